"""Positional look-ups: requests (pos, key, ...) keep their order and repeats, and what is missing is null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.bitmap16 import bits_between, from_bitmap


def mget(kv: DataFrame, requests: DataFrame) -> DataFrame:
    """pos, key, value."""
    return requests.select("pos", "key").join(kv.select("key", "value"), "key", "left").select("pos", "key", "value")


get = mget


def zmscore(z: DataFrame, requests: DataFrame) -> DataFrame:
    return requests.select("pos", "key", "member").join(z.select("key", "member", "score"), ["key", "member"], "left").select("pos", "key", "member", "score")


def zmdata(z: DataFrame, requests: DataFrame) -> DataFrame:
    """data: null of a missing member, empty of one without data."""
    found = z.select("key", "member", F.coalesce("data", F.lit("")).alias("data"))
    return requests.select("pos", "key", "member").join(found, ["key", "member"], "left").select("pos", "key", "member", "data")


def zdata_bm16(bits: DataFrame, requests: DataFrame, low: int = 0, high: int = 0) -> DataFrame:
    """pos, key, member, bit: a row for each set bit from low to high, of bits (key, member, bits)."""
    found = requests.select("pos", "key", "member").join(bits, ["key", "member"])
    return found.select("pos", "key", "member", F.explode(bits_between(F.col("bits"), low, high)).alias("bit"))


def with_bits(z: DataFrame) -> DataFrame:
    """key, member, bits of the sorted sets whose data are bitmaps in hexadecimal; other data have no bits."""
    bitmap = F.col("data").rlike("^([0-9a-fA-F]{66})+$")
    return z.select("key", "member", F.when(bitmap, from_bitmap(F.when(bitmap, F.unhex("data")))).otherwise(F.array().cast("array<int>")).alias("bits"))


def smismember(s: DataFrame, requests: DataFrame) -> DataFrame:
    found = s.select("key", "member", F.lit(1).alias("hit"))
    return requests.select("pos", "key", "member").join(found, ["key", "member"], "left").select("pos", "key", "member", F.coalesce("hit", F.lit(0)).alias("is_member"))


def smembers(s: DataFrame, keys=None) -> DataFrame:
    return s.select("key", "member") if keys is None else s.where(F.col("key").isin(list(keys))).select("key", "member")
