"""Key derivation, shards, masks, log ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Shards of the command log; the offset basis and prime of 64-bit FNV.
SHARDS = 32
_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3


def concat_key(member: Column, prefix: str, start: int | None = None, end: int | None = None, suffix: str = "") -> Column:
    """prefix + member, or prefix + member[start..end] + suffix: indices are of bytes, count from the end where negative and wrap at the length. Null where the part is empty."""
    if start is None:
        return F.concat(F.lit(prefix), member)
    n = F.octet_length(member)
    a, b = F.pmod(F.lit(start), n), F.pmod(F.lit(end), n)
    return F.when((n > 0) & (b >= a), F.concat(F.lit(prefix), F.substring(member.cast("binary"), a + 1, b - a + 1).cast("string"), F.lit(suffix)))


def tag(key: Column) -> Column:
    """What is between the first `{` and the next `}`, empty too, else the whole key: keys of one tag share a shard."""
    return F.when(key.rlike(r"\{[^}]*\}"), F.regexp_extract(key, r"\{([^}]*)\}", 1)).otherwise(key)


def shard(key: Column) -> Column:
    """A shard by Spark's own hash; all keys of a tag are together."""
    return F.pmod(F.xxhash64(tag(key)), F.lit(SHARDS)).cast("int")


def fnv1(raw: bytes) -> int:
    h = _BASIS
    for b in raw:
        h = h * _PRIME & (1 << 64) - 1 ^ b
    return h


@F.pandas_udf(IntegerType())
def _fnv(key: pd.Series) -> pd.Series:
    return pd.Series([fnv1(k.encode()) % SHARDS for k in key])


def fnv_shard(key: Column) -> Column:
    """The shard by FNV-1 of the tag, for exchange with systems that use it."""
    return _fnv(tag(key))


def bits_mask(high: int, low: int) -> int:
    """A mask of the bits from low to high, both included."""
    if not 0 <= low <= high <= 63:
        raise ValueError("bits must be 0 <= low <= high <= 63")
    value = (1 << (high - low + 1)) - 1 << low
    return value - (1 << 64) if value >> 63 else value


def log_id_seconds(log_id: Column) -> Column:
    """Seconds of a log id, which holds them above 28 bits of a counter."""
    return F.shiftright(log_id, 28)


def proxy_slot(key: Column) -> Column:
    return (F.crc32(tag(key)) % 1024).cast("int")
