"""The catalog of names, and paging by a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.match import match_expr
from tarn.model import HARD_LIMIT

#: Types in the order of a scan.
KINDS = ("zset", "set", "string")


def catalog(z: DataFrame, s: DataFrame, kv: DataFrame, match: str | None = None) -> DataFrame:
    """key, kind, size: members of a set, bytes of a value; a name is there once for each of its kinds."""
    count = F.count(F.lit(1)).alias("size")
    parts = [
        z.groupBy("key").agg(count).withColumn("kind", F.lit("zset")),
        s.groupBy("key").agg(count).withColumn("kind", F.lit("set")),
        kv.select("key", F.octet_length("value").cast("long").alias("size"), F.lit("string").alias("kind")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if match:
        out = out.where(match_expr(match, F.col("key"), None, "member"))
    return out.select("key", "kind", "size")


def _kind_order():
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))


def scan(names: DataFrame, cursor: tuple[str, str] | None = None, count: int = HARD_LIMIT) -> DataFrame:
    """A page of the catalog from the cursor (kind, key) on, in order of kind and key, and one row more: the next cursor."""
    out = names.withColumn("_k", _kind_order())
    if cursor:
        k = KINDS.index(cursor[0]) + 1
        out = out.where((F.col("_k") > k) | ((F.col("_k") == k) & (F.col("key") >= cursor[1])))
    return out.orderBy("_k", "key").limit(min(count, HARD_LIMIT) + 1).drop("_k")


def sscan(s: DataFrame, key: str, cursor: str = "", count: int = HARD_LIMIT, match: str | None = None) -> DataFrame:
    """A page of a set's members from the cursor on, and one row more."""
    out = s.where((F.col("key") == key) & (F.col("member") >= cursor))
    if match:
        out = out.where(match_expr(match, F.col("member"), None, "member"))
    return out.select("member").orderBy("member").limit(min(count, HARD_LIMIT) + 1)


def distinct_keys(df: DataFrame, cursor: str = "") -> DataFrame:
    return df.where(F.col("key") >= cursor).select("key").distinct()


def disk_size(z: DataFrame, s: DataFrame, kv: DataFrame, from_key: str | None = None, to_key: str | None = None) -> DataFrame:
    """kind, bytes of keys, members, scores and data of the names from..to."""

    def part(df, kind, *columns, fixed=0):
        if from_key is not None:
            df = df.where((F.col("key") >= from_key) & (F.col("key") <= (to_key or from_key)))
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(fixed))
        return df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).select(F.lit(kind).alias("kind"), "bytes")

    return part(z, "zset", "key", "member", "data", fixed=8).unionByName(part(s, "set", "key", "member")).unionByName(part(kv, "string", "key", "value"))
