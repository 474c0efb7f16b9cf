"""Filters of sorted sets by others, and children of members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.bloom import bloom_agg, bloom_contains
from tarn.functions.bounds import parse_number


def intersect(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows whose member is in each of the others."""
    return reduce(lambda df, o: df.join(o.select("member").distinct(), "member", "left_semi"), others, left)


def notintersect(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows whose member is in none of the others."""
    return reduce(lambda df, o: df.join(o.select("member").distinct(), "member", "left_anti"), others, left)


def in_bloom(left: DataFrame, blob: bytes) -> DataFrame:
    return left.where(bloom_contains(F.col("member"), blob))


def members_bloom(left: DataFrame, fpr: float, size: int, rev: bool = False, lex: bool = False) -> DataFrame:
    """One row for the rows of one key: first, first_score, first_data, last, last_score, last_data, n, bloom (a filter of their members for `size` of them); none for no rows."""
    place = F.struct(*(["member", "score", "data"] if lex else ["score", "member", "data"]))
    ends = left.agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n")).where("n > 0")
    first, last = ("high", "low") if rev else ("low", "high")
    bloom = bloom_agg(left.select(F.lit("").alias("_all"), "member"), "_all", "member", size, fpr).select("bloom")
    cols = [F.col(f"{e}.{c}").alias(name + {"member": ""}.get(c, f"_{c}")) for e, name in ((first, "first"), (last, "last")) for c in ("member", "score", "data")]
    return ends.select(*cols, "n").join(F.broadcast(bloom))


def nested(children: DataFrame) -> DataFrame:
    """One row for each row that went into `fanout`, in which its children are an array (member, score, data) in order: the reply as a tree."""
    own = [c for c in children.columns if c not in ("pos", "child", "child_score", "child_data")]
    son = F.when(F.col("pos") > 0, F.struct("pos", F.col("child").alias("member"), F.col("child_score").alias("score"), F.col("child_data").alias("data")))
    return children.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(son)), lambda x: F.struct(x["member"].alias("member"), x["score"].alias("score"), x["data"].alias("data"))).alias("children"))


def two_hops(left: DataFrame, z: DataFrame, member: str, key_expr: Column | None = None) -> DataFrame:
    """Rows whose derived key's sorted set holds `member`."""
    held = z.where(F.col("member") == member).select(F.col("key").alias("_hop")).distinct()
    return left.join(held, F.coalesce(key_expr, F.lit(None)) == F.col("_hop") if key_expr is not None else F.col("member") == F.col("_hop"), "left_semi")


def fanout(left: DataFrame, z: DataFrame, low, high, n: int, key_expr: Column | None = None, limit: int | None = None) -> DataFrame:
    """Each row of `left` with its first n children: those of its derived key's sorted set from low up to, without, high; downwards where low > high.

    Adds pos (0 for a row without children), child, child_score, child_data; a row without children stays. A limit counts rows and children, in the order of the rows.
    """
    a, b = (parse_number(x.lstrip("([") if isinstance(x, str) else x) for x in (low, high))
    down = a > b
    a, b = min(a, b), max(a, b)
    by = [F.col(c).desc() if down else F.col(c).asc() for c in ("child_score", "child")]
    sons = z.where((F.col("score") >= a) & (F.col("score") < b)).select(F.col("key").alias("_son"), F.col("member").alias("child"), F.col("score").alias("child_score"), F.col("data").alias("child_data"))
    sons = sons.withColumn("pos", F.row_number().over(W.partitionBy("_son").orderBy(*by))).where(F.col("pos") <= n)
    out = left.withColumn("_to", F.col("member") if key_expr is None else key_expr).join(sons, F.col("_to") == F.col("_son"), "left").drop("_to", "_son")
    out = out.withColumn("pos", F.coalesce("pos", F.lit(0)))
    if limit is None:
        return out
    # a row takes one place, and each child one
    w = W.partitionBy("key").orderBy("score", "member", "pos")
    place = F.row_number().over(w) + F.sum(F.when(F.col("pos") <= 1, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.when(F.col("pos") == 0, 1).otherwise(0)
    return out.withColumn("_at", place).where(F.col("_at") <= limit).drop("_at")


def union_topk(*zs: DataFrame, rev: bool = False, limit: int | None = None) -> DataFrame:
    """All rows of all inputs, repeats kept, in order of (score, member, key); the first `limit`."""
    out = reduce(DataFrame.unionByName, zs)
    by = [F.col(c).desc() if rev else F.col(c).asc() for c in ("score", "member", "key")]
    return out.orderBy(*by) if limit is None else out.orderBy(*by).limit(limit)
