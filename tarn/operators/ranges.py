"""Range selection, counts and ranks of sorted sets, for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.bounds import lex_between, score_between
from tarn.functions.match import match_expr
from tarn.model import HARD_LIMIT
from tarn.sources.tables import stored


def order(rev: bool = False, lex: bool = False) -> list[Column]:
    """By score, then member; a reversed order turns both."""
    return [F.col(c).desc() if rev else F.col(c).asc() for c in (["member"] if lex else ["score", "member"])]


def top(z: DataFrame, n: int, by: list[Column]) -> DataFrame:
    """The first n rows of each key. What is over n is dropped in each task before the shuffle."""
    if n <= 0:
        return z.where(F.lit(False))
    return z.withColumn("_n", F.row_number().over(W.partitionBy("key").orderBy(*by))).where(F.col("_n") <= n).drop("_n")


def _only(z: DataFrame, keys) -> DataFrame:
    return z if keys is None else z.where(F.col("key").isin(list(keys)))


def zrangebyscore(z, low, high, *, keys=None, rev=False, limit=None, match=None, with_data=False) -> DataFrame:
    """Rows with a score in the interval; a reversed call gives (high, low). Matching goes before the limit, which is for each key."""
    if rev:
        low, high = high, low
    out = _only(z, keys).where(score_between(F.col("score"), low, high))
    if match:
        out = out.where(match_expr(match, F.col("member"), F.col("data")))
    out = out.select("key", "member", "score", *(["data"] if with_data else []))
    return out if limit is None else top(out, min(limit, HARD_LIMIT), order(rev))


def zrangebylex(z, low, high, *, keys=None, rev=False, limit=None, match=None, with_data=False) -> DataFrame:
    if rev:
        low, high = high, low
    out = _only(z, keys).where(lex_between(F.col("member"), low, high))
    if match:
        out = out.where(match_expr(match, F.col("member"), F.col("data"), "member"))
    out = out.select("key", "member", "score", *(["data"] if with_data else []))
    return out if limit is None else top(out, min(limit, HARD_LIMIT), order(rev, lex=True))


def numbered(z: DataFrame, by: list[Column]) -> DataFrame:
    """Rows with `rank`, their position in their key (never null) from 0; no task holds a whole key.

    Rows are dealt by intervals of (key, order) and stored; each is numbered within its interval, from what the intervals of its key before it hold.
    """
    dealt = stored(z.repartitionByRange("key", *by).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("key", "_part", (F.sum("_n").over(W.partitionBy("key").orderBy("_part")) - F.col("_n")).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("key", "_part").orderBy(*by)) - 1)
    return own.join(before, ["key", "_part"]).withColumn("rank", (F.col("_own") + F.col("_before")).cast("long")).select(*z.columns, "rank")


def _first(z: DataFrame, n: int, by: list[Column]) -> DataFrame:
    """`top`, with the rank."""
    rank = F.row_number().over(W.partitionBy("key").orderBy(*by))
    return z.withColumn("_n", rank).where(F.col("_n") <= max(0, n)).withColumn("rank", (F.col("_n") - 1).cast("long")).drop("_n")


def zrange(z, start: int, stop: int, *, keys=None, rev=False, limit=None, with_data=False) -> DataFrame:
    """Rows by position, from start to stop, both included and from the end where negative; adds rank.

    Where an end or a limit bounds the rows of a key, only so many rows of a task are shuffled, counted from the front or the back; a position from the other
    side takes a count of the key. From a front position to one from the end, without a limit, all rows are numbered (`numbered`).
    """
    out = _only(z, keys).select("key", "member", "score", *(["data"] if with_data else []))
    counts = out.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    most = None if limit is None else min(limit, HARD_LIMIT)
    if start < 0 and stop < 0:
        out = _first(out, -start, order(not rev)).where(F.col("rank") >= -stop - 1)
        out = out.join(counts, "key").withColumn("rank", F.col("_n") - 1 - F.col("rank")).drop("_n")
    elif stop >= 0:
        out = _first(out, stop + 1, order(rev))
        out = out.where(F.col("rank") >= start) if start >= 0 else out.join(counts, "key").where(F.col("rank") >= F.col("_n") + start).drop("_n")
    else:
        ranked = numbered(out, order(rev)) if most is None else _first(out, start + most, order(rev))
        ranked = ranked.where(F.col("rank") >= start)
        out = ranked if stop == -1 else ranked.join(counts, "key").where(F.col("rank") <= F.col("_n") + stop).drop("_n")
    return out if most is None else top(out, most, [F.col("rank")])


def zcount(z, low, high, *, lex=False, match=None, compat=False) -> DataFrame:
    """key, n. In compatibility mode a count stops at the hard limit."""
    inside = lex_between(F.col("member"), low, high) if lex else score_between(F.col("score"), low, high)
    out = z.where(inside)
    if match:
        out = out.where(match_expr(match, F.col("member"), F.col("data"), "member" if lex else "either"))
    n = F.count(F.lit(1))
    return out.groupBy("key").agg((F.least(n, F.lit(HARD_LIMIT)) if compat else n).alias("n"))


def zcard(z) -> DataFrame:
    return z.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


scard = zcard


def zrank(z, *, rev=False, max_rank: int | None = None) -> DataFrame:
    """key, member, rank (from 0) of all members (`numbered`), or of those up to max_rank, which alone are shuffled."""
    out = z.select("key", "member", "score")
    ranked = numbered(out, order(rev)) if max_rank is None else _first(out, max_rank + 1, order(rev))
    return ranked.drop("score")


def zrank_of(z, requests: DataFrame, *, rev=False, max_rank: int | None = None) -> DataFrame:
    """key, member, rank of requested (key, member): counts the rows in front, with no sort of a whole key; null if missing or beyond max_rank, where one is given.

    Each request meets all rows of its key: for many requests, join them with `zrank`."""
    asked = requests.select("key", "member").distinct()
    own = asked.join(z.select("key", "member", F.col("score").alias("own")), ["key", "member"])
    ahead = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("other") > F.col("member")))
    if not rev:
        ahead = (F.col("score") < F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("other") < F.col("member")))
    pairs = own.join(z.select("key", F.col("member").alias("other"), "score"), "key")
    n = pairs.groupBy("key", "member").agg(F.sum(ahead.cast("long")).alias("rank"))
    if max_rank is not None:
        n = n.where(F.col("rank") <= max_rank)
    return asked.join(n, ["key", "member"], "left")


def zrange_buckets(z, low, high, size: float) -> DataFrame:
    """Rows in the interval and the lower end of their bucket of scores (norm)."""
    return zrangebyscore(z, low, high).withColumn("norm", F.floor(F.col("score") / size) * size)
