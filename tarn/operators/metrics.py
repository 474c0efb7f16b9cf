"""Metric series (name, ts, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of a bucket; buckets of the last minute, five minutes and hour without the current one.
BUCKET, SPANS = 20, {"m1": 3, "m5": 15, "all": 179}


def names(m: DataFrame) -> DataFrame:
    return m.select("name").distinct()


def fill_series(m: DataFrame, start=None, end=None) -> DataFrame:
    """name, minute, value: the last value of each minute from start to end (of the series, where none is given); NaN and missing minutes are 0."""
    by = m if start is None else m.where((F.col("ts") >= start) & (F.col("ts") < end))
    minute = F.date_trunc("minute", "ts")
    last = by.groupBy("name", minute.alias("minute")).agg(F.max_by("value", "ts").alias("v"))
    ends = last.groupBy("name").agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    grid = ends.select("name", F.explode(F.sequence("a", "b", F.expr("interval 1 minute"))).alias("minute"))
    return grid.join(last, ["name", "minute"], "left").select("name", "minute", F.coalesce(F.nanvl("v", F.lit(0.0)), F.lit(0.0)).alias("value"))


def sliding_stats(m: DataFrame) -> DataFrame:
    """name, bucket (seconds), and qps, mean, max over the last minute, 5 minutes and hour before each bucket that has values.

    Values are summed in buckets before the shuffle; frames run over buckets. Without values a mean and a max are null.
    """
    sec = F.floor(F.unix_micros("ts") / 1_000_000 / BUCKET) * BUCKET
    part = m.groupBy("name", sec.cast("long").alias("bucket")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"), F.max("value").alias("x"))
    out = ["name", "bucket"]
    for label, k in SPANS.items():
        w = W.partitionBy("name").orderBy("bucket").rangeBetween(-k * BUCKET, -BUCKET)
        n = F.coalesce(F.sum("n").over(w), F.lit(0))
        seconds = 3600 if label == "all" else k * BUCKET
        out += [(n / seconds).alias(f"qps_{label}"), (F.sum("v").over(w) / F.nullif(n, F.lit(0))).alias(f"mean_{label}"), F.max("x").over(w).alias(f"max_{label}")]
    return part.select(*out)


def p99_by_minute(m: DataFrame, exact: bool = False) -> DataFrame:
    """name, minute, p99; by a mergeable sketch unless an exact one is asked for."""
    p = F.percentile("value", 0.99) if exact else F.percentile_approx("value", 0.99, 10_000)
    return m.groupBy("name", F.date_trunc("minute", "ts").alias("minute")).agg(p.alias("p99"))


def chart(m: DataFrame, *series: str) -> DataFrame:
    """minute and a column for each series."""
    return fill_series(m.where(F.col("name").isin(*series))).groupBy("minute").pivot("name", list(series)).agg(F.first("value"))


def retained(m: DataFrame, now, days: int = 30) -> DataFrame:
    return m.where(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def without(m: DataFrame, name: str) -> DataFrame:
    return m.where(F.col("name") != name)
