"""Logical tables and the views over the test tables that queries run on.

A sorted set is rows of one table (key, member, score, data), for all keys at once; an operator takes and returns
DataFrames, and a single key is a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

ZSET = StructType([StructField("key", StringType()), StructField("member", StringType()), StructField("score", DoubleType(), False), StructField("data", StringType())])
SSET = StructType([StructField("key", StringType()), StructField("member", StringType())])
KV = StructType([StructField("key", StringType()), StructField("value", StringType())])
CMDLOG = StructType([StructField("shard", IntegerType()), StructField("id", LongType()), StructField("argv", ArrayType(StringType())), StructField("crc", LongType())])
METRICS = StructType([StructField("name", StringType()), StructField("ts", TimestampType()), StructField("value", DoubleType())])
BLOB = BinaryType()

#: Most rows that one scan returns in compatibility mode, most members of one write.
HARD_LIMIT, MOST_MEMBERS = 65535, 256


def valid_scores(z: DataFrame) -> DataFrame:
    """Rows with a score that is a number; -0.0 becomes 0.0."""
    return z.where("score IS NOT NULL AND NOT isnan(score)").withColumn("score", F.col("score") + F.lit(0.0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _z(df: DataFrame, key: Column, member: Column, score: Column, data: Column | None = None) -> DataFrame:
    return df.select(key.alias("key"), member.alias("member"), score.cast("double").alias("score"), (F.lit(None).cast("string") if data is None else data).alias("data"))


def zo(spark, d):
    """Customers' orders by price."""
    return _z(table(spark, d, "orders"), F.concat(F.lit("cust:"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"), F.col("o_totalprice"), F.col("o_orderpriority"))


def zc(spark, d):
    """Nations' customers by balance."""
    return _z(table(spark, d, "customer"), F.concat(F.lit("nation:"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey"), F.col("c_acctbal"), F.col("c_mktsegment"))


def zn(spark, d):
    """Regions' nations."""
    return _z(table(spark, d, "nation"), F.concat(F.lit("region:"), "n_regionkey"), F.concat(F.lit("nation:"), "n_nationkey"), F.col("n_nationkey"), F.col("n_name"))


def zps(spark, d):
    """Parts' suppliers by quantity sold."""
    sold = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return _z(sold, F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("supp:"), "l_suppkey"), F.col("q"))


def epoch(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def ze(spark, d):
    """Users' events by time; the data are JSON."""
    return _z(table(spark, d, "events"), F.concat(F.lit("user:"), "user_id"), F.col("event_id").cast("string"), epoch("ts"), F.col("props"))


def zt(spark, d):
    """Users by the summed value of each type of event."""
    summed = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 6).alias("v"))
    return _z(summed, F.concat(F.lit("ev:"), "event_type"), F.concat(F.lit("u"), "user_id"), F.col("v"))


def se(spark, d):
    """The set of users of each type of event."""
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.concat(F.lit("u"), "user_id").alias("member")).distinct()


def kv(spark, d):
    return table(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))


def series(spark, d):
    """Events as metric series named by their type."""
    return table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "value")
