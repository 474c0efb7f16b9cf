"""Stored tables: places in the shared folder, snapshots, exports, imports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.match import match_expr


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the session names as shared; in a temporary one of this machine where it names none, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/tarn-{name}-{uuid.uuid4().hex[:12]}"


def snapshot(z: DataFrame, path: str) -> None:
    """A version of a sorted-set table, laid out by key and score so that scans of an interval skip row groups."""
    z.repartitionByRange("key", "score").sortWithinPartitions("key", "score", "member").write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The sorted sets of a snapshot."""
    return spark.read.schema("key string, member string, score double, data string").parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again, so that what led to it is not planned again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_rows(z: DataFrame, from_key: str | None = None, to_key: str | None = None, low: float = float("-inf"), high: float = float("inf"), match: str | None = None, with_data: bool = False) -> DataFrame:
    """Rows of all keys from..to with a score in low..high (both ends included): key, score, member and, if asked for, data."""
    out = z.where((F.col("score") >= low) & (F.col("score") <= high))
    out = out if from_key is None else out.where(F.col("key") >= from_key)
    out = out if to_key is None else out.where(F.col("key") <= to_key)
    if match:
        out = out.where(match_expr(match, F.col("member"), F.col("data")))
    return out.select("key", "score", "member", *(["data"] if with_data else []))


def export_csv(z: DataFrame, path: str, **choice) -> None:
    """export_rows as gzip CSV, sorted over all files."""
    rows = export_rows(z, **choice)
    rows.repartitionByRange("key", "score", "member").sortWithinPartitions("key", "score", "member").write.option("compression", "gzip").csv(path)


def read_export(spark: SparkSession, path: str, with_data: bool = False) -> DataFrame:
    return spark.read.schema("key string, score double, member string" + ", data string" * with_data).csv(path)


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: file, value."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")
