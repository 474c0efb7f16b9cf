"""Shared pieces: the shared folder, staged tables, row keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []

#: Whether Spark deletes the shuffle files of a write at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: `\s` of ASCII, as a Java and RE2 class.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; in local mode a temporary one where it names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarn-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again: cuts the lineage and survives lost executors.

    Once the table is written, nothing needs the shuffles that led to it, so their files go at the end of the write.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def sweep() -> None:
    """Delete the staged tables of this process; results that still read them end with it."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: nothing can be deleted through it
            continue


atexit.register(sweep)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Rows in a batch that goes to Python: whole texts are long, so few."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """`df` (a stored table) marked for broadcast where it has at most `most_rows` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most_rows else df


def without_rows(docs: DataFrame, gone: DataFrame, number, most_rows: int = 1_000_000) -> DataFrame:
    """`docs` but for the rows whose number (an expression over `docs`) is in the stored list `gone` (row), which is broadcast only up to `most_rows` rows."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    gone = gone.select(F.col("row").alias(name))
    return docs.withColumn(name, number).join(bounded_broadcast(gone, most_rows), name, "left_anti").select(*docs.columns)


#: Bits of a filter over hashes: at least, and at most (32 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def filter_bits(rows: int) -> int:
    """Bits, a power of two, for a filter over so many hashes: 16 for each, within fixed bounds."""
    return max(LEAST_BITS, min(MOST_BITS, 1 << (16 * rows).bit_length()))


def bit_filter(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """`bits` bits (a power of two), packed, with those set that the hashes of a stored column (long) name. What comes to the driver is these bits, whatever the input."""
    slot = F.expr(f"pmod({column}, {bits}L) + 1")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in hashes.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect():
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["m"], dtype=np.uint8)
    return out


def hits(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64) have their bit set."""
    slot = hashes.view(np.uint64) & np.uint64(8 * len(packed) - 1)
    return (packed[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
