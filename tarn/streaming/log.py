"""The command log: framing, checks, and its replay as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.keys import log_id_seconds, shard
from tarn.operators.mutate import COMMANDS, commands, fold

LOG = f"shard int, id long, crc long, {COMMANDS}"
_SIGNED = [x.split()[0] for x in COMMANDS.split(", ")]


def _crc() -> Column:
    return F.crc32(F.to_json(F.struct(*_SIGNED)))


def framed(cmds: DataFrame) -> DataFrame:
    """Commands as log rows: shard of the key, id (the order of seq), crc of what is written."""
    return commands(cmds).select(shard(F.col("key")).alias("shard"), F.col("seq").alias("id"), _crc().alias("crc"), "*")


def append(cmds: DataFrame, path: str) -> None:
    framed(cmds).write.mode("append").parquet(path)


def checked(log: DataFrame) -> DataFrame:
    """Rows whose crc is right, once for each shard and id: a batch that comes twice changes nothing."""
    return log.where(F.col("crc") == _crc()).dropDuplicates(["shard", "id", "pos"])


def replay(z: DataFrame, log: DataFrame) -> DataFrame:
    return fold(z, checked(log))


def retained(log: DataFrame, now_seconds: int, ttl: int = 86_400) -> DataFrame:
    return log.where(log_id_seconds(F.col("id")) >= now_seconds - ttl)


def follow(spark: SparkSession, path: str, state: str, checkpoint: str, files_per_batch: int = 1000, trigger: dict | None = None):
    """A streaming query that folds each new batch of the log at `path` into the next version of the table under `state`.

    A version is a list (`applied`) of the shards with the last id applied and the batch that wrote them: a batch reads and writes only the shards
    that it has commands for. A batch that is repeated after a failure writes the same version again from the one before. Commands up to the last id of their shard are passed over, so those that
    are appended again in another file are applied once; the files of a shard come in order of id. Start it with trigger {"availableNow": True} to catch up and end.
    """

    def step(batch: DataFrame, number: int) -> None:
        last = applied(spark, state, number - 1)
        new = batch.join(last, "shard", "left").where("last IS NULL OR id > last").select(*batch.columns)
        touched = [r["shard"] for r in new.where(F.col("crc") == _crc()).select("shard").distinct().collect()]  # SHARDS at most
        if touched:
            after = replay(version(spark, state, number - 1, touched), new).withColumn("shard", shard(F.col("key")))
            after.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{state}/v={number:012d}")
        ids = last.union(new.where(F.col("crc") == _crc()).select("shard", F.col("id").alias("last"), F.lit(number).cast("long").alias("v")))
        ids.groupBy("shard").agg(F.max("last").alias("last"), F.max("v").alias("v")).coalesce(1).write.mode("overwrite").parquet(f"{state}/ids={number:012d}")

    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def version(spark: SparkSession, state: str, number: int, shards: list[int] | None = None) -> DataFrame:
    """The table after batch `number`, or these shards of it, each from the batch that wrote it last; empty before the first."""
    wrote: dict[int, list[int]] = {}
    for r in applied(spark, state, number).collect():
        if shards is None or r["shard"] in shards:
            wrote.setdefault(r["v"], []).append(r["shard"])
    schema = "key string, member string, score double, data string"
    out = spark.createDataFrame([], schema)
    for v, some in sorted(wrote.items()):
        part = spark.read.schema(f"{schema}, shard int").parquet(f"{state}/v={v:012d}")
        out = out.union(part.where(F.col("shard").isin(some)).drop("shard"))
    return out


def applied(spark: SparkSession, state: str, number: int) -> DataFrame:
    """shard, last, v: the last id of each shard in a version, and the batch that wrote the shard."""
    schema = "shard int, last long, v long"
    return spark.createDataFrame([], schema) if number < 0 else spark.read.schema(schema).parquet(f"{state}/ids={number:012d}")


def latest(spark: SparkSession, state: str) -> DataFrame:
    """The newest version; an empty table before the first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(state)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{state}/ids=*/_SUCCESS"))
    return version(spark, state, max((int(x.getPath().getParent().getName()[4:]) for x in done or []), default=-1))


def windowed_rates(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Streaming sums of a metric stream (name, ts, value) by tumbling minute, with late rows up to a watermark."""
    return events.withWatermark("ts", late).groupBy("name", F.window("ts", "1 minute")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.max("value").alias("x"))
