"""Exact dedup: a persistent digest index, bucketed and sorted by hash, with sort-merge anti-joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import SPACES, new_path, staged, table, text_of


class DigestIndex:
    """Digests of all texts seen so far with the id that keeps each, as a table bucketed and sorted by digest.

    `path` makes it durable: a later session opens the same path with the same number of buckets (another number is refused). New data are
    grouped by digest, anti-joined with the index by sort-merge, and what is new is appended in one commit, so a
    lost executor or a repeated run changes nothing: a document that the index already names keeps its place.

    Null texts count as empty; an empty table adds nothing; of rows with one text the smallest id stays and null ids
    come last (a group of null ids alone keeps null and all its rows); repeated rows of one id are kept alike; other
    columns are never read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        path = path or new_path(spark, "digest-index")
        self._same_buckets(path)
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _same_buckets(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        marks = jvm.org.apache.hadoop.fs.Path(path)
        files = marks.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(marks):
            found = [x.getPath().getName() for x in files.listStatus(marks) if x.getPath().getName().startswith("_buckets-")]
            if found and found != [f"_buckets-{self.buckets}"]:
                raise ValueError(f"{path} has {found[0].removeprefix('_buckets-')} buckets, not {self.buckets}")
        files.mkdirs(marks)
        files.create(jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets-{self.buckets}"), True).close()

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", number=None) -> DataFrame:
        """One row per row of `docs`: doc_id, keep_id, group_size (rows of this text in `docs`), kept, digest.

        With `number`, an expression that numbers the rows of `docs` (given back as row), exactly one row of each text is kept: of repeated
        rows of the id that keeps it, or of null ids alone, that of the least number.
        """
        text = F.regexp_replace(text_of(text_col), SPACES, " ")
        row = [number.alias("row")] if number is not None else []
        digests = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), *row), "digests")
        first = [F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row"))["row"].alias("first_row")] if row else []
        groups = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"), *first)
        fresh = groups.join(self.table().hint("merge"), "digest", "left_anti")
        fresh.select("digest", "first_id").write.insertInto(self.name)
        # stored, so that the join below has a plain shuffle on each side, whose hot digests are split at run time
        named = staged(groups.join(self.table().hint("merge"), "digest").select("digest", "keep_id", "group_size", *["first_row"] * len(first)), "digest-groups")
        kept = "doc_id <=> keep_id AND row = first_row" if row else "doc_id <=> keep_id"
        return digests.join(named.hint("merge"), "digest").select("doc_id", "keep_id", "group_size", F.expr(kept).alias("kept"), "digest", *["row"] * len(row))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    index = DigestIndex(spark)
    out = index.dedup(table(spark, sf_dir, "documents"))
    index.close()  # the result reads stored tables only
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
