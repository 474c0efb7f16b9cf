"""A training corpus in five stages, each stored and read again as the next one's documents.

Every stage works on all that its predecessor kept and returns the columns of `documents`, but for the last, which returns the pieces of
packed sequences with their token ids. Decisions go by row, not by id: rows of null ids are judged too, of repeated rows one stays, and of two
texts of one id each is judged by itself. Null and empty texts count as one text, which the classifier scores like any other; texts of any
length are handled whole; columns of other names are carried along, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontaminate, exact_dedup, jaccard, packing, quality
from tarn.llm.common import staged, table, text_of, without_rows

#: DuckDB SQL can't express a trained classifier or a tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: those with a score of THRESHOLD or more."""
    model = quality.trained_on(spark, docs, sf_dir)
    return quality.scored(docs, model).where(F.col("_score") >= quality.THRESHOLD).drop("_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that of the least id (null last), of repeated rows the first."""
    number = F.monotonically_increasing_id()
    index = exact_dedup.DigestIndex(spark)
    gone = staged(index.dedup(docs, number=number).where("NOT kept").select("row"), "copies")
    index.close()
    return without_rows(docs, gone, number)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of similar ones; those without words stay."""
    gone = staged(jaccard.similar(docs).where("NOT kept").select("row").distinct(), "near-copies")
    return without_rows(docs, gone, jaccard.row_number_of(F.col("doc_id").cast("long"), text_of()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without_rows(docs, staged(found.where("n_hit > 0").select("row"), "contaminated"), F.monotonically_increasing_id())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
