"""Benchmark decontamination: a positional inverted index, phrase and proximity search from the rarest terms."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm.common import bounded_broadcast, staged, table, text_of

#: A word: ASCII digits, letters, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Most rows of a stored list that is broadcast; beyond it the join is shuffled.
MOST_ROWS = 1_000_000


def words(text):
    """Words in order, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


class PositionalIndex:
    """Postings (row, pos, term) of all documents for the terms of a test set, stored without a shuffle, partitioned by document.

    `row` numbers the rows of the documents; a last posting of the empty term gives each row's doc_id and, as pos, its
    number of words. Terms that no test text has can match nothing and are not stored. Null and empty texts have that last
    posting alone; null or repeated ids are separate rows; other columns are unread.
    """

    def __init__(self, docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        terms = staged(vocabulary.select("term").where("term != ''").distinct().union(vocabulary.sparkSession.sql("SELECT '' AS term")), "terms")
        terms = terms.select(F.xxhash64("term").alias("h"), F.col("term").alias("text_term"))
        # numbered first: beside the generator, each of its rows would get a number
        rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(text_col).alias("text"))
        tokens = rows.select("doc_id", "row", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "word"))
        tokens = tokens.withColumn("h", F.xxhash64("word"))
        hit = tokens.join(bounded_broadcast(terms, MOST_ROWS), (tokens.h == terms.h) & (tokens.word == terms.text_term)).select("row", "pos", tokens.h.alias("term"), F.when(F.col("word") == "", F.col("doc_id")).alias("doc_id"))
        self.postings = staged(hit, "postings")
        self.end = F.xxhash64(F.lit(""))

    def documents(self) -> DataFrame:
        return self.postings.where(F.col("term") == self.end).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))

    def rarity(self) -> DataFrame:
        """Occurrences of each term, over all documents."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def phrases(self, items: DataFrame, length: int = 10) -> DataFrame:
        """Runs of `length` or more consecutive item words that occur in a document: item, row, at (position of the run's first word), n (its words).

        items: item, n_terms, off, term. An item of fewer words counts whole. For each window the two rarest terms are
        looked up; their lists, adjusted by the offset, must agree on where the item would begin; only there are the lists of
        the other terms intersected.
        """
        counted = items.join(self.rarity(), "term", "left").select("item", "n_terms", "off", "term", F.coalesce("df", F.lit(0)).alias("df"))
        whole = counted.groupBy("item", "n_terms").agg(F.sort_array(F.collect_list(F.struct("off", "term", "df"))).alias("t"))
        span = F.least(F.lit(length), F.col("n_terms"))
        window = whole.select("item", "n_terms", span.alias("span"), F.explode(F.transform(F.sequence(F.lit(0), F.col("n_terms") - span), lambda i: F.slice("t", i + 1, span))).alias("w"))
        rarest = F.slice(F.array_sort(F.transform("w", lambda x: F.struct(x.df.alias("df"), x.off.alias("off"), x.term.alias("term")))), 1, 2)
        anchors = staged(window.select("item", "n_terms", F.explode(rarest).alias("a")).select("item", "n_terms", "a.off", "a.term").distinct(), "anchors")
        lists = self.postings.select("row", "pos", "term").join(bounded_broadcast(anchors, MOST_ROWS), "term")
        begin = lists.groupBy("item", "n_terms", "row", (F.col("pos") - F.col("off")).alias("begin")).agg(F.count(F.lit(1)).alias("agree"))
        begin = staged(begin.where(F.col("agree") >= F.least(F.lit(2), F.col("n_terms"))).select("item", "row", "begin"), "begins")
        rows = staged(begin.select("row").distinct(), "begin-rows")
        near = self.postings.select("row", "pos", "term").join(bounded_broadcast(rows, MOST_ROWS), "row", "left_semi")
        due = begin.join(bounded_broadcast(staged(items.select("item", "n_terms", "off", "term"), "item-terms"), MOST_ROWS), "item").withColumn("pos", F.col("begin") + F.col("off"))
        met = due.join(near, ["row", "pos", "term"]).select("item", "n_terms", "row", "begin", "off")
        place = F.row_number().over(W.partitionBy("item", "row", "begin").orderBy("off"))
        runs = met.withColumn("run", F.col("off") - place).groupBy("item", "n_terms", "row", "begin", "run").agg(F.min("off").alias("low"), F.count(F.lit(1)).alias("n"))
        return runs.where(F.col("n") >= F.least(F.lit(length), F.col("n_terms"))).select("item", "row", (F.col("begin") + F.col("low")).alias("at"), "n")

    def near(self, items: DataFrame, slop: int = 20) -> DataFrame:
        """Proximity matches: item, row, pos of an occurrence of the item's rarest term with all its other terms at most `slop` words away."""
        counted = items.select("item", "term").distinct().join(self.rarity(), "term", "left").select("item", "term", F.coalesce("df", F.lit(0)).alias("df"))
        rarest = counted.groupBy("item").agg(F.min(F.struct("df", "term")).term.alias("rare"), F.count(F.lit(1)).alias("n"))
        lists = self.postings.select("row", "pos", "term").withColumn("cell", F.floor(F.col("pos") / slop).cast("long"))
        at = lists.withColumnRenamed("term", "rare").join(rarest, "rare").withColumnRenamed("pos", "at")
        at = at.select("item", "n", "row", "at", "rare", F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)])).alias("cell"))
        other = at.join(counted.select("item", "term"), "item").join(lists, ["row", "cell", "term"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
        return other.groupBy("item", "n", "row", "at").agg(F.count_distinct("term").alias("met")).where("met = n").select("item", "row", F.col("at").alias("pos"))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Test texts as terms: item_id, item (a row's number), n_terms, off, word, term; stored."""
    base = items.select(F.col(id_col).alias("item_id"), F.monotonically_increasing_id().alias("item"), words(text_of(text_col)).alias("w"))
    out = base.select("item_id", "item", F.size("w").alias("n_terms"), F.posexplode("w").alias("off", "word"))
    return staged(out.withColumn("term", F.xxhash64("word")), "items")


def contaminated(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit (words inside any occurrence of a window of `length` item words), item_ids (sorted as strings), n_items, row (its number by `monotonically_increasing_id`).

    An item of fewer words, but not none, is one window; null and empty texts have no words; items of a null id are
    searched but not listed; items of one id count once; an empty table on either side gives no hits.
    """
    terms = item_terms(items)
    index = PositionalIndex(docs, terms.select(F.col("word").alias("term")))
    found = staged(index.phrases(terms, length), "phrases")
    hits = found.select("row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    names = terms.select("item", "item_id").distinct()
    which = found.select("row", "item").distinct().join(bounded_broadcast(names, MOST_ROWS), "item").groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    out = index.documents().join(hits, "row", "left").join(which, "row", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), "row")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT item_id, least(10, len(w)) AS span, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), spans AS (SELECT DISTINCT span FROM bw),
dw AS (
  SELECT doc_id, span, i, array_to_string(list_slice(w, i, i + span - 1), ' ') AS k
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)
), m AS (SELECT dw.doc_id, dw.i, dw.span, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.span = bw.span),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i, unnest(range(0, span)) AS j FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
