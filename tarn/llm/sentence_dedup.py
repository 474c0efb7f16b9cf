"""Substring dedup: sliding spans of consecutive sentences, which are cut into clauses."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import bit_filter, filter_bits, hits, small_batches, staged, table, text_of
from tarn.llm.textvec import mix, power_tables, words_of

#: Words that a span has at least: half of a passage of 50, as a passage may begin and end within clauses.
LEAST_WORDS = 25

#: Scripts without spaces between words (and their punctuation): each of their letters counts as a word.
SINGLE = "฀-໿က-႟ក-៿　-ヿ㐀-鿿豈-﫿＀-￯\U00020000-\U0003ffff"
_BLANK = r"\x20\x09-\x0D"
WORD = rf"[{SINGLE}]|[^{_BLANK}{SINGLE}]+"
#: A word with the white space before it.
PIECE = rf"[{_BLANK}]*(?:{WORD})"
#: Last characters of a word that ends a clause: those that end or part sentences, and an s, so that clauses without any are cut as well.
ENDS = ".!?,;:s。！？．，、；：؟۔।"

_U = np.uint64
_NO_ID = -(2**63)
#: First bytes of UTF-8 of the letters in SINGLE.
_FAR = re.compile(rb"[\xe0\xe1\xe3-\xe9\xef\xf0]")
_SINGLE = re.compile(f"([{SINGLE}])")
_PIECE = re.compile(PIECE)
_END_CODES = {k: np.array([int.from_bytes(c.encode(), "big") for c in ENDS if len(c.encode()) == k]) for k in (1, 2, 3)}


def _spaced(raw: bytes) -> bytes:
    """The text with spaces around the letters that are words by themselves."""
    if not _FAR.search(raw):
        return raw
    return _SINGLE.sub(r" \1 ", raw.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")


def _ends_clause(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the words that end before these places end a clause."""
    code, out = data[ends - 1].astype(np.int64), np.zeros(len(ends), dtype=bool)
    for k in (1, 2, 3):
        if k > 1:
            code |= np.where(ends >= k, data[ends - k].astype(np.int64), 0) << (8 * (k - 1))
        out |= np.isin(code, _END_CODES[k])
    return out


class Spans:
    """Of some texts: words (their number in each), clauses (in each), and of each span: text, at, end (words of its text), a, b (128 bits of hash).

    A span begins with each clause and has as many whole clauses as reach `least` words.
    """

    def __init__(self, texts: list[bytes], least: int):
        hashes, new, self.words, ended = [], [], [], True
        for data, starts, ends, h, counts in words_of([_spaced(x) for x in texts]):
            fed = data == 10
            if len(starts):
                lines, cut = np.cumsum(fed), _ends_clause(data, ends)
                first = np.ones(len(starts), dtype=bool)
                first[0] = ended or lines[starts[0]] > 0  # a block may continue a text
                first[1:] = (lines[starts[1:]] > lines[ends[:-1] - 1]) | cut[:-1]
                ended = bool(cut[-1] or lines[-1] > lines[ends[-1] - 1])
                hashes.append(h)
                new.append(first)
            else:
                ended |= bool(fed.any())
            ended |= bool(counts)
            self.words += counts
        h, new = (np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((hashes, _U), (new, bool)))
        of = np.repeat(np.arange(len(texts)), self.words)
        begin = np.concatenate([[0], np.cumsum(self.words)]).astype(np.int64)
        new[begin[:-1][np.asarray(self.words, dtype=np.int64) > 0]] = True
        at = np.flatnonzero(new)
        self.clauses = np.bincount(of[at], minlength=len(texts))
        clause = np.cumsum(new) - 1
        ends = np.append(at[1:], len(h))
        at = at[at + least <= begin[of[at] + 1]]
        self.text, end = of[at], ends[clause[at + least - 1]]
        powers, inverses = power_tables(len(h) + 1)

        def run(x):
            sums = np.zeros(len(x) + 1, dtype=_U)
            np.cumsum(x * powers[: len(x)], out=sums[1:])
            return mix((sums[end] - sums[at]) * inverses[at] + (end - at).astype(_U)).view(np.int64)

        self.a, self.b = run(h), run(mix(h ^ _U(0xA5A5A5A55A5A5A5A)))
        self.at, self.end = at - begin[self.text], end - begin[self.text]


def _firsts(least: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(Spans(batch.column(0).to_pylist(), least).a)], ["a"])

    return run


def _chosen(least: int, bits):
    """(_d, _t, text) -> the spans that the filter lets through."""

    def run(batches):
        for batch in batches:
            x = Spans(batch.column(2).to_pylist(), least)
            keep = np.flatnonzero(hits(bits.value, x.a))
            row = pa.array(x.text[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(v[keep]) for v in (x.at, x.end, x.a, x.b))], ["_d", "_t", "at", "end", "a", "b"])

    return run


def _without(spans: list[tuple[int, int]], text: str) -> tuple[int, str]:
    """How many words the spans (first word, end) cover, and the text without them and the white space before each."""
    parts = _PIECE.findall(text)
    gone = np.zeros(len(parts) + 1, dtype=np.int64)
    for low, high in spans:
        gone[low] += 1
        gone[high] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return int(gone.sum()), "".join(x for x, g in zip(parts, gone, strict=True) if not g)


def _cleaned(batches):
    """(doc_id, text, spans or null, first_id) -> doc_id, n_words, n_removed, first_id, text."""
    names = ["doc_id", "n_words", "n_removed", "first_id", "text"]
    for batch in batches:
        text, n = batch.column(1).to_pylist(), []
        for *_, counts in words_of([_spaced(x) for x in text]):
            n += counts
        removed = [0] * len(text)
        for i, spans in enumerate(batch.column(2).to_pylist()):
            if spans:
                removed[i], s = _without([(x["at"], x["end"]) for x in spans], text[i].decode("utf-8", "surrogateescape"))
                text[i] = s.encode("utf-8", "surrogateescape")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), batch.column(3), pa.array(text, pa.binary())], names)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return base.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("_d"), F.xxhash64("text").alias("_t"))


def repeated_spans(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with any: its spans that are not the first of their words, in order of (id, place); stored.

    Words are what white space parts (in scripts without spaces, letters). A clause ends after a word that ends in one of ENDS, or at a line
    feed, so two copies of a passage have the same clauses but for the first and the last, whatever is glued to them. Every
    span of consecutive clauses that just reaches `least` words is hashed and counted over the corpus. Those
    counted twice set bits in a filter of bounded size; a second pass over the texts stores the spans that it lets through, with 128 bits of hash,
    and these are grouped. The filter only saves work: with more repeats than it has bits it lets all spans through.
    Returns _d, _t (the row's key), spans (at, end: numbers of words from 0), first_id (the least id with a first place; null is -2**63).
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = _keyed(docs, id_col, text_col)
    often = staged(base.select("text").mapInArrow(_firsts(least), "a long").groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"), "span-hashes")
    bits = spark.sparkContext.broadcast(bit_filter(often, "a", filter_bits(often.count())))
    spans = staged(base.select("_d", "_t", "text").mapInArrow(_chosen(least, bits), "_d long, _t long, at long, end long, a long, b long"), "spans")
    place = F.struct("_d", "at", "_t")
    firsts = staged(spans.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("a", "b", "first"), "span-firsts")
    later = spans.join(firsts.hint("merge"), ["a", "b"]).where(place != F.col("first"))
    return staged(later.groupBy("_d", "_t").agg(F.collect_set(F.struct("at", "end")).alias("spans"), F.min("first._d").alias("first_id")), "span-repeats")


def remove_repeated(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, first_doc_id, text without the words of every span that occurred before.

    Each word goes with the white space before it; a text that loses none is unchanged. Only texts that lose words (and those that a filter
    of bounded size takes for them) are shuffled. Null and empty texts have no words; rows of a null id come first in the order; repeated rows
    (same id and text) count as one place and are cleaned alike, equal texts of different ids all but the first; of two texts of one id the
    order is by place, then by a hash; very long texts are handled whole, in one row; other columns are unread; an empty table gives no rows.
    """
    spark = docs.sparkSession
    gone = repeated_spans(docs, least, id_col, text_col)
    bits = spark.sparkContext.broadcast(bit_filter(gone, "_t", filter_bits(gone.count())))

    @F.pandas_udf("boolean")
    def touched(t):
        import pandas as pd

        return pd.Series(hits(bits.value, t.to_numpy()))

    base = _keyed(docs, id_col, text_col)
    none = [F.lit(None).cast("array<struct<at:bigint,end:bigint>>").alias("spans"), F.lit(None).cast("long").alias("first_id")]
    whole = base.where(~touched("_t")).select("doc_id", "text", *none)
    some = base.where(touched("_t")).join(gone.hint("merge"), ["_d", "_t"], "left").select("doc_id", "text", "spans", "first_id")
    out = whole.unionByName(some).mapInArrow(_cleaned, "doc_id long, n_words long, n_removed long, first_id long, text binary")
    return out.select("doc_id", "n_words", "n_removed", F.when(F.col("first_id") != _NO_ID, F.col("first_id")).alias("first_doc_id"), F.col("text").cast("string").alias("text"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, first_doc_id (the least of those that keep its passages), text_sha256 of the cleaned text."""
    out = remove_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "first_doc_id", F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), raw AS (
  SELECT doc_id, regexp_extract_all(text, '{PIECE}') AS parts FROM d
), p AS (
  SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS i FROM raw
), w AS (
  SELECT doc_id, i, s, regexp_replace(s, '^[{_BLANK}]+', '') AS t, contains(regexp_extract(s, '^[{_BLANK}]*'), chr(10)) AS fed FROM p
), c AS (
  SELECT doc_id, i, s, t, sum(CASE WHEN i = 0 OR fed OR ended THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS clause
  FROM (SELECT *, lag(regexp_matches(t, '[{ENDS}]$')) OVER (PARTITION BY doc_id ORDER BY i) AS ended FROM w)
), clauses AS (
  SELECT doc_id, clause, min(i) AS beg, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS t FROM c GROUP BY doc_id, clause
), spans AS (
  SELECT doc_id, beg, string_agg(t, ' ') OVER o AS k, sum(n) OVER o AS n
  FROM clauses WINDOW o AS (PARTITION BY doc_id ORDER BY beg RANGE BETWEEN CURRENT ROW AND {LEAST_WORDS - 1} FOLLOWING)
), r AS (
  SELECT doc_id, beg, beg + n AS ends, row_number() OVER q AS place, first_value(doc_id) OVER q AS first_id FROM spans WHERE n >= {LEAST_WORDS}
  WINDOW q AS (PARTITION BY k ORDER BY doc_id, beg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), gone AS (
  SELECT DISTINCT c.doc_id, c.clause FROM r JOIN clauses c ON c.doc_id = r.doc_id AND c.beg >= r.beg AND c.beg < r.ends WHERE place > 1
), f AS (SELECT doc_id, min(first_id) AS first_doc_id FROM r WHERE place > 1 GROUP BY doc_id), x AS (
  SELECT c.doc_id, count(*) AS n_words, count(g.clause) AS n_removed, coalesce(string_agg(s, '' ORDER BY i) FILTER (g.clause IS NULL), '') AS text
  FROM c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.clause = c.clause GROUP BY c.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, first_doc_id, sha256(CASE WHEN n_removed > 0 THEN x.text ELSE d.text END) AS text_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
"""
