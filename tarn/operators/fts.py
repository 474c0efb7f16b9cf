"""Ranked retrieval over postings (term, doc, tf)."""

from __future__ import annotations

import math
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.sources.tables import stored

_CATEGORIES = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Nd", "Pc"}


def _is_word(c: str) -> bool:
    return all(unicodedata.category(x) in _CATEGORIES for x in c + unicodedata.normalize("NFKC", c))


def _runs(text: str) -> Iterator[tuple[str, bool]]:
    """(run of word characters all ASCII or all not, whether it follows the run before without a gap)."""
    run, joined = "", False
    for c in text:
        if not _is_word(c):
            if run:
                yield run, joined
            run, joined = "", False
        elif run and run[-1].isascii() != c.isascii():
            yield run, joined
            run, joined = c, True
        else:
            run += c
    if run:
        yield run, joined


def tokenize(text: str) -> dict[str, float]:
    """Shares of a text's tokens. ASCII words of two letters or more, in lower case; of others pairs of neighbours, and short ones (4 at most) whole; pairs across the border of two words of
    different kinds."""
    found: Counter[str] = Counter()
    total, before = 0, ""
    for run, _ in _runs(text):
        if before and before[-1].isascii() != run[0].isascii():
            found[(before[-1] + run[0]).lower()] += 1
            total += 1
        before = run
        if run[0].isascii():
            if len(run) > 1:
                found[run.lower()] += 1
                total += 1
            continue
        for pair in zip(run, run[1:]):
            found["".join(pair)] += 1
            total += 1
        if len(run) <= 4:
            found[run] += 1
    return {k: v / total for k, v in found.items()} if total else {}


def postings_any(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc, tf of texts of any script."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(t, d, v) for d, x in zip(pdf["doc"], pdf["text"], strict=True) for t, v in tokenize(x or "").items()]
            yield pd.DataFrame(rows, columns=["term", "doc", "tf"])

    return docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).alias("text")).mapInPandas(run, "term string, doc string, tf double")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc, tf of the ASCII words of two letters or more, all by built-in functions; tf is a term's share of them."""
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    base = docs.select(F.col(id_col).cast("string").alias("doc"), F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), F.lit(0)).alias("w"))
    terms = base.select("doc", F.size("w").alias("n"), F.explode("w").alias("term"))
    return terms.groupBy("doc", "term").agg((F.count(F.lit(1)) / F.first("n")).alias("tf")).select("term", "doc", "tf")


def parse_terms(terms: list[str]) -> list[tuple[str, str]]:
    """(term, marker): `+` is required, `-` excluded, `?` or none optional; of a repeated term the last + or - counts for all."""
    out, marks = [], {}
    for raw in terms:
        if len(raw) <= 1:
            raise ValueError(f"term too short: {raw!r}")
        mark, term = (raw[0], raw[1:]) if raw[0] in "+-?" else ("", raw)
        if mark in "+-":
            marks[term] = mark or marks.get(term, "")
        out.append(term)
    return [(t, marks.get(t, "")) for t in out]


def ranked(posts: DataFrame, terms: list[str], count: int = 65535) -> DataFrame:
    """doc, score of the best `count` documents.

    A term's weight is ln(total / df), with df one more than its documents and total the sum of all df (1 of a single term); a score is the sum of
    tf * weight, times (share of terms met) ** 2.5, times the size of the smallest list over that of the smallest list that holds the document.
    The postings of the terms are stored at once, so that texts are read and cut into words once.
    """
    parsed = parse_terms(terms)
    times = Counter(t for t, _ in parsed)
    marks = dict(parsed)
    own = stored(posts.where(F.col("term").isin(list(times))), "postings")
    card = {r["term"]: r["n"] for r in own.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each query term
    total = sum((card.get(t, 0) + 1) * k for t, k in times.items())
    sizes = [n for n in card.values() if n]
    if not sizes:
        return own.select("doc", F.col("tf").alias("score")).where(F.lit(False))
    rows = [(t, float(1 if card.get(t, 0) + 1 == total else math.log(total / (card.get(t, 0) + 1))), times[t], card.get(t, 0), marks[t]) for t in times]
    weights = F.broadcast(posts.sparkSession.createDataFrame(rows, "term string, idf double, times int, card long, mark string"))
    by_doc = own.join(weights, "term").groupBy("doc").agg(
        F.sum(F.col("tf") * F.col("idf") * F.col("times")).alias("s"), F.sum("times").alias("hits"), F.min("card").alias("via"),
        F.sum((F.col("mark") == "+").cast("int")).alias("met"), F.max((F.col("mark") == "-").cast("int")).alias("bad"),
    )
    needed = sum(m == "+" for m in marks.values())
    good = by_doc.where((F.col("met") == needed) & (F.col("bad") == 0))
    score = F.col("s") * F.pow(F.col("hits") / len(parsed), F.lit(2.5)) * (F.lit(min(sizes)) / F.col("via"))
    return good.select("doc", score.alias("score")).orderBy(F.desc("score"), "doc").limit(count)
