"""Line dedup: winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import SPACES, staged, table, text_of

#: What is cut from both ends of a line before it is compared.
_EDGES = " \t\r\n\x0b\x0c"


#: Lines in a run; words from which fewer lines count as a run too.
RUN, LONG_WORDS = 3, 25


def _hash(parts: list):
    """A hash of 128 bits of the line hashes of a run."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts).alias("b"))


def _upto(count):
    """0, 1, ... below `count`; none for 0 or less."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _let(value, use):
    """use(value), where `value` is worked out once for a row: within a lambda, an expression is worked out for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _marks(run: int):
    """Of an array of line hashes: its distinct fingerprints (f), each with the line from which (low) the hashes around it (near) are."""

    def near(h, p):
        return F.transform(F.sequence(F.greatest(F.lit(0), -p - (run - 1)), F.least(F.size(h) - 1, -p + run - 1)), lambda j: F.get(h, j))

    def marks(h):
        least = F.transform(_upto(F.size(h) - (run - 1)), lambda i: F.array_min(F.array(*(F.struct(F.get(h, i + k).alias("f"), (-(i + k)).alias("p")) for k in range(run)))))
        # places of minima never go back, so equal ones are neighbours
        some = lambda m: F.filter(m, lambda x, i: (i == 0) | (F.get(m, i - 1)["p"] != x["p"]))
        return F.transform(_let(least, some), lambda x: F.struct(x["f"].alias("f"), F.greatest(F.lit(0), -x["p"] - (run - 1)).alias("low"), near(h, x["p"]).alias("near")))

    return marks


def _short_runs(run: int, long_words: int):
    """Of an array of lines (hash h, words w): runs of fewer than `run` lines with `long_words` words (at, n, w)."""

    def of(s, n):
        part = lambda i: [F.get(s, i + k) for k in range(n)]
        fits = F.filter(_upto(F.size(s) - (n - 1)), lambda i: sum((x["w"] for x in part(i)[1:]), part(i)[0]["w"]) >= long_words)
        return F.transform(fits, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), _hash([x["h"] for x in part(i)]).alias("w")))

    return lambda s: F.concat(*(of(s, n) for n in range(1, run)))


def _without(number):
    """Of an array of raw lines: those left when the lines of these numbers (blank lines not counted) go."""

    def left(raw):
        full = F.filter(_upto(F.size(raw)), lambda i: F.btrim(F.get(raw, i), F.lit(_EDGES)) != "")
        gone = _let(full, lambda f: F.transform(number, lambda x: F.get(f, x)))
        return F.array_join(F.transform(F.array_except(_upto(F.size(raw)), gone), lambda i: F.get(raw, i)), "\n")

    return left


def _later(windows: DataFrame, by: list[str]) -> DataFrame:
    """The windows (_d, _t, at, ...) that are not the first of their kind, in order of (_d, at)."""
    place = F.struct("_d", "at", "_t")
    firsts = windows.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select(*by, "first")
    return windows.join(firsts.hint("merge"), by).where(place != F.col("first"))


def dedup_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", long_words: int | None = LONG_WORDS) -> DataFrame:
    """Delete every line in a run of at least `run` lines that occurred before, in order of (id, line); of fewer lines as well where they have `long_words` words or more.

    Lines end at a line feed and are compared without spaces at their ends; blank lines are never compared and stay.
    Each window of `run` line hashes gives its least (of equal ones the last) as a fingerprint, so a repeated run
    always shares one, at the same place. Positions of a fingerprint that occurs more than once are joined, and each is
    extended both ways: the windows around it are compared, group by group and not pair by pair, with those around
    its other positions. Any but the first place of an equal window is deleted; together these are the whole runs.
    A run of fewer lines is no longer than a window and is compared whole. All steps take time in proportion to a text's lines.

    Returns per row of `docs`: doc_id, n_lines (not blank), n_removed, text (cleaned). Null texts count as empty; rows
    of a null id come first in the order; repeated rows (same id and text) count as one place; other columns are unread;
    a text of any number of lines is handled whole; an empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    base = base.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_d"), F.xxhash64("text").alias("_t"))
    trimmed = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_EDGES))), lambda x: x != "")
    lines = base.select("_d", "_t", trimmed.alias("l"))
    spots = _let(F.transform("l", lambda x: F.xxhash64(x)), _marks(run))
    marks = staged(lines.select("_d", "_t", F.explode(spots).alias("x")).select("_d", "_t", "x.*"), "line-fingerprints")
    # two marks of one text repeat as well: repeated rows alone don't, but then add nothing to what is deleted
    often = marks.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f")
    found = marks.join(often.hint("merge"), "f", "left_semi")
    around = F.transform(_upto(F.size("near") - (run - 1)), lambda i: F.struct((F.col("low") + i).alias("at"), _hash([F.get("near", i + k) for k in range(run)]).alias("w")))  # stored columns
    windows = found.select("_d", "_t", F.explode(around).alias("x")).select("_d", "_t", "x.at", "x.w.a", "x.w.b").distinct()
    later = _later(staged(windows, "line-windows"), ["a", "b"]).select("_d", "_t", "at", F.lit(run).alias("n"))
    if long_words is not None and run > 1:
        known = F.transform("l", lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, SPACES)).alias("w")))
        some = lines.select("_d", "_t", F.explode(_let(known, _short_runs(run, long_words))).alias("x")).select("_d", "_t", "x.at", "x.n", "x.w.a", "x.w.b")
        later = later.unionByName(_later(staged(some, "line-long-windows"), ["n", "a", "b"]).select("_d", "_t", "at", "n"))
    gone = staged(later.groupBy("_d", "_t").agg(F.collect_set(F.struct("at", "n")).alias("runs")), "line-deletions")
    out = base.join(gone.hint("merge"), ["_d", "_t"], "left").select("doc_id", "text", F.size(trimmed).cast("long").alias("n_lines"), "runs")
    number = F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    cleaned = F.when(F.col("runs").isNull(), F.col("text")).otherwise(_let(number, lambda n: _let(F.split("text", "\n"), _without(n))))
    return out.select("doc_id", "n_lines", F.coalesce(F.size(number), F.lit(0)).cast("long").alias("n_removed"), cleaned.alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text_sha256 of the cleaned text."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


_RUNS_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents
), l AS (
  SELECT doc_id, p, s, trim(s, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM raw
), n AS (
  SELECT doc_id, p, t, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l WHERE t <> ''
), w AS (
  SELECT doc_id, i, t || chr(10) || lead(t, 1) OVER o || chr(10) || lead(t, 2) OVER o AS k FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM w WHERE k IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM r, (VALUES (0), (1), (2)) AS v(j) WHERE place > 1
), kept AS (
  SELECT l.doc_id, l.p, l.s, n.i IS NOT NULL AS full_line, g.i IS NOT NULL AS removed
  FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.p = l.p LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i
)
SELECT doc_id, CAST(sum(CAST(full_line AS BIGINT)) AS BIGINT) AS n_lines, CAST(sum(CAST(removed AS BIGINT)) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY p) FILTER (NOT removed), '')) AS text_sha256
FROM kept GROUP BY doc_id
"""

_WORDS = r"len(regexp_split_to_array(t, '[\x20\x09-\x0D]+'))"

OP3_SQL = _RUNS_SQL.replace(
    "), gone AS (",
    f"""), w2 AS (
  SELECT doc_id, i, 1 AS n, t AS k FROM n WHERE {_WORDS} >= 25
  UNION ALL
  SELECT doc_id, i, 2, k FROM (SELECT doc_id, i, t || chr(10) || lead(t) OVER o AS k, {_WORDS} + lead({_WORDS}) OVER o AS words FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE words >= 25
), r2 AS (
  SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) AS place FROM w2
), gone AS (
  SELECT doc_id, i + j AS i FROM r2, (VALUES (0), (1)) AS v(j) WHERE place > 1 AND j < n
  UNION""",
)
