"""URL filters: fixed rules, and host reputations by empirical Bayes."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import staged, table

#: (rule, verdict): a host, then the first part of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: Standard deviations below the posterior mean: a host is blocked if this bound passes the rate over all labelled pages. Least share of the variance of outcomes that is taken to lie between the groups of a level.
DEVIATIONS, SPREAD = 1.0, 0.05

#: The number in a path, after the folder of a language: the document that the page shows.
SHOWN = r"^/[^/]*/([0-9]+)"


def url_parts(url):
    """(host, path): both empty where the url is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return host, path


def rule_of(host, path, rules=RULES):
    """The longest rule that fits as a struct (rule, verdict), else null."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        it = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, it) if out is None else out.when(fits, it)
    return out


def _shrunk(groups: DataFrame) -> DataFrame:
    """Adds post_mean, post_size to groups with n, x, prior: a beta-binomial prior of the parent's mean, whose strength comes from the overdispersion over all groups of the level."""
    m = F.least(F.greatest("prior", F.lit(1e-4)), F.lit(1 - 1e-4))
    spread = groups.where("n > 0").agg(F.sum(F.pow(F.col("x") - F.col("n") * m, 2) / (F.col("n") * m * (1 - m))).alias("s"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") - 1).alias("f"))
    rho = F.least(F.greatest((F.col("s") - F.col("g")) / F.greatest("f", F.lit(1)), F.lit(SPREAD)), F.lit(0.9))
    strength = spread.select(F.coalesce(1 / rho - 1, F.lit(1.0)).alias("strength"))
    size = F.col("strength") + F.col("n")
    return groups.join(F.broadcast(strength)).withColumn("post_mean", (F.col("strength") * m + F.col("x")) / size).withColumn("post_size", size).drop("strength")


def reputations(hosts: DataFrame) -> DataFrame:
    """host, mean, bound (lower bound of the rate of bad pages), base (the rate over all labelled pages) from hosts (host, n, x: labelled pages, bad ones).

    Rates shrink from host to registered domain (the last two labels) to suffix (the last) to the rate over all
    pages. A host without labelled pages has its domain's. Without any labelled page the rate is taken to be 0.
    """
    h = hosts.select("host", "n", "x", F.substring_index("host", ".", -2).alias("domain"), F.substring_index("host", ".", -1).alias("suffix"))
    total = staged(h.agg(F.coalesce(F.sum("x") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("prior")), "base-rate")
    s = _shrunk(h.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).join(F.broadcast(total)))
    d = h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).join(s.select("suffix", F.col("post_mean").alias("prior")), "suffix")
    d = staged(_shrunk(d), "domains")
    out = _shrunk(h.join(d.select("domain", F.col("post_mean").alias("prior")), "domain"))
    bound = F.col("post_mean") - DEVIATIONS * F.sqrt(F.col("post_mean") * (1 - F.col("post_mean")) / (F.col("post_size") + 1))
    return out.select("host", F.col("post_mean").alias("mean"), bound.alias("bound")).join(F.broadcast(total.select(F.col("prior").alias("base"))))


def shown(path):
    """The id of the document that a page of this path shows, else null."""
    return F.nullif(F.regexp_extract(path, SHOWN, 1), F.lit("")).try_cast("long")


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, key=None) -> DataFrame:
    """page_id, host, path, rule, verdict (the rule's, else block where the host's bound passes the rate over all labelled pages), bound.

    outcomes: key, bad (1 or 0; null is not labelled) of pages whose `key` (a function of the path; else page_id) is the same; several of one
    key all count. A null url has an empty host, which has a reputation like any other. Null or repeated page ids are separate rows, and a
    null key has no outcome; very long urls are read whole; other columns are unread; an empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    base = staged(base.withColumn("_key", key(F.col("path")) if key else F.col("page_id").cast("long")), "urls")
    known = outcomes.where("bad IS NOT NULL AND key IS NOT NULL").groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("x"))
    seen = base.where("_key IS NOT NULL").select("_key", "host").join(known, "_key").groupBy("host").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    hosts = base.select("host").distinct().join(seen, "host", "left")
    hosts = staged(hosts.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", F.lit(0)).alias("x")), "hosts")
    rep = staged(reputations(hosts), "reputations")
    out = base.join(rep.hint("merge"), "host").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bound") > F.col("base"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "bound")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad where the label of the document that it shows has quality 0 or toxic 1. That is the document whose id is the number in its path: its title begins the text of this document."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labels, key=shown).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, source: str) -> str:
    m = "least(greatest(prior, 1e-4), 1 - 1e-4)"
    return f"""{name}_s AS (
  SELECT coalesce(1 / least(greatest((s - g) / greatest(f, 1), {SPREAD}), 0.9) - 1, 1.0) AS strength FROM (
    SELECT sum(power(x - n * {m}, 2) / (n * {m} * (1 - {m}))) AS s, count(*) AS g, sum(n - 1) AS f FROM {source} WHERE n > 0)
), {name} AS (SELECT t.*, (strength * {m} + x) / (strength + n) AS post_mean, strength + n AS post_size FROM {source} t, {name}_s)"""


OP10_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^[^?#]*', 0) AS path FROM u
), k AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT host, string_split(host, '.')[-1] AS suffix, CASE WHEN len(string_split(host, '.')) > 1 THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END AS domain,
         CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(x), 0) AS DOUBLE) AS x
  FROM b LEFT JOIN k ON k.doc_id = TRY_CAST(nullif(regexp_extract(path, '{SHOWN}', 1), '') AS BIGINT) GROUP BY host
), s0 AS (SELECT suffix, sum(n) AS n, sum(x) AS x, (SELECT coalesce(sum(x) / nullif(sum(n), 0), 0) FROM h) AS prior FROM h GROUP BY suffix),
{_level("s1", "s0")},
d0 AS (SELECT g.*, s1.post_mean AS prior FROM (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM h GROUP BY suffix, domain) g JOIN s1 ON s1.suffix = g.suffix),
{_level("d1", "d0")},
h0 AS (SELECT h.host, h.n, h.x, d1.post_mean AS prior FROM h JOIN d1 ON d1.domain = h.domain),
{_level("h1", "h0")},
v AS (
  SELECT page_id, b.host, path, post_mean - {DEVIATIONS} * sqrt(post_mean * (1 - post_mean) / (post_size + 1)) AS bound,
    CASE WHEN (b.host = 'example.org' OR b.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (b.host = 'example.org' OR b.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (b.host = 'com' OR b.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (b.host = 'com' OR b.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (b.host = 'org' OR b.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM b JOIN h1 ON h1.host = b.host
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > (SELECT sum(x) / nullif(sum(n), 0) FROM h) THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""
