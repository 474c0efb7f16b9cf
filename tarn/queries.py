"""Named queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import model as M
from tarn.functions.bitmap16 import bits_agg, to_bitmap
from tarn.functions.bloom import bloom_agg
from tarn.functions.keys import bits_mask, concat_key
from tarn.functions.match import match_expr
from tarn.operators import fts, joins, lookup, metrics, mutate, ranges, scan
from tarn.plans.command import Session
from tarn.sources import tables
from tarn.streaming import log

#: The views in SQL.
VIEWS = {
    "zo": "SELECT 'cust:' || o_custkey AS key, 'o' || o_orderkey AS member, o_totalprice AS score, o_orderpriority AS data FROM orders",
    "zc": "SELECT 'nation:' || c_nationkey AS key, 'c' || c_custkey AS member, c_acctbal AS score, c_mktsegment AS data FROM customer",
    "zn": "SELECT 'region:' || n_regionkey AS key, 'nation:' || n_nationkey AS member, CAST(n_nationkey AS DOUBLE) AS score, n_name AS data FROM nation",
    "zps": "SELECT 'part:' || l_partkey AS key, 'supp:' || l_suppkey AS member, CAST(sum(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY l_partkey, l_suppkey",
    "ze": "SELECT 'user:' || user_id AS key, CAST(event_id AS VARCHAR) AS member, epoch_us(ts) / 1e6 AS score, props AS data, event_id AS seq FROM events",
    "zt": "SELECT 'ev:' || event_type AS key, 'u' || user_id AS member, round(sum(value), 6) AS score FROM events GROUP BY event_type, user_id",
    "se": "SELECT DISTINCT event_type AS key, 'u' || user_id AS member FROM events",
    "kv": "SELECT c_name AS key, c_mktsegment AS value FROM customer",
    "adds": "SELECT event_id AS seq, 'ev:' || event_type AS key, 'u' || user_id AS member, value AS score, CASE WHEN value > 10 THEN props ELSE '' END AS data FROM events",
}

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *views: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = ("WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views) + " " if views else "") + sql
        return f

    return add


def adds(spark, d) -> DataFrame:
    """Events as ordered upserts."""
    e = M.table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("ev:"), "event_type").alias("key"), F.concat(F.lit("u"), "user_id").alias("member"), F.col("value").alias("score"), F.when(F.col("value") > 10, F.col("props")).otherwise("").alias("data"))


@query("SELECT key, member, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS rank FROM zo WHERE score > 50000 AND score <= 200000) WHERE rank <= 3", "zo")
def top_orders(spark, d):
    """Each customer's dearest three orders of an interval of prices."""
    return ranges.zrange(ranges.zrangebyscore(M.zo(spark, d), "(50000", "200000"), 0, 2, rev=True).withColumn("rank", F.col("rank") + 1)


_RANKED = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS r, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rr, count(*) OVER (PARTITION BY key) AS n FROM zo"


@query(f"SELECT key, member, score, r AS rank FROM ({_RANKED}) WHERE r BETWEEN 1 AND 4", "zo")
def zrange_rank(spark, d):
    return ranges.zrange(M.zo(spark, d), 1, 4)


@query(f"SELECT key, member, score, rr AS rank FROM ({_RANKED}) WHERE rr BETWEEN 0 AND 2", "zo")
def zrevrange_rank(spark, d):
    return ranges.zrange(M.zo(spark, d), 0, 2, rev=True)


@query(f"SELECT key, member, score, r AS rank FROM ({_RANKED}) WHERE r BETWEEN greatest(n - 3, 0) AND n - 2", "zo")
def zrange_negative(spark, d):
    return ranges.zrange(M.zo(spark, d), -3, -2)


@query("SELECT key, member, score FROM zo WHERE score >= 100000 AND score <= 250000", "zo")
def zrangebyscore_incl(spark, d):
    return ranges.zrangebyscore(M.zo(spark, d), "[100000", "250000")


@query("SELECT key, member, score, data FROM zc WHERE score > 100 AND score < 5000.5", "zc")
def zrangebyscore_excl(spark, d):
    return ranges.zrangebyscore(M.zc(spark, d), "(100", "(5000.5", with_data=True)


@query("SELECT key, member, score FROM zc WHERE score <= 0", "zc")
def zrangebyscore_inf(spark, d):
    return ranges.zrangebyscore(M.zc(spark, d), "-inf", "0")


@query("SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS i FROM zps WHERE score < 100) WHERE i <= 2", "zps")
def zrevrangebyscore_limit(spark, d):
    return ranges.zrangebyscore(M.zps(spark, d), "(100", "-inf", rev=True, limit=2)


@query("SELECT key, member, score FROM zc WHERE member >= 'c1' AND member < 'c3'", "zc")
def zrangebylex(spark, d):
    return ranges.zrangebylex(M.zc(spark, d), "[c1", "(c3")


@query("SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) AS i FROM zc WHERE member > 'c5') WHERE i <= 5", "zc")
def zrevrangebylex(spark, d):
    return ranges.zrangebylex(M.zc(spark, d), "+", "(c5", rev=True, limit=5)


@query("SELECT key, count(*) AS n FROM zc WHERE member >= 'c1' AND member <= 'c4' GROUP BY key", "zc")
def zcountbylex(spark, d):
    return ranges.zcount(M.zc(spark, d), "c1", "[c4", lex=True)


@query("SELECT key, count(*) AS n FROM zps GROUP BY key", "zps")
def zcard(spark, d):
    return ranges.zcard(M.zps(spark, d))


@query("SELECT key, count(*) AS n FROM se GROUP BY key", "se")
def scard(spark, d):
    return ranges.scard(M.se(spark, d))


@query("SELECT key, count(*) AS n FROM zo WHERE score > 1000 AND score <= 90000 GROUP BY key", "zo")
def zcount(spark, d):
    return ranges.zcount(M.zo(spark, d), "(1000", "90000")


@query("SELECT key, count(*) AS n FROM zo WHERE score <= 90000 AND (data LIKE '%HIGH%' OR member LIKE '%HIGH%') GROUP BY key", "zo")
def zcount_match(spark, d):
    return ranges.zcount(M.zo(spark, d), "-inf", "90000", match="\\term{HIGH}")


@query("SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zc", "zc")
def zrank(spark, d):
    return ranges.zrank(M.zc(spark, d))


@query("SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zps", "zps")
def zrevrank(spark, d):
    return ranges.zrank(M.zps(spark, d), rev=True)


def _asked(spark, d):
    """Requests: every order's customer, in two sorted sets, of which one may not hold it."""
    o = M.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("nation:"), (F.col("o_orderkey") % 25)).alias("key"), F.concat(F.lit("c"), "o_custkey").alias("member"))


_ASKED = "SELECT o_orderkey AS pos, 'nation:' || (o_orderkey % 25) AS key, 'c' || o_custkey AS member FROM orders"


@query(f"SELECT a.pos, a.key, a.member, zc.score FROM ({_ASKED}) a LEFT JOIN zc ON zc.key = a.key AND zc.member = a.member", "zc")
def zmscore(spark, d):
    return lookup.zmscore(M.zc(spark, d), _asked(spark, d))


@query(f"SELECT a.pos, a.key, a.member, zc.data FROM ({_ASKED}) a LEFT JOIN zc ON zc.key = a.key AND zc.member = a.member", "zc")
def zmdata(spark, d):
    return lookup.zmdata(M.zc(spark, d), _asked(spark, d))


@query("SELECT o_orderkey AS pos, 'Customer#' || lpad(CAST(2 * o_custkey AS VARCHAR), 9, '0') AS key, value FROM orders LEFT JOIN kv ON kv.key = 'Customer#' || lpad(CAST(2 * o_custkey AS VARCHAR), 9, '0')", "kv")
def mget(spark, d):
    asked = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("Customer#"), F.lpad((2 * F.col("o_custkey")).cast("string"), 9, "0")).alias("key"))
    return lookup.mget(M.kv(spark, d), asked)


@query("SELECT c_custkey AS pos, 'purchase' AS key, 'u' || c_custkey AS member, CAST(se.member IS NOT NULL AS INTEGER) AS is_member FROM customer LEFT JOIN se ON se.key = 'purchase' AND se.member = 'u' || c_custkey", "se")
def smismember(spark, d):
    asked = M.table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.lit("purchase").alias("key"), F.concat(F.lit("u"), "c_custkey").alias("member"))
    return lookup.smismember(M.se(spark, d), asked)


@query("SELECT key, member FROM se", "se")
def smembers(spark, d):
    return lookup.smembers(M.se(spark, d))


def _matching(view, pattern, target="either"):
    return lambda spark, d: (z := view(spark, d)).where(match_expr(pattern, F.col("member"), F.col("data"), target)).select("key", "member", "score")


for _name, _f, _sql, _v in (
    ("match_glob", _matching(M.zo, "o1?[2-5]*", "member"), "SELECT key, member, score FROM zo WHERE regexp_matches(member, '^o1.[2-5].*$')", "zo"),
    ("match_prefix_suffix", _matching(M.zo, "\\prefix{o1}\\suffix{7}", "member"), "SELECT key, member, score FROM zo WHERE member LIKE 'o1%' AND member LIKE '%7'", "zo"),
    ("match_or_not", _matching(M.zo, "\\data{}\\or{\\prefix{1-}\\prefix{2-}}\\not{\\term{HIGH}}"), "SELECT key, member, score FROM zo WHERE (data LIKE '1-%' OR data LIKE '2-%') AND data NOT LIKE '%HIGH%'", "zo"),
    ("match_re", _matching(M.zo, "\\re{^o[0-9]*([0-9])0$}", "member"), "SELECT key, member, score FROM zo WHERE regexp_matches(member, '^o[0-9]*([0-9])0$')", "zo"),
    ("match_numeric", _matching(M.ze, "\\ge{100}\\lt{2000}\\ne{150}", "member"), "SELECT key, member, score FROM ze WHERE CAST(member AS DOUBLE) >= 100 AND CAST(member AS DOUBLE) < 2000 AND CAST(member AS DOUBLE) <> 150", "ze"),
    ("match_json", _matching(M.ze, "\\data{}\\json:k{\\gt{42}}"), "SELECT key, member, score FROM ze WHERE CAST(json_extract_string(data, '$.k') AS DOUBLE) > 42", "ze"),
):
    _f.__name__ = _name
    query(_sql, _v)(_f)


def _ev(spark, d, kind):
    return M.zt(spark, d).where(F.col("key") == f"ev:{kind}").select("key", "member", "score")


@query("SELECT key, member, score FROM zt a WHERE key = 'ev:click' AND EXISTS (SELECT 1 FROM zt b WHERE b.key = 'ev:purchase' AND b.member = a.member) AND EXISTS (SELECT 1 FROM zt b WHERE b.key = 'ev:view' AND b.member = a.member)", "zt")
def intersect(spark, d):
    return joins.intersect(_ev(spark, d, "click"), _ev(spark, d, "purchase"), _ev(spark, d, "view"))


@query("SELECT key, member, score FROM zt a WHERE key = 'ev:click' AND NOT EXISTS (SELECT 1 FROM zt b WHERE b.key = 'ev:purchase' AND b.member = a.member AND b.score > 650)", "zt")
def notintersect(spark, d):
    return joins.notintersect(_ev(spark, d, "click"), _ev(spark, d, "purchase").where("score > 650"))


@query("SELECT key, member, score FROM zt a WHERE key = 'ev:click' AND EXISTS (SELECT 1 FROM zt b WHERE b.key = 'ev:view' AND b.member = a.member) AND NOT EXISTS (SELECT 1 FROM zt b WHERE b.key = 'ev:error' AND b.member = a.member AND b.score > 600) ORDER BY score, member LIMIT 20", "zt")
def intersect_mixed(spark, d):
    """The first 20 that pass both filters."""
    out = joins.notintersect(joins.intersect(_ev(spark, d, "click"), _ev(spark, d, "view")), _ev(spark, d, "error").where("score > 600"))
    return out.orderBy("score", "member").limit(20)


@query("SELECT key, member, score, data FROM zn WHERE EXISTS (SELECT 1 FROM zc WHERE zc.key = zn.member AND zc.member = 'c42')", "zn", "zc")
def two_hops(spark, d):
    return joins.two_hops(M.zn(spark, d), M.zc(spark, d), "c42")


@query("SELECT key, member, score FROM zt a WHERE EXISTS (SELECT 1 FROM ze WHERE ze.key = 'user:' || substr(a.member, 2) AND ze.member = '7')", "zt", "ze")
def two_hops_concat(spark, d):
    return joins.two_hops(M.zt(spark, d), M.ze(spark, d), "7", concat_key(F.col("member"), "user:", 1, -1, "")).select("key", "member", "score")


@query("SELECT zn.key, zn.member, zn.score, CAST(coalesce(c.i, 0) AS INTEGER) AS pos, c.member AS child, c.score AS child_score FROM zn LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS i FROM zc WHERE score >= 0 AND score < 9000) c ON c.key = zn.member AND c.i <= 3", "zn", "zc")
def fanout_topn(spark, d):
    return joins.fanout(M.zn(spark, d), M.zc(spark, d), "9000", "0", 3).select("key", "member", "score", "pos", "child", "child_score")


@query("SELECT key, member, score FROM (SELECT * FROM zt WHERE key = 'ev:click' UNION ALL SELECT * FROM zt WHERE key = 'ev:view' UNION ALL SELECT * FROM zt WHERE key = 'ev:click') ORDER BY score DESC, member DESC, key DESC LIMIT 50", "zt")
def union_topk(spark, d):
    a, b = _ev(spark, d, "click"), _ev(spark, d, "view")
    return joins.union_topk(a, b, a, rev=True, limit=50)


@query("SELECT key, member, arg_max(score, seq) AS score, arg_max(data, seq) AS data FROM adds GROUP BY key, member", "adds")
def zadd_last_wins(spark, d):
    return mutate.last_wins(adds(spark, d))


@query("SELECT key, member, arg_min(score, seq) AS score, arg_min(data, seq) AS data FROM adds GROUP BY key, member", "adds")
def zadd_nx(spark, d):
    return mutate.first_wins(adds(spark, d))


def _all(df, key):
    return df.withColumn("key", F.lit(key))


@query("SELECT 'seen' AS key, member, score FROM (SELECT member, arg_max(score, seq) AS score FROM adds GROUP BY member) WHERE member IN (SELECT member FROM adds WHERE key = 'ev:purchase')", "adds")
def zadd_xx(spark, d):
    base = mutate.last_wins(_all(adds(spark, d).where("key = 'ev:purchase'"), "seen"))
    return mutate.only_existing(base, _all(adds(spark, d), "seen")).select("key", "member", "score")


@query("SELECT key, CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN p <> score THEN 1 ELSE 0 END) AS BIGINT) AS updated FROM (SELECT *, lag(score) OVER (PARTITION BY key, member ORDER BY seq) AS p FROM adds) GROUP BY key", "adds")
def zadd_ch(spark, d):
    return mutate.changed(adds(spark, d))


@query("SELECT key, member, arg_max(score, seq) AS score, arg_max(data, seq) FILTER (data <> '') AS data FROM adds GROUP BY key, member", "adds")
def zadd_pd(spark, d):
    return mutate.keep_data(adds(spark, d))


@query("SELECT key, member, round(sum(score), 4) AS score FROM adds GROUP BY key, member", "adds")
def zadd_mssum(spark, d):
    return mutate.sums(adds(spark, d)).withColumn("score", F.round("score", 4))


_MASK = bits_mask(5, 1)


@query(f"SELECT key, member, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(trunc(score) AS BIGINT) ORDER BY seq)), lambda a, x: (a & {_MASK}) | x) AS DOUBLE) AS score FROM adds GROUP BY key, member", "adds")
def zadd_msbit(spark, d):
    cmds = adds(spark, d).select("seq", "key", "member", "score", F.lit("bit").alias("merge"), F.lit(_MASK).alias("mask"))
    return mutate.fold(_nothing(spark), cmds).select("key", "member", "score")


def _nothing(spark):
    return spark.createDataFrame([], "key string, member string, score double, data string")


_BITS = {"set": "(a & {m}) | {b} | x", "clear": "(a & {m} & ~{b}) | x", "invert": "xor(a & {m}, {b}) | x"}


def _bit_query(kind: str):
    def run(spark, d):
        cmds = adds(spark, d).select("seq", "key", "member", "score", F.lit(kind).alias("merge"), F.lit(_MASK).alias("mask"), F.lit(3).alias("bit"))
        return mutate.fold(_nothing(spark), cmds).select("key", "member", "score")

    run.__name__ = f"zadd_msbit{kind}"
    how = _BITS[kind].format(m=_MASK, b="CAST(8 AS BIGINT)")
    query(f"SELECT key, member, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(trunc(score) AS BIGINT) ORDER BY seq)), lambda a, x: {how}) AS DOUBLE) AS score FROM adds GROUP BY key, member", "adds")(run)


for _kind in _BITS:
    _bit_query(_kind)

_DSLT = "SELECT s_suppkey AS seq, 'nation:' || s_nationkey AS key, 'm' || (s_suppkey % 7) AS member, s_acctbal AS score, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal - 100 WHEN s_suppkey % 5 = 1 THEN 1000.0 END AS dslt FROM supplier"


@query(f"WITH c AS ({_DSLT}), last AS (SELECT key, member, max(seq) AS seq, arg_max(score, seq) AS score FROM c WHERE dslt IS NULL OR score >= dslt GROUP BY key, member) SELECT key, member, score FROM last WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.key = last.key AND c.seq >= last.seq AND c.dslt > last.score)")
def zadd_dslt(spark, d):
    """Upserts with thresholds of their own: what is below one is left out, and what is there below it expires."""
    s = M.table(spark, d, "supplier")
    dslt = F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") - 100).when(F.col("s_suppkey") % 5 == 1, F.lit(1000.0))
    cmds = s.select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("nation:"), "s_nationkey").alias("key"), F.concat(F.lit("m"), (F.col("s_suppkey") % 7).cast("string")).alias("member"), F.col("s_acctbal").alias("score"), dslt.alias("dslt"))
    return mutate.fold(_nothing(spark), cmds).select("key", "member", "score")


@query("SELECT key, member, arg_max(score, seq) AS score, arg_max(data, seq) AS data FROM adds GROUP BY key, member", "adds")
def zadd_pairs(spark, d):
    """All upserts of a key as pairs of one command: the last pair of a member wins."""
    cmds = adds(spark, d).select(F.lit(1).alias("seq"), F.col("seq").cast("int").alias("pos"), "key", "member", "score", "data")
    return mutate.fold(_nothing(spark), cmds)


@query("SELECT key, member, round(sum(score), 4) AS score FROM adds WHERE score > 5 GROUP BY key, member", "adds")
def zincrby(spark, d):
    return mutate.sums(adds(spark, d).where("score > 5")).withColumn("score", F.round("score", 4))


@query("SELECT seq, key, member, score, round(score - coalesce(lag(score) OVER (PARTITION BY key, member ORDER BY seq), 0), 6) AS delta FROM adds", "adds")
def zincrby_incrto(spark, d):
    return mutate.deltas(adds(spark, d)).withColumn("delta", F.round("delta", 6))


_HISTORY = "SELECT key, member, arg_max(score, seq) AS score FROM adds a WHERE seq > coalesce((SELECT max(seq) FROM adds b WHERE b.key = a.key AND b.score > 60), -1) GROUP BY key, member"


@query(_HISTORY, "adds")
def del_then_add(spark, d):
    """Upserts, with a deletion of the key in place of each of a score over 60."""
    a = adds(spark, d)
    cmds = a.select("seq", "key", F.when(F.col("score") > 60, "del").otherwise("zadd").alias("op"), F.when(F.col("score") <= 60, F.col("member")).alias("member"), "score")
    # of the deletions of a key only the last decides
    last = cmds.where("op = 'del'").groupBy("key").agg(F.max("seq").alias("seq")).select("seq", "key", F.lit("del").alias("op"), F.lit(None).cast("string").alias("member"), F.lit(0.0).alias("score"))
    return mutate.fold(_nothing(spark), cmds.where("op = 'zadd'").unionByName(last)).select("key", "member", "score")


@query("SELECT key, member FROM zt a WHERE NOT EXISTS (SELECT 1 FROM zt b WHERE b.member = a.member AND b.key = 'ev:error' AND b.score > 50 AND a.key = 'ev:click')", "zt")
def zrem(spark, d):
    z = M.zt(spark, d)
    gone = z.where("key = 'ev:error' AND score > 50").select(F.lit("ev:click").alias("key"), "member")
    return mutate.zrem(z, gone).select("key", "member")


@query("SELECT key, member FROM zc WHERE key < 'nation:1' OR key > 'nation:3'", "zc")
def del_range(spark, d):
    return mutate.delete_keys(M.zc(spark, d), "nation:1", "nation:3").select("key", "member")


@query("SELECT key, coalesce(v, value) AS value FROM kv LEFT JOIN (SELECT c_name AS k, arg_max(o_orderpriority, o_orderkey) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name) ON k = key", "kv")
def set_last_wins(spark, d):
    o = M.table(spark, d, "orders").join(M.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return mutate.set_values(M.kv(spark, d), o.select(F.col("c_name").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq")))


@query("SELECT 'user:' || user_id AS key, array_to_string(list_sort(list(DISTINCT day)), ',') AS bits FROM (SELECT user_id, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events) GROUP BY user_id")
def bm16_days(spark, d):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return M.table(spark, d, "events").groupBy(F.concat(F.lit("user:"), "user_id").alias("key")).agg(F.array_join(bits_agg(day).cast("array<string>"), ",").alias("bits"))


@query("SELECT key, member, score FROM zt a WHERE key = 'ev:click' AND EXISTS (SELECT 1 FROM se WHERE se.key = 'purchase' AND se.member = a.member)", "zt", "se")
def memberbf_semi(spark, d):
    """A Bloom filter first, then the exact join. The filter has the size of the set within fixed bounds (10 MB): past them it lets more through."""
    users = M.se(spark, d).where("key = 'purchase'")
    size = max(64, min(users.count(), 1 << 23))
    blob = bloom_agg(users, "key", "member", size=size).select("bloom").head()
    left = _ev(spark, d, "click")
    left = joins.in_bloom(left, bytes(blob[0])) if blob else left
    return joins.intersect(left, users).select("key", "member", "score")


@query("SELECT key, 'zset' AS kind, count(*) AS size FROM zn GROUP BY key UNION ALL SELECT key, 'set', count(*) FROM se GROUP BY key UNION ALL SELECT key, 'string', strlen(value) FROM kv", "zn", "se", "kv")
def scan_catalog(spark, d):
    return scan.catalog(M.zn(spark, d), M.se(spark, d), M.kv(spark, d))


@query("SELECT member FROM se WHERE key = 'click' AND member >= 'u1' ORDER BY member LIMIT 11", "se")
def sscan_page(spark, d):
    return scan.sscan(M.se(spark, d), "click", "u1", 10)


@query("SELECT 'zset' AS kind, CAST(sum(strlen(key) + strlen(member) + coalesce(strlen(data), 0) + 8) AS BIGINT) AS bytes FROM zc UNION ALL SELECT 'set', CAST(sum(strlen(key) + strlen(member)) AS BIGINT) FROM se UNION ALL SELECT 'string', CAST(sum(strlen(key) + strlen(value)) AS BIGINT) FROM kv", "zc", "se", "kv")
def ssdisksize(spark, d):
    return scan.disk_size(M.zc(spark, d), M.se(spark, d), M.kv(spark, d))


_POSTS = """tok AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]{2,}') AS w FROM documents),
posts AS (SELECT term, CAST(doc_id AS VARCHAR) AS doc, count(*) / CAST(any_value(n) AS DOUBLE) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM tok) GROUP BY doc_id, term)"""


def _zri(terms: list[str]) -> str:
    parsed = fts.parse_terms(terms)
    values = ", ".join(f"('{t}', '{m}')" for t, m in parsed)
    needed = sum(m == "+" for _, m in parsed)
    return f"""WITH {_POSTS}, q AS (SELECT * FROM (VALUES {values}) v(term, mark)),
c AS (SELECT q.term, q.mark, (SELECT count(*) FROM posts p WHERE p.term = q.term) AS card FROM q),
w AS (SELECT *, CASE WHEN card + 1 = (SELECT sum(card + 1) FROM c) THEN 1 ELSE ln((SELECT sum(card + 1) FROM c) / CAST(card + 1 AS DOUBLE)) END AS idf FROM c),
s AS (SELECT doc, sum(tf * idf) AS s, count(*) AS hits, min(card) AS via, sum(CASE WHEN mark = '+' THEN 1 ELSE 0 END) AS met, max(CASE WHEN mark = '-' THEN 1 ELSE 0 END) AS bad FROM posts JOIN w ON w.term = posts.term GROUP BY doc)
SELECT doc, round(s * power(hits / {len(parsed)}.0, 2.5) * (SELECT min(card) FROM c WHERE card > 0) / via, 9) AS score FROM s WHERE bad = 0 AND met = {needed}"""


def _search(name, terms):
    def f(spark, d):
        return fts.ranked(fts.postings(M.table(spark, d, "documents")), terms, count=2**31 - 1).select("doc", F.round("score", 9).alias("score"))

    f.__name__ = name
    query(_zri(terms))(f)


_search("zri_basic", ["tion", "than", "ble"])
_search("zri_required", ["+der", "und", "?die"])
_search("zri_excluded", ["the", "-with", "of"])
_search("zri_single", ["und"])


@query(None)
def zri_any(spark, d):
    """By the tokens of any script, whose rules SQL has not."""
    return fts.ranked(fts.postings_any(M.table(spark, d, "documents")), ["+fü", "ür", "und"], count=2**31 - 1).select("doc", F.round("score", 9).alias("score"))


@query("""SELECT m.name, m.minute, coalesce(v, 0) AS value FROM (
SELECT name, unnest(generate_series(a, b, INTERVAL 1 MINUTE)) AS minute FROM (SELECT event_type AS name, min(date_trunc('minute', ts)) AS a, max(date_trunc('minute', ts)) AS b FROM events GROUP BY event_type)) m
LEFT JOIN (SELECT event_type AS name, date_trunc('minute', ts) AS minute, arg_max(value, ts) AS v FROM events GROUP BY 1, 2) e ON e.name = m.name AND e.minute = m.minute""")
def metrics_fill(spark, d):
    return metrics.fill_series(M.series(spark, d)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


def _frames() -> str:
    parts = []
    for label, k in metrics.SPANS.items():
        w = f"OVER (PARTITION BY name ORDER BY bucket RANGE BETWEEN {k * 20} PRECEDING AND 20 PRECEDING)"
        seconds = 3600 if label == "all" else k * 20
        parts.append(f"round(coalesce(sum(n) {w}, 0) / {seconds}.0, 6) AS qps_{label}, round(sum(v) {w} / nullif(sum(n) {w}, 0), 6) AS mean_{label}, max(x) {w} AS max_{label}")
    return "SELECT name, bucket, " + ", ".join(parts) + " FROM (SELECT event_type AS name, CAST(floor(epoch_us(ts) / 1e6 / 20) * 20 AS BIGINT) AS bucket, sum(value) AS v, count(*) AS n, max(value) AS x FROM events GROUP BY 1, 2)"


@query(_frames())
def metrics_sliding(spark, d):
    out = metrics.sliding_stats(M.series(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c[:4] in ("qps_", "mean") else c for c in out.columns])


@query("SELECT event_type AS name, date_trunc('minute', ts) AS minute, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1, 2")
def metrics_p99(spark, d):
    return metrics.p99_by_minute(M.series(spark, d), exact=True).select("name", F.col("minute").cast("timestamp_ntz").alias("minute"), F.round("p99", 6).alias("p99"))


@query("SELECT key, score, member, data FROM zo WHERE key >= 'cust:1' AND key <= 'cust:5' AND score >= 1000 AND score <= 300000 AND (data LIKE '%URGENT%' OR member LIKE '%URGENT%')", "zo")
def export_ssd(spark, d):
    """Written as gzip CSV and read again."""
    path = tables.shared_path(spark, "export")
    tables.export_csv(M.zo(spark, d), path, from_key="cust:1", to_key="cust:5", low=1000.0, high=300000.0, match="\\term{URGENT}", with_data=True)
    return tables.read_export(spark, path, with_data=True)


@query("SELECT key, member, arg_max(score, seq) AS score FROM adds GROUP BY key, member", "adds")
def cmdlog_replay_stream(spark, d):
    """Upserts written to a log, which a stream folds into versions of the table."""
    root = tables.shared_path(spark, "cmdlog")
    log.append(adds(spark, d).select("seq", "key", "member", "score", F.lit("zadd").alias("op")), f"{root}/log")
    log.follow(spark, f"{root}/log", f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return log.latest(spark, f"{root}/state").select("key", "member", "score")


def _session(spark, d, **tables) -> Session:
    return Session(spark, **{k: v.select(*(c for c in ("key", "member", "score", "data") if c in v.columns)) for k, v in tables.items()})


_BETWEEN = "FROM zc WHERE key = 'nation:3' AND score BETWEEN 0 AND 5000"


@query(f"SELECT arg_min(member, (score, member)) AS first, min(score) AS first_score, arg_max(member, (score, member)) AS last, max(score) AS last_score, count(*) AS n {_BETWEEN}", "zc")
def cmd_memberbf(spark, d):
    """The ends and the number of a range; the filter itself is in `cmd_intbfdata`."""
    return _session(spark, d, z=M.zc(spark, d)).run("ZRANGEBYSCORE nation:3 0 5000 MEMBERBF 0.01").select("first", "first_score", "last", "last_score", "n")


@query(f"SELECT member, score {_BETWEEN} AND data = 'BUILDING'", "zc")
def cmd_intbfdata(spark, d):
    """A range filtered by a Bloom filter of another range, and exactly after it."""
    z = M.zc(spark, d)
    s = _session(spark, d, z=z.union(z.where("data = 'BUILDING' AND key = 'nation:3'").withColumn("key", F.lit("building"))))
    row = s.run("ZRANGEBYSCORE building -inf +inf MEMBERBF 0.01").head()
    blob = f"INTBFDATA {base64.b64encode(row['bloom']).decode()}" if row else ""
    return s.run(f"ZRANGEBYSCORE nation:3 0 5000 {blob} INTERSECT building WITHSCORES")


@query(f"SELECT member, score {_BETWEEN} AND data = 'BUILDING'", "zc")
def cmd_precedence(spark, d):
    """Of INTERSECT and TWOHOPS only the first counts."""
    z = M.zc(spark, d)
    s = _session(spark, d, z=z.union(z.where("data = 'BUILDING'").withColumn("key", F.lit("building"))))
    return s.run("ZRANGEBYSCORE nation:3 0 5000 TWOHOPS nobody INTERSECT building WITHSCORES")


@query("SELECT member, score FROM zc WHERE key IN ('nation:3', 'nation:4') AND score BETWEEN 0 AND 5000 ORDER BY score DESC, member DESC LIMIT 50", "zc")
def cmd_union(spark, d):
    """A union has no filter."""
    return _session(spark, d, z=M.zc(spark, d)).run("ZREVRANGEBYSCORE nation:3 5000 0 UNION nation:4 INTERSECT none WITHSCORES LIMIT 0 50")


@query("SELECT command, CAST(result AS DOUBLE) AS result FROM (VALUES ('add', 2.0), ('ch', 3.0), ('incr', 7.0), ('incrto', -5.0), ('nx', 0.0), ('rem', 1.0)) AS t(command, result)")
def cmd_answers(spark, d):
    """What writes answer."""
    s, out = Session(spark), None
    for name, line in (("add", "ZADD z 5 a 2 a 1 b"), ("ch", "ZADD z CH 3 a 1 b 4 c 6 d"), ("incr", "ZINCRBY z 4 a"), ("incrto", "ZINCRBY z 2 a INCRTO"), ("nx", "ZADD z NX 9 a"), ("rem", "ZREM z d d q")):
        one = s.run(line).select(F.lit(name).alias("command"), "result")
        out = one if out is None else out.union(one)
    return out


@query("SELECT member, CAST(score AS DOUBLE) AS score, data FROM (VALUES ('a', 2.0, ''), ('b', 3.0, 'x'), ('c', 8.0, 'a-6-2'), ('d', -2.0, ''), ('e', 7.0, 'x')) AS t(member, score, data)")
def cmd_zincrby(spark, d):
    s = Session(spark)
    for line in ("ZADD z 6 c", "ZINCRBY z 2 a ADD negresult d", "ZINCRBY z 3 b DATA x ADD 7 e", """ZINCRBY z 2 c DF "concat('a-', cast(score AS INT), '-', cast(by AS INT))" """):
        s.run(line)
    return s.z.select("member", "score", F.coalesce("data", F.lit("")).alias("data"))


_DAYS = "SELECT DISTINCT 'user:' || user_id AS key, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS bit FROM events"


def _days(spark, d) -> DataFrame:
    """The days of each user's events, as bitmaps in data."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    bits = M.table(spark, d, "events").groupBy(F.concat(F.lit("user:"), "user_id").alias("key")).agg(bits_agg(day).alias("bits"))
    return bits.select("key", F.lit("days").alias("member"), F.lit(0.0).alias("score"), F.lower(F.hex(to_bitmap("bits"))).alias("data"))


@query(f"SELECT key, bit FROM ({_DAYS}) WHERE bit BETWEEN 3 AND 12")
def zdata_bm16(spark, d):
    z = _days(spark, d)
    return lookup.zdata_bm16(lookup.with_bits(z), z.select(F.lit(0).alias("pos"), "key", "member"), 3, 12).select("key", "bit")


@query(f"SELECT DISTINCT key FROM ({_DAYS}) WHERE bit IN (4, 70)")
def match_bm16(spark, d):
    z = _days(spark, d)
    return z.where(match_expr("\\bm16{4,70}", F.col("member"), F.col("data"))).select("key")


@query("SELECT bit FROM (VALUES (3), (9), (500)) AS t(bit)")
def cmd_bm16(spark, d):
    s = Session(spark)
    for line in ("ZADD z BM16 1 a 9 1 a 500", "ZINCRBY z 1 a BM16 3", "ZADD z BM16 1 a 9"):
        s.run(line)
    return s.run("ZDATABM16 z a 0 0").select(F.col("bit"))


@query("SELECT key, member FROM zc WHERE regexp_matches(member, '^c[0-9]?5$') OR regexp_matches(member, '^c12[^/]*$')", "zc")
def match_path(spark, d):
    z = M.zc(spark, d)
    return z.where(match_expr("\\or{\\match{c?5}\\match{c5}\\match{c12*}}", F.col("member"), None, "member")).select("key", "member")


@query("SELECT n_nationkey FROM nation WHERE contains(n_name, '1')")
def match_pb(spark, d):
    """Messages of a number (field 1) and a name (field 2), by the name."""
    n = M.table(spark, d, "nation")
    size = lambda c: F.unhex(F.lpad(F.hex(F.octet_length(c)), 2, "0"))
    raw = F.concat(F.unhex(F.lit("08")), F.unhex(F.lpad(F.hex(F.col("n_nationkey")), 2, "0")), F.unhex(F.lit("12")), size(F.col("n_name")), F.col("n_name").cast("binary"))
    return n.where(match_expr("\\pb:2s{\\term{1}}", F.lit(""), raw.cast("string"))).select("n_nationkey")


@query("SELECT 'region:' || r_regionkey AS key, r_name AS outer_name, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey) FILTER (n_nationkey < 12), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def fanout_nested(spark, d):
    """Regions with their nations below 12, as a tree."""
    r = M.table(spark, d, "region").select(F.lit("all").alias("key"), F.concat(F.lit("region:"), "r_regionkey").alias("member"), F.col("r_regionkey").cast("double").alias("score"), F.col("r_name").alias("data"))
    tree = joins.nested(joins.fanout(r, M.zn(spark, d), 0, 12, 100))
    return tree.select(F.col("member").alias("key"), F.col("data").alias("outer_name"), F.array_join(F.transform("children", lambda x: x["data"]), ",").alias("names"))
