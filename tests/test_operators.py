import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions.keys import concat_key
from tarn.model import HARD_LIMIT
from tarn.operators import fts, joins, lookup, metrics, mutate, ranges, scan
from tarn.plans.command import Session
from tarn.queries import QUERIES
from tarn.sources import tables
from tarn.streaming import log

Z = "key string, member string, score double, data string"


@pytest.fixture(scope="module")
def z(spark):
    rows = [("a", f"m{i}", float(i % 4), f"d{i}") for i in range(9)] + [("b", "m1", float("inf"), None), ("b", "m2", float("-inf"), ""), ("b", "ÿ", 0.0, "x")]
    return spark.createDataFrame(rows, Z)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def model(z, key, rev=False):
    return sorted(((r["score"], r["member"]) for r in z.collect() if r["key"] == key), reverse=rev)


@pytest.mark.parametrize("rev", [False, True])
@pytest.mark.parametrize("span", [(0, 2), (-3, -1), (2, -2), (-100, 1), (5, 3), (0, 100), (-1, 0)])
def test_zrange(z, span, rev):
    start, stop = span
    for key in "ab":
        want = model(z, key, rev)
        n = len(want)
        a, b = (max(0, start + n) if start < 0 else start), (stop + n if stop < 0 else stop)
        got = rows(ranges.zrange(z, start, stop, keys=[key], rev=rev), "rank", "score", "member")
        assert got == [(i, *want[i]) for i in range(n) if a <= i <= b]


@pytest.mark.parametrize("rev", [False, True])
def test_zrange_with_limit(z, rev):
    for span in ((1, -2), (0, -1), (-3, -1), (-100, 5)):
        want = rows(ranges.zrange(z, *span, rev=rev), "key", "rank", "member")
        assert rows(ranges.zrange(z, *span, rev=rev, limit=2), "key", "rank", "member") == [r for k in "ab" for r in [x for x in want if x[0] == k][:2]]


def test_ranges_shuffle_no_more_than_asked(z):
    for df in (ranges.zrange(z, 0, 2), ranges.zrange(z, -3, -1), ranges.zrange(z, -9, 3), ranges.zrange(z, 1, -1, limit=5), ranges.zrank(z, max_rank=7)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_numbered(spark):
    """A key that holds most rows, over many intervals, with ties of scores."""
    z = spark.range(3000).selectExpr("if(id % 10 = 0, concat('k', id % 7), 'hot') AS key", "cast(id * 7919 % 3001 AS string) AS member", "cast(id % 5 AS double) AS score")
    for by in (ranges.order(), ranges.order(True)):
        want = z.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*by)) - 1)
        assert rows(ranges.numbered(z, by), "key", "member", "rank") == rows(want, "key", "member", "rank")
    assert ranges.numbered(z.where("false"), ranges.order()).count() == 0


def test_limits_and_counts(z):
    assert ranges.zrangebyscore(z, "-inf", "+inf", limit=0).count() == 0
    assert rows(ranges.zrangebyscore(z, "+inf", "-inf", rev=True, limit=1), "key", "member") == [("a", "m7"), ("b", "m1")]
    assert rows(ranges.zcount(z, "(0", "3"), "key", "n") == [("a", 6)]
    assert rows(ranges.zcount(z, "-", "(m2", lex=True), "key", "n") == [("a", 2), ("b", 1)]
    assert rows(ranges.zrangebylex(z, "-", "+", keys=["b"]), "member") == [("m1",), ("m2",), ("ÿ",)]
    assert ranges.zrangebyscore(z, "0", "inf", match="d3").count() == 1


def test_rank_of(spark, z):
    asked = spark.createDataFrame([("a", "m4"), ("a", "none"), ("b", "m1")], "key string, member string")
    for rev in (False, True):
        all_ranks = {(r["key"], r["member"]): r["rank"] for r in ranges.zrank(z, rev=rev).collect()}
        for r in ranges.zrank_of(z, asked, rev=rev).collect():
            assert r["rank"] == all_ranks.get((r["key"], r["member"]))


def test_ranks_beyond_the_hard_limit(spark):
    n = HARD_LIMIT + 5
    long = spark.range(n).selectExpr("'k' AS key", "format_string('m%06d', id) AS member", "CAST(id AS DOUBLE) AS score", "'' AS data")
    asked = spark.createDataFrame([("k", f"m{n - 1:06d}")], "key string, member string")
    for rev, last in ((False, f"m{n - 1:06d}"), (True, "m000000")):
        got = ranges.zrank(long, rev=rev)
        assert got.count() == n and rows(got.where(F.col("rank") == n - 1), "member") == [(last,)]
        assert ranges.zrank(long, rev=rev, max_rank=9).count() == 10
    assert rows(ranges.zrank_of(long, asked), "rank") == [(n - 1,)]
    assert rows(ranges.zrank_of(long, asked, max_rank=HARD_LIMIT), "rank") == [(None,)]


def test_lookup(spark, z):
    asked = spark.createDataFrame([(0, "b", "m2"), (1, "b", "zz"), (2, "b", "m2"), (3, "b", "m1")], "pos int, key string, member string")
    assert [r["data"] for r in lookup.zmdata(z, asked).orderBy("pos").collect()] == ["", None, "", ""]
    assert [r["is_member"] for r in lookup.smismember(z, asked).orderBy("pos").collect()] == [1, 0, 1, 1]
    bits = spark.createDataFrame([("b", "m2", [1, 5, 9])], "key string, member string, bits array<int>")
    assert rows(lookup.zdata_bm16(bits, asked, 2, 0), "pos", "bit") == [(0, 5), (0, 9), (2, 5), (2, 9)]


def test_joins(z):
    a, b = z.where("key = 'a'"), z.where("key = 'b'")
    assert rows(joins.intersect(a, b), "member") == [("m1",), ("m2",)]
    assert joins.notintersect(a, b).count() == 7
    assert rows(joins.union_topk(a, b, a, rev=True, limit=3), "score", "member") == [(3.0, "m7"), (3.0, "m7"), (float("inf"), "m1")]


def test_fanout(spark):
    outer = spark.createDataFrame([("r", "n1", 1.0, None), ("r", "n2", 2.0, None), ("r", "n3", 3.0, None)], Z)
    inner = spark.createDataFrame([(f"k:n{n}", f"c{i}", float(i), None) for n in (1, 3) for i in range(5)], Z)
    key = concat_key(F.col("member"), "k:")
    got = rows(joins.fanout(outer, inner, "1", "4", 2, key), "member", "pos", "child")
    assert [(m, p, c) for m, p, c in got] == [("n1", 1, "c1"), ("n1", 2, "c2"), ("n2", 0, None), ("n3", 1, "c1"), ("n3", 2, "c2")]
    down = joins.fanout(outer, inner, "4", "1", 2, key).where("member = 'n1'")
    assert [r["child"] for r in down.orderBy("pos").collect()] == ["c3", "c2"]
    assert joins.fanout(outer, inner, "1", "4", 2, key, limit=4).count() == 3


def replayed(cmds):
    """A model of the fold in plain Python."""
    state = {}
    for c in sorted(cmds, key=lambda c: c["seq"]):
        at = (c["key"], c["member"])
        if c["op"] == "del":
            state = {k: v for k, v in state.items() if k[0] != c["key"]}
        elif c["op"] == "zrem":
            state.pop(at, None)
        elif c["op"] == "zincrby":
            old = state.get(at, (0.0, None))
            state[at] = (old[0] + c["score"], old[1])
        else:
            old, t = state.get(at), c["dslt"]
            skip = c["nx"] and old or c["xx"] and not old or (t is not None and c["merge"] is None and c["score"] < t)
            if not skip:
                was = old[0] if old else 0.0
                new = {"sum": was + c["score"], "avg": (was + c["score"]) / 2, "bit": float(int(was) & (c["mask"] if c["mask"] is not None else -1) | int(c["score"]))}.get(c["merge"], c["score"])
                state[at] = (new, old[1] if c["pd"] and old and not c["data"] else c["data"])
            if t is not None:
                state = {k: v for k, v in state.items() if k[0] != c["key"] or v[0] >= t}
    return sorted((*k, *v) for k, v in state.items())


@pytest.mark.parametrize("seed", range(3))
def test_fold_against_model(spark, seed):
    rng = random.Random(seed)
    cmds = []
    for seq in range(120):
        op = rng.choice(["zadd"] * 8 + ["zincrby", "zrem", "del"])
        cmds.append({"seq": seq, "key": rng.choice("ab"), "op": op, "member": None if op == "del" else f"m{rng.randrange(6)}", "score": float(rng.randrange(20)), "data": rng.choice(["", "x", "y"]),
                     "nx": rng.random() < 0.1, "xx": rng.random() < 0.1, "pd": rng.random() < 0.3, "merge": rng.choice([None, None, None, "sum", "avg", "bit"]), "mask": rng.choice([None, 12]), "dslt": rng.choice([None, None, None, 3.0])})
    names = list(cmds[0])
    schema = "seq long, key string, op string, member string, score double, data string, nx boolean, xx boolean, pd boolean, merge string, mask long, dslt double"
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in cmds], schema)
    got = sorted((r["key"], r["member"], r["score"], r["data"]) for r in mutate.fold(spark.createDataFrame([], Z), df).collect())
    assert [x[:3] for x in got] == [x[:3] for x in replayed(cmds)]
    half = mutate.fold(mutate.fold(spark.createDataFrame([], Z), df.where("seq < 60")), df.where("seq >= 60"))
    assert sorted((r["key"], r["member"], r["score"]) for r in half.collect()) == [x[:3] for x in got]


def test_sequential(spark):
    z = spark.createDataFrame([("k", "a", 1.0, None)], Z)
    cmds = spark.createDataFrame([(1, "k", "a", 2.0, "result", "b"), (2, "k", "b", 1.0, "negresult", "a")], "seq long, key string, member string, score double, add_from string, add_to string").withColumn("op", F.lit("zincrby"))
    assert rows(mutate.sequential(z, cmds), "member", "score") == [("a", -1.0), ("b", 4.0)]


def test_tokenizer():
    assert fts.tokenize("Hello world a") == {"hello": 0.5, "world": 0.5}
    assert fts.tokenize("") == {} and fts.tokenize("!!!") == {}
    got = fts.tokenize("ab中文字")
    assert set(got) == {"ab", "b中", "中文", "文字", "中文字"}


def test_ranked_markers(spark):
    posts = spark.createDataFrame([("x", "1", 0.5), ("x", "2", 0.5), ("y", "2", 0.5), ("z", "1", 0.1)], "term string, doc string, tf double")
    assert [r["doc"] for r in fts.ranked(posts, ["xx", "yy"]).collect()] == []
    docs = spark.createDataFrame([("1", "red red blue"), ("2", "red green"), ("3", "green blue blue")], "doc_id string, text string")
    p = fts.postings(docs)
    assert {r["doc"] for r in fts.ranked(p, ["+red", "blue"]).collect()} == {"1", "2"}
    assert {r["doc"] for r in fts.ranked(p, ["red", "-green"]).collect()} == {"1"}
    assert [r["doc"] for r in fts.ranked(p, ["red", "blue"], count=1).collect()] == ["1"]
    assert {(r["term"], r["tf"]) for r in fts.postings_any(docs).where("doc = '2'").collect()} == {("red", 0.5), ("green", 0.5)}
    with pytest.raises(ValueError):
        fts.parse_terms(["+"])


def test_zri_any(spark, sf_dir):
    terms, needed = ["fü", "ür", "und"], "fü"
    docs = {str(r["doc_id"]): fts.tokenize(r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    card = {t: sum(t in x for x in docs.values()) for t in terms}
    total = sum(card[t] + 1 for t in terms)
    want = {}
    for doc, x in docs.items():
        met = [t for t in terms if t in x]
        if needed in met:
            s = sum(x[t] * math.log(total / (card[t] + 1)) for t in met)
            want[doc] = s * (len(met) / len(terms)) ** 2.5 * min(n for n in card.values() if n) / min(card[t] for t in met)
    got = {r["doc"]: r["score"] for r in QUERIES["zri_any"](spark, sf_dir).collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=2e-9) for k, v in want.items())


def test_metrics(spark):
    m = spark.sql("SELECT * FROM VALUES ('q', timestamp'2024-01-01 00:00:05', 1D), ('q', timestamp'2024-01-01 00:00:50', 3D), ('q', timestamp'2024-01-01 00:03:00', double('NaN')) AS t(name, ts, value)")
    assert [r["value"] for r in metrics.fill_series(m).orderBy("minute").collect()] == [3.0, 0.0, 0.0, 0.0]
    s = {r["bucket"] % 3600: r for r in metrics.sliding_stats(m.where("NOT isnan(value)")).collect()}
    assert s[40]["qps_m1"] == 1 / 60 and s[40]["mean_m1"] == 1.0 and s[0]["mean_all"] is None
    assert metrics.names(metrics.without(m, "q")).count() == 0
    assert metrics.chart(m, "q").count() == 4


def test_scan(spark, z):
    s = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z")], "key string, member string")
    kv = spark.createDataFrame([("a", "é")], "key string, value string")
    names = scan.catalog(z, s, kv)
    page = scan.scan(names, None, 2).collect()
    assert [(r["kind"], r["key"]) for r in page] == [("zset", "a"), ("zset", "b"), ("set", "a")]
    assert [(r["kind"], r["size"]) for r in scan.scan(names, ("set", "a"), 5).collect()] == [("set", 3), ("string", 2)]
    assert [r["member"] for r in scan.sscan(s, "a", "y", 1).collect()] == ["y", "z"]


def test_export(spark, z, tmp_path):
    path = f"file://{tmp_path}/x"
    tables.export_csv(z, path, low=0.0, high=1.0, with_data=True)
    assert tables.read_export(spark, path, True).count() == z.where("score BETWEEN 0 AND 1").count()


def test_stream(spark, tmp_path):
    base = f"file://{tmp_path}"
    part = lambda a, b: spark.range(a, b).select(F.col("id").alias("seq"), F.lit("k").alias("key"), F.concat(F.lit("m"), F.col("id") % 3).alias("member"), F.col("id").cast("double").alias("score"))
    log.append(part(0, 10), f"{base}/log")
    log.follow(spark, f"{base}/log", f"{base}/state", f"{base}/cp").awaitTermination()
    log.append(part(10, 20), f"{base}/log")
    log.follow(spark, f"{base}/log", f"{base}/state", f"{base}/cp").awaitTermination()
    assert rows(log.latest(spark, f"{base}/state"), "member", "score") == [("m0", 18.0), ("m1", 19.0), ("m2", 17.0)]
    whole = spark.read.schema(log.LOG).parquet(f"{base}/log")
    assert rows(log.replay(spark.createDataFrame([], Z), whole.union(whole)), "score") == [(17.0,), (18.0,), (19.0,)]
    assert log.checked(whole.withColumn("score", F.lit(0.0))).count() == 1  # only what was 0 before


def test_commands(spark):
    s = Session(spark)
    s.run("ZADD z 1 a 2 b 3 c")
    s.run("ZADD z XX 5 a 9 new")
    s.run("ZADD w DATA 1 b hello 2 d x")
    s.run("ZINCRBY z 2 b")
    got = lambda line: [tuple(r) for r in s.run(line).collect()]
    assert got("ZRANGE z 0 -1 WITHSCORES") == [("c", 3.0), ("b", 4.0), ("a", 5.0)]
    assert got("ZREVRANGEBYSCORE z +inf (3 LIMIT 0 1") == [("a",)]
    assert got("ZRANGEBYSCORE z -inf +inf INTERSECT w") == [("b",)]
    assert got("ZRANGEBYSCORE z -inf +inf NOTINTERSECT w limit 0 1") == [("c",)]
    assert got("ZRANGEBYSCORE w -inf +inf MATCH hel* WITHDATA") == [("b", 1.0, "hello")]
    assert got("ZRANK z a") == [("z", "a", 2)] and got("ZCARD z") == [("z", 3)]
    assert got("ZMSCORE z a x a") == [(0, "z", "a", 5.0), (1, "z", "x", None), (2, "z", "a", 5.0)]
    s.run("ZREM z a a")
    assert got("ZCOUNT z -inf +inf") == [("z", 2)]
    s.run("SADD s x y x")
    s.run("SET k v")
    s.run("SETNX k w")
    assert got("GET k") == [(0, "k", "v")] and got("SMISMEMBER s x q") == [(0, "s", "x", 1), (1, "s", "q", 0)]
    assert {r["kind"] for r in s.run("SCAN").collect()} == {"zset", "set", "string"}
    s.run("DEL z")
    assert got("ZCARD z") == [("z", 0)] and got("ZCOUNT z 0 1") == [("z", 0)]
    for bad in ("ZADD z nan a", "ZADD z 1", "NOPE x"):
        with pytest.raises(ValueError):
            s.run(bad)


@pytest.fixture
def session(spark):
    s = Session(spark)
    return s, lambda line: [tuple(r) for r in s.run(line).collect()]


def test_answers_and_order(session):
    s, got = session
    assert got("ZADD z 5 a 2 a") == [(1.0,)] and got("ZMSCORE z a") == [(0, "z", "a", 2.0)]
    assert got("ZADD z 1 b 3 a") == [(1.0,)] and got("ZADD z CH 1 b 4 a 9 c") == [(2.0,)]
    assert got("ZADD z XX 11 a 12 new") == [(0.0,)] and got("ZADD z NX 1 a 1 new") == [(1.0,)]
    assert got("ZREM z a a q") == [(1.0,)] and got("ZCARD z") == [("z", 3)]
    assert got("SADD s x y x") == [(2.0,)] and got("SADD s y z") == [(1.0,)] and got("SREM s x q") == [(1.0,)] and got("SCARD s") == [("s", 2)]
    assert got("SETNX k a") == [(1.0,)] and got("SETNX k b") == [(0.0,)] and got("GET k") == [(0, "k", "a")]


def test_bits_of_scores(session):
    """FIXTURES A7: mask of the bits 33 to 63."""
    s, got = session
    s.run("ZADD z 1 a")
    steps = [("MSBITSET 63 33 33", 2, 2**33 + 2), ("MSBITSET 63 33 33", 3, 2**33 + 3), ("MSBITCLR 63 33 34", 4, 2**33 + 4), ("MSBITCLR 63 33 33 PD", 5, 5), ("MSBITINV 63 33 33", 6, 2**33 + 6), ("MSBIT 63 33", 7, 2**33 + 7), ("MSSUM", 8, 2**33 + 15)]
    for flags, n, want in steps:
        s.run(f"ZADD z {flags} {n} a")
        assert got("ZSCORE z a") == [(0, "z", "a", float(want))]
    with pytest.raises(ValueError):
        s.run("ZADD z MSBITSET 40 33 3 1 a")


def test_bitmaps_in_data(session):
    s, got = session
    s.run("ZADD z BM16 1 a 1 1 a 500 2 b 7")
    s.run("ZINCRBY z 100 a BM16 9")
    for n in (99, 100, 101):
        s.run(f"ZADD z BM16 3 c {n}")
    assert got("ZDATABM16 z a 0 0") == [(1,), (9,), (500,)] and got("ZDATABM16 z a 2 0") == [(9,), (500,)] and got("ZDATABM16 z a 0 9") == [(1,), (9,)]
    assert got("ZDATABM16 z c 100 100") == [(100,)] and got("ZDATABM16 z none 0 0") == [] and got("ZSCORE z a") == [(0, "z", "a", 101.0)]


def test_increments(session):
    """FIXTURES A6 and B."""
    s, got = session
    assert got("ZINCRBY z 1 foo") == [(1.0,)] and got("ZINCRBY z 2 foo DATA x") == [(3.0,)]
    assert got("ZADD z 1 bar") == [(1.0,)] and got("ZINCRBY z 10 bar") == [(11.0,)] and got("ZINCRBY z -5 bar") == [(6.0,)]
    assert got("""ZINCRBY z 1 bar INCRTO DF "concat('a-', cast(score as int), '-', cast(by as int))" """) == [(-5.0,)]
    assert got("ZMDATA z foo bar") == [(0, "z", "foo", "x"), (1, "z", "bar", "a-6-1")]
    assert got("ZADD k 1 a") == [(1.0,)] and got("ZINCRBY k 2 a ADD result b") == [(3.0,)] and got("ZMSCORE k a b") == [(0, "k", "a", 3.0), (1, "k", "b", 3.0)]
    assert got("ZINCRBY k 1 a ADD negresult b") == [(4.0,)] and got("ZINCRBY k 1 a ADD 7 c") == [(5.0,)]
    assert got("ZMSCORE k a b c") == [(0, "k", "a", 5.0), (1, "k", "b", -1.0), (2, "k", "c", 7.0)]
    for bad in ("ZINCRBY k 1 a ADD what b", "ZINCRBY k 1 a WHAT"):
        with pytest.raises(ValueError):
            s.run(bad)


def test_filters_of_ranges(session):
    """FIXTURES A8; a Bloom filter made by one range filters another; of several kinds of filter one counts."""
    import base64

    s, got = session
    for name, step in (("iz", 1), ("iz2", 2), ("iz3", 3)):
        s.run(f"ZADD {name} " + " ".join(f"{i} m{i}" for i in range(step, 41, step)))
    s.run("ZADD m9 1 x")
    members = lambda line: [r[0] for r in got(f"ZRANGEBYSCORE iz -inf +inf {line} LIMIT 0 6")]
    assert members("INTERSECT iz2 INTERSECT iz3") == ["m6", "m12", "m18", "m24", "m30", "m36"]
    assert members("NOTINTERSECT iz2 INTERSECT iz3") == ["m3", "m9", "m15", "m21", "m27", "m33"]
    assert members("INTERSECT missing INTERSECT iz3") == [] and members("NOTINTERSECT missing") == [f"m{i}" for i in range(1, 7)]
    row = s.run("ZRANGEBYSCORE iz3 6 +inf MEMBERBF 0.001 INTERSECT iz2 LIMIT 0 4").head()
    assert (row["first"], row["first_score"], row["last"], row["n"]) == ("m6", 6.0, "m15", 4)
    blob = base64.b64encode(row["bloom"]).decode()
    assert members(f"INTBFDATA {blob}") == ["m6", "m9", "m12", "m15"] and members(f"INTBFDATA {blob} INTERSECT iz2") == ["m6", "m12"]
    rev = s.run("ZREVRANGEBYSCORE iz3 15 6 MEMBERBF 0.001").head()
    assert (rev["first"], rev["last"], rev["n"]) == ("m15", "m6", 4) and s.run("ZRANGEBYSCORE none 0 1 MEMBERBF 0.1").count() == 0
    assert members("TWOHOPS x") == ["m9"] and members("TWOHOPS x INTERSECT iz2") == ["m2", "m4", "m6", "m8", "m10", "m12"]
    assert got("ZRANGEBYSCORE iz2 1 3 UNION iz3 INTERSECT none WITHSCORES") == [("m2", 2.0), ("m3", 3.0)]
    s.run("SADD s m6 q")
    assert members(f"INTBFDATA {base64.b64encode(s.run('SMEMBERS s MEMBERBF 0.001').head()['bloom']).decode()}") == ["m6"]


def test_many_writes(session):
    """Plans don't grow with the number of writes."""
    s, got = session
    for i in range(200):
        s.run(f"ZADD z --DEFER-- {i} m{i % 50}")
        if i % 40 == 0:
            s.run(f"ZINCRBY z 1000 m{i % 50} --DEFER--")
    assert got("ZCARD z") == [("z", 50)] and got("ZREVRANGE z 0 2 WITHSCORES") == [("m10", 1160.0), ("m49", 199.0), ("m48", 198.0)]
    assert len(s.z._jdf.queryExecution().logical().toString()) < 400_000
    for i in range(150):
        s.run(f"SADD s x{i % 60} --DEFER--")
        s.run(f"SET k{i % 30} v{i} --DEFER--")
    assert got("SCARD s") == [("s", 60)] and got("GET k29") == [(0, "k29", "v149")]
    assert dict(got("INFO"))["zset_members"] == 50 and got("CONFIG GET hard*") == [("hard_limit", "65535")]


def test_nested(spark):
    outer = spark.createDataFrame([("r", "n1", 1.0, None), ("r", "n2", 2.0, None)], Z)
    inner = spark.createDataFrame([("n1", f"c{i}", float(i), None) for i in range(3)], Z)
    got = {r["member"]: [(c["member"], c["score"]) for c in r["children"]] for r in joins.nested(joins.fanout(outer, inner, 0, 5, 2)).collect()}
    assert got == {"n1": [("c0", 0.0), ("c1", 1.0)], "n2": []}


def test_log_twice(spark, tmp_path):
    """The same commands appended again, in another file: sums count once."""
    base = f"file://{tmp_path}"
    adds = spark.createDataFrame([(1, 0, "k", "m", 5.0, "sum"), (1, 1, "k", "m", 2.0, "sum"), (2, 0, "k", "n", 1.0, "sum")], "seq long, pos int, key string, member string, score double, merge string")
    for _ in range(2):
        log.append(adds, f"{base}/log")
        log.follow(spark, f"{base}/log", f"{base}/state", f"{base}/cp").awaitTermination()
    assert rows(log.latest(spark, f"{base}/state"), "member", "score") == [("m", 7.0), ("n", 1.0)]


def test_versions_by_shard(spark, tmp_path):
    """A batch writes the shards of its own commands; one that empties a shard leaves none of its rows."""
    base = f"file://{tmp_path}"
    batches = ([(1, "a", "m", 1.0, "zadd"), (2, "b", "m", 2.0, "zadd")], [(3, "a", "n", 3.0, "zadd")], [(4, "a", None, 0.0, "del")], [(5, "a", "o", 5.0, "zadd"), (6, "b", "m", 6.0, "zadd")])
    want = ([("a", "m", 1.0), ("b", "m", 2.0)], [("a", "m", 1.0), ("a", "n", 3.0), ("b", "m", 2.0)], [("b", "m", 2.0)], [("a", "o", 5.0), ("b", "m", 6.0)])
    wrote = []
    for cmds, now in zip(batches, want, strict=True):
        log.append(spark.createDataFrame(cmds, "seq long, key string, member string, score double, op string"), f"{base}/log")
        log.follow(spark, f"{base}/log", f"{base}/state", f"{base}/cp").awaitTermination()
        assert rows(log.latest(spark, f"{base}/state"), "key", "member", "score") == now
        wrote.append(sorted(r["v"] for r in log.applied(spark, f"{base}/state", len(wrote)).collect()))
    assert wrote == [[0, 0], [0, 1], [0, 2], [3, 3]]
    assert rows(log.version(spark, f"{base}/state", 1), "key", "member", "score") == want[1]


def test_snapshot(spark, z, tmp_path):
    tables.snapshot(z, f"file://{tmp_path}/s")
    assert rows(tables.restore(spark, f"file://{tmp_path}/s"), "key", "member", "score") == rows(z, "key", "member", "score")


def test_key_bytes(spark):
    from tarn.functions.keys import fnv_shard, tag

    df = spark.createDataFrame([("é1",), ("ab",)], "m string")
    assert [r[0] for r in df.select(concat_key(F.col("m"), "k:", 2, -1)).collect()] == ["k:1", "k:ab"]  # indices of bytes; 2 wraps to 0 in two bytes
    keys = spark.createDataFrame([("a",), ("{a}",), ("b{a}",), ("b{a}c",), ("",), ("b{}c",)], "k string")
    got = [tuple(r) for r in keys.select(tag(F.col("k")), fnv_shard(F.col("k"))).collect()]
    assert len(set(got[:4])) == 1 and len(set(got[4:])) == 1
