"""Operators of the corpus pipeline against SQL, brute force and round trips, and on odd tables."""

import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import decontaminate, exact_dedup, jaccard, language, line_dedup, packing, quality, sentence_dedup, textvec, url_filter, warc
from tarn.llm.components import components, forest
from tarn.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, row long, h string, s string"


def documents(spark, texts):
    """Documents, with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", 0, "d", 1, "h", "s") for i, t in texts], DOCS)


WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("x", "y", "z", "w", "v", "t", "s")]


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "Null id."), (None, None), (5, "same text"), (5, "same text"), (6, "same  text"), (7, "x" * 300_000), (8, "é" * 50 + "\n" + "中文 " * 9), (9, "!!!")]


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in "documents pages benchmark labels".split():
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows(name, spark, db, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cur = db.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == theirs


@pytest.mark.parametrize("texts", [ODD, []], ids=["odd", "empty"])
def test_odd_tables(spark, texts):
    docs = documents(spark, texts)
    n = len(texts)
    assert exact_dedup.DigestIndex(spark).dedup(docs).count() == n
    assert line_dedup.dedup_lines(docs).count() == n
    assert sentence_dedup.remove_repeated(docs).count() == n
    items = spark.createDataFrame([(1, "same text"), (2, None), (3, ""), (None, "null id")], "item_id long, text string")
    for bench in (items, items.where("false")):
        assert decontaminate.contaminated(docs, bench).count() == n
    assert jaccard.similar(docs).count() == n
    assert {r["doc_id"] for r in packing.pack(docs).collect()} == {i for i, _ in texts}
    model = language.train(docs.select(F.col("lang").alias("label"), "text", F.col("doc_id").alias("key")))
    assert language.identify(docs, model, ["doc_id"]).count() == n
    labels = spark.createDataFrame([(5, 1), (9, 0), (None, 1), (2, None), (5, 0)], "doc_id long, label int")
    for known in (labels, labels.where("false")):
        got = quality.scored(docs, quality.train(docs, known))
        assert got.columns[:-1] == docs.columns and got.where("_score BETWEEN 0 AND 1").count() == n


def test_exact_index_persists(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = documents(spark, [(3, "a b"), (1, "a\t\tb"), (2, "c"), (4, None), (6, "")])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.DigestIndex(spark, path, 4).dedup(docs).collect()}
    assert got == {3: (1, 2, False), 1: (1, 2, True), 2: (2, 1, True), 4: (4, 2, True), 6: (4, 2, False)}
    # a later session: what is known keeps its place, a repeated run changes nothing
    again = exact_dedup.DigestIndex(spark, path, 4)
    for _ in range(2):
        more = {r["doc_id"]: r["keep_id"] for r in again.dedup(documents(spark, [(0, "a b"), (9, "new"), (2, "c")])).collect()}
        assert more == {0: 1, 9: 9, 2: 2}
    assert again.table().count() == 4
    with pytest.raises(ValueError, match="buckets"):
        exact_dedup.DigestIndex(spark, path, 8)
    again.close()


def test_lines(spark):
    run = "one\ntwo\nthree"
    docs = documents(spark, [(1, f"a\n{run}\nb"), (2, f"{run}\n\nfour"), (3, f"c\n one \n\ntwo\nthree\nd\n{run}"), (4, "one\ntwo\nx")])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: f"a\n{run}\nb", 2: "\nfour", 3: "c\n\nd", 4: "one\ntwo\nx"}


def brute_lines(texts, run=3, long_words=25):
    """(n_lines, n_removed, text) of each document of distinct ids, in order."""
    seen, out = {}, {}
    for i in sorted(texts):
        raw = (texts[i] or "").split("\n")
        full = [k for k, x in enumerate(raw) if x.strip(" \t\r\x0b\x0c")]
        lines, gone = [raw[k].strip(" \t\r\x0b\x0c") for k in full], set()
        for n in range(1, run + 1):
            for k in range(len(lines) - n + 1):
                part = tuple(lines[k : k + n])
                if (n == run or sum(len(x.split()) for x in part) >= long_words) and seen.setdefault((n, part), (i, k)) != (i, k):
                    gone |= {full[j] for j in range(k, k + n)}
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(raw) if k not in gone))
    return out


def cleaned_lines(docs):
    return {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()}


def test_lines_brute(spark):
    rng = random.Random(5)
    alphabet = [*"abcdef", "", " ", " a ", " ".join("x" * 13), " ".join("y" * 24), " ".join("z" * 25)]
    texts = {i: "\n".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for i in range(90)} | {200: None}
    assert cleaned_lines(documents(spark, list(texts.items()))) == brute_lines(texts)


def test_lines_brute_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert cleaned_lines(docs) == brute_lines({r["doc_id"]: r["text"] for r in docs.collect()})


def test_lines_many(spark):
    """200,000 lines in one text, half of them repeated: time in proportion to lines."""
    rng = random.Random(6)
    first = [f"{rng.random()}" for _ in range(100_000)]
    texts = {1: "\n".join(first + first), 2: "\n".join(first[50_000:])}
    assert cleaned_lines(documents(spark, list(texts.items()))) == brute_lines(texts)


def test_long_lines(spark):
    rng = random.Random(9)
    one, half = sentence(rng, 50), [sentence(rng, 13), sentence(rng, 12)]
    docs = documents(spark, [(1, f"{one}\nown a\n{half[0]}\n\n{half[1]}"), (2, f"own b\n {one}\nshort"), (3, f"own c\n{half[0]}\n{half[1]}\nshort"), (4, f"{half[0]}\nown d")])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: f"{one}\nown a\n{half[0]}\n\n{half[1]}", 2: "own b\nshort", 3: "own c\nshort", 4: f"{half[0]}\nown d"}


def plain_clauses(text):
    """(words with the white space before each, number of the clause of each)."""
    parts = re.findall(sentence_dedup.PIECE, text or "")
    number, out = -1, []
    for k, x in enumerate(parts):
        number += k == 0 or "\n" in x[: len(x) - len(x.lstrip(" \t\r\n\x0b\x0c"))] or parts[k - 1][-1] in sentence_dedup.ENDS
        out.append(number)
    return parts, out


def brute_spans(texts, least=sentence_dedup.LEAST_WORDS):
    """(n_words, n_removed, first_doc_id, text) of each document of distinct ids, in order."""
    seen, out = {}, {}
    for i in sorted(texts):
        parts, of = plain_clauses(texts[i])
        words, gone, first = [x.strip(" \t\r\n\x0b\x0c") for x in parts], set(), None
        for at in range(len(words)):
            if at and of[at] == of[at - 1] or at + least > len(words):
                continue
            end = at + least
            while end < len(words) and of[end] == of[end - 1]:
                end += 1
            holder = seen.setdefault(tuple(words[at:end]), (i, at))
            if holder != (i, at):
                gone |= set(range(at, end))
                first = holder[0] if first is None else min(first, holder[0])
        out[i] = (len(parts), len(gone), first, "".join(x for k, x in enumerate(parts) if k not in gone) if gone else texts[i] or "")
    return out


def removed(spark, texts, **options):
    return {r["doc_id"]: tuple(r)[1:4] + (r["text"],) for r in sentence_dedup.remove_repeated(documents(spark, list(texts.items())), **options).collect()}


def test_sentences(spark):
    rng = random.Random(6)
    own = [" ".join(sentence(rng) for _ in range(4)) for _ in range(20)]
    clause = lambda n: ", ".join(" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(n // 6)).capitalize()
    # 54 words in 1 to 4 sentences, and 60 letters without spaces between them
    passages = [". ".join(clause(54 // 6 // k * 6 + 6 * (i < 9 % k)) for i in range(k)) + "." for k in (1, 2, 3, 4)]
    passages += ["".join(chr(0x4E00 + rng.randrange(5000)) + "。" * (k % 9 == 8) for k in range(60))]
    first = {k: f"{own[k]} {p} {own[k + 5]}" for k, p in enumerate(passages)}
    # glued to other words at both ends
    later = {10 + k: f"{own[k + 10]} Kax lox {p[:-1]} miy y{k}. {own[k + 15]}" for k, p in enumerate(passages)}
    # lines of boilerplate that many share are short: they stay
    notice = {30 + k: f"{sentence(rng, 40)}\n{WORDS[0]} same notice. {WORDS[1]} in each." for k in range(3)}
    got = removed(spark, first | later | notice)
    for k in range(5):
        assert got[k][1:] == (0, None, first[k])
        assert 25 <= got[10 + k][1] <= 66 and got[10 + k][2] == k and got[10 + k][3].startswith(f"{own[k + 10]} Kax lox") and got[10 + k][3].endswith(own[k + 15])
    assert all(got[i][1:] == (0, None, t) for i, t in notice.items())


@pytest.mark.parametrize("block", [60, 1 << 20])
def test_spans_brute(spark, block, monkeypatch):
    monkeypatch.setattr(textvec, "BLOCK", block)
    rng = random.Random(8)
    alphabet = ["a", "b", "as", "b.", "c,", "中", "。", "é", "ß:"]
    texts = {i: "".join(rng.choice(alphabet) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(40))) for i in range(80)}
    texts |= {100: None, 101: "", 102: " \n", 103: "a " * 40, 104: "中" * 300, 105: "a " * 40, 200: texts[7] + texts[9]}
    docs = documents(spark, list(texts.items()))
    if block == 60:  # in this process: Python workers have the block of the module
        spans = sentence_dedup.Spans([(t or "").encode() for t in texts.values()], 5)
        monkeypatch.setattr(textvec, "BLOCK", 1 << 20)
        whole = sentence_dedup.Spans([(t or "").encode() for t in texts.values()], 5)
        assert all((getattr(spans, k) == getattr(whole, k)).all() for k in ("text", "at", "end", "a", "b", "clauses")) and spans.words == whole.words
        return
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["first_doc_id"], r["text"]) for r in sentence_dedup.remove_repeated(docs, 5).collect()}
    assert got == brute_spans(texts, 5)


def test_spans_brute_tables(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = sentence_dedup.remove_repeated(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["first_doc_id"], r["text"]) for r in got} == brute_spans(texts)


@pytest.mark.parametrize("texts", [ODD, []], ids=["odd", "empty"])
def test_spans_odd(spark, texts):
    got = sentence_dedup.remove_repeated(documents(spark, texts)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted((str(i), t or "") for i, t in texts)


def test_warc_round_trip_and_audit(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>\r\n\r\nWARC/1.0\r\nfake"), (2, None, ""), (3, "u\r\nv", None), (None, "http://n/", "n"), (90, "http://z/é", "é\r\n\r\n"), (200, "w", "中" * 5000), (200, "w", "again")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, idx string")
    ours = warc.records(pages)
    warc.write_warc(ours.repartition(2), f"file://{tmp_path}/w")
    back = warc.read_warc(spark, f"file://{tmp_path}/w")
    assert sorted((str(r["page_id"]), str(r["url"]), str(r["html"])) for r in back.collect()) == sorted(tuple(map(str, r)) for r in rows)
    assert back.where("NOT sound").count() == 0
    a, b, _ = warc.trees(ours, back, fanout=4)
    assert a.root() == b.root() and warc.audit(a, b).count() == 0
    broken = back.where("page_id IS NULL OR page_id != 2").withColumn("record", F.when(F.col("page_id") == 90, F.concat("record", F.lit(b"!"))).otherwise(F.col("record")))
    broken = broken.unionByName(back.where("page_id = 1").withColumn("page_id", F.lit(7).cast("long")))
    a, b, zero = warc.trees(ours, broken, fanout=4)
    assert {(r["idx"] + zero, r["state"]) for r in warc.audit(a, b).collect()} == {(2, "missing"), (90, "corrupt"), (7, "extra")}
    spans = sorted((r["start"], r["bytes"]) for r in a.ranges().collect())
    assert all(x[0] + x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[0][0] == 0
    none = warc.trees(ours.where("false"), back.where("false"))
    assert warc.audit(*none[:2]).count() == 0 and none[0].root() is None


def test_warc_foreign(spark, tmp_path):
    """Files of other writers: a gzip member for each record, blocks with marks and any bytes, other fields; broken ones are passed over."""
    import gzip

    blocks = [b"\x00\xff\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nabcde", b"", b"plain"]
    raw = [b"WARC/1.1\r\nContent-Length: %d\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Target-URI: http://x/\r\n\r\n%b\r\n\r\n" % (len(x), i, x) for i, x in enumerate(blocks)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    (tmp_path / "w/b.warc").write_bytes(raw[2].replace(b": 5", b": 7") + raw[0])
    (tmp_path / "w/c.warc").write_bytes(b"")
    got = [(r["page_id"], bytes(r["record"]).split(b"\r\n\r\n", 1)[1], r["sound"]) for r in warc.read_warc(spark, f"file://{tmp_path}/w").collect()]
    good = [(i, x, True) for i, x in enumerate(blocks)]
    assert sorted(x for x in got if x[2]) == sorted([*good, good[0]]) and [x[0] for x in got if not x[2]] == [2]
    assert list(warc.parse(raw[0] + raw[1])) == [(x.split(b"\r\n\r\n", 1)[0], y, True) for x, y in zip(raw, blocks[:2])]
    with pytest.raises(Exception, match="too large"):
        warc.read_warc(spark, f"file://{tmp_path}/w", 20).count()


def test_proximity(spark):
    docs = documents(spark, [(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "gamma beta alpha")])
    terms = decontaminate.item_terms(spark.createDataFrame([(1, "Alpha BETA gamma")], "item_id long, text string"))
    index = decontaminate.PositionalIndex(docs, terms.select(F.col("word").alias("term")))
    assert {r["doc_id"] for r in index.near(terms, 6).join(index.documents(), "row").collect()} == {1, 3}


def test_url_rules(spark):
    urls = [(1, "http://A.example.ORG/en/12?x"), (2, "https://example.org/es/"), (3, "https://notexample.org/es/"), (4, "x.com/de/"), (5, None), (6, "http://m.com/de/1"), (7, "http://org"), (8, "http://a.com/fr/?://b.org/")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, spark.createDataFrame([], "key long, bad int")).collect()}
    assert got == {1: ("a.example.org", "/en/12", "example.org/en/1", "block"), 2: ("example.org", "/es/", "example.org/es/", "block"), 3: ("notexample.org", "/es/", "org/", "allow"), 4: ("", "", None, "allow"),
                   5: ("", "", None, "allow"), 6: ("m.com", "/de/1", "com/de/", "block"), 7: ("org", "", None, "allow"), 8: ("a.com", "/fr/", "com/fr/", "allow")}


def test_reputation(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 40 else 'good'}.site.net/p{i}") for i in range(100)] + [(200, "http://new.site.net/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 40)) for i in range(100)] + [(1, None), (None, 1)], "key long, bad int")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(pages, outcomes).collect()}
    assert got == {"bad.site.net": "block", "good.site.net": "allow", "new.site.net": "allow"}
    assert url_filter.judge(pages.where("false"), outcomes).count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (None, "http://a.net/en/7", "y"), (2, "http://a.net/en/99999999999999999999", "z"), (2, "http://a.net/en/7", "z")], "page_id long, url string, host string")
    got = url_filter.judge(odd, spark.createDataFrame([(7, 1), (7, 0)], "key long, bad int"), key=url_filter.shown).collect()
    assert sorted((str(r["page_id"]), r["host"]) for r in got) == [("1", ""), ("2", "a.net"), ("2", "a.net"), ("None", "a.net")]


def test_reputation_sql(spark, tmp_path):
    """The query against its SQL on tables whose hosts differ: the method blocks hosts, and all but its own pages."""
    rng = random.Random(5)
    pages = [(i, f"http://{'worse' if i % 3 else 'fine'}{i % 5}.{'a.net' if i % 2 else 'b.info'}/en/{1000 + i}?q={i}", "") for i in range(400)]
    labels = [(1000 + i, int(rng.random() > (0.97 if i % 3 else 0.03)), 0) for i in range(0, 400, 2)] + [(1000 + i, 1, int(i % 3 > 0)) for i in range(1, 400, 2)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT page_id, host, verdict FROM ({url_filter.OP10_SQL})").fetchall())
    got = sorted((r["page_id"], r["host"], r["verdict"]) for r in QUERIES["op10_url_filters"](spark, f"file://{tmp_path}").collect())
    assert got == want and {v for _, h, v in got if h.startswith("fine")} == {"allow"} and {v for _, h, v in got if h.startswith("worse")} == {"block"}


def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets):
    least = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def near_texts(seed, n=150):
    rng = random.Random(seed)
    bases = [[rng.choice(WORDS) for _ in range(rng.choice([3, 8, 40, 60, 90]))] for _ in range(12)]
    common = [rng.choice(WORDS) for _ in range(30)]
    texts = {}
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        if rng.random() < 0.2:
            w = w[: rng.randrange(1, len(w) + 1)] + common
        texts[i] = rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", " \n"]).join(x.upper() if rng.random() < 0.3 else x for x in w)
    return texts | {200: None, 201: "", 202: "É é", 203: "é É"}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_brute(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)  # tiles in several blocks
    texts = near_texts(seed)
    sets = brute_sets(texts)
    want = brute_components(sets)
    docs = documents(spark, list(texts.items()))
    got = jaccard.similar(docs).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in got} == {i: (want[i], len(sets[i])) for i in texts}
    first = {}
    for i, s in sets.items():
        if s:
            first.setdefault(s, i)
    pairs = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and 100 * len(s & t) >= 75 * len(s | t)}
    assert {(r["a"], r["b"]) for r in jaccard.links(docs).collect()} == pairs and len(pairs) > 20


def test_jaccard_brute_table(spark):
    """All documents of a table, with the shingles that two documents share as candidates."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = brute_sets({r["doc_id"]: r["text"] for r in docs.collect()})
    want = brute_components(sets)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.similar(docs).collect()} == {i: (want[i], len(sets[i])) for i in sets}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    least = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert sorted((r["node"], r["component"]) for r in got) == sorted((k, v) for k, v in least.items() if k not in loops)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(textvec, "BLOCK", 50)
    rng = random.Random(4)
    texts = [b"".join(rng.choice([b"a", b"bc", b" ", b"\n", "é".encode()]) for _ in range(rng.randrange(120))) for _ in range(200)]
    known = {}
    for raw, got in zip(texts, textvec.word_hashes(texts), strict=True):
        words = raw.split()
        assert len(words) == len(got)
        for w, h in zip(words, got, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_packing_round_trip(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    alphabet = [" ", "  ", "a", "b.", "\n", "\t", "\xa0", "é", "12", "'s", "X", "!!", "　", "中", "\r\n", "\x85", "<|endoftext|>", "<|endof", "​", "́", "²"]
    texts = {i: "".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for i in range(300)} | {500: None, 501: "word " * 5000, 502: " " * 70_000, 503: "a <|endoftext|> b"}
    texts |= {1000 + r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()}
    pieces, whole = {}, {}
    at = 0
    packed = packing.pack(documents(spark, list(texts.items())))
    for r in sorted(packed.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 1024 + r["offset"] == at and r["offset"] + r["length"] <= 1024 and r["length"] > 0
        at += r["length"]
        pieces.setdefault(r["doc_id"], []).append(r)
        whole[r["sequence_id"]] = whole.get(r["sequence_id"], b"") + r["ids"]
    for i, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        begin = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (begin, len(ids))
            assert r["ids"] == np.asarray(ids[begin : begin + r["length"]], dtype="<u4").tobytes()
            begin += r["length"]
        assert begin == len(ids)
    assert t.encode(texts[503], add_special_tokens=False).ids[2] == 50256
    got = {r["sequence_id"]: (r["n_tokens"], bytes(r["ids"])) for r in packing.sequences(packed).collect()}
    assert got == {k: (len(x) // 4, x.ljust(4096, b"\0")) for k, x in whole.items()}


def test_packing_query(spark, sf_dir):
    rows = QUERIES["op9_packing"](spark, sf_dir)
    ids = {(r["doc_id"], r["start"]): zlib.crc32(r["ids"]) for r in packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert {(r["doc_id"], r["start"]): r["ids_crc32"] for r in rows.collect()} == ids


def test_language_counts(monkeypatch):
    """Whole texts in blocks: each run counts once, wherever blocks begin."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abé ,B\n中") for _ in range(n)) for n in (0, 1, 2, 3, 7, 50, 200, 1000)]
    whole = [language.counts(t) for t in texts]
    for block in (1, 4, 37):
        monkeypatch.setattr(language, "_BLOCK", block)
        assert all((language.counts(t) == x).all() for t, x in zip(texts, whole, strict=True))
    assert language.counts("a" * 300_000).max() > 65535


def test_language_forward():
    """Labels and probabilities against a plain computation from the model's numbers; texts without letters are undetermined."""
    rng = np.random.default_rng(1)
    texts = ["the cat sat on the mat", "der hund und die katze", "le chat est sur la table"] * 6
    rows = []
    for i, t in enumerate(texts):
        c = language.counts(t)
        rows.append((np.flatnonzero(c), c[np.flatnonzero(c)].astype(float), i % 3))
    model = language.LanguageModel(["en", "de", "fr"]).fit([rows[i] for i in rng.permutation(len(rows))], epochs=30)
    for t in texts[:3] + ["katze chat"]:
        total, n = np.zeros(language.WIDTH), 0
        for k, c in enumerate(language.counts(t)):
            total, n = total + c * model.emb[k], n + c
        z = ((total / n) @ model.out + model.bias) / model.temperature
        p = np.exp(z) / np.exp(z).sum()
        assert model.predict(t)[0] == ["en", "de", "fr"][int(p.argmax())] and abs(model.predict(t)[1] - p.max()) < 1e-9
    assert [model.predict(t)[0] for t in texts[:3]] == ["en", "de", "fr"]
    for t in (None, "", "½ ² ①", "12 _ !", "\u0301", "Ⅷ"):
        assert model.predict(t) == ("und", 0.0)
    assert model.predict("ª")[0] != "und" and model.predict("ʰ")[0] != "und" and model.predict("中")[0] != "und"


def test_quality_forward(spark, monkeypatch):
    """Scores against a plain computation, passage by passage; a long text in blocks."""
    model = quality.AttentionModel()
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (1, 64, 65, 300)] + [""]
    w = model.w
    for t in texts:
        z, total = np.zeros(quality.WIDTH), 0.0
        for x in quality.passages(t):
            h = np.tanh(x @ w["E"] + w["e"])
            a = np.exp(sum(np.tanh(h @ w["V"][:, k]) / (1 + np.exp(-(h @ w["U"][:, k]))) * w["a"][k] for k in range(quality.ATTENTION)))
            z, total = z + a * h, total + a
        want = 1 / (1 + np.exp(-((z / total) @ w["o"] + w["b"][0])))
        assert abs(model.score([quality.passages(t)])[0] - want) < 1e-6
    got = quality.scored(documents(spark, list(enumerate(texts))), model).collect()
    assert np.allclose([r["_score"] for r in sorted(got, key=lambda r: r["doc_id"])], [model.score([quality.passages(t)])[0] for t in texts])
    monkeypatch.setattr(quality, "_BLOCK", 64 * 4 * 3)
    assert len(quality.passages("abc " * 64 * 30)) >= 30


def test_classifiers_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_quality_classifier"](spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op8_language_id"](spark, d).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) > 0.97


def test_pipeline(spark):
    """Each stage against a plain version of it, on its own input."""
    sf_dir = "/root/testdata/sf0.01"
    import corpus_pipeline
    from tarn.llm.common import staged

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, text = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept, frames = [sorted(text)], []
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), "test-stage")
        frames.append(docs)
        kept.append(sorted({r["doc_id"] for r in docs.select("doc_id").collect()}))
    assert all(f.columns == columns for f in frames[:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = set(kept[0]) - set(kept[1])
    assert np.mean([(labels[i] == 0) == (i in gone) for i in labels]) > 0.95
    first = {}
    for i in kept[1]:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[i]), i)
    assert kept[2] == sorted(first.values())
    want = brute_components(brute_sets({i: text[i] for i in kept[2]}))
    assert kept[3] == sorted(set(want.values()))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda s: word.findall("".join(c.lower() if c.isascii() else c for c in s))
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in [lower(r["text"])] for k in range(max(1, len(w) - 9))}
    assert kept[4] == [i for i in kept[3] if not any(tuple(w[k : k + n]) in windows for w in [lower(text[i])] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))]
    assert kept[5] == kept[4]




def test_forest():
    rng = np.random.default_rng(2)
    for n, m in ((50, 30), (400, 500), (2000, 1500)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        least = np.arange(n)
        for _ in range(n):
            low = np.minimum(least[a], least[b])
            new = least.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            if (new == least).all():
                break
            least = new
        root, node = forest(a, b)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {i: int(x) for i, x in enumerate(least) if x != i}


def test_pipeline_odd(spark, tmp_path):
    """Null, repeated and clashing ids, empty tables and extra columns in every stage."""
    import corpus_pipeline
    from tarn.llm.common import staged

    stages = dict(corpus_pipeline.STAGES)
    item = "one two three four five six seven eight nine ten"
    near = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(1, item), (None, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(5, "same"), (5, "same"), (7, "same"), (None, "same"), (None, "alone"), (None, "alone"), (8, None), (8, ""), (9, near), (9, near + " v"), (None, near + " u"), (3, f"a {item} b"), (3, "clean words here"), (None, f"{item} c"), (4, "x" * 200_000)]
    docs = staged(documents(spark, rows), "odd")
    got = lambda name, docs: sorted((str(r["doc_id"]), r["text"]) for r in stages[name](spark, docs, f"file://{tmp_path}").collect())
    text = lambda *keep: sorted((str(i), t) for i, t in keep)
    copies = got("exact dedup", docs)
    one = [(5, "same"), (None, "alone"), (9, near), (9, near + " v"), (None, near + " u"), (3, f"a {item} b"), (3, "clean words here"), (None, f"{item} c"), (4, "x" * 200_000)]
    assert [x for x in copies if x[0] != "8"] == text(*one) and len(copies) == len(one) + 1
    unique = staged(documents(spark, one + [(8, "")]), "unique")
    assert got("n-gram Jaccard join", unique) in [sorted(text(*[x for x in one if not (x[1] or "").startswith(near)], (8, "")) + text(k)) for k in ((9, near), (9, near + " v"))]
    assert got("benchmark decontamination", unique) == text(*[x for x in one if item not in x[1]], (8, ""))
    kept = stages["quality classifier"](spark, docs, f"file://{tmp_path}")
    assert kept.columns == docs.columns and set(kept.collect()) <= set(docs.collect())
    pieces = stages["packing"](spark, docs, f"file://{tmp_path}").collect()
    assert sum(r["doc_tokens"] for r in pieces if r["start"] == 0) == sum(r["length"] for r in pieces) and sum(r["start"] == 0 for r in pieces) == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, staged(docs.where("false"), "none"), f"file://{tmp_path}").count() == 0
