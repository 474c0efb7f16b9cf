"""WARC records with a Merkle fixity audit of replicas."""

from __future__ import annotations

import base64
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm.common import new_path, staged, table

_BEGIN, _END = "WARC/1.0\r\n", "\r\n\r\n"

#: The date in records of pages that have none; most bytes of a file that is read.
DATE, LARGEST = "2024-01-01T00:00:00Z", 1 << 28

_FIELDS = "page_id long, url string, html string, record binary, sound boolean"


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record (binary): a WARC record of each page, without its closing blank lines.

    A page with a url is a resource, one without is metadata, as a resource must have one. A null id leaves its place in the record id
    empty, and fields of this module's own (X-) mark a null html, and hold in base64 a url with a line end. The block is the html as it is, of
    any length; repeated ids give a record each; other columns are unread; an empty table gives no records.
    """
    body, url = F.coalesce("html", F.lit("")), F.col("url")
    odd = url.rlike("[\r\n]")
    coded = F.regexp_replace(F.base64(url), "[\r\n]", "")
    head = F.concat(
        F.when(url.isNull(), _BEGIN + "WARC-Type: metadata\r\n").otherwise(_BEGIN + "WARC-Type: resource\r\n"),
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">\r\nWARC-Date: {date}\r\n"),
        F.when(url.isNull(), "").when(odd, F.concat(F.lit("WARC-Target-URI: urn:base64:"), coded, F.lit("\r\nX-Target-URI-Base64: "), coded, F.lit("\r\n"))).otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))),
        F.when(F.col("html").isNull(), "X-Block-Null: 1\r\n").otherwise(""),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(_END),
    )
    return pages.select("page_id", F.concat(head, body).cast("binary").alias("record"))


def write_warc(recs: DataFrame, path: str) -> None:
    """Write records as WARC files, one for each partition."""
    recs.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END).text(path)


def _members(data: bytes):
    """Parts of a file that hold whole records: each gzip member, or the rest as it is."""
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        member, out = zlib.decompressobj(31), []
        while not member.eof and at < len(data):
            piece = data[at : at + 65536]
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        yield b"".join(out)
    if at < len(data):
        yield data[at:]


def parse(data: bytes):
    """(head, block, sound) of each record: its block has as many bytes as the head says, whatever they are. After a record that is not sound, reading goes on at the next mark."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            yield data[at:], b"", False
            return
        head = data[at:end]
        length = re.search(rb"(?im)^Content-Length:[ \t]*([0-9]+)[ \t]*\r?$", head)
        size = int(length[1]) if length else 0
        block = data[end + 4 : end + 4 + size]
        sound = length is not None and len(block) == size and data[end + 4 + size : end + 8 + size] in (b"\r\n\r\n", b"")
        yield head, block, sound
        at = end + 8 + size if sound else end + 4


def _parsed(batches):
    def rows(kept):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*kept, strict=True), (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.bool_()), strict=True)], [x.split()[0] for x in _FIELDS.split(", ")])

    for batch in batches:
        kept, held = [], 0
        for content in batch.column(0):
            for part in _members(content.as_py()):
                for head, block, sound in parse(part):
                    text = head.decode("utf-8", "replace")
                    field = dict(x.split(": ", 1) for x in text.split("\r\n")[1:] if ": " in x)
                    number = re.search(r"<urn:page:(-?[0-9]+)>", field.get("WARC-Record-ID", ""))
                    coded = field.get("X-Target-URI-Base64")
                    url = field.get("WARC-Target-URI") if coded is None else base64.b64decode(coded).decode("utf-8", "replace")
                    html = None if field.get("X-Block-Null") == "1" else block.decode("utf-8", "replace")
                    kept.append((number and int(number[1]), url, html, head + b"\r\n\r\n" + block, sound))
                    held += 2 * len(block)
                    if held > 1 << 24:
                        yield rows(kept)
                        kept, held = [], 0
        if kept:
            yield rows(kept)


def read_warc(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """page_id, url, html, record, sound (the block has the declared length), of plain or gzip WARC files.

    Blocks are read by their length, so a block may hold any bytes, also marks of records. A file is read as one row, so a
    larger one than `largest` bytes is refused with an error, not cut. Record ids of other kinds have no page_id; an empty file has no records.
    """
    files = spark.read.format("binaryFile").load(path).select(F.when(F.col("length") > largest, F.raise_error(F.concat(F.lit("too large: "), "path")).cast("binary")).otherwise(F.col("content")).alias("content"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    return files.mapInArrow(_parsed, _FIELDS)


class MerkleTree:
    """Hashes of records in order of their key, and of ordered ranges of them: level 0 has a node for each key, each node above covers `fanout` times as many keys.

    A node has a range of byte offsets (start, bytes) in the archive in key order. Records of one key, or of none (a null
    key counts as base - 1, the first), are hashed as a multiset by sums of their digests, so a key that holds a third of
    all rows is summed before the shuffle. An empty table has no nodes.
    """

    def __init__(self, recs: DataFrame, base: int, height: int, fanout: int = 64):
        self.fanout, self.levels = fanout, []
        digest = F.sha2("record", 256)
        part = recs.select((F.coalesce("page_id", F.lit(base - 1)) - (base - 1)).cast("long").alias("idx"), digest.alias("d"), (F.octet_length("record") + len(_END)).cast("long").alias("size"))
        sums = [F.sum(F.conv(F.substring("d", 1 + 14 * k, 14), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
        leaf = part.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums), 256).alias("hash"))
        self.levels.append(staged(leaf, "merkle-0"))
        for k in range(1, height + 1):
            below = self.levels[-1].withColumn("up", F.expr(f"idx div {fanout}"))
            sons = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: F.concat(x.idx.cast("string"), F.lit(":"), x.hash))
            self.levels.append(staged(below.groupBy(F.col("up").alias("idx")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws(",", sons), 256).alias("hash")), f"merkle-{k}"))

    def root(self) -> str | None:
        top = self.levels[-1].head()
        return top and top["hash"]

    def ranges(self) -> DataFrame:
        """The leaves with their first byte's offset: prefix sums among at most `fanout` brothers, handed down from the root."""
        at = self.levels[-1].select("idx", F.lit(0).cast("long").alias("start"), "bytes")
        before = F.coalesce(F.sum("bytes").over(W.partitionBy("up").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        for level in self.levels[-2::-1]:
            sons = level.select("idx", "bytes", F.expr(f"idx div {self.fanout}").alias("up"))
            at = sons.withColumn("before", before).join(at.select(F.col("idx").alias("up"), F.col("start").alias("from")), "up").select("idx", (F.col("from") + F.col("before")).alias("start"), "bytes")
        return at


def trees(a: DataFrame, b: DataFrame, fanout: int = 64) -> tuple[MerkleTree, MerkleTree, int]:
    """Trees of two replicas (page_id, record) over one range of keys, and the key of index 0."""
    ends = [df.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).head() for df in (a, b)]
    low = min((x["low"] for x in ends if x["low"] is not None), default=0)
    high = max((x["high"] for x in ends if x["high"] is not None), default=0)
    height = 1
    while fanout**height <= high - low + 1:
        height += 1
    return MerkleTree(a, low, height, fanout), MerkleTree(b, low, height, fanout), low - 1


def audit(a: MerkleTree, b: MerkleTree) -> DataFrame:
    """Leaves that differ: idx, state (corrupt, missing in b, extra in b). Compares roots first and descends only into branches that differ."""
    bad = None
    for x, y in zip(a.levels[::-1], b.levels[::-1], strict=True):
        if bad is not None:
            up = F.expr(f"idx div {a.fanout}")
            x, y = (z.join(bad.select(F.col("idx").alias("up")), up == F.col("up"), "left_semi") for z in (x, y))
        x, y = x.select("idx", F.col("hash").alias("ours")), y.select("idx", F.col("hash").alias("theirs"))
        bad = staged(x.join(y, "idx", "full").where("NOT ours <=> theirs"), "merkle-bad")
    state = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("corrupt")
    return bad.select("idx", state.alias("state"))


def damaged(recs: DataFrame) -> DataFrame:
    """A replica with faults: of page ids, each 101st is lost from 7 on, and each 97th from 5 on has a wrong last byte."""
    wrong = F.concat(F.expr("substring(record, 1, octet_length(record) - 1)"), F.lit(b"\x00"))
    return recs.where(F.coalesce(F.col("page_id") % 101 != 7, F.lit(True))).withColumn("record", F.when(F.col("page_id") % 97 == 5, wrong).otherwise(F.col("record")))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC files, read this replica back, damage it, audit it against the pages; a row for each page."""
    ours = records(table(spark, sf_dir, "pages"))
    path = new_path(spark, "warc")
    write_warc(ours, path)
    a, b, zero = trees(ours, damaged(read_warc(spark, path).where("sound").select("page_id", "record")))
    bad = audit(a, b)
    leaves = a.ranges().join(bad, "idx", "left").select("idx", "start", "state")
    rows = ours.select("page_id", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"), (F.coalesce("page_id", F.lit(zero)) - zero).cast("long").alias("idx"))
    return rows.join(leaves, "idx").select("page_id", F.col("start").alias("record_offset"), "record_bytes", "record_sha256", F.coalesce("state", F.lit("intact")).alias("state"))


OP5_SQL = rf"""
WITH e AS (SELECT chr(13) || chr(10) AS nl), r AS (
  SELECT page_id, 'WARC/1.0' || nl || CASE WHEN url IS NULL THEN 'WARC-Type: metadata' ELSE 'WARC-Type: resource' END || nl || 'WARC-Record-ID: <urn:page:' || CAST(page_id AS VARCHAR) || '>' || nl
    || 'WARC-Date: {DATE}' || nl || coalesce('WARC-Target-URI: ' || url || nl, '') || CASE WHEN html IS NULL THEN 'X-Block-Null: 1' || nl ELSE '' END
    || 'Content-Type: text/html' || nl || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || nl || nl || coalesce(html, '') AS rec
  FROM pages, e
)
SELECT page_id, CAST(sum(strlen(rec) + 4) OVER (ORDER BY page_id) - strlen(rec) - 4 AS BIGINT) AS record_offset, CAST(strlen(rec) AS BIGINT) AS record_bytes, sha256(rec) AS record_sha256,
  CASE WHEN page_id % 101 = 7 THEN 'missing' WHEN page_id % 97 = 5 THEN 'corrupt' ELSE 'intact' END AS state
FROM r
"""
