"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import bit_filter, filter_bits, hits, small_batches, staged, table, text_of
from tarn.llm.components import components
from tarn.llm.textvec import mix, shingle_set, shingles, word_hashes

#: Words in a shingle; least similarity in hundredths.
SHINGLE, LEAST = 5, 75
#: Counters of how often shingles and words occur, and the slices in which they are summed up; bits of a signature, and at most of a long one.
COUNTERS, SLICES, BITS, LONG = 1 << 20, 256, 1024, 1 << 17
#: Postings that a worker holds before it passes them on, and that one task of the next stage is to get.
HELD, PER_TASK = 1_000_000, 1_000_000
#: Sets of a tile that are compared in one block; tiles of a set that are known to each of its rows; pairs looked at at once.
BLOCK, HEADS, AT_ONCE = 512, 8, 1 << 16


def _words(texts: list[str | None]):
    return word_hashes([(x or "").encode("utf-8", "surrogatepass").lower() for x in texts])


def _sets(texts: list[str | None]):
    return (shingle_set(w, SHINGLE) for w in _words(texts))


def _counter(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(44)).astype(np.int64)


def _name(s: np.ndarray) -> int:
    """A hash of a whole set; never of an empty one."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signature(s: np.ndarray, size: int = BITS) -> bytes:
    bits = np.zeros(size, dtype=bool)
    bits[(s >> np.uint64(20)) % np.uint64(size)] = True
    return np.packbits(bits).tobytes()


def _long_signature(s: np.ndarray) -> bytes | None:
    """Two bits or more for each shingle, where that is more than BITS: a short signature of a long text is full."""
    size = min(LONG, 1 << (2 * len(s) - 1).bit_length())
    return _signature(s, size) if size > BITS else None


def _measure(batches):
    """(row, doc_id, text) -> a row for each document, then the counters of the partition, of shingles and of words, in slices."""
    counters = np.zeros((2, COUNTERS), dtype=np.int64)
    names = ["row", "doc_id", "n", "s", "sign", "long_sign", "slice", "counters"]
    for batch in batches:
        n, s, sign, long_sign, all_sets, all_words = [], [], [], [], [], []
        for w in _words(batch.column(2).to_pylist()):
            x = shingle_set(w, SHINGLE)
            n.append(len(x))
            s.append(_name(x) if len(x) else None)
            sign.append(_signature(x) if len(x) else None)
            long_sign.append(_long_signature(x) if len(x) else None)
            all_sets.append(x)
            all_words.append(w)
        for k, parts in enumerate((all_sets, all_words)):
            counters[k] += np.bincount(_counter(np.concatenate(parts)), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(sign, pa.binary()), pa.array(long_sign, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
    if counters.any():
        yield pa.RecordBatch.from_arrays([*[pa.nulls(SLICES, pa.int64())] * 4, *[pa.nulls(SLICES, pa.binary())] * 2, pa.array(range(SLICES), pa.int32()), pa.array([_packed(x) for x in np.split(counters, SLICES, axis=1)], pa.binary())], names)


def _packed(counters: np.ndarray) -> bytes:
    return zlib.compress(counters.astype("<i8").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), "<i8").reshape(2, COUNTERS // SLICES)


def _add_counters(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            total[k] = total[k] + _unpacked(x) if k in total else _unpacked(x)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(x) for x in total.values()], pa.binary())], ["slice", "counters"])


def _ranks(measured: DataFrame) -> np.ndarray:
    """How much each counter of shingles stands out, and how common the words of each counter are: 2 * COUNTERS bytes, whatever the input. Each slice is summed up in one task."""
    parts = measured.where("counters IS NOT NULL").select("slice", "counters")
    total = np.zeros((2, COUNTERS), dtype=np.int64)
    width = COUNTERS // SLICES
    for r in parts.repartition("slice").mapInArrow(_add_counters, "slice int, counters binary").collect():
        total[:, r["slice"] * width : (r["slice"] + 1) * width] = _unpacked(r["counters"])
    mean = max(1.0, total[0].mean())
    out = np.clip(np.floor(4 * np.log2(np.maximum(total[0], 1) / mean)), 0, 31)
    return np.stack([out, np.clip(np.round(3 * np.log2(total[1] + 1)), 0, 200)]).astype(np.uint8)


def _rarest(w: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, its first shingles in an order that is the same for all documents): those that don't stand out as frequent, then of rarer words, then by hash.

    Sets of similarity t share t of the larger one at least, so one of the first n - t * n + 1 of each is common.
    """
    all_of = shingles(w, SHINGLE)
    x, at = np.unique(all_of, return_index=True)
    n = len(x)
    most = n - -(-LEAST * n // 100) + 1
    if most >= n:
        return x, x
    common = ranks[1][_counter(w)].astype(np.uint64)
    size = min(SHINGLE, len(w))
    total = common[: len(all_of)].copy()
    for i in range(1, size):
        total += common[i : len(all_of) + i]
    key = (ranks[0][_counter(x)].astype(np.uint64) << np.uint64(59)) | (total[at] << np.uint64(49)) | (x >> np.uint64(15))
    return x, x[np.argpartition(key, most - 1)[:most]]


_POSTING = np.dtype([("h", "<u8"), ("s", "<i8"), ("n", "<u4")])
_MEMBER = np.dtype([("h", "<u8"), ("s", "<i8"), ("n", "<u4"), ("hub", "<i8"), ("hub_n", "<u4"), ("next", "<i8"), ("next_n", "<u4")])


def _hang(p: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of postings: (members, hubs). In the tile of a shingle, the sets of a band of sizes hang on the smallest of them, and each on a neighbour in one of
    four orders by hash as well. The hubs go on to meet those of other workers; at the last meeting, hubs of other bands hang on that of the tile's least band, so that a tile stays together."""
    if not len(p):
        return np.empty(0, _MEMBER), p
    p = p[np.argsort(p["h"], kind="stable")]
    same = p["h"][1:] == p["h"][:-1]
    many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    alone, p = p[~many], p[many]  # most shingles are in one set only
    p = p[np.lexsort((p["s"], p["n"], p["h"]))]
    p = p[np.concatenate([[True], (p["h"][1:] != p["h"][:-1]) | (p["s"][1:] != p["s"][:-1])])[: len(p)]]
    if not len(p):
        return np.empty(0, _MEMBER), alone
    band = np.floor(np.log(p["n"]) / np.log(100 / LEAST)).astype(np.int64)
    new_tile = np.concatenate([[True], p["h"][1:] != p["h"][:-1]])
    new_band = new_tile | np.concatenate([[True], band[1:] != band[:-1]])
    first = np.maximum.accumulate(np.where(new_band, np.arange(len(p)), 0))
    tile = np.maximum.accumulate(np.where(new_tile, np.arange(len(p)), 0))
    hub = np.where(new_band, tile, first)
    order = np.lexsort((mix(p["s"].view("<u8") + (p["h"] & np.uint64(3))), first))
    after = hub.copy()
    follows = first[order[1:]] == first[order[:-1]]
    after[order[:-1][follows]] = order[1:][follows]
    hung = np.flatnonzero(~(new_tile if last else new_band))
    out = np.empty(len(hung), _MEMBER)
    for k in ("h", "s", "n"):
        out[k] = p[k][hung]
    for k, at in (("hub", hub), ("next", after)):
        out[k], out[f"{k}_n"] = p["s"][at[hung]], p["n"][at[hung]]
    return out, np.concatenate([alone, p[new_band]])


def _postings(rank, bucket_bits: int):
    """(text) -> packed postings of the rarest shingles of each set, enough that two similar sets share one; dealt by shingle."""

    def run(batches):
        order, held, count = rank.value, [], 0

        def flush():
            nonlocal held, count
            members, hubs = _hang(np.concatenate(held)) if held else (np.empty(0, _MEMBER), np.empty(0, _POSTING))
            held, count = [], 0
            rows = {}
            for kind, x in enumerate((hubs, members)):
                if not len(x):
                    continue
                at = (x["h"] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(x), dtype=np.int64)
                by = np.argsort(at, kind="stable")
                x, at = x[by], at[by]
                low = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                for a, b in zip(low, [*low[1:], len(x)], strict=True):
                    rows.setdefault(int(at[a]), [b"", b""])[kind] = x[a:b].tobytes()
            k = sorted(rows)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([rows[i][0] for i in k], pa.binary()), pa.array([rows[i][1] for i in k], pa.binary())], ["bucket", "hubs", "members"])

        for batch in batches:
            for w in _words(batch.column(0).to_pylist()):
                if len(w):
                    x, first = _rarest(w, order)
                    p = np.empty(len(first), _POSTING)
                    p["h"], p["s"], p["n"] = first, _name(x), len(x)
                    held.append(p)
                    count += len(p)
                    if count >= HELD:
                        yield flush()
        if held:
            yield flush()

    return run


_MEMBERS = "h long, s long, n long, hub long, hub_n long, next long, next_n long"


def _meet(batches):
    """All packed rows of a task: members, and what hangs together of the hubs."""
    hubs, members = [], []
    for batch in batches:
        hubs += [np.frombuffer(x.as_py(), _POSTING) for x in batch.column(1)]
        members += [np.frombuffer(x.as_py(), _MEMBER) for x in batch.column(2)]
    if hubs:
        more, _ = _hang(np.concatenate(hubs), last=True)
        out = np.concatenate([*members, more])
        for at in range(0, len(out), 200_000):
            x = out[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[k].view("<i8") if k == "h" else x[k].astype("<i8")) for k in _MEMBER.names], list(_MEMBER.names))


def _needed(bits):
    """(row, text) -> the names and the items of the sets of rows that the filter lets through."""

    def run(batches):
        for batch in batches:
            at = pa.array(np.flatnonzero(hits(bits.value, batch.column(0).to_numpy())))
            sets = [x for x in _sets(batch.column(1).take(at).to_pylist()) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["s", "items"])

    return run


def _enough(na: np.ndarray, nb: np.ndarray, common) -> np.ndarray:
    """100 * common >= LEAST * (na + nb - common)."""
    return (100 + LEAST) * common >= LEAST * (na + nb)


def _bound(na, nb, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most common shingles that the signatures allow: each bit that only one side has is a shingle that the other lacks."""
    only_a = np.bitwise_count(a & ~b).sum(axis=1).astype(np.int64)
    only_b = np.bitwise_count(b & ~a).sum(axis=1).astype(np.int64)
    return np.minimum(na - only_a, nb - only_b)


def _folded(raw: bytes, size: int) -> np.ndarray:
    """The signature of the same set in `size` bytes, a power of two."""
    return np.bitwise_or.reduce(np.frombuffer(raw, "<u8").reshape(-1, size // 8), axis=0)


def _allowed(batches):
    """(na, nb, signature of a, of b, others) -> the others of the pairs that the signatures allow."""
    for batch in batches:
        na, nb = (batch.column(k).to_numpy() for k in (0, 1))
        signs = [batch.column(k).to_pylist() for k in (2, 3)]
        size = np.array([min(len(x), len(y)) for x, y in zip(*signs, strict=True)], dtype=np.int64)
        ok = np.zeros(len(na), dtype=bool)
        for k in np.unique(size):
            at = np.flatnonzero(size == k)
            a, b = (np.stack([_folded(x[i], int(k)) for i in at]) for x in signs)
            ok[at] = _enough(na[at], nb[at], _bound(na[at], nb[at], a, b))
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([x.take(keep) for x in batch.columns[4:]], batch.schema.names[4:])


def _exact(batches):
    """(items of a, items of b, others) -> the others of the similar pairs."""
    for batch in batches:
        keep = []
        for k, (x, y) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
            x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if _enough(len(x), len(y), common):
                keep.append(k)
        yield pa.RecordBatch.from_arrays([x.take(pa.array(keep, pa.int64())) for x in batch.columns[2:]], batch.schema.names[2:])


_PART = ["h", "cell", "part", "side", "own", "s", "n", "comp"]
_PAIR = ["a", "b", "na", "nb", "ca", "cb"]


def _within(batches):
    """Sorted rows (_PART, sign, heads) -> _PAIR: pairs in one part of a tile that no link joins yet and whose sizes and signatures allow one.

    Rows of side 0 meet those of side 1, rows of side 2 meet each other; two copies from the band below (`own` is 0) met there. `heads` are a
    set's first tiles in order of h: a pair that shares one of them before this tile was made there and isn't made again.
    """
    rest = None

    def pairs(x, sign, heads):
        change = np.concatenate([[True], (x["h"][1:] != x["h"][:-1]) | (x["cell"][1:] != x["cell"][:-1]) | (x["part"][1:] != x["part"][:-1]), [True]])
        start = np.flatnonzero(change)
        group = np.cumsum(change[:-1]) - 1
        end = start[group + 1]
        ones = np.cumsum(np.concatenate([[0], x["side"] == 1]))
        # side 0: the rows of side 1, which end its part; side 2: the rows after it
        low = np.where(x["side"] == 0, end - (ones[end] - ones[start[group]]), np.arange(len(end)) + 1)
        count = np.where(x["side"] == 1, 0, end - low)
        total = np.concatenate([[0], np.cumsum(count)])
        out = [np.empty((len(_PAIR), 0), dtype=np.int64)]
        at = 0
        while at < len(count):
            to = max(at + 1, int(np.searchsorted(total, total[at] + AT_ONCE, side="right")) - 1)
            i = np.repeat(np.arange(at, to), count[at:to])
            j = np.arange(total[at], total[to]) - np.repeat(total[at:to] - low[at:to], count[at:to])
            at = to
            ok = (x["comp"][i] != x["comp"][j]) & (x["own"][i] + x["own"][j] > 0) & (100 * np.minimum(x["n"][i], x["n"][j]) >= LEAST * np.maximum(x["n"][i], x["n"][j]))
            i, j = i[ok], j[ok]
            ok = _enough(x["n"][i], x["n"][j], _bound(x["n"][i], x["n"][j], sign[i], sign[j]))
            i, j = i[ok], j[ok]
            met = (heads[i][:, :, None] == heads[j][:, None, :]).any(axis=2) & (heads[i] < x["h"][i][:, None])
            first = ~met.any(axis=1)
            i, j = i[first], j[first]
            swap = x["s"][i] > x["s"][j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            out.append(np.stack([x[k][v] for k in ("s", "n", "comp") for v in (i, j)]))
        return np.concatenate(out, axis=1)

    def emit(x, sign, heads, cut):
        got = pairs({c: v[:cut] for c, v in x.items()}, sign[:cut], heads[:cut])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in got], _PAIR)

    for batch in batches:
        x = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(_PART)}
        sign = np.frombuffer(b"".join(batch.column(len(_PART)).to_pylist()), "<u8").reshape(-1, BITS // 64)
        heads = batch.column(len(_PART) + 1).flatten().to_numpy().reshape(-1, HEADS)
        if rest is not None:
            x, sign, heads = {c: np.concatenate([rest[0][c], x[c]]) for c in _PART}, np.concatenate([rest[1], sign]), np.concatenate([rest[2], heads])
        if not len(x["h"]):
            continue
        last = np.flatnonzero((x["h"] != x["h"][-1]) | (x["cell"] != x["cell"][-1]) | (x["part"] != x["part"][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield emit(x, sign, heads, cut)
        rest = {c: v[cut:] for c, v in x.items()}, sign[cut:], heads[cut:]
    if rest is not None and len(rest[1]):
        yield emit(*rest, len(rest[1]))


def row_number_of(doc_id, text):
    """What names a row in the results: repeated rows (same id and text) have one name."""
    return F.xxhash64(doc_id, text)


class Join:
    """What is known of the sets of all texts: `rows` (a row for each document), `sets` (a row for each distinct set), `members` (of tiles)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        small_batches(spark)
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
        self.base = base.select(row_number_of("doc_id", "text").alias("row"), "doc_id", "text")
        measured = staged(self.base.mapInArrow(_measure, "row long, doc_id long, n long, s long, sign binary, long_sign binary, slice int, counters binary"), "measured")
        self.rows = measured.where("n IS NOT NULL").select("row", "doc_id", "n", "s")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("first")
        one = [F.min("row").alias("row"), first, F.first("sign").alias("sign"), F.first("long_sign").alias("long_sign")]
        self.sets = staged(measured.where("s IS NOT NULL").groupBy("s").agg(*one), "sets")
        total = self.rows.agg(F.sum(F.col("n") * (100 - LEAST) / 100 + 1)).head()[0] or 0
        bits = max(int(np.ceil(np.log2(total / PER_TASK + 1))), int(np.ceil(np.log2(int(spark.conf.get("spark.sql.shuffle.partitions"))))))
        rank = spark.sparkContext.broadcast(_ranks(measured))
        posted = self.base.select("text").mapInArrow(_postings(rank, bits), "bucket long, hubs binary, members binary")
        self.members = staged(posted.repartition(1 << bits, "bucket").mapInArrow(_meet, _MEMBERS), "members")

    def linked(self, pairs: DataFrame, name: str, keep: tuple[str, str] = ("a", "b")) -> DataFrame:
        """The columns `keep` of the similar ones of pairs (a, b, na, nb, ...; a < b, in any number): by signatures, then by exact intersection of the sorted arrays; stored."""
        spark = pairs.sparkSession
        sign = lambda x: self.sets.select(F.col("s").alias(x), F.coalesce("long_sign", "sign").alias(f"sign_{x}"), F.col("row").alias(f"row_{x}")).hint("merge")
        carried = [c for c in pairs.columns if c not in ("na", "nb")] + ["row_a", "row_b"]
        pairs = pairs.distinct().join(sign("a"), "a").join(sign("b"), "b").select("na", "nb", "sign_a", "sign_b", *carried)
        pairs = staged(pairs.mapInArrow(_allowed, ", ".join(f"{c} long" for c in carried)), f"{name}-pairs")
        # the arrays come from the texts again; a filter of bounded size keeps most other texts out
        rows = pairs.select(F.explode(F.array("row_a", "row_b")).alias("row"))
        bits = spark.sparkContext.broadcast(bit_filter(rows, "row", filter_bits(2 * pairs.count())))
        sets = staged(self.base.select("row", "text").mapInArrow(_needed(bits), "s long, items binary"), f"{name}-sets")
        left, right = (sets.select(F.col("s").alias(x), F.col("items").alias(f"items_{x}")).dropDuplicates([x]).hint("merge") for x in "ab")
        both = pairs.drop("row_a", "row_b").join(left, "a").join(right, "b").select("items_a", "items_b", *keep)
        return staged(both.mapInArrow(_exact, f"{keep[0]} long, {keep[1]} long"), f"{name}-links")

    def near(self) -> DataFrame:
        """Links of sets with what they hang on: a, b."""
        pairs = None
        for hub in ("hub", "next"):
            m, swap = f"{hub}_n", F.col("s") > F.col(hub)
            some = self.members.where(f"s != {hub} AND 100 * least(n, {m}) >= {LEAST} * greatest(n, {m})")
            some = some.select(F.least("s", hub).alias("a"), F.greatest("s", hub).alias("b"), F.when(swap, F.col(m)).otherwise(F.col("n")).alias("na"), F.when(swap, F.col("n")).otherwise(F.col(m)).alias("nb"))
            pairs = some if pairs is None else pairs.union(some)
        return self.linked(pairs, "near")

    def all_pairs(self, found: DataFrame | None) -> DataFrame:
        """Candidate pairs of sets (a, b, na, nb) in one tile, of two components (ca, cb) of `found`; without `found` each set is its own."""
        m = self.members
        tiles = m.select("h", "s", "n").union(m.select("h", F.col("hub").alias("s"), F.col("hub_n").alias("n"))).distinct()
        if found is None:
            tiles = tiles.withColumn("comp", F.col("s"))
        else:
            tiles = tiles.join(found.select(F.col("node").alias("s"), "component").hint("merge"), "s", "left").select("h", "s", "n", F.coalesce("component", "s").alias("comp"))
        # a tile has a cell for each band of sizes, and the sets of a band come to the next one as well; a little over 100 / LEAST, as logarithms are not exact
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / LEAST) * (1 + 1e-9)))
        tiles = staged(tiles.withColumn("band", band), "tiles")
        cells = tiles.select("h", F.explode(F.array(F.struct(F.col("band").alias("cell"), F.lit(1).alias("own")), F.struct((F.col("band") + 1).alias("cell"), F.lit(0).alias("own")))).alias("x"), "s", "n", "comp").select("h", "x.*", "s", "n", "comp")
        counts = cells.groupBy("h", "cell", "comp").agg(F.count(F.lit(1)).alias("k"), F.max("own").alias("own"))
        several = counts.groupBy("h", "cell").agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("size"), F.max("own").alias("own")).where("own = 1 AND size > main.k")
        several = staged(several.select("h", "cell", F.col("main.comp").alias("main"), F.when(F.col("size") > BLOCK, F.col("main.k")).alias("n_main"), "size"), "open-cells")
        # the sets of the largest component needn't meet each other: in blocks they meet those of the others, which meet each other
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        todo = cells.join(several.hint("merge"), ["h", "cell"]).withColumns({"bm": blocks(F.col("n_main")), "br": blocks(F.col("size") - F.col("n_main"))})
        mine = F.expr("cast(pmod(xxhash64(s), if(comp = main, bm, br)) as int)")
        part = lambda p, side: F.struct(p.cast("long").alias("part"), F.lit(side).cast("long").alias("side") if isinstance(side, int) else side.cast("long").alias("side"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        as_main = F.transform(upto("br"), lambda a: part(a * F.col("bm") + F.col("mine"), 1))
        to_main = F.transform(upto("bm"), lambda b: part(F.col("mine") * F.col("bm") + b, 0))
        to_rest = F.transform(upto("br"), lambda o: part(-1 - (F.least("mine", o).cast("long") * F.col("br") + F.greatest("mine", o)), F.when(F.col("mine") < o, 0).when(F.col("mine") > o, 1).otherwise(2)))
        parts = F.when(F.col("n_main").isNull(), F.array(part(F.lit(0), 2))).when(F.col("comp") == F.col("main"), as_main).otherwise(F.concat(to_main, to_rest))
        todo = todo.withColumn("mine", mine).select("h", "cell", F.explode(parts).alias("x"), F.col("own").cast("long").alias("own"), "s", "n", "comp").select("h", "cell", "x.part", "x.side", "own", "s", "n", "comp")
        todo = staged(todo, "todo")
        heads = todo.groupBy("s").agg(F.slice(F.array_sort(F.collect_set("h")), 1, HEADS).alias("k"))
        heads = heads.select("s", F.concat("k", F.array_repeat(F.lit(2**63 - 1), F.lit(HEADS) - F.size("k"))).alias("heads"))
        todo = todo.join(heads.hint("merge"), "s").join(self.sets.select("s", "sign").hint("merge"), "s").select(*_PART, "sign", "heads")
        return todo.repartition("h", "cell", "part").sortWithinPartitions("h", "cell", "part", "side").mapInArrow(_within, ", ".join(f"{c} long" for c in _PAIR))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All links between distinct sets: a, b (the least doc_id of each set; a row for each two sets). Their number grows with the square of a group of near copies; see `similar` for the rest."""
    join = Join(docs, id_col, text_col)
    pairs = join.linked(join.all_pairs(None).select("a", "b", "na", "nb"), "all")
    ids = lambda x: join.sets.select(F.col("s").alias(x), F.col("first.doc_id").alias(f"id_{x}")).hint("merge")
    return pairs.distinct().join(ids("a"), "a").join(ids("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), row (`row_number_of` it), kept (whether it is the first of its component, ids in order and null last) per row of `docs`.

    1. Each text becomes its sorted distinct shingle hashes, whose hash names the set; equal sets are one from here on.
    2. Every set posts its rarest shingles (by counters of shingles and words over all documents); sets with a common one share a tile. A worker joins what it holds
       of a tile to one set for each band of sizes and passes on only that one, so a tile that a third of all sets share stays small.
    3. Sets are compared with those they hang on. What links merges into components.
    4. Cells (a tile's sets of one band of sizes and of the band below) that still have several components are compared whole, in blocks: pairs of different
       components whose sizes and signatures allow a link are made in the first tile that both sets know of, and intersected
       exactly. The largest component of a cell meets the others only, so a large group of near copies is not paired with itself. No link between components is lost.

    Only components are returned, not each link: links between sets that are already joined are not looked at (`links` returns all).
    Null and empty texts have no shingles and link with nothing; a null id is never the least (a component of null ids alone has null); repeated
    rows share their component; texts of any length are handled whole; other columns are unread; an empty table gives no rows.
    """
    join = Join(docs, id_col, text_col)
    found = components(join.near(), "near-components")
    more = components(join.linked(join.all_pairs(found), "late", ("ca", "cb")).toDF("a", "b"), "late-components")
    of_set = join.sets.select("s", "first").join(found.select(F.col("node").alias("s"), "component").hint("merge"), "s", "left").select("s", "first", F.coalesce("component", "s").alias("comp"))
    of_set = of_set.join(more.select(F.col("node").alias("comp"), "component").hint("merge"), "comp", "left").select("s", "first", F.coalesce("component", "comp").alias("comp"))
    of_set = staged(of_set, "set-components")
    least = of_set.groupBy("comp").agg(F.min("first").alias("least"))
    label = staged(of_set.join(least.hint("merge"), "comp").select("s", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first_row")), "set-labels")
    out = join.rows.join(label.hint("merge"), "s", "left")
    alone = F.col("s").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row", (alone | (F.col("row") == F.col("first_row"))).alias("kept"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
