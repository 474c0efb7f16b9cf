"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tarn.llm.common import bounded_broadcast, small_batches, staged, table
from tarn.llm.textvec import mix

#: Words in a passage; documents of each label to train on at most, and passages of each of them; sizes of an encoding and of the attention.
PASSAGE, SAMPLE, TAUGHT, WIDTH, ATTENTION = 64, 1500, 128, 24, 12
#: The score from which a document counts as good.
THRESHOLD = 0.3

#: Classes of bytes: letters a-z by themselves, A-Z, digits, white space, each other ASCII sign by itself, parts of longer characters.
_CLASS = np.full(256, 3, dtype=np.int64)
_CLASS[65:91], _CLASS[48:58], _CLASS[0x80:0xC0], _CLASS[0xC0:] = 0, 1, 4, 5
_CLASS[97:123] = np.arange(6, 32)
_SIGNS = [x for x in range(33, 127) if not chr(x).isalnum()]
_CLASS[_SIGNS] = np.arange(32, 32 + len(_SIGNS))
_CLASS[10] = 2
_CLASSES = 32 + len(_SIGNS)
FEATURES = _CLASSES + 4

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BLOCK = 1 << 20


def _block(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros((0, FEATURES), dtype=np.float32)
    n = (len(starts) + PASSAGE - 1) // PASSAGE
    cuts = starts[::PASSAGE]
    of_byte = np.zeros(len(data), dtype=np.int64)
    of_byte[cuts[1:]] = 1
    of_byte = np.cumsum(of_byte)
    hist = np.bincount(of_byte * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float32)
    words = np.bincount(np.arange(len(starts)) // PASSAGE, minlength=n).astype(np.float32)
    # distinct words: by length, first byte and the sum of the bytes' squares
    total = np.concatenate([[0], np.cumsum(data.astype(np.int64) ** 2)])
    sign = mix((total[ends] - total[starts]).astype(np.uint64) + (data[starts].astype(np.uint64) << np.uint64(40)) + ((ends - starts).astype(np.uint64) << np.uint64(48))) >> np.uint64(24)
    key = np.unique(((np.arange(len(starts)) // PASSAGE).astype(np.uint64) << np.uint64(40)) | sign)
    distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n).astype(np.float32)
    size = np.bincount(np.arange(len(starts)) // PASSAGE, weights=(ends - starts), minlength=n).astype(np.float32)
    extra = np.stack([distinct / words, np.log1p(words) / 4, size / words / 10, (size / words > 12).astype(np.float32)], axis=1)
    return np.concatenate([np.sqrt(hist / hist.sum(axis=1, keepdims=True)), extra], axis=1)


def passages(text: str | None) -> np.ndarray:
    """Features of each passage of the whole text; an empty or null text has one passage of zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts, at = [], 0
    while at < len(raw):
        cut = at + _BLOCK
        if cut < len(raw):
            cut = max(raw.rfind(b" ", at, cut), raw.rfind(b"\n", at, cut)) + 1 or cut
            cut = cut if cut > at else at + _BLOCK
        parts.append(_block(np.frombuffer(raw, dtype=np.uint8, count=min(cut, len(raw)) - at, offset=at)))
        at = cut
    out = np.concatenate(parts) if parts else np.zeros((0, FEATURES), dtype=np.float32)
    return out if len(out) else np.zeros((1, FEATURES), dtype=np.float32)


class AttentionModel:
    """Passages are encoded by a tanh layer, weighted by gated attention (tanh times sigmoid), summed, and scored by a logistic unit."""

    def __init__(self):
        rng = np.random.default_rng(3)
        scale = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"E": scale(FEATURES, WIDTH), "e": np.zeros(WIDTH), "V": scale(WIDTH, ATTENTION), "U": scale(WIDTH, ATTENTION), "a": scale(ATTENTION, 1)[:, 0], "o": scale(WIDTH, 1)[:, 0], "b": np.zeros(1)}

    def _forward(self, x: np.ndarray, first: np.ndarray):
        w = self.w
        h = np.tanh(x @ w["E"] + w["e"])
        v, u = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        s = (v * u) @ w["a"]
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        s = np.exp(s - np.maximum.reduceat(s, first)[of])
        a = s / np.add.reduceat(s, first)[of]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, v, u, a, of, z, 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["b"][0], -30, 30)))

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        first = np.cumsum([0, *map(len, bags)])[:-1]
        return self._forward(np.concatenate(bags), first)[-1]

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 40, rate: float = 5e-3) -> AttentionModel:
        rng, w = np.random.default_rng(4), self.w
        m, r, t = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 32)):
                x, first = np.concatenate([bags[i] for i in some]), np.cumsum([0, *(len(bags[i]) for i in some)])[:-1]
                h, v, u, a, of, z, p = self._forward(x, first)
                d = (p - y[some]) * weight[some] / len(some)
                dz = d[:, None] * w["o"]
                da = (dz[of] * h).sum(axis=1)
                ds = a * (da - np.add.reduceat(a * da, first)[of])
                dv, du = ds[:, None] * w["a"] * u * (1 - v**2), ds[:, None] * w["a"] * v * u * (1 - u)
                dh = (a[:, None] * dz[of] + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
                grad = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dv, "U": h.T @ du, "a": (v * u).T @ ds, "o": z.T @ d, "b": np.array([d.sum()])}
                t += 1
                for k, g in grad.items():
                    g = g + 1e-4 * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    r[k] = 0.999 * r[k] + 0.001 * g * g
                    w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(r[k] / (1 - 0.999**t)) + 1e-8)
        return self


def _bags(batches):
    for batch in batches:
        x = [passages(t.as_py()) for t in batch.column(1)]
        x = [(b if len(b) <= TAUGHT else b[np.linspace(0, len(b) - 1, TAUGHT).astype(int)]).astype("<f4").tobytes() for b in x]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> AttentionModel:
    """Fit on at most `most` documents of each label (doc_id, label 0 or 1): those of the least hash of the id; the others' share is kept by weights.
    Of a document with more than TAUGHT passages, so many evenly spread ones teach, so that what comes to the driver is bounded; of repeated ids, 4 * most rows at most in all.

    Rows of a null id or label teach nothing; of several labels of one id the least counts; without labels every score is about 0.5.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    known = staged(known.where("label IN (0, 1)").withColumn("h", F.xxhash64("doc_id")), "labels")
    share, parts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}, []
    for y in sorted(share):
        parts.append(known.where(F.col("label") == y).orderBy("h", "doc_id").limit(most).select("doc_id", "label"))
    model = AttentionModel()
    if not parts:
        return model
    chosen = staged(parts[0].union(parts[1]) if len(parts) > 1 else parts[0], "labels-chosen")
    rows = docs.select("doc_id", "text").join(bounded_broadcast(chosen, 2 * most), "doc_id").select("label", "text").mapInArrow(_bags, "y int, x binary").limit(4 * most).collect()
    rows = sorted(rows, key=lambda r: (r["y"], r["x"]))
    y = np.array([r["y"] for r in rows], dtype=float)
    if not len(y):
        return model
    have = {k: (y == k).sum() for k in share}
    weight = np.array([share[int(k)] / sum(share.values()) * len(y) / max(1, have[int(k)]) for k in y])
    return model.fit([np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES) for r in rows], y, weight)


def scored(docs: DataFrame, model: AttentionModel, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and _score (0 to 1; it takes the place of a column of that name), from the whole text alone.

    Null texts count as empty; a text of any length is scored whole, and equal texts score alike; an empty table gives no rows.
    """
    docs = docs.drop("_score")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some 10 KB
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = []
            column = batch.column(at)
            for low in range(0, len(column), 64):
                scores.append(shared.value.score([passages(x.as_py()) for x in column[low : low + 64]]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], [*batch.schema.names, "_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_score", DoubleType())]))


def held_out():
    """True for rows that nothing is learnt from; rows of a null id are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def trained_on(spark: SparkSession, docs: DataFrame, sf_dir: str) -> AttentionModel:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(~held_out())
    return train(docs, labels)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Rows of a null id are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, trained_on(spark, docs, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
