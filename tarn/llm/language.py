"""Language ID: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import small_batches, table

#: Hash buckets of subwords; size of an embedding; rows to train on at most; share of the labelled rows that the rejection may cost.
BUCKETS, WIDTH, SAMPLE, REJECTED = 1 << 14, 16, 2000, 0.01
UNKNOWN = "und"

_ASCII_LETTER = re.compile(r"[A-Za-z]")
#: ASCII letters in lower case, other bytes of UTF-8 as they are, all else a space.
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_BLOCK = 1 << 20


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's category L."""
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's subwords occur in the whole text: runs of 2, 3 and 4 bytes within words with a space at both ends, in blocks of bounded size."""
    raw = np.frombuffer(b" %b " % text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(buckets, dtype=np.int64)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    for at in range(0, len(raw), _BLOCK):
        b = _FOLD[raw[at : at + _BLOCK + 3]]
        inner = b != 32
        for n in (2, 3, 4):
            m = min(_BLOCK, len(b) - n + 1)  # runs that begin in this block
            if m <= 0:
                continue
            code = b[:m].copy()
            for k in range(1, n):
                code |= b[k : k + m] << np.uint32(8 * k)
            fits = np.ones(m, dtype=bool) if n == 2 else inner[1 : 1 + m].copy()
            if n == 4:
                fits &= inner[2 : 2 + m]
            fits &= inner[:m] | inner[n - 1 : n - 1 + m]
            out += np.bincount(((code[fits] + np.uint32(n)) * np.uint32(2654435761)) >> shift, minlength=buckets)
    return out


class LanguageModel:
    """logits of a text = mean embedding of its subwords times a matrix; trained by stochastic gradient descent in numpy.

    The temperature (fitted on a fifth of the rows) makes the highest probability a confidence; a text below the confidence
    that all but REJECTED of those rows reach is not accepted.
    """

    def __init__(self, labels: list[str]):
        self.labels = labels
        rng = np.random.default_rng(7)
        self.emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
        self.out = np.zeros((WIDTH, len(labels)))
        self.bias = np.zeros(len(labels))
        self.temperature, self.least = 1.0, 0.0

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 0.5) -> LanguageModel:
        """rows: (buckets, counts, label number)."""
        order, hold = np.random.default_rng(8), len(rows) // 5
        train, held = rows[hold:], rows[:hold]
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for i in order.permutation(len(train)):
                at, n, y = train[i]
                if not len(at):
                    continue
                share = n / n.sum()
                mean = share @ self.emb[at]
                p = _softmax(mean @ self.out + self.bias)
                p[y] -= 1
                back = self.out @ p
                self.out -= step * np.outer(mean, p)
                self.bias -= step * 0.1 * p
                self.emb[at] -= step * 20 * share[:, None] * back
        self.table = (self.emb @ self.out).astype(np.float64)
        if held:
            logits = np.array([(n / max(1, n.sum())) @ self.table[at] + self.bias for at, n, _ in held])
            truth = np.array([y for *_, y in held], dtype=int)
            loss = {t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in np.geomspace(0.2, 5, 41)}
            self.temperature = min(loss, key=loss.get)
            self.least = float(np.quantile(_softmax(logits / self.temperature).max(axis=1), REJECTED))
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.labels or not has_letter(text):
            return UNKNOWN, 0.0
        n = counts(text)
        p = _softmax((n @ self.table / max(1, n.sum()) + self.bias) / self.temperature)
        return self.labels[int(p.argmax())], float(p.max())


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def _sparse(batches):
    for batch in batches:
        at, n = [], []
        for text in batch.column(1):
            c = counts(text.as_py())
            k = np.flatnonzero(c)
            at.append(k.astype("<u2").tobytes())
            n.append(c[k].astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["label", "at", "n"])


def train(labelled: DataFrame, most: int = SAMPLE) -> LanguageModel:
    """Fit on at most `most` rows (label, text) with neither null: those of the least hash of id and text (of repeated rows, 2 * most at most in all). What comes to the driver is at most 96 KB a row, however long its text."""
    small_batches(labelled.sparkSession)
    order = labelled.where("label IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("key", "text"))
    last = order.select("h").orderBy("h").limit(most).agg(F.max("h").alias("h")).head()["h"]
    rows = order.where(F.col("h") <= (last if last is not None else 0)).select("label", "text").mapInArrow(_sparse, "label string, at binary, n binary").limit(2 * most).collect()
    rows = sorted(rows, key=lambda r: (r["label"], r["at"], r["n"]))
    rows = [rows[i] for i in np.random.default_rng(9).permutation(len(rows))]
    names = sorted({r["label"] for r in rows})
    return LanguageModel(names).fit([(np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<u4").astype(float), names.index(r["label"])) for r in rows])


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs`, lang_pred, score, accepted. Null texts and texts without a letter (Unicode's category L) are `und`, with score 0 and not accepted.

    A text of any length is counted whole; repeated rows and null ids are rows of their own; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    schema = docs.select(*keep).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred KB for each label, whatever the input

    def run(batches):
        model = shared.value
        for batch in batches:
            got = [model.predict(x.as_py()) for x in batch.column(len(keep))]
            lang, score = [x for x, _ in got], [y for _, y in got]
            ok = [x != UNKNOWN and y >= model.least for x, y in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], [*keep, "lang_pred", "score", "accepted"])

    schema = schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted. Rows of a null id are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = train(docs.where(F.coalesce(~held, F.lit(False))).select(F.col("lang").alias("label"), "text", F.col("doc_id").alias("key")))
    return identify(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model, ["doc_id", "held_out"])


