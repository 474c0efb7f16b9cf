"""Bloom filters as an aggregate and a predicate, in a binary form of its own: 4 bytes of hash count, then the bits.

Built map-side in Arrow batches, so what is shuffled is a filter for each task and key, not the members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType


def _shape(size: int, fpr: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-max(1, size) * math.log(fpr) / math.log(2) ** 2))
    return -(-bits // 64) * 64, max(1, round(bits / max(1, size) * math.log(2)))


def _slots(h: np.ndarray, hashes: int, bits: int) -> np.ndarray:
    h = h.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(bits) for k in range(hashes)]).astype(np.int64)


def bloom_agg(df: DataFrame, key: str, member: str, size: int, fpr: float = 0.01) -> DataFrame:
    """key, bloom: a filter for `size` members of each key at the false positive rate `fpr`. No member gives an empty filter's absence: no row."""
    bits, hashes = _shape(size, fpr)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            at, h = codes.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for i, k in enumerate(codes.dictionary.to_pylist()):
                m = maps.setdefault(k, np.zeros(bits, dtype=bool))
                m[_slots(h[at == i], hashes, bits).ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.string()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], ["k", "m"])

    @F.pandas_udf(BinaryType())
    def merged(m: pd.Series) -> bytes:
        out = np.zeros(bits // 8, dtype=np.uint8)
        for x in m:
            out |= np.frombuffer(x, dtype=np.uint8)
        return hashes.to_bytes(4, "little") + out.tobytes()

    part = df.select(F.col(key).alias("k"), F.xxhash64(member).alias("h")).mapInArrow(partial, "k string, m binary")
    return part.groupBy(F.col("k").alias(key)).agg(merged("m").alias("bloom"))


@F.pandas_udf(BooleanType())
def _contains(h: pd.Series, blob: pd.Series) -> pd.Series:
    out = np.zeros(len(h), dtype=bool)
    for raw, at in blob.groupby(blob).groups.items() if len(blob) else ():
        bits = np.unpackbits(np.frombuffer(bytes(raw)[4:], dtype=np.uint8)).astype(bool)
        out[at] = bits[_slots(h.loc[at].to_numpy(), int.from_bytes(bytes(raw)[:4], "little"), len(bits))].all(axis=0)
    return pd.Series(out)


def bloom_contains(member: Column, blob: Column | bytes) -> Column:
    """True of every member that went in, and of few others. A filter given as bytes goes to each worker once, one given as a column with every row."""
    if not isinstance(blob, bytes):
        return _contains(F.xxhash64(member), blob)
    hashes = int.from_bytes(blob[:4], "little")

    @F.pandas_udf(BooleanType())
    def inside(h: pd.Series) -> pd.Series:
        packed = np.frombuffer(blob, dtype=np.uint8, offset=4)
        slots = _slots(h.to_numpy(), hashes, 8 * len(packed))
        return pd.Series(((packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=0).astype(bool))

    return inside(F.xxhash64(member))
