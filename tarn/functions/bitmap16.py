"""Sets of 16-bit numbers: as sorted arrays, and in a binary form of blocks (a high byte, then 256 bits), sorted by the high byte."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType

_BLOCK = 33


def bits_agg(bit: Column) -> Column:
    """Aggregate: the sorted distinct numbers, each taken modulo 65536. At most 65536 a group."""
    return F.array_sort(F.collect_set((F.pmod(bit.cast("long"), F.lit(65536))).cast("int")))


def bits_between(bits: Column, low: int = 0, high: int = 0) -> Column:
    """Numbers from low to high; 0 on either side leaves it open."""
    return F.filter(bits, lambda x: (x >= low if low else F.lit(True)) & (x <= high if high else F.lit(True)))


def encode_bits(bits: list[int]) -> bytes:
    blocks: dict[int, int] = {}
    for b in bits:
        b &= 0xFFFF
        blocks[b >> 8] = blocks.get(b >> 8, 0) | 1 << (b & 0xFF)
    return b"".join(bytes([k]) + blocks[k].to_bytes(32, "little") for k in sorted(blocks))


def decode_bits(raw: bytes) -> list[int]:
    if len(raw) % _BLOCK:
        raise ValueError("not a bitmap")
    return [raw[at] << 8 | i for at in range(0, len(raw), _BLOCK) for i, v in enumerate(f"{int.from_bytes(raw[at + 1 : at + _BLOCK], 'little'):0256b}"[::-1]) if v == "1"]


@F.pandas_udf(BinaryType())
def to_bitmap(bits: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else encode_bits([int(b) for b in x]) for x in bits])


@F.pandas_udf(ArrayType(IntegerType()))
def from_bitmap(raw: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else decode_bits(bytes(x)) for x in raw])


@F.pandas_udf(BooleanType())
def has_any(bits: pd.Series, raw: pd.Series) -> pd.Series:
    """Whether the bitmap holds any of the numbers; false of what is no bitmap."""
    return pd.Series([x is not None and len(x) % _BLOCK == 0 and not set(map(int, b)).isdisjoint(decode_bits(bytes(x))) for b, x in zip(bits, raw, strict=True)])
