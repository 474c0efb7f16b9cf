"""Texts of interval ends as predicates."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: str | float) -> float:
    """A decimal number, inf, or 0x and the bits of a double. Anything else, and NaN, is an error."""
    if isinstance(text, (int, float)):
        value = float(text)
    elif text[:2].lower() == "0x" and "p" not in text.lower() and len(text) <= 18:
        value = struct.unpack(">d", int(text, 16).to_bytes(8, "big"))[0]
    else:
        if text != text.strip() or "_" in text:
            raise ValueError(f"not a number: {text!r}")
        value = float.fromhex(text) if "0x" in text.lower() else float(text)
    if math.isnan(value):
        raise ValueError(f"not a number: {text!r}")
    return value


def format_number(value: float | None) -> str | None:
    """Plain decimals without an exponent and without trailing zeros; None of NaN."""
    if value is None or math.isnan(value):
        return None
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    from decimal import Decimal

    return format(Decimal(repr(value)).normalize(), "f") if value else "0"


@dataclass(frozen=True)
class Bound:
    value: float | str | None
    inclusive: bool = True


def score_bound(text: str | float) -> Bound:
    """`(1` leaves 1 out; `[1` and `1` take it in."""
    if isinstance(text, str) and text[:1] in "([" and text:
        return Bound(parse_number(text[1:]), text[0] == "[")
    return Bound(parse_number(text))


def score_between(score: Column, low: str | float, high: str | float) -> Column:
    a, b = score_bound(low), score_bound(high)
    above = score >= a.value if a.inclusive else score > a.value
    return above & (score <= b.value if b.inclusive else score < b.value)


def lex_between(member: Column, low: str, high: str) -> Column:
    """`-` and `+` are open ends; `(x` leaves x out, `[x` and `x` take it in. `+` as the low or `-` as the high end is nothing."""
    if low == "+" or high == "-":
        return F.lit(False)
    out = F.lit(True)
    if low != "-":
        a = low[1:] if low[:1] in "([" and low else low
        out = out & (member > a if low[:1] == "(" else member >= a)
    if high != "+":
        b = high[1:] if high[:1] in "([" and high else high
        out = out & (member < b if high[:1] == "(" else member <= b)
    return out
