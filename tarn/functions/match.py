"""The match language, compiled to Columns.

A pattern is a sequence of terms `\\name{argument}` that all must hold, then, if anything is left, a glob over the whole text.
An argument may hold braces in pairs, or be quoted. White space behind a term is skipped.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarn.functions.bitmap16 import has_any


def _argument(text: str) -> tuple[str, str] | None:
    """(argument, what follows its brace) of a text behind an opening brace; None where none closes it."""
    depth, quoted = 0, False
    for i, c in enumerate(text):
        if c == '"' and not (quoted and text[i - 1] == "\\"):
            quoted = not quoted
        elif c == "{" and not quoted:
            depth += 1
        elif c == "}" and not quoted:
            if not depth:
                return text[:i], text[i + 1 :].lstrip()
            depth -= 1
    return None


def next_term(pattern: str) -> tuple[str, str, str] | None:
    """(name, argument, rest) of a pattern that begins with a term of a non-empty argument."""
    if not pattern.startswith("\\") or "{" not in pattern:
        return None
    name, _, behind = pattern[1:].partition("{")
    found = _argument(behind)
    if found is None:
        return None
    value, rest = found
    if len(value) >= 2 and value[0] == value[-1] == '"':
        try:
            value = json.loads(value)
        except ValueError:
            value = ""
    return name, value, rest


def glob_regex(glob: str, path: bool = False) -> str | None:
    """An anchored Java regular expression: `*`, `?`, `[a-z]`, `[^a]`, `\\c`; with `path`, `*` and `?` stop at `/`. None of a malformed glob."""
    one, i, out = ("[^/]" if path else "."), 0, []
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(one + "*")
        elif c == "?":
            out.append(one)
        elif c == "\\":
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
            i += 1
        elif c == "[":
            inside, negated = [], False
            if glob[i : i + 1] == "^":
                negated, i = True, i + 1
            while True:
                if i >= len(glob):
                    return None
                if glob[i] == "]" and inside:
                    i += 1
                    break
                ends = []
                for _ in range(2):
                    if glob[i : i + 1] == "\\":
                        i += 1
                    if i >= len(glob):
                        return None
                    ends.append(glob[i])
                    i += 1
                    if glob[i : i + 1] != "-" or len(ends) == 2:
                        break
                    i += 1
                inside.append("-".join("\\" + x if not x.isalnum() and ord(x) < 128 else x for x in ends))
            out.append(("[^" if negated else "[") + "".join(inside) + "]")
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"


def _number(text: Column) -> Column:
    """A finite or infinite number; null of anything else, spaces at its ends included."""
    value = F.when(text == F.btrim(text), F.expr("1").isNotNull()).otherwise(F.lit(False))
    return F.when(value & ~F.lower(text).rlike("[df]$|nan"), text.try_cast("double"))


_COMPARE = {"gt": Column.__gt__, "lt": Column.__lt__, "ge": Column.__ge__, "le": Column.__le__, "eq": Column.__eq__}


def _term(name: str, value: str, text: Column) -> Column:
    if name == "not":
        return ~matches(value, text)
    if name == "or":
        out = F.lit(False)
        while (found := next_term(value)) and found[1]:
            out = out | _term(found[0], found[1], text)
            value = found[2]
        return out
    if name == "re":
        try:
            re.compile(value)
        except re.error:
            return F.lit(False)
        # look-around and back references are no part of the language
        return F.lit(False) if re.search(r"\(\?[=!<]|\\[1-9]", value) else text.rlike(value)
    if name == "match":
        regex = glob_regex(value, path=True)
        return F.lit(False) if regex is None else text.rlike(regex)
    if name == "term":
        return text.contains(value)
    if name == "prefix":
        return text.startswith(value)
    if name == "suffix":
        return text.endswith(value)
    if name in _COMPARE or name == "ne":
        try:
            number = float(value)
        except ValueError:
            number = math.nan
        own = _number(text)
        if name == "ne":
            return F.lit(True) if math.isnan(number) else F.coalesce(own != number, F.lit(True))
        return F.lit(False) if math.isnan(number) else F.coalesce(_COMPARE[name](own, F.lit(number)), F.lit(False))
    if name == "bm16":
        bits = [int(x) & 0xFFFF for x in value.split(",") if re.fullmatch(r"[+-]?\d+", x.strip())]
        # bitmaps in data are in hexadecimal
        return has_any(F.lit(bits), F.when(text.rlike("^([0-9a-fA-F]{66})+$"), F.unhex(text)).otherwise(text.cast("binary")))
    if name.startswith("json:"):
        path = "$" + "".join(f"[{x}]" if x.isdigit() else f".{x}" for x in name[5:].split("."))
        return matches(value, F.coalesce(F.get_json_object(text, path), F.lit("")))
    if name.startswith("pb:"):
        return matches(value, protobuf_field(text.cast("binary"), F.lit(name[3:])))
    raise ValueError(f"unknown term {name!r}")


def matches(pattern: str, text: Column) -> Column:
    """Whether `text` (a string; null counts as empty) fits the pattern. Never null."""
    text = F.coalesce(text, F.lit(""))
    out = None
    while found := next_term(pattern):
        name, value, rest = found
        if not value:  # such a term is passed over, the rest is a glob
            pattern = rest
            break
        one = _term(name, value, text)
        out = one if out is None else out & one
        if not rest:
            return out
        pattern = rest
    if pattern.startswith("\\\\"):
        pattern = pattern[1:]
    regex = glob_regex(pattern)
    one = F.lit(False) if regex is None else text.rlike(regex)
    return one if out is None else out & one


def match_expr(pattern: str, member: Column, data: Column | None = None, target: str = "either") -> Column:
    """`\\member{}` or `\\data{}` in front choose what is matched; else `target`: the member, or the member or the data."""
    data = F.lit("") if data is None else data.cast("string")
    if pattern.startswith("\\member{}"):
        return matches(pattern[9:], member)
    if pattern.startswith("\\data{}"):
        return matches(pattern[7:], data)
    return matches(pattern, member) if target == "member" else matches(pattern, member) | matches(pattern, data)


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at, value, shift = at + 1, value | (b & 0x7F) << shift, shift + 7
        if b < 0x80:
            return value & (1 << 64) - 1, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            return
        yield tag >> 3, value


def read_protobuf(raw: bytes, path: str) -> str:
    """The field at a path of numbers, such as `3,2u`, the last with its kind: i (zigzag), u, b or s; empty where it is missing or broken."""
    *outer, last = path.split(",")
    kind, number = (last[-1], int(last[:-1])) if last[-1].isalpha() else ("s", int(last))
    try:
        for n in outer:
            raw = next(v for k, v in _fields(raw) if k == int(n.rstrip("iubs")))
        value = next(v for k, v in _fields(raw) if k == number)
    except (IndexError, StopIteration, TypeError):
        return ""
    if isinstance(value, bytes):
        return value.decode("utf-8", "replace")
    if kind == "i":
        return str((value >> 1) ^ -(value & 1))
    return ("true" if value else "false") if kind == "b" else str(value)


@F.pandas_udf(StringType())
def protobuf_field(raw: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([read_protobuf(bytes(x), p) if x is not None else "" for x, p in zip(raw, path, strict=True)])
