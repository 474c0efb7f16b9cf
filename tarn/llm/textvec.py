"""Vectorised text work on bytes: words, their hashes, shingles and byte n-grams, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes handled at once; a longer word makes its block longer.
BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, _BASE, dtype=np.uint64))])
            _inverses = np.concatenate([[_U(1)], np.cumprod(np.full(n - 1, _INVERSE, dtype=np.uint64))])
    return _powers, _inverses


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of some bytes."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverses = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * powers[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Parts of at most about BLOCK bytes, cut at white space."""
    at = 0
    while len(raw) - at > BLOCK:
        cut = at + BLOCK
        data = np.frombuffer(raw, dtype=np.uint8, offset=at)
        after = BLOCK
        while after < len(data):
            hit = np.flatnonzero(_SPACE[data[after : after + 4096]])
            if len(hit):
                after += int(hit[0])
                break
            after = min(after + 4096, len(data))
        cut = at + after
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def words_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """(bytes, starts, ends, hashes, number of words in each text) of blocks of texts; words are what white space parts. A text of several blocks counts in its last one."""
    group: list[bytes] = []
    held = 0

    def flush():
        nonlocal group, held
        if group:
            begin = np.cumsum([0, *(len(x) + 1 for x in group)])
            data = np.frombuffer(b" ".join(group), dtype=np.uint8)
            starts, ends, hashes = _block_words(data)
            yield data, starts, ends, hashes, np.diff(np.searchsorted(starts, begin)).tolist()
        group, held = [], 0

    for raw in texts:
        if len(raw) > BLOCK:
            yield from flush()
            n = 0
            for x in filter(None, _pieces(raw)):
                data = np.frombuffer(x, dtype=np.uint8)
                starts, ends, hashes = _block_words(data)
                n += len(starts)
                yield data, starts, ends, hashes, []
            yield np.zeros(0, np.uint8), *([np.zeros(0, np.int64)] * 2), np.zeros(0, _U), [n]
            continue
        if held + len(raw) > BLOCK:
            yield from flush()
        group.append(raw)
        held += len(raw) + 1
    yield from flush()


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the words of each text, in order."""
    before = []
    for _, _, _, hashes, counts in words_of(texts):
        if not counts:
            before.append(hashes)
            continue
        if before:
            hashes, before = np.concatenate([*before, hashes]), []
        yield from np.split(hashes, np.cumsum(counts)[:-1])


_WEIGHT = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of k words, in order; of all words where they are fewer; none of none."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    total = np.full(n - size + 1, size, dtype=np.uint64) * _WEIGHT[63]
    for i in range(size):
        total += words[i : n - size + 1 + i] * _WEIGHT[i]
    return mix(total)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted distinct ones of these hashes."""
    return np.unique(shingles(words, k))
