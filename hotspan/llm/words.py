"""Words of many texts at once, as hash arrays.

Words are runs of bytes other than blanks (0x20, 0x09-0x0D). The bytes of a
group of texts lie in one array, so that cutting and hashing need no loop
over words. A word's hash is a polynomial of its bytes modulo 2^64, taken
from running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of texts that are worked on together; one longer text is a group alone.
GROUP_BYTES = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        size = max(n, GROUP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``values[start:end]`` for every span."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of texts: text ``i`` has the words ``first[i] .. first[i + 1]``."""

    data: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def words_of(data: np.ndarray, at: np.ndarray, lower: bool) -> Words:
    """The words of the texts ``data[at[i]:at[i + 1]]``."""
    live = ~_BLANK[data]
    opens, closes = live.copy(), live.copy()
    if len(data):
        opens[1:] &= ~live[:-1]
        closes[:-1] &= ~live[1:]
        edges = at[(at > 0) & (at < len(data))]
        opens[edges] = live[edges]
        closes[edges - 1] = live[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    values = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    return Words(data, np.searchsorted(starts, at), starts, ends, span_hashes(values, starts, ends))


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of ``k`` consecutive values; the callers leave out those across texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return mix(span_hashes(mix(hashes, 0x5851F42D4C957F2D), at, at + k), seed)


def groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(from, to, bytes, offsets)`` of successive groups of a column of texts; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, buffer = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + GROUP_BYTES, side="right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
