"""Words and word windows of whole Arrow text columns as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer text is handled alone.
BYTES_AT_ONCE = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x2127599BF4325C37 | 5
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BYTES_AT_ONCE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts that lie side by side in data, and where each text's words begin and end.

    A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D within one text.
    """
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    starts[first], ends[last] = inside[first], inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)), np.searchsorted(s, offsets)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of so many words, those across texts among them."""
    n = len(words) - size + 1
    if n <= 0:
        return words[:0]
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * _U(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(h)


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of a text column (null: empty) parts of at most BYTES_AT_ONCE, or one row: first row, end, bytes, offsets."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, where, raw = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES_AT_ONCE, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
