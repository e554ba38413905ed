"""Vectorised scans of UTF-8 text with numpy, for use inside Arrow batches.

Words are runs of bytes other than space and 0x09-0x0D. Spans of bytes are numbered exactly within a slice, or hashed by
mixing their bytes in; sequences of words hash as polynomials over the word hashes, which are random numbers to each other. A slice has about
BLOCK bytes, or one text, so the memory beyond the text itself is bounded by the longest text's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 1 << 20

_random = np.random.default_rng(20240607)
_TABLE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93
SEED = 20240607
LONG = 256  # bytes of a span

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept, and made anew twice as long when too short."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, 1 << 12)
        size = 1 << (size - 1).bit_length()
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts(column: pa.Array, limit: int = 4 * BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a string column: first row, bytes, and where each text begins in them (one more than there are rows).

    A slice has up to `limit` bytes, or one text. Nulls are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def runs(data: np.ndarray, at: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't in `gap` (a table of 256), none across texts."""
    off = gap[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = off[:-1]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = off[1:]
    after[inner - 1] = True
    on = ~off
    return np.flatnonzero(on & before), np.flatnonzero(on & after) + 1


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span as one binary array. Spans are in order and don't overlap."""
    on = np.zeros(len(data) + 1, np.int8)
    np.add.at(on, starts, 1)
    np.add.at(on, ends, -1)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[np.cumsum(on[:-1]).astype(bool)])])


def numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span, equal exactly where the bytes are, within this call."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return spans(data, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same in every call: eight bytes after the other are mixed in; long spans go through XXH3."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(_STEP) + np.uint64(SEED))
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))  # the eight bytes from each place on
    todo = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        todo = todo[size[todo] > k]
        if not len(todo):
            break
        unused = np.maximum(8 - (size[todo] - k), 0).astype(np.uint64) * np.uint64(8)
        lane = eight[starts[todo] + k] << unused  # a little-endian machine has the bytes behind the span on top
        out[todo] = mix(out[todo] * np.uint64(_STEP) ^ mix(lane + np.uint64(k + 1)))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), SEED)
    return mix(out)


def windows(words: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `size` words within one text, and where each begins. of: each word's text, ascending."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(_STEP) + words[k : k + n]
    begin = np.flatnonzero(of[:n] == of[size - 1 :])
    return mix(h[begin]), begin


def counts(of: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, minlength=n).astype(np.int64)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of `values` (one for each byte) in each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def owner(at: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The text that each position is in."""
    return np.searchsorted(at, positions, "right") - 1
