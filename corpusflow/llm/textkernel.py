"""Vectorised word hashing over Arrow string columns (numpy inside Spark tasks).

Words are runs of bytes outside a separator set, after A-Z are lower-cased.
A word's hash is a polynomial over random byte values, taken from one running
sum per chunk, then mixed; 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time (a longer text is one chunk).
CHUNK = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return table


#: ASCII white space, and all ASCII that is neither letter nor digit.
BLANK = separators((0x20, 0x20), (0x09, 0x0D))
NOT_WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("p", _BASE), ("i", _BASE_INV)):
            out = np.ones(size, np.uint64)
            have, step = 1, base
            while have < size:       # doubling: out[have:2have] = out[:have] * base^have
                k = min(have, size - have)
                out[have:have + k] = out[:k] * np.uint64(step)
                have += k
                step = step * step % (1 << 64)
            _powers[name] = out
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_chunks(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them); null texts are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + column.offset)[column.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + chunk, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word of the chunk, in text order."""
    return _words(data, offsets, sep, ())[:4]


def words_and_stems(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word and, for each length, of the first bytes of every longer word."""
    h, rows, _, _, stems = _words(data, offsets, sep, lengths)
    return np.concatenate([h, *[v for v, _ in stems]]), np.concatenate([rows, *[rows[k] for _, k in stems]])


def _words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lengths: tuple[int, ...]):
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return np.zeros(0, np.uint64), none, none, none, [(np.zeros(0, np.uint64), none)] * len(lengths)
    low = LOWER[data]
    inside = ~sep[low]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    last = np.empty(n, bool)
    last[:-1] = ~inside[1:] | first[1:]
    last[-1] = True
    ends = np.flatnonzero(inside & last) + 1
    power, inverse = _power(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUE[low] * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    rows = np.searchsorted(offsets, starts, "right") - 1
    stems = []
    for n in lengths:
        longer = np.flatnonzero(ends - starts > n)
        at = starts[longer]
        stems.append((mix((total[at + n] - total[at]) * inverse[at] + np.uint64(n * 0xA24BAED4963EE407 % (1 << 64))), longer))
    return h, rows, starts, ends, stems


_STEP = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9FB21C651E98DF25)]


def shingles(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``k`` words within a row; a row of fewer words gives its whole sequence once."""
    out, of = [], []
    m = len(h)
    if m >= k:
        same = rows[:m - k + 1] == rows[k - 1:]
        acc = np.zeros(m - k + 1, np.uint64)
        for i in range(k):
            acc = (acc ^ h[i:m - k + 1 + i]) * _STEP[i % 5] + _STEP[(i + 1) % 5]
        out.append(mix(acc[same]))
        of.append(rows[:m - k + 1][same])
    short, begin, count = np.unique(rows, return_index=True, return_counts=True)
    for r, b, c in zip(short[count < k], begin[count < k], count[count < k]):
        acc = np.full(1, c, np.uint64)
        for i in range(c):
            acc = (acc ^ h[b + i:b + i + 1]) * _STEP[(i + 2) % 5] + _STEP[i % 5]
        out.append(mix(acc))
        of.append(np.array([r]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)
