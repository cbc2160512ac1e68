"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last ``WINDOW`` bytes rolls over the UTF-8 bytes of a text.  Where it ends in ``k`` zero bits, a
piece of level ``k`` ends, so pieces are about ``2 ** k`` bytes and an edit changes only the pieces it touches.
The level of a text is the lowest at which it has at most ``PIECES`` pieces.  Each piece leaves 12 bits of its
own hash; the fingerprint is ``level:signature:signature one level up``, two characters a piece.

Two fingerprints compare at a level both have (equal or neighbouring levels).  Their likeness is one less the
edit distance of the two signatures over the longer one's length, the best over the levels they share; it is 0
if they share no level, or no run of ``RUN`` pieces (half of the shorter signature, if that is less).

Defined results: a null text is an empty text; the fingerprint of an empty text is ``0::``, alike (1) to itself
only.  Equal texts have equal fingerprints, whatever else is in their rows.  Rows are ordered by doc_id, nulls
first, then by a 64-bit hash of the text, so repeated rows stay rows and follow each other; a single row is its
own next.  An empty table gives no rows; extra columns are ignored.  A text of any length is hashed in windows of
``tk.CHUNK`` bytes: beyond the text itself it costs one byte per byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.llm import textkernel as tk
from corpusflow.llm.helpers import Scratch

#: Bytes that decide whether a piece ends.
WINDOW = 7
#: Most pieces of a signature (a word of the bit-parallel edit distance holds one bit each).
PIECES = 64
#: Pieces in a row that alike texts share.
RUN = 4
#: Level no byte reaches (a hash has 64 bits, so levels end at 64).
_NONE = 65
#: Never a byte of UTF-8; it stands between texts and has no weight.
_GAP = 0xFF
_WEIGHT = tk._VALUE.copy()
_WEIGHT[_GAP] = 0
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
_PAIR = np.array([a + b for a in _DIGITS for b in _DIGITS], "S2")
_CODE = {a + b: i for i, (a, b) in enumerate((a, b) for a in _DIGITS for b in _DIGITS)}


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of weighted bytes, and the inverse powers that make the hash of a slice independent of its place."""
    power, inverse = tk._power(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_WEIGHT[data] * power[:len(data)], out=total[1:])
    return total, inverse


def _levels(total: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Zero bits at the end of the rolling hash, for each byte; fewer than WINDOW bytes before it count as gaps."""
    n = len(total) - 1
    start = np.maximum(np.arange(1 - WINDOW, n + 1 - WINDOW), 0)
    h = (total[1:] - total[start]) * inverse[start]
    short = min(WINDOW - 1, n)          # at the very front the slice is shorter: shift it to the window's end
    h[:short] *= tk._power(WINDOW)[0][WINDOW - 1:WINDOW - 1 - short:-1]
    h = tk.mix(h)
    return np.bitwise_count((h & (~h + np.uint64(1))) - np.uint64(1)).astype(np.uint8)


def _codes(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (tk.mix(h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(52)).astype(np.int64)


def _lowest(counts: np.ndarray) -> np.ndarray:
    """Per row of counts by level: the lowest level with at most PIECES - 1 inner ends."""
    above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
    return (above >= PIECES).sum(axis=1)


def _short_fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of non-empty texts that are hashed together."""
    gap = bytes([_GAP]) * (WINDOW - 1)
    data = np.frombuffer(gap + gap.join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    first = WINDOW - 1 + np.concatenate([[0], np.cumsum(size + WINDOW - 1)[:-1]])
    last = first + size - 1
    total, inverse = _sums(data)
    level = _levels(total, inverse)
    level[data == _GAP] = 0
    level[last] = _NONE
    row = np.repeat(np.arange(len(texts), dtype=np.int32), size + WINDOW - 1)
    row = np.concatenate([np.zeros(WINDOW - 1, np.int32), row])[:len(data)]
    real = (data != _GAP) & (level < _NONE)
    counts = np.bincount(row[real] * np.int64(_NONE) + level[real], minlength=len(texts) * _NONE).reshape(len(texts), _NONE)
    lowest = _lowest(counts)
    signs = []
    for up in (0, 1):
        end = np.flatnonzero((level >= (lowest + up)[row]) & (data != _GAP))
        start = np.empty_like(end)
        start[0], start[1:] = 0, end[:-1] + 1
        start = np.maximum(start, first[row[end]])
        code = _codes((total[end + 1] - total[start]) * inverse[start], end - start + 1)
        pairs, cuts = _PAIR[code].tobytes().decode(), 2 * np.searchsorted(row[end], np.arange(len(texts) + 1))
        signs.append([pairs[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
    return [f"{k}:{x}:{y}" for k, x, y in zip(lowest.tolist(), *signs)]


def _long_fingerprint(text: bytes) -> str:
    """The same of one long text, window by window."""
    data = np.frombuffer(text, np.uint8)
    n, step = len(data), tk.CHUNK
    level = np.empty(n, np.uint8)
    for a in range(0, n, step):
        before = min(a, WINDOW - 1)
        level[a:a + step] = _levels(*_sums(data[a - before:a + step]))[before:]
    level[-1] = _NONE
    k = int(_lowest(np.bincount(level, minlength=_NONE)[None, :_NONE])[0])
    ends = np.flatnonzero(level >= k)
    hashes, held, at = [], 0, 0             # hash and first byte of the piece that is open
    for a in range(0, n, step):
        total, inverse = _sums(data[a:a + step])
        stop = min(a + step, n)
        for e in ends[np.searchsorted(ends, a):np.searchsorted(ends, stop)].tolist():
            hashes.append(_join(held, total, inverse, at, a, e + 1))
            held, at = 0, e + 1
        held = _join(held, total, inverse, at, a, stop)
    hashes = np.array(hashes, np.uint64)
    code = _codes(hashes, np.diff(ends, prepend=-1))
    one = _PAIR[code].tobytes().decode()
    coarse = np.flatnonzero(level[ends] >= k + 1)
    joined, starts = [], np.concatenate([[0], ends[:-1] + 1])
    power = lambda m: pow(tk._BASE, int(m), 1 << 64)
    for i, j in zip(np.concatenate([[0], coarse[:-1] + 1]), coarse):
        joined.append(sum(int(hashes[x]) * power(starts[x] - starts[i]) for x in range(i, j + 1)) % (1 << 64))
    two = _PAIR[_codes(np.array(joined, np.uint64), np.diff(ends[coarse], prepend=-1))].tobytes().decode()
    return f"{k}:{one}:{two}"


def _join(held: int, total: np.ndarray, inverse: np.ndarray, at: int, a: int, stop: int) -> int:
    """Hash of the bytes from ``at`` to ``stop``: what was held up to the window's start ``a``, and the window's share."""
    s = max(at, a)
    if stop <= s:
        return held
    part = int(total[stop - a] - total[s - a]) * int(inverse[s - a])
    return (held + part * pow(tk._BASE, s - at, 1 << 64)) % (1 << 64)


def fingerprints(texts: list[str | None]) -> list[str]:
    """The fingerprint of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out, group, size = ["0::"] * len(raw), [], 0

    def flush():
        if group:
            for i, f in zip(group, _short_fingerprints([raw[i] for i in group])):
                out[i] = f

    with np.errstate(over="ignore"):
        for i, t in enumerate(raw):
            if len(t) > tk.CHUNK:
                out[i] = _long_fingerprint(t)
            elif t:
                group.append(i)
                size += len(t) + WINDOW
                if size >= tk.CHUNK:
                    flush()
                    group, size = [], 0
        flush()
    return out


def _read(fingerprint: str) -> tuple[int, str, str]:
    level, one, two = fingerprint.split(":")
    return int(level), one, two


def _matrix(signs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(s) // 2 for s in signs], np.int64)
    out = np.full((len(signs), PIECES), 0xFFFF, np.uint16)
    flat = np.array([_CODE[s[i:i + 2]] for s in signs for i in range(0, len(s), 2)], np.uint16)
    out[np.arange(PIECES) < size[:, None]] = flat
    return out, size


def signature_likeness(a: list[str], b: list[str]) -> np.ndarray:
    """One less the edit distance over the longer length, of non-empty signatures; 0 without a common run (bit-parallel, a pair per lane)."""
    p, m = _matrix(a)
    t, n = _matrix(b)
    one, zero = np.uint64(1), np.uint64(0)
    top = (m - 1).astype(np.uint64)
    plus, minus = np.full(len(a), ~zero), np.zeros(len(a), np.uint64)
    distance, runs = m.copy(), [np.zeros(len(a), np.uint64) for _ in range(RUN)]
    shared = np.zeros((RUN, len(a)), bool)
    for j in range(int(n.max(initial=0))):
        live = j < n
        eq = np.packbits((p == t[:, j:j + 1]) & live[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        for r in range(RUN - 1, 0, -1):
            runs[r] = (runs[r - 1] << one) & eq
        runs[0] = eq
        for r in range(RUN):
            shared[r] |= runs[r] != 0
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus), plus & xh
        distance += np.where(live, ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64), 0)
        up, down = (up << one) | one, down << one
        plus, minus = down | ~(xv | up), up & xv
    need = np.minimum(RUN, (np.minimum(m, n) + 1) // 2) - 1
    return np.where(shared[need, np.arange(len(a))], 1 - distance / np.maximum(m, n), 0.0)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of each two fingerprints, 0 to 1."""
    out = np.zeros(len(a))
    pairs, left, right = [], [], []
    for i, (x, y) in enumerate(zip(a, b)):
        if x == y:
            out[i] = 1.0
            continue
        (j, x1, x2), (k, y1, y2) = _read(x), _read(y)
        both = [(x1, y1), (x2, y2)] if j == k else [(x2, y1)] if j + 1 == k else [(x1, y2)] if k + 1 == j else []
        for s, t in both:
            if s and t:
                pairs.append(i)
                left.append(s)
                right.append(t)
    if pairs:
        with np.errstate(over="ignore"):
            np.maximum.at(out, pairs, signature_likeness(left, right))
    return out


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of a text column; one scan."""
    @F.pandas_udf("string")
    def of(column):
        import pandas as pd
        return pd.Series(fingerprints([t if isinstance(t, str) else None for t in column]))
    return df.withColumn(name, of(F.col(f"`{text}`").cast("string")))


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns; null if one is null."""
    @F.pandas_udf("double")
    def of(x, y):
        import pandas as pd
        known = x.notna() & y.notna()
        out = pd.Series([None] * len(x), dtype="float64")
        out[known] = likeness(x[known].tolist(), y[known].tolist())
        return out
    return of(a, b)


def edit_tail(text: str, following: str) -> str:
    """``text`` whose last quarter of code points is replaced by the first as many (or all) of ``following``."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
#: Beside the results: kind 0 a result, 1 the first row of a partition, 2 its last row, which still lacks its next.
_ROWS = RESULT + ", kind int, part int, text string"
_ROWS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                         ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
                         ("kind", pa.int32()), ("part", pa.int32()), ("text", pa.string())])
_RESULT_ARROW = pa.schema(list(_ROWS_ARROW)[:7])
#: Characters of text handled together.
BLOCK = 4 << 20


def _compared(ids: list, texts: list[str], following: list[str], known: list[str] | None = None) -> list[list]:
    """Columns of the result; ``known`` are the fingerprints of ``texts`` and of the last row's next."""
    edited = [edit_tail(t, f) for t, f in zip(texts, following)]
    own = known or fingerprints(texts + following[-1:])
    changed = fingerprints(edited)
    size = len(texts)
    near = likeness(own[:size] * 2, changed + own[1:size + 1])
    return [ids, [len(t) for t in texts], [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            own[:size], changed, near[:size].tolist(), near[size:].tolist()]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of an ordered partition against the row after it; the first and the last row go along for the neighbours."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()

    def edge(i, text, kind):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([i] + [None] * 6 + [kind, part, text], _ROWS_ARROW.types)],
                                          schema=_ROWS_ARROW)

    def block(ids, texts):
        columns = _compared(ids[:-1], texts[:-1], texts[1:])
        m = len(ids) - 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns + [[0] * m, [part] * m, [None] * m], _ROWS_ARROW.types)],
                                          schema=_ROWS_ARROW)

    ids, texts, held, begun = [], [], 0, False
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not begun:
                yield edge(i, t, 1)
                begun = True
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= BLOCK and len(ids) > 1:
                yield block(ids, texts)
                ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
    if len(ids) > 1:
        yield block(ids, texts)
    if begun:
        yield edge(ids[-1], texts[-1], 2)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (doc_id, text, next text) of rows parted by a partition's end."""
    for b in batches:
        for i, t, f in zip(*[c.to_pylist() for c in b.columns]):
            columns = _compared([i], [t], [f], fingerprints([t, f]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _RESULT_ARROW.types)], schema=_RESULT_ARROW)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` against its edited text and against the next row (``RESULT``).

    The rows are range-partitioned once by (doc_id, text hash) and streamed in order; only the first and the last
    row of each partition meet their neighbours in a join.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    done = Scratch(spark).keep(rows.select("doc_id", "text").mapInArrow(_stream, _ROWS), "fingerprints")
    heads = done.filter("kind = 1").select("part", F.col("text").alias("following"))
    order = Window.orderBy("part")          # one row per partition of the shuffle
    after = heads.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    tails = (done.filter("kind = 2").select("doc_id", "text", "part").join(after, "part")
             .join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following"))
    columns = [f.name for f in _RESULT_ARROW]
    return done.filter("kind = 0").select(*columns).unionByName(tails.mapInArrow(_edges, RESULT))
