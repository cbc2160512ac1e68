"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

1. Each text becomes its set of distinct ``k``-word shingles (64-bit hashes).
   Documents are packed; a pack sends each of its distinct shingles once, with the number of its
   documents that hold it, to the shingle's bucket.  There, every shingle's
   document frequency is known, and only shingles of two or more documents go
   back, once to each pack that has them.  A shared shingle is by definition one of them, so
   these lists are enough for exact intersections.  However many documents share a line, a bucket gets
   no more of it than one entry per pack.
2. With shingles ordered by frequency, linked sets share one of their first
   ``n - ceil(t n) + 1`` shingles.  A document whose unique shingles fill that
   prefix can link with nothing and leaves.  Equal sets are one class, found by
   a 128-bit set digest.
3. A tile is (prefix shingle, size band).  Bands grow by 1 / t, so a set meets its
   own band and the next.  Tiles over ``TILE`` members are dealt over blocks of about ``TILE``.
   In a tile, the popcount of two XORed parity bitmaps bounds the symmetric
   difference from below, hence the overlap from above; pairs past the bound
   are verified exactly on sorted arrays.
4. Two rounds keep the pairs few without losing a link: the first verifies, per
   block, a spanning forest of the pairs past the bound, and again among one
   representative per component of a tile of several blocks while that joins
   components; the second verifies every pair past the bound whose ends are still
   in different components, in every tile.  There, two blocks at a time meet, so
   that a task holds about ``2 * TILE`` members and a tile has each pair once.
   Components of the verified links are then those of all links.

Shingles are 64-bit hashes, whatever the number of buckets, and sets 128-bit digests of them: two different shingles
agree with a chance of about 2**-64.  Everything else is exact.

Defined results: null, empty and wordless texts have an empty set and link with
nothing; a text of fewer than ``k`` words has its whole sequence as one shingle;
repeated rows keep their rows and share a component; rows of one doc_id with
different texts are different documents; a null doc_id links like any other but
is never the smallest of its component, unless all are null; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusflow.llm import graph, helpers, textkernel as tk
from corpusflow.session import scratch_path

#: Members compared with each other in one block of a tile.
TILE = 1024
#: Representatives are compared again while their number falls to this share or less.
SHRINK = 0.9
#: Bits of the widest bitmap.
WIDEST = 2048
#: Bytes of text whose shingles are packed together, and most documents in such a pack.
PACK_BYTES, PACK_DOCS = 16 << 20, 60_000
#: Bytes of payload in a batch of results, and shingles of a pack's documents that are looked up at a time.
BATCH_BYTES, BLOCK = 4 << 20, 1 << 18


def bands(t_num: int, t_den: int, top: int) -> np.ndarray:
    """First set size of each band: a set's partners lie in its own band or a neighbouring one."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * t_den // t_num + 1)
    return np.array(out, np.int64)


def bitmap_bits(n: int) -> int:
    """Bits of the parity bitmap of a set of ``n``: a power of two from 64 to WIDEST, above n where possible."""
    return min(WIDEST, max(64, 1 << int(n).bit_length()))


def parity_bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    """Bit i is the parity of the items that hash to i; halves XORed together give the narrower bitmap."""
    at = (tk.mix(items) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bitmap: np.ndarray, bits: int) -> np.ndarray:
    while len(bitmap) * 64 > bits:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow column."""
    for _, data, offsets in tk.text_chunks(column):
        h, rows, _, _ = tk.words(data, offsets, tk.BLANK)
        s, of = tk.shingles(h, rows, k)
        order = np.argsort(of, kind="stable")
        s, of = s[order], of[order]
        cuts = np.searchsorted(of, np.arange(len(offsets)))
        for r in range(len(offsets) - 1):
            yield np.unique(s[cuts[r]:cuts[r + 1]])


PACKS = "bucket int, pack long, kind int, payload binary"
_PACKS = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
_DOCS = np.dtype([("id", "<i8"), ("null", "u1"), ("key", "<i8"), ("n", "<i8"), ("d1", "<u8"), ("d2", "<u8")])


def _planes(values: np.ndarray) -> bytes:
    """Little-endian numbers byte by byte, all lowest bytes first: what sorted or small numbers have in common compresses."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplanes(payload: bytes, dtype: str, n: int, at: int) -> tuple[np.ndarray, int]:
    """(numbers, place after them) of ``n`` numbers written by :func:`_planes` at ``at``."""
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(payload, np.uint8, n * size, at).reshape(size, n).T
    return np.ascontiguousarray(raw).view(dtype).reshape(n), at + n * size


def _batches(rows: Iterable[tuple], schema: pa.Schema, payload: int) -> Iterator[pa.RecordBatch]:
    """Record batches of at most 2,000 rows, ended by the row whose ``payload`` (a column's number) fills BATCH_BYTES."""
    made, size = [], 0
    for r in rows:
        made.append(r)
        size += len(r[payload] or b"")
        if len(made) == 2000 or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)
            made, size = [], 0
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``parts``, sorted, the place of every shingle among them, and how often each comes.  Empties ``parts``:
    an array of a pack's size goes as soon as it isn't needed."""
    every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    parts.clear()
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    place = np.empty(len(every), np.uint32)
    place[order] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    del order
    value, first = every[new], np.flatnonzero(new)
    return value, place, np.diff(first, append=len(every)).astype("<u2")


#: Most buckets; each gets its share of every pack.
BUCKETS = 1 << 20


def _pack_sets(k: int, buckets: int):
    """Per pack: its distinct shingles by bucket, each with its number of documents (kind 0); and its documents with
    the places of their shingles among the pack's distinct ones (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, seq = TaskContext.get().partitionId() << 24, 0
        parts, table, held = [], [], 0
        # where each bucket's shingles begin: those of bucket b have (shingle >> 32) * buckets >> 32 == b
        edges = ((np.arange(buckets, dtype=np.uint64) << 32) + (buckets - 1)) // buckets << 32

        def flush():
            nonlocal table, held, seq
            pack, seq = base + seq, seq + 1
            docs, table, held = np.array(table, _DOCS), [], 0
            value, place, count = _distinct(parts)
            cuts = np.append(np.searchsorted(value, edges), len(value))
            for at in np.flatnonzero(np.diff(cuts)).tolist():
                x, y = int(cuts[at]), int(cuts[at + 1])
                yield at, pack, 0, np.int64(x).tobytes() + _planes(value[x:y].astype("<u8")) + _planes(count[x:y])
            m = len(value)
            del value, count
            step = np.diff(place, prepend=np.uint32(0))         # modulo 2**32
            begins = (np.cumsum(docs["n"]) - docs["n"])[docs["n"] > 0]
            step[begins] = place[begins]                # a document's places ascend
            del place
            yield pack % buckets, pack, 1, np.array([len(docs), m], "<i8").tobytes() + docs.tobytes() + _planes(step.astype("<u4"))

        for b in batches:
            for i, key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2), k)):
                with np.errstate(over="ignore"):
                    d1 = tk.mix(s).sum(dtype=np.uint64) if len(s) else np.uint64(0)
                    d2 = tk.mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) if len(s) else np.uint64(0)
                if len(s):
                    parts.append(s)
                table.append((i or 0, i is None, key, len(s), d1, d2))
                held += 8 * len(s)
                if held >= PACK_BYTES or len(table) >= PACK_DOCS:
                    yield from _batches(flush(), _PACKS, 3)
        if table:
            yield from _batches(flush(), _PACKS, 3)
    return run


def _by_key(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[list]]]:
    """Rows of each run of equal values in a sorted column."""
    now, rows = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for r in zip(*cols):
            if r[column] != now:
                if rows:
                    yield now, rows
                now, rows = r[column], []
            rows.append(r)
    if rows:
        yield now, rows


def _frequency_class(df: np.ndarray) -> np.ndarray:
    """Document frequencies in 255 classes that keep their order."""
    big = 128 + np.minimum(127, 8 * np.log2(np.maximum(df, 128) / 128))
    return np.where(df < 128, df, big).astype(np.uint8)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket, for each pack: its shingles that two or more documents hold, by place, with hash and frequency class."""

    def found():
        for bucket, rows in _by_key(batches, 0):
            packs = []
            for r in rows:
                if r[2] == 1:
                    yield r
                    continue
                m = (len(r[3]) - 8) // 10
                value, at = _unplanes(r[3], "<u8", m, 8)
                packs.append((r[1], int.from_bytes(r[3][:8], "little"), value, _unplanes(r[3], "<u2", m, at)[0]))
            rows.clear()
            if packs:
                value, of = np.unique(np.concatenate([p[2] for p in packs]), return_inverse=True)
                total = np.bincount(of, np.concatenate([p[3] for p in packs]), len(value)).astype(np.int64)
                classes, at = np.where(total > 1, _frequency_class(total), 0).astype(np.uint8), 0
                for pack, first, own, _ in packs:
                    mine = classes[of[at:at + len(own)]]
                    at += len(own)
                    keep = np.flatnonzero(mine)
                    if len(keep):
                        yield bucket, pack, 0, _planes((keep + first).astype("<u4")) + mine[keep].tobytes() + _planes(own[keep])
    return _batches(found(), _PACKS, 3)


SETS = "doc_id long, row_key long, n long, d1 long, d2 long, shared binary, prefix array<long>, bitmap binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shared", pa.binary()),
                   ("prefix", pa.list_(pa.int64())), ("bitmap", pa.binary())])


def _prefixes(t_num: int, t_den: int):
    """Per document: size and digest; and, unless unique shingles fill its prefix, its shared shingles and the rest of the prefix."""

    def found(batches):
        for _, rows in _by_key(batches, 1):
            body = next(r[3] for r in rows if r[2] == 1)
            m, distinct = np.frombuffer(body, "<i8", 2).tolist()
            docs = np.frombuffer(body, _DOCS, m, 16)
            ends = np.cumsum(docs["n"])
            step = _unplanes(body, "<u4", int(docs["n"].sum()), 16 + m * _DOCS.itemsize)[0]
            rank_of, hash_of = np.zeros(distinct, np.uint8), np.zeros(distinct, np.uint64)
            for _, _, kind, payload in rows:
                if kind == 0:
                    q = len(payload) // 13
                    at, end = _unplanes(payload, "<u4", q, 0)
                    rank_of[at] = np.frombuffer(payload, np.uint8, q, end)
                    hash_of[at] = _unplanes(payload, "<u8", q, end + q)[0]
            rows.clear()
            first = 0
            while first < m:            # some documents at a time: what is made of a shingle is many times its size
                done = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
                yield from documents(docs[first:last], step[done:int(ends[last - 1])].astype(np.int64), rank_of, hash_of)
                first = last

    def documents(docs, step, rank_of, hash_of):
        m = len(docs)
        owner = np.repeat(np.arange(m), docs["n"])
        upto = np.cumsum(step)
        begins = np.cumsum(docs["n"]) - docs["n"]
        place = upto - np.repeat(np.concatenate([[0], upto])[begins], docs["n"])
        shared_here = rank_of[place] > 0
        place, owner = place[shared_here], owner[shared_here]
        ids, cls, cuts = hash_of[place], rank_of[place], np.searchsorted(owner, np.arange(m + 1))
        for i, d in enumerate(docs):
            n = int(d["n"])
            shared = prefix = bitmap = None
            if n and len(ids):
                mine, rank = ids[cuts[i]:cuts[i + 1]], cls[cuts[i]:cuts[i + 1]]
                left = n - (-(-t_num * n // t_den)) + 1 - (n - len(mine))
                if left > 0:
                    prefix = mine[np.lexsort((mine, rank))[:left]].view(np.int64).tolist()
                    whole = np.sort(mine)
                    shared, bitmap = whole.tobytes(), parity_bitmap(whole, bitmap_bits(n)).tobytes()
            yield (None if d["null"] else int(d["id"]), int(d["key"]), n, int(d["d1"].view(np.int64)), int(d["d2"].view(np.int64)),
                   shared, prefix, bitmap)
    return lambda batches: _batches(found(batches), _SETS, 5)


class _Tile:
    """One block of a tile: members' nodes, sizes, homes (or visitors from the band below), components and bitmaps."""

    def __init__(self, rows: list, t_num: int, t_den: int):
        self.node = np.array([r[2] for r in rows], np.int64)
        self.n = np.array([r[3] for r in rows], np.int64)
        self.extra = np.array([r[4] for r in rows], np.int64)   # members' singles: n minus shared shingles
        self.home = np.array([r[5] for r in rows], bool)
        self.comp = np.array([r[6] for r in rows], np.int64)
        self.main = np.array([r[7] for r in rows], bool)
        self.side = np.array([r[10] for r in rows], np.int64)   # 0: all meet; else 1 meets 2
        maps = [np.frombuffer(r[8], np.uint64) for r in rows]
        bits = min(len(m) for m in maps) * 64
        self.map = np.stack([fold(m, bits) for m in maps])
        self.t = t_num, t_den

    def past(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` may link with member i: the overlap's upper bound reaches the threshold."""
        a, b = self.t
        n, m = self.n[i], self.n[others]
        apart = np.bitwise_count(self.map[others] ^ self.map[i]).sum(axis=1, dtype=np.int64)
        apart += self.extra[i] + self.extra[others]          # unique shingles are never shared
        # overlap <= (n + m - apart) / 2, and linked means b * overlap >= a * (n + m - overlap)
        ok = (a + b) * (n + m - apart) >= 2 * a * (n + m)
        return others[ok & (self.home[i] | self.home[others]) & (self.node[others] != self.node[i])]


class _FewRows:
    """The same for a tile of a few members, on Python integers: most tiles hold two or three."""

    MOST = 12

    def __init__(self, rows: list, t_num: int, t_den: int):
        self.node, self.n, self.extra, self.home, self.comp, self.main = zip(*[r[2:8] for r in rows])
        self.side = [r[10] for r in rows]
        bits = 8 * min(len(r[8]) for r in rows)
        self.map = []
        for r in rows:
            x, k = int.from_bytes(r[8], "little"), 8 * len(r[8])
            while k > bits:
                k //= 2
                x = (x >> k) ^ (x & ((1 << k) - 1))
            self.map.append(x)
        self.t = t_num, t_den

    def past(self, i: int, j: int) -> bool:
        a, b = self.t
        if self.node[i] == self.node[j] or not (self.home[i] or self.home[j]):
            return False
        both = self.n[i] + self.n[j]
        apart = (self.map[i] ^ self.map[j]).bit_count() + self.extra[i] + self.extra[j]
        return (a + b) * (both - apart) >= 2 * a * both

    def forest(self) -> list[tuple[int, int]]:
        tree, out = list(range(len(self.node))), []
        order = sorted(range(len(self.node)), key=self.node.__getitem__)
        for y, j in enumerate(order):
            for i in order[:y]:
                if tree[i] != tree[j] and self.past(i, j):
                    out.append((self.node[i], self.node[j]))
                    old = tree[j]
                    tree = [tree[i] if t == old else t for t in tree]
        return out

    def crossing(self) -> list[tuple[int, int]]:
        few = range(len(self.node))
        return [(min(self.node[i], self.node[j]), max(self.node[i], self.node[j])) for j in few for i in few[:j]
                if self.comp[i] != self.comp[j] and (self.side[i] == 0 or self.side[i] != self.side[j]) and self.past(i, j)]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    now, rows = None, []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            key = r[0], r[1], r[9]
            if key != now:
                if len(rows) > 1:
                    yield rows
                now, rows = key, []
            rows.append(r)
    if len(rows) > 1:
        yield rows


def _pairs(found) -> Iterator[pa.RecordBatch]:
    a, b, size = [], [], 0
    for x, y in found:
        a.append(x)
        b.append(y)
        size += len(x)
        if size > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b, size = [], [], 0
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _forest(t_num: int, t_den: int):
    """First round: a spanning forest of the pairs past the bound, per block of a tile."""

    def found(batches):
        for rows in _tiles(batches):
            if len(rows) <= _FewRows.MOST:
                if pairs := _FewRows(rows, t_num, t_den).forest():
                    yield tuple(np.array(pairs, np.int64).T)
                continue
            tile = _Tile(rows, t_num, t_den)
            order = np.argsort(tile.node, kind="stable")     # the same trees in every tile that holds the same members
            free = np.ones(len(order), bool)
            for seed in order:
                if not free[seed]:
                    continue
                free[seed], queue = False, [seed]
                while queue:
                    i = queue.pop()
                    near = tile.past(i, np.flatnonzero(free))
                    if len(near):
                        free[near] = False
                        queue.extend(near.tolist())
                        x, y = np.full(len(near), tile.node[i]), tile.node[near]
                        yield np.minimum(x, y), np.maximum(x, y)
    return lambda batches: _pairs(found(batches))


def _crossing(t_num: int, t_den: int):
    """Second round: all pairs past the bound between different components, each once: within a block, or of two blocks."""

    def found(batches):
        for rows in _tiles(batches):
            if len(rows) <= _FewRows.MOST:
                if pairs := _FewRows(rows, t_num, t_den).crossing():
                    yield tuple(np.array(pairs, np.int64).T)
                continue
            tile = _Tile(rows, t_num, t_den)
            within = not tile.side.any()
            for i in np.flatnonzero(~tile.main if within else tile.side == 1):
                meets = tile.main | (np.arange(len(rows)) > i) if within else tile.side == 2
                near = tile.past(i, np.flatnonzero(meets & (tile.comp != tile.comp[i])))
                if len(near):
                    x, y = np.full(len(near), tile.node[i]), tile.node[near]
                    yield np.minimum(x, y), np.maximum(x, y)
    return lambda batches: _pairs(found(batches))


def _exact(t_num: int, t_den: int):
    """Verified pairs: sizes of exact sorted-array intersections decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, nb, x, y in zip(*[b.column(i).to_pylist() for i in range(2, 6)]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                keep.append(t_den * both >= t_num * (na + nb - both))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])
    return run


def _verify(pairs: DataFrame, sets: DataFrame, t: tuple[int, int]) -> DataFrame:
    side = lambda k: sets.select(F.col("node").alias(k), F.col("n").alias("n" + k), F.col("shared").alias("s" + k))
    rows = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    return rows.mapInArrow(_exact(*t), "a long, b long")


def _deal(entries: DataFrame, partitions: int) -> DataFrame:
    """Blocks of tiles brought together and streamed in order."""
    return (entries.select("sh", "block", "node", "n", "extra", "home", "comp", "main", "bitmap", "band", "side")
            .repartition(partitions, "sh", "block", "band").sortWithinPartitions("sh", "block", "band"))


def _representatives(entries: DataFrame, roots: DataFrame, turn: int) -> DataFrame:
    """One member per component of a tile of several blocks and components, dealt over blocks anew in each turn."""
    rows = entries.filter("blocks > 1").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    one = F.max(F.struct("home", "node", "n", "extra", "bitmap")).alias("x")
    rows = rows.groupBy("sh", "band", "comp").agg(one).select("sh", "band", "comp", "x.*")
    left = rows.groupBy("sh", "band").agg(F.count(F.lit(1)).alias("left")).filter("left > 1")
    block = F.pmod(F.hash("node", F.lit(turn)), F.ceil(F.col("left") / TILE).cast("int"))
    return rows.join(left, ["sh", "band"]).withColumn("block", block).withColumn("main", F.lit(False)).withColumn("side", F.lit(0)).drop("left")


def _apart(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Tiles of several components, dealt so that every pair of them meets once, but for pairs within the largest.

    Members of the largest component and the others have blocks of their own; each two blocks of others
    meet, and each of others with each of the largest.  A tile of one block stays whole.
    """
    joined = entries.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    shares = joined.groupBy("sh", "band", "comp").agg(F.count(F.lit(1)).alias("c"))
    blocks = lambda n: F.ceil(n / TILE).cast("long")
    most = (shares.groupBy("sh", "band").agg(F.max(F.struct("c", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("all"))
            .filter("comps > 1").select("sh", "band", F.col("m.comp").alias("largest"), blocks(F.col("m.c")).alias("mains"), blocks(F.col("all") - F.col("m.c")).alias("others")))
    joined = joined.join(most, ["sh", "band"]).withColumn("main", F.col("comp") == F.col("largest"))
    joined = joined.withColumn("part", F.pmod(F.hash("node").cast("long"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    at = lambda x, y, side: f"named_struct('block', ({x}) * (others + mains) + {y}, 'side', {side})"
    meets = F.expr(f"""CASE WHEN blocks = 1 THEN array(named_struct('block', 0L, 'side', 0))
        WHEN main THEN transform(sequence(0L, others - 1), i -> {at('i', 'others + part', '2')})
        ELSE concat(transform(sequence(0L, others - 1), i -> {at('least(part, i)', 'greatest(part, i)', 'CASE WHEN i = part THEN 0 WHEN part < i THEN 1 ELSE 2 END')}),
                    transform(sequence(0L, mains - 1), i -> {at('part', 'others + i', '1')})) END""")
    return joined.withColumn("at", F.explode(meets)).select("*", "at.block", "at.side").drop("at")


def similarity_classes(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), text: str = "text",
                       row_key: Column | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, row_key (as given), n_shingles, component_id and root.

    ``root`` is the same for the rows of one component and null for empty sets.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = min(4 * parts, BUCKETS)
    a, b = threshold

    scratch = helpers.Scratch(spark)
    kept = scratch.keep

    given = F.lit(0) if row_key is None else row_key
    packs = docs.select(F.col("doc_id").cast("long"), given.cast("long").alias("row_key"), F.col(text).cast("string").alias("text")).mapInArrow(_pack_sets(k, buckets), PACKS)
    packs = packs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, PACKS)
    packs = packs.repartition(parts, "pack").sortWithinPartitions("pack")
    every = kept(packs.mapInArrow(_prefixes(a, b), SETS), "sets")

    # equal sets are one node of the graph
    classes = kept(every.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least")), "classes")
    sets = (every.filter("shared IS NOT NULL").withColumn("size", F.octet_length("shared") / 8)
            .groupBy("d1", "d2").agg(F.first(F.struct("n", "shared", "prefix", "bitmap")).alias("x"))
            .select(F.col("d1").alias("node"), "x.*"))
    sets = kept(sets, "candidates")

    top = sets.agg(F.max("n")).first()[0] or 1
    edges = bands(a, b, top).tolist()      # one number per band
    band = F.expr("CASE " + " ".join(f"WHEN n < {e} THEN {i}" for i, e in enumerate(edges[1:])) + f" ELSE {len(edges)} END")
    members = sets.withColumn("band", band).withColumn("extra", (F.col("n") - F.octet_length("shared") / 8).cast("long"))
    entries = members.select(F.explode("prefix").alias("sh"), "node", "n", "extra", "band", "bitmap")
    entries = entries.select("sh", "node", "n", "extra", "bitmap", F.explode(F.array(
        F.struct(F.lit(True).alias("home"), F.col("band").alias("band")),
        F.struct(F.lit(False).alias("home"), (F.col("band") + 1).alias("band")))).alias("at")).select("*", "at.home", "at.band").drop("at")
    sizes = (entries.groupBy("sh", "band").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("home").cast("int")).alias("homes"))
             .filter("size > 1 AND homes > 0").select("sh", "band", "size"))
    entries = kept(entries.join(sizes, ["sh", "band"]).withColumn("blocks", F.ceil(F.col("size") / TILE).cast("int")), "entries")

    # first round
    one = entries.withColumn("block", F.pmod(F.hash("node"), F.col("blocks"))).withColumn("comp", F.col("node")).withColumn("main", F.lit(False)).withColumn("side", F.lit(0))
    links = kept(_verify(_deal(one, parts).mapInArrow(_forest(a, b), "a long, b long"), sets, threshold), "links")
    roots = graph.components(links)

    # the components of a large tile's blocks meet
    before = entries.filter("blocks > 1").count()
    for turn in itertools.count():
        few = _representatives(entries, roots, turn)
        now = few.count() if before else 0
        if not now or now > SHRINK * before:
            break
        before = now
        more = kept(_verify(_deal(few, parts).mapInArrow(_forest(a, b), "a long, b long"), sets, threshold), "links")
        if more.isEmpty():
            break
        links = links.union(more)
        roots = graph.components(links)

    # second round: what is still apart
    more = kept(_verify(_deal(_apart(entries, roots), parts).mapInArrow(_crossing(a, b), "a long, b long"), sets, threshold), "links")
    if not more.isEmpty():
        roots = graph.components(links.union(more))
    roots = kept(roots, "roots")
    scratch.drop("candidates", "entries", "links")

    named = classes.join(roots, classes["d1"] == roots["node"], "left").select("d1", "d2", "least", F.coalesce("root", "d1").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "root").select("d1", "d2", "component_id", "root")
    rows = every.select("doc_id", "row_key", F.col("n").alias("n_shingles"), "d1", "d2")
    linked = rows.filter("n_shingles > 0").join(named, ["d1", "d2"]).select("doc_id", "row_key", "n_shingles", "component_id", "root")
    alone = rows.filter("n_shingles = 0").select("doc_id", "row_key", "n_shingles", F.col("doc_id").alias("component_id"),
                                                 F.lit(None).cast("long").alias("root"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (of those, the smallest row hash); empty texts all stay.

    Rows are known by a 64-bit hash of id and text, so identical rows count as one.
    """
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    path = scratch_path(docs.sparkSession, "classes")
    similarity_classes(docs, k, threshold, row_key=key).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_key"))
    stay = rows.filter("root IS NOT NULL").groupBy("root").agg(first.alias("m")).select(F.col("m.row_key").alias("row_key"))
    out = rows.filter("root IS NOT NULL").select("row_key").distinct().join(stay, "row_key", "left_anti")
    out = helpers.checked_broadcast(out)
    kept = docs.join(out.withColumnRenamed("row_key", "__key"), key == F.col("__key"), "left_anti")
    twice = rows.filter("root IS NOT NULL").groupBy("row_key").count().filter("count > 1").select(F.col("row_key").alias("__key"))
    twice = twice.join(stay, F.col("__key") == stay["row_key"], "left_semi")
    if twice.isEmpty():
        return kept
    twice = helpers.checked_broadcast(twice)
    again = kept.join(twice, key == F.col("__key"), "left_semi").withColumn("__key", key).dropDuplicates(["__key"]).drop("__key")
    return kept.join(twice, key == F.col("__key"), "left_anti").unionByName(again)
