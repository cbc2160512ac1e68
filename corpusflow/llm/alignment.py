"""Cross-tokenizer alignment by sparse products of token-byte incidence matrices.

Text is encoded by two tokenizers, A (byte-level BPE) and B (pieces with byte fallback).  Row ``i`` of a
tokenizer's incidence matrix has a one for each byte of its ``i``-th token, in hand-built compressed sparse rows
(:class:`Csr`).  ``A B'``, computed row by row as sums of scaled rows of ``B'`` (:func:`product`), has an entry
for every two tokens that overlap: an overlap link, and how many bytes they share.  Offsets where a token of each
side ends cut the tokens into groups; with the token-group incidence matrices, ``GA GB'`` has an entry for every two
tokens of a group (a shared-group link).

Digests need each id pair's count over the whole corpus.  A task packs documents; a pack sends each of its distinct
pairs once, with its count, to be summed, and gets back total and rank.  Its documents' own entries, as indices
into the pack's list of pairs, wait in a written table.  Nothing that grows with the corpus is broadcast, and no
pair costs a row per document.

Defined results: null and empty texts, and texts whose tokens' bytes don't join to a space and the text, have no
tokens and take no part in the counts; repeated rows count each; a null doc_id is a document like any other; an
empty table gives no rows; extra columns are ignored.  Special tokens' strings in a text are plain text.  Texts
longer than ``CHUNK`` characters are encoded in pieces cut at a space between words, which no token of
either tokenizer spans (checked when a model is read); only a longer stretch without such a place is encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusflow.llm.helpers import Scratch

#: Characters of one encoded piece of a text, and of pieces that are multiplied together.
CHUNK, BLOCK = 1 << 18, 1 << 19
#: Tokens of A kept with the parts of texts they encode.
REMEMBER = 2_000_000
#: (document, pair) entries of a pack, and documents.
ENTRIES, DOCS = 4_000_000, 50_000
#: Products of a block of rows.
PRODUCTS = 1 << 20


class Csr(NamedTuple):
    """A sparse matrix in compressed rows: the entries of row i are at ``indptr[i]:indptr[i + 1]``, columns ascending."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of_entries(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))


def transpose(m: Csr) -> Csr:
    """Entries ordered by column; rows stay ascending within a column."""
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.columns))])
    return Csr(indptr, m.row_of_entries()[order], m.data[order], m.rows)


def product_blocks(x: Csr, y: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of the entries of ``x y`` in row order.

    Row i is the sum of the rows k of ``y``, each scaled by ``x[i, k]``.  Blocks of rows with about ``PRODUCTS``
    products are expanded together, and equal columns of a row summed.
    """
    per_entry = np.diff(y.indptr)[x.indices]
    upto = np.concatenate([[0], np.cumsum(per_entry)])
    row_ends, row_of = upto[x.indptr], x.row_of_entries()
    at = 0
    while at < x.rows:
        end = max(at + 1, int(np.searchsorted(row_ends, row_ends[at] + PRODUCTS, "right")) - 1)
        a, b = x.indptr[at], x.indptr[end]
        times = per_entry[a:b]
        place = np.arange(upto[b] - upto[a]) + np.repeat(y.indptr[x.indices[a:b]] - (upto[a:b] - upto[a]), times)
        row, column = np.repeat(row_of[a:b], times), y.indices[place]
        value = np.repeat(x.data[a:b], times) * y.data[place]
        at = end
        if not len(row):
            continue
        key = row * y.columns + column
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield key[first] // y.columns, key[first] % y.columns, np.add.reduceat(value, first)


def product(x: Csr, y: Csr) -> Csr:
    """``x y`` as one matrix."""
    parts = list(product_blocks(x, y))
    row, column, value = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    return Csr(np.searchsorted(row, np.arange(x.rows + 1)), column, value, y.columns)


def row_products(x: Csr, y: Csr) -> np.ndarray:
    """Entries of each row of ``x y`` if no column of a row is met twice: the product with a vector of ones, nothing expanded."""
    upto = np.concatenate([[0], np.cumsum(np.diff(y.indptr)[x.indices])])
    return np.diff(upto[x.indptr])


def byte_incidence(ends: np.ndarray, n_bytes: int) -> Csr:
    """Token x byte: consecutive tokens that end at ``ends`` cover all bytes."""
    return Csr(np.concatenate([[0], ends]), np.arange(n_bytes), np.ones(n_bytes, np.int64), n_bytes)


def group_incidence(closes: np.ndarray) -> Csr:
    """Token x group, from which tokens close a group."""
    upto = np.cumsum(closes)
    return Csr(np.arange(len(closes) + 1), upto - closes, np.ones(len(closes), np.int64), int(upto[-1]) if len(upto) else 0)


class Pair:
    """Both tokenizers, read from the contents of their files."""

    _made: dict = {}

    def __init__(self, byte_json: bytes, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(byte_json.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
        self.bytes_a: list = [None] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # decimal ids by what follows them in a group listing
        self.text_a = np.array([f"{i}{s}" for s in ",|" for i in range(len(self.bytes_a))], object)
        self.text_b = np.array([f"{i}{s}" for s in (",", ";", "") for i in range(len(self.bytes_b))], object)
        split = json.loads(byte_json).get("pre_tokenizer") or {}
        self.cuts = (split.get("type") == "ByteLevel" and split.get("use_regex", True)
                     and not any(re.search("[^▁]▁", p) for p in pieces))
        self._forget()

    @classmethod
    def of(cls, files: tuple[bytes, bytes]) -> "Pair":
        key = tuple(hashlib.sha256(f).digest() for f in files)
        if key not in cls._made:
            cls._made[key] = cls(*files)
        return cls._made[key]

    _BETWEEN = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")

    def pieces(self, text: str) -> list[str]:
        """The text cut before spaces between words, about ``CHUNK`` characters each."""
        out, at = [], 0
        while self.cuts and len(text) - at > CHUNK:
            cut = self._BETWEEN.search(text, at + CHUNK)
            if not cut:
                break
            out.append(text[at:cut.start()])
            at = cut.start()
        return out + [text[at:]]

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}             # a part's place; the empty one has no tokens
        self.good = np.zeros(1, bool)
        self.ids = [np.zeros(0, np.int64)] * 2
        self.size = [np.zeros(1, np.int64)] * 2

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts, each as it follows a space."""
        a = [e.ids for e in self.a.encode_batch([" " + p for p in parts], add_special_tokens=False)]
        b = self.b.encode(parts, num_threads=1)          # B puts the space itself
        good = []
        for p, x, y in zip(parts, a, b):
            raw = b" " + p.encode("utf-8", "surrogatepass")
            good.append(b"".join([self.bytes_a[i] for i in x]) == raw and b"".join([self.bytes_b[i] for i in y]) == raw)
        self.good = np.append(self.good, good)
        for side, ids in enumerate((a, b)):
            self.ids[side] = np.append(self.ids[side], np.fromiter((i for x in ids for i in x), np.int64))
            self.size[side] = np.append(self.size[side], [len(x) for x in ids])

    def encode(self, pieces: list[tuple[str, bool]]) -> "Coded":
        """Tokens of each (piece, is its text's first); a piece whose tokens don't join to its bytes has none.

        A piece is cut at its spaces between words; equal parts are encoded once, until ``REMEMBER`` tokens are held.
        """
        if len(self.ids[0]) > REMEMBER:
            self._forget()
        known, flat, count, new = self.known, [], [], []
        for p, first in pieces:
            p = p if first else p[1:]
            parts = self._BETWEEN.split(p) if self.cuts else [p]
            for w in parts:
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
            flat += [known[w] for w in parts]
            count.append(len(parts))
        if new:
            self._learn(new)
        part, count = np.array(flat, np.int64), np.array(count, np.int64)
        first = np.cumsum(count) - count
        good = np.logical_and.reduceat(self.good[part], first) if len(count) else np.zeros(0, bool)
        part, of = part[np.repeat(good, count)], np.repeat(np.arange(len(count)), count * good)
        out = [good]
        for side in (0, 1):
            size = self.size[side]
            start = np.cumsum(size) - size
            n = size[part]
            place = np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += [self.ids[side][place], np.concatenate([[0], np.cumsum(np.bincount(of, n, len(count)).astype(np.int64))])]
        return Coded(*out)


class Coded(NamedTuple):
    """Per piece whether it has tokens; ids of both sides in a row, and where each piece's begin."""

    good: np.ndarray
    a: np.ndarray
    first_a: np.ndarray
    b: np.ndarray
    first_b: np.ndarray


class Aligned:
    """Some pieces' tokens on one byte axis: ids, ends, group cuts and where each piece begins."""

    def __init__(self, pair: Pair, coded: Coded):
        self.pair = pair
        _, self.a, self.first_a, self.b, self.first_b = coded
        self.end_a, self.end_b = np.cumsum(pair.len_a[self.a]), np.cumsum(pair.len_b[self.b])
        n = int(self.end_a[-1]) if len(self.end_a) else 0
        ends = np.zeros((2, n + 1), bool)
        ends[0, self.end_a], ends[1, self.end_b] = True, True
        cut_a, cut_b = ends[1, self.end_a], ends[0, self.end_b]
        self.cuts = self.end_a[cut_a]
        self.ga, self.gb = group_incidence(cut_a), group_incidence(cut_b)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, bytes both hold) of every overlap link: entries of A B'."""
        n = int(self.end_a[-1]) if len(self.end_a) else 0
        return product_blocks(byte_incidence(self.end_a, n), transpose(byte_incidence(self.end_b, n)))

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of every two tokens of one group: entries of GA GB'."""
        return product_blocks(self.ga, transpose(self.gb))

    def listings(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each piece."""
        va, vb = len(self.pair.bytes_a), len(self.pair.bytes_b)
        group_a, group_b = self.ga.indices, self.gb.indices
        last_a = np.append(group_a[1:] != group_a[:-1], True)
        last_b = np.append(group_b[1:] != group_b[:-1], True).astype(np.int64)
        last_b[(self.first_b[1:] - 1)[self.first_b[1:] > 0]] = 2
        before_b = np.searchsorted(group_b, np.arange(len(self.cuts)))          # B tokens of earlier groups
        upto_a = np.searchsorted(group_a, np.arange(len(self.cuts)), "right")   # A tokens up to this group
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + before_b[group_a]] = self.pair.text_a[self.a + va * last_a]
        out[np.arange(len(self.b)) + upto_a[group_b]] = self.pair.text_b[self.b + vb * last_b]
        out, at = out.tolist(), (self.first_a + self.first_b).tolist()
        return ["".join(out[i:j]) for i, j in zip(at[:-1], at[1:])]


_DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256"]
_PACKED = ("kind int, pack long, pair long, n long, payload binary, doc_id array<long>, n_a array<long>, n_b array<long>, "
           "n_groups array<long>, n_links array<long>, n_shared array<long>, groups_sha256 array<string>")
_PACKED_ARROW = pa.schema([("kind", pa.int32()), ("pack", pa.int64()), ("pair", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()),
                           *[(c, pa.list_(pa.int64())) for c in _DOC[:-1]], (_DOC[-1], pa.list_(pa.string()))])
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_shared long"
_RESULT_ARROW = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                           ("groups_sha256", pa.string()), ("n_shared", pa.int64())])


def _pieces(pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, piece, first, last) of every text in turn; a text without characters is one empty piece."""
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            parts = pair.pieces(t) if t else [""]
            for k, p in enumerate(parts):
                yield i, p, k == 0, k == len(parts) - 1


def _blocks(pair: Pair, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for p in _pieces(pair, batches):
        held.append(p)
        size += len(p[1]) + 100
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Pack:
    """Documents and their (document, id pair, links) entries until there are enough for a pack."""

    def __init__(self, pair: Pair):
        self.pair, self.open = pair, None
        self.clear()

    def clear(self):
        self.docs, self.good = [], []
        self.slots, self.pairs, self.links = [], [], []
        self.entries = 0

    def add(self, block: list[tuple]) -> None:
        coded = self.pair.encode([(p, first) for _, p, first, _ in block])
        joined = Aligned(self.pair, coded)
        n_a, n_b = np.diff(joined.first_a), np.diff(joined.first_b)
        listings = joined.listings()
        piece_a = np.repeat(np.arange(len(block)), np.diff(joined.first_a))
        n_groups = np.bincount(piece_a[np.append(np.diff(joined.ga.indices) > 0, True)[:len(piece_a)]], minlength=len(block))
        n_shared = np.bincount(piece_a, row_products(joined.ga, transpose(joined.gb)), len(block)).astype(np.int64)
        n_links = np.zeros(len(block), np.int64)
        wide = len(self.pair.bytes_a) * len(self.pair.bytes_b)
        keys, counts = [], []
        for i, j, _ in joined.overlaps():
            n_links += np.bincount(piece_a[i], minlength=len(block))
            key, count = np.unique(piece_a[i] * wide + joined.a[i] * len(self.pair.bytes_b) + joined.b[j], return_counts=True)
            keys.append(key)
            counts.append(count)
        slot_of = np.empty(len(block), np.int64)
        for k, (doc, _, first, _) in enumerate(block):
            if first:
                self.docs.append([doc, 0, 0, 0, 0, 0, hashlib.sha256()])
                self.good.append(True)
            slot_of[k] = len(self.docs) - 1
            row = self.docs[-1]
            if not coded.good[k]:
                self.good[-1] = False
            else:
                row[6].update((b"" if first else b";") + listings[k].encode())
                for c, v in zip(range(1, 6), (n_a[k], n_b[k], n_groups[k], n_links[k], n_shared[k])):
                    row[c] += int(v)
        if keys:
            key, count = np.concatenate(keys), np.concatenate(counts)
            self.slots.append(slot_of[key // wide])
            self.pairs.append(key % wide)
            self.links.append(count)
            self.entries += len(key)

    def full(self) -> bool:
        return self.entries >= ENTRIES or len(self.docs) >= DOCS

    def batches(self, pack: int) -> Iterator[pa.RecordBatch]:
        good = np.array(self.good, bool)
        slot, pair, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.slots, self.pairs, self.links))
        keep = good[slot]
        slot, pair, n = slot[keep], pair[keep], n[keep]
        value, index = np.unique(pair, return_inverse=True)
        total = np.bincount(index, n, len(value)).astype(np.int64)
        step = np.diff(index, prepend=0).astype("<i4")
        payload = zlib.compress(np.bincount(slot, minlength=len(good)).astype("<i4").tobytes() + step.tobytes() + n.astype("<i4").tobytes(), 1)
        rows = [r[:6] + [r[6].hexdigest()] if ok else [r[0], 0, 0, 0, 0, 0, ""] for r, ok in zip(self.docs, good)]
        columns = [pa.array([list(c)], t) for c, t in zip(zip(*rows), _PACKED_ARROW.types[5:])]
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([pack]), pa.nulls(1, pa.int64()), pa.array([len(value)]),
                                          pa.array([payload], pa.binary()), *columns], schema=_PACKED_ARROW)
        for at in range(0, len(value), 10_000):
            v, t = value[at:at + 10_000], total[at:at + 10_000]
            m = len(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(np.full(m, pack)), pa.array(v), pa.array(t),
                                              *[pa.nulls(m, k) for k in _PACKED_ARROW.types[4:]]], schema=_PACKED_ARROW)


def _packs(files):
    """Per pack: one row of kind 2 (its documents and their entries), and a row of kind 1 for each distinct id pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, seq = TaskContext.get().partitionId() << 24, 0
        held = _Pack(Pair.of(files.value))
        for block in _blocks(held.pair, batches):
            held.add(block)
            if block[-1][3] and held.full():       # only after a text's last piece
                yield from held.batches(base + seq)
                held.clear()
                seq += 1
        if held.docs:
            yield from held.batches(base + seq)
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pack, in order: its pairs' totals (kind 1), then its documents (kind 2)."""
    totals, best = [], []
    for b in batches:
        kind = b.column(0).to_numpy()
        n, top = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
        at = 0
        for k in np.flatnonzero(kind == 2).tolist():
            count = np.concatenate([*totals, n[at:k]]).astype(np.int64)
            is_best = np.concatenate([*best, top[at:k]]).astype(np.int64)
            totals, best, at = [], [], k + 1
            docs = [b.column(i)[k].as_py() for i in range(6, 13)]
            raw = np.frombuffer(zlib.decompress(b.column(5)[k].as_py()), "<i4").astype(np.int64)
            m = len(docs[0])
            entries = (len(raw) - m) // 2
            slot, index, links = np.repeat(np.arange(m), raw[:m]), np.cumsum(raw[m:m + entries]), raw[m + entries:]
            sums = [np.zeros(m, np.int64) for _ in range(2)]
            np.add.at(sums[0], slot, links * is_best[index])
            np.add.at(sums[1], slot, links * count[index])
            columns = [*docs[:5], sums[0], sums[1], docs[6], docs[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RESULT_ARROW.types)], schema=_RESULT_ARROW)
        totals.append(n[at:])
        best.append(top[at:])


def read_files(*paths: str) -> tuple[bytes, ...]:
    """Contents of vocabulary files; executors get them from the driver, never by a path."""
    out = []
    for p in paths:
        with open(p, "rb") as f:
            out.append(f.read())
    return tuple(out)


def alignment_digests(docs: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: tokens, groups and links, and the links' corpus-wide counts (``RESULT``)."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(read_files(byte_json, piece_model))     # two vocabulary files, whatever the corpus
    size_b = len(Pair.of(files.value).bytes_b)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packs = Scratch(spark).keep(rows.mapInArrow(_packs(files), _PACKED), "alignment")
    pairs = packs.filter("kind = 1").select("pack", "pair", "n")
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % size_b)
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    ranked = counts.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    back = pairs.join(ranked, "pair").select(F.lit(1).alias("kind"), "pack", "pair", F.col("total").alias("n"), "best")
    bodies = packs.filter("kind = 2").drop("pair")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (back.unionByName(bodies, allowMissingColumns=True).select("kind", "pack", "pair", "n", "best", "payload", *_DOC)
               .repartition(n, "pack").sortWithinPartitions("pack", "kind", "pair"))
    return ordered.mapInArrow(_digests, RESULT)


LINKS = "doc_id long, a_pos long, b_pos long, a_id int, b_id int, overlap int, shared_group long"
_LINKS_ARROW = pa.schema([("doc_id", pa.int64()), ("a_pos", pa.int64()), ("b_pos", pa.int64()), ("a_id", pa.int32()), ("b_id", pa.int32()),
                          ("overlap", pa.int32()), ("shared_group", pa.int64())])


def links(docs: DataFrame, byte_json: str, piece_model: str, shared: bool = False) -> DataFrame:
    """Every overlap link of every row (``LINKS``); with ``shared``, every shared-group link, ``overlap`` null.

    Positions count from 0 in the whole text, groups too.  A text without tokens gives no links.
    """
    files = docs.sparkSession.sparkContext.broadcast(read_files(byte_json, piece_model))

    def run(batches):
        pair = Pair.of(files.value)
        for i, text in ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t):
            parts = pair.pieces(text)
            if not all(pair.encode([(p, k == 0)]).good[0] for k, p in enumerate(parts)):
                continue
            base = [0, 0, 0]
            for k, p in enumerate(parts):
                one = Aligned(pair, pair.encode([(p, k == 0)]))
                for a, b, over in one.shared() if shared else one.overlaps():
                    over = pa.nulls(len(a), pa.int32()) if shared else pa.array(over, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(a), pa.int64()), pa.array(a + base[0]), pa.array(b + base[1]), pa.array(one.a[a], pa.int32()),
                         pa.array(one.b[b], pa.int32()), over,
                         pa.array(np.where(one.ga.indices[a] == one.gb.indices[b], one.ga.indices[a] + base[2], -1))], schema=_LINKS_ARROW)
                base = [base[0] + len(one.a), base[1] + len(one.b), base[2] + len(one.cuts)]

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, LINKS)
