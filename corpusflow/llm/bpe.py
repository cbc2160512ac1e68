"""BPE encoding and decoding by a tokenization automaton.

The merge list is compiled into a deterministic automaton over tokens.  Its
states are the tokens themselves (the token just read); an arc ``x -> y``
says that ``y`` may follow ``x`` inside a word.  Compilation starts from the
base alphabet, where every symbol may follow every other, and applies the
merges in rank order.  The gadget of merge ``(u, v) -> w`` at rank ``r``

* adds state ``w``, which takes over the out-arcs of ``v`` and the in-arcs of
  ``u`` as they stand at rank ``r``,
* deletes the arc ``u -> v`` (after the out-arcs, before the in-arcs are taken over).

All arcs are laid down before the first word, as one table of bits.  Tokens that no later merge
has on its left lose no out-arc of their own, so those that took over the same out-arcs stay equal for good
and share a row; in the same way tokens share columns.  That makes about 52 MB of a vocabulary of 49,000 tokens.

A string has exactly one accepted path, and so has each of its prefixes.  So encoding walks once along the symbols:
a second table, a trie of the labels with failure links, names the tokens that end at a place, and the one whose arc from the state
at its own beginning stands is the state there.  Decoding emits the arc labels (token strings).

Defined results: null and empty texts encode to no token; special-token
strings inside a text become their ids; repeated rows give repeated results;
other columns of the input are passed through untouched.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

#: Words whose encoding a worker remembers; a bound on memory, not on results.
CACHE_WORDS = 100_000


def _byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in keep:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


class Automaton:
    """Deterministic automaton of a merge list (see the module text)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.suffix = suffix
        size = max(vocab.values()) + 1
        self.label = [""] * size
        for s, i in vocab.items():
            self.label[i] = s
        self._compile(vocab, merges, size)
        self._trie()

    def _compile(self, vocab: dict[str, int], merges: list[tuple[str, str]], size: int) -> None:
        """Applies the gadgets: ``arcs[row[x]]`` has bit ``column[y]`` where ``x -> y`` stands.

        While they are applied the bits lie column by column, as most gadgets take over a whole column.
        """
        gadgets, seen = [], set()
        for a, b in merges:
            if (vocab[a], vocab[b]) not in seen:
                seen.add((vocab[a], vocab[b]))
                gadgets.append((vocab[a], vocab[b], vocab[a + b]))
        cuts_left, cuts_right = [0] * size, [0] * size      # later deletions that a token's row or column sees
        for u, v, _ in gadgets:
            cuts_left[u] += 1
            cuts_right[v] += 1
        own_row, own_column = [n > 0 for n in cuts_left], [n > 0 for n in cuts_right]
        self.state: dict[str, int] = {s: i for s, i in vocab.items()
                                      if len(s[:-len(self.suffix)] if s.endswith(self.suffix) else s) == 1}
        # a first look at the gadgets counts rows and columns: equal keys mean equal out-arcs (in-arcs) for good
        done_left, done_right = [0] * size, [0] * size
        keys_row: dict = {("own", i): None for i in self.state.values()}
        keys_column = dict(keys_row)
        key_row, key_column = [("own", i) for i in range(size)], [("own", i) for i in range(size)]
        for u, v, w in gadgets:
            if not own_row[w]:
                key_row[w] = (v, done_left[v])
            if not own_column[w]:
                key_column[w] = (u, done_right[u] + (u == v))       # in-arcs are taken over after the deletion
            keys_row.setdefault(key_row[w])
            keys_column.setdefault(key_column[w])
            done_left[u] += 1
            done_right[v] += 1
        row_of, column_of = {k: i for i, k in enumerate(keys_row)}, {k: i for i, k in enumerate(keys_column)}
        self.row, self.column = [row_of.get(k, -1) for k in key_row], [column_of.get(k, -1) for k in key_column]
        bits = np.zeros(((len(column_of) + 7) // 8, len(row_of)), np.uint8)
        base = list(self.state.values())
        for y in base:
            c = self.column[y]
            bits[c >> 3, [self.row[x] for x in base]] |= 1 << (c & 7)
        row, column, label = self.row, self.column, self.label
        made_row, made_column = set(row[x] for x in base), set(column[x] for x in base)
        for u, v, w in gadgets:
            cu, cv = column[u], column[v]
            stands = label[u] in self.state and label[v] in self.state and bits[cv >> 3, row[u]] >> (cv & 7) & 1
            if stands:
                self.state[label[w]] = w
                if row[w] not in made_row:
                    bits[:, row[w]] = bits[:, row[v]]
                    made_row.add(row[w])
            if label[u] in self.state and label[v] in self.state:
                bits[cv >> 3, row[u]] &= 255 ^ (1 << (cv & 7))
            if stands and column[w] not in made_column:
                c = column[w]
                bits[c >> 3] |= (bits[cu >> 3] >> (cu & 7) & 1) << (c & 7)
                made_column.add(c)
        self.arcs = [r.tobytes() for r in np.ascontiguousarray(bits.T)]
        self.place = [(c >> 3, 1 << (c & 7)) for c in column]

    def arc(self, x: int, y: int) -> bool:
        """Whether ``y`` may follow ``x``."""
        at, bit = self.place[y]
        return self.arcs[self.row[x]][at] & bit != 0

    def _trie(self) -> None:
        """Labels as a trie with failure links; per node, the tokens that end there, inside a word and at its end, longest first."""
        self.next: list[dict[str, int]] = [{}]
        inner, final = [[]], [[]]
        for s, t in self.state.items():
            last = bool(self.suffix) and s.endswith(self.suffix)
            node, text = 0, s[:-len(self.suffix)] if last else s
            for ch in text:
                if ch not in self.next[node]:
                    self.next[node][ch] = len(self.next)
                    self.next.append({})
                    inner.append([])
                    final.append([])
                node = self.next[node][ch]
            token = (t, len(text), self.arcs[self.row[t]], *self.place[t])
            (final if last else inner)[node].append(token)
        self.fail = [0] * len(self.next)
        queue = list(self.next[0].values())
        for node in queue:
            for ch, child in self.next[node].items():
                back = self.fail[node]
                while back and ch not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(ch, 0)
                queue.append(child)
            inner[node] = inner[node] + inner[self.fail[node]]
            final[node] = final[node] + final[self.fail[node]]
        self.inner, self.final = inner, final if self.suffix else inner

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word (a string of base symbols): one pass over its symbols, a state for each place."""
        n, step, fail, ends = len(word), self.next, self.fail, self.inner
        states: list = [None] * (n + 1)          # the token that ends at each place, with the row of its out-arcs
        node = 0
        for k, ch in enumerate(word, 1):
            to = step[node].get(ch)
            while to is None and node:
                node = fail[node]
                to = step[node].get(ch)
            node = to or 0
            for token in (ends if k < n else self.final)[node]:
                before = k - token[1]
                if not before or (states[before] is not None and states[before][2][token[3]] & token[4]):
                    states[k] = token
                    break
        path = []
        while n:
            token = states[n]
            path.append(token[0])
            n -= token[1]
        return path[::-1]


class Codec:
    """Normalisation, pre-splitting, the automaton and its decoding for one vocabulary file."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]],
                                   model["end_of_word_suffix"])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.labels = {i: s for i, s in enumerate(self.automaton.label)} | {i: s for s, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.symbols = _byte_symbols()
        self.words, self.words_bmp, self.words_ascii = self._splitter(0x110000), self._splitter(0x10000), self._splitter(0x80)
        #: Two generations of remembered words: a bound on memory, not on results.
        self.cache: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    @staticmethod
    def _splitter(top: int):
        """The pre-splitting rule for code points below ``top``."""
        kinds: dict[str, list[str]] = {"L": [], "N": []}
        start, kind = 0, ""
        for c in range(top + 1):
            k = unicodedata.category(chr(c))[0] if c < top else ""
            if k != kind:
                if kind in kinds:
                    kinds[kind].append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start, kind = c, k
        letter, number = "".join(kinds["L"]), "".join(kinds["N"])
        # white space of the vocabulary's splitting rule (fixed values)
        blank = "\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        return re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{blank}{letter}{number}]+").findall

    def _word(self, word: str) -> tuple[str, str]:
        found = self.older.get(word)
        if found is None:
            found = self._encode(word)
        if len(self.cache) >= CACHE_WORDS:
            self.older, self.cache = self.cache, {}
        if len(word) <= 64:
            self.cache[word] = found
        return found

    def _encode(self, word: str) -> tuple[str, str]:
        symbols = self.symbols
        ids = self.automaton.encode("".join([symbols[b] for b in word.encode("utf-8", "surrogatepass")]))
        label = self.labels
        return " ".join(map(str, ids)), " ".join([label[i] for i in ids])

    def lines(self, text: str | None) -> tuple[str, str]:
        """(ids joined by blanks, decoded text) of one whole text."""
        if not text:
            return "", ""
        ids: list[str] = []
        labels: list[str] = []
        parts = self.at_special.split(text) if "<|" in text else (text,)
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(str(self.special[part]))
                labels.append(part)
                continue
            if part.isascii():
                found = self.words_ascii(part.lower())
            else:
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                plain = len(part.encode("utf-16-le", "surrogatepass")) == 2 * len(part)
                found = (self.words_bmp if plain else self.words)(part)
            known, other = self.cache.get, self._word
            made = [known(w) or other(w) for w in found]
            ids += [m[0] for m in made]
            labels += [m[1] for m in made]
        return " ".join(ids), " ".join(labels)

    def encode(self, text: str | None) -> list[int]:
        line = self.lines(text)[0]
        return [int(x) for x in line.split(" ")] if line else []

    def decode(self, ids) -> str:
        """Arc labels joined by one blank, as the file names no decoder."""
        label = self.labels
        return " ".join([label[i] for i in ids if i in label])


_CODECS: dict[bytes, Codec] = {}


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def codec(file: bytes) -> Codec:
    """The codec of a vocabulary file's contents, compiled once per worker process."""
    key = hashlib.sha256(file).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(file)
    return _CODECS[key]


def _shipped(df: DataFrame, path: str):
    """Gives the codec in a task: the driver reads the file, and executors get its contents (bounded by the vocabulary)."""
    contents = df.sparkSession.sparkContext.broadcast(read_file(path))
    return lambda: codec(contents.value)


def _add(df: DataFrame, text: str, keep: list[str], fields: list[tuple[str, pa.DataType, T.DataType]], make) -> DataFrame:
    """Columns ``keep`` of ``df`` plus columns made from ``text`` batch by batch; a clashing old column gives way."""
    names = {n.lower() for n, _, _ in fields}
    kept = [c for c in keep if c.lower() not in names]
    columns = [F.col(f"`{c}`") for c in kept]
    source = df.select(*columns, F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, t) for n, _, t in fields]])
    at = kept.index(text) if text in kept and df.schema[text].dataType == T.StringType() else len(kept)
    if at < len(kept):
        source = df.select(*columns)    # the text goes to Python once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = make()
        for b in batches:
            made: list[list] = [[] for _ in fields]
            for t in b.column(at):
                for out, v in zip(made, tool(t.as_py())):
                    out.append(v)
            arrays = [b.column(i) for i in range(len(kept))]
            arrays += [pa.array(v, type=t) for v, (_, t, _) in zip(made, fields)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[n for n, _, _ in fields]])

    return source.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` plus an ``array<int>`` column of token ids of the whole ``text``."""
    tool = _shipped(df, path)
    return _add(df, text, df.columns, [(ids, pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))],
                lambda: lambda t, c=tool(): (c.encode(t),))


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` plus the decoded string of an id array column; null ids give null."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.StringType())])

    tool = _shipped(df, path)

    def run(batches):
        c = tool()
        for b in batches:
            made = [None if x is None else c.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns)], pa.array(made, pa.string())],
                                             names=[*kept, out])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def encoding_digests(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` plus n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding every whole text."""

    tool = _shipped(df, path)

    def make():
        c = tool()

        def one(t):
            ids, back = c.lines(t)
            return (ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                    hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
        return one

    return _add(df, text, list(keep), [("n_tokens", pa.int64(), T.LongType()), ("ids_sha256", pa.string(), T.StringType()),
                           ("decoded_sha256", pa.string(), T.StringType())], make)
