"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of the whole
text is described by surface statistics and encoded by one learned layer;
gated attention (tanh times sigmoid) weighs the passages; the weighted mean of
their codes gives the document's score.  Only document labels train it: the
attention learns which passages decide.

Training uses a bounded sample (of each label at most ``CLASS`` documents, a parameter);
scoring reads every row.

Defined results: null, empty and wordless texts are a bag of one empty passage
and get a score; repeated rows score alike, and of several texts of one doc_id one is learned from, whatever the order of rows; doc_ids are
of any type; without labels of both classes the
score is the share of label 1 (0.5 without any labels); other columns pass
through, and a clashing old ``score`` or ``predicted`` column gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from corpusflow.llm import learning, textkernel as tk

#: Words of a passage; labelled documents learned from, and the most of one class among them.
PASSAGE, SAMPLE, CLASS = 64, 4_000, 2_400
#: Width of the passage code and of the attention; steps of training.
CODE, GATE, STEPS, RATE = 12, 8, 250, 0.03
N_FEATURES = 17

_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "line": [10],
    "stop": [ord(c) for c in ".,;:?'\"-()"], "odd": [ord(c) for c in "#$%&*|!<>{}[]=_~^\\/@+`"], "pipe": [ord("|")],
}


def _ranges(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(features of passages, row of each passage, rows) chunk by chunk, in row order."""
    masks = np.zeros((len(_CLASSES), 256), np.uint8)
    for i, codes in enumerate(_CLASSES.values()):
        masks[i, codes] = 1
    for _, data, offsets in tk.text_chunks(column):
        n_rows = len(offsets) - 1
        h, rows, starts, ends = tk.words(data, offsets, tk.BLANK)
        if not len(h):
            yield _empty(n_rows), np.arange(n_rows), n_rows
            continue
        first = np.searchsorted(rows, np.arange(n_rows + 1))
        inside = np.arange(len(h)) - first[rows]
        heads = np.flatnonzero(inside % PASSAGE == 0)
        passage = np.cumsum(inside % PASSAGE == 0) - 1
        of, m = rows[heads], len(heads)
        count = np.bincount(passage, minlength=m).astype(np.float64)
        begin = starts[heads]
        last = np.append(heads[1:], len(h)) - 1
        end = ends[last]
        size = np.maximum(end - begin, 1)
        share = {}
        for i, name in enumerate(_CLASSES):
            total = np.concatenate([[0], np.cumsum(masks[i][data], dtype=np.int64)])
            share[name] = total[end] - total[begin]
        length = (ends - starts).astype(np.float64)
        mean = np.bincount(passage, length, m) / count
        spread = np.sqrt(np.maximum(np.bincount(passage, length ** 2, m) / count - mean ** 2, 0))
        mark = masks[5][data[ends - 1]].astype(np.float64)
        stop = masks[4][data[ends - 1]].astype(np.float64)
        # words seen before in the passage, and equal to the word before
        order = np.lexsort((h, passage))
        again = np.zeros(len(h))
        again[order[1:]] = (h[order][1:] == h[order][:-1]) & (passage[order][1:] == passage[order][:-1])
        twin = np.zeros(len(h))
        twin[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        # runs of three words seen elsewhere in the document
        echo = np.zeros(len(h))
        if len(h) >= 3:
            s = tk.mix(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
            s = np.where(rows[:-2] == rows[2:], s, h[:-2] + np.arange(len(s), dtype=np.uint64))
            order = np.lexsort((s, rows[:-2]))
            same = (s[order][1:] == s[order][:-1]) & (rows[:-2][order][1:] == rows[:-2][order][:-1])
            echo[order[1:]] = same
        per = lambda v: np.bincount(passage, v, m) / count
        letters = np.maximum(share["upper"] + share["lower"], 1)
        x = np.stack([np.log1p(count), mean / 10, spread / 10, share["upper"] / letters, share["lower"] / size, share["digit"] / size * 5,
                      share["line"] / size * 20, share["stop"] / size * 10, share["odd"] / size * 5, share["pipe"] / size * 10, per(mark), per(stop),
                      per(again), per(twin), per(echo), np.log1p(np.bincount(of, minlength=n_rows)[of]), np.zeros(m)], axis=1)
        missing = np.setdiff1d(np.arange(n_rows), of)
        if len(missing):
            x, of = np.concatenate([x, _empty(len(missing))]), np.concatenate([of, missing])
            order = np.argsort(of, kind="stable")
            x, of = x[order], of[order]
        yield x, of, n_rows


def _empty(n: int) -> np.ndarray:
    x = np.zeros((n, N_FEATURES))
    x[:, -1] = 1
    return x


class Model:
    """Encoder, gated attention and document score; ``p`` holds the parameters."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = N_FEATURES
        self.p = {"W": r.normal(0, f ** -0.5, (f, CODE)), "b": np.zeros(CODE), "V": r.normal(0, CODE ** -0.5, (CODE, GATE)),
                  "U": r.normal(0, CODE ** -0.5, (CODE, GATE)), "w": r.normal(0, GATE ** -0.5, GATE), "c": r.normal(0, CODE ** -0.5, CODE),
                  "d": np.zeros(1)}
        self.mean, self.scale, self.shift, self.constant = np.zeros(f), np.ones(f), 0.0, None

    def _forward(self, x: np.ndarray, of: np.ndarray, n: int):
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), learning.sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        heads = np.searchsorted(of, np.arange(n))       # every bag has a passage, and `of` is sorted
        a = np.exp(e - np.maximum.reduceat(e, heads)[of])
        a /= np.add.reduceat(a, heads)[of]
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return h, v, u, a, z, z @ p["c"] + p["d"][0]

    def fit(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4) -> None:
        """Full-batch logistic loss, gradients by hand."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x, n, p = (x - self.mean) / self.scale, len(y), self.p
        adam = learning.Adam(p, RATE)
        weight = weight / weight.sum()
        for _ in range(STEPS):
            h, v, u, a, z, s = self._forward(x, of, n)
            gs = (learning.sigmoid(s) - y) * weight
            gz = gs[:, None] * p["c"]
            gh = a[:, None] * gz[of]
            ga = (gz[of] * h).sum(1)
            ge = a * (ga - np.bincount(of, a * ga, n)[of])
            gv, gu = ge[:, None] * p["w"] * u * (1 - v * v), ge[:, None] * p["w"] * v * u * (1 - u)
            gh += gv @ p["V"].T + gu @ p["U"].T
            gx = gh * (1 - h * h)
            adam.step({"W": x.T @ gx + decay * p["W"], "b": gx.sum(0), "V": h.T @ gv + decay * p["V"], "U": h.T @ gu + decay * p["U"],
                       "w": (v * u).T @ ge + decay * p["w"], "c": z.T @ gs + decay * p["c"], "d": np.array([gs.sum()])})

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        out = [np.zeros(0)]
        for x, of, n in _ranges(column):
            out.append(learning.sigmoid(self._forward((x - self.mean) / self.scale, of, n)[5] + self.shift))
        return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits on a bounded sample of labelled documents; their passage statistics, not their texts, come to the driver."""
    model = Model()
    counts = learning.class_shares(labels, label)
    if len(counts) < 2:
        model.constant = float(next(iter(counts))) if counts else 0.5
        return model
    chosen = learning.labelled_ids(labels, label, sample, CLASS)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches):
        for b in batches:
            made = []
            for x, of, n in _ranges(b.column(2)):
                cuts = np.searchsorted(of, np.arange(n + 1))
                made += [x[cuts[i]:cuts[i + 1]].astype(np.float32).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["doc_id", "y", "x"])

    made = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, x binary")
    # of several texts of one doc_id the least counts, whatever the order of tasks
    bags = made.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("_b")).select("doc_id", "_b.y", "_b.x").toArrow().sort_by("doc_id")
    if not bags.num_rows:
        model.constant = counts.get(1, 0) / sum(counts.values())
        return model
    y = np.array(bags.column("y").to_pylist(), np.float64)
    xs = [np.frombuffer(v, np.float32).reshape(-1, N_FEATURES) for v in bags.column("x").to_pylist()]
    of = np.repeat(np.arange(len(xs)), [len(v) for v in xs])
    model.fit(np.concatenate(xs).astype(np.float64), of, y, np.ones(len(y)))
    seen = min(max(y.mean(), 1e-3), 1 - 1e-3)
    real = counts.get(1, 0) / sum(counts.values())
    real = min(max(real, 1e-3), 1 - 1e-3)
    model.shift = float(np.log(real / (1 - real)) - np.log(seen / (1 - seen)))   # the sample favours the rarer class
    return model


def score(docs: DataFrame, model, text: str = "text", cut: float = 0.3, keep: tuple[str, ...] | None = None,
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns ``keep`` (all by default) plus the score (0 to 1) and the prediction (1 if score >= cut), every whole text read."""
    kept = [c for c in keep or docs.columns if c.lower() not in names]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    source, at = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias("__text")), len(kept)
    if text in kept and docs.schema[text].dataType == T.StringType():
        source, at = docs.select(*[F.col(f"`{c}`") for c in kept]), kept.index(text)     # the text goes to Python once

    def run(batches):
        for b in batches:
            s = model.scores(b.column(at))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], pa.array(s, pa.float64()),
                                              pa.array((s >= cut).astype(np.int32))], names=[*kept, *names])

    return source.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject; all columns stay."""
    scored = score(docs, train(docs, labels), cut=cut, names=("__score", "__predicted"))
    return scored.filter("__predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
