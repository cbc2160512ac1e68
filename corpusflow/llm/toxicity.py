"""Toxicity: a factorization machine over hashed terms.

Terms are words (runs of letters, digits and non-ASCII characters, A-Z lower-cased)
and the first ``STEMS`` bytes of longer words, so that inflected forms share a term;
they are hashed to ``SPACE`` buckets, and a document is the set of its terms.  The score is
``sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>)`` over the document's kept terms,
so a pair such as an insult with the mention of a group can weigh more (or
less) than its words do alone.

Kept terms are chosen from a bounded sample of labelled documents: every term
whose association with the label is beyond chance, at least the ``TELLING`` most
associated with either class, and the most common of the others, which can only
matter in pairs.  Documents of the same terms count once, with the share of label 1
among them, so that copies of a text don't crowd out other texts' terms.  Fitting
uses that sample (``SAMPLE``, a parameter); scoring reads every whole text of every row.

Defined results: null, empty and wordless texts have no terms and score the
intercept; repeated rows score alike, and of several texts of one doc_id one is learned from, whatever the order of rows; doc_ids are
of any type; without labels of both classes the score
is the share of label 1 (0 without any labels); other columns pass through, and
a clashing old ``score`` or ``predicted`` column gives way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusflow.llm import learning, quality, textkernel as tk

#: Buckets of the term hash; labelled documents learned from: of each class the smaller of the two at most, 16,000 in all.
SPACE, SAMPLE, CLASS = 1 << 20, 12_000, 8_000
#: Terms kept at least for their association with either class, and for being common; width of the factors; steps of training.
TELLING, COMMON, RANK, STEPS, RATE = 768, 256, 4, 400, 0.05
#: Standard deviations from which on an association is beyond chance: all such terms are kept, however many.
BEYOND_CHANCE = 4
STEMS = (4, 5, 6)


def document_terms(column: pa.Array, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, term) of the distinct terms, sorted by row, and the number of rows, chunk by chunk."""
    for _, data, offsets in tk.text_chunks(column):
        h, rows = tk.words_and_stems(data, offsets, tk.NOT_WORD, STEMS)
        term = (h & np.uint64(SPACE - 1)).astype(np.int64)
        if keep is not None:
            term = keep[term]
            rows, term = rows[term >= 0], term[term >= 0]
        pair = np.unique(rows * SPACE + term)
        yield pair // SPACE, pair % SPACE, len(offsets) - 1


class Model:
    """``keep`` maps a bucket to a kept term or -1; w0, w and v are the machine."""

    def __init__(self):
        self.keep = np.full(SPACE, -1, np.int32)
        self.w0, self.w, self.v, self.constant = 0.0, np.zeros(0), np.zeros((0, RANK)), None

    def _sums(self, rows: np.ndarray, terms: np.ndarray, n: int):
        linear = np.bincount(rows, self.w[terms], n) if len(rows) else np.zeros(n)
        total, square = np.zeros((n, RANK)), np.zeros((n, RANK))
        for j in range(RANK):
            vj = self.v[terms, j]
            total[:, j], square[:, j] = np.bincount(rows, vj, n), np.bincount(rows, vj * vj, n)
        return self.w0 + linear + 0.5 * (total * total - square).sum(1), total

    def fit(self, rows: np.ndarray, terms: np.ndarray, y: np.ndarray, seed: int = 11, decay: float = 2e-5) -> None:
        n, m = len(y), int(self.keep.max()) + 1
        self.w, self.v = np.zeros(m), np.random.default_rng(seed).normal(0, 0.01, (m, RANK))
        p = {"w0": np.array([np.log(y.mean() / (1 - y.mean()))]), "w": self.w, "v": self.v}
        adam = learning.Adam(p, RATE)
        for _ in range(STEPS):
            self.w0 = float(p["w0"][0])
            s, total = self._sums(rows, terms, n)
            g = (learning.sigmoid(s) - y) / n
            each = g[rows]
            gw = np.bincount(terms, each, m)
            gv = np.stack([np.bincount(terms, each * (total[rows, j] - self.v[terms, j]), m) for j in range(RANK)], axis=1)
            adam.step({"w0": np.array([g.sum()]), "w": gw + decay * self.w, "v": gv + 20 * decay * self.v})
        self.w0 = float(p["w0"][0])

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return np.concatenate([np.zeros(0), *[learning.sigmoid(self._sums(r, t, n)[0]) for r, t, n in document_terms(column, self.keep)]])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on a bounded sample; term counts are summed in Spark, and only kept terms of sampled documents come to the driver."""
    model = Model()
    counts = learning.class_shares(labels, label)
    if len(counts) < 2:
        model.constant = float(next(iter(counts))) if counts else 0.0
        return model
    chosen = learning.labelled_ids(labels, label, sample, CLASS)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def run(batches):
        for b in batches:
            made = []
            for r, t, n in document_terms(b.column(2)):
                cuts = np.searchsorted(r, np.arange(n + 1))
                made += [t[cuts[i]:cuts[i + 1]].astype(np.int32) for i in range(n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "y", "terms"])

    from corpusflow.session import scratch_path
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "terms")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, y int, terms array<int>")
    # of several texts of one doc_id the least counts, whatever the order of tasks
    made.groupBy("doc_id").agg(F.min(F.struct("terms", "y")).alias("_t")).select("doc_id", "_t.y", "_t.terms").write.parquet(path)
    sampled = spark.read.parquet(path)
    n, n1 = sampled.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < n1 < n:
        model.constant = counts.get(1, 0) / sum(counts.values())
        return model
    once = sampled.groupBy("terms").agg(F.min("doc_id").alias("doc_id"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("copies"))
    d, d1 = once.agg(F.count(F.lit(1)), F.sum("y")).first()
    by_term = (once.select("y", "copies", F.explode("terms").alias("t")).groupBy("t")
               .agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("c1"), F.sum("copies").alias("seen")).filter("seen >= 3"))
    # signed root of the chi-squared statistic: how far the term's share of label 1 is from the sample's
    z = f"(c1 - c * {d1 / d}) / sqrt(c * {d1 / d} * {1 - d1 / d} * greatest(1 - c / {float(d)}, 1e-9))"
    by_term = by_term.select("t", "c", F.expr(z).alias("z"))
    telling = [by_term.filter(F.abs("z") >= BEYOND_CHANCE), *[by_term.orderBy(way("z"), "t").limit(TELLING) for way in (F.desc, F.asc)]]
    common = by_term.orderBy(F.desc("c"), "t").limit(COMMON)
    terms = sorted({r["t"] for few in (*telling, common) for r in few.select("t").collect()})     # at most SPACE numbers
    model.keep[terms] = np.arange(len(terms))

    def known(batches):
        keep = np.zeros(SPACE, bool)
        keep[terms] = True
        for b in batches:
            flat, cuts = b.column(2).flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(b.column(2)).to_pylist()])
            good = keep[flat]
            cuts = np.concatenate([[0], np.cumsum(good)])[cuts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat[good], pa.int32()))],
                                             names=["doc_id", "y", "terms"])

    table = once.select("doc_id", "y", "terms").mapInArrow(known, f"doc_id {kind}, y double, terms array<int>").toArrow().sort_by("doc_id")
    y = table.column("y").to_numpy()
    of = np.repeat(np.arange(len(y)), pc.list_value_length(table.column("terms")).to_numpy())
    flat = model.keep[pc.list_flatten(table.column("terms")).to_numpy()].astype(np.int64)
    model.fit(of, flat, y)
    real, seen = counts[1] / sum(counts.values()), n1 / n
    model.w0 += float(np.log(real / (1 - real)) - np.log(seen / (1 - seen)))    # the sample favours the rarer class
    return model


def score(docs: DataFrame, model: Model, text: str = "text", cut: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) plus ``score`` (0 to 1) and ``predicted`` (1 if score >= cut)."""
    return quality.score(docs, model, text, cut, keep)
