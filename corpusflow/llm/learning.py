"""What the trained operators share: the held-out rule, bounded samples of labels, metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5; a null id is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def labelled_ids(labels: DataFrame, label: str, bound: int, most_of_a_class: int) -> DataFrame:
    """(doc_id, y) of labelled ids that may be learned from, by hash order: of each class about the smaller of the bounds at most.

    Two classes therefore give up to twice that number.  Each keeps the share of its ids that meets it;
    conflicting labels of one id count as the larger.  The result is small by
    construction, so callers may broadcast it.
    """
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    sizes = dict(rows.groupBy("y").count().collect())
    keep = F.lit(False)
    for y, n in sizes.items():
        share = min(1.0, min(bound, most_of_a_class) / n)
        keep = keep | ((F.col("y") == y) & (F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_000)) < int(share * 1_000_000)))
    return rows.filter(keep)


def class_shares(labels: DataFrame, label: str) -> dict[int, int]:
    """Counts of each class over all rows that may be learned from."""
    return dict(labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
                .groupBy(F.col(label).cast("int").alias("y")).count().collect())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Adam:
    """Adaptive steps over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            up, down = self.m[k] / (1 - 0.9 ** self.t), self.v[k] / (1 - 0.999 ** self.t)
            self.p[k] -= self.rate * up / (np.sqrt(down) + 1e-8)
