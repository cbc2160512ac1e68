import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import neighbours
from corpusflow.session import ship_package


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    if not ok:
        return {}
    d = max({len(v) for _, v in ok}, key=lambda n: (sum(len(v) == n for _, v in ok), n))
    ok = [(i, v) for i, v in ok if len(v) == d]
    ids, x = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for q in {i for i, _ in ok if i % every == 0}:
        best = {}
        for v in x[ids == q]:
            for i, s in zip(ids, x @ v):
                if i != q:
                    best[i] = max(best.get(i, -np.inf), s)
        out[q] = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
    return out


def run(spark, rows, k=20, every=20, kind="float"):
    ship_package(spark)
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, score double")
    out = {}
    for r in neighbours.nearest(df, F.col("vec_id") % every == 0, k).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({i for _, i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


@pytest.mark.parametrize("norms", ["unit", "free"])
def test_recall_and_scores(spark, monkeypatch, norms):
    """Structureless and clustered vectors, of one length or any; blocks far smaller than the table."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(1200, 16)), r.normal(size=(1, 16)) + 0.02 * r.normal(size=(400, 16))])
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if norms == "unit" else x * r.uniform(0.5, 2, (1600, 1))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows, 20, 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    vec = {i: np.array(v) for i, v in rows}
    for q, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and all(abs(vec[q] @ vec[i] - s) < 1e-12 for _, i, s in found)
        assert q not in {i for _, i, _ in found}


def test_rows_of_every_kind(spark):
    """Equal vectors beyond k, ties, repeated rows and ids, vectors that take no part; exact, as one block holds all."""
    r = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 2.0]) for i in range(100, 160)] + [(i, [float(c) for c in r.integers(-3, 4, 3)]) for i in range(1, 60)]
    rows += [(100, [1.0, 2.0, 2.0]), (100, [0.0, 0.0, 5.0]), (7, [1.0, 2.0, 2.0])]
    rows += [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 2.0]), (204, [1.0, float("nan"), 2.0]), (205, [float("inf"), 1.0, 1.0]),
             (220, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    got, want = run(spark, rows, k=5), brute(rows, 5, 20)
    assert {q: [(i, round(s, 9)) for _, i, s in f] for q, f in got.items()} == {q: [(i, round(s, 9)) for i, s in f] for q, f in want.items()}
    assert run(spark, [], k=5) == {} and run(spark, [(1, [1.0])], k=5) == {} and run(spark, [(20, None)]) == {}
    assert run(spark, [(20, [1.0, 0.5]), (21, [1.0, 0.25])], k=5, kind="double") == {20: [(1, 21, 1.125)]}


def test_hilbert_order_is_a_walk():
    """Neighbours along the curve differ by one step in one coordinate, and every point is met once."""
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(points, bits)
        assert sorted(keys) == list(range(side ** dims))
        walk = points[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
