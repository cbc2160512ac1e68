import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import graph, jaccard
from corpusflow.session import ship_package

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows):
    """(doc_id, size, smallest reachable id) per row, over all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted([(rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))], key=str)


def run(spark, rows):
    ship_package(spark)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    return sorted([(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.similarity_classes(df).collect()], key=str)


def copies(r, n_bases, n_copies, vocabulary=4000):
    vocab = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for _ in range(n_bases):
        base = r.choices(vocab, k=r.randint(30, 200))
        rows.append(" ".join(base))
        for _ in range(n_copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append(" ".join(w[:r.randint(len(w) * 4 // 5, len(w))]))
    return rows


@pytest.mark.parametrize("tile", [2048, 8])
def test_equals_all_pairs(spark, monkeypatch, tile):
    """Near copies around the threshold, shared passages, exact copies; with small tiles, groups span many blocks."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    r = random.Random(11)
    texts = copies(r, 6, 25)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(r.choices([f"q{i}" for i in range(3000)], k=40)) + " " + passage for _ in range(30)]
    texts += texts[:10] + [texts[0].upper()]
    assert run(spark, list(enumerate(texts))) == brute(list(enumerate(texts)))


def near_copies_with_tails(n):
    """One template, and a tail of its own for each copy: linked with each other, and all in the same tiles."""
    return [" ".join([f"c{i}" for i in range(40)] + [f"tail{d}x{i}" for i in range(3)]) for d in range(n)]


@pytest.mark.parametrize("first_round", [True, False])
def test_a_large_tile_is_dealt_evenly(spark, monkeypatch, first_round):
    """No block holds much more than two of a tile's blocks, each pair comes once per tile, and no link is lost - also without the first round's."""
    from corpusflow.session import scratch_path
    tile, sizes, crossing = 8, [], []
    deal, verify = jaccard._deal, jaccard._verify
    monkeypatch.setattr(jaccard, "TILE", tile)
    if not first_round:
        monkeypatch.setattr(jaccard, "_forest", lambda *t: lambda batches: (b for b in batches if False))

    def spy(entries, partitions):
        sizes.append(entries.groupBy("sh", "block", "band").count().agg(F.max("count")).first()[0] or 0)
        return deal(entries, partitions)

    def spied(pairs, sets, t):
        path = scratch_path(spark, "pairs")
        pairs.write.parquet(path)
        crossing.append(spark.read.parquet(path).groupBy("a", "b").count().agg(F.count("*"), F.max("count")).first())
        return verify(spark.read.parquet(path), sets, t)

    monkeypatch.setattr(jaccard, "_deal", spy)
    monkeypatch.setattr(jaccard, "_verify", spied)
    rows = list(enumerate(near_copies_with_tails(160)))
    assert run(spark, rows) == brute(rows)
    assert max(sizes) <= 6 * tile
    pairs, times = crossing[-1]
    if first_round:
        assert pairs == 0
    else:
        assert pairs == 160 * 159 // 2 and times <= 5      # five prefix shingles


def test_rows_of_every_kind(spark):
    w = [f"t{i}" for i in range(2000)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b"), (7, "a  b"), (7, "a b c d"), (8, "x y z"), (8, "x y z"),
            (None, "x y z"), (None, "only null"), (9, " ".join(w)), (10, " ".join(w[:1700])), (11, " ".join(w * 5)), (12, "É a b c d e"), (13, "é a b c d e"),
            # four of five shingles shared: exactly the threshold; four of six: below it
            (20, "a1 a2 a3 a4 a5 a6 a7 a8"), (21, "a1 a2 a3 a4 a5 a6 a7 a8 a9"), (22, "b1 b2 b3 b4 b5 b6 b7 b8"), (23, "b0 b1 b2 b3 b4 b5 b6 b7 b8 b9")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_one_row_of_each_group_stays(spark):
    ship_package(spark)
    same = " ".join(f"s{i}" for i in range(50))
    rows = [(3, same, "a"), (2, same.upper(), "b"), (5, same, "c"), (5, same, "c"), (6, None, "d"), (7, "", "e"), (8, "other text here", "f"), (8, "quite another one", "g"),
            (9, "twice the same", "h"), (9, "twice the same", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __more string").withColumnRenamed("__more", "more")
    got = sorted((x.doc_id, x.more) for x in jaccard.keep_one(df).collect())
    assert got == [(2, "b"), (6, "d"), (7, "e"), (8, "f"), (8, "g"), (9, "h")]


def test_bands_hold_all_partners():
    edges = jaccard.bands(80, 100, 5000)
    of = lambda n: int((edges <= n).sum())
    for n in range(1, 4000):
        assert of(n * 5 // 4) - of(n) <= 1


def test_components_equal_search(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, i) for i in range(400, 500)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_shared_line_fills_no_bucket(spark, monkeypatch):
    """A shingle costs one entry per pack, however many documents hold it."""
    ship_package(spark)
    line = "the one line that every single document holds somewhere in its text"
    df = spark.range(4000).selectExpr("id AS doc_id", "0L AS row_key", f"concat('{line} ', array_join(transform(sequence(1, 6), i -> md5(concat(id, '-', i))), ' ')) AS text")
    packs = df.repartition(4).mapInArrow(jaccard._pack_sets(5, 32), jaccard.PACKS)
    load = {x.bucket: x.n for x in packs.filter("kind = 0").selectExpr("bucket", "(octet_length(payload) - 8) div 10 AS n").groupBy("bucket").sum("n").toDF("bucket", "n").collect()}
    assert len(load) == 32 and max(load.values()) < 1.2 * sorted(load.values())[16]
    assert sum(load.values()) < 4000 * 13 + 4 * 10


def test_results_do_not_depend_on_partitions(spark):
    rows = list(enumerate(copies(random.Random(4), 4, 12)))
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(run(spark, rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == brute(rows)


@pytest.mark.parametrize("dtype", ["<u2", "<u4", "<u8"])
def test_planes_come_back(dtype):
    values = np.random.default_rng(1).integers(0, np.iinfo(dtype).max, 57, dtype=dtype)
    got, at = jaccard._unplanes(b"xyz" + jaccard._planes(values) + b"tail", dtype, 57, 3)
    assert (got == values).all() and at == 3 + values.nbytes


def traced(step):
    """(batches of a step, the most bytes of numpy's and Python's that were held meanwhile)."""
    tracemalloc.start()
    try:
        out = [b for b in step]
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_pack_is_worked_on_in_parts(monkeypatch):
    """What a task holds beside a pack of 16 MB is a few times the pack, and its results leave in small batches."""
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    r = np.random.default_rng(3)
    halves = [" ".join(map(str, r.integers(0, 5000, 1000))) for _ in range(1050)]
    texts = [f"{a} {b}" for a, b in zip(halves, halves[1:])]            # each half in two documents
    source = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], names=["a", "b", "c"])
    shingles = len(texts) * 1996
    assert jaccard.PACK_BYTES - 100_000 < 8 * shingles < jaccard.PACK_BYTES
    packs, most = traced(jaccard._pack_sets(5, 12)(iter([source])))
    assert most < 50 * shingles
    assert max(b.nbytes for b in packs) < 3 * jaccard.PACK_BYTES // 4
    rows = pa.Table.from_batches(packs)
    back, _ = traced(jaccard._repeated(iter(rows.sort_by("bucket").combine_chunks().to_batches())))
    held = pa.Table.from_batches(back).sort_by("pack").combine_chunks().to_batches()
    sets, most = traced(jaccard._prefixes(80, 100)(iter(held)))
    assert sum(b.num_rows for b in sets) == len(texts) and max(b.nbytes for b in sets) < 2 * jaccard.BATCH_BYTES
    assert most < 50 * shingles


def test_large_rows_go_to_python_a_few_at_a_time(spark):
    ship_package(spark)
    rows = spark.range(0, 300, 1, 1).selectExpr("cast(repeat(md5(cast(id AS string)), 4000) AS binary) AS x")

    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    got = rows.mapInArrow(run, "n long, size long").collect()
    assert sum(x.n for x in got) == 300 and max(x.size for x in got) < 9 << 20
