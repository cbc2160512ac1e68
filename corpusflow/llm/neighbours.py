"""Approximate nearest neighbours by shifted space-filling curves.

Nearness is the inner product.  Vectors are lifted by one coordinate to a common
length, which makes the largest inner product the smallest distance.  Each of
``ORDERINGS`` orderings projects them to ``DIMS`` random directions, shifts the
grid, and sorts by Hilbert key: a range partitioning in Spark, equal keys apart by id.
The sorted rows are numbered in blocks of ``BLOCK``.  A query meets the blocks up to ``w`` away from
its own place in every ordering; what it finds there is merged and ranked by exact scores.

``w`` is measured, not assumed: ``PROBES`` queries are compared with every row, and ``w``
is the smallest distance in blocks, in the best ordering, that holds the share ``RECALL`` of their
true neighbours.  Vectors with structure need few blocks; vectors without any need windows that
grow with the table, as for any index.

Two passes keep the merged rows few: the query's own blocks give a score that the k-th neighbour
must reach, and only candidates that reach it leave the other blocks, each from the first ordering that covers it.

Equal vectors are one row of the index; its ids are listed up to the k + 1 smallest, which is all
that any answer can hold.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
null ids, nor vectors whose length isn't the table's most common one (the larger on ties); repeated rows count once; rows of one id
with different vectors are all candidates, but not for queries of that id; ties go to the smaller id;
fewer candidates than k give all; no query gives no row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusflow.session import scratch_path

ORDERINGS, DIMS, BITS, BLOCK = 4, 6, 9, 1024
PROBES, RECALL, FIT = 200, 0.96, 10_000


def hilbert_keys(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows of ``x``, coordinates below 2**bits), all rows at once."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    top = 1 << (bits - 1)
    q = top
    while q > 1:                       # undo excess rotations, from the highest bit down
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            if i:
                x[:, i] = np.where(on, x[:, i], x[:, i] ^ t)
        q >>= 1
    for i in range(1, n):              # Gray code
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = top
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


class Curves:
    """The orderings' projections, scales and shifts, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 5):
        r = np.random.default_rng(seed)
        self.longest = longest
        lifted = self.lift(sample)
        d = lifted.shape[1]
        self.axes = [np.linalg.qr(r.normal(size=(d, min(DIMS, d))))[0] for _ in range(ORDERINGS)]
        if d < DIMS:
            self.axes = [np.pad(a, ((0, 0), (0, DIMS - d))) for a in self.axes]
        at = [lifted @ a for a in self.axes]
        self.low = [a.mean(0) - 3 * a.std(0) - 1e-9 for a in at]
        self.span = [6 * a.std(0) + 2e-9 for a in at]
        self.shift = [r.uniform(0, 0.25, DIMS) for _ in range(ORDERINGS)]

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def lift_queries(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x * (self.longest / np.sqrt((x * x).sum(1)))[:, None], np.zeros((len(x), 1))], axis=1)

    def keys(self, lifted: np.ndarray) -> list[np.ndarray]:
        out = []
        for a, low, span, shift in zip(self.axes, self.low, self.span, self.shift):
            u = np.clip((lifted @ a - low) / span, 0, 1) * 0.75 + shift
            out.append(hilbert_keys(np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))
        return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _ordered(batches):
    """Block numbers along each partition's part of each ordering; queries take the place they fall in."""
    from pyspark import TaskContext
    part, now, count = TaskContext.get().partitionId(), None, 0
    for b in batches:
        t, kind = b.column(0).to_numpy(), b.column(2).to_numpy()
        block = np.empty(len(t), np.int64)
        for v in np.unique(t):
            mine = np.flatnonzero(t == v)
            if v != now:
                now, count = v, 0
            upto = count + np.cumsum(kind[mine] == 0) - (kind[mine] == 0)
            block[mine] = upto // BLOCK
            count += int((kind[mine] == 0).sum())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.full(len(t), part)), pa.array(block)],
                                         names=["t", "kind", "cid", "part", "block"])


def _visit(d: int, k: int, w: int | None):
    """Per block: its rows, then the queries that meet it, batch by batch.  Without ``w`` the best k of each query;
    with ``w`` the rows that reach the query's bar and that no earlier ordering covers."""

    def found(rows, ids, places, b, at):
        q = _matrix(b.column(4).take(pa.array(at)), d)
        qid = b.column(3).to_numpy()[at]
        score = q @ rows.T
        score[qid[:, None] == ids[None, :]] = -np.inf
        if w is None:
            m = min(k, score.shape[1])
            best = np.argpartition(-score, m - 1, axis=1)[:, :m]
            r, c = np.repeat(np.arange(len(at)), m), best.ravel()
            r, c = r[np.isfinite(score[r, c])], c[np.isfinite(score[r, c])]
        else:
            bar = b.column(6).to_numpy(zero_copy_only=False)[at]
            r, c = np.nonzero(score >= bar[:, None] - 1e-9)
            qp = _matrix(b.column(5).take(pa.array(at)), ORDERINGS)
            t = int(b.column(0)[int(at[0])].as_py())
            first = ~(np.abs(places[c][:, :t] - qp[r][:, :t]) <= w).any(axis=1)
            r, c = r[first], c[first]
        return pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[c]), pa.array(score[r, c])], names=["qcid", "cid", "near"])

    def run(batches):
        now, parts, rows, ids, places = None, [], None, None, None
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) << 40 | b.column(1).to_numpy()
            kind = b.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(key * 2 + kind)) + 1
            for at in np.split(np.arange(len(key)), cuts):
                if not len(at):
                    continue
                if key[at[0]] != now:
                    now, parts, rows = key[at[0]], [], None
                if kind[at[0]] == 0:
                    take = pa.array(at)
                    parts.append((_matrix(b.column(4).take(take), d), b.column(3).to_numpy()[at], _matrix(b.column(5).take(take), ORDERINGS)))
                    continue
                if not parts:
                    continue
                if rows is None:
                    rows, ids, places = (np.concatenate(x) for x in zip(*parts))
                for lo in range(0, len(at), 2048):
                    yield found(rows, ids, places, b, at[lo:lo + 2048])
    return run


def nearest(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that ``is_query`` marks."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def kept(x: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        x.write.parquet(path)
        return spark.read.parquet(path)

    e = F.col(f"`{embedding}`")
    ok = (F.col(f"`{vec_id}`").isNotNull() & e.isNotNull() & (F.size(e) > 0)
          & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0))
    rows = df.filter(ok).select(F.col(f"`{vec_id}`").cast("long").alias("id"), e.alias("e"), F.coalesce(is_query, F.lit(False)).alias("q"))
    lengths = rows.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return empty
    d = lengths[0]["d"]
    rows = kept(rows.filter(F.size("e") == d).withColumn("h", F.xxhash64("e")), "vectors")

    # equal vectors are one class, numbered as it is written
    classes = kept(rows.groupBy("h", "e").agg(F.min("id").alias("least")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    first = Window.partitionBy("h", "e").orderBy("id")
    few = rows.select("h", "e", "id").distinct().withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= k + 1)
    members = kept(few.join(classes, ["h", "e"]).select("cid", "id"), "members")
    asked = kept(rows.filter("q").select("h", "e", "id").distinct().join(classes, ["h", "e"]).select(F.col("id").alias("qid"), F.col("cid").alias("qcid")), "asked")
    asking = asked.select(F.col("qcid").alias("cid")).distinct().withColumn("kind", F.lit(1))

    # an id of m different vectors can take up to m of the best classes, so more of them are looked for
    several = rows.select("id", "h").distinct().groupBy("id").count().agg(F.max("count")).first()[0]
    need = (k + 1) * several
    n, longest = classes.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate(F.col("e").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v)))).first()
    sample = classes.filter(F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < int(min(1.0, FIT / n) * 1_000_000) + 1).select("e").limit(2 * FIT).toArrow()
    if not sample.num_rows:
        sample = classes.select("e").limit(FIT).toArrow()
    curves = Curves(_matrix(sample.column("e").combine_chunks(), d), longest)

    def place(batches):
        for b in batches:
            x, cid, q = _matrix(b.column(1), d), b.column(0).to_numpy(), np.array(b.column(2).to_pylist(), bool)
            for kind, lifted, ids in ((0, curves.lift(x), cid), (1, curves.lift_queries(x[q]), cid[q])):
                for t, key in enumerate(curves.keys(lifted)):
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t)), pa.array(key), pa.array(np.full(len(ids), kind)), pa.array(ids)],
                                                         names=["t", "key", "kind", "cid"])

    marked = classes.join(asking, "cid", "left").select("cid", "e", F.col("kind").isNotNull().alias("q"))
    keys = kept(marked.mapInArrow(place, "t long, key long, kind long, cid long"), "keys")
    order = ["t", "key", "kind", "cid"]
    placed = kept(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                  .mapInArrow(_ordered, "t long, kind long, cid long, part long, block long"), "placed")
    # blocks of each partition's part: a handful of numbers per partition
    runs = placed.groupBy("t", "part").agg((F.max("block") + 1).alias("blocks"))
    along = Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("blocks").over(along), F.lit(0)))
    last = {r["t"]: r["n"] for r in runs.groupBy("t").agg(F.max(F.col("before") + F.col("blocks")).alias("n")).collect()}
    placed = placed.join(F.broadcast(runs.select("t", "part", "before")), ["t", "part"])
    spots = (placed.groupBy("cid", "kind").agg(F.sort_array(F.collect_list(F.struct("t", (F.col("before") + F.col("block")).alias("b")))).alias("s"))
             .select("cid", "kind", F.col("s.b").alias("places")))
    spots = kept(spots.join(classes.select("cid", "e"), "cid"), "spots")
    index, queries = spots.filter("kind = 0").drop("kind"), spots.filter("kind = 1").drop("kind")

    probes = queries.orderBy(F.xxhash64("cid"), "cid").limit(PROBES).toArrow()
    if not probes.num_rows:
        return empty
    w = _window(index, probes, d, k)

    def visits(width: int, bars: DataFrame | None) -> DataFrame:
        own = index.withColumn("kind", F.lit(0)).withColumn("bar", F.lit(None).cast("double"))
        own = own.select(F.posexplode("places").alias("t", "block"), "kind", "cid", "e", "places", "bar")
        ask = queries.join(bars, "cid", "left") if bars is not None else queries.withColumn("bar", F.lit(None).cast("double"))
        ends = F.element_at(F.create_map(*[F.lit(int(x)) for kv in sorted(last.items()) for x in (kv[0], kv[1] - 1)]), F.col("t"))
        ask = (ask.select(F.posexplode("places").alias("t", "b"), F.lit(1).alias("kind"), "cid", "e", "places", F.coalesce("bar", F.lit(float("-inf"))).alias("bar"))
               .select("t", F.explode(F.sequence(F.greatest(F.col("b") - width, F.lit(0)), F.least(F.col("b") + width, ends.cast("long")))).alias("block"),
                       "kind", "cid", "e", "places", "bar"))
        return own.unionByName(ask).repartition(parts, "t", "block").sortWithinPartitions("t", "block", "kind", "cid")

    pairs = "qcid long, cid long, near double"
    once = kept(visits(0, None).mapInArrow(_visit(d, need, None), pairs).groupBy("qcid", "cid").agg(F.max("near").alias("near")), "own")
    best = Window.partitionBy("qcid").orderBy(F.desc("near"), "cid")
    bars = once.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") == need).select(F.col("qcid").alias("cid"), F.col("near").alias("bar"))
    more = visits(w, bars).mapInArrow(_visit(d, need, w), pairs).select("qcid", "cid")
    pairs_found = once.select("qcid", "cid").union(more).union(asked.select("qcid", F.col("qcid").alias("cid"))).distinct()

    # exact scores on the original vectors, then the ids of equal vectors
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("e").cast("array<double>").alias("e_" + c))
    exact = F.aggregate(F.zip_with("e_qcid", "e_cid", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    scored = pairs_found.join(side("qcid"), "qcid").join(side("cid"), "cid").join(classes.select("cid", "least"), "cid")
    scored = scored.select("qcid", "cid", "least", exact.alias("score"))
    # a class beyond these by score and smallest id can't hold an answer
    top = scored.withColumn("rn", F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("score"), "least", "cid"))).filter(F.col("rn") <= need)
    top = top.select("qcid", "cid", "score").join(members, "cid").select("qcid", "id", "score")
    # an id is a candidate once, with its best vector
    top = top.groupBy("qcid", "id").agg(F.max("score").alias("score"))
    top = top.withColumn("rn", F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("score"), "id"))).filter(F.col("rn") <= k + 1).drop("rn")
    per = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(top, "qcid").filter("id <> qid").select(F.col("qid").alias("query_id"), F.col("id").alias("vec_id"), "score")
    return out.withColumn("rank", F.row_number().over(per)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _window(index: DataFrame, probes: pa.Table, d: int, k: int) -> int:
    """Blocks on either side that hold the share RECALL of the probes' true neighbours in their best ordering."""
    q = _matrix(probes.column("e").combine_chunks(), d)
    qid, qp = probes.column("cid").to_numpy(), _matrix(probes.column("places").combine_chunks(), ORDERINGS)

    def run(batches):
        for b in batches:
            x, cid = _matrix(b.column(1), d), b.column(0).to_numpy()
            places = _matrix(b.column(2), ORDERINGS)
            score = q @ x.T
            score[qid[:, None] == cid[None, :]] = -np.inf
            m = min(k, len(cid))
            best = np.argpartition(-score, m - 1, axis=1)[:, :m]
            r, c = np.repeat(np.arange(len(q)), m), best.ravel()
            r, c = r[np.isfinite(score[r, c])], c[np.isfinite(score[r, c])]
            apart = np.abs(places[c] - qp[r]).min(axis=1).astype(np.int64) if len(r) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(score[r, c]), pa.array(apart)], names=["probe", "score", "apart"])

    near = index.select("cid", "e", "places").mapInArrow(run, "probe long, score double, apart long")
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "apart"))).filter(F.col("rn") <= k)
    counts = sorted((r["apart"], r["count"]) for r in near.groupBy("apart").count().collect())
    total, seen = sum(c for _, c in counts), 0
    for apart, c in counts:
        seen += c
        if seen >= RECALL * total:
            return int(apart)
    return 0
