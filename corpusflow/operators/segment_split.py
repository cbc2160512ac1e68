"""G1 and G2 over documents that are divided over tasks: paragraphs come as rows, and no task holds a document.

The fold of :mod:`corpusflow.operators.segment` closes a pack where the next paragraph doesn't fit.  So a paragraph that begins a
pack determines, by prefix sums of the lengths, the one that begins the next: a pointer a bounded distance ahead.
A document is cut into blocks of ``BLOCK`` paragraphs:

1. each block maps every paragraph at which it might be entered to the paragraph at which the next block is entered then
   (pointer doubling within the block; the next block's first lengths are at hand);
2. the maps of a document are followed from its first paragraph, a small row per block;
3. each block, knowing its entry, names its packs and which of them join the segment before, and builds its segments.
   Pieces of segments that cross a block's end are joined by their number: heads before the block, and within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import constants as K
from corpusflow.operators.segment import _check_bounds
from corpusflow.session import ship_package

#: Paragraphs of a block (a task holds the texts of one block at a time).
BLOCK = 10_000


def most_in_pack(max_len: int) -> int:
    """A pack holds no more paragraphs: each has a character at least, and a joiner of two."""
    return (max_len + 2) // 3 + 1


def next_starts(lengths: np.ndarray, max_len: int) -> np.ndarray:
    """For a pack that begins at each paragraph, where the one after it begins."""
    upto = np.concatenate([[0], np.cumsum(lengths + 2)])
    fits = np.searchsorted(upto, upto[:-1] + max_len + 2, "right") - 1
    return np.maximum(fits, np.arange(1, len(lengths) + 1))


def block_exits(lengths: np.ndarray, own: int, max_len: int) -> np.ndarray:
    """For each entry among a block's first paragraphs: the first pack start at or after the block's end, counted from there.

    ``lengths`` are those of the block's ``own`` paragraphs and of the ones that follow it.
    """
    to = np.arange(len(lengths) + 1)
    to[:own] = next_starts(lengths, max_len)[:own]
    while (to[:own] < own).any():
        to = to[to]
    return to[:min(own, most_in_pack(max_len))] - own


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows equal in their first ``n`` columns."""
    now, rows = None, []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if r[:n] != now:
                if rows:
                    yield now, rows
                now, rows = r[:n], []
            rows.append(r)
    if rows:
        yield now, rows


def _out(rows: Iterator[tuple], schema: pa.Schema, most: int = 5_000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def segment_paragraphs(paras: DataFrame, keys: list[str], row_no: str = "row_no", content: str = "content",
                       min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN) -> DataFrame:
    """G1 of documents given as paragraphs: (keys..., seg_no, content), the rows :func:`segment` gives for whole documents.

    ``paras`` holds each document's stripped, non-blank paragraphs, numbered from 1 by ``row_no`` without gaps.
    Null keys are a document like any other.
    """
    _check_bounds(min_len, max_len)
    from corpusflow.operators.infer import materialize
    spark = paras.sparkSession
    ship_package(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    halo, k = most_in_pack(max_len) + 1, len(keys)
    if BLOCK < halo:
        raise ValueError(f"blocks of {BLOCK} paragraphs are too short for packs of {max_len} characters")
    at = (F.col(row_no) - 1).cast("bigint")
    block = F.floor(at / BLOCK).cast("bigint")
    place = F.pmod(at, F.lit(BLOCK)).cast("bigint")
    rows = paras.select(*keys, block.alias("block"), place.alias("place"), F.length(content).cast("bigint").alias("len"), F.col(content).alias("text"))
    own = rows.withColumn("kind", F.lit(1))
    ahead = rows.filter((F.col("block") > 0) & (F.col("place") < halo)).withColumn("block", F.col("block") - 1).withColumn("text", F.lit(None).cast("string")).withColumn("kind", F.lit(2))
    key_fields = [paras.schema[c] for c in keys]

    # 1: maps
    lengths = own.drop("text").unionByName(ahead.drop("text")).select(*keys, "block", "kind", "place", "len")
    dealt = lengths.repartition(tasks, *keys, "block").sortWithinPartitions(*keys, "block", "kind", "place")
    map_schema = T.StructType([*key_fields, T.StructField("block", T.LongType()), T.StructField("own", T.LongType()), T.StructField("exits", T.ArrayType(T.LongType()))])
    map_arrow = _arrow(map_schema)

    def maps(batches):
        def made():
            for key, found in _grouped(batches, k + 1):
                n = sum(r[k + 1] == 1 for r in found)
                yield *key, n, block_exits(np.array([r[k + 3] for r in found], np.int64), n, max_len).tolist()
        return _out(made(), map_arrow)

    # 2: entries
    entry_schema = T.StructType([*key_fields, T.StructField("block", T.LongType()), T.StructField("entry", T.LongType())])
    entry_arrow = _arrow(entry_schema)

    def follow(batches):
        def made():
            now, entry = None, 0
            for b in batches:
                for r in zip(*[c.to_pylist() for c in b.columns]):
                    if r[:k] != now:
                        now, entry = r[:k], 0
                    yield *r[:k + 1], entry
                    n, exits = r[k + 1], r[k + 2]
                    entry = exits[entry] if entry < len(exits) else entry - n
        return _out(made(), entry_arrow)

    mapped = dealt.mapInArrow(maps, map_schema)
    by_document = mapped.repartition(tasks, *keys) if keys else mapped.repartition(1)          # a row per block
    entries = by_document.sortWithinPartitions(*keys, "block").mapInArrow(follow, entry_schema)

    # 3: segments of each block
    piece_schema = T.StructType([*key_fields, T.StructField("block", T.LongType()), T.StructField("local", T.LongType()), T.StructField("heads", T.LongType()),
                                 T.StructField("content", T.StringType())])
    piece_arrow = _arrow(piece_schema)
    told = entries.select(*keys, "block", F.lit(0).alias("kind"), F.col("entry").alias("place"), F.lit(0).cast("bigint").alias("len"), F.lit(None).cast("string").alias("text"))
    columns = [*keys, "block", "kind", "place", "len", "text"]
    blocks = told.unionByName(own.select(*columns)).unionByName(ahead.select(*columns))
    blocks = blocks.repartition(tasks, *keys, "block").sortWithinPartitions(*keys, "block", "kind", "place")

    def build(batches):
        def made():
            for key, found in _grouped(batches, k + 1):
                entry, texts = found[0][k + 2], [r[k + 4] for r in found if r[k + 1] == 1]
                size = np.array([r[k + 3] for r in found[1:]], np.int64)
                to = next_starts(size, max_len)
                upto = np.concatenate([[0], np.cumsum(size + 2)])
                heads, i = [], entry
                while i < len(texts):
                    j = int(to[i])
                    if (key[-1] == 0 and i == 0) or upto[j] - upto[i] - 2 >= min_len:
                        heads.append(i)
                    i = j
                cuts = [0, *heads, len(texts)]
                for local, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if b > a:
                        yield *key, local, len(heads), K.SEGMENT_JOINER.join(texts[a:b])
        return _out(made(), piece_arrow)

    pieces = materialize(blocks.mapInArrow(build, piece_schema))
    sizes = pieces.select(*keys, "block", "heads").distinct()
    order = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("heads").over(order.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.col("block").alias("_b"), before.alias("_before"))   # a row per block
    on = pieces["block"] == starts["_b"]
    for i, c in enumerate(keys):
        on = on & pieces[c].eqNullSafe(starts[f"_k{i}"])
    named = pieces.join(starts, on).select(*[pieces[c] for c in keys], "block", "local", "heads", (F.col("_before") + F.col("local")).cast("bigint").alias("seg_no"), "content")
    whole = (F.col("local") > 0) & (F.col("local") < F.col("heads"))
    parts = F.sort_array(F.collect_list(F.struct("block", "content")))
    crossing = named.filter(~whole).groupBy(*keys, "seg_no").agg(F.array_join(F.transform(parts, lambda x: x["content"]), K.SEGMENT_JOINER).alias("content"))
    return named.filter(whole).select(*keys, "seg_no", "content").unionByName(crossing.select(*keys, "seg_no", "content"))


def segment_files(ranges: DataFrame, encodings: list[str] | None = None, min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN) -> DataFrame:
    """G1 of text files read by ranges (``sources.ranges.file_ranges``): (file_path, seg_no, content), each file divided over tasks throughout."""
    from corpusflow.sources.ranges import read_pieces
    return segment_paragraphs(read_pieces(ranges, 2, encodings), ["file_path"], min_len=min_len, max_len=max_len)
