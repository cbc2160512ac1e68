"""K3 as one ordered document: a header once, rows in order, whatever the number of tasks.

Rows are range-sorted and each range is written as a part.  Parts are named in order, the byte-order mark and the header are in the
first alone, and a manifest says at which byte of the whole each begins (sizes of the parts, summed up).  So the parts, read in
order, are the document; where tasks can write at a place of a file, :func:`join_parts` makes them one file, each task its own bytes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.session import ship_package
from corpusflow.sinks.writers import run_folder
from corpusflow.store import open_store, qualified

BOM = "﻿"
#: Bytes copied at a time.
STEP = 8 << 20


def csv_line(cells: list[Column], sep: str = ",") -> Column:
    """Cells as one record: quoted where they hold the separator, a quote or a line break, quotes doubled; null is empty.
    An empty text is quoted, so that it is no null when read again."""
    def one(c: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        special = c.rlike("[\"\r\n" + ("\\t" if sep == "\t" else "\\" + sep) + "]") | (c == "")
        return F.when(c.isNull(), "").when(special, quoted).otherwise(c)
    return F.concat_ws(sep, *[one(c) for c in cells])


def write_ordered(df: DataFrame, path: str, run_id: str, order: list[str], fmt: str = "csv", mark: bool = True) -> DataFrame:
    """Writes ``df`` in the order of ``order`` and returns the manifest: part, file, rows, bytes, first (byte of the whole).

    ``csv``: comma-separated under a header, after a byte-order mark (``mark``); ``text``: the one column besides those of ``order`` as
    lines, or several columns tab-separated under a header.  Every line ends with a line feed.  Rows equal in ``order`` are in any order.
    A range that is written again after a failure has the same name and replaces its file as a whole.
    """
    if fmt not in ("csv", "text"):
        raise ValueError(f"unknown format {fmt!r}")
    spark = df.sparkSession
    ship_package(spark)
    folder = run_folder(path, run_id)
    data = [c for c in df.columns if c not in order]
    plain = fmt == "text" and len(data) == 1
    sep = "," if fmt == "csv" else "\t"
    cells = [F.col(f"`{c}`").cast("string") for c in df.columns]
    line = F.coalesce(F.col(f"`{data[0]}`").cast("string"), F.lit("")) if plain else csv_line(cells, sep)
    rows = df.select(F.lit(1).alias("_at"), *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)], line.alias("_line"))
    if not plain or (mark and fmt == "csv"):
        names = csv_line([F.lit(c) for c in df.columns], sep)
        head = spark.range(1).select(F.lit(0).alias("_at"), *[F.lit(None).cast(rows.schema[f"_o{i}"].dataType).alias(f"_o{i}") for i in range(len(order))],
                                     F.concat(F.lit(BOM if mark and fmt == "csv" else ""), names).alias("_line"))
        rows = rows.unionByName(head)
    keys = ["_at", *[f"_o{i}" for i in range(len(order))]]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_line")
    uri, extension = qualified(spark, folder), "csv" if fmt == "csv" else "txt"
    arrow = pa.schema([("part", pa.int64()), ("file", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, count, size = TaskContext.get().partitionId(), 0, 0
        store, root = open_store(uri)
        name, pending = f"part-{part:06d}.{extension}", f"{root}/_pending-{uuid.uuid4().hex}"
        store.create_dir(root, recursive=True)
        with store.open_output_stream(pending) as out:
            for b in batches:
                for s in b.column(0).to_pylist():
                    raw = s.encode("utf-8", "surrogatepass") + b"\n"
                    out.write(raw)
                    count, size = count + 1, size + len(raw)
        if not count:
            store.delete_file(pending)
            return
        store.move(pending, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([count]), pa.array([size])], schema=arrow)

    at = f"{folder}/_manifest"
    ranged.mapInArrow(write, "part bigint, file string, rows bigint, bytes bigint").write.mode("overwrite").parquet(at)
    manifest = read_manifest(spark, path, run_id)
    _drop_others(uri, {r["file"] for r in manifest.select("file").collect()})       # as many names as there were tasks
    return manifest


def _drop_others(uri: str, parts: set[str]) -> None:
    """Removes parts that an earlier writing of the run left, and unfinished ones."""
    from pyarrow import fs
    store, root = open_store(uri)
    for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.is_file and f.base_name.startswith(("part-", "_pending-")) and f.base_name not in parts:
            store.delete_file(f.path)


def read_manifest(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The parts of a run and where each begins in the whole (a row per part)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = spark.read.schema("part bigint, file string, rows bigint, bytes bigint").parquet(f"{run_folder(path, run_id)}/_manifest")
    return parts.select("*", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("bigint").alias("first"))


def join_parts(spark: SparkSession, path: str, run_id: str, name: str) -> str:
    """One file of a run's parts, in a store where tasks write at a place of a file (a shared folder); returns its path.

    Each part is copied to its own bytes by its own task, so a task that runs twice writes the same again.
    """
    folder = qualified(spark, run_folder(path, run_id))
    if not folder.startswith("file:"):
        raise ValueError("parts can be joined in a shared folder only; elsewhere the parts in order are the document")
    parts = read_manifest(spark, path, run_id).select("file", "first", "bytes")
    _, root = open_store(folder)
    target = f"{root}/{name}"

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first, _ in zip(*[c.to_pylist() for c in b.columns]):
                out = os.open(target, os.O_WRONLY | os.O_CREAT, 0o644)
                try:
                    with open(f"{root}/{file}", "rb") as f:
                        at = first
                        while data := f.read(STEP):
                            os.pwrite(out, data, at)
                            at += len(data)
                finally:
                    os.close(out)
                yield pa.RecordBatch.from_arrays([pa.array([at - first])], names=["bytes"])

    n = max(1, parts.count())
    copied, wanted = parts.repartition(n).mapInArrow(copy, "bytes bigint").agg(F.sum("bytes")).first()[0], parts.agg(F.sum("bytes")).first()[0]
    if copied != wanted:
        raise RuntimeError(f"{copied} bytes joined of {wanted}")
    return f"{run_folder(path, run_id)}/{name}"
