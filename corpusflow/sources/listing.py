"""S1 at scale: the files below a folder, listed by tasks, hidden names included.

Folders are listed round by round: a round's rows are the folders met by the round before, dealt over tasks, and each task lists its
folders in the store itself.  The driver sees one number per round, as many rounds as folders are deep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import scratch_path, ship_package
from corpusflow.store import open_store, qualified

#: Folders that a task lists, about.
FOLDERS_PER_TASK = 50
_FOUND = "path string, folder boolean, size bigint, mtime_us bigint, hidden boolean"


def hidden_name(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name[:1] in ("_", ".")


def list_files(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, size, modified, hidden) of every file below the folder ``path``, or of the file ``path``; None if there is neither, as where
    ``path`` is a pattern.

    Files of a hidden name are listed as such, but for writers' own ``_SUCCESS`` and checksum files; hidden folders aren't entered.
    """
    from pyarrow import fs
    ship_package(spark)
    uri = qualified(spark, path)
    store, root = open_store(uri)
    start = store.get_file_info(root)
    if start.type == fs.FileType.NotFound:
        return None
    if start.is_file:
        rows = spark.createDataFrame([(uri, start.size, start.mtime_ns // 1000)], "path string, size bigint, mtime_us bigint")
        return rows.select("path", "size", F.timestamp_micros("mtime_us").alias("modified"), F.lit(False).alias("hidden"))
    prefix = uri[:len(uri) - len(root)] if uri.endswith(root) else uri.split(root.rstrip("/").split("/")[0])[0]
    arrow = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("mtime_us", pa.int64()), ("hidden", pa.bool_())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = open_store(uri)
        for b in batches:
            for folder in b.column(0).to_pylist():
                held = []
                for f in where.get_file_info(fs.FileSelector(open_store(folder)[1])):
                    hidden = hidden_name(f.base_name)
                    is_folder = f.type == fs.FileType.Directory
                    if hidden and (is_folder or f.base_name == "_SUCCESS" or f.base_name.endswith(".crc")):
                        continue
                    held.append((prefix + f.path, is_folder, None if is_folder else f.size, None if f.mtime_ns is None else f.mtime_ns // 1000, hidden))
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    out, level, folders, n = scratch_path(spark, "listing"), 0, spark.createDataFrame([(uri,)], "path string"), 1
    while n:
        at = f"{out}/level={level}"
        folders.repartition(max(1, min(n // FOLDERS_PER_TASK, 10_000))).mapInArrow(look, _FOUND).write.parquet(at)
        folders = spark.read.schema(_FOUND).parquet(at).filter("folder").select("path")
        n, level = folders.count(), level + 1
    found = spark.read.schema(_FOUND).parquet(out).filter("NOT folder")
    shown = lambda c: F.when(~F.col("hidden"), F.col(c))
    return found.select("path", shown("size").alias("size"), F.timestamp_micros(shown("mtime_us")).alias("modified"), "hidden")
