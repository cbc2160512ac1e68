"""K2, one output per file, at scale: as many container files as buckets, and an index by key.

A container holds the outputs of many keys one after the other; the index says where each begins and ends.  A key with many rows
has several extents, each in the container its number hashes to, so a hot key fills none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.session import ship_package
from corpusflow.sinks.writers import run_folder
from corpusflow.store import open_store, qualified

#: Rows of a key in one extent.
EXTENT_ROWS = 10_000
_INDEX = "key string, extent bigint, container string, first bigint, length bigint, rows bigint"


def write_containers(rows: DataFrame, path: str, run_id: str, key: str, order: str, buckets: int = 64) -> None:
    """Writes ``rows`` as JSON lines, without ``key``, into ``buckets`` containers below the run's folder, and their index.

    ``order`` numbers a key's rows.  A task that runs again writes the same container under the same name, as a whole.
    Null keys are one key of their own.
    """
    spark = rows.sparkSession
    ship_package(spark)
    folder = run_folder(path, run_id)
    data = [c for c in rows.columns if c != key]
    extent = F.floor(F.col(order) / EXTENT_ROWS).cast("bigint")
    lines = rows.select(F.col(key).cast("string").alias("key"), extent.alias("extent"), F.col(order).alias("_order"),
                        F.to_json(F.struct(*data), {"ignoreNullFields": "false"}).alias("line"))
    bucket = F.pmod(F.xxhash64("key", "extent"), F.lit(buckets)).cast("int")
    dealt = lines.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "extent", "_order")
    uri = qualified(spark, f"{folder}/containers")
    arrow = pa.schema([("key", pa.string()), ("extent", pa.int64()), ("container", pa.string()), ("first", pa.int64()), ("length", pa.int64()), ("rows", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(uri)
        store.create_dir(root, recursive=True)
        out = now = pending = None
        at, index, entry = 0, [], None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), arrow.types)], schema=arrow)

        def close():
            if out is not None:
                out.close()
                store.move(pending, f"{root}/{name(now)}")

        def name(b):
            return f"container-{b:06d}.jsonl"

        for b in batches:
            for key_, extent_, line, bucket_ in zip(*[c.to_pylist() for c in b.columns]):
                if bucket_ != now:
                    close()
                    now, at, entry, pending = bucket_, 0, None, f"{root}/_pending-{uuid.uuid4().hex}"
                    out = store.open_output_stream(pending)
                if entry is None or entry[:2] != [key_, extent_]:
                    entry = [key_, extent_, name(now), at, 0, 0]
                    index.append(entry)
                raw = line.encode("utf-8", "surrogatepass") + b"\n"
                out.write(raw)
                at += len(raw)
                entry[4] += len(raw)
                entry[5] += 1
            if len(index) > 10_000:         # all but the open one are whole
                last = index.pop()
                yield batch()
                index = [last]
        close()
        if index:
            yield batch()

    dealt.select("key", "extent", "line", "bucket").mapInArrow(write, _INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    _save_schema(spark, rows.schema, key, folder)


def _save_schema(spark: SparkSession, schema: T.StructType, key: str, folder: str) -> None:
    spark.createDataFrame([(key, schema.json())], "key string, schema string").coalesce(1).write.mode("overwrite").json(f"{folder}/schema")


def read_index(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(f"{run_folder(path, run_id)}/index")


def read_containers(spark: SparkSession, path: str, run_id: str, keys: DataFrame | None = None) -> DataFrame:
    """The rows of the keys in ``keys`` (its first column), or of all: only their bytes are read."""
    folder = run_folder(path, run_id)
    saved = spark.read.schema("key string, schema string").json(f"{folder}/schema").first()
    key, schema = saved["key"], T.StructType.fromJson(json.loads(saved["schema"]))
    found = read_index(spark, path, run_id)
    if keys is not None:
        wanted = keys.select(F.col(keys.columns[0]).cast("string").alias("_k")).distinct()
        found = found.join(wanted, F.col("key").eqNullSafe(F.col("_k")), "left_semi")
    uri = qualified(spark, f"{folder}/containers")
    arrow = pa.schema([("key", pa.string()), ("line", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(uri)
        now = f = None
        for b in batches:
            for key_, _, container, first, length, _ in zip(*[c.to_pylist() for c in b.columns]):
                if container != now:
                    now, f = container, store.open_input_file(f"{root}/{container}")
                lines = f.read_at(length, first).decode("utf-8", "surrogatepass").split("\n")[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([key_] * len(lines), pa.string()), pa.array(lines, pa.string())], schema=arrow)

    dealt = found.repartition("container").sortWithinPartitions("container", "first")
    rest = T.StructType([f for f in schema if f.name != key])
    rows = dealt.mapInArrow(read, "key string, line string").select(F.col("key").cast(schema[key].dataType).alias(key), F.from_json("line", rest).alias("_r"))
    return rows.select(*[F.col(key) if c == key else F.col("_r")[c].alias(c) for c in schema.names])
