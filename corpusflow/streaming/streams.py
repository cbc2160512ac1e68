"""Structured Streaming operators (ST1, ST2).

Both are bounded incremental runs (``Trigger.AvailableNow``): new input files
are picked up once, progress lives in a checkpoint location in the shared
folder, and a stopped run resumes where it left off.  Neither needs event
time, watermarks or state: segmentation and inference are per-row.
"""

from __future__ import annotations

import hashlib
import time
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import constants as K
from corpusflow.functions.text import strip_ws
from corpusflow.operators import infer as M
from corpusflow.operators import dataset as D
from corpusflow.operators.segment import explode_segments, with_segments
from corpusflow.sources.corpus import any_case, decode_corpus, normalize_newlines, plain_path


def _source(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
            glob: str | None = None, max_files: int | None = None, options: dict | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


def segment_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType,
                   keys: list[str], text: str = "text", fmt: str = "parquet", glob: str | None = None,
                   min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN,
                   delim: str = K.PARAGRAPH_DELIM, max_files: int | None = None, options: dict | None = None,
                   tasks: list[str] | None = None, **sample_options):
    """ST1: documents arriving as files -> segment rows appended to ``sink``.

    Stateless, so the append output mode needs no watermark; a rerun with the
    same checkpoint only processes files it has not seen.  With ``tasks`` the
    samples of these tasks are written instead of the segments.  Novels arriving
    as files of any encoding: :func:`novel_stream`.  ``keys=["file_path"]`` takes the path from ``_metadata``."""
    src = _source(spark, source, schema, fmt, glob, max_files, options)
    if "file_path" in keys and "file_path" not in src.columns:
        src = src.withColumn("file_path", plain_path(F.col("_metadata.file_path")))
    return _segments_to(src.select(*keys, text), sink, checkpoint, keys, text, min_len, max_len, delim, tasks, sample_options)


def _segments_to(docs, sink, checkpoint, keys, text, min_len, max_len, delim, tasks, sample_options):
    segs = explode_segments(with_segments(docs, text, "segments", min_len, max_len, delim).drop(text),
                            keys, "segments", "content")
    if tasks:
        segs = D.build_dataset(segs, [*keys, "seg_no"], tasks, **sample_options)
    q = (segs.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return q


def novel_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, encodings: list[str] | None = None,
                 extensions: list[str] | None = None, min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN,
                 delim: str = K.PARAGRAPH_DELIM, max_files: int | None = None, tasks: list[str] | None = None,
                 outcomes: str | None = None, **sample_options):
    """ST1 over text files as the batch reader sees them: decoded (S6), newlines and
    byte-order mark normalised (S7), keyed by ``file_path``; stream and batch give the same rows.
    ``outcomes``: a table to which a second stream over the same files appends, once for each file, file_path, size, encoding_used
    and status (read, empty or undecodable)."""
    globs = ",".join(any_case(e)[1:] for e in (extensions or K.NOVEL_EXTENSIONS))
    schema = "path string, modificationTime timestamp, length long, content binary"
    src = _source(spark, source, schema, "binaryFile", "*{" + globs + "}", max_files, {"recursiveFileLookup": "true"})
    if outcomes:
        named = decode_corpus(src.select(F.col("path").alias("file_path"), F.col("length").alias("size"), "content"), encodings)
        blank = F.length(strip_ws(normalize_newlines("text"))) == 0
        status = F.when(F.col("text").isNull(), "undecodable").when(blank, "empty").otherwise("read")
        told = (named.select("file_path", "size", "encoding_used", status.alias("status")).writeStream.format("parquet").outputMode("append")
                .option("checkpointLocation", f"{checkpoint.rstrip('/')}-outcomes").trigger(availableNow=True).start(outcomes))
        told.awaitTermination()
    raw = src.select(F.col("path").alias("file_path"), "content")
    docs = decode_corpus(raw, encodings).select("file_path", normalize_newlines("text").alias("text"))
    return _segments_to(docs, sink, checkpoint, ["file_path"], "text", min_len, max_len, delim, tasks, sample_options)


def infer_stream(spark: SparkSession, source: str, results: str, checkpoint: str, schema: T.StructType,
                 keys: list[str], columns: list[str], prompt: str, fn: M.ModelFn, fmt: str = "parquet",
                 glob: str | None = None, max_files: int | None = 1,
                 sleep: Callable[[float], None] = time.sleep, **kw):
    """ST2: bounded increments of inference with safe stop and resume.

    Each micro-batch overwrites its own folder, ``run=<of the checkpoint>/batch_id=<n>``,
    so a batch replayed after a failure rewrites the same files instead of
    duplicating them, and another checkpoint never touches them.  A row whose good result is
    already there (same keys, prompt and values; only keys, digest and outcome are read) is skipped: no second
    model call.  A row that failed is tried again when a source delivers it again; :func:`stream_results` reads the outcome."""
    src = _source(spark, source, schema, fmt, glob, max_files)
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    root = results.rstrip("/")

    def handle(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        rows = batch.select(*keys, *columns)
        history = M.read_results(s, root, _history_schema(rows, keys, columns))
        if history is not None:
            own = (F.col("run") == run) & (F.col("batch_id") == batch_id)
            seen = history.filter(~own & _good(columns)).select(*keys, M.ROW)
            known = rows.withColumn(M.ROW, M.row_digest(columns, prompt))
            same = M._same(known, seen, keys) & (seen[M.ROW].isNull() | (known[M.ROW] == seen[M.ROW]))
            rows = known.join(seen, same, "left_anti").drop(M.ROW)
        out = M.infer_columns(rows, keys, columns, prompt, fn, sleep=sleep, **kw)
        out.withColumn(M.ROW, M.row_digest(columns, prompt)).write.mode("overwrite").parquet(f"{root}/run={run}/batch_id={batch_id}")

    q = (src.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _history_schema(rows: DataFrame, keys: list[str], columns: list[str]) -> T.StructType:
    """What the results of earlier batches are read as; known, so that a folder without files is readable."""
    text = [T.StructField(c, T.StringType()) for c in (M.ROW, *[f"{c}_processed" for c in columns], "run")]
    return T.StructType([*[rows.schema[k] for k in keys], *text, T.StructField("batch_id", T.LongType())])


def _good(columns: list[str]):
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~F.startswith(F.coalesce(f"{c}_processed", F.lit("")), F.lit(K.FAILED))
    return ok


def stream_results(spark: SparkSession, results: str, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of all micro-batches, and of a row that came in several of them those of the best: without a
    failure rather than with one, then the latest."""
    from pyspark.sql import Window
    rows = spark.read.parquet(results)
    best = Window.partitionBy(*keys, M.ROW).orderBy(_good(columns).desc(), F.col("run"), F.col("batch_id").desc())
    return rows.withColumn("_rank", F.dense_rank().over(best)).filter("_rank = 1").drop("_rank")


def processed(df: DataFrame, results: DataFrame, keys: list[str], columns: list[str], prompt: str) -> DataFrame:
    """``df`` with ``<col>_processed`` from what the micro-batches wrote, each of its rows once: rows equal in keys and values
    share an answer, though it was written with the first batch that had one of them."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_processed").alias("result")) for c in columns]))
    told = results.select(*keys, M.ROW, cells.alias("_c")).select(*keys, M.ROW, "_c.column", "_c.result")
    return M.join_results(df, M.latest_results(told, [*keys, M.ROW, "column"]), keys, columns, prompt=prompt)


def progress(query) -> DataFrame | None:
    """R9 live values: rows per second and batch durations from the query's
    recent progress reports."""
    spark = SparkSession.getActiveSession()
    rows = [(p.get("batchId"), p.get("numInputRows"), p.get("inputRowsPerSecond"),
             p.get("processedRowsPerSecond"), (p.get("durationMs") or {}).get("triggerExecution"))
            for p in (query.recentProgress or [])]
    if spark is None:
        return None
    return spark.createDataFrame(rows, "batch_id long, input_rows long, input_rows_per_s double, "
                                       "processed_rows_per_s double, trigger_ms long")
