"""Sinks (K1-K3).

Each sink is one distributed write below ``<path>/run_id=<run_id>``, which
replaces the time-stamped file names of a single-machine tool: a rerun replaces
its own run and never touches another.  Values are written as they are: outer
blanks stay, and quotes are doubled inside quoted cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.operators.dataset import to_jsonl, to_messages
from corpusflow.session import keep_only, path_exists

#: Options under which a CSV cell comes back as it was, when reading and when writing.  A null is written as nothing and an empty
#: text as a pair of quotes; Spark's reader makes nulls of both, :func:`read_processed` tells them apart.
EXACT_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def run_folder(path: str, run_id: str) -> str:
    if not run_id or "/" in run_id:
        raise ValueError(f"a run id is a name without slashes, not {run_id!r}")
    return f"{path.rstrip('/')}/run_id={run_id}"


def write_messages(samples: DataFrame, path: str, run_id: str, task_col: str = "task_type",
                   mode: str = "overwrite") -> None:
    """K1: one JSONL dataset per task (``task_type=<task>/part-*.txt``), one
    ``{"messages": [...]}`` object per line, non-ASCII unescaped."""
    lines = samples.select(task_col, to_jsonl(to_messages("system", "user", "assistant")).alias("value"))
    lines.write.mode(mode).partitionBy(task_col).option("compression", "none").text(run_folder(path, run_id))


#: Folders that ``separate`` makes at most; every one costs the driver a commit and a listing, and the store a file.
MAX_FOLDERS = 10_000
#: Segments of a container, some 16 MB.
CONTAINER_ROWS = 20_000


def write_segments(segments: DataFrame, path: str, run_id: str, file_key: str = "doc_id",
                   separate: bool = False, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K2: the merged segment table, or one output per file (``separate``):
    ``partitionBy(file_key)`` keys by the full path/key, so equal base names in
    different folders never overwrite each other, and drops the key column
    from the files as the per-file tables do.  Parquet outputs of more than ``MAX_FOLDERS`` files, of which each would be a
    folder, become extents of containers with an index (:mod:`corpusflow.sinks.containers`), numbered by ``seg_no``;
    :func:`read_segments` reads either, whole or by key.  A run that is appended to keeps its folders."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    folder = run_folder(path, run_id)
    spark = segments.sparkSession
    held = _in_containers(spark, folder)
    if held and mode == "append":
        raise ValueError(f"{folder} holds containers, which are written as a whole")
    if separate and fmt == "parquet" and "seg_no" in segments.columns and (mode == "overwrite" or not path_exists(spark, folder)):
        sizes = segments.groupBy(file_key).agg(F.count(F.lit(1)).alias("n"))
        files, rows = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if files > MAX_FOLDERS:
            from corpusflow.sinks import containers
            containers.write_containers(segments, path, run_id, file_key, "seg_no", buckets=-(-rows // CONTAINER_ROWS))
            keep_only(spark, folder, ["containers", "index", "schema"])     # no folders of an earlier run
            return
    if held and mode == "overwrite":
        keep_only(spark, folder, [])
    w = segments.write.mode(mode)
    if separate:
        w = w.partitionBy(file_key)
    if fmt == "parquet":
        w.parquet(folder)
    else:
        w.options(**EXACT_CSV).csv(folder)


def _in_containers(spark: SparkSession, folder: str) -> bool:
    return path_exists(spark, f"{folder}/schema")        # written last


def read_segments(spark: SparkSession, path: str, run_id: str, file_key: str = "doc_id", keys: DataFrame | None = None) -> DataFrame:
    """The segments of a run that :func:`write_segments` wrote as Parquet, or those of the files in ``keys`` (its first column)."""
    folder = run_folder(path, run_id)
    if _in_containers(spark, folder):
        from corpusflow.sinks import containers
        return containers.read_containers(spark, path, run_id, keys)
    rows = spark.read.parquet(folder)
    if keys is None:
        return rows
    wanted = keys.select(F.col(keys.columns[0]).cast("string").alias("_k")).distinct()
    return rows.join(wanted, F.col(file_key).cast("string").eqNullSafe(F.col("_k")), "left_semi")


def write_processed(df: DataFrame, path: str, run_id: str, fmt: str = "csv", mode: str = "overwrite",
                    order: list[str] | None = None) -> None:
    """K3: ``csv`` with a header (no byte-order mark), or ``text``: a single
    column as plain lines, several columns tab-separated with a header.

    With ``order`` the rows are range-sorted by these columns first: the part
    files, read in name order, hold them in that order.  A text of one column
    besides the order columns is written as plain lines of that column.  Each part has its header here, and a plain line that
    holds line breaks becomes several; ``ordered.write_ordered`` writes one document with one header.
    """
    cols = list(df.columns)
    if order:
        df = df.orderBy(*order)
    target = run_folder(path, run_id)
    if fmt == "csv":
        df.write.mode(mode).options(**EXACT_CSV).csv(target)
    elif fmt == "text":
        data = [c for c in cols if not order or c not in order] or cols
        if len(data) == 1:
            df.select(F.col(data[0]).cast("string").alias("value")).write.mode(mode).text(target)
        else:
            df.write.mode(mode).options(**EXACT_CSV).option("sep", "\t").csv(target)
    else:
        raise ValueError(f"unknown format {fmt!r}")


#: Stands for an empty text while a CSV is read; a private character that no text has by itself.
_EMPTY = "\ue0fe\ue0ff"


def read_processed(spark: SparkSession, path: str, run_id: str, schema, sep: str = ",") -> DataFrame:
    """The rows that :func:`write_processed` wrote as CSV, empty texts and nulls as they were."""
    rows = (spark.read.options(**EXACT_CSV, multiLine=True, sep=sep, emptyValue=_EMPTY).schema(schema).csv(run_folder(path, run_id)))
    return rows.select(*[F.when(F.col(f"`{f.name}`") == _EMPTY, "").otherwise(F.col(f"`{f.name}`")).alias(f.name)
                         if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in rows.schema])
