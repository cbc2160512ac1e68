"""Aggregations and reports.

Every report is one grouped aggregation with map-side partial aggregation, so a
hot group (one file, one column, one language) is combined inside each task
before the shuffle and never lands whole on one reducer.  Ratios use
``try_divide`` so that an empty group gives null instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.text import excerpt, is_blank, strip_ws


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


# --- R8 ---------------------------------------------------------------------------

def segment_stats(segments: DataFrame, by: list[str] | None = None, key: str = "doc_id",
                  content: str = "content") -> DataFrame:
    """R8 over segment rows: files, segments, characters, mean segment length.

    Pre-aggregates per file first (one row per file and group), so the file
    count needs no distinct aggregation and a hot group stays partial-aggregated.
    """
    by = by or []
    per_file = segments.groupBy(*by, key).agg(
        F.count("*").alias("_n"), F.sum(F.length(content)).alias("_c"))
    return per_file.groupBy(*by).agg(
        F.count("*").cast("bigint").alias("files"),
        F.sum("_n").cast("bigint").alias("segments"),
        F.sum("_c").cast("bigint").alias("chars"),
        _ratio(F.sum("_c"), F.sum("_n")).alias("avg_len"),
    )


def segment_stats_arrays(df: DataFrame, segs: str = "segments", by: list[str] | None = None) -> DataFrame:
    """R8 straight from per-document segment arrays: no explode, one aggregate."""
    by = by or []
    n = F.size(segs)
    chars = F.aggregate(F.col(segs), F.lit(0).cast("bigint"), lambda a, s: a + F.length(s))
    per_doc = df.select(*by, n.alias("_n"), chars.alias("_c"))
    return per_doc.groupBy(*by).agg(
        F.count_if(F.col("_n") > 0).cast("bigint").alias("files"),
        F.sum("_n").cast("bigint").alias("segments"),
        F.sum("_c").cast("bigint").alias("chars"),
        _ratio(F.sum("_c"), F.sum("_n")).alias("avg_len"),
    )


# --- R1 ---------------------------------------------------------------------------

def workload_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, non-blank rows and their mean character length, plus a
    ``__total__`` row (rollup).  Null counts as blank."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    long = df.select(pairs.alias("_p")).select("_p.column", "_p.value").filter(~is_blank("value"))
    agg = long.rollup("column").agg(
        F.count("*").cast("bigint").alias("items"),
        F.avg(F.length("value")).alias("avg_len"),
    )
    return agg.select(F.coalesce("column", F.lit("__total__")).alias("column"), "items", "avg_len")


# --- R2, R3, R4 ----------------------------------------------------------------------

def _group_or_total(column: str) -> Column:
    """Name of a rollup's row: its group, null too, or the total's."""
    return F.when(F.col("_total") == 1, F.lit("__total__")).otherwise(F.col(column))


def _is_failed(c: Column) -> Column:
    return F.startswith(F.coalesce(c, F.lit("")), F.lit(K.FAILED))


def outcome_stats(results: DataFrame, column: str = "column", result: str = "result") -> DataFrame:
    """R2: per column and in total (rollup): items, success (non-empty and not
    starting with the failure marker), failed = items - success, percentages."""
    r = F.col(result)
    ok = (F.length(F.coalesce(r, F.lit(""))) > 0) & ~_is_failed(r)
    agg = results.rollup(column).agg(
        F.grouping(column).alias("_total"),
        F.count("*").cast("bigint").alias("items"),
        F.count_if(ok).cast("bigint").alias("success"),
    )
    return agg.select(
        _group_or_total(column).alias("column"),
        "items", "success",
        (F.col("items") - F.col("success")).alias("failed"),
        (_ratio(F.col("success"), F.col("items")) * 100).alias("success_pct"),
        (_ratio(F.col("items") - F.col("success"), F.col("items")) * 100).alias("failed_pct"),
    )


def result_lengths(results: DataFrame, column: str = "column", result: str = "result") -> DataFrame:
    """Over stripped results: non-empty, failed (starting with the marker),
    success = difference, mean length of the non-empty ones (failures included)."""
    s = strip_ws(F.coalesce(F.col(result), F.lit("")))
    nonempty = F.length(s) > 0
    return results.groupBy(column).agg(
        F.count_if(nonempty).cast("bigint").alias("non_empty"),
        F.count_if(F.startswith(s, F.lit(K.FAILED))).cast("bigint").alias("failed"),
        (F.count_if(nonempty) - F.count_if(F.startswith(s, F.lit(K.FAILED)))).cast("bigint").alias("success"),
        F.avg(F.when(nonempty, F.length(s))).alias("avg_len"),
    )


def quality_report(results: DataFrame, column: str = "column", result: str = "result") -> DataFrame:
    """Empty (blank), error (matches the error pattern), valid = rest, with
    shares of all rows.  A valid answer that mentions failure counts as an error,
    exactly as the text rule says."""
    r = F.coalesce(F.col(result), F.lit(""))
    empty = F.length(strip_ws(r)) == 0
    error = r.rlike(K.QUALITY_ERROR_PATTERN)
    agg = results.groupBy(column).agg(
        F.count("*").cast("bigint").alias("rows"),
        F.count_if(empty).cast("bigint").alias("empty"),
        F.count_if(error).cast("bigint").alias("error"),
    )
    valid = F.col("rows") - F.col("empty") - F.col("error")
    return agg.select(
        column, "rows", "empty", "error", valid.alias("valid"),
        (_ratio(valid, F.col("rows")) * 100).alias("valid_pct"),
        (_ratio(F.col("error"), F.col("rows")) * 100).alias("error_pct"),
        (_ratio(F.col("empty"), F.col("rows")) * 100).alias("empty_pct"),
    )


# --- R5 ---------------------------------------------------------------------------

def sample_preview(df: DataFrame, order: list[str], columns: list[str], n: int = 3,
                   width: int = K.EXCERPT_PREVIEW, processed_suffix: str = "_processed") -> DataFrame:
    """The first ``n`` rows by ``order`` (a top-k: ``TakeOrderedAndProject``),
    with excerpts of each source column and, when present, its processed twin."""
    present = set(df.columns)
    cols = []
    for c in columns:
        cols.append(excerpt(F.col(c).cast("string"), width).alias(c))
        p = f"{c}{processed_suffix}"
        if p in present:
            cols.append(excerpt(F.col(p).cast("string"), width).alias(p))
    return df.orderBy(*order).limit(n).select(*order, *cols)


# --- R6, R7, R10 ------------------------------------------------------------------------

def file_profile(files: DataFrame) -> DataFrame:
    """Per readable file: type, size, rows, and the columns of its own header
    (``corpus_files`` output; empty files have their row)."""
    return files.filter(F.col("rows").isNotNull()).select(
        "file_path", F.col("ext").alias("type"), F.col("size").cast("bigint").alias("size"), "rows",
        F.size("columns").cast("bigint").alias("columns"))


def filter_report(files: DataFrame, matched: str = "matched", path: str = "path", show: int = 10) -> DataFrame:
    """Total files, matched files, the first ``show`` matched names in path
    order and how many more there are.

    The names come from a bounded top-k (``orderBy().limit()``), never from
    collecting all names; the two one-row results are combined by a union and
    an aggregate, not a join.
    """
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    counts = files.agg(F.count("*").cast("bigint").alias("total"),
                       F.count_if(F.col(matched)).cast("bigint").alias("matched"))
    first = (files.filter(F.col(matched)).select(path, name.alias("n")).orderBy(path).limit(show)
             .agg(F.collect_list(F.struct(F.col(path).alias("p"), F.col("n"))).alias("_l")))
    first = first.select(F.transform(F.array_sort("_l"), lambda x: x["n"]).alias("first_names"))
    both = counts.select("total", "matched", F.lit(None).cast("array<string>").alias("first_names")).unionByName(
        first.select(F.lit(None).cast("bigint").alias("total"), F.lit(None).cast("bigint").alias("matched"),
                     "first_names"))
    out = both.agg(F.max("total").alias("total"), F.max("matched").alias("matched"),
                   F.max("first_names").alias("first_names"))
    return out.select("total", "matched", F.coalesce("first_names", F.array().cast("array<string>")).alias("first_names"),
                      F.greatest(F.col("matched") - show, F.lit(0)).cast("bigint").alias("more"))


def corpus_outcome(files: DataFrame, status: str = "status", path: str = "file_path") -> DataFrame:
    """Files per status (processed / failed ...) with the total as a rollup row."""
    agg = files.rollup(status).agg(F.grouping(status).alias("_total"), F.count("*").cast("bigint").alias("files"))
    return agg.select(_group_or_total(status).alias(status), "files")


# --- R9 ---------------------------------------------------------------------------

def throughput(results: DataFrame, column: str = "column", total: dict[str, int] | None = None) -> DataFrame:
    """Per column and overall (``__total__``): items done, items per second over
    the wall-clock span of the calls (``started_at`` .. ``finished_at`` of the
    result rows), mean call latency, and -- given the planned ``total`` per column --
    remaining items, estimated remaining seconds and percent done."""
    span = F.max("finished_at") - F.min("started_at")
    agg = results.rollup(column).agg(
        F.grouping(column).alias("_total"),
        F.count("*").cast("bigint").alias("done"),
        span.alias("span_s"),
        F.avg(F.col("finished_at") - F.col("started_at")).alias("mean_latency_s"),
    )
    rate = F.try_divide(F.col("done").cast("double"), F.col("span_s"))
    out = agg.select(_group_or_total(column).alias(column), "done", "span_s", "mean_latency_s", rate.alias("items_per_s"))
    if total is not None:
        planned = F.lit(None).cast("bigint")
        for name, n in [*total.items(), ("__total__", sum(total.values()))]:
            planned = F.when(F.col(column) == name, F.lit(n).cast("bigint")).otherwise(planned)
        out = out.withColumn("planned", planned)
        remaining = F.greatest(F.col("planned") - F.col("done"), F.lit(0))
        out = out.select("*", remaining.alias("remaining"),
                         F.try_divide(remaining.cast("double"), F.col("items_per_s")).alias("eta_s"),
                         (F.try_divide(F.col("done").cast("double"), F.col("planned").cast("double")) * 100).alias("pct_done")).drop("planned")
    return out
