"""Batch model inference over table columns (M1-M8).

Plan of ``infer_columns``:

    rows --(native: unpivot, blank filter, truncate, render)--> requests
         --(``distinct``: one request per digest)-->
         --(optional hash repartition on the key: total concurrency = p x k)-->
         mapInArrow: the user's ``fn`` per request, ``k`` threads per task,
                     typed retry policy, error class and attempts recorded
         --write (shared folder or a table the user names)--> keyed results, written once
         --(results of the chosen columns per key and row digest, left join back)--> table

A row is known by its keys and by the digest of the prompt and its chosen values.  Rows that share their keys, or
have none, still get their own answers, and an answer is used again only where prompt and values are the same.

The model is a user-supplied function ``fn(request: dict) -> str`` where the
request holds ``system``, ``user``, ``max_tokens`` (or None) and ``stop``.  It is
costly and perhaps not deterministic, so its results are written before
anything else reads them: a second action or a lost executor reads the saved
results instead of calling the model again.  With ``results_path`` tasks move them into a folder
that outlives the job, some hundred at a time (:mod:`corpusflow.sinks.calls`): an interrupted run
keeps what it has, and the next run calls the model only for what has no good result yet.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import constants as K
from corpusflow.operators import backoff
from corpusflow.operators.dataset import CONTENT, content_digest
from corpusflow.functions.text import is_blank, max_output_tokens, strip_ws, truncate_input
from corpusflow.session import path_exists, scratch_path, ship_package
from corpusflow.store import reachable

ModelFn = Callable[[dict], str]

# --- M1 -----------------------------------------------------------------------------


def render_request(text, prompt, profile: str = "processor", requested_tokens=None) -> Column:
    """M1: ``struct(system, user, max_tokens, stop)`` for a text and a prompt.

    processor: system prompt of the column processor, input capped at 10,000
    characters; builder: its own system prompt, input capped at 8,000, an output
    token budget (T9) and stop strings.
    """
    text = F.col(text) if isinstance(text, str) else text
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    if profile == "processor":
        body = truncate_input(text, K.PROCESSOR_INPUT_CAP, K.PROCESSOR_TRUNCATION_MARKER)
        system, tokens, stop = K.PROCESSOR_SYSTEM, F.lit(None).cast("bigint"), F.array().cast("array<string>")
    elif profile == "builder":
        body = truncate_input(text, K.BUILDER_INPUT_CAP, K.BUILDER_TRUNCATION_MARKER)
        system = K.BUILDER_SYSTEM
        tokens = max_output_tokens(body, requested_tokens)
        stop = F.array(*[F.lit(s) for s in K.BUILDER_STOP])
    else:
        raise ValueError(f"unknown profile {profile!r}")
    user = F.concat(F.lit(K.USER_TEMPLATE_HEAD), prompt, F.lit(K.USER_TEMPLATE_MID), body)
    return F.struct(F.lit(system).alias("system"), user.alias("user"),
                    tokens.alias("max_tokens"), stop.alias("stop"))


# --- M3: one retry policy -----------------------------------------------------------------

def error_class(e: BaseException) -> str:
    name = type(e).__name__.lower()
    if "ratelimit" in name or getattr(e, "status_code", None) == 429:
        return "rate_limit"
    if isinstance(e, TimeoutError) or "timeout" in name:
        return "timeout"
    if isinstance(e, ConnectionError) or "connection" in name:
        return "connection"
    return "other"


def call_with_policy(fn: ModelFn, request: dict, retries: int = K.ITEM_RETRIES,
                     sleep: Callable[[float], None] = time.sleep, controller: backoff.Controller | None = None):
    """M3: (result, ok, attempts, error_class).

    connection / timeout: up to ``retries`` retries, waiting min(2^k, 10) s;
    rate limit: up to ``retries`` retries, waiting min(5k, 30) s; any other
    error: one retry after 2 s.  The final failure is a text that starts with
    the failure marker.  A successful answer is stripped.

    With a ``controller`` (one for all calls of a task) a call waits for its place, and one that is refused for its
    rate is asked again, ``backoff.REFUSALS`` times, while all calls together slow down.
    """
    tries = refusals = 0
    attempts = 0
    while True:
        attempts += 1
        try:
            if controller is None:
                out = fn(request)
            else:
                with controller as burst:
                    out = fn(request)
                controller.answered()
            return ("" if out is None else str(out)).strip(), True, attempts, None
        except Exception as e:  # noqa: BLE001 - every model error becomes a row outcome
            kind = error_class(e)
            if kind == "rate_limit" and controller is not None and refusals < backoff.REFUSALS:
                refusals += 1
                controller.refused(burst)
                continue
            if kind in ("connection", "timeout", "rate_limit"):
                tries += 1
                if tries <= retries:
                    sleep(min(5 * tries, 30) if kind == "rate_limit" else min(2 ** tries, 10))
                    continue
                fmt = {"connection": K.FAILED_CONNECTION, "timeout": K.FAILED_TIMEOUT,
                       "rate_limit": K.FAILED_RATE_LIMIT}[kind]
                return fmt.format(err=e, n=retries), False, attempts, kind
            if tries == 0:
                tries += 1
                sleep(2)
                continue
            return f"{K.FAILED_PREFIX}{e}", False, attempts, kind


RESULT_FIELDS = [
    T.StructField("result", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("attempts", T.IntegerType()),
    T.StructField("error_class", T.StringType()),
    T.StructField("started_at", T.DoubleType()),
    T.StructField("finished_at", T.DoubleType()),
]


def request_columns(requests: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the four parts of a request; no token limit and no stop texts where they are absent."""
    req = requests
    if "max_tokens" not in req.columns:
        req = req.withColumn("max_tokens", F.lit(None).cast("bigint"))
    if "stop" not in req.columns:
        req = req.withColumn("stop", F.array().cast("array<string>"))
    return req.select(*keys, "system", "user", "max_tokens", "stop")


def answered(batch, keys: list[str], fn: ModelFn, pool: ThreadPoolExecutor, batch_size: int, sleep: Callable[[float], None],
             controller: backoff.Controller | None = None):
    """An Arrow batch of requests as one of ``keys`` and ``RESULT_FIELDS``: windows of ``batch_size`` through the pool."""
    import pyarrow as pa

    d = batch.to_pydict()
    reqs = [{k: d[k][i] for k in ("system", "user", "max_tokens", "stop")} for i in range(batch.num_rows)]

    def one(r):
        t0 = time.time()
        res, ok, att, err = call_with_policy(fn, r, sleep=sleep, controller=controller)
        return res, ok, att, err, t0, time.time()

    outs = []
    for s in range(0, len(reqs), max(1, batch_size)):
        outs.extend(pool.map(one, reqs[s:s + batch_size]))
    types = [pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
    cells = list(zip(*outs)) if outs else [[] for _ in types]
    return pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(list(c), t) for c, t in zip(cells, types)]],
                                      names=[*keys, *[f.name for f in RESULT_FIELDS]])


def result_schema(requests: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*[requests.schema[k] for k in keys], *RESULT_FIELDS])


def call_model(requests: DataFrame, keys: list[str], fn: ModelFn, concurrency: int = K.DEFAULT_CONCURRENCY,
               batch_size: int = K.DEFAULT_BATCH_SIZE, partitions: int | None = None,
               sleep: Callable[[float], None] = time.sleep, adaptive: bool = False) -> DataFrame:
    """Runs ``fn`` once per request row in Arrow batches; ``k = concurrency``
    threads per task over windows of ``batch_size`` requests.  ``adaptive``: as many of them call
    at once as the service bears (:mod:`corpusflow.operators.backoff`).

    ``requests`` must hold ``keys`` + ``system``, ``user`` (+ optional
    ``max_tokens``, ``stop``).  Only those columns cross into Python.
    """
    ship_package(requests.sparkSession)
    req = request_columns(requests, keys)
    if partitions:
        req = req.repartition(partitions, *keys)

    def run(batches):
        pool = ThreadPoolExecutor(max_workers=max(1, concurrency))
        controller = backoff.Controller(concurrency, sleep) if adaptive else None
        try:
            for b in batches:
                yield answered(b, keys, fn, pool, batch_size, sleep, controller)
        finally:
            pool.shutdown(wait=True)

    return req.mapInArrow(run, result_schema(req, keys))


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back."""
    path = scratch_path(df.sparkSession, "results")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def latest_results(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: a good result before a failed one, then the newest."""
    cols = [c for c in results.columns if c not in keys]
    good = F.coalesce(F.col("ok"), F.lit(True)) if "ok" in cols else ~F.startswith(F.coalesce("result", F.lit("")), F.lit(K.FAILED))
    when = F.col("finished_at") if "finished_at" in cols else F.lit(0.0)
    best = F.max_by(F.struct(*cols), F.struct(good.alias("g"), when.alias("w"), F.coalesce("result", F.lit("")).alias("r")))
    return results.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def good_results(results: DataFrame) -> DataFrame:
    """Results that need no second call."""
    ok = ~F.startswith(F.coalesce("result", F.lit("")), F.lit(K.FAILED))
    return results.filter((F.coalesce("ok", F.lit(True)) & ok) if "ok" in results.columns else ok)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


# --- M2 -------------------------------------------------------------------------------


#: Name of the digest that tells apart rows of the same keys.
ROW = "row_digest"


def _digest(*parts: Column) -> Column:
    """128 bits of some texts, nulls apart from every text."""
    sized = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.md5(F.concat(*sized).cast("binary"))


def row_digest(columns: list[str], prompt) -> Column:
    """Digest of the prompt and a row's values in the chosen columns."""
    return _digest(F.lit(prompt) if isinstance(prompt, str) else prompt, *[F.col(c).cast("string") for c in columns])


def _checked(df: DataFrame, keys: list[str], columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    if ROW in df.columns or "column" in keys:
        raise ValueError(f"a table with a column {ROW!r}, or a key 'column', has to be renamed first")


def column_requests(df: DataFrame, keys: list[str], columns: list[str], prompt,
                    profile: str = "processor") -> DataFrame:
    """Unpivot the chosen columns, drop blank values, render requests: keys, row digest, column, request.

    Null counts as blank (the tool we reproduce turned null into the text
    "nan" and sent it to the model)."""
    _checked(df, keys, columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                for c in columns]))
    long = df.select(*keys, row_digest(columns, prompt).alias(ROW), pairs.alias("_p")).select(*keys, ROW, "_p.column", "_p.value")
    items = long.filter(~is_blank("value"))
    r = render_request("value", prompt, profile)
    return items.select(*keys, ROW, "column", r["system"].alias("system"), r["user"].alias("user"),
                        r["max_tokens"].alias("max_tokens"), r["stop"].alias("stop"))


def join_results(df: DataFrame, results: DataFrame, keys: list[str], columns: list[str],
                 suffix: str = "_processed", prompt="") -> DataFrame:
    """``<col>_processed`` per column: the result; "" for a blank source value;
    the bare failure marker for a non-blank value without a result (never
    reached, e.g. an interrupted run).  Keys are compared null-safe, and so is the row digest (under ``prompt``)
    where the results have one; results without it count for every row of their keys."""
    match = [*keys, ROW] if ROW in results.columns else keys
    found = [F.max(F.when(F.col("column") == c, F.col("result"))).alias(f"_res{i}") for i, c in enumerate(columns)]
    per_key = results.groupBy(*match).agg(*found).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(match)],
                                                         *[f"_res{i}" for i in range(len(columns))])
    rows = df.withColumn(ROW, row_digest(columns, prompt)) if match != keys else df
    on = F.lit(True)
    for i, k in enumerate(match):
        on = on & rows[k].eqNullSafe(per_key[f"_k{i}"])
    joined = rows.join(per_key, on, "left")
    out = [rows[c] for c in df.columns]
    for i, c in enumerate(columns):
        val = (F.when(is_blank(rows[c].cast("string")), F.lit(""))
               .otherwise(F.coalesce(F.col(f"_res{i}"), F.lit(K.FAILED))))
        out.append(val.alias(f"{c}{suffix}"))
    return joined.select(*out)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The results kept below ``path`` (none yet: no rows), or None if nothing is there.  The schema is known,
    so a folder that an interrupted run left without a single file is readable too."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else None


def _call_into(requests, keys, fn, path, concurrency, batch_size, partitions, sleep, adaptive, increments, commit_rows) -> DataFrame:
    """Calls whose results stay below ``path``; all of them, with those of earlier runs."""
    from corpusflow.sinks import calls
    spark = requests.sparkSession
    if reachable(spark, path):
        calls.call_and_keep(requests, keys, fn, path, concurrency, batch_size, partitions, sleep, commit_rows, adaptive)
    else:       # a store that only Spark's own writers reach: each increment is complete when written
        for i in range(increments):
            part = requests.filter(F.pmod(F.xxhash64(*keys), F.lit(increments)) == i) if increments > 1 else requests
            call_model(part, keys, fn, concurrency, batch_size, partitions, sleep, adaptive).write.mode("append").parquet(path)
    return latest_results(read_results(spark, path, result_schema(requests, keys)), keys)


def infer_columns(df: DataFrame, keys: list[str], columns: list[str], prompt, fn: ModelFn,
                  concurrency: int = K.DEFAULT_CONCURRENCY, batch_size: int = K.DEFAULT_BATCH_SIZE,
                  partitions: int | None = None, sleep: Callable[[float], None] = time.sleep,
                  done: DataFrame | None = None, return_results: bool = False,
                  results_path: str | None = None, increments: int = 1, distinct: bool = False, commit_rows: int = 500,
                  adaptive: bool = False):
    """M2 (+M8): apply ``fn`` under ``prompt`` to the chosen columns.

    Every row gets its own answer, whatever its keys; rows equal in keys and chosen values share one.
    ``done``: results of an earlier run (same keys + ``column``, ``result``); only
    requests without a good result are sent.  ``results_path``: a folder of results
    kept across sessions; what it holds counts as done, and tasks add new results, ``commit_rows`` at a time.
    In a store that only Spark's writers reach, results are added in ``increments`` parts by key hash.
    ``distinct``: equal requests, of whatever rows, are sent once (``results_path`` then holds answers by request).
    ``adaptive``: the calls of a task slow down together when the service refuses some.
    """
    spark = df.sparkSession
    reqs = column_requests(df, keys, columns, prompt)
    rkeys = [*keys, ROW, "column"]
    call = (concurrency, batch_size, partitions, sleep, adaptive)
    if distinct:
        if done is not None:
            raise ValueError("with distinct requests, earlier answers come from results_path")
        results = distinct_answers(reqs, rkeys, fn, *call, results_path=results_path, increments=increments, commit_rows=commit_rows)
    else:
        if done is not None:
            done = _with_rows(done, reqs, keys)
        kept = read_results(spark, results_path, result_schema(reqs, rkeys)) if results_path else None
        if kept is not None:
            done = kept if done is None else kept.unionByName(done, allowMissingColumns=True)
        if done is not None:
            done = latest_results(done, rkeys)
            reqs = resume(reqs, done, rkeys)
        if results_path:
            results = _call_into(reqs, rkeys, fn, results_path, *call, increments, commit_rows)
        else:
            results = materialize(call_model(reqs, rkeys, fn, *call))
        if done is not None:
            results = latest_results(results.unionByName(done, allowMissingColumns=True), rkeys)
    out = join_results(df, results, keys, columns, prompt=prompt)
    return (out, results) if return_results else out


def _with_rows(done: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Results by row digest; those that have none count for every row of their keys."""
    if ROW in done.columns:
        return done
    cells = requests.select(*keys, "column", ROW).distinct()
    return cells.join(done, _same(cells, done, [*keys, "column"])).select(*[cells[c] for c in cells.columns],
                                                                        *[done[c] for c in done.columns if c not in cells.columns])


#: A request that more than this share of all cells make is spread over so many parts of the join.
HOT_SHARE, HOT_PARTS = 1 / 1000, 64


def distinct_answers(requests: DataFrame, keys: list[str], fn: ModelFn, concurrency: int = K.DEFAULT_CONCURRENCY,
                     batch_size: int = K.DEFAULT_BATCH_SIZE, partitions: int | None = None, sleep: Callable[[float], None] = time.sleep,
                     adaptive: bool = False, results_path: str | None = None, increments: int = 1, commit_rows: int = 500) -> DataFrame:
    """M2 with one call per distinct request: results by ``keys``, as :func:`call_model` gives them for each.

    Requests are grouped by their digest; each is sent once, and its answer goes back to all its cells by a join on the digest.
    Digests that many cells share, under 1 / ``HOT_SHARE`` of them, are salted on both sides.
    """
    spark = requests.sparkSession
    req = request_columns(requests, keys)
    digest = _digest(F.col("system"), F.col("user"), F.col("max_tokens").cast("string"), F.to_json("stop"))
    tagged = req.withColumn("request_id", digest)
    once = tagged.groupBy("request_id").agg(*[F.first(c).alias(c) for c in ("system", "user", "max_tokens", "stop")])
    if results_path:
        kept = read_results(spark, results_path, result_schema(once, ["request_id"]))
        if kept is not None:
            once = resume(once, kept, ["request_id"])
        answers = _call_into(once, ["request_id"], fn, results_path, concurrency, batch_size, partitions, sleep, adaptive, increments, commit_rows)
    else:
        answers = materialize(call_model(once, ["request_id"], fn, concurrency, batch_size, partitions, sleep, adaptive))
    cells = tagged.select(*keys, "request_id")
    sizes = materialize(cells.groupBy("request_id").agg(F.count("*").alias("_n")))
    every = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = F.broadcast(sizes.filter(F.col("_n") > every * HOT_SHARE).select("request_id", F.lit(True).alias("_hot")))     # fewer than 1 / HOT_SHARE
    salted = cells.join(hot, "request_id", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*keys), F.lit(HOT_PARTS))).otherwise(0).cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    spread = answers.join(hot, "request_id", "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(spread, ["request_id", "_salt"]).drop("_salt", "request_id")


def resume(requests: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """M8: the requests that still lack a good result; failed ones are tried again."""
    good = good_results(done).select(*keys).distinct()
    return requests.join(good, _same(requests, good, keys), "left_anti")


# --- M4 -------------------------------------------------------------------------------


def ordinal(df: DataFrame, partition_by: list[str], order: list[str], coarse: list[Column],
            fine: list[Column], predicate: Column | None = None, out: str = "ordinal") -> DataFrame:
    """1-based position of each row among the rows satisfying ``predicate``
    within ``partition_by``, in ``order``; other rows get null.

    Skew-proof, no window ever sees a whole partition: ``coarse`` and ``fine``
    are bucket expressions that never decrease along ``order``.  Rows are
    counted per fine bucket (partial aggregation), fine counts are summed per
    coarse bucket, offsets are prefix sums -- over the few coarse buckets of a
    partition, then over the fine buckets of a coarse bucket -- and the final
    ``row_number`` runs per fine bucket, which holds a bounded number of rows
    (e.g. ``turn div 1000`` within a conversation, ``row_no div 100000``
    within a file).
    """
    pred = F.lit(True) if predicate is None else predicate
    cn = [f"_c{i}" for i in range(len(coarse))]
    fn = [f"_f{i}" for i in range(len(fine))]
    tagged = df.select("*", *[c.alias(n) for c, n in zip(coarse, cn)],
                       *[c.alias(n) for c, n in zip(fine, fn)], pred.alias("_sel"))
    fine_counts = tagged.filter("_sel").groupBy(*partition_by, *cn, *fn).agg(F.count("*").alias("_cnt"))
    coarse_counts = fine_counts.groupBy(*partition_by, *cn).agg(F.sum("_cnt").alias("_ccnt"))
    before = (Window.unboundedPreceding, -1)
    wc = Window.partitionBy(*partition_by).orderBy(*cn).rowsBetween(*before)
    coarse_off = coarse_counts.select(*partition_by, *cn, F.coalesce(F.sum("_ccnt").over(wc), F.lit(0)).alias("_coff"))
    wf = Window.partitionBy(*partition_by, *cn).orderBy(*fn).rowsBetween(*before)
    fine_off = fine_counts.select(*partition_by, *cn, *fn, F.coalesce(F.sum("_cnt").over(wf), F.lit(0)).alias("_foff"))
    offsets = fine_off.join(coarse_off, [*partition_by, *cn], "inner")
    local = Window.partitionBy(*partition_by, *cn, *fn, "_sel").orderBy(*order)
    numbered = tagged.withColumn("_local", F.row_number().over(local))
    joined = numbered.join(offsets, [*partition_by, *cn, *fn], "left")
    pos = F.when(F.col("_sel"), F.col("_coff") + F.col("_foff") + F.col("_local"))
    return joined.select(*df.columns, pos.cast("bigint").alias(out))


def global_ordinal(df: DataFrame, order: list[str], predicate: Column, out: str = "ordinal") -> DataFrame:
    """:func:`ordinal` over the whole table: no window and no single task.

    The selected rows are range-sorted and written; a row's number is its place in its
    range plus the rows of the ranges before it (one number per range is summed up).
    """
    ranged = df.filter(predicate).repartitionByRange(*order).sortWithinPartitions(*order)
    items = materialize(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = items.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))      # a row per range
    numbered = items.withColumn("_part", part).join(starts, "_part").select(*df.columns, (F.col("_before") + place + 1).cast("bigint").alias(out))
    return numbered.unionByName(df.filter(~predicate).withColumn(out, F.lit(None).cast("bigint")))


def assign_batches(df: DataFrame, partition_by: list[str], order: list[str], coarse: list[Column],
                   fine: list[Column], text: str, size: int = K.DEFAULT_BATCH_SIZE) -> DataFrame:
    """M4: item number (1-based) and batch number (0-based) of each non-blank
    row, ceil(n / size) batches per partition; blank rows get nulls.  Without
    ``partition_by`` the whole table is numbered, and ``coarse`` and ``fine`` aren't needed."""
    if partition_by:
        numbered = ordinal(df, partition_by, order, coarse, fine, ~is_blank(text), "item_no")
    else:
        numbered = global_ordinal(df, order, ~is_blank(text), "item_no")
    return numbered.select(*df.columns, "item_no",
                           F.floor((F.col("item_no") - 1) / size).cast("bigint").alias("batch_no"))


# --- M5, M6 ----------------------------------------------------------------------------


def writing_prompt_request(content, extra: str = "", focus: str = "", template: str = "") -> Column:
    """M5 request (builder profile) for a segment used as the assistant turn."""
    content = F.col(content) if isinstance(content, str) else content
    prompt = template.strip() or K.WRITING_REVERSE_DEFAULT
    text = F.concat(F.lit(K.WRITING_TEXT_HEAD), content, F.lit(K.EXTRA_LABEL + extra))
    if focus.strip():
        text = F.concat(text, F.lit(K.FOCUS_LABEL + focus.strip()))
        if not template.strip():
            prompt += K.FOCUS_CLAUSE + focus.strip()
    return render_request(text, prompt, "builder")


def revision_requests(original, modified, extra: str = "", focus: str = "", template: str = ""):
    """M6: the two requests -- the revision request and the plainer original."""
    original = F.col(original) if isinstance(original, str) else original
    modified = F.col(modified) if isinstance(modified, str) else modified
    prompt = template.strip() or K.REVISION_REVERSE_DEFAULT
    text = F.concat(F.lit(K.REVISION_TEXT_ORIGINAL), original, F.lit(K.REVISION_TEXT_MODIFIED), modified,
                    F.lit(K.EXTRA_LABEL + extra))
    if focus.strip():
        text = F.concat(text, F.lit(K.FOCUS_LABEL + focus.strip()))
        if not template.strip():
            prompt += K.FOCUS_CLAUSE + focus.strip()
    return render_request(text, prompt, "builder"), render_request(modified, K.SIMPLIFY_PROMPT, "builder")


def infer_writing_prompts(segments: DataFrame, keys: list[str], fn: ModelFn, content: str = "content",
                          extra: str = "", focus: str = "", template: str = "", **kw) -> DataFrame:
    """M5: keys, digest of the segment -> ``user_prompt``: the model's stripped answer, or on an empty
    answer or an error ``extra`` or the default writing request.  Segments of the same keys are told apart by the digest."""
    r = writing_prompt_request(content, extra, focus, template)
    reqs = segments.select(*keys, content_digest(content).alias(CONTENT), r["system"].alias("system"), r["user"].alias("user"),
                           r["max_tokens"].alias("max_tokens"), r["stop"].alias("stop"))
    res = materialize(call_model(reqs, [*keys, CONTENT], fn, **kw))
    fallback = F.lit(extra.strip() or K.WRITING_FALLBACK)
    good = F.col("ok") & (F.length(strip_ws("result")) > 0)
    return res.select(*keys, CONTENT, F.when(good, strip_ws("result")).otherwise(fallback).alias("user_prompt"))


def infer_revision_prompts(segments: DataFrame, keys: list[str], fn: ModelFn, content: str = "content",
                           extra: str = "", focus: str = "", template: str = "", **kw) -> DataFrame:
    """M6: keys, digest of the segment -> ``request``, ``original``, ``model_ok``.  Two requests per segment in
    one model pass (``kind`` 0/1), folded back per key and digest.  An empty answer, or an
    error in either call, leaves a null: the samples (D3) put the default request and
    the segment in its place, so the segments' text isn't joined here again."""
    r1, r2 = revision_requests(content, content, extra, focus, template)
    by = [*keys, CONTENT]
    both = segments.select(*keys, content_digest(content).alias(CONTENT), F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), r1["system"].alias("system"), r1["user"].alias("user"),
                 r1["max_tokens"].alias("max_tokens"), r1["stop"].alias("stop")),
        F.struct(F.lit(1).alias("kind"), r2["system"].alias("system"), r2["user"].alias("user"),
                 r2["max_tokens"].alias("max_tokens"), r2["stop"].alias("stop")),
    )).alias("_r")).select(*by, "_r.*")
    res = materialize(call_model(both, [*by, "kind"], fn, **kw))
    folded = res.groupBy(*by).agg(
        F.max(F.when(F.col("kind") == 0, strip_ws("result"))).alias("_req"),
        F.max(F.when(F.col("kind") == 1, strip_ws("result"))).alias("_orig"),
        F.min(F.col("ok").cast("int")).alias("_ok"),
    )
    filled = lambda c: F.when((F.col("_ok") == 1) & (F.length(F.coalesce(c, F.lit(""))) > 0), F.col(c))
    request = filled("_req")
    if extra.strip():
        request = F.coalesce(request, F.lit(extra.strip()))
    return folded.select(*by, request.alias("request"), filled("_orig").alias("original"), (F.col("_ok") == 1).alias("model_ok"))


# --- M7 -------------------------------------------------------------------------------


def infer_corpus(rows: DataFrame, columns: list[str], prompt, fn: ModelFn, file_col: str = "file_path",
                 row_col: str = "row_no", files: DataFrame | None = None, **kw):
    """M7: M2 over the rows of many files (``read_corpus`` output).

    ``files``: one row per file with its ``status`` and its own ``columns``
    (``corpus_files`` output).  A file that wasn't read, or whose header lacks a
    requested column, is marked failed and skipped; every other file is processed,
    empty columns included.  Without ``files`` a column is missing from a file
    if the table of rows doesn't have it, or all its values there are null.

    Returns ``(processed_rows, outcome)`` where outcome has one row per file:
    ``file_path, status ('processed' | 'failed'), reason``.
    """
    if row_col not in rows.columns:
        raise ValueError(f"rows need a row number ({row_col}) within their file")
    present = [c for c in columns if c in rows.columns]
    absent = [c for c in columns if c not in rows.columns]
    if files is None:
        counts = rows.groupBy(file_col).agg(*[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(present)], F.count("*").alias("_n"))
        seen = counts.select(file_col, F.lit("read").alias("_status"), F.array_compact(F.array(
            *[F.when(F.col(f"_n{i}") > 0, F.lit(c)) for i, c in enumerate(present)], F.lit(None).cast("string"))).alias("_columns"))
    else:
        seen = files.filter("status NOT IN ('not matched', 'hidden name', 'unsupported type')").select(
            file_col, F.col("status").alias("_status"), F.col("columns").alias("_columns"))
    wanted = F.array(*[F.lit(c) for c in columns])
    lacking = F.array_join(F.array_except(wanted, F.coalesce("_columns", F.array().cast("array<string>"))), ", ")
    reason = (F.when(~F.col("_status").isin("read", "empty"), F.col("_status"))
              .when(F.length(lacking) > 0, F.concat(F.lit("missing columns: "), lacking)))
    outcome = seen.select(file_col, F.when(reason.isNull(), "processed").otherwise("failed").alias("status"), reason.alias("reason"))
    good = rows.join(outcome.filter("status = 'processed'").select(file_col), file_col, "left_semi")
    if absent:
        good = good.filter(F.lit(False))  # the column exists in no file: every file failed
    processed = infer_columns(good.select(file_col, row_col, *present), [file_col, row_col], present, prompt, fn,
                              **kw) if present else good
    return processed, outcome
