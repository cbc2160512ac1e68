"""Registered queries over the driver tables: one per operator family.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame over the WHOLE
tables.  Driver tables hold single newlines only, so paragraph queries split on
``\\n+`` and continuation splits use the marks ``. ! ? \\n`` (the Chinese marks
are the default of the operator and are covered by the unit tests).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions import text as T
from corpusflow.operators import report as R
from corpusflow.operators import segment as G
from corpusflow.sources import tables

LINE_DELIM = r"\n+"
FIXTURE_MARKS = [".", "!", "?", "\n"]


# --- segmentation ---------------------------------------------------------------------

def q_segments(spark: SparkSession, sf: str) -> DataFrame:
    """G1: documents -> (doc_id, seg_no, content)."""
    docs = tables.documents(spark, sf, ["doc_id", "text"])
    return G.segment(docs, "text", ["doc_id"], delim=LINE_DELIM)


def q_segment_stats_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """G1 + R8: how many training segments of what size each language yields."""
    docs = tables.documents(spark, sf, ["doc_id", "text", "lang"])
    segs = G.with_segments(docs.select("lang", "text"), "text", "segments", delim=LINE_DELIM)
    return R.segment_stats_arrays(segs, "segments", ["lang"])


def q_segment_table(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned documents -> (doc_id, seg_no, n_chars, content)."""
    docs = tables.documents(spark, sf, ["doc_id", "text"])
    return G.segment_table(docs, "text", "doc_id", clean=True, delim=LINE_DELIM)


def q_segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    """R8 over the segment table of all documents (files, segments, chars, mean)."""
    return R.segment_stats(q_segment_table(spark, sf), [], "doc_id", "content")


# --- scalar text functions -----------------------------------------------------------------

def q_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf, ["doc_id", "text"])
    return docs.select("doc_id", T.clean_text("text").alias("cleaned"))


def q_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf, ["doc_id", "text"])
    paras = docs.select("doc_id", T.split_paragraphs("text", LINE_DELIM).alias("_p"))
    return G.explode_segments(paras, ["doc_id"], "_p", "paragraph").withColumnRenamed("seg_no", "para_no")


def q_strip_ws(spark: SparkSession, sf: str) -> DataFrame:
    conv = tables.conversations(spark, sf)
    return conv.select("conv_id", "turn", T.strip_ws("text").alias("stripped"),
                       T.is_blank("text").alias("blank"), T.char_count("text").alias("n_chars"))


def q_truncate_input(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf, ["doc_id", "text"])
    return docs.select(
        "doc_id",
        T.truncate_input("text", K.PROCESSOR_INPUT_CAP, K.PROCESSOR_TRUNCATION_MARKER).alias("input_10000"),
        T.truncate_input("text", K.BUILDER_INPUT_CAP, K.BUILDER_TRUNCATION_MARKER).alias("input_8000"),
    )


def q_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    conv = tables.conversations(spark, sf)
    return conv.select(
        "conv_id", "turn",
        T.excerpt("text", K.EXCERPT_RESULT).alias("ex_50"),
        T.excerpt("text", K.EXCERPT_LISTING).alias("ex_80"),
        T.excerpt("text", K.EXCERPT_RAW, dots=False).alias("ex_100"),
        T.excerpt("text", K.EXCERPT_PREVIEW).alias("ex_150"),
        T.excerpt("text", 200).alias("ex_200"),
    )


def q_max_output_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.documents(spark, sf, ["doc_id", "text", "n_chars"])
    return docs.select(
        "doc_id",
        T.max_output_tokens("text").alias("tokens_default"),
        T.max_output_tokens("text", 4096).alias("tokens_4096"),
        T.max_output_tokens("text", 1000).alias("tokens_1000"),
        T.max_output_tokens("text", 8192).alias("tokens_8192"),
        T.max_output_tokens("text", F.col("n_chars") - 3000).alias("tokens_per_row"),
    )


def q_split_continuation(spark: SparkSession, sf: str) -> DataFrame:
    """G4 over all segments."""
    segs = q_segments(spark, sf)
    return G.split_continuation(segs, "content", FIXTURE_MARKS).select(
        "doc_id", "seg_no", "first_part", "second_part")


# --- dataset construction ---------------------------------------------------------------

from corpusflow.operators import catalog as P  # noqa: E402
from corpusflow.operators import dataset as D  # noqa: E402
from corpusflow.operators import infer as M  # noqa: E402
from corpusflow.plans import models  # noqa: E402

SEG_KEYS = ["doc_id", "seg_no"]
WRITING_EXTRA = "  悬疑风格，第一人称  "


def _segments(spark, sf):
    return q_segments(spark, sf)


def q_continuation_samples(spark: SparkSession, sf: str) -> DataFrame:
    return D.continuation_samples(_segments(spark, sf), SEG_KEYS, marks=FIXTURE_MARKS)


def q_writing_samples(spark: SparkSession, sf: str) -> DataFrame:
    return D.writing_samples(_segments(spark, sf), SEG_KEYS, extra=WRITING_EXTRA)


def q_revision_samples(spark: SparkSession, sf: str) -> DataFrame:
    return D.revision_samples(_segments(spark, sf), SEG_KEYS)


def q_build_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return D.build_dataset(_segments(spark, sf), SEG_KEYS, marks=FIXTURE_MARKS)


def q_dataset_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.dataset_counts(q_build_dataset(spark, sf))


def q_messages_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    ds = q_build_dataset(spark, sf)
    return ds.select("task_type", *SEG_KEYS, D.to_jsonl(D.to_messages()).alias("line"))


def _segments_x_tasks(spark, sf):
    segs = _segments(spark, sf)
    return segs.select(*SEG_KEYS, "content", F.explode(F.array(*[F.lit(t) for t in K.DATASET_TASKS])).alias("task_type"))


def q_prompt_only_messages(spark: SparkSession, sf: str) -> DataFrame:
    x = _segments_x_tasks(spark, sf)
    m = D.prompt_only_messages("content", "task_type")
    return x.select(*SEG_KEYS, "task_type", m[0]["content"].alias("system"), m[1]["content"].alias("user"),
                    F.size(m).cast("bigint").alias("turns"))


def q_legacy_user_content(spark: SparkSession, sf: str) -> DataFrame:
    x = _segments_x_tasks(spark, sf)
    return x.select(*SEG_KEYS, "task_type", D.legacy_user_content("task_type", "content").alias("user"),
                    D.default_user_content("task_type").alias("default_user"),
                    D.default_instruction("task_type").alias("instruction"))


# --- prompt catalogs --------------------------------------------------------------------------

ROLE_TASK = {"user": "中文翻译", "assistant": "文本摘要", "system": "格式化"}
CUSTOM_REVERSE = {"小说续写": {"多样续写": "请续写这一段。\n请接着写下去。\n  \n请延续情节，保持人物性格。",
                           "情节延续": "（被内置提示词覆盖的自定义提示词）"}}
CATEGORY_OF = {K.TASK_WRITING: "风格模仿", K.TASK_REVISION: "文本润色"}


def q_attach_task(spark: SparkSession, sf: str) -> DataFrame:
    tasks = P.resolve_tasks(spark)
    conv = tables.conversations(spark, sf, ["conv_id", "turn"])
    return P.attach_task(conv, tasks, name="文本摘要").select("conv_id", "turn", "task", "prompt")


def q_attach_task_per_row(spark: SparkSession, sf: str) -> DataFrame:
    tasks = P.resolve_tasks(spark)
    conv = tables.conversations(spark, sf, ["conv_id", "turn", "role"])
    mapping = F.create_map(*[x for k, v in ROLE_TASK.items() for x in (F.lit(k), F.lit(v))])
    rows = conv.select("conv_id", "turn", mapping[F.col("role")].alias("task"))
    return P.attach_task(rows, tasks, task_col="task").select("conv_id", "turn", "task", "prompt")


def q_reverse_prompts(spark: SparkSession, sf: str) -> DataFrame:
    resolved = P.resolve_reverse_prompts(P.reverse_table(spark, CUSTOM_REVERSE))
    x = _segments_x_tasks(spark, sf)
    rtype = F.create_map(*[v for t in K.DATASET_TASKS for v in (F.lit(t), F.lit(K.REVERSE_TYPE[t]))])
    category = (F.when(F.col("task_type") == K.TASK_CONTINUATION,
                       F.when(F.col("seg_no") == 1, F.lit("情节延续")).otherwise(F.lit("多样续写")))
                .otherwise(F.create_map(*[v for t, c in CATEGORY_OF.items() for v in (F.lit(t), F.lit(c))])[F.col("task_type")]))
    rows = x.select(*SEG_KEYS, "task_type", rtype[F.col("task_type")].alias("reverse_type"), category.alias("category"))
    looked = P.lookup_reverse_prompt(rows.withColumnRenamed("task_type", "dataset_task")
                                     .withColumnRenamed("reverse_type", "task_type"), resolved)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("seg_no").cast("string"))
    picked = P.with_template(looked, "reverse_prompt", "7", key)
    return picked.select(*SEG_KEYS, F.col("dataset_task").alias("task_type"), "category", "template")


# --- inference ------------------------------------------------------------------------------------

SUMMARY = "文本摘要"


def q_render_request(spark: SparkSession, sf: str) -> DataFrame:
    conv = tables.conversations(spark, sf).filter(~T.is_blank("text"))
    prompt = K.DEFAULT_TASKS[SUMMARY]
    p = M.render_request("text", prompt, "processor")
    b = M.render_request("text", prompt, "builder")
    return conv.select("conv_id", "turn", p["system"].alias("system"), p["user"].alias("user"),
                       b["system"].alias("builder_system"), b["user"].alias("builder_user"),
                       b["max_tokens"].alias("builder_max_tokens"),
                       F.array_join(b["stop"], "|").alias("builder_stop"))


def q_assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    conv = tables.conversations(spark, sf)
    out = M.assign_batches(conv, [], ["conv_id", "turn"], [], [], text="text", size=K.DEFAULT_BATCH_SIZE)
    return out.select("conv_id", "turn", "item_no", "batch_no")


def q_workload_summary(spark: SparkSession, sf: str) -> DataFrame:
    return R.workload_summary(tables.conversations(spark, sf), ["text", "role"])


def _conv_inferred(spark, sf, done=None, return_results=False):
    conv = tables.conversations(spark, sf, ["conv_id", "turn", "role", "text"])
    return M.infer_columns(conv, ["conv_id", "turn"], ["text"], K.DEFAULT_TASKS[SUMMARY], models.echo_model,
                           sleep=models.no_sleep, done=done, return_results=return_results)


def q_infer_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _conv_inferred(spark, sf).select("conv_id", "turn", "text_processed")


def q_resume(spark: SparkSession, sf: str) -> DataFrame:
    conv = tables.conversations(spark, sf, ["conv_id", "turn", "role", "text"])
    first = conv.filter(F.col("role") == "user")          # an interrupted first run
    _, done = M.infer_columns(first, ["conv_id", "turn"], ["text"], K.DEFAULT_TASKS[SUMMARY], models.echo_model,
                              sleep=models.no_sleep, return_results=True)
    return _conv_inferred(spark, sf, done=done).select("conv_id", "turn", "text_processed")


def _doc_results(spark, sf):
    docs = tables.documents(spark, sf, ["doc_id", "text"])
    return M.infer_columns(docs, ["doc_id"], ["text"], K.DEFAULT_TASKS[SUMMARY], models.flaky_model,
                           sleep=models.no_sleep, return_results=True)


def q_outcome_stats(spark: SparkSession, sf: str) -> DataFrame:
    _, results = _doc_results(spark, sf)
    return R.outcome_stats(results)


def q_result_lengths(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = _doc_results(spark, sf)
    long = out.select(F.lit("text").alias("column"), F.col("text_processed").alias("result"))
    return R.result_lengths(long)


def q_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = _doc_results(spark, sf)
    long = out.select(F.lit("text").alias("column"), F.col("text_processed").alias("result"))
    return R.quality_report(long)


def q_sample_preview(spark: SparkSession, sf: str) -> DataFrame:
    out = _conv_inferred(spark, sf)
    return R.sample_preview(out, ["conv_id", "turn"], ["text"], n=5)


def q_writing_samples_model(spark: SparkSession, sf: str) -> DataFrame:
    segs = M.materialize(_segments(spark, sf))      # computed once, for the requests and for the samples
    prompts = M.infer_writing_prompts(segs, SEG_KEYS, models.writing_model, extra=WRITING_EXTRA,
                                      sleep=models.no_sleep)
    return D.writing_samples(segs, SEG_KEYS, extra=WRITING_EXTRA, prompts=prompts)


def q_revision_samples_model(spark: SparkSession, sf: str) -> DataFrame:
    segs = M.materialize(_segments(spark, sf))
    rev = M.infer_revision_prompts(segs, SEG_KEYS, models.revision_model, sleep=models.no_sleep)
    return D.revision_samples(segs, SEG_KEYS, revisions=rev)


# --- files and streams ---------------------------------------------------------------------------

from corpusflow.session import scratch_path  # noqa: E402
from corpusflow.sources import corpus as C  # noqa: E402
from corpusflow.streaming import streams as ST  # noqa: E402


def q_segment_stream(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: the documents' file or files picked up by a bounded stream, segmented, appended."""
    schema = tables.load(spark, sf, "documents").schema
    out = scratch_path(spark, "segment-stream")
    ST.segment_stream(spark, sink=f"{out}/data", checkpoint=f"{out}/checkpoint", schema=schema, keys=["doc_id"],
                      delim=LINE_DELIM, **tables.stream_source(spark, sf, "documents"))
    return spark.read.parquet(f"{out}/data")


def q_infer_stream(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: conversations through stream increments of M2 with keyed, replay-safe results."""
    conv = tables.load(spark, sf, "conversations")
    out = scratch_path(spark, "infer-stream")
    keys, columns, prompt = ["conv_id", "turn"], ["text"], K.DEFAULT_TASKS[SUMMARY]
    ST.infer_stream(spark, results=f"{out}/results", checkpoint=f"{out}/checkpoint", schema=conv.schema, keys=keys, columns=columns,
                    prompt=prompt, fn=models.echo_model, sleep=models.no_sleep, **tables.stream_source(spark, sf, "conversations"))
    done = ST.processed(conv, spark.read.parquet(f"{out}/results"), keys, columns, prompt)
    return done.select("conv_id", "turn", "text_processed")


def q_corpus_lines_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """K3 -> S1 -> S6 -> S2 round trip: documents written as text files per
    language, discovered, decoded and read back as lines."""
    out = scratch_path(spark, "corpus")
    docs = tables.documents(spark, sf, ["lang", "text"])
    docs.write.partitionBy("lang").text(out)
    listing = C.list_corpus(spark, out, "*.txt", [".txt"]).filter("matched")
    lines = C.read_text_lines(spark, out).join(listing.select(F.col("path").alias("file_path")), "file_path",
                                               "left_semi")
    lang = F.regexp_extract("file_path", r"/lang=([^/]+)/", 1)
    return lines.groupBy(lang.alias("lang")).agg(F.count("*").cast("bigint").alias("lines"),
                                                 F.sum(F.length("content")).cast("bigint").alias("chars"))


# --- sink -> source round trips over data derived from the tables -------------------------------

from corpusflow.sinks import writers as W  # noqa: E402


def q_written_messages(spark: SparkSession, sf: str) -> DataFrame:
    """K1: the dataset written as one JSONL dataset per task, read back as lines."""
    out = scratch_path(spark, "messages")
    W.write_messages(q_build_dataset(spark, sf), out, "r1")
    return spark.read.text(out).select(F.col("task_type"), F.col("value").alias("line"))


def q_written_segments(spark: SparkSession, sf: str) -> DataFrame:
    """K2: one segment table per document (a folder by its key, or an extent of a container where they are many), read back."""
    out = scratch_path(spark, "segments")
    W.write_segments(q_segments(spark, sf), out, "r1", file_key="doc_id", separate=True)
    back = W.read_segments(spark, out, "r1")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "seg_no", "content")


def q_processed_csv(spark: SparkSession, sf: str) -> DataFrame:
    """K3: the processed conversation table written as CSV with a header, in order, read back."""
    out = scratch_path(spark, "processed")
    W.write_processed(q_infer_columns(spark, sf), out, "r1", fmt="csv", order=["conv_id", "turn"])
    back = (spark.read.options(**W.EXACT_CSV).option("multiLine", "true")
            .schema("conv_id long, turn long, text_processed string").csv(f"{out}/run_id=r1"))
    return back.select("conv_id", "turn", F.coalesce("text_processed", F.lit("")).alias("text_processed"))


def q_paragraph_blocks_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    """S3: documents written with blank lines between their lines, read back as blocks."""
    out = scratch_path(spark, "blocks")
    docs = tables.documents(spark, sf, ["lang", "text"])
    docs.select("lang", F.concat(F.regexp_replace("text", "\n", "\n\n"), F.lit("\n")).alias("text")) \
        .write.partitionBy("lang").text(out)
    blocks = C.read_paragraphs(spark, out, glob="*.txt")
    lang = F.regexp_extract("file_path", r"/lang=([^/]+)/", 1)
    return blocks.groupBy(lang.alias("lang")).agg(F.count("*").cast("bigint").alias("blocks"),
                                                  F.sum(F.length("content")).cast("bigint").alias("chars"))


def q_delimited_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S5 + S6: documents' keys written as ';'-separated CSV files, the separator
    chosen from each header, read back."""
    out = scratch_path(spark, "delimited")
    docs = tables.documents(spark, sf, ["doc_id", "lang", "source"])
    docs.write.option("header", "true").option("sep", ";").csv(out)
    back = C.read_delimited(spark, out)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source")
