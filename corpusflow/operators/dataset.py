"""SFT dataset construction.

All tasks are built in ONE pass over the segments: each segment row produces
an array of per-task samples that is exploded (a narrow generator, no join,
no union of recomputed branches), so the scan and the segmentation run once
however many tasks are selected.  Options (system prompt, extra request,
templates) are run-level strings and are folded into literals; ``template``
may also be a Column for per-row picks (P6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.text import excerpt, py_strip_or, strip_ws
from corpusflow.operators.segment import keep_rows, with_split_point

_MSG = "array<struct<role:string,content:string>>"


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(K.OPEN_QUOTE), c, F.lit(K.CLOSE_QUOTE))


def _template_col(template) -> Column:
    if isinstance(template, Column):
        return F.when(F.length(F.coalesce(strip_ws(template), F.lit(""))) > 0, strip_ws(template)).otherwise(
            F.lit(K.CONTINUATION_TEMPLATE))
    return F.lit(py_strip_or(template, K.CONTINUATION_TEMPLATE))


# --- D1 ----------------------------------------------------------------------------

def with_split(df: DataFrame, col: str = "content", marks: list[str] | None = None) -> DataFrame:
    """G4 as columns: ``first_part``/``second_part``, null where the segment
    yields no continuation sample (too short, or a half below 50 characters)."""
    seg = F.col(col)
    staged = with_split_point(df, col, marks)
    first = strip_ws(F.substring(seg, F.lit(1), F.col("_split")))
    second = strip_ws(F.substring(seg, F.col("_split") + 1, F.length(seg)))
    parts = staged.select("*", first.alias("_first"), second.alias("_second")).drop("_split")
    keep = ((F.length(seg) >= K.CONTINUATION_MIN_SEGMENT) & (F.length("_first") >= K.CONTINUATION_MIN_PART)
            & (F.length("_second") >= K.CONTINUATION_MIN_PART))
    return parts.select(*df.columns, F.when(keep, F.col("_first")).alias("first_part"),
                        F.when(keep, F.col("_second")).alias("second_part"))


def continuation_user(first_part, extra: str = "", template="") -> Column:
    """template + 『first part cut to 200 + "..."』 (+ 续写要求：extra)."""
    first_part = F.col(first_part) if isinstance(first_part, str) else first_part
    shown = excerpt(first_part, K.CONTINUATION_DISPLAY)
    user = F.concat(_template_col(template), F.lit("\n\n"), _quoted(shown))
    if extra.strip():
        user = F.concat(user, F.lit("\n\n" + K.CONTINUATION_EXTRA_LABEL + extra.strip()))
    return user


def continuation_samples(segments: DataFrame, keys: list[str], content: str = "content", system: str = "",
                         extra: str = "", template="", marks: list[str] | None = None) -> DataFrame:
    """Keys, system, user, assistant (= second part); dropped rows removed."""
    split = with_split(segments.select(*keys, content), content, marks)
    s = keep_rows(split, F.col("first_part").isNotNull(), {"fp": "first_part", "sp": "second_part"}) \
        .withColumnRenamed("fp", "first_part").withColumnRenamed("sp", "second_part")
    return s.select(*keys,
                    F.lit(py_strip_or(system, K.SYSTEM_DEFAULT[K.TASK_CONTINUATION])).alias("system"),
                    continuation_user("first_part", extra, template).alias("user"),
                    F.col("second_part").alias("assistant"))


# --- D2, D3 ---------------------------------------------------------------------------

def writing_user(extra: str = "", prompts: Column | None = None) -> Column:
    """Without a model: extra or the default writing request; with a model the
    M5 answer column (already carrying its own fallback)."""
    return prompts if prompts is not None else F.lit(py_strip_or(extra, K.WRITING_FALLBACK))


def revision_user(original, request: Column | None = None, extra: str = "") -> Column:
    original = F.col(original) if isinstance(original, str) else original
    req = request if request is not None else F.lit(py_strip_or(extra, K.REVISION_FALLBACK))
    return F.concat(F.lit(K.REVISION_HEAD), req, F.lit(K.REVISION_MID), _quoted(original))


def revised_user(content: str, extra: str = "") -> Column:
    """The user turn from M6's columns, with its fallbacks: the default request for a null one; for a
    null original the segment, stripped if the model gave an empty answer."""
    seg = F.col(content)
    original = F.coalesce(F.col("original"), F.when(F.coalesce("model_ok", F.lit(False)), strip_ws(seg)).otherwise(seg))
    return revision_user(original, F.coalesce(F.col("request"), F.lit(py_strip_or(extra, K.REVISION_FALLBACK))))


#: Name of the digest that tells apart segments of the same keys.
CONTENT = "content_digest"


def content_digest(content) -> Column:
    """Digest of a segment; a null one is empty."""
    content = F.col(content) if isinstance(content, str) else content
    return F.md5(F.coalesce(content, F.lit("")).cast("binary"))


def _with_answers(base: DataFrame, answers: DataFrame, keys: list[str], content: str) -> DataFrame:
    """``base`` with the model's answers for its segments (M5, M6), one for each row.

    Keys are compared null-safe, and so is the segment's digest where the answers have one: segments that share their
    keys get their own.  Several answers for a segment become one, so that rows never multiply.
    """
    found = [c for c in answers.columns if c not in keys and c != CONTENT]
    match = [*keys, CONTENT] if CONTENT in answers.columns else keys
    pick = F.max(F.struct(*found)).alias("_a")
    one = answers.groupBy(*match).agg(pick).select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(match)], "_a")
    rows = base.withColumn(CONTENT, content_digest(content))
    on = F.lit(True)
    for i, k in enumerate(match):
        on = on & rows[k].eqNullSafe(one[f"_m{i}"])
    return rows.join(one, on, "left").select(*[rows[c] for c in base.columns], "_a.*")


def writing_samples(segments: DataFrame, keys: list[str], content: str = "content", system: str = "",
                    extra: str = "", prompts: DataFrame | None = None) -> DataFrame:
    """assistant = segment; user = M5 answer (``prompts``: keys, user_prompt)
    or, without a model, ``extra`` or the default request."""
    base = segments.select(*keys, content)
    user = writing_user(extra)
    if prompts is not None:
        base = _with_answers(base, prompts, keys, content)
        user = F.coalesce(F.col("user_prompt"), F.lit(py_strip_or(extra, K.WRITING_FALLBACK)))
    return base.select(*keys, F.lit(py_strip_or(system, K.SYSTEM_DEFAULT[K.TASK_WRITING])).alias("system"),
                       user.alias("user"), F.col(content).alias("assistant"))


def revision_samples(segments: DataFrame, keys: list[str], content: str = "content", system: str = "",
                     extra: str = "", revisions: DataFrame | None = None) -> DataFrame:
    """D3: assistant = segment; user = request + 『original』 from M6
    (``revisions``: keys, request, original, model_ok) or the default request and
    the segment itself."""
    base = segments.select(*keys, content)
    user = revision_user(content, None, extra)
    if revisions is not None:
        base = _with_answers(base, revisions, keys, content)
        user = revised_user(content, extra)
    return base.select(*keys, F.lit(py_strip_or(system, K.SYSTEM_DEFAULT[K.TASK_REVISION])).alias("system"),
                       user.alias("user"), F.col(content).alias("assistant"))


# --- D4 ----------------------------------------------------------------------------

def build_dataset(segments: DataFrame, keys: list[str], tasks: list[str] | None = None, content: str = "content",
                  system: str = "", extra: str = "", continuation_template="",
                  marks: list[str] | None = None, writing_prompts: DataFrame | None = None,
                  revisions: DataFrame | None = None) -> DataFrame:
    """``(task_type, keys..., system, user, assistant)`` for the selected
    tasks, in one pass.  Continuation may drop rows; the others never do."""
    tasks = list(K.DATASET_TASKS if tasks is None else tasks)
    if not tasks:
        raise ValueError("select at least one task")
    unknown = [t for t in tasks if t not in K.DATASET_TASKS]
    if unknown:
        raise ValueError(f"unknown tasks: {unknown}")
    base = segments.select(*keys, content)
    if K.TASK_CONTINUATION in tasks:
        base = with_split(base, content, marks)
    if writing_prompts is not None and K.TASK_WRITING in tasks:
        base = _with_answers(base, writing_prompts, keys, content)
    if revisions is not None and K.TASK_REVISION in tasks:
        base = _with_answers(base, revisions, keys, content)
    seg = F.col(content)
    items = []
    for t in tasks:
        sysmsg = F.lit(py_strip_or(system, K.SYSTEM_DEFAULT[t]))
        if t == K.TASK_CONTINUATION:
            user = F.when(F.col("first_part").isNotNull(), continuation_user("first_part", extra, continuation_template))
            assistant = F.col("second_part")
        elif t == K.TASK_WRITING:
            user = (F.coalesce(F.col("user_prompt"), writing_user(extra)) if writing_prompts is not None
                    else writing_user(extra))
            assistant = seg
        else:
            if revisions is not None:
                user = revised_user(content, extra)
            else:
                user = revision_user(seg, None, extra)
            assistant = seg
        items.append(F.struct(F.lit(t).alias("task_type"), sysmsg.alias("system"), user.alias("user"),
                              assistant.alias("assistant")))
    fanned = base.select(*keys, F.explode(F.array(*items)).alias("_s"))
    return fanned.select(F.col("_s.task_type").alias("task_type"), *keys, "_s.system", "_s.user",
                         "_s.assistant").filter(F.col("user").isNotNull())


# --- D5, D6, D7, D8 -------------------------------------------------------------------

def to_messages(system="system", user="user", assistant="assistant") -> Column:
    """``array<struct<role, content>>`` with system, user (and assistant)."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    msgs = [F.struct(F.lit("system").alias("role"), c(system).alias("content")),
            F.struct(F.lit("user").alias("role"), c(user).alias("content"))]
    if assistant is not None:
        msgs.append(F.struct(F.lit("assistant").alias("role"), c(assistant).alias("content")))
    return F.array(*msgs)


def to_jsonl(messages: Column) -> Column:
    """``{"messages": [...]}`` as one JSON line (UTF-8, not escaped)."""
    return F.to_json(F.struct(messages.alias("messages")))


def prompt_only_messages(segment, task, system: str = "", extra: str = "") -> Column:
    """Two-role messages without an assistant turn.

    continuation: 请续写以下段落 + the whole segment quoted; revision: the
    revision request with ``extra`` or the default hint; writing: ``extra`` or
    the default writing request.  Blank system -> the general default."""
    segment = F.col(segment) if isinstance(segment, str) else segment
    task = F.col(task) if isinstance(task, str) else F.lit(task)
    cont = F.concat(F.lit(K.PROMPT_ONLY_CONTINUATION_HEAD), _quoted(segment))
    rev = revision_user(segment, None, extra)
    write = F.lit(py_strip_or(extra, K.PROMPT_ONLY_WRITING_FALLBACK))
    user = F.when(task == K.TASK_CONTINUATION, cont).when(task == K.TASK_REVISION, rev).otherwise(write)
    return to_messages(F.lit(py_strip_or(system, K.PROMPT_ONLY_SYSTEM)), user, None)


def default_user_content(task, extra: str = "") -> Column:
    """Constant user text per task (writing/revision take ``extra`` first)."""
    task = F.col(task) if isinstance(task, str) else F.lit(task)
    return (F.when(task == K.TASK_WRITING, F.lit(py_strip_or(extra, K.DEFAULT_USER_CONTENT[K.TASK_WRITING])))
            .when(task == K.TASK_CONTINUATION, F.lit(K.DEFAULT_USER_CONTENT[K.TASK_CONTINUATION]))
            .otherwise(F.lit(py_strip_or(extra, K.DEFAULT_USER_CONTENT[K.TASK_REVISION]))))


def default_instruction(task) -> Column:
    """Default instruction per task."""
    task = F.col(task) if isinstance(task, str) else F.lit(task)
    return (F.when(task == K.TASK_WRITING, F.lit(K.DEFAULT_INSTRUCTION[K.TASK_WRITING]))
            .when(task == K.TASK_CONTINUATION, F.lit(K.DEFAULT_INSTRUCTION[K.TASK_CONTINUATION]))
            .otherwise(F.lit(K.DEFAULT_INSTRUCTION[K.TASK_REVISION])))


def legacy_user_content(task, content, extra: str = "", writing: Column | None = None,
                        request: Column | None = None, original: Column | None = None) -> Column:
    """Continuation always shows the first 200 characters followed by
    ``...``; writing and revision use the model answers when given, else their
    fallbacks (extra or the default writing text; the default request and the
    content itself)."""
    task = F.col(task) if isinstance(task, str) else F.lit(task)
    content = F.col(content) if isinstance(content, str) else content
    cont = F.concat(F.lit(K.CONTINUATION_TEMPLATE + "\n\n" + K.OPEN_QUOTE), F.substring(content, 1, 200),
                    F.lit("..." + K.CLOSE_QUOTE))
    write = writing if writing is not None else F.lit(py_strip_or(extra, K.WRITING_FALLBACK))
    rev = revision_user(original if original is not None else content, request, extra)
    return F.when(task == K.TASK_WRITING, write).when(task == K.TASK_CONTINUATION, cont).otherwise(rev)


# --- D9 ----------------------------------------------------------------------------

def dataset_counts(samples: DataFrame, task_col: str = "task_type") -> DataFrame:
    """Samples per task (tasks without samples are not listed) and the total
    as a ``__total__`` rollup row."""
    agg = samples.rollup(task_col).agg(F.count("*").cast("bigint").alias("samples"))
    return agg.select(F.coalesce(F.col(task_col), F.lit("__total__")).alias(task_col), "samples")


def planned_items(segments: DataFrame, tasks: list[str]) -> DataFrame:
    """Items planned before building: segments x selected tasks."""
    return segments.agg((F.count("*") * len(tasks)).cast("bigint").alias("planned"))
