"""DuckDB SQL for each registered query: an independent statement of the rules.

Written against the pre-registered views (``documents``, ``conversations`` ...).
Control characters are written with ``chr`` because DuckDB string literals do
not process escapes.
"""

from __future__ import annotations

from corpusflow import constants as K
from corpusflow.plans import sqltext as S

LINE_DELIM = "\\n+"
FIXTURE_MARKS = [".", "!", "?", "\n"]


def _segments_cte(text: str = "text", cleaned: bool = False, extra: str = "") -> str:
    src = S.clean(text) if cleaned else text
    return f"""
  p AS (SELECT doc_id{extra}, {S.paragraphs(src, LINE_DELIM)} AS paras FROM documents),
  f AS (SELECT doc_id{extra}, {S.segments('paras')} AS st FROM p),
  s AS (SELECT doc_id{extra}, {S.finish_segments('st')} AS segs FROM f)"""


SEGMENT_ROWS = f"""WITH {_segments_cte()}
SELECT doc_id, CAST(generate_subscripts(segs, 1) AS BIGINT) AS seg_no, unnest(segs) AS content FROM s"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["segments"] = SEGMENT_ROWS
    q["segment_stats_by_lang"] = f"""WITH {_segments_cte(extra=', lang')},
  d AS (SELECT lang, len(segs) AS n, list_sum(list_transform(segs, lambda x: length(x))) AS c FROM s)
SELECT lang, CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS segments,
       CAST(sum(coalesce(c, 0)) AS BIGINT) AS chars,
       CAST(sum(coalesce(c, 0)) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS avg_len
FROM d GROUP BY lang"""
    q["segment_table"] = f"""WITH {_segments_cte(cleaned=True)}
SELECT doc_id, CAST(generate_subscripts(segs, 1) AS BIGINT) AS seg_no,
       CAST(length(unnest(segs)) AS BIGINT) AS n_chars, {S.strip('unnest(segs)')} AS content FROM s"""
    q["segment_stats"] = f"""WITH {_segments_cte(cleaned=True)},
  r AS (SELECT doc_id, unnest(segs) AS content FROM s)
SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS segments,
       CAST(sum(length(content)) AS BIGINT) AS chars,
       CAST(sum(length(content)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_len FROM r"""
    q["clean_text"] = f"SELECT doc_id, {S.clean('text')} AS cleaned FROM documents"
    q["paragraphs"] = f"""WITH p AS (SELECT doc_id, {S.paragraphs('text', LINE_DELIM)} AS ps FROM documents)
SELECT doc_id, CAST(generate_subscripts(ps, 1) AS BIGINT) AS para_no, unnest(ps) AS paragraph FROM p"""
    q["strip_ws"] = f"""SELECT conv_id, turn, {S.strip('text')} AS stripped, {S.blank('text')} AS blank,
       CAST(length(text) AS BIGINT) AS n_chars FROM conversations"""
    q["truncate_input"] = f"""SELECT doc_id,
       {S.truncate('text', K.PROCESSOR_INPUT_CAP, K.PROCESSOR_TRUNCATION_MARKER)} AS input_10000,
       {S.truncate('text', K.BUILDER_INPUT_CAP, K.BUILDER_TRUNCATION_MARKER)} AS input_8000 FROM documents"""
    q["excerpt"] = f"""SELECT conv_id, turn, {S.excerpt('text', 50)} AS ex_50, {S.excerpt('text', 80)} AS ex_80,
       substr(text, 1, 100) AS ex_100, {S.excerpt('text', 150)} AS ex_150, {S.excerpt('text', 200)} AS ex_200
FROM conversations"""

    def tok(req: str) -> str:
        est = "greatest(least(CAST(length(text) AS BIGINT), 2048), 256)"
        chosen = f"CASE WHEN {req} IS NULL OR {req} > 4096 THEN {est} ELSE {req} END"
        return f"CAST(least({chosen}, 2048) AS BIGINT)"
    q["max_output_tokens"] = f"""SELECT doc_id, {tok('CAST(NULL AS BIGINT)')} AS tokens_default,
       {tok('CAST(4096 AS BIGINT)')} AS tokens_4096, {tok('CAST(1000 AS BIGINT)')} AS tokens_1000,
       {tok('CAST(8192 AS BIGINT)')} AS tokens_8192, {tok('CAST(n_chars - 3000 AS BIGINT)')} AS tokens_per_row
FROM documents"""
    q["split_continuation"] = f"""WITH seg AS ({SEGMENT_ROWS}),
  sp AS (SELECT doc_id, seg_no, content, {S.split_point('content', FIXTURE_MARKS)} AS pt
         FROM seg WHERE length(content) >= {K.CONTINUATION_MIN_SEGMENT}),
  parts AS (SELECT doc_id, seg_no, {S.strip('substr(content, 1, pt)')} AS first_part,
                   {S.strip('substr(content, pt + 1)')} AS second_part FROM sp)
SELECT * FROM parts WHERE length(first_part) >= {K.CONTINUATION_MIN_PART}
  AND length(second_part) >= {K.CONTINUATION_MIN_PART}"""
    q.update(_dataset_sql())
    q.update(_catalog_sql())
    q.update(_infer_sql())
    q["segment_stream"] = SEGMENT_ROWS
    q["infer_stream"] = q["infer_columns"]
    q["written_messages"] = q["messages_jsonl"].replace(
        "SELECT task_type, doc_id, seg_no,", "SELECT task_type,")
    q["written_segments"] = SEGMENT_ROWS
    q["processed_csv"] = q["infer_columns"]
    q["paragraph_blocks_by_lang"] = f"""WITH l AS (SELECT lang, {S.strip('unnest(string_split(text, ' + S.NL + '))')} AS line
                 FROM documents)
SELECT lang, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(length(line)) AS BIGINT) AS chars
FROM l WHERE length(line) > 0 GROUP BY lang"""
    q["delimited_roundtrip"] = "SELECT doc_id, lang, source FROM documents"
    q["corpus_lines_by_lang"] = f"""WITH l AS (SELECT lang, {S.strip('unnest(string_split(text, ' + S.NL + '))')} AS line
                 FROM documents)
SELECT lang, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars
FROM l WHERE length(line) > 0 GROUP BY lang"""
    return q


# --- datasets ------------------------------------------------------------------------------

WRITING_EXTRA = "  悬疑风格，第一人称  "


def _quote(x: str) -> str:
    return f"({S.lit(K.OPEN_QUOTE)} || {x} || {S.lit(K.CLOSE_QUOTE)})"


def _revision_user(original: str, request: str) -> str:
    return f"({S.lit(K.REVISION_HEAD)} || {request} || {S.lit(K.REVISION_MID)} || {_quote(original)})"


def _continuation_cte() -> str:
    return f"""seg AS ({SEGMENT_ROWS}),
  sp AS (SELECT doc_id, seg_no, content, {S.split_point('content', FIXTURE_MARKS)} AS pt
         FROM seg WHERE length(content) >= {K.CONTINUATION_MIN_SEGMENT}),
  parts AS (SELECT doc_id, seg_no, {S.strip('substr(content, 1, pt)')} AS fp,
                   {S.strip('substr(content, pt + 1)')} AS sp2 FROM sp),
  cont AS (SELECT * FROM parts WHERE length(fp) >= {K.CONTINUATION_MIN_PART} AND length(sp2) >= {K.CONTINUATION_MIN_PART})"""


def _cont_select(task: bool = False) -> str:
    t = f"{S.lit(K.TASK_CONTINUATION)} AS task_type, " if task else ""
    user = f"({S.lit(K.CONTINUATION_TEMPLATE)} || {S.JOIN} || {_quote(S.excerpt('fp', K.CONTINUATION_DISPLAY))})"
    return (f"SELECT {t}doc_id, seg_no, {S.lit(K.SYSTEM_DEFAULT[K.TASK_CONTINUATION])} AS system, "
            f"{user} AS \"user\", sp2 AS assistant FROM cont")


def _writing_select(task: bool = False) -> str:
    t = f"{S.lit(K.TASK_WRITING)} AS task_type, " if task else ""
    return (f"SELECT {t}doc_id, seg_no, {S.lit(K.SYSTEM_DEFAULT[K.TASK_WRITING])} AS system, "
            f"{S.lit(K.WRITING_FALLBACK if task else WRITING_EXTRA.strip())} AS \"user\", content AS assistant FROM seg")


def _revision_select(task: bool = False) -> str:
    t = f"{S.lit(K.TASK_REVISION)} AS task_type, " if task else ""
    return (f"SELECT {t}doc_id, seg_no, {S.lit(K.SYSTEM_DEFAULT[K.TASK_REVISION])} AS system, "
            f"{_revision_user('content', S.lit(K.REVISION_FALLBACK))} AS \"user\", content AS assistant FROM seg")


def _dataset_sql() -> dict[str, str]:
    q = {}
    q["continuation_samples"] = f"WITH {_continuation_cte()}\n{_cont_select()}"
    q["writing_samples"] = f"WITH seg AS ({SEGMENT_ROWS})\n{_writing_select()}"
    q["revision_samples"] = f"WITH seg AS ({SEGMENT_ROWS})\n{_revision_select()}"
    ds = f"{_writing_select(True)}\nUNION ALL {_cont_select(True)}\nUNION ALL {_revision_select(True)}"
    q["build_dataset"] = f"WITH {_continuation_cte()}\n{ds}"
    q["dataset_counts"] = f"""WITH {_continuation_cte()}, ds AS ({ds})
SELECT coalesce(task_type, '__total__') AS task_type, CAST(count(*) AS BIGINT) AS samples
FROM ds GROUP BY ROLLUP (task_type)"""
    msgs = ("CAST(to_json({'messages': [{'role': 'system', 'content': system}, {'role': 'user', 'content': \"user\"}, "
            "{'role': 'assistant', 'content': assistant}]}) AS VARCHAR)")
    q["messages_jsonl"] = f"""WITH {_continuation_cte()}, ds AS ({ds})
SELECT task_type, doc_id, seg_no, {msgs} AS line FROM ds"""
    tasks = ", ".join(S.lit(t) for t in K.DATASET_TASKS)
    x = f"seg AS ({SEGMENT_ROWS}), x AS (SELECT doc_id, seg_no, content, unnest([{tasks}]) AS task_type FROM seg)"
    po_user = (f"CASE WHEN task_type = {S.lit(K.TASK_CONTINUATION)} THEN "
               f"{S.lit(K.PROMPT_ONLY_CONTINUATION_HEAD)} || {_quote('content')} "
               f"WHEN task_type = {S.lit(K.TASK_REVISION)} THEN {_revision_user('content', S.lit(K.REVISION_FALLBACK))} "
               f"ELSE {S.lit(K.PROMPT_ONLY_WRITING_FALLBACK)} END")
    q["prompt_only_messages"] = f"""WITH {x}
SELECT doc_id, seg_no, task_type, {S.lit(K.PROMPT_ONLY_SYSTEM)} AS system, {po_user} AS "user",
       CAST(2 AS BIGINT) AS turns FROM x"""
    legacy = (f"CASE WHEN task_type = {S.lit(K.TASK_WRITING)} THEN {S.lit(K.WRITING_FALLBACK)} "
              f"WHEN task_type = {S.lit(K.TASK_CONTINUATION)} THEN {S.lit(K.CONTINUATION_TEMPLATE + chr(10) + chr(10) + K.OPEN_QUOTE)}"
              f" || substr(content, 1, 200) || {S.lit('...' + K.CLOSE_QUOTE)} "
              f"ELSE {_revision_user('content', S.lit(K.REVISION_FALLBACK))} END")
    dflt = (f"CASE WHEN task_type = {S.lit(K.TASK_WRITING)} THEN {S.lit(K.DEFAULT_USER_CONTENT[K.TASK_WRITING])} "
            f"WHEN task_type = {S.lit(K.TASK_CONTINUATION)} THEN {S.lit(K.DEFAULT_USER_CONTENT[K.TASK_CONTINUATION])} "
            f"ELSE {S.lit(K.DEFAULT_USER_CONTENT[K.TASK_REVISION])} END")
    instr = (f"CASE WHEN task_type = {S.lit(K.TASK_WRITING)} THEN {S.lit(K.DEFAULT_INSTRUCTION[K.TASK_WRITING])} "
             f"WHEN task_type = {S.lit(K.TASK_CONTINUATION)} THEN {S.lit(K.DEFAULT_INSTRUCTION[K.TASK_CONTINUATION])} "
             f"ELSE {S.lit(K.DEFAULT_INSTRUCTION[K.TASK_REVISION])} END")
    q["legacy_user_content"] = f"""WITH {x}
SELECT doc_id, seg_no, task_type, {legacy} AS "user", {dflt} AS default_user, {instr} AS instruction FROM x"""
    return q


# --- catalogs ------------------------------------------------------------------------------

ROLE_TASK = {"user": "中文翻译", "assistant": "文本摘要", "system": "格式化"}
CUSTOM_MULTI = "请续写这一段。\n请接着写下去。\n  \n请延续情节，保持人物性格。"
CATEGORY_OF = {K.TASK_WRITING: "风格模仿", K.TASK_REVISION: "文本润色"}


def _resolved_tasks_sql() -> str:
    merged = dict(K.DEFAULT_TASKS)
    merged.update(K.SHIPPED_TASKS)
    rows = ", ".join(f"({S.lit(k)}, {S.lit(v)})" for k, v in merged.items())
    return f"(SELECT * FROM (VALUES {rows}) AS t(task, prompt))"


def _catalog_sql() -> dict[str, str]:
    q = {}
    q["attach_task"] = f"""SELECT conv_id, turn, t.task AS task, t.prompt AS prompt
FROM conversations JOIN {_resolved_tasks_sql()} t ON t.task = '文本摘要'"""
    role_map = " ".join(f"WHEN role = {S.lit(r)} THEN {S.lit(t)}" for r, t in ROLE_TASK.items())
    q["attach_task_per_row"] = f"""WITH c AS (SELECT conv_id, turn, CASE {role_map} END AS task FROM conversations)
SELECT conv_id, turn, c.task AS task, t.prompt AS prompt FROM c LEFT JOIN {_resolved_tasks_sql()} t ON t.task = c.task"""
    pre = K.PREDEFINED_REVERSE_PROMPTS
    w = pre[K.REVERSE_TYPE[K.TASK_WRITING]][CATEGORY_OF[K.TASK_WRITING]]
    r = pre[K.REVERSE_TYPE[K.TASK_REVISION]][CATEGORY_OF[K.TASK_REVISION]]
    c1 = pre[K.REVERSE_TYPE[K.TASK_CONTINUATION]]["情节延续"]
    lines = f"list_filter(list_transform(string_split(prompt, {S.NL}), lambda q: {S.strip('q')}), lambda q: length(q) > 0)"
    idx = "CAST(('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR) || ':' || CAST(seg_no AS VARCHAR)), 1, 8)) AS BIGINT)"
    tasks = ", ".join(S.lit(t) for t in K.DATASET_TASKS)
    q["reverse_prompts"] = f"""WITH seg AS ({SEGMENT_ROWS}),
  x AS (SELECT doc_id, seg_no, unnest([{tasks}]) AS task_type FROM seg),
  c AS (SELECT doc_id, seg_no, task_type,
          CASE WHEN task_type = {S.lit(K.TASK_CONTINUATION)} THEN (CASE WHEN seg_no = 1 THEN '情节延续' ELSE '多样续写' END)
               WHEN task_type = {S.lit(K.TASK_WRITING)} THEN {S.lit(CATEGORY_OF[K.TASK_WRITING])}
               ELSE {S.lit(CATEGORY_OF[K.TASK_REVISION])} END AS category FROM x),
  p AS (SELECT *, CASE WHEN category = '多样续写' THEN {S.lit(CUSTOM_MULTI)}
                       WHEN category = '情节延续' THEN {S.lit(c1)}
                       WHEN category = {S.lit(CATEGORY_OF[K.TASK_WRITING])} THEN {S.lit(w)}
                       ELSE {S.lit(r)} END AS prompt FROM c),
  l AS (SELECT *, {lines} AS ls FROM p)
SELECT doc_id, seg_no, task_type, category,
       CASE WHEN prompt = '' THEN '' WHEN len(ls) = 0 THEN prompt ELSE ls[({idx} % len(ls)) + 1] END AS template FROM l"""
    return q


# --- inference -------------------------------------------------------------------------------

SUMMARY_PROMPT = K.DEFAULT_TASKS["文本摘要"]


def _user(text: str, prompt_sql: str, cap: int, marker: str) -> str:
    return (f"({S.lit(K.USER_TEMPLATE_HEAD)} || {prompt_sql} || {S.lit(K.USER_TEMPLATE_MID)} || "
            f"{S.truncate(text, cap, marker)})")


def _tokens(body: str) -> str:
    return f"CAST(least(greatest(least(CAST(length({body}) AS BIGINT), 2048), 256), 2048) AS BIGINT)"


def _echo(u: str) -> str:
    return S.strip(f"CAST(length({u}) AS VARCHAR) || '|' || substr({u}, greatest(length({u}) - 39, 1))")


def _infer_sql() -> dict[str, str]:
    q = {}
    P = S.lit(SUMMARY_PROMPT)
    pu = _user("text", P, K.PROCESSOR_INPUT_CAP, K.PROCESSOR_TRUNCATION_MARKER)
    bu = _user("text", P, K.BUILDER_INPUT_CAP, K.BUILDER_TRUNCATION_MARKER)
    btr = S.truncate("text", K.BUILDER_INPUT_CAP, K.BUILDER_TRUNCATION_MARKER)
    stop = S.lit("|".join(K.BUILDER_STOP))
    q["render_request"] = f"""SELECT conv_id, turn, {S.lit(K.PROCESSOR_SYSTEM)} AS system, {pu} AS "user",
       {S.lit(K.BUILDER_SYSTEM)} AS builder_system, {bu} AS builder_user, {_tokens(btr)} AS builder_max_tokens,
       {stop} AS builder_stop FROM conversations WHERE NOT {S.blank('text')}"""
    q["assign_batches"] = f"""WITH c AS (SELECT conv_id, turn, NOT {S.blank('text')} AS sel FROM conversations),
  n AS (SELECT conv_id, turn, CASE WHEN sel THEN row_number() OVER (PARTITION BY sel ORDER BY conv_id, turn) END AS i FROM c)
SELECT conv_id, turn, CAST(i AS BIGINT) AS item_no, CAST((i - 1) // 10 AS BIGINT) AS batch_no FROM n"""
    q["workload_summary"] = f"""WITH l AS (SELECT 'text' AS "column", text AS v FROM conversations
             UNION ALL SELECT 'role', role FROM conversations),
  f AS (SELECT * FROM l WHERE NOT {S.blank('v')})
SELECT coalesce("column", '__total__') AS "column", CAST(count(*) AS BIGINT) AS items, avg(length(v)) AS avg_len
FROM f GROUP BY ROLLUP ("column")"""
    echo = f"""WITH r AS (SELECT conv_id, turn, text, {pu} AS u FROM conversations)
SELECT conv_id, turn, CASE WHEN {S.blank('text')} THEN '' ELSE {_echo('u')} END AS text_processed FROM r"""
    q["infer_columns"] = echo
    q["resume"] = echo
    fail = S.lit(K.FAILED_CONNECTION.format(err="no route to model", n=K.ITEM_RETRIES))
    flaky = f"""r AS (SELECT doc_id, text, {pu} AS u, substr({S.truncate('text', K.PROCESSOR_INPUT_CAP, K.PROCESSOR_TRUNCATION_MARKER)}, 1, 1) AS f0
             FROM documents),
  o AS (SELECT doc_id, text, CASE WHEN {S.blank('text')} THEN ''
                    WHEN f0 = 'T' THEN {fail}
                    WHEN f0 = 'E' THEN ''
                    WHEN f0 = 'S' THEN '本次失败 ' || CAST(length(u) AS VARCHAR)
                    ELSE 'ok:' || CAST(length(u) AS VARCHAR) END AS res FROM r)"""
    q["outcome_stats"] = f"""WITH {flaky},
  it AS (SELECT * FROM o WHERE NOT {S.blank('text')}),
  a AS (SELECT 'text' AS c, CAST(count(*) AS BIGINT) AS items,
               CAST(count(*) FILTER (WHERE length(res) > 0 AND NOT starts_with(res, '处理失败')) AS BIGINT) AS success
        FROM it GROUP BY ROLLUP (c))
SELECT coalesce(c, '__total__') AS "column", items, success, items - success AS failed,
       CAST(success AS DOUBLE) / CAST(items AS DOUBLE) * 100 AS success_pct,
       CAST(items - success AS DOUBLE) / CAST(items AS DOUBLE) * 100 AS failed_pct FROM a"""
    q["result_lengths"] = f"""WITH {flaky}, s AS (SELECT {S.strip('res')} AS v FROM o)
SELECT 'text' AS "column", CAST(count(*) FILTER (WHERE length(v) > 0) AS BIGINT) AS non_empty,
       CAST(count(*) FILTER (WHERE starts_with(v, '处理失败')) AS BIGINT) AS failed,
       CAST(count(*) FILTER (WHERE length(v) > 0) - count(*) FILTER (WHERE starts_with(v, '处理失败')) AS BIGINT) AS success,
       avg(CASE WHEN length(v) > 0 THEN length(v) END) AS avg_len FROM s"""
    q["quality_report"] = f"""WITH {flaky},
  a AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE length({S.strip('res')}) = 0) AS BIGINT) AS e,
               CAST(count(*) FILTER (WHERE regexp_matches(res, '{K.QUALITY_ERROR_PATTERN}')) AS BIGINT) AS x FROM o)
SELECT 'text' AS "column", n AS "rows", e AS empty, x AS error, n - e - x AS valid,
       CAST(n - e - x AS DOUBLE) / CAST(n AS DOUBLE) * 100 AS valid_pct,
       CAST(x AS DOUBLE) / CAST(n AS DOUBLE) * 100 AS error_pct,
       CAST(e AS DOUBLE) / CAST(n AS DOUBLE) * 100 AS empty_pct FROM a"""
    q["sample_preview"] = f"""WITH r AS (SELECT conv_id, turn, text, {pu} AS u FROM conversations),
  p AS (SELECT conv_id, turn, text, CASE WHEN {S.blank('text')} THEN '' ELSE {_echo('u')} END AS tp FROM r
        ORDER BY conv_id, turn LIMIT 5)
SELECT conv_id, turn, {S.excerpt('text', 150)} AS text, {S.excerpt('tp', 150)} AS text_processed FROM p"""
    # M5 + D2
    wtext = f"({S.lit(K.WRITING_TEXT_HEAD)} || content || {S.lit(K.EXTRA_LABEL + WRITING_EXTRA)})"
    wbody = S.truncate(wtext, K.BUILDER_INPUT_CAP, K.BUILDER_TRUNCATION_MARKER)
    wu = f"({S.lit(K.USER_TEMPLATE_HEAD + K.WRITING_REVERSE_DEFAULT + K.USER_TEMPLATE_MID)} || {wbody})"
    q["writing_samples_model"] = f"""WITH seg AS ({SEGMENT_ROWS}),
  r AS (SELECT doc_id, seg_no, content, {wu} AS u, {_tokens(wbody)} AS mt FROM seg)
SELECT doc_id, seg_no, {S.lit(K.SYSTEM_DEFAULT[K.TASK_WRITING])} AS system,
       {S.strip("'写一段' || CAST(length(u) AS VARCHAR) || '字的故事，max_tokens=' || CAST(mt AS VARCHAR)")} AS "user",
       content AS assistant FROM r"""
    # M6 + D3
    rtext = (f"({S.lit(K.REVISION_TEXT_ORIGINAL)} || content || {S.lit(K.REVISION_TEXT_MODIFIED)} || content || "
             f"{S.lit(K.EXTRA_LABEL)})")
    ru = (f"({S.lit(K.USER_TEMPLATE_HEAD + K.REVISION_REVERSE_DEFAULT + K.USER_TEMPLATE_MID)} || "
          f"{S.truncate(rtext, K.BUILDER_INPUT_CAP, K.BUILDER_TRUNCATION_MARKER)})")
    sbody = S.truncate("content", K.BUILDER_INPUT_CAP, K.BUILDER_TRUNCATION_MARKER)
    q["revision_samples_model"] = f"""WITH seg AS ({SEGMENT_ROWS}),
  r AS (SELECT doc_id, seg_no, content, '请润色 ' || CAST(length({ru}) AS VARCHAR) AS req,
               CASE WHEN starts_with({sbody}, 'E') THEN '' ELSE {S.strip("'简化:' || substr(" + sbody + ", 1, 30)")} END AS orig
        FROM seg)
SELECT doc_id, seg_no, {S.lit(K.SYSTEM_DEFAULT[K.TASK_REVISION])} AS system,
       {_revision_user(f"CASE WHEN length(orig) > 0 THEN orig ELSE {S.strip('content')} END", 'req')} AS "user",
       content AS assistant FROM r"""
    return q
