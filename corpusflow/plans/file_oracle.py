"""DuckDB SQL of the queries over written files."""

from __future__ import annotations

from corpusflow import constants as K
from corpusflow.plans import oracle as O
from corpusflow.plans import sqltext as S

CR = "chr(13)"
_NOVEL = f"""
  d AS (SELECT *, CASE WHEN length(text) = strlen(text) AND lang = 'en' THEN 'gbk' ELSE 'bom' END AS kind FROM documents WHERE text IS NOT NULL),
  n AS (SELECT kind, lang, source,
               CASE WHEN kind = 'gbk' THEN '第一章' || {S.NL} ELSE '' END || string_agg(text, {S.JOIN} ORDER BY doc_id) || {S.JOIN} AS text
        FROM d GROUP BY kind, lang, source)"""


def _segments(text: str) -> str:
    return f"""WITH{_NOVEL},
  p AS (SELECT kind, lang, source, {S.paragraphs(text, chr(92) + "n{2,}")} AS paras FROM n),
  f AS (SELECT kind, lang, source, {S.segments('paras')} AS st FROM p),
  s AS (SELECT kind, lang, source, {S.finish_segments('st')} AS segs FROM f)"""


_RAW, _CLEAN = _segments("text"), _segments(S.clean("text"))


def _lines(text: str) -> str:
    return f"list_filter(list_transform(string_split({text}, {S.NL}), lambda q: {S.strip('q')}), lambda q: length(q) > 0)"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["novel_documents"] = f"""WITH{_NOVEL}
SELECT kind, lang, source, CASE kind WHEN 'gbk' THEN 'gbk' ELSE 'utf-8' END AS encoding_used, CAST(length(text) AS BIGINT) AS chars, sha256(text) AS sha256 FROM n"""
    q["novel_lines"] = f"""WITH{_NOVEL}, l AS (SELECT kind, lang, source, {_lines('text')} AS ls FROM n)
SELECT kind, lang, source, CAST(generate_subscripts(ls, 1) AS BIGINT) AS row_no, unnest(ls) AS content FROM l"""
    q["novel_lines_split"] = f"SELECT * FROM ({q['novel_lines']}) WHERE kind = 'bom'"
    q["novel_lines_ranges"] = q["novel_lines"]
    q["novel_encodings_ranges"] = f"""WITH{_NOVEL}
SELECT kind, lang, source, CASE kind WHEN 'gbk' THEN 'gbk' ELSE 'utf-8' END AS encoding_used,
       CAST(length(replace(text, {S.NL}, '')) AS BIGINT) AS chars FROM n"""
    q["paragraph_blocks_ranges"] = f"SELECT *, CAST(0 AS BIGINT) AS off FROM ({O.sql()['paragraph_blocks_by_lang']})"
    q["delimited_ranges"] = f"""SELECT doc_id, 'say "' || text || '",' || {S.NL} || '"' || {S.NL} AS text, source FROM documents"""
    q["delimited_headers"] = """SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id * 2 END AS own_row, doc_id || CASE WHEN lang = 'en' THEN 'd' ELSE 'f' END AS text,
       CASE WHEN lang = 'en' THEN source END AS again, CASE WHEN lang = 'en' THEN lang END AS named FROM documents"""
    q["corpus_numeric_content"] = """SELECT CASE WHEN lang = 'en' THEN '00' || doc_id ELSE 'line ' || doc_id END AS content,
       CASE WHEN lang = 'en' THEN lang END AS lang FROM documents"""
    q["novel_segments"] = f"""{_CLEAN}
SELECT kind, lang, source, CAST(generate_subscripts(segs, 1) AS BIGINT) AS seg_no, CAST(length(unnest(segs)) AS BIGINT) AS n_chars, {S.strip('unnest(segs)')} AS content FROM s"""
    q["novel_stream"] = f"""{_RAW}
SELECT kind, lang, source, CAST(generate_subscripts(segs, 1) AS BIGINT) AS seg_no, unnest(segs) AS content FROM s"""
    q["novel_segments_ranges"] = q["novel_stream"]
    q["book_segments"] = f"""WITH d AS (SELECT doc_id, {S.paragraphs('text', chr(92) + 'n+')} AS ps FROM documents),
  b AS (SELECT flatten(list(ps ORDER BY doc_id)) AS paras FROM d),
  f AS (SELECT {S.segments('paras')} AS st FROM b), s AS (SELECT {S.finish_segments('st')} AS segs FROM f)
SELECT CAST(generate_subscripts(segs, 1) AS BIGINT) AS seg_no, CAST(length(unnest(segs)) AS BIGINT) AS n_chars, unnest(segs) AS content FROM s"""
    q["novel_stats"] = f"""{_RAW}, r AS (SELECT kind, lang, source, unnest(segs) AS content FROM s)
SELECT kind, CAST(count(DISTINCT (lang, source)) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS segments, CAST(sum(length(content)) AS BIGINT) AS chars,
       CAST(sum(length(content)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_len FROM r GROUP BY kind"""
    q["delimited_mixed"] = """SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN source END AS source,
       CASE WHEN lang IS DISTINCT FROM 'es' THEN nullif(text, '') END AS text, CASE WHEN lang = 'es' THEN '第一章' END AS note FROM documents"""
    parts = f"""c AS (SELECT conv_id, turn, coalesce(text, '') AS text, CASE WHEN role IN ('assistant', 'system') THEN role ELSE 'user' END AS role FROM conversations),
  u AS (SELECT turn, {_lines('text')} AS ls FROM c WHERE role = 'user'), a AS (SELECT turn, {_lines('text')} AS ls FROM c WHERE role = 'assistant'),
  y AS (SELECT * FROM c WHERE role = 'system')"""
    total = "CAST(sum(list_sum(list_transform(ls, lambda z: length(z)))) AS BIGINT)"
    q["corpus_dispatch"] = f"""WITH {parts}
SELECT 'user' AS role, 'read' AS outcome, count(DISTINCT turn) AS files, CAST(sum(len(ls)) AS BIGINT) AS "rows", {total} AS chars FROM u
UNION ALL SELECT 'assistant', 'read', count(DISTINCT turn), CAST(sum(len(ls)) AS BIGINT), {total} FROM a
UNION ALL SELECT 'system', 'read', count(DISTINCT turn), count(*), CAST(sum(length(text)) AS BIGINT) FROM y
UNION ALL SELECT 'bare', 'read', count(DISTINCT turn), count(*), 0 FROM y
UNION ALL SELECT 'office', 'unsupported type', count(DISTINCT turn), 0, 0 FROM u"""
    q["file_profile"] = f"""WITH {parts}
SELECT 'user' AS role, turn AS key, '.txt' AS "type", CAST(sum(len(ls)) AS BIGINT) AS "rows", CAST(1 AS BIGINT) AS columns FROM u GROUP BY turn
UNION ALL SELECT 'assistant', turn, '.md', CAST(sum(len(ls)) AS BIGINT), 1 FROM a GROUP BY turn
UNION ALL SELECT 'system', turn, '.csv', count(*), 3 FROM y GROUP BY turn
UNION ALL SELECT 'bare', turn, '.csv', count(*), 2 FROM y GROUP BY turn"""
    prompt = S.lit(O.SUMMARY_PROMPT)
    pu = O._user("text", prompt, K.PROCESSOR_INPUT_CAP, K.PROCESSOR_TRUNCATION_MARKER)
    q["infer_corpus"] = f"""WITH r AS (SELECT turn, nullif(text, '') AS text, {pu} AS u FROM conversations WHERE role = 'system')
SELECT turn, text, CASE WHEN {S.blank('text')} THEN '' ELSE {O._echo('u')} END AS text_processed FROM r"""
    q["corpus_outcome"] = f"""WITH {parts},
  o AS (SELECT DISTINCT 'processed' AS status, turn, 's' AS r FROM y UNION ALL SELECT DISTINCT 'failed', turn, 'b' FROM y
        UNION ALL SELECT DISTINCT 'failed', turn, 'u' FROM u UNION ALL SELECT DISTINCT 'failed', turn, 'a' FROM a)
SELECT coalesce(status, '__total__') AS status, count(*) AS files FROM o GROUP BY ROLLUP (status)"""
    q["filter_report"] = f"""WITH {parts},
  n AS (SELECT (SELECT count(DISTINCT turn) FROM u) AS nu, (SELECT count(DISTINCT turn) FROM a) AS na, (SELECT count(DISTINCT turn) FROM y) AS ny)
SELECT 2 * nu + na + 2 * ny AS total, na + 2 * ny AS matched, least(na + 2 * ny, 10) AS shown, greatest(na + 2 * ny - 10, 0) AS more FROM n"""
    q["written_two_runs"] = f"""WITH g AS ({O.SEGMENT_ROWS})
SELECT 'r1' AS run_id, * FROM g UNION ALL SELECT 'r2', * FROM g WHERE seg_no = 1"""
    q["processed_exact"] = f"""SELECT doc_id, '  "' || text || '\\", ' || {S.NL} || ' ' AS text FROM documents"""
    first = f"substr({S.truncate('text', K.PROCESSOR_INPUT_CAP, K.PROCESSOR_TRUNCATION_MARKER)}, 1, 1)"
    cell = "CASE WHEN text_processed = '' OR regexp_matches(text_processed, '[\",\\r\\n]') THEN '\"' || replace(text_processed, '\"', '\"\"') || '\"' ELSE text_processed END"
    q["processed_ordered"] = f"""WITH e AS ({O.sql()["infer_columns"]}),
  l AS (SELECT conv_id, turn, conv_id || ',' || turn || ',' || {cell} AS line FROM e),
  s AS (SELECT 'conv_id,turn,text_processed' || {S.NL} || string_agg(line || {S.NL}, '' ORDER BY conv_id, turn) AS doc FROM l),
  p AS (SELECT {_lines('doc')} AS ls, CAST(3 + strlen(doc) AS BIGINT) AS bytes FROM s)
SELECT CAST(generate_subscripts(ls, 1) AS BIGINT) AS row_no, unnest(ls) AS content, bytes FROM p"""
    q["processed_nulls"] = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN text END AS text, lang FROM documents"
    q["written_containers"] = O.SEGMENT_ROWS
    q["novel_stream_outcomes"] = f"""WITH{_NOVEL}
SELECT kind, lang, source, CASE kind WHEN 'gbk' THEN 'undecodable' ELSE 'read' END AS status, CASE kind WHEN 'bom' THEN 'utf-8' END AS encoding_used FROM n"""
    q["resume_failed"] = f"""WITH r AS (SELECT doc_id, text, {pu} AS u, {first} AS f0 FROM documents)
SELECT doc_id, CASE WHEN {S.blank('text')} THEN '' WHEN doc_id % 3 <> 0 OR f0 = 'T' THEN {O._echo('u')} WHEN f0 = 'E' THEN ''
       WHEN f0 = 'S' THEN '本次失败 ' || CAST(length(u) AS VARCHAR) ELSE 'ok:' || CAST(length(u) AS VARCHAR) END AS text_processed FROM r"""
    q["call_outcomes"] = f"""SELECT doc_id, {first} <> 'T' AS ok, CAST(CASE WHEN {first} = 'T' THEN {K.ITEM_RETRIES + 1} ELSE 1 END AS BIGINT) AS attempts,
       CASE WHEN {first} = 'T' THEN 'connection' ELSE '' END AS error_class FROM documents WHERE NOT {S.blank('text')}"""
    q["throughput"] = """WITH r AS (SELECT role AS c, conv_id + turn / 2.0 AS t0 FROM conversations),
  a AS (SELECT c, count(*) AS done, CAST(max(t0) + 0.25 - min(t0) AS DOUBLE) AS span_s FROM r GROUP BY ROLLUP (c)),
  b AS (SELECT coalesce(c, '__total__') AS "column", done, span_s, done / span_s AS items_per_s,
               CASE c WHEN 'user' THEN 1000000 WHEN 'assistant' THEN 500000 WHEN 'system' THEN 100000 ELSE 1600000 END AS planned FROM a)
SELECT "column", done, span_s, items_per_s, greatest(planned - done, 0) AS remaining, greatest(planned - done, 0) / items_per_s AS eta_s,
       CAST(done AS DOUBLE) / planned * 100 AS pct_done FROM b"""
    pr = O._user("role", prompt, K.PROCESSOR_INPUT_CAP, K.PROCESSOR_TRUNCATION_MARKER)
    echo = lambda c, u: f"CASE WHEN {S.blank(c)} THEN '' ELSE {O._echo(u)} END AS {c}_processed"
    q["resume_interrupted"] = f"WITH r AS (SELECT doc_id, text, {pu} AS u FROM documents) SELECT doc_id, {echo('text', 'u')} FROM r"
    q["infer_repeated_keys"] = f"""WITH r AS (SELECT CASE WHEN conv_id % 3 > 0 THEN conv_id END AS conv_id, role, text, {pu} AS u, {pr} AS ur FROM conversations)
SELECT conv_id, role, text, {echo('text', 'u')}, {echo('role', 'ur')} FROM r"""
    q["infer_distinct"] = f"""WITH r AS (SELECT *, {pu} AS u, {pr} AS ur FROM conversations),
  c AS (SELECT u FROM r WHERE NOT {S.blank('text')} UNION SELECT ur FROM r WHERE NOT {S.blank('role')})
SELECT conv_id, turn, {echo('text', 'u')}, {echo('role', 'ur')}, (SELECT count(*) FROM c) AS calls FROM r"""
    q["infer_stream_retry"] = O.sql()["infer_columns"]
    q["writing_samples_repeated"] = f"""SELECT doc_id, system, "user", assistant FROM ({O.sql()["writing_samples_model"]})"""
    q["infer_state_stream"] = O.sql()["infer_columns"]
    q["stream_progress"] = "SELECT count(*) AS rows, count(*) AS observed, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents"
    q["infer_two_streams"] = O.sql()["infer_columns"]
    q["collapse_blanks"] = """SELECT doc_id, regexp_replace(replace(text, ' ', ' ' || chr(9) || ' '), '[ \\t]+', ' ', 'g') AS collapsed FROM documents"""
    kind, cats = next(iter(K.PREDEFINED_REVERSE_PROMPTS.items()))
    rows = ", ".join(f"({S.lit(c)}, {S.lit(p)})" for c, p in cats.items())
    q["categories_by_source"] = f"""WITH t AS (SELECT * FROM (VALUES {rows}) v(category, prompt)), s AS (SELECT source, count(*) AS documents FROM documents GROUP BY 1)
SELECT source, documents, category, '• ' || category || ': ' || substr(prompt, 1, 80) || '...' AS line FROM s CROSS JOIN t"""
    return q
