"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from corpusflow.llm import licenses

#: Reads straight from the rows: what formatting and reading back must give.
OP2 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
e AS (
  SELECT *, replace(text, chr(27), chr(27) || chr(27)) AS x FROM t),
f AS (
  SELECT conv_id, turn, role, text,
         length(regexp_replace(x, '(<s>|</s>|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|\\[ANS\\]|\\[ROLE\\]|\\[/ROLE\\]|\\[END\\])', '_\\1', 'g'))
         + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'system' THEN 17 ELSE 20 + length(role) END AS n,
         lag(role) OVER w AS before, row_number() OVER w AS k FROM e
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n) AS BIGINT) AS formatted_chars,
       bool_and(CASE role WHEN 'system' THEN k = 1 WHEN 'user' THEN k = 1 OR before IN ('assistant', 'system')
                WHEN 'assistant' THEN k > 1 AND before = 'user' ELSE false END) AS in_order
FROM f GROUP BY conv_id
"""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS span, array_to_string(w[j:j + least(10, len(w)) - 1], ' ') AS ws
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS j FROM b WHERE len(w) > 0)),
spots AS (
  SELECT doc_id, i, span, array_to_string(w[i:i + span - 1], ' ') AS ws
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS i FROM d, (SELECT DISTINCT span FROM win) WHERE len(w) >= span)),
hit AS (SELECT doc_id, i, spots.span, item_id FROM spots JOIN win USING (ws, span)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + span)) AS q FROM hit) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: Shingle sets, their pairs over the threshold by shared shingles, and reachability.
OP3 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY 1) m USING (doc_id)
"""

_KNOWN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (licenses.SENTENCES | licenses.VARIANTS).items()) + "}"
_RULES = ", ".join(f"{{'name': '{n}', 'rule': '{p}'}}" for n, p in licenses.RULES)
_NORMAL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(text: str, pattern: str, written: str) -> str:
    return f"regexp_replace({text}, {_lit(pattern)}, {_lit(written.replace('$', chr(92)))}, 'g')"


def _license_ids(n: str) -> str:
    """Identifiers of a normalised sentence: known as it is, an SPDX line, a statement of any subject, or free software."""
    spelled = f"replace({n}, 'licence', 'license')"
    stated = ", ".join(f"known[{_replaced(spelled, licenses.SUBJECT, start + ' $1')}]" for start in licenses.STARTS)
    names = f"regexp_split_to_array(replace(substr({n}, 25), ' or later', ' or-later'), ' (?:or|and) ')"
    spdx = f"array_to_string(list_transform({names}, lambda e: coalesce(known['spdx ' || replace(e, 'or-later', 'or later')], 'unknown')), ';')"
    return (f"coalesce(known[{n}], CASE WHEN {n} LIKE 'spdx license identifier %' THEN {spdx} WHEN regexp_matches({n}, {_lit(licenses.NEGATED)}) THEN NULL "
            f"WHEN {n} LIKE '% under %' THEN coalesce({stated}) WHEN regexp_matches({n}, {_lit(licenses.FREE)}) THEN 'gplfree' END)")


_WRITTEN = _replaced(_replaced("text", licenses.MARKS, "$1"), licenses.NAMED, licenses.HOLDER)
for _pattern, _text in licenses.SPDX:
    _WRITTEN = _replaced(_WRITTEN, _pattern, _text)

OP4 = f"""
WITH m AS (SELECT {_KNOWN} AS known),
c AS (
  SELECT doc_id, row_number() OVER () AS rn, known, string_split({_replaced(_WRITTEN, licenses.ENDS, "$1$2" + licenses.END)}, chr(1)) AS cut
  FROM (SELECT doc_id, CASE WHEN regexp_matches(text, {_lit(licenses.GATE)}) OR regexp_matches(text, {_lit(licenses.ALSO)}) THEN text END AS text FROM documents), m),
s AS (SELECT rn, known, unnest(cut) AS s, generate_subscripts(cut, 1) AS i FROM c WHERE cut IS NOT NULL),
n AS (SELECT *, {_NORMAL.format("s")} AS n FROM s),
k AS (SELECT *, {_license_ids("n")} AS id, string_split(s, chr(10)) AS ls FROM n),
u AS (SELECT rn, i, known, unnest(ls) AS l, generate_subscripts(ls, 1) AS j FROM k WHERE id IS NULL),
v AS (SELECT *, {_NORMAL.format("l")} AS n FROM u),
l AS (
  SELECT rn, i, 0 AS j, id FROM k WHERE id IS NOT NULL
  UNION ALL
  SELECT rn, i, j, coalesce({_license_ids("n")}, CASE WHEN regexp_matches(l, {_lit(licenses.GATE)}) THEN 'unknown' END) AS id FROM v),
q AS (SELECT rn, string_agg(id, ';' ORDER BY i, j) AS sequence FROM l WHERE id IS NOT NULL GROUP BY 1),
x AS (
  SELECT *, len(list_filter(string_split(sequence, ';'), lambda z: z <> 'unknown')) AS n, list_reduce(
    list_prepend({{'name': ';' || sequence || ';', 'rule': ''}}, [{_RULES}]),
    lambda a, r: CASE WHEN regexp_matches(a.name, r.rule) THEN {{
      'name': regexp_replace(regexp_replace(a.name, r.rule, ';', 'g'), r.rule, ';', 'g'), 'rule': a.rule || ',' || r.name}} ELSE a END) AS x FROM q),
g AS (SELECT *, list_sort(list_distinct(list_filter(string_split(x.rule, ','), lambda z: z <> ''))) AS named FROM x),
f AS (SELECT *, CASE WHEN len(named) > 1 THEN list_filter(named, lambda z: z <> 'Proprietary') ELSE named END AS found FROM g)
SELECT c.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(sequence, '') AS sequence, coalesce(array_to_string(found, ','), '') AS licenses,
       CAST(coalesce(len(found), 0) AS BIGINT) AS n_licenses,
       CAST(coalesce(len(list_filter(string_split(x.name, ';'), lambda z: z <> '')), 0) AS BIGINT) AS n_left
FROM c LEFT JOIN f USING (rn)
"""

ORACLE = {"op4_license_scan": OP4, "op3_jaccard_join": OP3, "op2_chat_formatting": OP2, "op9_decontamination": OP9}
