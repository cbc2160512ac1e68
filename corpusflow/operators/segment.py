"""Segmentation (G1, G2) and the continuation split.

G1 is a sequential fold over the paragraphs of ONE document, so it is a narrow,
row-local operation: no shuffle, no grouping, any number of documents in
parallel.  The paragraph array is computed in its own projection and the fold
is a single higher-order ``aggregate`` in the next one, so the ``split`` runs
once per document (checked with ``explain``).

Fold rules (per document, paragraphs in order):
  * ``cur`` empty                          -> ``cur = p``
  * ``len(cur) + len(p) + 2 <= max_len``   -> ``cur += "\\n\\n" + p``
  * otherwise close ``cur`` and start ``cur = p``
Closing: if ``len(cur) < min_len`` and some segment was already emitted, append
``cur`` to the last emitted segment (which may then exceed ``max_len``),
otherwise emit it.  The last ``cur`` closes the same way.

The fold runs over paragraph LENGTHS and only collects the first paragraph of
each segment.  Spark copies the whole fold state after every element, so the
paragraphs are folded in blocks: the inner fold's state holds at most one
block's starts, and the starts so far are copied once per block.  The segment
strings are assembled at the end with ``slice`` + ``array_join``.  Documents of
every size take this one route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions.text import clean_text, strip_ws

#: Paragraphs folded at a time.
FOLD_BLOCK = 256


def _check_bounds(min_len: int, max_len: int) -> None:
    if min_len <= 0 or max_len <= 0:
        raise ValueError("segment lengths must be greater than 0")
    if min_len >= max_len:
        raise ValueError("min_len must be smaller than max_len")


def sql_literal(s: str) -> str:
    """A Spark SQL string literal equal to ``s``: backslash, quote, whitespace
    and non-printable characters are written as escapes."""
    out = []
    for ch in s:
        if ch == "\\":
            out.append("\\\\")
        elif ch == "'":
            out.append("\\'")
        elif ch.isspace() or not ch.isprintable():
            out.append(f"\\u{ord(ch):04x}")
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def let_sql(name: str, value: str, body: str) -> str:
    """SQL text: ``value`` evaluated once, then used as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def fold_starts_sql(lengths: str, min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN) -> str:
    """G1 decisions on an ``array<int>`` of paragraph lengths, as SQL text: the
    0-based first paragraph of each segment.  A short pack that joins the segment
    before it simply has no start of its own."""
    _check_bounds(min_len, max_len)

    def state(first, length, some, starts):
        return (f"named_struct('i', a_.i + 1, 'first', {first}, 'len', {length}, 'some', {some}, 'starts', {starts})")

    merge = (f"(a_, l_) -> CASE "
             f"WHEN a_.first < 0 THEN {state('a_.i', 'l_', 'a_.some', 'a_.starts')} "
             f"WHEN a_.len + l_ + 2 <= {max_len} THEN {state('a_.first', 'a_.len + l_ + 2', 'a_.some', 'a_.starts')} "
             f"WHEN a_.len < {min_len} AND a_.some THEN {state('a_.i', 'l_', 'a_.some', 'a_.starts')} "
             f"ELSE {state('a_.i', 'l_', 'true', 'concat(a_.starts, array(a_.first))')} END")
    none = "cast(array() AS array<int>)"
    block = (f"aggregate(slice({lengths}, b_ * {FOLD_BLOCK} + 1, {FOLD_BLOCK}), "
             f"named_struct('i', o_.i, 'first', o_.first, 'len', o_.len, 'some', o_.some, 'starts', {none}), {merge}, "
             f"r_ -> named_struct('i', r_.i, 'first', r_.first, 'len', r_.len, 'some', r_.some, 'starts', concat(o_.starts, r_.starts)))")
    last = (f"e_ -> if(e_.first < 0 OR (e_.len < {min_len} AND e_.some), e_.starts, concat(e_.starts, array(e_.first)))")
    start = f"named_struct('i', 0, 'first', -1, 'len', 0, 'some', false, 'starts', {none})"
    return (f"if(size({lengths}) = 0, {none}, aggregate(sequence(0, (size({lengths}) - 1) DIV {FOLD_BLOCK}), {start}, "
            f"(o_, b_) -> {block}, {last}))")


def segments_sql(paras: str, min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN) -> str:
    """G1 on an ``array<string>`` of stripped, non-blank paragraphs, as SQL text; ``paras`` is evaluated once."""
    pieces = (f"transform(s_, (x_, j_) -> array_join(slice(p_, x_ + 1, coalesce(get(s_, j_ + 1), size(p_)) - x_), "
              f"{sql_literal(K.SEGMENT_JOINER)}))")
    starts = let_sql("l_s", "transform(p_, q_ -> length(q_))", fold_starts_sql("l_s", min_len, max_len))
    return let_sql("p_", paras, let_sql("s_", starts, pieces))


def paragraphs_sql(text: str, delim: str) -> str:
    """T4 of the column ``text`` as SQL text (split, strip every piece, drop blank pieces); null gives none."""
    ws = sql_literal(K.WS)
    return (f"filter(transform(split(coalesce(`{text}`, ''), {sql_literal(delim)}, -1), x_ -> trim(BOTH {ws} FROM x_)), "
            f"x_ -> length(x_) > 0)")


def with_segments(df: DataFrame, text: str, out: str = "segments",
                  min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN,
                  delim: str = K.PARAGRAPH_DELIM) -> DataFrame:
    """Adds G1 segments of the column ``text`` as ``out: array<string>``; one
    expression in which the paragraphs are split once."""
    cols = [c for c in df.columns if c != out]
    return df.select(*cols, F.expr(segments_sql(paragraphs_sql(text, delim), min_len, max_len)).alias(out))


def explode_segments(df: DataFrame, cols: list[str], arr: str = "segments",
                     out: str = "content") -> DataFrame:
    """One row per segment with a 1-based ``seg_no``.

    ``posexplode_outer`` + a filter above it, not ``posexplode``: for the inner
    generator Catalyst infers ``size(arr) > 0`` and pushes it below the
    projections, which inlines a second copy of the whole fold into the filter.
    """
    exploded = df.select(*cols, F.posexplode_outer(arr).alias("_pos", out))
    return exploded.filter(F.col("_pos").isNotNull()).select(
        *cols, (F.col("_pos") + 1).cast("bigint").alias("seg_no"), out)


def segment(df: DataFrame, text: str = "text", keys: list[str] | None = None,
            min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN,
            delim: str = K.PARAGRAPH_DELIM, extra: list[str] | None = None) -> DataFrame:
    """G1 as rows: ``(keys..., extra..., seg_no, content)``, ``seg_no`` 1-based.

    Narrow: every document is folded inside its own scan partition and the
    ``posexplode`` keeps the order of the segments as an explicit column.
    """
    cols = [*(keys or ["doc_id"]), *(extra or [])]
    segs = with_segments(df.select(*cols, text), text, "segments", min_len, max_len, delim).drop(text)
    return explode_segments(segs, cols, "segments", "content")


def segment_table(df: DataFrame, text: str = "text", key: str = "doc_id", clean: bool = True,
                  min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN,
                  delim: str = K.PARAGRAPH_DELIM) -> DataFrame:
    """File key, 1-based segment number, character count, content.

    ``n_chars`` is the length of the segment as built, ``content`` the stripped
    segment (equal for segments built from stripped paragraphs).
    """
    src = df.select(key, (clean_text(text) if clean else F.col(text)).alias("_text"))
    rows = segment(src, "_text", [key], min_len, max_len, delim)
    return rows.select(
        key, "seg_no",
        F.length("content").cast("bigint").alias("n_chars"),
        strip_ws("content").alias("content"),
    )


def _mark_offsets(seg: Column, m: Column, r: Column, mark: str):
    """Nearest occurrence of ``mark`` after (forward) and before (backward) the
    middle, as 1-based positions inside the search windows (0 = none)."""
    fwd = F.instr(F.substring(seg, m + 1, r), mark)                 # offsets 0..r-1 after m
    bwd = F.instr(F.reverse(F.substring(seg, m - r + 2, r)), mark)  # offsets 0..r-1 before m
    return fwd, bwd


def _mark_split(fwd: Column, bwd: Column, m: Column) -> Column:
    """Split point for one mark, or null; forward wins ties."""
    return (F.when((fwd > 0) & ((bwd == 0) | (fwd <= bwd)), m + fwd)
            .when(bwd > 0, m - bwd + 2))


def with_split_point(df: DataFrame, col: str = "content", marks: list[str] | None = None,
                     out: str = "_split") -> DataFrame:
    """Adds the G4 split position (characters in the first part) as ``out``.

    n = length, m = n // 2, r = n // 4.  For each mark in order, offsets 0..r-1
    are tried forward (m + o) then backward (m - o); the first mark with any hit
    wins, at its nearest offset (forward on ties); no hit -> split at m.  A hit
    at position p splits after p.  Staged projections keep every ``instr``
    computed once and the generated code small.
    """
    marks = K.SPLIT_MARKS if marks is None else marks
    seg = F.col(col)
    base = df.select("*", F.floor(F.length(seg) / 2).cast("int").alias("_m"),
                     F.floor(F.length(seg) / 4).cast("int").alias("_r"))
    m, r = F.col("_m"), F.col("_r")
    offsets = []
    for i, mk in enumerate(marks):
        fwd, bwd = _mark_offsets(seg, m, r, mk)
        offsets += [fwd.alias(f"_f{i}"), bwd.alias(f"_b{i}")]
    staged = base.select("*", *offsets)
    point = F.coalesce(*[_mark_split(F.col(f"_f{i}"), F.col(f"_b{i}"), m) for i in range(len(marks))], m)
    tmp = ["_m", "_r", *[f"_f{i}" for i in range(len(marks))], *[f"_b{i}" for i in range(len(marks))]]
    return staged.select("*", point.alias(out)).drop(*tmp)


def split_continuation(df: DataFrame, col: str = "content", marks: list[str] | None = None,
                       min_segment: int = K.CONTINUATION_MIN_SEGMENT,
                       min_part: int = K.CONTINUATION_MIN_PART) -> DataFrame:
    """Split each segment near its middle at punctuation (rules in
    :func:`with_split_point`).  Both halves are stripped; segments shorter
    than ``min_segment`` and splits with a half shorter than ``min_part`` are
    dropped.  Adds ``first_part`` and ``second_part``.
    """
    seg = F.col(col)
    pointed = with_split_point(df.filter(F.length(seg) >= min_segment), col, marks)
    parts = pointed.select(
        "*",
        strip_ws(F.substring(seg, F.lit(1), F.col("_split"))).alias("_first"),
        strip_ws(F.substring(seg, F.col("_split") + 1, F.length(seg))).alias("_second"),
    ).drop("_split")
    keep = (F.length("_first") >= min_part) & (F.length("_second") >= min_part)
    return keep_rows(parts, keep, {"first_part": "_first", "second_part": "_second"})


def keep_rows(df: DataFrame, keep: Column, rename: dict[str, str]) -> DataFrame:
    """Drop rows where ``keep`` is false WITHOUT a filter on computed columns.

    A filter on a derived column is pushed below the projections and inlines
    the whole derivation a second time; a filter above an ``explode_outer``
    generator cannot move below it, so the derivation runs once.
    """
    base = [c for c in df.columns if c not in rename.values()]
    packed = F.when(keep, F.array(F.struct(*[F.col(v).alias(k) for k, v in rename.items()])))
    ex = df.select(*base, F.explode_outer(packed).alias("_kept"))
    return ex.filter(F.col("_kept").isNotNull()).select(*base, *[F.col(f"_kept.{k}").alias(k) for k in rename])
