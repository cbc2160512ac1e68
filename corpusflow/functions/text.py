"""Scalar text functions (Column -> Column), all native Spark expressions.

Lengths are code points (Spark ``length``), stripping uses the exact set of
characters Python's ``str.strip()`` removes, and every function keeps null
as null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``."""
    return F.trim(_col(c), F.lit(K.WS))


def collapse_blanks(c) -> Column:
    """Runs of spaces and tabs become one space."""
    return F.regexp_replace(_col(c), r"[ \t]+", " ")


def clean_text(c) -> Column:
    """Collapse blanks, strip every line, keep at most two consecutive empty
    lines, drop leading and trailing empty lines.

    After the lines are stripped an empty line contributes nothing between its
    newlines, so "at most two empty lines" is "at most three newlines in a row"
    and leading/trailing empty lines are leading/trailing newlines.
    """
    lines = F.split(collapse_blanks(c), "\n", -1)
    joined = F.array_join(F.transform(lines, lambda x: F.trim(x, F.lit(K.WS))), "\n")
    capped = F.regexp_replace(joined, "\n{4,}", "\n\n\n")
    return F.trim(capped, F.lit("\n"))


def split_paragraphs(c, delim: str = K.PARAGRAPH_DELIM) -> Column:
    """T4: split on a regular expression, strip each piece, drop blank pieces."""
    parts = F.transform(F.split(_col(c), delim, -1), lambda x: F.trim(x, F.lit(K.WS)))
    return F.filter(parts, lambda x: F.length(x) > 0)


def is_blank(c) -> Column:
    """T5: true when the value is null or only whitespace (null counts as blank)."""
    return F.length(F.coalesce(strip_ws(c), F.lit(""))) == 0


def truncate_input(c, limit: int = K.PROCESSOR_INPUT_CAP,
                   marker: str = K.PROCESSOR_TRUNCATION_MARKER) -> Column:
    """Longer than ``limit`` -> first ``limit`` characters + ``marker``."""
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)


def excerpt(c, n: int, dots: bool = True) -> Column:
    """First ``n`` characters, plus ``...`` when the value was longer."""
    c = _col(c)
    if not dots:
        return F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def char_count(c) -> Column:
    """Code-point length as bigint."""
    return F.length(_col(c)).cast("bigint")


def max_output_tokens(text, requested=None) -> Column:
    """Requested null or above 4096 -> max(min(len(text), 2048), 256); then
    capped at 2048."""
    n = F.length(_col(text)).cast("bigint")
    estimated = F.greatest(F.least(n, F.lit(K.MAX_TOKENS_CAP)), F.lit(K.MAX_TOKENS_FLOOR))
    req = F.lit(None).cast("bigint") if requested is None else (
        F.lit(requested).cast("bigint") if isinstance(requested, int) else _col(requested).cast("bigint"))
    chosen = F.when(req.isNull() | (req > K.MAX_TOKENS_CEILING), estimated).otherwise(req)
    return F.least(chosen, F.lit(K.MAX_TOKENS_CAP)).cast("bigint")


def nonblank_or(c, fallback: str) -> Column:
    """``c.strip() or fallback`` for a Column ``c``."""
    s = strip_ws(c)
    return F.when(F.length(F.coalesce(s, F.lit(""))) > 0, s).otherwise(F.lit(fallback))


def py_strip_or(value: str | None, fallback: str) -> str:
    """Driver-side twin of :func:`nonblank_or` for scalar options."""
    return (value or "").strip() or fallback
