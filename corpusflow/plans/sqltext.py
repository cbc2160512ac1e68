"""Helpers that write DuckDB SQL literals for the oracle queries."""

from __future__ import annotations

from corpusflow import constants as K


def lit(s: str) -> str:
    """A DuckDB string expression equal to ``s`` (control characters via chr)."""
    parts: list[str] = []
    buf = ""
    for ch in s:
        if ord(ch) < 32 or ord(ch) in (0x85, 0x2028, 0x2029):
            if buf:
                parts.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append("'" + buf.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")" if len(parts) > 1 else parts[0]


WS = "(" + " || ".join(f"chr({ord(c)})" for c in K.WS) + ")"
NL = "chr(10)"
JOIN = f"({NL} || {NL})"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def blank(x: str) -> str:
    return f"(length(coalesce({strip(x)}, '')) = 0)"


def nonblank_or(x: str, fallback: str) -> str:
    return f"(CASE WHEN length(coalesce({strip(x)}, '')) > 0 THEN {strip(x)} ELSE {lit(fallback)} END)"


def excerpt(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || '...' ELSE {x} END)"


def truncate(x: str, n: int, marker: str) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN substr({x}, 1, {n}) || {lit(marker)} ELSE {x} END)"


def paragraphs(text: str, delim: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({text}, '{delim}'), "
            f"lambda q: {strip('q')}), lambda q: length(q) > 0)")


def clean(text: str) -> str:
    collapsed = f"regexp_replace({text}, '[ \\t]+', ' ', 'g')"
    lines = f"list_transform(string_split({collapsed}, {NL}), lambda q: {strip('q')})"
    joined = f"array_to_string({lines}, {NL})"
    capped = f"regexp_replace({joined}, '\\n{{4,}}', {NL} || {NL} || {NL}, 'g')"
    return f"trim({capped}, {NL})"


def _close(out: str, cur: str, min_len: int) -> str:
    return (f"CASE WHEN length({cur}) < {min_len} AND len({out}) > 0 "
            f"THEN list_append(list_slice({out}, 1, len({out}) - 1), {out}[len({out})] || {JOIN} || {cur}) "
            f"ELSE list_append({out}, {cur}) END")


def segments(paras: str, min_len: int = K.DEFAULT_MIN_LEN, max_len: int = K.DEFAULT_MAX_LEN) -> str:
    """The segmentation fold as one ``list_reduce`` over ``{cur, out}``."""
    step = (f"lambda acc, q: CASE WHEN acc.cur = '' THEN {{'cur': q, 'out': acc.out}} "
            f"WHEN length(acc.cur) + length(q) + 2 <= {max_len} THEN {{'cur': acc.cur || {JOIN} || q, 'out': acc.out}} "
            f"ELSE {{'cur': q, 'out': {_close('acc.out', 'acc.cur', min_len)}}} END")
    state = f"list_reduce({paras}, {step}, {{'cur': '', 'out': []::VARCHAR[]}})"
    return state


def finish_segments(state: str, min_len: int = K.DEFAULT_MIN_LEN) -> str:
    return (f"CASE WHEN {state}.cur = '' THEN {state}.out "
            f"ELSE {_close(state + '.out', state + '.cur', min_len)} END")


def split_point(seg: str, marks: list[str]) -> str:
    """Continuation split point; the backward search uses a greedy regex for the
    last occurrence (DuckDB's reverse works on grapheme clusters)."""
    n = f"length({seg})"
    m = f"({n} // 2)"
    r = f"({n} // 4)"
    outs = []
    for mk in marks:
        fwin = f"substr({seg}, {m} + 1, {r})"
        bwin = f"substr({seg}, {m} - {r} + 2, {r})"
        fwd = f"instr({fwin}, {lit(mk)})"
        esc = "\\n" if mk == "\n" else ("\\" + mk if mk in ".!?*+()[]{}|^$\\" else mk)
        last = f"(length(regexp_extract({bwin}, '(?s)^(.*){esc}', 1)) + 1)"
        has_b = f"regexp_matches({bwin}, '{esc}')"
        bwd = f"(CASE WHEN {has_b} THEN {r} - {last} + 1 ELSE 0 END)"
        outs.append(f"(CASE WHEN {fwd} > 0 AND ({bwd} = 0 OR {fwd} <= {bwd}) THEN {m} + {fwd} "
                    f"WHEN {bwd} > 0 THEN {m} - {bwd} + 2 END)")
    return "coalesce(" + ", ".join(outs + [m]) + ")"
