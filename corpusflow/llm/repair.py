"""Conversation structure repair by depth-first branch and bound.

A conversation is repaired when its roles' initials read ``(s?(ua)+)?``.  Edits: keep a row (0), give it the role
user or assistant (2), delete it (3, and required for a blank or duplicate row), insert an empty user or assistant
turn anywhere (2); a truncated row that stays adds 1.  Of the cheapest ways, the one whose ``audit`` (the edits'
initials K, R, D, I in order) is least in ASCII is taken.

:func:`cheapest` searches depth first on an explicit stack.  A node is (rows done, state of the role automaton).
A suffix bound, the least cost of what remains from each state whatever its audit, orders the branches and prunes
those over the incumbent's cost; at equal cost a prefix that is ASCII-greater than the incumbent's is pruned, and a
table per node drops prefixes that reach it dearer, or as dear and ASCII-greater.  The search ends when the stack
is empty: nothing left can beat the incumbent.

Work is spread by conversation in two streamed steps: the first sees a row as its role and fault (a byte), the second
applies the audit to the texts, one row in memory at a time.  Duplicates are found by an aggregate over digests
before.  A conversation is one task in each, as its repair and its digest run over all its rows in order.

Defined results: a null role or text is one space; rows of a null conv_id are one conversation; rows are ordered by
turn, nulls first, then by role and the SHA-256 of role and text, so equal rows are adjacent; a role's initial is its
first character, and an empty role has none: keeping it doesn't move the automaton.  An empty table gives no
rows; extra columns are ignored; turns and conv_ids are read as longs.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Costs of the edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: The blanks of a text, and the characters that end one.
_BLANKS = " \t\n\x0b\f\r"

#: Automaton: nothing yet, after s, after u, after a.  What a user or assistant turn leads to, and where a text may end.
_TURN = (2, 2, 3, 2)
_ENDS = (True, False, False, True)
_BY_INITIAL = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (0, 1, 2, 3)}
_NEVER = (None, None, None, None)
#: A row as one byte: place of its initial, times 4, plus its fault (0 none, 1 truncated, 2 blank or duplicate).
_INITIALS = ["s", "u", "a", ""]
_MOVES = [_BY_INITIAL[i] for i in _INITIALS] + [_NEVER]
_FAR = 1 << 30


def row_code(initial: str, truncated: bool, must_go: bool) -> int:
    place = _INITIALS.index(initial) if initial in _INITIALS else 4
    return 4 * place + (2 if must_go else int(truncated))


def _children(code: int | None, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, rows done by it, next state, cost) in ASCII order."""
    out = []
    if code is not None:
        out.append(("D", 1, state, DELETE))
    out.append(("I", 0, _TURN[state], INSERT))
    if code is not None and code & 3 != 2:
        extra = TRUNCATED if code & 3 else 0
        kept = _MOVES[code >> 2][state]
        if kept is not None:
            out.append(("K", 1, kept, extra))
        out.append(("R", 1, _TURN[state], REROLE + extra))
    return out


#: By row code and state; None where no row is left.
_CHILDREN = {(c, s): _children(c, s) for c in [None, *range(20)] for s in range(4)}


def suffix_bounds(rows: bytes) -> list[array]:
    """For each state: the least cost of repairing the rows from each place on."""
    n = len(rows)
    bounds = [array("q", bytes(8 * (n + 1))) for _ in range(4)]
    for i in range(n, -1, -1):
        code = rows[i] if i < n else None
        here = []
        for s in range(4):
            least = 0 if code is None and _ENDS[s] else _FAR
            for _, step, to, cost in _CHILDREN[code, s]:
                if step and cost + bounds[to][i + 1] < least:
                    least = cost + bounds[to][i + 1]
            here.append(least)
        for _ in range(2):                       # inserting more than two turns between rows only comes back to a state
            here = [min(v, INSERT + here[_TURN[s]]) for s, v in enumerate(here)]
        for s in range(4):
            bounds[s][i] = here[s]
    return bounds


def cheapest(rows: bytes) -> tuple[int, str]:
    """(cost, audit) of the best repair of the rows, given as :func:`row_code` bytes."""
    n, bounds = len(rows), suffix_bounds(rows)
    best_cost, best = _FAR, []                   # the incumbent
    path, common = [], 0                         # edits so far, and how many of them the incumbent shares
    reached = {}                                 # per node: least cost of a prefix; at equal cost the ASCII-least came first
    stack = [(0, "", 0, 0, 0)]                   # (edits before, edit, rows done, state, cost)
    while stack:
        depth, edit, i, state, cost = stack.pop()
        del path[depth:]
        common = min(common, depth)
        bound = cost + bounds[state][i]
        if bound > best_cost:
            continue
        if edit:
            if bound == best_cost and common == depth and (depth >= len(best) or edit > best[depth]):
                continue
            if common == depth and depth < len(best) and edit == best[depth]:
                common += 1
            path.append(edit)
        node = 4 * i + state
        if reached.get(node, _FAR) <= cost:
            continue
        reached[node] = cost
        if i == n and _ENDS[state] and (cost < best_cost or cost == best_cost):
            best_cost, best, common = cost, path.copy(), len(path)
            continue                             # more turns could only be inserted
        after = [(cost + c + bounds[to][i + step], e, i + step, to, cost + c) for e, step, to, c in _CHILDREN[rows[i] if i < n else None, state]]
        after.sort(key=lambda x: x[:2], reverse=True)
        stack += [(len(path), e, j, to, c) for f, e, j, to, c in after if f <= best_cost]
    return best_cost, "".join(best)


def apply_audit(audit: str, rows: Iterator[tuple]) -> Iterator[tuple[str, tuple | None, str | None]]:
    """(edit, row, role it gets) in order; rows are tuples that begin with the role.  An inserted turn has no row, a deleted one no role."""
    state, rows = 0, iter(rows)
    for edit in audit:
        if edit == "I":
            state = _TURN[state]
            yield edit, None, "user" if state == 2 else "assistant"
            continue
        row = next(rows)
        if edit == "D":
            yield edit, row, None
        elif edit == "R":
            state = _TURN[state]
            yield edit, row, "user" if state == 2 else "assistant"
        else:
            state = _BY_INITIAL[row[0][:1]][state]
            yield edit, row, row[0]


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with a fault by ``crc32(conv_id:turn) % 20``; no copies: dropped."""
    fault = F.crc32(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(_filled("text"), "[.!?]", "")).otherwise(_filled("text"))
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.when(fault == 4, F.lit("user")).otherwise(_filled("role")).alias("role"), text.alias("text"),
                     F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"))


def as_found(df: DataFrame) -> DataFrame:
    """The same columns of rows that are taken as they are."""
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _filled("role").alias("role"),
                     _filled("text").alias("text"), F.lit(1).cast("long").alias("copies"))


_KEY = ["no_conv", "conv"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("conv"), "turn", "role",
                       F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).substr(1, 40).alias("d"),
                       "text", "copies")


AUDITS = ("no_conv boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
_AUDITS = pa.schema([("no_conv", pa.bool_()), ("conv", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string())])
#: Rows and bytes of an output batch.
BATCH_ROWS, BATCH_BYTES = 5_000, 4_000_000


def _batched(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[text] or "")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(conversation, its rows one by one); a conversation's rows have to be read before the next."""
    source = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    ahead = next(source, None)
    while ahead is not None:
        key = ahead[:2]

        def rows():
            nonlocal ahead
            while ahead is not None and ahead[:2] == key:
                yield ahead
                ahead = next(source, None)
        inner = rows()
        yield key, inner
        for _ in inner:
            pass


def _audit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for key, cells in _runs(batches):
            codes, last, legal = bytearray(), None, ("su", "ua", "au")
            count = {"blank": 0, "duplicate": 0, "truncated": 0}
            illegal, low, high, distinct = 0, None, None, 0
            for _, _, turn, initial, blank, cut, first, n in cells:
                if not n:
                    continue
                if turn is not None:
                    distinct += turn != high
                    low, high = turn if low is None else low, turn
                new = 0 if blank or not first else 1             # copies after the first are duplicates
                if blank:
                    count["blank"] += n
                else:
                    count["truncated"] += new and cut
                    count["duplicate"] += n - new
                codes += bytes([row_code(initial, cut, False)]) * new + bytes([row_code(initial, False, True)]) * (n - new)
                illegal += (last is not None and last + initial not in legal) + (n - 1) * (initial + initial not in legal)
                last = initial
            gaps = 0 if low is None else high - low + 1 - distinct
            yield *key, gaps, count["blank"], count["duplicate"], int(count["truncated"]), illegal, *cheapest(bytes(codes))
    return _batched(made(), _AUDITS, 8)


def audits(rows: DataFrame) -> DataFrame:
    """Faults and the best repair of every conversation (``AUDITS``); ``rows`` as :func:`damage` gives them.

    Equal rows are counted together, and the turn of the first of them found, by aggregates that combine before
    they shuffle; then only turn, initial and faults go to the conversation's task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANKS))
    cells = (_keyed(rows).withColumn("blank", trimmed == "").withColumn("cut", ~trimmed.substr(F.lit(-1), F.lit(1)).isin(".", "!", "?"))
             .groupBy(*_KEY, "turn", "role", "d", "blank", "cut").agg(F.sum("copies").alias("n")))
    first = (cells.filter("n > 0").groupBy(*_KEY, "d").agg(F.max(F.col("turn").isNull()).alias("untimed"), F.min("turn").alias("least")))
    is_first = F.coalesce(F.when(F.col("untimed"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least")), F.lit(False))
    coded = (cells.join(first, [*_KEY, "d"], "left")
             .select(*_KEY, "turn", F.col("role").substr(1, 1).alias("initial"), "blank", "cut", is_first.alias("first"), "n", "role", "d")
             .repartition(n, *_KEY).sortWithinPartitions(*_KEY, F.col("turn").asc_nulls_first(), "role", "d"))
    return coded.drop("role", "d").mapInArrow(_audit_rows, AUDITS)


def _with_texts(rows: DataFrame) -> DataFrame:
    """Per conversation, in order: its audit (kind 0), then its rows (kind 1)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = (audits(rows).withColumn("kind", F.lit(0))
            .unionByName(_keyed(rows).filter("copies > 0").withColumn("kind", F.lit(1)), allowMissingColumns=True))
    return (both.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "kind", F.col("turn").asc_nulls_first(), "role", "d")
            .select(*_KEY, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turn", "role", "text", "copies"))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator]]:
    """(audit row, the edits applied to the conversation's rows)."""
    for _, rows in _runs(batches):
        head = next(rows)
        yield head, apply_audit(head[8], (r[10:12] + (r[9],) for r in rows for _ in range(r[12])))


DIGESTS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
_DIGESTS = pa.schema([("conv_id", pa.int64()), *list(_AUDITS)[2:], ("repaired_sha256", pa.string())])


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation (``DIGESTS``); ``rows`` as :func:`damage` or :func:`as_found` give them."""

    def run(batches):
        def made():
            for head, edits in _edits(batches):
                whole, joint = hashlib.sha256(), ""
                for _, row, role in edits:
                    if role is not None:
                        whole.update(f"{joint}{role}:{row[1] if row else ''}".encode("utf-8", "surrogatepass"))
                        joint = "\n"
                yield None if head[0] else head[1], *head[2:9], whole.hexdigest()
        return _batched(made(), _DIGESTS, 7)
    return _with_texts(rows).mapInArrow(run, DIGESTS)


REPAIRED = "conv_id long, place long, edit string, turn long, role string, text string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def repaired(rows: DataFrame) -> DataFrame:
    """The rows of every repaired conversation, in order by ``place``; inserted ones have no turn and an empty text."""

    def run(batches):
        def made():
            for head, edits in _edits(batches):
                place = 0
                for edit, row, role in edits:
                    if role is not None:
                        yield None if head[0] else head[1], place, edit, row[2] if row else None, role, row[1] if row else ""
                        place += 1
        return _batched(made(), _REPAIRED, 5)
    return _with_texts(rows).mapInArrow(run, REPAIRED)
