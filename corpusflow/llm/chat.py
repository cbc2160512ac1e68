"""Chat formatting: a role automaton and a declarative template.

``format_conversations`` turns rows by turn into text segments with a loss
flag each; the segments of a conversation, joined in ``seg_no`` order, are
its formatted text.  ``read_back`` parses that text again: marks are found,
escapes undone, and roles, texts and the loss mask come out as they went in.

The conversation streams through its task turn by turn, in order, so memory
is bounded by one turn however long a conversation is.

Control strings inside a text or a role name are escaped reversibly: ESC is
doubled, and the first character of a control string is followed by one ESC.

Defined results: null text and null role count as empty; turns are ordered by
(turn, role, text), nulls first, and repeated rows stay repeated turns; rows
with a null conv_id form one conversation; an empty table gives no rows;
extra columns are ignored.  A conversation that breaks the turn order is
still formatted; each of its segments carries ``in_order`` false from the
offending turn on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ESC = "\x1b"


@dataclass(frozen=True)
class Template:
    """Marks by role, roles under the loss, and the turn-order automaton.

    ``marks`` maps a role to its opening and closing mark.  Other roles use
    ``other``: its opening mark is followed by the escaped role name and
    ``other_end``.  ``moves`` maps a state and a role to the next state; a
    missing entry is a breach of the order.
    """

    begin: str = "<s>"
    marks: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")})
    other: tuple = ("[ROLE]", "[/ROLE]", "[END]")
    pad: str = " "
    loss_roles: tuple = ("assistant",)
    start: str = "start"
    moves: dict = field(default_factory=lambda: {
        ("start", "system"): "instructed", ("start", "user"): "asked", ("instructed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: tuple = ("answered",)

    def controls(self) -> list[str]:
        found = [self.begin, *[m for pair in self.marks.values() for m in pair], *self.other]
        if len(set(found)) != len(found) or any(len(x) < 2 or ESC in x for x in found):
            raise ValueError("control strings must be distinct, of two characters or more, without ESC")
        for a in found:
            for b in found:
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(a == b, len(a))):
                    raise ValueError(f"control strings {a!r} and {b!r} overlap")
        return found


class Marker:
    """Escaping, formatting and parsing under one template."""

    def __init__(self, template: Template):
        self.t = template
        controls = template.controls()
        alternatives = "|".join(map(re.escape, sorted(controls, key=len, reverse=True)))
        self._unsafe = re.compile(f"{ESC}|{alternatives}")
        self._escaped = re.compile(f"{ESC}({ESC}?)")
        self._control = re.compile(alternatives)
        self.close = {c: role for role, (_, c) in template.marks.items()}
        self.open = {o: role for role, (o, _) in template.marks.items()}

    def escape(self, s: str) -> str:
        return self._unsafe.sub(lambda m: m[0][0] + ESC + m[0][1:], s)

    def unescape(self, s: str) -> str:
        return self._escaped.sub(r"\1", s)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of one turn: opening, body, closing."""
        pad = self.t.pad
        if role in self.t.marks:
            before, after = self.t.marks[role]
        else:
            before, after = self.t.other[0] + self.escape(role) + self.t.other[1], self.t.other[2]
        return [(before + pad, False), (self.escape(text), role in self.t.loss_roles), (pad + after, False)]

    def parse(self, pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the loss mask) of each turn of one formatted conversation.

        Looks only at the characters and their loss flags; the cuts between
        the pieces mean nothing to it.
        """
        buffer, flags = "", []          # flags: (length, loss) runs over the buffer
        begun, pad = False, len(self.t.pad)
        for text, loss in pieces:
            buffer += text
            flags.append((len(text), loss))
            if not begun:
                if len(buffer) < len(self.t.begin):
                    continue
                if not buffer.startswith(self.t.begin):
                    raise ValueError("no begin mark")
                buffer, flags, begun = self._drop(buffer, flags, len(self.t.begin))
                begun = True
            if loss:
                continue   # no turn ends inside a body
            while True:
                marks = list(self._turn_marks(buffer))
                if not marks:
                    break
                role, a, b, end = marks[0]
                body = buffer[a + pad:b - pad]
                masked, at = [], 0
                for n, under in flags:
                    if under:
                        masked.append(buffer[at:min(at + n, end)])
                    at += n
                    if at >= end:
                        break
                yield role, self.unescape(body), self.unescape("".join(masked))
                buffer, flags, _ = self._drop(buffer, flags, end)
        if buffer:
            raise ValueError("the formatted text ends inside a turn")

    def _turn_marks(self, s: str):
        """(role, body start, body end, turn end) of the first whole turn in ``s``, if there is one."""
        first = self._control.match(s)
        if not first:
            if len(s) > 64:
                raise ValueError("a turn has to begin with a mark")
            return
        if first[0] == self.t.other[0]:
            named = self._control.search(s, first.end())
            if not named:
                return
            role, a, want = self.unescape(s[first.end():named.start()]), named.end(), self.t.other[2]
        else:
            role, a = self.open[first[0]], first.end()
            want = self.t.marks[role][1]
        last = self._control.search(s, a)
        if last:
            if last[0] != want:
                raise ValueError(f"{last[0]!r} inside a turn of {role!r}")
            yield role, a, last.start(), last.end()

    @staticmethod
    def _drop(buffer: str, flags: list, n: int):
        left, out = n, []
        for k, loss in flags:
            cut = min(k, left)
            left -= cut
            if k - cut:
                out.append((k - cut, loss))
        return buffer[n:], out, False


SEGMENTS = "conv_id long, seg_no long, role string, segment string, loss boolean, in_order boolean"
_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("seg_no", pa.int64()), ("role", pa.string()), ("segment", pa.string()),
                       ("loss", pa.bool_()), ("in_order", pa.bool_())])
#: Rows and characters of an output batch.
BATCH_ROWS, BATCH_CHARS = 5_000, 4_000_000


def _batched(rows: Iterator[tuple], schema: pa.Schema, chars) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += chars(r)
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def format_conversations(df: DataFrame, template: Template | None = None, partitions: int | None = None) -> DataFrame:
    """Segments (see ``SEGMENTS``) of every conversation of ``df(conv_id, turn, role, text)``.

    One shuffle on conv_id; each partition is sorted on disk and streamed.
    """
    template = template or Template()
    template.controls()
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                      F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches):
        marker = Marker(template)

        def segments():
            now, state, seg, good = object(), template.start, 0, True
            for b in batches:
                for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    if conv != now:
                        now, state, seg, good = conv, template.start, 0, True
                        yield conv, 0, None, template.begin, False, True
                    state = template.moves.get((state, role)) if good else None
                    good = state is not None
                    for s, loss in marker.turn(role, text):
                        seg += 1
                        yield conv, seg, role, s, loss, good
        return _batched(segments(), _SEGMENTS, lambda r: len(r[3]))

    return rows.mapInArrow(run, SEGMENTS)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("in_order", pa.bool_())])


def conversation_digests(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, digests of what parsing its formatted text gives back.

    ``segments`` comes straight from :func:`format_conversations`: a
    conversation's rows follow each other in one partition, in order.
    """
    template = template or Template()

    def run(batches):
        marker = Marker(template)

        def rows():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist())

        def digests():
            source = rows()
            ahead = next(source, None)
            while ahead is not None:
                conv, size, good = ahead[0], 0, True

                def pieces():
                    nonlocal ahead, size, good
                    while ahead is not None and ahead[0] == conv:
                        _, s, loss, good = ahead
                        size += len(s)
                        yield s, loss
                        ahead = next(source, None)

                turns, under, n, chars = hashlib.sha256(), hashlib.sha256(), 0, 0
                for role, text, masked in marker.parse(pieces()):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    under.update(masked.encode("utf-8", "surrogatepass"))
                    chars += len(masked)
                yield conv, n, turns.hexdigest(), chars, under.hexdigest(), size, good
        return _batched(digests(), _DIGESTS, lambda r: 0)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                    "formatted_chars long, in_order boolean")
