"""Large files by byte ranges: decoding, lines, blocks and delimited records of one file in many tasks.

A range is a row (file, number, first byte, end).  Tasks open the file and read their range, so a file of any size is
spread over as many tasks as it has ranges, and no task holds more than a range and the record that crosses its end.
What a range needs to know about the bytes before it goes through a small table of a row per range:

* **decoding**: for each encoding, the number of bytes of a character that stand before the range's start maps to the
  number that stand before its end, or to an error.  The maps of a file's ranges, applied in order from nothing
  pending, tell whether the encoding decodes the whole file, and where in a character each range begins;
* **delimited records**: in the same way a state of the quoting rules (at the start of a record, inside quotes, ...) maps
  to the state at the range's end, so a line break inside a quoted cell never passes for the end of a record.

Lines and blocks need no state: their ends are the same bytes in every encoding that is tried.  A record belongs to the
range in which it begins.  Row numbers are places in a range plus the rows of the file's ranges before it.
"""

from __future__ import annotations

import codecs
import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.session import ship_package
from corpusflow.store import open_store

#: Bytes of a range, and of one read beyond its end.
RANGE_BYTES, STEP = 32 << 20, 1 << 20
#: Most tasks that ranges are dealt to.
MOST_TASKS = 20_000
RANGES = "file_path string, range_no bigint, first bigint, stop bigint, file_size bigint"


def file_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """The byte ranges (``RANGES``) of ``files(file_path, file_size)``, each its own task up to ``MOST_TASKS``."""
    ship_package(files.sparkSession)
    last = F.greatest(F.ceil(F.col("file_size") / size) - 1, F.lit(0)).cast("bigint")
    rows = files.select("file_path", "file_size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("range_no")).select(
        "file_path", "range_no", (F.col("range_no") * size).alias("first"), F.least((F.col("range_no") + 1) * size, "file_size").alias("stop"), "file_size")
    tasks = files.agg(F.sum(last + 1)).first()[0] or 1
    return rows.repartition(int(min(tasks, MOST_TASKS)))


class _File:
    """Reads of an open file by place."""

    def __init__(self, path: str, size: int):
        store, at = open_store(path)
        self.f, self.size = store.open_input_file(at), size

    def read(self, a: int, b: int) -> bytes:
        return self.f.read_at(max(0, min(b, self.size) - a), a) if a < min(b, self.size) else b""

    def close(self):
        self.f.close()


def _over_files(run):
    """A batch function from one over rows: calls ``run(file, row)`` per row with its open file, and makes batches of the tuples it gives."""

    def batches(source: Iterator[pa.RecordBatch], schema: pa.Schema, most: int = 10_000, most_chars: int = 16 << 20) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

        for b in source:
            for row in b.to_pylist():
                f = _File(row["file_path"], row["file_size"])
                try:
                    for out in run(f, row):
                        held.append(out)
                        size += sum(len(x) for x in out if isinstance(x, str))
                        if len(held) >= most or size >= most_chars:
                            yield batch()
                            held, size = [], 0
                finally:
                    f.close()
        if held:
            yield batch()
    return batches


# --- decoding --------------------------------------------------------------------------

#: Most bytes of a character that can stand before a range.
_BEFORE = 3


def _pending(data: bytes, encoding: str) -> int:
    """Bytes of an unfinished character at the end of ``data``; -1 if it doesn't decode."""
    decoder = codecs.getincrementaldecoder(encoding)()
    try:
        decoder.decode(data)
    except UnicodeDecodeError:
        return -1
    return len(decoder.getstate()[0])


def decoding_map(before: bytes, data: bytes, encoding: str) -> list[int]:
    """For 0 to 3 bytes of a character that stand before the range: how many stand before its end, or -1.

    After the first line break every beginning is at a character, so the rest is decoded once.
    """
    cut = data.find(b"\n") + 1
    rest = _pending(data[cut:], encoding) if cut else None
    out = []
    for k in range(_BEFORE + 1):
        if k > len(before):
            out.append(-1)
            continue
        head = _pending(before[len(before) - k:] + (data[:cut] if cut else data), encoding)
        out.append(head if not cut or head < 0 else -1 if head else rest)
    return out


def _known(encodings: list[str]) -> list[str]:
    out = []
    for e in encodings:
        try:
            codecs.lookup(e)
        except LookupError:
            continue
        # a mark at the start is removed after decoding, whatever the encoding
        out.append((e, "utf-8" if e.replace("_", "-").lower() == "utf-8-sig" else e))
    return out


def file_encodings(ranges: DataFrame, encodings: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S6 over ranges: per file ``encoding_used`` (the first that decodes all of it, or null), and per range the bytes
    ``pending`` before it under that encoding.  No task holds a file."""
    names = _known(K.ENCODINGS if encodings is None else encodings)
    schema = "file_path string, range_no bigint, maps array<array<int>>"
    arrow = pa.schema([("file_path", pa.string()), ("range_no", pa.int64()), ("maps", pa.list_(pa.list_(pa.int32())))])

    def maps(f, row):
        a = max(0, row["first"] - _BEFORE)
        data = f.read(a, row["stop"])
        before, data = data[:row["first"] - a], data[row["first"] - a:]
        yield row["file_path"], row["range_no"], [decoding_map(before, data, codec) for _, codec in names]

    run = _over_files(maps)
    rows = ranges.mapInArrow(lambda b: run(b, arrow), schema)
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(n, "file_path").sortWithinPartitions("file_path", "range_no")
    states_schema = "file_path string, range_no bigint, pending array<int>"
    states_arrow = pa.schema([("file_path", pa.string()), ("range_no", pa.int64()), ("pending", pa.list_(pa.int32()))])

    def follow(batches):
        """Per range the bytes pending before it, by encoding; after a file's last range a row -1 with those after it."""
        file, state, out = None, None, []
        for b in batches:
            for path, number, maps in zip(*[c.to_pylist() for c in b.columns]):
                if path != file:
                    if file is not None:
                        out.append((file, -1, state))
                    file, state = path, [0] * len(names)
                out.append((path, number, state))
                state = [m[s] if s >= 0 else -1 for m, s in zip(maps, state)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), states_arrow.types)], schema=states_arrow)
                out = []
        if file is not None:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([-1]), pa.array([state], states_arrow.types[2])], schema=states_arrow)

    from corpusflow.operators.infer import materialize
    states = materialize(ordered.mapInArrow(follow, states_schema))         # a row per range; both results read it
    at = F.array_position("pending", F.lit(0)).cast("int") - 1          # -1, beyond the array, if no encoding is left
    chosen = states.filter("range_no = -1").select("file_path", at.alias("_at"))
    used = F.get(F.array(*[F.lit(e) for e, _ in names]), F.col("_at")) if names else F.lit(None).cast("string")
    pending = states.filter("range_no >= 0").join(chosen, "file_path").select(
        "file_path", "range_no", F.get("pending", F.col("_at")).alias("pending"))
    return chosen.select("file_path", used.alias("encoding_used")), pending


def _codec(encoding: str) -> str:
    return "utf-8" if encoding.replace("_", "-").lower() == "utf-8-sig" else encoding


def decoded_ranges(ranges: DataFrame, encodings: list[str] | None = None) -> DataFrame:
    """The decoded text of each range, (file_path, range_no, encoding_used, text): joined in order they are the file's text without
    its byte-order mark.  A character cut by a range's end belongs to the next.  Undecodable files have one row, without text."""
    used, pending = file_encodings(ranges, encodings)
    rows = ranges.join(pending, ["file_path", "range_no"]).join(used, "file_path")
    arrow = pa.schema([("file_path", pa.string()), ("range_no", pa.int64()), ("encoding_used", pa.string()), ("text", pa.string())])

    def texts(f, row):
        if row["encoding_used"] is None:
            if row["range_no"] == 0:
                yield row["file_path"], 0, None, None
            return
        decoder = codecs.getincrementaldecoder(_codec(row["encoding_used"]))()
        text = decoder.decode(f.read(row["first"] - row["pending"], row["stop"]))
        yield row["file_path"], row["range_no"], row["encoding_used"], text.removeprefix("﻿") if row["first"] == row["pending"] else text

    run = _over_files(texts)
    return rows.mapInArrow(lambda b: run(b, arrow), "file_path string, range_no bigint, encoding_used string, text string")


# --- lines and blocks ---------------------------------------------------------------------

_RUN = {1: re.compile(rb"[\r\n]+"), 2: re.compile(rb"(?>\r\n?|\n){2,}")}


def next_start(f: _File, at: int, breaks: int) -> int:
    """The first byte from ``at`` on that follows ``breaks`` line breaks or more and isn't one; the file's start counts, its end if none."""
    if at <= 0:
        return 0
    a = at
    while a > 0 and f.read(a - 1, a) in (b"\r", b"\n"):
        a -= 1
    data, base = b"", a
    while True:
        more = f.read(base + len(data), base + len(data) + STEP)
        data += more
        for m in _RUN[breaks].finditer(data):
            if m.end() == len(data) and more:
                break                       # it may go on
            if base + m.end() >= at:
                return base + m.end()
        if not more:
            return f.size
        keep = len(data) - len(data.rstrip(b"\r\n"))
        base, data = base + len(data) - keep, data[len(data) - keep:]


def read_pieces(ranges: DataFrame, breaks: int, encodings: list[str] | None = None) -> DataFrame:
    """S2 (``breaks=1``) and S3 (2) over ranges: (file_path, row_no, content), each stripped non-blank line or block.

    Undecodable files give no rows.
    """
    from corpusflow.operators.infer import materialize
    used, _ = file_encodings(ranges, encodings)
    rows = ranges.join(used.filter("encoding_used IS NOT NULL"), "file_path")
    arrow = pa.schema([("file_path", pa.string()), ("range_no", pa.int64()), ("place", pa.int64()), ("content", pa.string())])
    ends = "\n" * breaks

    def pieces(f, row):
        a = next_start(f, row["first"], breaks)
        if a >= row["stop"]:
            return
        b = next_start(f, row["stop"], breaks)
        text = f.read(a, b).decode(_codec(row["encoding_used"]))
        text = (text.removeprefix("﻿") if a == 0 else text).replace("\r\n", "\n").replace("\r", "\n")
        place = 0
        for piece in text.split(ends):
            piece = piece.strip()
            if piece:
                yield row["file_path"], row["range_no"], place, piece
                place += 1

    run = _over_files(pieces)
    found = materialize(rows.mapInArrow(lambda b: run(b, arrow), "file_path string, range_no bigint, place bigint, content string"))
    return numbered(found).select("file_path", (F.col("before") + F.col("place") + 1).alias("row_no"), "content")


def numbered(found: DataFrame) -> DataFrame:
    """``found`` with ``before``: the rows of its file's ranges before its own (a window over rows of a range each)."""
    order = Window.partitionBy("file_path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("file_path", "range_no").agg(F.count("*").alias("_n"))
    starts = sizes.select("file_path", "range_no", F.coalesce(F.sum("_n").over(order), F.lit(0)).cast("bigint").alias("before"))
    return found.join(starts, ["file_path", "range_no"])


# --- delimited records ---------------------------------------------------------------------

#: States of the quoting rules: start of a record; after a carriage return that ended one; start of a cell; in a plain cell;
#: inside quotes; after a quote inside quotes, which ends the cell or is half of a doubled one.
START, RETURN, CELL, PLAIN, QUOTED, QUOTE = range(6)


def quote_state(text: str, state: int, sep: str, until_start: bool = False) -> int:
    """The state after ``text``; with ``until_start``, the place of the first start of a record instead (-1: none).

    As the csv module reads: a quote opens a quoted cell only at the cell's start.
    """
    at, n = 0, len(text)
    if state == RETURN and n:
        state, at = START, int(text[0] == "\n")
    if until_start and state in (START, RETURN):
        return at if at < n else -1
    opening, ending = re.compile(f'[{re.escape(sep)}\r\n]"'), re.compile(f'{re.escape(sep)}"|[\r\n]')
    while True:
        if state == QUOTED:
            at = text.find('"', at) + 1
            if not at:
                return -1 if until_start else QUOTED
            state = QUOTE
        if state == QUOTE:
            if at == n:
                return -1 if until_start else QUOTE
            state = QUOTED if text[at] == '"' else PLAIN
            at += state == QUOTED
            continue
        if state in (START, CELL) and text[at:at + 1] == '"':
            state, at = QUOTED, at + 1
            continue
        m = (ending if until_start else opening).search(text, at)
        if m and m[0][-1] != '"':
            end = m.end() + (m[0] == "\r" and text[m.end():m.end() + 1] == "\n")
            return end if end < n else -1
        if m:
            state, at = QUOTED, m.end()
            continue
        if until_start:
            return -1
        if at == n:
            return state
        return {"\n": START, "\r": RETURN, sep: CELL}.get(text[-1], PLAIN)


class _Text:
    """The decoded text of a file from some byte on, read as it is asked for."""

    def __init__(self, f: _File, encoding: str, at: int):
        self.f, self.at, self.decoder = f, at, codecs.getincrementaldecoder(_codec(encoding))()

    def to(self, stop: int) -> str:
        data = self.f.read(self.at, stop)
        self.at += len(data)
        return self.decoder.decode(data, self.at >= self.f.size)

    def lines(self, text: str) -> Iterator[str]:
        """Lines with their ends, from ``text`` and then from the rest of the file; no line is cut between \\r and \\n."""
        whole = re.compile("[^\r\n]*(?:\r\n|\n|\r(?=[^\n]))")
        while True:
            at = 0
            for m in whole.finditer(text):
                yield m[0]
                at = m.end()
            text = text[at:]
            if self.at >= self.f.size:
                if text:
                    yield text
                return
            text += self.to(self.at + STEP)


def _header(f: _File, encoding: str, seps: list[str]) -> tuple[str, list[str] | None]:
    """Separator and cells of the header: the first record with a cell that isn't empty."""
    text = _Text(f, encoding, 0)
    first = text.to(STEP).removeprefix("﻿")
    line = next(text.lines(first), "").rstrip("\r\n")
    sep = next((s for s in seps if s in line), ",")
    text = _Text(f, encoding, 0)
    first = text.to(STEP).removeprefix("﻿")
    return sep, next((cells for cells in csv.reader(text.lines(first), delimiter=sep) if any(cells)), None)


def delimited_records(ranges: DataFrame, header_names, seps: list[str] | None = None, encodings: list[str] | None = None) -> DataFrame:
    """S5 over ranges: (file_path, row_no, cells) as ``corpus.delimited_cells`` gives them, a file's records from many tasks.

    ``header_names`` makes column names of a header's cells, and of how many more cells a record has.
    """
    from corpusflow.operators.infer import materialize
    csv.field_size_limit(1 << 31)
    seps = K.CSV_SEPARATORS if seps is None else seps
    used, pending = file_encodings(ranges, encodings)
    known = ranges.join(used.filter("encoding_used IS NOT NULL"), "file_path").join(pending, ["file_path", "range_no"])

    def heads(f, row):
        csv.field_size_limit(1 << 31)
        sep, cells = _header(f, row["encoding_used"], seps)
        yield row["file_path"], sep, cells

    run_heads = _over_files(heads)
    heads_arrow = pa.schema([("file_path", pa.string()), ("sep", pa.string()), ("header", pa.list_(pa.string()))])
    head = materialize(known.filter("range_no = 0").mapInArrow(lambda b: run_heads(b, heads_arrow), "file_path string, sep string, header array<string>"))
    known = known.join(head.filter("header IS NOT NULL"), "file_path")

    def own_text(f, row):
        text = _Text(f, row["encoding_used"], row["first"] - row["pending"])
        data = text.f.read(text.at, row["stop"])
        text.at += len(data)
        own = text.decoder.decode(data, text.at >= f.size)
        return text, own.removeprefix("﻿") if row["first"] == row["pending"] else own

    def states(f, row):
        _, own = own_text(f, row)
        yield row["file_path"], row["range_no"], [quote_state(own, s, row["sep"]) for s in range(6)]

    run_states = _over_files(states)
    states_arrow = pa.schema([("file_path", pa.string()), ("range_no", pa.int64()), ("maps", pa.list_(pa.int32()))])
    mapped = known.mapInArrow(lambda b: run_states(b, states_arrow), "file_path string, range_no bigint, maps array<int>")
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = mapped.repartition(n, "file_path").sortWithinPartitions("file_path", "range_no")
    entry_arrow = pa.schema([("file_path", pa.string()), ("range_no", pa.int64()), ("entry", pa.int32())])

    def follow(batches):
        file, state = None, START
        for b in batches:
            out = []
            for path, number, maps in zip(*[c.to_pylist() for c in b.columns]):
                if path != file:
                    file, state = path, START
                out.append((path, number, state))
                state = maps[state]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), entry_arrow.types)], schema=entry_arrow)

    entries = ordered.mapInArrow(follow, "file_path string, range_no bigint, entry int")
    rows_arrow = pa.schema([("file_path", pa.string()), ("range_no", pa.int64()), ("place", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])

    def records(f, row):
        csv.field_size_limit(1 << 31)
        text, own = own_text(f, row)
        begin = quote_state(own, row["entry"], row["sep"], until_start=True)
        if begin < 0:
            return
        taken, size, names = 0, len(own) - begin, header_names(row["header"], 0)

        def fed():
            nonlocal taken
            for line in text.lines(own[begin:]):
                taken += len(line)
                yield line

        place = 0
        reader = csv.reader(fed(), delimiter=row["sep"])
        while taken < size:         # the next record begins in this range
            cells = next(reader, None)
            if cells is None:
                return
            if any(cells):
                if len(cells) > len(names):
                    names = header_names(row["header"], len(cells) - len(row["header"]))
                yield row["file_path"], row["range_no"], place, [(k, v or None) for k, v in zip(names, cells)]
                place += 1

    run_records = _over_files(records)
    found = materialize(known.join(entries, ["file_path", "range_no"]).mapInArrow(
        lambda b: run_records(b, rows_arrow), "file_path string, range_no bigint, place bigint, cells map<string,string>"))
    rows = numbered(found).select("file_path", (F.col("before") + F.col("place")).alias("row_no"), "cells").filter("row_no > 0")
    top_arrow = pa.schema([("file_path", pa.string()), ("row_no", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])

    def named(batches):
        for b in batches:
            made = [(path, 0, [(k, None) for k in header_names(header, 0)]) for path, _, header in zip(*[c.to_pylist() for c in b.columns]) if header]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), top_arrow.types)], schema=top_arrow)

    return rows.unionByName(head.mapInArrow(named, "file_path string, row_no bigint, cells map<string,string>"))
