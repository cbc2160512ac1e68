"""Corpus sources (S1-S8): discovery, decoding and the text readers.

Files are read as ``binaryFile`` rows (one row per file, content loaded only
when selected), so every reader is one distributed scan, and ``path`` has one
form everywhere.  Extensions are compared lower-cased by the listing and by the
readers alike.  UTF-8 files are decoded natively (``is_valid_utf8`` on the bytes
cast to a string); only the rest cross into Python, where the encodings are tried
in order on whole files.  Delimited files are parsed from the decoded text, each under its own header.
The readers of lines, blocks and delimited records give files of more than ``range_bytes`` to :mod:`corpusflow.sources.ranges`,
which reads one file in many tasks, if the store is one that tasks can open.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import constants as K
from corpusflow.functions.text import strip_ws
from corpusflow.session import scratch_path, ship_package
from corpusflow.sources import ranges as G
from corpusflow.sources.listing import list_files
from corpusflow.store import reachable


def _ext(path: Column) -> Column:
    """Lower-cased extension of the base name, as ``pathlib``'s ``suffix``: the
    last dot must be neither the first nor the last character of the name
    (``.txt`` and ``a.`` have none)."""
    return F.lower(F.regexp_extract(_name(path), r"^.+(\.[^.]+)$", 1))


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def wildcard_regex(pattern: str) -> str:
    """Shell wildcard (``*``, ``?``, ``[...]``) as an anchored regular expression."""
    return "^" + fnmatch.translate(pattern.strip())


# --- S1 ------------------------------------------------------------------------------

def hidden_files(spark: SparkSession, path: str) -> list[str]:
    """Files below ``path`` that Spark's readers never list: names that begin
    with ``_`` or ``.`` (writers' own ``_SUCCESS`` and checksum files aside).

    One file-system call per folder; only the hidden names come to Python.
    """
    jvm, found = spark._jvm, []
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(root).isDirectory():
        return found
    todo = [root]
    while todo:
        folder = todo.pop()
        told = jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(folder))     # one call, however many files
        for at, is_folder in re.findall(r"\{path=(.*?); isDirectory=(true|false)", told):
            name = at.rsplit("/", 1)[-1]
            if is_folder == "true":
                if name[0] not in "._":
                    todo.append(jvm.org.apache.hadoop.fs.Path(at))
            elif name[0] in "._" and name != "_SUCCESS" and not name.endswith(".crc"):
                found.append(at)
    return found


def _listed_by_readers(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, hidden) as Spark's readers list them, for stores that only they reach and for path patterns."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(False).alias("hidden")))
    hidden = hidden_files(spark, path)
    if hidden:
        from corpusflow.operators.catalog import local_table
        files = files.unionByName(local_table(spark, [(x,) for x in hidden], "path string").select(
            "path", F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("modified"), F.lit(True).alias("hidden")))
    return files


def list_corpus(spark: SparkSession, path: str, pattern: str = "",
                extensions: list[str] | None = None) -> DataFrame:
    """Every file below ``path`` (or the file ``path``) once, with ``matched``: the
    lower-cased extension is allowed and the base name matches the wildcard (blank = all).

    Columns: path, name, ext, size, modified, matched, hidden.  Only metadata is read.
    Files with hidden-style names are listed with a null size and never match.
    """
    exts = [e.lower() for e in (K.ALLOWED_EXTENSIONS if extensions is None else extensions)]
    files = list_files(spark, path) if reachable(spark, path) else None
    if files is None:
        files = _listed_by_readers(spark, path)
    name = _name(F.col("path"))
    ok = _ext(F.col("path")).isin(exts) & ~F.col("hidden")
    if pattern and pattern.strip():
        ok = ok & name.rlike(wildcard_regex(pattern))
    return files.select("path", name.alias("name"), _ext(F.col("path")).alias("ext"), "size", "modified", ok.alias("matched"), "hidden")


# --- S6, S7 ----------------------------------------------------------------------------

def _py_decode(data: bytes, encodings: list[str]) -> tuple[str | None, str | None]:
    for enc in encodings:
        try:
            return data.decode(enc), enc
        except (UnicodeDecodeError, LookupError):
            continue
    return None, None


def decode_corpus(binary: DataFrame, encodings: list[str] | None = None, content: str = "content",
                  single_pass: bool = False) -> DataFrame:
    """``text`` and ``encoding_used`` per file; the first encoding that
    decodes the WHOLE file wins.  A leading byte-order mark is removed.

    UTF-8 rows never leave the JVM; the others go through ``mapInArrow`` with
    Python codecs (GBK, Big5 ... are not decodable by Spark without a global
    legacy flag).  Undecodable files get null text.
    """
    import pyarrow as pa

    ship_package(binary.sparkSession)
    encodings = K.ENCODINGS if encodings is None else encodings
    other_cols = [c for c in binary.columns if c != content]
    s = F.col(content).cast("string")
    valid = F.is_valid_utf8(s)
    plain = [e.replace("_", "-").lower() in ("utf-8", "utf8") for e in encodings]
    if not (plain and plain[0]):
        single_pass = True      # another encoding comes first: the order holds for every file
    utf8 = binary.filter(valid).select(*other_cols, s.alias("text"), F.lit("utf-8").alias("encoding_used"))
    rest = binary.filter(~valid)
    in_schema = rest.schema
    out_schema = T.StructType([f for f in in_schema.fields if f.name != content] +
                              [T.StructField("text", T.StringType()), T.StructField("encoding_used", T.StringType())])
    # utf-8 already failed for these rows; the remaining encodings are tried in order
    tail = [e for e, u in zip(encodings, plain) if not u]

    def make_run(encs: list[str]):
        def run(batches):
            for b in batches:
                data = b.column(content).to_pylist()
                texts, used = [], []
                for d in data:
                    t, e = _py_decode(d, encs) if d is not None else (None, None)
                    texts.append(t)
                    used.append(e)
                arrays = [b.column(c) for c in other_cols]
                arrays += [pa.array(texts, pa.string()), pa.array(used, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out_schema.fields])
        return run

    if single_pass:
        decoded = binary.mapInArrow(make_run(list(encodings)), out_schema)
    else:
        decoded = utf8.unionByName(rest.mapInArrow(make_run(tail), out_schema))
    return decoded.withColumn("text", F.regexp_replace("text", "^\ufeff", ""))


def normalize_newlines(c) -> Column:
    """``\\r\\n`` and ``\\r`` become ``\\n`` (what text-mode reading does)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, "\r\n?", "\n")


def encoding_report(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("encoding_used").agg(F.count("*").cast("bigint").alias("files"))


# --- readers -----------------------------------------------------------------------------

def any_case(extension: str) -> str:
    """A glob for names with this extension in any case."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def _binary(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    # an unreadable file is skipped here and named by corpus_files()
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"), "content")


def _only(df: DataFrame, pattern: str) -> DataFrame:
    return df.filter(_name(F.col("file_path")).rlike(wildcard_regex(pattern))) if pattern and pattern.strip() else df


def _split_by_size(spark: SparkSession, path: str, glob: str | None, pattern: str, range_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The files to be read as one row each, and those to be read by ranges (None if there are none); only sizes are looked at."""
    files = _only(_binary(spark, path, glob), pattern)
    big = files.filter(F.col("file_size") > range_bytes).select("file_path", "file_size")
    if not reachable(spark, path) or big.isEmpty():
        return files, None
    return files.filter(F.col("file_size") <= range_bytes), big


TEXT, MARKDOWN, DELIMITED = any_case(".txt"), any_case(".md"), any_case(".csv")


def read_documents(spark: SparkSession, path: str, glob: str | None = TEXT,
                   encodings: list[str] | None = None, pattern: str = "") -> DataFrame:
    """One row per file (file_path, file_size, text, encoding_used);
    newlines normalised; empty or whitespace-only files and undecodable files
    are skipped (``corpus_files`` names them)."""
    return _documents(_only(_binary(spark, path, glob), pattern), encodings)


def _documents(files: DataFrame, encodings: list[str] | None) -> DataFrame:
    dec = decode_corpus(files, encodings)
    doc = dec.select("file_path", "file_size", normalize_newlines("text").alias("text"), "encoding_used")
    return doc.filter(F.length(F.coalesce(strip_ws("text"), F.lit(""))) > 0)


def read_novels(spark: SparkSession, path: str, encodings: list[str] | None = None) -> DataFrame:
    """S4 for novels: ``.txt`` and ``.text`` in any case, or the one file ``path``."""
    globs = ",".join(any_case(e)[1:] for e in K.NOVEL_EXTENSIONS)
    return read_documents(spark, path, "*{" + globs + "}", encodings)


def _pieces(df: DataFrame, delim: str, out: str = "content") -> DataFrame:
    parts = F.filter(F.transform(F.split("text", delim, -1), lambda x: strip_ws(x)), lambda x: F.length(x) > 0)
    staged = df.select("file_path", parts.alias("_p"))
    ex = staged.select("file_path", F.posexplode_outer("_p").alias("_pos", out))
    return ex.filter(F.col("_pos").isNotNull()).select(
        "file_path", (F.col("_pos") + 1).cast("bigint").alias("row_no"), out)


def _read_pieces(spark, path, glob, encodings, pattern, range_bytes, breaks: int) -> DataFrame:
    small, big = _split_by_size(spark, path, glob, pattern, range_bytes)
    rows = _pieces(_documents(small, encodings), "\n" * breaks)
    return rows if big is None else rows.unionByName(G.read_pieces(G.file_ranges(big, range_bytes), breaks, encodings))


def read_text_lines(spark: SparkSession, path: str, glob: str | None = TEXT,
                    encodings: list[str] | None = None, pattern: str = "", range_bytes: int = G.RANGE_BYTES) -> DataFrame:
    """One row per stripped non-blank line: (file_path, row_no, content).  Larger files are read by ranges, in any encoding."""
    return _read_pieces(spark, path, glob, encodings, pattern, range_bytes, 1)


def plain_path(c: Column) -> Column:
    """A path of ``_metadata`` in the form that ``binaryFile`` gives (not percent-encoded)."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def read_utf8_lines(spark: SparkSession, path: str, glob: str | None = TEXT) -> DataFrame:
    """S2 for files of any size known to be UTF-8: the result of :func:`read_text_lines`, but a
    file is split over tasks.

    A line's number is its place in its block plus the lines of the file's blocks before it:
    no task and no window holds more than a block.
    """
    from corpusflow.operators.infer import materialize
    from pyspark.sql import Window
    r = spark.read.option("recursiveFileLookup", "true")
    raw = (r.option("pathGlobFilter", glob) if glob else r).text(path)
    lines = raw.select(plain_path(F.col("_metadata.file_path")).alias("file_path"), F.col("_metadata.file_block_start").alias("_block"),
                       F.col("value"), F.monotonically_increasing_id().alias("_id"))
    # a mark is one at the file's start alone; the first block's first line has its least id
    block = ["file_path", "_block"]
    lines = materialize(lines)
    begins = F.min(F.struct("_id", F.startswith("value", F.lit("\ufeff")).alias("m"))).alias("_first")
    first = lines.filter("_block = 0").groupBy("file_path").agg(begins).filter("_first.m").select("file_path", F.col("_first._id").alias("_id"), F.lit(True).alias("_mark"))
    value = F.when(F.col("_mark"), F.substring("value", F.lit(2), F.length("value"))).otherwise(F.col("value"))
    lines = lines.join(first, ["file_path", "_id"], "left").select(*block, "_id", strip_ws(value).alias("content")).filter(F.length("content") > 0)
    before = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy(*block).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("_id"))
    return (lines.withColumn("_place", place).join(starts, block)
            .select("file_path", (F.col("_before") + F.col("_place")).cast("bigint").alias("row_no"), "content"))


def read_paragraphs(spark: SparkSession, path: str, glob: str | None = MARKDOWN, pattern: str = "", range_bytes: int = G.RANGE_BYTES) -> DataFrame:
    """S3 (Markdown): one row per stripped non-blank block between blank lines.
    Markdown is read as UTF-8 only; other files are undecodable (``corpus_files`` names them)."""
    return _read_pieces(spark, path, glob, ["utf-8"], pattern, range_bytes, len(K.MARKDOWN_DELIM))


# --- S5 ----------------------------------------------------------------------------------

def _with_separator(decoded: DataFrame, seps: list[str] | None) -> DataFrame:
    """``decoded`` plus ``sep``: the first separator that splits the header line into more than one field, else a comma."""
    seps = K.CSV_SEPARATORS if seps is None else seps
    header = F.regexp_extract(normalize_newlines("text"), r"^([^\n]*)", 1)
    choice = F.coalesce(*[F.when(F.size(F.split(header, _regex_escape(s), -1)) > 1, F.lit(s)) for s in seps], F.lit(","))
    return decoded.withColumn("sep", choice)


def choose_separators(spark: SparkSession, path: str, glob: str | None = DELIMITED,
                      seps: list[str] | None = None) -> DataFrame:
    """S5 step 1: (file_path, sep, encoding_used) per file; whole files."""
    return _with_separator(decode_corpus(_binary(spark, path, glob)), seps).select("file_path", "sep", "encoding_used")


def _regex_escape(s: str) -> str:
    return "".join("\\" + ch if ch in ".^$*+?()[]{}|\\" else ch for ch in s)


def _header_names(cells: list[str], more: int = 0) -> list[str]:
    """Column names of a header, and of ``more`` cells beyond it: blanks get a place name, and a name that is taken gets
    the first number that makes it new.  Case doesn't tell names apart, as in Spark."""
    taken = {c.strip().lower() for c in cells if c.strip()}
    seen: set[str] = set()
    out = []
    for i, c in enumerate([*cells, *[""] * more]):
        own = c.strip()
        name, n = own or f"column_{i + 1}", 0
        while name.lower() in seen or (name.lower() in taken and name != own):
            n += 1
            name = f"{own or f'column_{i + 1}'}.{n}"
        seen.add(name.lower())
        out.append(name)
    return out


def _records(text: str, sep: str) -> Iterator[list[str]]:
    """Records with at least one cell that isn't empty; quotes are doubled inside quoted cells."""
    csv.field_size_limit(1 << 31)
    for cells in csv.reader(io.StringIO(text, newline=""), delimiter=sep):
        if any(cells):
            yield cells


def delimited_cells(spark: SparkSession, path: str, glob: str | None = DELIMITED, seps: list[str] | None = None,
                    pattern: str = "", rows_per_batch: int = 10_000, range_bytes: int = G.RANGE_BYTES) -> DataFrame:
    """S5 step 2: (file_path, row_no, cells): every record as a map from its own file's column names to text.

    Row 0 of each file is its header alone (keys in order, null values), so
    the names are known without data rows.  Empty cells are null; cells beyond
    the header get place names.  One pass over each file, in any encoding; larger files are read by ranges.
    """
    small, big = _split_by_size(spark, path, glob, pattern, range_bytes)
    decoded = _with_separator(decode_corpus(small), seps)
    source = decoded.filter(F.col("text").isNotNull()).select("file_path", "sep", "text")
    schema = "file_path string, row_no bigint, cells map<string,string>"

    def run(batches):
        import pyarrow as pa
        kind = pa.map_(pa.string(), pa.string())

        def batch(held):
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.string()), pa.array([h[1] for h in held], pa.int64()),
                                               pa.array([h[2] for h in held], kind)], names=["file_path", "row_no", "cells"])

        held = []
        for b in batches:
            for file, sep, text in zip(*[c.to_pylist() for c in b.columns]):
                names = None
                for n, cells in enumerate(_records(text, sep)):
                    if names is None:
                        header, names = cells, _header_names(cells)
                        held.append((file, 0, [(k, None) for k in names]))
                        continue
                    if len(cells) > len(names):
                        names = _header_names(header, len(cells) - len(header))
                    held.append((file, n, [(k, v or None) for k, v in zip(names, cells)]))
                    if len(held) >= rows_per_batch:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)

    rows = source.mapInArrow(run, schema)
    return rows if big is None else rows.unionByName(G.delimited_records(G.file_ranges(big, range_bytes), _header_names, seps))


def _names_of(cells: DataFrame) -> dict[str, list[str]]:
    """The column names over all files, in order of first appearance by file, each with its spellings: as many as the result has columns.

    Names that differ in case alone are one column, under the spelling met first.
    """
    names = (cells.select("file_path", "row_no", F.posexplode(F.map_keys("cells")).alias("at", "name"))
             .groupBy("name").agg(F.min(F.struct("file_path", "at")).alias("first")).orderBy("first"))
    out: dict[str, tuple[str, list[str]]] = {}
    for r in names.collect():
        out.setdefault(r["name"].lower(), (r["name"], []))[1].append(r["name"])
    return dict(out.values())


#: Columns that every reader gives; a file's column of such a name gets a number.
_OWN = ("file_path", "row_no")


def _column_names(names: list[str]) -> list[str]:
    """Names of the result's columns: those that clash with its own ones get the first number that makes them new."""
    taken = {n.lower() for n in (*names, *_OWN)}
    out = []
    for name in names:
        n, new = 0, name
        while new.lower() in _OWN or (n and new.lower() in taken):
            n += 1
            new = f"{name}.{n}"
        taken.add(new.lower())
        out.append(new)
    return out


#: What counts as a whole number, and as a number, written out (a cast would take ``1d`` and ``2f`` too).
WHOLE, NUMBER = r"^\s*[+-]?[0-9]+\s*$", r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _typed(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns whose every value is a whole number, or a number, get that type; one look over all rows."""
    if not names:
        return df
    tests = []
    for i, c in enumerate(names):
        v = F.col(f"`{c}`")
        tests += [F.count(v).alias(f"n{i}"), F.count(F.when(v.rlike(WHOLE), v.try_cast("bigint"))).alias(f"l{i}"),
                  F.count(F.when(v.rlike(NUMBER), v.try_cast("double"))).alias(f"d{i}")]
    seen = df.agg(*tests).first()
    out = []
    for i, c in enumerate(names):
        n, whole, number = seen[f"n{i}"], seen[f"l{i}"], seen[f"d{i}"]
        kind = "bigint" if n and whole == n else "double" if n and number == n else "string"
        out.append(F.col(f"`{c}`").cast(kind).alias(c))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *out)


def read_delimited(spark: SparkSession, path: str, glob: str | None = DELIMITED,
                   seps: list[str] | None = None, infer_schema: bool = True, pattern: str = "",
                   text_columns: tuple[str, ...] = (), range_bytes: int = G.RANGE_BYTES) -> DataFrame:
    """(file_path, row_no, columns...): every file under its own separator, encoding
    and header, joined by column NAME; types are decided once over all files, but for ``text_columns``.

    No column is lost: names that differ in case alone are one column, and a column called ``file_path`` or ``row_no``
    becomes ``file_path.1`` or ``row_no.1``.
    """
    at = scratch_path(spark, "cells")
    delimited_cells(spark, path, glob, seps, pattern, range_bytes=range_bytes).write.parquet(at)     # each file is parsed once
    cells = spark.read.parquet(at)
    spellings = _names_of(cells.filter("row_no = 0 OR exists(map_keys(cells), k -> startswith(k, 'column_'))"))
    names = _column_names(list(spellings))
    value = lambda same: F.coalesce(*[F.element_at("cells", F.lit(x)) for x in same])
    rows = cells.filter("row_no > 0").select("file_path", "row_no", *[value(same).alias(n) for n, same in zip(names, spellings.values())])
    texts = {c.lower() for c in text_columns}
    return _typed(rows, [n for n in names if n.lower() not in texts]) if infer_schema else rows


# --- S8 ----------------------------------------------------------------------------------

READABLE = [".txt", ".md", ".csv"]


def read_corpus(spark: SparkSession, path: str, pattern: str = "", extensions: list[str] | None = None,
                range_bytes: int = G.RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, excluded).  Text (.txt) as lines, Markdown (.md) as blocks, CSV
    by separator, all with ``file_path`` and ``row_no``; ``content`` is text, in CSV files too; other allowed types
    (office, PDF) are not read by this engine.  ``excluded`` has every file
    that gives no row, with the reason: the files are those of the rows and these.
    """
    files = corpus_files(spark, path, pattern, extensions, range_bytes)
    exts = [e.lower() for e in (K.ALLOWED_EXTENSIONS if extensions is None else extensions)]
    options = {"pattern": pattern, "range_bytes": range_bytes}
    readers = {".txt": lambda: read_text_lines(spark, path, **options),
               ".md": lambda: read_paragraphs(spark, path, **options),
               ".csv": lambda: read_delimited(spark, path, text_columns=("content",), **options)}
    listing = list_corpus(spark, path, pattern, extensions).filter("matched")
    has = {r.ext for r in listing.select("ext").distinct().collect()}      # at most as many as there are allowed extensions
    rows = None
    for ext, read in readers.items():
        if ext in has and ext in exts:
            part = read()
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None:
        rows = spark.createDataFrame([], "file_path string, row_no bigint, content string")
    return rows, files.filter("status <> 'read'").select(F.col("file_path").alias("path"), "ext", F.col("status").alias("reason"))


def corpus_files(spark: SparkSession, path: str, pattern: str = "", extensions: list[str] | None = None,
                 range_bytes: int = G.RANGE_BYTES) -> DataFrame:
    """One row per listed file: file_path, ext, size, status, rows, columns (its own header's names; ``content`` for text).

    ``status``: read, empty, undecodable, unreadable, unsupported type, not
    matched, or hidden name.
    """
    listing = list_corpus(spark, path, pattern, extensions)
    found = None
    exts = [e.lower() for e in (K.ALLOWED_EXTENSIONS if extensions is None else extensions)]
    content = F.array(F.lit("content"))
    for ext, glob, encodings, delim in ((".txt", TEXT, None, "\n"), (".md", MARKDOWN, ["utf-8"], K.MARKDOWN_DELIM)):
        if ext in exts:
            small, big = _split_by_size(spark, path, glob, pattern, range_bytes)
            dec = decode_corpus(small, encodings)
            parts = F.filter(F.split(normalize_newlines("text"), delim, -1), lambda x: F.length(strip_ws(x)) > 0)
            one = dec.select("file_path", F.col("text").isNotNull().alias("decoded"), F.coalesce(F.size(parts), F.lit(0)).cast("bigint").alias("rows"),
                             content.alias("columns"))
            if big is not None:
                cut = G.file_ranges(big, range_bytes)
                counts = G.read_pieces(cut, len(delim), encodings).groupBy("file_path").agg(F.count("*").alias("rows"))
                one = one.unionByName(G.file_encodings(cut, encodings)[0].join(counts, "file_path", "left").select(
                    "file_path", F.col("encoding_used").isNotNull().alias("decoded"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), content.alias("columns")))
            found = one if found is None else found.unionByName(one)
    if ".csv" in exts:
        # a map's keys keep the header's order; one header row per file
        cells = delimited_cells(spark, path, pattern=pattern, range_bytes=range_bytes)
        per = cells.groupBy("file_path").agg(F.count_if(F.col("row_no") > 0).cast("bigint").alias("rows"),
                                             F.max(F.when(F.col("row_no") == 0, F.map_keys("cells"))).alias("columns"))
        small, big = _split_by_size(spark, path, DELIMITED, pattern, range_bytes)
        dec = decode_corpus(small).select("file_path", F.col("text").isNotNull().alias("decoded"))
        if big is not None:
            dec = dec.unionByName(G.file_encodings(G.file_ranges(big, range_bytes))[0].select("file_path", F.col("encoding_used").isNotNull().alias("decoded")))
        one = dec.join(per, "file_path", "left").select("file_path", "decoded", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"),
                                                        F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "file_path string, decoded boolean, rows bigint, columns array<string>")
    joined = listing.withColumnRenamed("path", "file_path").join(found, "file_path", "left")
    status = (F.when(F.col("hidden"), "hidden name").when(~F.col("matched"), "not matched")
              .when(~F.col("ext").isin(READABLE), "unsupported type").when(F.col("size") == 0, "empty").when(F.col("decoded").isNull(), "unreadable")
              .when(~F.col("decoded"), "undecodable").when(F.col("rows") == 0, "empty").otherwise("read"))
    return joined.select("file_path", "ext", "size", status.alias("status"), F.when(status.isin("read", "empty"), F.coalesce("rows", F.lit(0).cast("bigint"))).alias("rows"),
                         F.when(status.isin("read", "empty"), F.coalesce("columns", F.array().cast("array<string>"))).alias("columns"))
