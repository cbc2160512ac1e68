"""One file read by many tasks: the same rows as from reading it whole, wherever the ranges cut."""
import csv
import io
import os
import random

import pytest
from hypothesis import given, settings, strategies as st

from corpusflow.session import ship_package
from corpusflow.sources import corpus as C
from corpusflow.sources import ranges as G

@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    monkeypatch.setattr(G, "MOST_TASKS", 8)


TEXTS = ["天地玄黄", "a", "bc ", "\n", "\n\n", "\r\n", "\r", "\r\n\r\n", "  ", "é", "𠀀", "，", "　", "x"]


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def novels(tmp_path_factory):
    root, r = str(tmp_path_factory.mktemp("ranges")), random.Random(5)
    for i in range(14):
        text = "".join(r.choices(TEXTS, k=r.choice([0, 1, 5, 60, 400])))
        _write(f"{root}/小说 一/u{i}.txt", (b"\xef\xbb\xbf" if i % 3 == 0 else b"") + text.encode())
        _write(f"{root}/g{i}.TXT", text.replace("𠀀", "龘").replace("é", "e").encode("gbk" if i % 2 else "gb18030"))
        _write(f"{root}/m/b{i}.md", ("段落" * 9).encode("gbk") if i == 7 else text.encode())
    _write(f"{root}/quad.txt", ("中" * 40 + "𠀀" * 80).encode("gb18030"))
    _write(f"{root}/bad.txt", "段落".encode("gbk") * 50 + b"\x81")
    _write(f"{root}/latin.txt", "caf\xe9 cr\xe8me\n".encode("latin-1") * 30)
    _write(f"{root}/inner.txt", "﻿one\n﻿two\nthree﻿\n".encode())
    return root


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_lines_and_blocks_of_ranges(spark, novels, size):
    ship_package(spark)
    assert _rows(C.read_text_lines(spark, novels, range_bytes=size)) == _rows(C.read_text_lines(spark, novels))
    assert _rows(C.read_paragraphs(spark, novels, range_bytes=size)) == _rows(C.read_paragraphs(spark, novels))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_decoding_of_ranges(spark, novels, size):
    """Encodings are chosen for whole files, and the ranges' texts join to the file's, with characters cut in every range."""
    ship_package(spark)
    files = C._binary(spark, novels, C.TEXT).select("file_path", "file_size", "content")
    if size < 50:
        files = files.filter("file_path LIKE '%quad%' OR file_path LIKE '%bad%' OR file_path LIKE '%inner%'")
    whole = {r.file_path: (r.encoding_used, r.text) for r in C.decode_corpus(files).collect()}
    parts = {}
    for r in G.decoded_ranges(G.file_ranges(files.select("file_path", "file_size"), size)).collect():
        parts.setdefault(r.file_path, []).append((r.range_no, r.encoding_used, r.text))
    got = {f: (p[0][1], "".join(x[2] for x in sorted(p)) if p[0][1] else None) for f, p in parts.items()}
    same = lambda e: e.replace("-sig", "")
    assert {f: (same(e), t) for f, (e, t) in got.items()} == {f: (same(e), t) for f, (e, t) in whole.items()}
    names = {f.rsplit("/", 1)[-1]: e for f, (e, _) in got.items()}
    assert names["quad.txt"] == "gb18030" and names["bad.txt"] == "latin1"


def test_a_bad_byte_in_the_last_range_changes_the_choice(spark, tmp_path):
    good = "天地玄黄宇宙洪荒" * 200
    _write(f"{tmp_path}/a.txt", good.encode("gbk"))
    _write(f"{tmp_path}/b.txt", good.encode("gbk") + b"\x80")
    files = C._binary(spark, str(tmp_path), C.TEXT).select("file_path", "file_size")
    for order, want in ((None, ["gbk", "latin1"]), (["utf-8", "gbk"], ["gbk", None])):
        used, _ = G.file_encodings(G.file_ranges(files, 33), order)
        assert [r.encoding_used for r in used.orderBy("file_path").collect()] == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(['"', '""', ",", ";", "\n", "\r", "\r\n", "a", "bc", " "]), max_size=40).map("".join), st.integers(1, 9))
def test_quote_states_find_the_records(text, size):
    """Pieces of any size: the states chain, and the starts they find are those of the csv module's records."""
    starts, lines = set(), list(io.StringIO(text, newline=""))
    at, taken = 0, 0

    def fed():
        nonlocal taken
        for x in lines:
            taken += len(x)
            yield x
    for _ in csv.reader(fed()):
        starts.add(at)
        at = taken
    state, found = G.START, set()
    for a in range(0, len(text), size):
        piece, entry = text[a:a + size], state
        place = G.quote_state(piece, entry, ",", until_start=True)
        if place >= 0:
            found.add(a + place)
        state = G.quote_state(piece, entry, ",")
        whole = G.quote_state(text[:a + size], G.START, ",")
        assert state == whole
    per_piece = {}
    for x in starts:
        per_piece.setdefault(x // size, x)
        per_piece[x // size] = min(per_piece[x // size], x)
    assert found == set(per_piece.values())


def _cells(r, n):
    values = ["", "plain", "two\nlines", 'say "hi"', "a,b;c\td", "\r\n", "末尾", "  ", "1", '"', "\n\n"]
    return [r.choice(values) for _ in range(n)]


@pytest.mark.parametrize("size", [7, 300])
def test_delimited_records_of_ranges(spark, tmp_path, size):
    ship_package(spark)
    r = random.Random(8)
    for i, (sep, end, enc) in enumerate([(",", "\n", "utf-8"), (";", "\r\n", "gbk"), ("\t", "\r", "utf-8"), ("|", "\n", "gbk"), (",", "\r\n", "utf-8")]):
        out = io.StringIO(newline="")
        w = csv.writer(out, delimiter=sep, lineterminator=end)
        w.writerow(["id", "id", "", f"名{i}"])
        for k in range(60):
            w.writerow([k, *_cells(r, r.choice([1, 3, 5]))])
            if k % 9 == 0:
                out.write(end * r.randint(1, 3))
        _write(f"{tmp_path}/f{i}.csv", (b"\xef\xbb\xbf" if i == 4 else b"") + out.getvalue().encode(enc))
    _write(f"{tmp_path}/open.csv", 'a,b\n1,"never closed\n2,3\n4,5\n'.encode())
    _write(f"{tmp_path}/stray.csv", 'a,b\n1,x"y\n2"z,"q"r"s\n4,5'.encode())
    _write(f"{tmp_path}/none.csv", b"\n\n,\n")
    whole = C.delimited_cells(spark, str(tmp_path)).collect()
    split = C.delimited_cells(spark, str(tmp_path), range_bytes=size).collect()
    key = lambda x: (x.file_path, x.row_no)
    assert sorted(map(tuple, map(lambda x: (x.file_path, x.row_no, tuple(x.cells.items())), split)), key=repr) == \
        sorted(map(lambda x: (x.file_path, x.row_no, tuple(x.cells.items())), whole), key=repr)
    assert len(split) > 250 and key(split[0])


def test_no_column_is_lost(spark, tmp_path):
    """Names that repeat, differ in case, or are the reader's own; texts that a cast would take for numbers; extra cells."""
    assert C._header_names(["a", "a", "a.1", "", "A", "column_4"]) == ["a", "a.2", "a.1", "column_4.1", "A.3", "column_4"]
    assert C._header_names(["x"], 2) == ["x", "column_2", "column_3"]
    _write(f"{tmp_path}/1.csv", b"file_path,row_no,text,a,a,a.1,n\nf,7,1d,p,q,r,007\n")
    _write(f"{tmp_path}/2.csv", b"Text,row_no.1,n,column_5\n2f,own,1.5,five,six\n")
    out = C.read_delimited(spark, str(tmp_path))
    rows = [r.asDict() for r in out.orderBy("row_no", "file_path").collect()]
    for r in rows:
        r.pop("file_path")
    none = dict.fromkeys(out.columns[1:])
    assert rows == [none | {"row_no": 1, "file_path.1": "f", "row_no.2": 7, "text": "1d", "a": "p", "a.2": "q", "a.1": "r", "n": 7.0},
                    none | {"row_no": 1, "text": "2f", "row_no.1": "own", "n": 1.5, "column_5": "five", "column_5.1": "six"}]


def test_one_numeric_column_stops_no_corpus(spark, tmp_path):
    _write(f"{tmp_path}/a.csv", b"content,k\n007,1\n12,2\n")
    _write(f"{tmp_path}/b.txt", "a line\n".encode())
    _write(f"{tmp_path}/c.csv", b"Content\n1e3\n")
    rows, _ = C.read_corpus(spark, str(tmp_path))
    assert sorted(r.content for r in rows.collect()) == ["007", "12", "1e3", "a line"]


def test_a_mixed_corpus_by_ranges(spark, tmp_path):
    """Rows, statuses and counts of every file are those of reading whole files."""
    for name, data in (("a.txt", "一\r\n\r\n二".encode("gbk")), ("b.md", "# t\n\n\nx\ny\n\n".encode()), ("c.md", "段落段落".encode("gbk")),
                       ("d.csv", "k;v\n1;\"x\ny\"\n".encode()), ("e.csv", b"k,v\n"), ("f.txt", b"  \n  \n  "), ("g.pdf", b"%PDF"), ("h.txt", b"")):
        _write(f"{tmp_path}/{name}", data)
    outs = []
    for size in (4, G.RANGE_BYTES):
        rows, excluded = C.read_corpus(spark, str(tmp_path), range_bytes=size)
        outs.append((sorted(map(repr, (r.asDict() for r in rows.collect()))), _rows(excluded),
                     sorted(map(repr, C.corpus_files(spark, str(tmp_path), range_bytes=size).collect()))))
    assert outs[0] == outs[1] and len(outs[0][0]) == 5
