import json
import os

from pyspark.sql import functions as F

from corpusflow.operators import dataset as D
from corpusflow.sinks import writers as W
from corpusflow.sources import corpus as C


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def _decodes(raw, enc):
    try:
        raw.decode(enc)
        return True
    except UnicodeDecodeError:
        return False


def _corpus(root):
    _write(f"{root}/a/novel.txt", "第一行\r\n\r\n  第二行  \r第三行".encode("utf-8"))
    _write(f"{root}/b/novel.txt", "﻿带标记的文件\n".encode("utf-8"))
    _write(f"{root}/c/gbk.txt", "简体中文内容\n第二行".encode("gbk"))
    _write(f"{root}/c/big5.TXT", "繁體中文內容".encode("big5"))
    _write(f"{root}/c/latin.txt", "caf\xe9 cr\xe8me".encode("latin-1"))
    _write(f"{root}/c/empty.txt", b"   \n\n")
    _write(f"{root}/d/notes.md", "# 标题\n\n\n段落一\n第二行\n\n\n\n段落二\n".encode("utf-8"))
    _write(f"{root}/d/semi.csv", "name;text\nx;hello\ny;world\n".encode("utf-8"))
    _write(f"{root}/d/tab.csv", "name\ttext\nz\tthere\n".encode("utf-8"))
    _write(f"{root}/d/one.csv", "text\nonly\n".encode("utf-8"))
    _write(f"{root}/d/image.png", b"\x89PNG")
    _write(f"{root}/d/report.pdf", b"%PDF")


def test_listing_and_wildcards(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _corpus(root)
    files = C.list_corpus(spark, root, "*.txt")
    got = {os.path.relpath(r.path.replace("file:", ""), root): r.matched for r in files.collect()}
    assert got["a/novel.txt"] and got["b/novel.txt"]          # same base name, both kept
    assert got["c/big5.TXT"] is False                          # wildcard is case-sensitive
    assert got["d/image.png"] is False and len(got) == 12      # each file once
    upper = {r.name for r in C.list_corpus(spark, root, "", [".txt"]).filter("matched").collect()}
    assert "big5.TXT" in upper                                 # extension compared lower-cased


def test_decoding_and_lines(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _corpus(root)
    docs = {os.path.basename(r.file_path): r for r in C.read_documents(spark, root, "*.[tT][xX][tT]").collect()}
    assert "empty.txt" not in docs
    assert docs["gbk.txt"].encoding_used == "gbk" and docs["gbk.txt"].text.startswith("简体中文")
    raw = "繁體中文內容".encode("big5")
    first_ok = next(e for e in ["gbk", "gb2312", "gb18030", "big5", "latin1"] if _decodes(raw, e))
    assert docs["big5.TXT"].encoding_used == first_ok and docs["big5.TXT"].text == raw.decode(first_ok)
    assert docs["latin.txt"].text == "caf\xe9 cr\xe8me" and docs["latin.txt"].encoding_used == "latin1"
    assert docs["novel.txt"].text in ("带标记的文件\n", "第一行\n\n  第二行  \n第三行")
    lines = C.read_text_lines(spark, f"{root}/a")
    assert [r.content for r in lines.orderBy("row_no").collect()] == ["第一行", "第二行", "第三行"]
    bom = C.read_text_lines(spark, f"{root}/b").first()
    assert bom.content == "带标记的文件"
    md = C.read_paragraphs(spark, f"{root}/d")
    assert [r.content for r in md.orderBy("row_no").collect()] == ["# 标题", "段落一\n第二行", "段落二"]


def test_delimited_separator_by_header(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _corpus(root)
    seps = {os.path.basename(r.file_path): r.sep for r in C.choose_separators(spark, f"{root}/d").collect()}
    assert seps == {"semi.csv": ";", "tab.csv": "\t", "one.csv": ","}
    rows = C.read_delimited(spark, f"{root}/d")
    assert sorted(r.text for r in rows.collect()) == ["hello", "only", "there", "world"]


def test_delimited_files_keep_their_own_header(spark, tmp_path):
    """Column order, encodings, quotes, blanks, glob characters, types: all by the file's own header."""
    root = str(tmp_path / "m")
    _write(f"{root}/a.csv", "text,other\nhello,1\n".encode())
    _write(f"{root}/小说 一.csv", "other,text\n2,\"he said \"\"hi\"\", then left\"\n".encode("gbk"))
    _write(f"{root}/b[1].CSV", "id;text;文\r\nx9;\"two\nlines\";文字\r\n\r\n7;  blanks  ;\r\n".encode("gbk"))
    _write(f"{root}/latin.csv", "text\tid\ncaf\xe9\t1\nplain\t2\textra\n".encode("latin-1"))
    rows = C.read_delimited(spark, root)
    got = sorted((r.text, r.other, r.id, r["文"], r["column_3"]) for r in rows.collect())
    assert got == sorted([("hello", 1, None, None, None), ('he said "hi", then left', 2, None, None, None), ("two\nlines", None, "x9", "文字", None),
                          ("  blanks  ", None, "7", None, None), ("caf\xe9", None, "1", None, None), ("plain", None, "2", None, "extra")])
    assert dict(rows.dtypes)["other"] == "bigint" and dict(rows.dtypes)["id"] == "string"
    assert rows.filter("row_no IS NULL").count() == 0


def test_every_listed_file_is_read_or_named(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _corpus(root)
    _write(f"{root}/e/_draft.txt", b"hidden")
    _write(f"{root}/e/.x.txt", b"hidden")
    _write(f"{root}/小说 一/n.MD", "# 标题\n\n段".encode("gbk"))
    _write(f"{root}/小说 一/好.TXT", "文".encode())
    rows, excluded = C.read_corpus(spark, root)
    listed = {r.path for r in C.list_corpus(spark, root).collect()}
    read, named = {r.file_path for r in rows.select("file_path").distinct().collect()}, {r.path: r.reason for r in excluded.collect()}
    assert read | set(named) == listed and not read & set(named) and len(listed) == 16
    short = {p.rsplit("/", 1)[-1]: v for p, v in named.items()}
    assert short == {"_draft.txt": "hidden name", ".x.txt": "hidden name", "n.MD": "undecodable", "report.pdf": "unsupported type",
                     "image.png": "not matched", "empty.txt": "empty"}
    one = C.list_corpus(spark, f"{root}/a/novel.txt").collect()
    assert len(one) == 1 and one[0].matched


def test_encoding_order_holds_for_every_file(spark, tmp_path):
    _write(f"{tmp_path}/u.txt", "文字".encode())
    for order in (["gbk"], ["gbk", "utf-8"], ["utf-8", "gbk"]):
        b = C._binary(spark, str(tmp_path), "*.txt")
        got = [[r.encoding_used for r in C.decode_corpus(b, order, single_pass=p).collect()] for p in (False, True)]
        assert got[0] == got[1] == [order[0]]


def test_runs_do_not_touch_each_other(spark, tmp_path):
    segs = spark.createDataFrame([(1, 1, "天" * 30)], "doc_id long, seg_no long, content string")
    for run, n in (("r1", 1), ("r2", 2), ("r2", 3)):
        many = segs.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("seg_no"), "content")
        W.write_segments(many, str(tmp_path / "s"), run)
        W.write_processed(many, str(tmp_path / "p"), run)
        W.write_messages(D.build_dataset(many, ["doc_id", "seg_no"]), str(tmp_path / "m"), run)
    for out, reader in (("s", spark.read.parquet), ("m", spark.read.text)):
        counts = {r.run_id: r["count"] for r in reader(str(tmp_path / out)).groupBy("run_id").count().collect()}
        assert counts["r2"] == 3 * counts["r1"] > 0


def test_csv_values_come_back_exactly(spark, tmp_path):
    values = ['  "q", x ', "a\nb", "\\", '"', " ", "tab\t", "文；，", "x\\\"y"]
    df = spark.createDataFrame([(i, v, v * 2) for i, v in enumerate(values)], "id long, c string, c_processed string")
    for fmt, sep in (("csv", ","), ("text", "\t")):
        W.write_processed(df, str(tmp_path / fmt), "r", fmt=fmt)
        back = spark.read.options(**W.EXACT_CSV, multiLine=True, sep=sep).schema(df.schema).csv(str(tmp_path / fmt / "run_id=r"))
        assert sorted(back.collect()) == sorted(df.collect())


def test_text_lines_leave_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"line{i:04d}") for i in range(3000)], "n long, c string").repartition(7)
    W.write_processed(df, str(tmp_path / "t"), "r", fmt="text", order=["n"])
    parts = sorted(f for f in os.listdir(tmp_path / "t/run_id=r") if f.startswith("part-"))
    lines = [x for f in parts for x in open(tmp_path / "t/run_id=r" / f, encoding="utf-8").read().splitlines()]
    assert lines == [f"line{i:04d}" for i in range(3000)]


def test_read_corpus_dispatch(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _corpus(root)
    rows, excluded = C.read_corpus(spark, root)
    ex = {os.path.basename(r.path): r.reason for r in excluded.collect()}
    assert ex["report.pdf"] == "unsupported type" and ex["image.png"] == "not matched"
    assert rows.filter(F.col("content") == "第三行").count() == 1


def test_write_messages_and_segments(spark, tmp_path):
    segs = spark.createDataFrame([(1, 1, "天色渐暗。" * 30), (2, 1, "风起了。" * 40)],
                                 "doc_id long, seg_no long, content string")
    ds = D.build_dataset(segs, ["doc_id", "seg_no"])
    out = str(tmp_path / "jsonl")
    W.write_messages(ds, out, "r1")
    back = spark.read.text(f"{out}/run_id=r1/task_type=写作")
    objs = [json.loads(r.value) for r in back.collect()]
    assert len(objs) == 2 and objs[0]["messages"][2]["role"] == "assistant"
    raw = open([os.path.join(dp, f) for dp, _, fs in os.walk(f"{out}/run_id=r1/task_type=写作")
                for f in fs if f.startswith("part-")][0], encoding="utf-8").read()
    assert "天色" in raw or "风起" in raw                      # non-ASCII unescaped
    seg_out = str(tmp_path / "segs")
    W.write_segments(segs, seg_out, "r1", separate=True)
    one = spark.read.parquet(f"{seg_out}/run_id=r1/doc_id=1")
    assert "doc_id" not in one.columns and one.count() == 1


def test_write_processed_text(spark, tmp_path):
    one = spark.createDataFrame([("a",), ("b",)], "c string")
    W.write_processed(one, str(tmp_path / "t1"), "r", fmt="text")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t1/run_id=r")).collect()) == ["a", "b"]
    two = spark.createDataFrame([("a", "x")], "c string, c_processed string")
    W.write_processed(two, str(tmp_path / "t2"), "r", fmt="text")
    lines = spark.read.text(str(tmp_path / "t2/run_id=r")).collect()
    assert lines[0].value == "c\tc_processed"


def test_single_pass_decoding_agrees(spark, tmp_path):
    root = str(tmp_path / "corpus")
    _corpus(root)
    b = C._binary(spark, root, "*.txt")
    two = sorted((r.file_path, r.text, r.encoding_used) for r in C.decode_corpus(b).collect())
    one = sorted((r.file_path, r.text, r.encoding_used) for r in C.decode_corpus(b, single_pass=True).collect())
    assert one == two


def test_extension_rule_matches_pathlib(spark):
    from pathlib import Path
    names = [".txt", "a.", "a.txt", "a.b.TXT", "..txt", "a..txt", "noext", ".a.txt", "a.tar.gz"]
    df = spark.createDataFrame([(f"/d/{n}",) for n in names], "p string")
    got = [r.e for r in df.select(C._ext(F.col("p")).alias("e")).collect()]
    assert got == [Path(n).suffix.lower() for n in names]


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    """The splittable reader equals the whole-file reader, with blocks far smaller than the files."""
    lines = [f"行 {i} " + "字" * (i % 50) if i % 7 else "  " for i in range(5000)]
    _write(f"{tmp_path}/小说 一/a+b.txt", b"\xef\xbb\xbf" + "\r\n".join(lines).encode())
    _write(f"{tmp_path}/b.TXT", "\n".join(reversed(lines)).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        split = C.read_utf8_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(split) == sorted(C.read_text_lines(spark, str(tmp_path)).collect())


def test_one_source_of_delimited_rows_is_many_files(spark, monkeypatch):
    """A key with many rows is written as files of a bounded number of lines, and all rows come back."""
    from corpusflow.plans import file_queries as Q
    written = []
    monkeypatch.setattr(Q, "FILE_LINES", 20, raising=False)
    read = Q.C.read_delimited
    monkeypatch.setattr(Q.C, "read_delimited", lambda s, out: written.append(out) or read(s, out))
    monkeypatch.setattr(Q.tables, "documents", lambda s, sf, cols: s.range(400).selectExpr("id AS doc_id", "'es' AS lang", "'hot' AS source", "concat('t', id) AS text").select(*cols))
    assert sorted(r.doc_id for r in Q.q_delimited_mixed(spark, "").select(F.col("doc_id").cast("long").alias("doc_id")).collect()) == list(range(400))
    sizes = [r["count"] for r in spark.read.text(f"{written[0]}/es", recursiveFileLookup=True).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 15 and max(sizes) < 60
