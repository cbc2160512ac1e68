"""One ordered document from many tasks; many outputs in some containers; nulls; totals beside null groups; outcomes of streams."""
import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import report as R
from corpusflow.sinks import containers as WC
from corpusflow.sinks import ordered as WO
from corpusflow.sinks import writers as W
from corpusflow.streaming import streams as ST

@pytest.fixture(autouse=True)
def every_range_a_task(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


VALUES = ['  "q", x ', "a\nb", "\\", '"', " ", "", None, "tab\there", "文；，", "x\\\"y", "plain", "\r"]


@pytest.mark.parametrize("fmt", ["csv", "text"])
def test_one_ordered_document(spark, tmp_path, fmt):
    r = random.Random(3)
    rows = [(i, r.choice(VALUES), r.choice(VALUES)) for i in range(700)]
    df = spark.createDataFrame(rows, "n long, c string, d string").repartition(6)
    manifest = WO.write_ordered(df, str(tmp_path), "r1", ["n"], fmt).orderBy("part").collect()
    folder = tmp_path / "run_id=r1"
    data = b"".join((folder / m.file).read_bytes() for m in manifest)
    assert [m.first for m in manifest] == [sum(x.bytes for x in manifest[:i]) for i in range(len(manifest))] and len(manifest) > 2
    text = data.decode("utf-8-sig")
    assert data.startswith(b"\xef\xbb\xbf") == (fmt == "csv") and "﻿" not in text
    back = list(csv.reader(io.StringIO(text, newline=""), delimiter="," if fmt == "csv" else "\t"))
    assert back == [["n", "c", "d"]] + [[str(a), b or "", c or ""] for a, b, c in rows]
    whole = WO.join_parts(spark, str(tmp_path), "r1", "whole.csv")
    assert open(whole, "rb").read() == data
    # written again with fewer rows: nothing of the first writing is left
    few = WO.write_ordered(df.filter("n < 3"), str(tmp_path), "r1", ["n"], fmt).collect()
    assert sorted(f for f in os.listdir(folder) if f.startswith("part")) == sorted(m.file for m in few)


def test_lines_of_one_column(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 5 else f"line {i:04d}") for i in range(900)], "n long, c string").repartition(5)
    manifest = WO.write_ordered(df, str(tmp_path), "r", ["n"], "text").orderBy("part").collect()
    data = b"".join((tmp_path / "run_id=r" / m.file).read_bytes() for m in manifest)
    assert data.decode() == "".join(("" if i == 5 else f"line {i:04d}") + "\n" for i in range(900))
    empty = WO.write_ordered(df.limit(0), str(tmp_path), "e", ["n"], "text")
    assert empty.count() == 0
    with pytest.raises(ValueError):
        WO.write_ordered(df, str(tmp_path), "r", ["n"], "xml")


def test_nulls_and_empty_texts_come_back(spark, tmp_path):
    rows = [(i, v, VALUES[-i]) for i, v in enumerate(VALUES) if v != "\r" and VALUES[-i] != "\r"]
    df = spark.createDataFrame(rows, "n long, c string, d string")
    W.write_processed(df, str(tmp_path), "r1")
    assert sorted(map(repr, W.read_processed(spark, str(tmp_path), "r1", df.schema).collect())) == sorted(map(repr, df.collect()))


def test_containers_by_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(WC, "EXTENT_ROWS", 10)
    r = random.Random(4)
    rows = [(k, i, r.choice(VALUES), i / 3) for k in [None, "", "a/b", "hot", *map(str, range(50))] for i in range(1, 200 if k == "hot" else r.randint(2, 9))]
    df = spark.createDataFrame(rows, "k string, n long, t string, x double").repartition(4)
    WC.write_containers(df, str(tmp_path), "r1", "k", "n", buckets=7)
    files = os.listdir(tmp_path / "run_id=r1" / "containers")
    assert sorted(f for f in files if f.startswith("container")) == [f"container-{i:06d}.jsonl" for i in range(7)]
    assert sorted(map(repr, map(tuple, WC.read_containers(spark, str(tmp_path), "r1").collect()))) == sorted(map(repr, rows))
    some = spark.createDataFrame([("hot",), (None,), ("3",), ("3",), ("absent",)], "key string")
    got = WC.read_containers(spark, str(tmp_path), "r1", some).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(x) for x in rows if x[0] in ("hot", None, "3"))
    hot = WC.read_index(spark, str(tmp_path), "r1").filter("key = 'hot'")
    assert hot.count() == 20 and hot.select("container").distinct().count() > 3


def test_a_null_group_is_not_the_total(spark):
    res = spark.createDataFrame([(None, "a"), (None, ""), ("c", "ok")], "column string, result string")
    assert sorted((repr(r.column), r.items) for r in R.outcome_stats(res).collect()) == [("'__total__'", 3), ("'c'", 1), ("None", 2)]
    files = spark.createDataFrame([(None, "f"), ("read", "g")], "status string, file_path string")
    assert sorted((repr(r.status), r.files) for r in R.corpus_outcome(files).collect()) == [("'__total__'", 2), ("'read'", 1), ("None", 1)]


def test_stream_outcomes(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for name, data in (("a.txt", "段落".encode()), ("b.txt", "段落".encode("gbk")), ("c.txt", b" \n ")):
        (root / name).write_bytes(data)
    for _ in range(2):
        ST.novel_stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "ck"), ["utf-8"], min_len=1, max_len=9, outcomes=str(tmp_path / "told"))
    told = spark.read.parquet(str(tmp_path / "told")).select(F.element_at(F.split("file_path", "/"), -1).alias("f"), "status", "size")
    assert sorted(map(tuple, told.collect())) == [("a.txt", "read", 6), ("b.txt", "undecodable", 4), ("c.txt", "empty", 3)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_separate_outputs_of_many_files(spark, tmp_path, monkeypatch):
    """Folders up to a number of files; beyond it containers, with the same rows and each file's to be read by itself."""
    monkeypatch.setattr(W, "MAX_FOLDERS", 20, raising=False)
    monkeypatch.setattr(W, "CONTAINER_ROWS", 30, raising=False)
    rows = [(k, n, r) for k in [None, *range(60)] for n in range(1, 4) for r in ("a\nb", "文")]     # keys and numbers that come twice
    many = spark.createDataFrame(rows, "doc_id long, seg_no long, content string").repartition(4)
    few = many.filter("doc_id < 9")
    some = spark.createDataFrame([(None,), (3,), (3,), (500,)], "doc_id long")
    shown = lambda df: sorted(map(repr, map(tuple, df.select("doc_id", "seg_no", "content").collect())))
    folder = tmp_path / "run_id=r1"
    for df, packed in ((few, False), (many, True), (many, True), (few, False)):
        W.write_segments(df, str(tmp_path), "r1", separate=True)
        assert sum(f.startswith("doc_id=") for f in os.listdir(folder)) == (0 if packed else 9)
        assert (folder / "containers").exists() == packed
        assert shown(W.read_segments(spark, str(tmp_path), "r1")) == shown(df)
        assert shown(W.read_segments(spark, str(tmp_path), "r1", keys=some)) == shown(df.filter("doc_id = 3" + " or doc_id is null" * packed))
    W.write_segments(many, str(tmp_path), "r2", separate=True)
    with pytest.raises(ValueError, match="containers"):
        W.write_segments(few, str(tmp_path), "r2", separate=True, mode="append")
    W.write_segments(many, str(tmp_path), "r1", separate=True, mode="ignore")
    assert shown(W.read_segments(spark, str(tmp_path), "r1")) == shown(few)
