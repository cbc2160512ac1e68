"""Segments of documents divided over tasks equal the fold over whole documents."""
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpusflow.operators import segment as G
from corpusflow.operators import segment_split as GS
from corpusflow.session import ship_package
from corpusflow.sources import corpus as C
from corpusflow.sources import ranges as R


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.integers(1, 30))
def test_pointers_follow_the_fold(lengths, max_len):
    size = np.array(lengths)
    to = GS.next_starts(size, max_len)
    for i in range(len(lengths)):
        cur, j = lengths[i], i + 1
        while j < len(lengths) and cur + lengths[j] + 2 <= max_len:
            cur, j = cur + lengths[j] + 2, j + 1
        assert to[i] == j and j - i <= GS.most_in_pack(max_len)
    own = max(1, len(lengths) // 2)
    for entry, out in enumerate(GS.block_exits(size, own, max_len)):
        i = entry
        while i < own:
            i = to[i]
        assert out == i - own


@pytest.mark.parametrize("bounds, block", [((200, 800), 300), ((5, 20), 9), ((18, 20), 8)])
def test_divided_documents(spark, monkeypatch, bounds, block):
    """Blocks far smaller than the documents; segments and chains of short packs that cross many blocks; null and empty documents."""
    ship_package(spark)
    monkeypatch.setattr(GS, "BLOCK", max(block, GS.most_in_pack(bounds[1]) + 1))
    r = random.Random(block)
    docs = [(i if i != 3 else None, "\n\n".join("字" * r.choice([1, 2, 4, 11, 17, 19, 30, bounds[1], bounds[1] - 4]) for _ in range(r.choice([0, 1, 2, 9, 400])))) for i in range(12)]
    docs += [(50, "\n\n".join(["x" * 19] * 70 + ["y" * 3] * 90))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = G.segment(df, "text", ["doc_id"], *bounds).collect()
    paras = df.selectExpr("doc_id", "posexplode(split(text, '\n\n')) AS (p, content)").filter("length(content) > 0").selectExpr("doc_id", "p + 1L AS row_no", "content")
    got = GS.segment_paragraphs(paras.repartition(5), ["doc_id"], min_len=bounds[0], max_len=bounds[1]).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, whole))
    one = GS.segment_paragraphs(paras.filter("doc_id = 50").select("row_no", "content"), [], min_len=bounds[0], max_len=bounds[1]).collect()
    assert sorted((x.seg_no, x.content) for x in one) == sorted((x.seg_no, x.content) for x in whole if x.doc_id == 50)
    assert GS.segment_paragraphs(paras.limit(0), ["doc_id"], min_len=bounds[0], max_len=bounds[1]).count() == 0


def test_blocks_have_to_hold_a_pack(spark, monkeypatch):
    monkeypatch.setattr(GS, "BLOCK", 10)
    with pytest.raises(ValueError):
        GS.segment_paragraphs(spark.createDataFrame([(1, 1, "x")], "doc_id long, row_no long, content string"), ["doc_id"])


def test_files_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "MOST_TASKS", 8)
    r = random.Random(2)
    for i, enc in enumerate(["utf-8", "gbk", "utf-8-sig"]):
        text = ("\r\n\r\n" if i else "\n\n\n").join(f"第{j}段" + "字" * r.randint(1, 300) for j in range(60))
        (tmp_path / f"n{i}.txt").write_bytes(text.encode(enc))
    files = C._binary(spark, str(tmp_path), C.TEXT).select("file_path", "file_size")
    got = GS.segment_files(R.file_ranges(files, 700)).collect()
    assert sorted(got) == sorted(G.segment(C.read_novels(spark, str(tmp_path)), "text", ["file_path"]).collect())
