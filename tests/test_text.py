from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.functions import text as T
from pyrules import check_clean, check_paragraphs

ALPHABET = ["a", "b", "中", "。", " ", "\t", "\n", "\r", "\xa0", "　", "\x0b", " ", "x"]
texts = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)


def test_ws_is_python_whitespace():
    assert K.WS == "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


@settings(max_examples=25, deadline=None)
@given(st.lists(texts, min_size=1, max_size=30))
def test_strip_clean_paragraphs_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = df.select("i", T.strip_ws("t").alias("s"), T.clean_text("t").alias("c"),
                     T.split_paragraphs("t").alias("p"), T.is_blank("t").alias("b")).collect()
    for r in rows:
        v = values[r.i]
        assert r.s == v.strip()
        check_clean(v, r.c)
        check_paragraphs(v, list(r.p))
        assert r.b == (v.strip() == "")


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([("  a \t b \n\n\n\n\n c  \n",)], "t string")
    once = df.select(T.clean_text("t").alias("t"))
    twice = once.select(T.clean_text("t").alias("t"))
    assert once.collect() == twice.collect() == [("a b\n\n\nc",)]


def test_null_is_blank(spark):
    df = spark.createDataFrame([(None,), ("　",), ("x",)], "t string")
    assert [r.b for r in df.select(T.is_blank("t").alias("b")).collect()] == [True, True, False]


def test_truncation_bounds(spark):
    rows = [("a" * n,) for n in (7999, 8000, 8001, 9999, 10000, 10001)]
    df = spark.createDataFrame(rows, "t string")
    out = df.select(T.truncate_input("t", 8000, K.BUILDER_TRUNCATION_MARKER).alias("b"),
                    T.truncate_input("t").alias("p")).collect()
    for (t,), r in zip(rows, out):
        assert r.b == (t if len(t) <= 8000 else t[:8000] + "...[文本过长已截断]")
        assert r.p == (t if len(t) <= 10000 else t[:10000] + "...[文本过长，已截断]")


def test_excerpt_and_tokens(spark):
    df = spark.createDataFrame([("x" * 49,), ("x" * 50,), ("x" * 51,), ("y" * 3000,), ("z" * 10,)], "t string")
    out = df.select(T.excerpt("t", 50).alias("e"), T.max_output_tokens("t").alias("d"),
                    T.max_output_tokens("t", 1000).alias("k"), T.max_output_tokens("t", 5000).alias("h")).collect()
    assert [r.e for r in out[:3]] == ["x" * 49, "x" * 50, "x" * 50 + "..."]
    assert [r.d for r in out] == [256, 256, 256, 2048, 256]
    assert {r.k for r in out} == {1000}
    assert [r.h for r in out] == [256, 256, 256, 2048, 256]
