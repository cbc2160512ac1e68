import random

from corpusflow.operators import segment as G
from pyrules import check_segments, split_choice


def _para(n, ch="p"):
    return ch * n


def test_bounds_all_orders(spark):
    sizes = [1, 199, 200, 798, 800, 801, 2000]
    rng = random.Random(3)
    docs = []
    for i in range(300):
        k = rng.randint(1, 9)
        docs.append((i, "\n\n".join(_para(rng.choice(sizes), chr(97 + j % 26)) for j in range(k))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: list(r.segments) for r in G.with_segments(df, "text").collect()}
    for i, t in docs:
        check_segments(t.split("\n\n"), got[i])


def test_partition_count_does_not_matter(spark):
    rng = random.Random(5)
    docs = [(i, "\n\n".join("w" * rng.randint(1, 500) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a = G.segment(df.repartition(1), "text", ["doc_id"]).collect()
    b = G.segment(df.repartition(13), "text", ["doc_id"]).collect()
    assert sorted(a) == sorted(b)


def test_every_size_takes_one_route(spark):
    """Null sizes, white space of all kinds as delimiter, and documents of many fold blocks."""
    rng = random.Random(7)
    docs = [(i, "\n\n".join("g" * rng.randint(1, 900) for _ in range(k))) for i, k in enumerate([1, 255, 256, 257, 511, 512, 513, 2000])]
    docs += [(20, None), (21, ""), (22, "a\n\u3000\nb"), (23, " \n\n ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: list(r.segments) for r in G.with_segments(df, "text").collect()}
    for i, t in docs[:8]:
        check_segments(t.split("\n\n"), got[i])
    assert [got[i] for i in (20, 21, 22, 23)] == [[], [], ["a\n\u3000\nb"], []]
    rows = G.segment(df, "text", ["doc_id"], delim=r"\n\s*\n")
    assert rows.filter("doc_id IN (20, 21, 23)").count() == 0
    plan = rows._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_one_document_of_millions_of_characters(spark):
    big = "\n\n".join("字" * (i % 300 + 1) for i in range(20_000))
    df = spark.createDataFrame([(1, big)], "doc_id long, text string")
    got = [r.content for r in G.segment(df, "text", ["doc_id"]).orderBy("seg_no").collect()]
    assert len(big) > 2_000_000
    check_segments(big.split("\n\n"), got)


def test_bounds_validated():
    import pytest
    with pytest.raises(ValueError):
        G.segments_sql("x", 0, 10)
    with pytest.raises(ValueError):
        G.segments_sql("x", 10, 10)


def test_segment_table_numbers_and_counts(spark):
    text = "  第一段。  \n\n\n\n\n第二段" + "字" * 300 + "\n\n" + "短"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = G.segment_table(df, "text", "doc_id").orderBy("seg_no").collect()
    assert [r.seg_no for r in rows] == list(range(1, len(rows) + 1))
    assert all(r.n_chars == len(r.content) for r in rows)


def _split_cases():
    rng = random.Random(11)
    out = []
    for n in (99, 100, 101, 400):
        m, r = n // 2, n // 4
        for offs in (0, 1, -1, r - 1, -(r - 1), r, -r, None):
            for mark in ("。", "！", "\n"):
                s = list("字" * n)
                if offs is not None and 0 <= m + offs < n:
                    s[m + offs] = mark
                out.append("".join(s))
        # ties: same offset both ways
        s = list("字" * n)
        s[m + 3] = "。"
        s[m - 3] = "。"
        out.append("".join(s))
        # a later mark nearer than an earlier mark
        s = list("字" * n)
        s[m + 1] = "！"
        s[m + r - 2] = "。"
        out.append("".join(s))
    for _ in range(300):
        n = rng.randint(90, 300)
        out.append("".join(rng.choice("字字字字。！？\n ") for _ in range(n)))
    return out


def test_continuation_split_rules(spark):
    cases = _split_cases()
    df = spark.createDataFrame(list(enumerate(cases)), "id long, content string")
    got = {r.id: (r.first_part, r.second_part) for r in G.split_continuation(df).collect()}
    for i, c in enumerate(cases):
        assert got.get(i) == split_choice(c), (i, c)


def test_plan_holds_one_split_and_one_fold(spark):
    df = spark.createDataFrame([(1, "a\n\nb")], "doc_id long, text string")
    for q in (G.segment(df, "text", ["doc_id"]), G.with_segments(df, "text")):
        plan = q._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and plan.count("aggregate(") == 2     # paragraphs within blocks


def test_split_runs_once_per_row(spark):
    df = spark.createDataFrame([(1, "字" * 300)], "doc_id long, content string")
    plan = G.split_continuation(df).select("first_part")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 8
