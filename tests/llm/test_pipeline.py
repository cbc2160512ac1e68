"""Each stage against its operator's brute force, on what its predecessor kept."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import quality
from corpusflow.llm.queries import KEY, tokenizer_path
from corpusflow.sources.tables import load
from test_decontaminate import brute as windows
from test_jaccard import brute as links

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    out, docs = [load(spark, SF, "documents")], load(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(kept):
    columns = kept[0].columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontamination", "pii", "bpe"]
    assert all(df.columns == columns for df in kept[:5])
    assert [t for _, t in kept[4].dtypes] == [t for _, t in kept[0].dtypes]


def test_quality_rejects_what_the_model_rejects(spark, kept):
    model = quality.train(kept[0], load(spark, SF, "labels"))
    want = quality.score(kept[0], model).filter("predicted = 1")
    assert ids(kept[1]) == ids(want)
    good = load(spark, SF, "labels").filter("quality = 1").join(kept[0], "doc_id").select("doc_id")
    assert good.join(kept[1], "doc_id", "left_anti").count() <= 0.02 * good.count()


def test_one_of_each_group_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept[1].select("doc_id", "text").collect()]
    want = {c if c is not None else i for (i, _, c) in links(rows)}
    assert ids(kept[2]) == sorted(want)


def test_no_window_of_the_benchmark_is_left(spark, kept):
    rows = [(r.doc_id, r.text) for r in kept[2].select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    assert ids(kept[3]) == sorted(r[0] for r in windows(rows, items) if not r[5])


def test_pseudonyms_take_effect(spark, kept):
    from corpusflow.llm import pii
    assert ids(kept[4]) == ids(kept[3])
    before = {r.doc_id: r.text for r in kept[3].collect()}
    want = {r.doc_id: r.text for r in pii.pseudonymise(kept[3], KEY).collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in kept[4].collect()}
    assert {i: t for i, (t, _) in after.items()} == want and all(n == len(t) for t, n in after.values())
    assert any(before[i] != want[i] for i in want)


def test_encoding_is_that_of_the_library(kept):
    import hashlib

    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in kept[5].collect()}
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = t.encode(text, add_special_tokens=False).ids
        assert got[i] == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(kept[5].collect())


def test_stages_on_rows_of_every_kind(spark):
    """Nulls in every column, empty texts, repeated rows, an empty table, an extra column that clashes with a result's name."""
    base = load(spark, SF, "documents")
    odd = spark.createDataFrame([(1, None, None, None, None, None), (None, "Some words that stand alone here", "en", None, 1, "x"), (2, "", "en", "s", 0, None),
                                 (3, "again and again the same five words", "en", "s", 3, "a"), (3, "again and again the same five words", "en", "s", 3, "a")],
                                "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs = base.withColumn("score", F.lit("old")).limit(40).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "bpe":
            assert out.columns == docs.columns
        rows = [tuple(r) for r in out.collect()]
        if name == "near_copies":
            texts = [r[1] for r in rows]
            assert texts.count("again and again the same five words") == 1 and None in texts and "" in texts
        if name in ("pii", "bpe"):
            assert len(rows) == docs.count()
