"""Trained operators: held-out accuracy on the driver's tables, and rows of every kind."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import language, learning, quality, queries, textkernel as tk, toxicity
from corpusflow.session import ship_package

SF = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else "/root/testdata/sf0.01"


def confusion(df, spark, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = df.filter("held_out").join(labels, "doc_id").groupBy(label, "predicted").count().collect()
    return {(r[0], r[1]): r[2] for r in rows}


def test_toxicity_held_out(spark):
    ship_package(spark)
    c = confusion(queries.op8_toxicity(spark, SF), spark, "toxic")
    caught, missed, false = c.get((1, 1), 0), c.get((1, 0), 0), c.get((0, 1), 0)
    assert caught / (caught + missed) > 0.6 and false <= 0.01 * c[0, 0]


def test_quality_held_out(spark):
    ship_package(spark)
    df = queries.op10_quality(spark, SF).cache()
    c = confusion(df, spark, "quality")
    assert c[0, 0] / (c[0, 0] + c.get((0, 1), 0)) > 0.95 and c[1, 1] / (c[1, 1] + c.get((1, 0), 0)) > 0.99
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.filter("score IS NULL OR score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").count() == 0


def test_language_held_out(spark):
    ship_package(spark)
    df = queries.op7_language_mixture(spark, SF)
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    good, n = df.filter("held_out").join(want, "doc_id").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert good / n > 0.98


def test_mixtures_are_found(spark):
    """Half a text in each of two languages: both are in its set, at about their shares; a pure text has one."""
    ship_package(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    long = {x: "".join(r.text + "\n" for r in docs.filter((F.col("lang") == x) & (F.length("text") > 2000)).orderBy("doc_id").limit(4).collect())[:6000] for x in ("en", "fr")}
    s = model.mixtures(pa.array([long["en"], long["fr"], long["en"][:3000] + " " + long["fr"][:3000]]))
    i, j = model.langs.index("en"), model.langs.index("fr")
    assert s[0, i] > 0.97 and s[1, j] > 0.97
    assert 0.35 < s[2, i] < 0.65 and 0.35 < s[2, j] < 0.65


def test_em_never_lowers_the_likelihood():
    r = np.random.default_rng(0)
    m = language.Model(["a", "b", "c"], r.integers(0, 50, (language.SPACE, 3)).astype(float))
    g = r.integers(0, language.SPACE, 300)
    k, of, heads = np.ones(300), np.repeat([0, 1], 150), np.array([0, 150])
    share, before = np.full((2, 3), 1 / 3), None
    for _ in range(12):
        share, fit = m._em(m.p[g], k, of, heads, np.array([150.0, 150.0]), share, 1)
        assert np.allclose(share.sum(1), 1)
        assert before is None or (fit >= before - 1e-9).all()
        before = fit


def rows(spark):
    data = [(i, f"good words number {i} stand here", "en", 1) for i in range(60)]
    data += [(100 + i, f"BAD!! ### {i} $$$ worthless", "xx", 0) for i in range(60)]
    data += [(300, None, "en", 9), (301, "", None, 9), (302, "12 !! 34", "en", 9), (None, "good words", "en", 9), (303, "bad " * 200_000, None, 9),
             (304, "same row", "en", 9), (304, "same row", "en", 9), (305, "漢字 كتاب", None, 9)]
    docs = spark.createDataFrame([(i, t, lang, "old") for i, t, lang, _ in data], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, y, 1 - y, 5) for i, _, _, y in data if y < 2] + [(None, 1, 1, 0), (5, None, None, 0), (700, 1, 0, 0), (1, 1, 0, 1)],
                                   "doc_id long, quality int, toxic int, text int")
    return docs, labels, len(data)


@pytest.mark.parametrize("op, label", [(quality, "quality"), (toxicity, "toxic")])
def test_scores_of_every_kind(spark, op, label):
    ship_package(spark)
    docs, labels, n = rows(spark)
    model = op.train(docs, labels)
    out = op.score(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted"]
    got = out.collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 304}) == 1
    side = {r.doc_id: r.score for r in got}
    good, bad = np.mean([side[i] for i in range(60)]), np.mean([side[100 + i] for i in range(60)])
    assert (good > bad + 0.5) if label == "quality" else (bad > good + 0.5)
    assert op.score(docs.limit(0), model).count() == 0
    none = op.score(docs, op.train(docs, labels.limit(0))).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5 if label == "quality" else 0.0]
    one = op.score(docs, op.train(docs, labels.filter(F.col(label) == 1))).select("score").distinct().collect()
    assert [r.score for r in one] == [1.0]
    elsewhere = op.train(docs.filter("doc_id > 300"), labels)      # labels of documents that aren't there
    assert 0 <= elsewhere.constant <= 1


@pytest.mark.parametrize("copies", ["exact", "near"])
def test_copies_crowd_out_no_terms(spark, copies):
    """A third of the rows is one clean text of 1,500 words; the words that tell toxic texts are learned all the same."""
    ship_package(spark)
    r, insults = np.random.default_rng(3), [f"insult{c}{c}{c}" for c in "abcdefghij"]
    some = lambda: " ".join(f"w{i}" for i in r.choice(200, 12, replace=False))
    long = " ".join(f"{i:05d}word" for i in r.permutation(1500))
    data = [(i, f"{some()} {insults[i % 10][::-1]}", 1) for i in range(400)] + [(1000 + i, some(), 0) for i in range(400)]
    data += [(2000 + i, long if copies == "exact" else f"{long} tail{i}", 0) for i in range(400)]
    docs = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    words = [next(toxicity.document_terms(pa.array([w[::-1]]))) for w in insults]
    assert all((model.keep[t] >= 0).any() for _, t, _ in words)
    s = model.scores(pa.array([f"{some()} {w[::-1]}" for w in insults] + [some() for _ in range(10)] + [long]))
    assert (s[:10] > 0.5).all() and (s[10:] < 0.5).all()


def test_languages_of_every_kind(spark):
    ship_package(spark)
    docs, _, n = rows(spark)
    out = language.predict(docs, language.train(docs), keep=("doc_id", "score", "text"))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "languages", "shares"] and out.count() == n
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].languages == [] for i in (300, 301, 302))
    assert got[3].lang_pred == "en" and got[104].lang_pred == "xx" and got[305].lang_pred in ("en", "xx")
    none = language.predict(docs, language.train(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.predict(docs.limit(0), language.train(docs)).count() == 0


def test_nothing_held_out_is_learned(spark):
    ship_package(spark)
    docs, labels, _ = rows(spark)
    ids = [r.doc_id for r in learning.labelled_ids(labels, "quality", 1000, 1000).collect()]
    import zlib
    assert ids and all(zlib.crc32(str(i).encode()) % 5 for i in ids)
    assert 0 < len(learning.labelled_ids(labels, "quality", 20, 20).collect()) < 60


def test_factorization_machine_learns_pairs():
    """A pair of terms decides, each of them alone says nothing: no additive weights can tell."""
    r = np.random.default_rng(1)
    a, b, noise = r.random(800) < 0.5, r.random(800) < 0.5, r.integers(2, 30, 800)
    y = (a == b).astype(float)
    pairs = [(i, t) for i in range(800) for t, on in ((0, a[i]), (1, b[i]), (noise[i], True)) if on]
    of, terms = (np.array(x) for x in zip(*pairs))
    m = toxicity.Model()
    m.keep[:30] = np.arange(30)
    m.fit(of, terms, y, decay=1e-5)
    assert ((m._sums(of, terms, 800)[0] > 0) == (y > 0.5)).mean() > 0.95


def test_attention_gradients():
    """Hand-written gradients against differences of the loss."""
    r = np.random.default_rng(2)
    x, of, y = r.normal(size=(30, quality.N_FEATURES)), np.sort(np.concatenate([np.arange(8), r.integers(0, 8, 22)])), (r.random(8) < 0.5).astype(float)
    m = quality.Model()
    loss = lambda: float(np.mean(np.logaddexp(0, m._forward(x, of, 8)[5]) - y * m._forward(x, of, 8)[5]))
    seen = {}

    class Spy(learning.Adam):
        def step(self, grads):
            seen.update({k: v.copy() for k, v in grads.items()})
    real, steps = learning.Adam, quality.STEPS
    try:
        learning.Adam, quality.STEPS = Spy, 1
        m.mean, m.scale = np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES)
        x = (x - x.mean(0)) / (x.std(0) + 1e-3)
        m.fit(x, of, y, np.ones(8), decay=0)
        x = (x - x.mean(0)) / (x.std(0) + 1e-3)
    finally:
        learning.Adam, quality.STEPS = real, steps
    for name, p in m.p.items():
        flat = p.reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 4)):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-5 - seen[name].reshape(-1)[i]) < 1e-5, name


def test_word_hashes_follow_the_words():
    texts = ["The cat  sat\non THE mat", None, "", "  x ", "É é the", "cat " * 1000]
    seen = {}
    for _, data, offsets in tk.text_chunks(pa.array(texts), chunk=10):
        h, rows_, starts, ends = tk.words(data, offsets, tk.BLANK)
        for v, a, b in zip(h, starts, ends):
            word = bytes(data[a:b]).decode().replace("T", "t").replace("H", "h").replace("E", "e")
            assert seen.setdefault(word, v) == v
    assert len(set(seen.values())) == len(seen) == 8


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_models_do_not_depend_on_row_order(spark, operator, label):
    """Several texts of one doc_id, in any order and partitioning, and ids that are strings: the same model."""
    ship_package(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 1500")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label).filter("doc_id < 1500")
    twice = docs.union(docs.selectExpr("doc_id", "concat('another ', reverse(text)) AS text").filter("doc_id % 3 = 0"))
    texts = pa.array([r.text for r in docs.orderBy("doc_id").limit(50).collect()], pa.string())
    seen = [operator.train(x, labels).scores(texts) for x in (twice, twice.repartition(5).sortWithinPartitions("text"), twice.orderBy(F.desc("text")))]
    assert np.array_equal(seen[0], seen[1]) and np.array_equal(seen[0], seen[2])
    named = [operator.train(d.withColumn("doc_id", F.concat(F.lit("d"), F.format_string("%06d", "doc_id"))), lab.withColumn("doc_id", F.concat(F.lit("d"), F.format_string("%06d", "doc_id"))))
             for d, lab in ((twice, labels), (twice.repartition(3), labels))]
    assert np.array_equal(named[0].scores(texts), named[1].scores(texts)) and named[0].constant is None


def test_too_many_languages_are_refused_early(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST", 5)
    df = spark.range(200).selectExpr("id AS doc_id", "'abc' AS text", "concat('l', id % 40) AS lang")
    with pytest.raises(ValueError):
        language.train(df)
