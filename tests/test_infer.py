import os
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.operators import infer as M
from corpusflow.operators import report as R


class RateLimitError(Exception):
    pass


def _counting_model(log_dir):
    def fn(req):
        with open(os.path.join(log_dir, uuid.uuid4().hex), "w", encoding="utf-8") as f:
            f.write(req["user"])
        return "  " + req["user"][-5:].upper() + "  "
    return fn


def test_policy_kinds():
    calls = []

    def sleeper(s):
        calls.append(s)

    def conn(_):
        raise ConnectionError("down")
    res, ok, att, kind = M.call_with_policy(conn, {}, sleep=sleeper)
    assert (ok, att, kind) == (False, 4, "connection") and res == "处理失败: 连接错误 - down (已重试3次)"
    assert calls == [2, 4, 8]
    calls.clear()

    def rate(_):
        raise RateLimitError("slow down")
    res, ok, att, kind = M.call_with_policy(rate, {}, sleep=sleeper)
    assert res.startswith("处理失败: 速率限制") and calls == [5, 10, 15]
    calls.clear()

    state = {"n": 0}

    def flaky(_):
        state["n"] += 1
        if state["n"] == 1:
            raise ValueError("once")
        return " fine "
    assert M.call_with_policy(flaky, {}, sleep=sleeper) == ("fine", True, 2, None)
    assert calls == [2]

    def bad(_):
        raise ValueError("always")
    assert M.call_with_policy(bad, {}, sleep=sleeper)[:3] == ("处理失败: always", False, 2)


def test_infer_columns_once_per_key(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    rows = [(1, "alpha text", None), (2, "   ", "second col"), (3, None, "x" * 12000), (4, "delta", "")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    out, res = M.infer_columns(df, ["id"], ["a", "b"], "请总结", _counting_model(str(log)),
                               sleep=lambda s: None, return_results=True)
    got = {r.id: (r.a_processed, r.b_processed) for r in out.collect()}
    out.count()
    res.count()
    assert len(os.listdir(log)) == 4          # non-blank cells only, and only once
    assert got[1] == ("TEXT", "")
    assert got[2] == ("", "D COL")
    assert got[4] == ("DELTA", "")
    long_user = [open(log / f, encoding="utf-8").read() for f in os.listdir(log)]
    assert any(u.endswith("...[文本过长，已截断]") for u in long_user)
    assert all(u.startswith(K.USER_TEMPLATE_HEAD + "请总结" + K.USER_TEMPLATE_MID) for u in long_user)
    with pytest.raises(ValueError):
        M.infer_columns(df, ["id"], ["zzz"], "p", _counting_model(str(log)))


def test_resume_calls_only_missing(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, t string")
    _, done = M.infer_columns(df.filter("id < 8"), ["id"], ["t"], "p", _counting_model(str(log)),
                              return_results=True)
    done.count()
    first = len(os.listdir(log))
    full = M.infer_columns(df, ["id"], ["t"], "p", _counting_model(str(log)), done=done)
    vals = {r.id: r.t_processed for r in full.collect()}
    assert first == 8 and len(os.listdir(log)) == 20
    assert all(v and not v.startswith(K.FAILED) for v in vals.values())


def test_never_reached_rows_marked_failed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, " ")], "id long, t string")
    partial = spark.createDataFrame([(1, "t", "done")], "id long, column string, result string")
    out = {r.id: r.t_processed for r in M.join_results(df, partial, ["id"], ["t"]).collect()}
    assert out == {1: "done", 2: K.FAILED, 3: ""}


def test_ordinal_matches_row_number_with_a_hot_file(spark):
    rows = [("hot", i, "x" if i % 3 else " ") for i in range(3000)] + [(f"f{j}", i, "y") for j in range(5) for i in range(7)]
    df = spark.createDataFrame(rows, "file string, row_no long, t string")
    got = M.assign_batches(df, ["file"], ["row_no"], coarse=[F.floor(F.col("row_no") / 1000)],
                           fine=[F.floor(F.col("row_no") / 100)], text="t", size=10)
    w = Window.partitionBy("file").orderBy("row_no")
    sel = df.filter(F.length(F.trim("t")) > 0).withColumn("n", F.row_number().over(w))
    exp = {(r.file, r.row_no): r.n for r in sel.collect()}
    for r in got.collect():
        assert r.item_no == exp.get((r.file, r.row_no))
        if r.item_no is not None:
            assert r.batch_no == (r.item_no - 1) // 10


def test_outcome_and_quality_reports(spark):
    res = spark.createDataFrame([("c", ""), ("c", "处理失败: x"), ("c", "ok"), ("c", "本次失败"), ("c", "错误")],
                                "column string, result string")
    o = {r.column: r for r in R.outcome_stats(res).collect()}
    assert (o["c"].items, o["c"].success, o["c"].failed) == (5, 3, 2)
    assert o["c"].success + o["c"].failed == o["c"].items
    q = R.quality_report(res).first()
    assert (q.rows, q.empty, q.error, q.valid) == (5, 1, 3, 1)
    assert abs(q.valid_pct + q.error_pct + q.empty_pct - 100) < 1e-9
    empty = R.outcome_stats(spark.createDataFrame([], "column string, result string")).collect()
    assert all(r.success_pct is None for r in empty)


def test_writing_and_revision_fallbacks(spark):
    segs = spark.createDataFrame([(1, "Evening falls."), (2, "Morning comes.")], "k long, content string")

    def model(req):
        if "Evening" in req["user"]:
            raise ValueError("model down")
        return "   "
    w = {r.k: r.user_prompt for r in M.infer_writing_prompts(segs, ["k"], model, extra=" 额外 ",
                                                              sleep=lambda s: None).collect()}
    assert w == {1: "额外", 2: "额外"}
    rev = M.infer_revision_prompts(segs, ["k"], model, sleep=lambda s: None)
    assert {r.k: (r.request, r.original, r.model_ok) for r in rev.collect()} == {1: (None, None, False), 2: (None, None, True)}
    from corpusflow.operators import dataset as D
    users = {r.k: r.user for r in D.revision_samples(segs, ["k"], revisions=rev).collect()}
    plain = {r.k: r.user for r in D.revision_samples(segs, ["k"]).collect()}
    assert users == plain and "Evening falls." in users[1]


def test_whole_table_is_numbered_without_one_task(spark):
    df = spark.createDataFrame([(i % 97, i, " " if i % 5 == 0 else "x") for i in range(4000)], "a long, b long, t string").repartition(6)
    got = {(r.a, r.b): (r.item_no, r.batch_no) for r in M.assign_batches(df, [], ["a", "b"], [], [], "t", 10).collect()}
    want = {k: (n + 1, n // 10) for n, k in enumerate(sorted((i % 97, i) for i in range(4000) if i % 5))}
    assert got == {(i % 97, i): want.get((i % 97, i), (None, None)) for i in range(4000)}


def test_model_samples_segment_once(spark):
    """The samples' plan reads stored segments: it holds no fold."""
    from corpusflow.plans import queries as Q
    import os
    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        for q in (Q.q_writing_samples_model, Q.q_revision_samples_model):
            assert "aggregate(" not in q(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_failed_rows_are_tried_again(spark, tmp_path):
    """A results table left by a run that failed halfway; a new run calls only for what has no good result."""
    log = tmp_path / "calls"
    log.mkdir()
    df = spark.createDataFrame([(i, f"text {i}") for i in range(12)] + [(None, "null key")], "id long, t string")
    table, good = str(tmp_path / "results"), _counting_model(str(log))

    def half(req):
        if int(req["user"][-1], 36) % 2:
            raise ValueError("down")
        return good(req)
    first = M.infer_columns(df, ["id"], ["t"], "p", half, sleep=lambda s: None, results_path=table, increments=3)
    failed = {r.id for r in first.collect() if r.t_processed.startswith(K.FAILED)}
    calls = len(os.listdir(log))
    assert 0 < len(failed) < 13 and calls == 13 - len(failed)
    again = {r.id: r.t_processed for r in M.infer_columns(df, ["id"], ["t"], "p", good, results_path=table).collect()}
    assert len(os.listdir(log)) == 13 and len(again) == 13 and not any(v.startswith(K.FAILED) for v in again.values())
    M.infer_columns(df, ["id"], ["t"], "p", good, results_path=table).collect()
    assert len(os.listdir(log)) == 13
    twice = spark.createDataFrame([(1, "t", "old"), (1, "t", "new"), (2, "t", K.FAILED)], "id long, column string, result string")
    out = {r.id: r.t_processed for r in M.infer_columns(df.filter("id < 3"), ["id"], ["t"], "p", lambda r: "fresh", done=twice).collect()}
    assert out[0] == out[2] == "fresh" and out[1] in ("old", "new")


def test_infer_corpus_over_mixed_files(spark, tmp_path):
    """Columns by header, not by content; unreadable kinds in the outcome; every row of a good file processed."""
    from corpusflow.sources import corpus as C
    root = tmp_path / "c"
    root.mkdir()
    (root / "a.csv").write_text("text,other\nhello,1\nworld,2\n", encoding="utf-8")
    (root / "b.csv").write_text("name;other\nx;3\n", encoding="utf-8")
    (root / "空 列.csv").write_bytes("other,text\n4,\n5,\n".encode("gbk"))
    (root / "head.csv").write_text("text,other\n", encoding="utf-8")
    (root / "n.txt").write_text("a line\n", encoding="utf-8")
    (root / "bad.md").write_bytes("段落".encode("gbk"))
    (root / "r.pdf").write_bytes(b"%PDF")
    rows, excluded = C.read_corpus(spark, str(root))
    files = C.corpus_files(spark, str(root))
    out, outcome = M.infer_corpus(rows, ["text"], "p", lambda r: r["user"][-5:], files=files, sleep=lambda s: None)
    status = {r.file_path.rsplit("/", 1)[-1]: (r.status, r.reason) for r in outcome.collect()}
    assert status == {"a.csv": ("processed", None), "b.csv": ("failed", "missing columns: text"), "空 列.csv": ("processed", None),
                      "head.csv": ("processed", None), "n.txt": ("failed", "missing columns: text"), "bad.md": ("failed", "undecodable")}
    assert sorted(r.text_processed for r in out.collect()) == ["", "", "hello", "world"]
    counts = {r.status: r.files for r in R.corpus_outcome(outcome).collect()}
    assert counts == {"processed": 3, "failed": 3, "__total__": 6}
    assert {r.path.rsplit("/", 1)[-1]: r.reason for r in excluded.collect()} == {"bad.md": "undecodable", "r.pdf": "unsupported type", "head.csv": "empty"}
    profile = {r.file_path.rsplit("/", 1)[-1]: (r.type, r.rows, r.columns) for r in R.file_profile(files).collect()}
    assert profile == {"a.csv": (".csv", 2, 2), "b.csv": (".csv", 1, 2), "空 列.csv": (".csv", 2, 2), "head.csv": (".csv", 0, 2), "n.txt": (".txt", 1, 1)}


def test_throughput_report(spark):
    res = spark.createDataFrame([("t", 0.0, 1.0), ("t", 0.5, 2.0), ("t", 1.0, 4.0)],
                                "column string, started_at double, finished_at double")
    both = {r.column: r for r in R.throughput(res, total={"t": 6, "u": 4}).collect()}
    assert both["__total__"].remaining == 7 and both["__total__"].pct_done == 30.0
    r = both["t"]
    assert (r.done, r.span_s, r.items_per_s, r.remaining) == (3, 4.0, 0.75, 3)
    assert r.eta_s == 4.0 and r.pct_done == 50.0


def test_filter_report(spark):
    files = spark.createDataFrame([(f"/d/f{i:02d}.txt", i % 4 != 0) for i in range(25)], "path string, matched boolean")
    rep = R.filter_report(files).first()
    assert (rep.total, rep.matched, rep.more) == (25, 18, 8)
    assert rep.first_names == [f"f{i:02d}.txt" for i in range(25) if i % 4 != 0][:10]
