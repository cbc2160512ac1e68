"""Answers that outlive their job, rows of the same keys, requests sent once, failed rows of streams."""
import os
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.operators import dataset as D
from corpusflow.operators import infer as M
from corpusflow.plans import models
from corpusflow.sinks import calls
from corpusflow.streaming import streams as ST


def _logged(folder, kill=None):
    def fn(req):
        text = models._text_of(req["user"]).strip()
        if kill and kill in text:
            raise models.Killed()
        with open(os.path.join(folder, uuid.uuid4().hex), "w", encoding="utf-8") as f:
            f.write(text)
        return f"<{text}>"
    return fn


def _log(tmp_path, name="calls"):
    folder = tmp_path / name
    folder.mkdir()
    return str(folder)


def test_an_ended_job_keeps_its_answers(spark, tmp_path):
    table, log = str(tmp_path / "results"), _log(tmp_path)
    df = spark.createDataFrame([(i, f"row {i:03d}") for i in range(200)], "id long, t string").repartition(4, "id")
    with pytest.raises(Exception):
        M.infer_columns(df, ["id"], ["t"], "p", _logged(log, "row 150"), results_path=table, commit_rows=5, concurrency=1)
    reqs = M.column_requests(df, ["id"], ["t"], "p")
    schema = M.result_schema(reqs, ["id", M.ROW, "column"])
    kept = M.read_results(spark, table, schema).count()
    assert 0 < kept < 200
    before = len(os.listdir(log))
    out = {r.id: r.t_processed for r in M.infer_columns(df, ["id"], ["t"], "p", _logged(log), results_path=table).collect()}
    assert out == {i: f"<row {i:03d}>" for i in range(200)}
    assert len(os.listdir(log)) - before == 200 - kept
    M.infer_columns(df, ["id"], ["t"], "p", _logged(log), results_path=table).count()
    assert len(os.listdir(log)) - before == 200 - kept                     # nothing is left to ask
    M.infer_columns(df, ["id"], ["t"], "another prompt", _logged(log), results_path=table).count()
    assert len(os.listdir(log)) - before == 400 - kept                     # other requests


def test_a_second_attempt_adopts_the_first_ones_files(tmp_path):
    import base64

    from pyspark import cloudpickle
    log = _log(tmp_path)

    def writer(run, kill=None):
        model = base64.b64encode(cloudpickle.dumps((_logged(log, kill), models.no_sleep))).decode()
        return calls.CallWriter({"path": f"file:{tmp_path}/out", "run": run, "keys": "id", "concurrency": "2", "batch_size": "4", "commit_rows": "4", "adaptive": "False",
                                 "model": model})

    rows = pa.RecordBatch.from_pydict({"id": list(range(18)), "system": ["s"] * 18, "user": [f"\nr{i:02d}" for i in range(18)],
                                       "max_tokens": pa.array([None] * 18, pa.int64()), "stop": [[]] * 18})
    with pytest.raises(models.Killed):
        writer("a", "r13").write(iter([rows]))
    done = len(list((tmp_path / "out").glob("part-*")))
    asked = len(os.listdir(log))
    assert done == 3
    told = writer("a").write(iter([rows]))
    assert (told.rows, told.found) == (18, 12) and len(os.listdir(log)) == asked + 6
    writer("a").commit([told])
    assert sorted(x.name[:5] for x in (tmp_path / "out").iterdir()) == ["part-"] * 5
    assert writer("b").write(iter([rows])).found == 0                      # another run asks anew: failed rows are among its requests


def test_folder_of_an_unfinished_write_is_readable(spark, tmp_path):
    (tmp_path / "results" / "_temporary" / "0").mkdir(parents=True)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    out = M.infer_columns(df, ["id"], ["t"], "p", lambda r: r["user"][-1], results_path=str(tmp_path / "results"))
    assert sorted(r.t_processed for r in out.collect()) == ["a", "b"]


def test_rows_of_one_key_get_their_own_answers(spark, tmp_path):
    log = _log(tmp_path)
    rows = [(1, "a", "x"), (1, "bb", "x"), (None, "ccc", None), (None, "dddd", "y"), (2, "same", "z"), (2, "same", "z"), (3, None, "")]
    df = spark.createDataFrame(rows, "id long, t string, u string")
    out = M.infer_columns(df, ["id"], ["t", "u"], "p", _logged(log)).collect()
    mark = lambda v: f"<{v}>" if v else ""
    assert sorted(map(repr, map(tuple, out))) == sorted(repr((*r, mark(r[1]), mark(r[2]))) for r in rows)
    with pytest.raises(ValueError):
        M.infer_columns(df.withColumnRenamed("u", M.ROW), ["id"], ["t"], "p", _logged(log))


@pytest.mark.parametrize("share", [2.0, 0.1])      # no digest is salted; common ones are
def test_equal_requests_are_sent_once(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(M, "HOT_SHARE", share)
    log, table = _log(tmp_path), str(tmp_path / "answers")
    rows = [(i, "hot" if i % 3 else f"t{i % 12}", None if i % 5 else "hot") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t string, u string").repartition(5)
    for _ in range(2):
        out = M.infer_columns(df, ["id"], ["t", "u"], "p", _logged(log), distinct=True, results_path=table)
        assert sorted(map(tuple, out.collect())) == sorted((i, t, u, f"<{t}>", f"<{u}>" if u else "") for i, t, u in rows)
        assert len(os.listdir(log)) == len({r[1] for r in rows} | {"hot"})
    plain = M.infer_columns(df, ["id"], ["t", "u"], "p", _logged(log), distinct=True)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, out.collect()))
    with pytest.raises(ValueError):
        M.infer_columns(df, ["id"], ["t"], "p", _logged(log), distinct=True, done=df)


def test_segments_of_one_key_never_multiply(spark):
    segs = spark.createDataFrame([(1, "first"), (1, "second"), (1, "second"), (None, "third")], "doc_id long, content string")
    prompts = M.infer_writing_prompts(segs, ["doc_id"], lambda r: f"w{sum(map(ord, r['user']))}", sleep=models.no_sleep)
    got = sorted((repr(r.doc_id), r.assistant) for r in D.writing_samples(segs, ["doc_id"], prompts=prompts).collect())
    assert got == [("1", "first"), ("1", "second"), ("1", "second"), ("None", "third")]
    answers = {r.assistant: r.user for r in D.writing_samples(segs, ["doc_id"], prompts=prompts).collect()}
    assert len(set(answers.values())) == 3
    revisions = M.infer_revision_prompts(segs, ["doc_id"], lambda r: str(len(r["user"])), sleep=models.no_sleep)
    built = D.build_dataset(segs, ["doc_id"], [K.TASK_WRITING, K.TASK_REVISION], writing_prompts=prompts, revisions=revisions)
    assert built.groupBy("task_type").count().toPandas()["count"].tolist() == [4, 4]
    own = spark.createDataFrame([(1, "mine"), (1, "mine")], "doc_id long, user_prompt string")        # a user's table without the digest
    assert sorted(r.user for r in D.writing_samples(segs.filter("doc_id = 1"), ["doc_id"], prompts=own).collect()) == ["mine"] * 3


def test_failed_stream_rows_are_tried_again(spark, tmp_path):
    log = _log(tmp_path)
    df = spark.createDataFrame([(i % 4, f"t{i}") for i in range(12)], "id long, t string")
    for k in (1, 2, 3):
        df.write.parquet(str(tmp_path / f"in{k}"))
    (tmp_path / "res" / "run=x" / "batch_id=0" / "_temporary").mkdir(parents=True)

    good = _logged(log)

    def failing(req):
        if req["user"].endswith(("1", "5")):
            raise ConnectionError("down")
        return good(req)
    for k, fn in ((1, failing), (2, good), (3, good)):
        ST.infer_stream(spark, str(tmp_path / f"in{k}"), str(tmp_path / "res"), str(tmp_path / f"ck{k}"), df.schema, ["id"], ["t"], "p", fn,
                        sleep=models.no_sleep)
    out = ST.stream_results(spark, str(tmp_path / "res"), ["id"], ["t"])
    assert sorted((r.id, r.t, r.t_processed) for r in out.collect()) == sorted((i % 4, f"t{i}", f"<t{i}>") for i in range(12))
    assert len(os.listdir(log)) == 12
    assert spark.read.parquet(str(tmp_path / "res")).filter(F.startswith("t_processed", F.lit(K.FAILED))).count() == 3     # t1, t5, t11


def _crowded(most):
    """A service that refuses a call while ``most`` others run, in each worker."""
    import threading
    state = {"now": 0, "lock": None}

    class RateLimitError(Exception):
        pass

    def fn(req):
        import time
        state["lock"] = state["lock"] or threading.Lock()
        with state["lock"]:
            state["now"] += 1
            crowd = state["now"]
        try:
            if crowd > most:
                raise RateLimitError("slow down")
            time.sleep(0.004)
            return models._text_of(req["user"])
        finally:
            with state["lock"]:
                state["now"] -= 1
    return fn


def test_calls_slow_down_together(spark):
    """A service that bears two calls at once, asked by twelve threads: no row fails, and few calls are refused."""
    from corpusflow.operators import backoff
    df = spark.createDataFrame([(i, f"t{i}") for i in range(160)], "id long, t string").coalesce(1)
    out, results = M.infer_columns(df, ["id"], ["t"], "p", _crowded(2), concurrency=12, batch_size=160, sleep=models.no_sleep, adaptive=True, return_results=True)
    assert {r.t_processed for r in out.collect()} == {f"t{i}" for i in range(160)}
    worst, tries = results.agg(F.max("attempts"), F.sum("attempts")).first()
    assert results.filter("NOT ok").count() == 0 and worst <= backoff.REFUSALS + 1
    gate = backoff.Controller(8, models.no_sleep)
    gate.refused(gate.burst)
    gate.refused(0)                    # the same burst halves once
    assert gate.limit == 4.0
    gate.refused(gate.burst)
    for _ in range(40):
        gate.answered()
    assert 7 < gate.limit <= 8
