"""Streams that remember in keyed state, and the table of their progress."""
import os
import uuid

import pytest
from pyspark.sql import functions as F

from corpusflow.plans import models
from corpusflow.streaming import metrics as X
from corpusflow.streaming import stateful as S

SCHEMA = "id long, t string"


def _logged(folder, fails=()):
    def fn(req):
        text = models._text_of(req["user"])
        with open(os.path.join(folder, uuid.uuid4().hex), "w", encoding="utf-8") as f:
            f.write(text)
        if text in fails:
            raise ValueError("down")
        return f"<{text}>"
    return fn


def _run(spark, root, fn, **kw):
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{root}/in")
    q = S.infer_state_stream(spark, src, f"{root}/res", f"{root}/ck", ["id"], ["t"], "p", fn, buckets=2, sleep=models.no_sleep, **kw)
    q.awaitTermination()
    return q


def _deliver(spark, root, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def test_rows_are_asked_until_answered(spark, tmp_path):
    root, log = str(tmp_path), str(tmp_path / "calls")
    os.makedirs(log)
    first = [(i % 5 if i else None, f"t{i}") for i in range(12)] + [(1, "  "), (1, None)]
    _deliver(spark, root, first)
    _run(spark, root, _logged(log, ("t3", "t4")))
    out = {r.result for r in S.answers(spark, f"{root}/res").filter("ok").collect()}
    assert out == {f"<t{i}>" for i in range(12) if i not in (3, 4)} and len(os.listdir(log)) == 14     # two tries of a failure
    # the same rows again, and others: answered ones aren't asked, failed ones are
    _deliver(spark, root, first[:3] + [(9, f"new{i}") for i in range(8)])
    _run(spark, root, _logged(log))
    got = S.processed(spark.createDataFrame(first, SCHEMA), S.answers(spark, f"{root}/res"), ["id"], ["t"], "p").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, t, f"<{t}>" if t and t.strip() else "")) for i, t in first)
    assert len(os.listdir(log)) == 14 + 2 + 8
    asked = {r.result: r.asked for r in S.answers(spark, f"{root}/res").collect()}
    assert asked["<t3>"] == asked["<t4>"] == 2 and asked["<t5>"] == 1


def test_a_row_that_always_fails_is_given_up(spark, tmp_path):
    root, log = str(tmp_path), str(tmp_path / "calls")
    os.makedirs(log)
    for k in range(6):
        _deliver(spark, root, [(k, f"x{k}-{i}") for i in range(6)] + [(0, "bad")])
    _run(spark, root, _logged(log, ("bad",)), attempts=3)
    bad = S.answers(spark, f"{root}/res").filter("NOT ok").collect()
    assert len(bad) == 1 and bad[0].asked == 3 and S.answers(spark, f"{root}/res").count() == 37
    assert sum(open(os.path.join(log, f)).read() == "bad" for f in os.listdir(log)) == 6


def test_progress_of_many_batches(spark, tmp_path):
    """More batches than Spark remembers: the table's totals are the rows', and what the plan observed."""
    (tmp_path / "in").mkdir()
    for i in range(150):
        (tmp_path / "in" / f"{i:03d}.txt").write_text("line\n" * (i % 7 + 1), encoding="utf-8")
    with X.recorded(spark, str(tmp_path / "progress"), every=40) as wait:
        src = spark.readStream.schema("value string").option("maxFilesPerTrigger", "1").text(str(tmp_path / "in"))
        seen = src.observe("lines", F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))
        q = seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        wait(q)
    rows = sum(i % 7 + 1 for i in range(150))
    table = X.read_progress(spark, str(tmp_path / "progress"))
    got = X.rates(table).collect()
    assert len(got) == 1 and (got[0].batches, got[0].rows) == (150, rows) and got[0].rows_per_s > 0
    assert {r.figure: r.total for r in X.observed_totals(table).collect()} == {"n": rows, "chars": 4.0 * rows}
    assert len(q.recentProgress) <= 100 and len(os.listdir(tmp_path / "progress")) == 4
