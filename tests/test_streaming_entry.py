import os

from corpusflow.operators import segment as G
from corpusflow.plans import models
from corpusflow.streaming import streams as ST


def _docs(spark, root, part, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{root}/in/p={part}")


def test_segment_stream_equals_batch_and_resumes(spark, tmp_path):
    root = str(tmp_path)
    rows1 = [(i, "\n\n".join("句" * (50 * (j + 1)) for j in range(i % 7))) for i in range(40)]
    _docs(spark, root, 1, rows1)
    schema = spark.read.parquet(f"{root}/in/p=1").schema
    ST.segment_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", schema, ["doc_id"])
    got = sorted(spark.read.parquet(f"{root}/out").collect())
    exp = sorted(G.segment(spark.createDataFrame(rows1, "doc_id long, text string"), "text", ["doc_id"]).collect())
    assert got == exp
    rows2 = [(100 + i, "新的一段。" * 60) for i in range(5)]
    _docs(spark, root, 2, rows2)
    ST.segment_stream(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", schema, ["doc_id"])
    assert spark.read.parquet(f"{root}/out").count() == len(exp) + 5


def test_infer_stream_replay_safe(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(i, 0, f"text {i}") for i in range(30)], "conv_id long, turn long, text string") \
        .write.parquet(f"{root}/in/p=1")
    schema = spark.read.parquet(f"{root}/in/p=1").schema
    for _ in range(2):  # the second run finds nothing new
        ST.infer_stream(spark, f"{root}/in", f"{root}/res", f"{root}/ckpt", schema, ["conv_id", "turn"], ["text"],
                        "请总结", models.echo_model, sleep=models.no_sleep)
    res = spark.read.parquet(f"{root}/res")
    assert res.count() == 30 and res.select("conv_id").distinct().count() == 30


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) == {"lang", "files", "segments", "chars", "avg_len"}
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_segment_stream_over_text_files(spark, tmp_path):
    from pyspark.sql import types as T
    root = str(tmp_path)
    os.makedirs(f"{root}/novels", exist_ok=True)
    body = "\n\n".join("段" * 150 for _ in range(5))
    for i in range(3):
        with open(f"{root}/novels/n{i}.txt", "w", encoding="utf-8") as f:
            f.write(body)
    schema = T.StructType([T.StructField("value", T.StringType())])
    ST.segment_stream(spark, f"{root}/novels", f"{root}/out", f"{root}/ckpt", schema, ["file_path"],
                      text="value", fmt="text", options={"wholetext": "true"})
    out = spark.read.parquet(f"{root}/out")
    assert out.select("file_path").distinct().count() == 3
    batch = G.segment(spark.createDataFrame([(1, body)], "doc_id long, text string"), "text", ["doc_id"])
    assert out.count() == 3 * batch.count()


def test_novel_stream_equals_batch(spark, tmp_path):
    """Encodings, newlines, byte-order marks, upper-case and blank-holding names; segments and samples."""
    from corpusflow.sources import corpus as C
    root = tmp_path / "novels"
    (root / "小说 一").mkdir(parents=True)
    body = "\r\n\r\n".join(f"第{i}段。" + "字" * 150 for i in range(9)) + "\r\n\u3000\r\n尾"
    for name, data in (("a+b.TXT", body.encode("gbk")), ("b.text", b"\xef\xbb\xbf" + body.encode()), ("c.txt", body.encode()), ("d.md", b"no")):
        (root / "小说 一" / name).write_bytes(data)
    ST.novel_stream(spark, str(root), str(tmp_path / "out"), str(tmp_path / "ck"))
    batch = G.segment(C.read_novels(spark, str(root)), "text", ["file_path"])
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(batch.collect()) and len({r.file_path for r in got}) == 3
    assert len({tuple(r.content for r in got if r.file_path == f) for f in {r.file_path for r in got}}) == 1
    ST.novel_stream(spark, str(root), str(tmp_path / "samples"), str(tmp_path / "ck2"), tasks=["续写"])
    assert set(spark.read.parquet(str(tmp_path / "samples")).columns) >= {"task_type", "user", "assistant"}


def test_two_checkpoints_share_one_result_folder(spark, tmp_path):
    """A second source with its own checkpoint adds rows, replaces none, and calls the model for new keys only."""
    log = tmp_path / "calls"
    log.mkdir()

    def model(req):
        import uuid
        (log / uuid.uuid4().hex).write_text("x")
        return req["user"][-3:]

    rows = spark.createDataFrame([(i, 0, f"text {i}") for i in range(30)], "conv_id long, turn long, text string")
    rows.write.parquet(str(tmp_path / "in1"))
    rows.filter("conv_id > 27").union(spark.createDataFrame([(100 + i, 0, "more") for i in range(5)], rows.schema)).write.parquet(str(tmp_path / "in2"))
    for k in (1, 2):
        ST.infer_stream(spark, str(tmp_path / f"in{k}"), str(tmp_path / "res"), str(tmp_path / f"ck{k}"), rows.schema, ["conv_id", "turn"], ["text"],
                        "请总结", model, sleep=models.no_sleep)
    res = spark.read.parquet(str(tmp_path / "res"))
    assert res.count() == 35 and res.select("conv_id").distinct().count() == 35
    assert len(list(log.iterdir())) == 35


def test_segment_stream_query_over_a_table_of_many_files(spark, tmp_path):
    """The documents as a folder of files give the rows that one file gives."""
    import shutil
    from corpusflow.plans import queries as Q
    rows = [(i % 11, "\n".join(f"line {i} {j} " * 9 for j in range(i % 13)) if i % 7 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "one-part"))
    (tmp_path / "one").mkdir()
    shutil.copy(next((tmp_path / "one-part").glob("part-*")), tmp_path / "one" / "documents.parquet")
    expected = sorted(Q.q_segments(spark, str(tmp_path / "many")).collect())
    assert len(expected) > 40
    for at in ("many", "one"):
        assert sorted(Q.q_segment_stream(spark, str(tmp_path / at)).collect()) == expected


def test_infer_stream_query_over_a_table_of_many_files(spark, tmp_path):
    """Every row once, also those that come again in a later file, have no keys or share them."""
    from corpusflow.plans import queries as Q
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "user", "other"), (None, None, "user", "no key"), (2, 1, None, None), (3, 0, "user", " ")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    for _ in range(3):
        conv.write.mode("append").parquet(str(tmp_path / "conversations.parquet"))
    got = [repr(tuple(r)) for r in Q.q_infer_stream(spark, str(tmp_path)).collect()]
    batch = [repr(tuple(r)) for r in Q.q_infer_columns(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(batch) and len(got) == 18
