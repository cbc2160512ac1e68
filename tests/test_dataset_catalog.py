import json

import pytest
from pyspark.sql import functions as F

from corpusflow import constants as K
from corpusflow.operators import catalog as P
from corpusflow.operators import dataset as D
from pyrules import split_choice

SEG = "她走进房间。" * 30 + "窗外下着雨！" * 10


@pytest.fixture()
def segs(spark):
    rows = [(1, 1, SEG), (1, 2, "短段落。"), (2, 1, "第二篇。" * 40)]
    return spark.createDataFrame(rows, "doc_id long, seg_no long, content string")


def test_continuation_sample_text(spark, segs):
    out = {(r.doc_id, r.seg_no): r for r in D.continuation_samples(segs, ["doc_id", "seg_no"], extra=" 加快节奏 ").collect()}
    assert (1, 2) not in out  # shorter than 100 characters
    first, second = split_choice(SEG)
    r = out[(1, 1)]
    shown = first[:200] + "..." if len(first) > 200 else first
    assert r.user == f"请续写以下段落：\n\n『{shown}』\n\n续写要求：加快节奏"
    assert r.assistant == second
    assert r.system == K.SYSTEM_DEFAULT[K.TASK_CONTINUATION]


def test_build_dataset_one_pass_and_counts(spark, segs):
    ds = D.build_dataset(segs, ["doc_id", "seg_no"])
    counts = {r.task_type: r.samples for r in D.dataset_counts(ds).collect()}
    assert counts == {"写作": 3, "修改": 3, "续写": 2, "__total__": 8}
    rev = ds.filter(F.col("task_type") == "修改").orderBy("doc_id", "seg_no").first()
    assert rev.user == f"请根据以下要求优化这段文本：\n\n要求：{K.REVISION_FALLBACK}\n\n文本：\n『{SEG}』"
    # one scan: a single generator, no union in the plan
    plan = ds._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Generate" in plan


def test_tasks_validated(spark, segs):
    with pytest.raises(ValueError):
        D.build_dataset(segs, ["doc_id", "seg_no"], tasks=[])
    with pytest.raises(ValueError):
        D.build_dataset(segs, ["doc_id", "seg_no"], tasks=["翻译"])


def test_jsonl_is_valid_json(spark, segs):
    ds = D.build_dataset(segs, ["doc_id", "seg_no"], system="  ")
    for r in ds.select(D.to_jsonl(D.to_messages()).alias("j"), "task_type").collect():
        obj = json.loads(r.j)
        assert [m["role"] for m in obj["messages"]] == ["system", "user", "assistant"]
        assert obj["messages"][0]["content"] == K.SYSTEM_DEFAULT[r.task_type]
        assert "\\u" not in r.j or "\\u00" in r.j  # CJK stays unescaped


def test_prompt_only_and_legacy(spark, segs):
    x = segs.select("content", F.explode(F.array(*[F.lit(t) for t in K.DATASET_TASKS])).alias("task"))
    rows = x.select("task", D.prompt_only_messages("content", "task", extra="").alias("m"),
                    D.legacy_user_content("task", "content").alias("legacy"), "content").collect()
    for r in rows:
        assert len(r.m) == 2 and r.m[0].content == K.PROMPT_ONLY_SYSTEM
        if r.task == "续写":
            assert r.m[1].content == f"请续写以下段落：\n\n『{r.content}』"
            assert r.legacy == f"请续写以下段落：\n\n『{r.content[:200]}...』"
        elif r.task == "写作":
            assert r.m[1].content == K.PROMPT_ONLY_WRITING_FALLBACK


def test_resolve_and_attach_tasks(spark):
    cat = P.resolve_tasks(spark, overrides={"文本摘要": "新的摘要要求", "新任务": "做点别的"})
    got = {r.task: (r.prompt, r.is_default) for r in cat.collect()}
    assert got["文本摘要"] == ("新的摘要要求", True)
    assert got["新任务"] == ("做点别的", False)
    assert got["格式化"][0] == K.DEFAULT_TASKS["格式化"]
    rows = spark.createDataFrame([(1, "新任务"), (2, "格式化")], "id int, task string")
    out = {r.id: r.prompt for r in P.attach_task(rows, cat, task_col="task").collect()}
    assert out == {1: "做点别的", 2: K.DEFAULT_TASKS["格式化"]}
    with pytest.raises(ValueError):
        P.attach_task(rows.drop("task"), cat, name="不存在")
    with pytest.raises(Exception, match="unknown or empty task: 不存在"):
        P.attach_task(spark.createDataFrame([(1, "不存在")], "id int, task string"), cat, task_col="task").collect()


def test_names_saved_twice_do_not_multiply_rows(spark):
    saved = spark.createDataFrame([(0, "新任务", "旧", "saved"), (1, "新任务", "新", "saved")], "pos int, task string, prompt string, origin string")
    cat = P.resolve_tasks(spark, overrides=saved)
    rows = spark.createDataFrame([(1, "新任务"), (2, "新任务")], "id int, task string")
    assert sorted((r.id, r.prompt) for r in P.attach_task(rows, cat, task_col="task").collect()) == [(1, "新"), (2, "新")]


def test_task_file(spark, tmp_path):
    p = tmp_path / "tasks.json"
    p.write_text(json.dumps({"方言": "转换方言", "文本摘要": "覆盖"}, ensure_ascii=False), encoding="utf-8")
    cat = P.resolve_tasks(spark, overrides=P.read_task_file(spark, str(p)))
    got = {r.task: r.prompt for r in cat.collect()}
    assert got["方言"] == "转换方言" and got["文本摘要"] == "覆盖"


def test_reverse_prompts_shadow_and_pick(spark):
    custom = {"小说续写": {"情节延续": "自定义", "多行": "一\n\n  二  \n三"}}
    resolved = P.resolve_reverse_prompts(P.reverse_table(spark, custom))
    rows = spark.createDataFrame([("小说续写", "情节延续"), ("小说续写", "多行"), ("小说写作", "无此类")],
                                 "task_type string, category string")
    got = {r.category: r.reverse_prompt for r in P.lookup_reverse_prompt(rows, resolved).collect()}
    assert got["情节延续"] == K.PREDEFINED_REVERSE_PROMPTS["小说续写"]["情节延续"]
    assert got["无此类"] == ""
    picks = spark.range(200).select(P.pick_template(F.lit("一\n\n  二  \n三"), "s", "id").alias("t")).collect()
    assert {r.t for r in picks} == {"一", "二", "三"}
    once = spark.range(50).select(P.pick_template(F.lit("一\n二"), "s").alias("t")).distinct().count()
    assert once == 1
    empty = spark.range(1).select(P.pick_template(F.lit(""), "s").alias("t"), P.pick_template(F.lit("  "), "s").alias("u")).first()
    assert empty.t == "" and empty.u == "  "
    cats = [r.category for r in P.list_categories(P.reverse_table(spark, custom), "小说续写").collect()]
    assert cats[:6] == list(K.PREDEFINED_REVERSE_PROMPTS["小说续写"]) and cats[6:] == ["情节延续", "多行"]
    lines = P.describe_templates(P.reverse_table(spark), "小说写作").collect()
    assert len(lines) == 7 and all(r.line.startswith("• ") and r.line.endswith("...") for r in lines)
