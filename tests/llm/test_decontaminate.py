import hashlib
import random
import re

import pytest

from corpusflow.llm import decontaminate

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, t in items:
            b = words(t)
            n = min(10, len(b))
            wins = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i:i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(item_id)
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc_id, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(d, b).collect()], key=str)


def cases():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["É", "straße", "x1"]
    line = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, line(r.randint(10, 40))) for i in range(12)]
    items += [(50, "alpha beta"), (51, "Gamma"), (52, "one two three four five six seven"), (53, None), (54, "--- !"), (55, items[0][1]), (56, items[1][1].upper()),
              (None, "null item words"), (57, "rep rep rep rep rep rep rep rep rep rep rep rep"), (2, "second text of item two here")]
    docs = [(i, line(r.randint(0, 80))) for i in range(30)]
    docs += [(100 + i, line(5) + ", " + items[i][1].replace(" ", "--") + ". " + line(7)) for i in range(12)]
    docs += [(200, " ".join(items[3][1].split()[4:16])), (201, " ".join(items[3][1].split()[:9])), (202, "x alpha BETA y gamma"), (203, "alpha x beta"),
             (204, "one two three four five six seven eight"), (205, None), (206, ""), (207, "null item words"), (208, "rep " * 30), (209, " ".join(t or "" for _, t in items)),
             (210, "second text of item two here"), (210, "second text of item two here"), (210, "another text"), (None, items[2][1]), (211, (line(50) + " ") * 400)]
    return docs, items


@pytest.mark.parametrize("block, wins", [(1_000_000, 100_000), (40, 0)])
def test_equals_every_window(spark, monkeypatch, block, wins):
    """Also with a benchmark far beyond what one broadcast may hold."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "WINDOWS", wins)
    docs, items = cases()
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, docs[-5:], []) == brute(docs[-5:], [])
    assert run(spark, docs[-5:], [(1, None), (2, " ")]) == brute(docs[-5:], [])
    assert run(spark, [], items) == []


def test_dropping(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "kept") for x in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.drop_contaminated(d, b)
    assert out.columns == ["doc_id", "text", "n_hit"]
    want = [x for x in docs if not brute([x], items)[0][5]]
    assert sorted([(x.doc_id, x.text) for x in out.collect()], key=str) == sorted(want, key=str)


def test_plan_is_native(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    plan = decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
