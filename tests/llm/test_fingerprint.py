import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpusflow.llm import fingerprint as fp, textkernel as tk
from corpusflow.session import ship_package

M = (1 << 64) - 1
POOL = ["ab", "c ", "é", "中文", " the", "\n", "zz", "0"]


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def poly(bs):
    return sum(int(tk._VALUE[b]) * pow(tk._BASE, i, 1 << 64) for i, b in enumerate(bs)) & M


def brute(text):
    """Byte by byte, window by window."""
    data = (text or "").encode()
    if not data:
        return "0::"
    levels = []
    for i in range(len(data)):
        window = data[max(0, i - fp.WINDOW + 1):i + 1]
        h = mix(poly(window) * pow(tk._BASE, fp.WINDOW - len(window), 1 << 64) & M)
        levels.append(64 if h == 0 else (h & -h).bit_length() - 1)
    levels[-1] = 99
    k = 0
    while sum(x >= k for x in levels) > fp.PIECES:
        k += 1
    signs = []
    for up in (k, k + 1):
        sign, start = "", 0
        for i, x in enumerate(levels):
            if x >= up:
                piece = data[start:i + 1]
                code = mix(poly(piece) + len(piece) * 0xD6E8FEB86659FD93 & M) >> 52
                sign += fp._DIGITS[code >> 6] + fp._DIGITS[code & 63]
                start = i + 1
        signs.append(sign)
    return f"{k}:{signs[0]}:{signs[1]}"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_likeness(x, y):
    if x == y:
        return 1.0
    (j, *a), (k, *b) = x.split(":"), y.split(":")
    best = 0.0
    for p, q in [(p, q) for u, p in enumerate(a) for v, q in enumerate(b) if int(j) + u == int(k) + v]:
        p, q = [p[i:i + 2] for i in range(0, len(p), 2)], [q[i:i + 2] for i in range(0, len(q), 2)]
        if p and q:
            need = min(fp.RUN, (min(len(p), len(q)) + 1) // 2)
            runs = {tuple(p[i:i + need]) for i in range(len(p) - need + 1)}
            if any(tuple(q[i:i + need]) in runs for i in range(len(q) - need + 1)):
                best = max(best, 1 - levenshtein(p, q) / max(len(p), len(q)))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(POOL), max_size=300).map("".join), max_size=6))
def test_fingerprints_equal_the_plain_way(texts):
    assert fp.fingerprints(texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_likeness_equals_plain_edit_distance(data):
    piece = st.sampled_from(["AA", "AB", "C0", "_-", "zz", "09"])
    sign = st.lists(piece, max_size=fp.PIECES).map("".join)
    one = st.tuples(st.integers(0, 3), sign, sign).map(lambda x: f"{x[0]}:{x[1]}:{x[2]}")
    pairs = data.draw(st.lists(st.tuples(one, one), min_size=1, max_size=8))
    got = fp.likeness([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == pytest.approx([brute_likeness(a, b) for a, b in pairs])


def test_windows_of_a_long_text(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choices(POOL, k=4000)), "a" * 5000, "abc " * 3000, "".join(map(chr, r.choices(range(0x4E00, 0x9000), k=2500)))]
    short = [fp.fingerprints([t])[0] for t in texts]
    monkeypatch.setattr(tk, "CHUNK", 997)
    assert [fp.fingerprints([t])[0] for t in texts] == short


def brute_rows(rows, hashed):
    """Rows of (doc_id, text) in their defined order, each against the next."""
    rows = sorted([(i, t or "") for i, t in rows], key=lambda x: (x[0] is not None, x[0] or 0, hashed[x[1]]))
    out = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        edited = t[:len(t) - q] + f[:q]
        a, b, c = brute(t), brute(edited), brute(f)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)))
    return sorted(out, key=repr)


def test_rows_of_every_kind(spark):
    from pyspark.sql import functions as F
    ship_package(spark)
    r = random.Random(7)
    rows = [(i, "".join(r.choices(POOL, k=r.choice([0, 1, 3, 40, 400])))) for i in range(-20, 60)]
    rows += [(None, "no id"), (None, None), (3, None), (4, ""), (5, rows[25][1]), (9, "same"), (9, "same"), (9, "other"), (200, "x" * 3000)]
    df = spark.createDataFrame([(*x, "e", 1) for x in rows], "doc_id long, text string, fingerprint string, part int").repartition(5)
    hashed = {x.t: x.h for x in df.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("h")).collect()}
    want = brute_rows(rows, hashed)
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = fp.edited_likeness(df).collect()
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        assert sorted([(*x[:5], round(x[5], 9), round(x[6], 9)) for x in got], key=repr) == want
    one = fp.edited_likeness(df.filter("doc_id = 200")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].near_edited == 1.0
    assert fp.edited_likeness(df.limit(0)).count() == 0


def test_columns(spark):
    ship_package(spark)
    df = spark.createDataFrame([(1, "some text that is long enough to be cut"), (2, None), (3, "")], "k int, text string")
    got = fp.with_fingerprint(df).withColumn("near", fp.fingerprint_likeness("fingerprint", "fingerprint")).orderBy("k").collect()
    assert [x.fingerprint for x in got] == [brute(x.text) for x in got] and [x.near for x in got] == [1.0] * 3


def test_edited_texts_stay_alike_and_others_not():
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=r.randint(60, 600))) for _ in range(60)]
    own, edited = fp.fingerprints(texts), fp.fingerprints([fp.edit_tail(t, f) for t, f in zip(texts, texts[1:] + texts[:1])])
    assert np.min(fp.likeness(own, edited)) > 0.4 and np.max(fp.likeness(own, own[1:] + own[:1])) < 0.1
