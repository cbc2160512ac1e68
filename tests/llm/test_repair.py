import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from corpusflow.llm import repair as rp
from corpusflow.session import ship_package

LEGAL = re.compile("(s?(ua)+)?")
BLANK = " \t\n\x0b\f\r"


def brute_repair(rows):
    """rows: (role, text, fault).  Cheapest first over (cost, audit), with the initials so far as the only state."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, out
        if (i, initials) in seen or len(initials) > 2 * len(rows) + 4:
            continue
        seen.add((i, initials))
        steps = [(2, "I", i, r, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((3, "D", i + 1, None, None))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                steps.append((extra, "K", i + 1, role, (role, text)))
                steps += [(2 + extra, "R", i + 1, r, (r, text)) for r in ("user", "assistant")]
        for c, e, j, role, row in steps:
            longer = initials + (role[:1] if role is not None else "")
            if re.fullmatch("s?(ua)*u?", longer):
                heapq.heappush(heap, (cost + c, audit + e, j, longer, out + ((row,) if row else ())))


def brute(rows, damaged=True):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        sp = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20 if damaged else 9
        role, text = sp(role), sp(text)
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    out = {}
    for conv, found in convs.items():
        digest = lambda x: hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()[:40]
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(x)))
        seen, marked = set(), []
        for _, role, text in found:
            last = text.strip(BLANK)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [x[0] for x in found if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, fixed = brute_repair(marked)
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "useless"]), st.sampled_from([None, None, "truncated", "blank", "duplicate"])), max_size=7))
def test_search_equals_uniform_cost_search(rows):
    rows = [(r, "t", f) for r, f in rows]
    codes = bytes(rp.row_code(r[:1], f == "truncated", f in ("blank", "duplicate")) for r, _, f in rows)
    cost, audit = rp.cheapest(codes)
    want = brute_repair(rows)
    assert (cost, audit) == want[:2]
    got = [(role, row[1] if row else "") for _, row, role in rp.apply_audit(audit, iter(rows)) if role is not None]
    assert tuple(got) == want[2]


def test_all_short_conversations():
    for n in range(5):
        for rows in itertools.product(range(5), range(3), repeat=n) if n < 3 else random.Random(n).sample(list(itertools.product([0, 1, 2, 4, 6, 8, 9, 16], repeat=n)), 150):
            codes = bytes(4 * a + b for a, b in zip(rows[::2], rows[1::2])) if n < 3 else bytes(rows)
            named = [(["system", "user", "assistant", "", "tool"][c >> 2], "t", [None, "truncated", "blank"][c & 3]) for c in codes]
            assert rp.cheapest(codes) == brute_repair(named)[:2]


def test_a_long_conversation_is_proved_in_one_descent():
    r = random.Random(1)
    rows = bytes(r.choice([0, 4, 5, 8, 9, 10, 16]) for _ in range(60_000))
    cost, audit = rp.cheapest(rows)
    assert cost == rp.suffix_bounds(rows)[0][0] and sum(e != "I" for e in audit) == len(rows)


def collected(df):
    return {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired_sha256) for x in df.collect()}


def rows_of_every_kind():
    r = random.Random(11)
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Hello.", "Is it?", "cut off", "  \n", None, "", "done!  \t", "中文.", "dots . . ."]
    rows = [(c, r.choice([None, *range(6)]), r.choice(roles[:3] if c % 2 else roles), r.choice(texts)) for c in range(1, 60) for _ in range(r.randint(1, 7))]
    rows += [(None, t, "user", "q.") for t in (None, 1, 1, 2)] + [(None, 3, "assistant", "a" * 100_000)]
    rows += [(0, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(40)] + [(-3, None, "user", "only.")]
    dropped = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "all gone.")], dropped


def test_conversations_of_every_kind(spark):
    ship_package(spark)
    rows, dropped = rows_of_every_kind()
    rows = [x for x in rows if x[0] != 0] + [(0, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(7)]
    df = spark.createDataFrame([(*x, "x", 5) for x in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(3)
    got = collected(rp.repair_digests(rp.damage(df)))
    assert got == brute(rows)
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert collected(rp.repair_digests(rp.as_found(df))) == brute(rows, damaged=False)
    assert rp.repair_digests(rp.damage(df.limit(0))).count() == 0


def test_repaired_rows(spark):
    ship_package(spark)
    rows, _ = rows_of_every_kind()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    fixed = rp.repaired(rp.damage(df)).orderBy("conv_id", "place").collect()
    digests = collected(rp.repair_digests(rp.damage(df)))
    for conv, g in itertools.groupby(fixed, key=lambda x: x.conv_id):
        g = list(g)
        assert [x.place for x in g] == list(range(len(g))) and LEGAL.fullmatch("".join(x.role[:1] for x in g))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in g).encode()).hexdigest() == digests[conv][-1]
