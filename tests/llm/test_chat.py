import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st

from corpusflow.llm import chat
from corpusflow.session import ship_package

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]", "\x1b", "[", "<", "s>", "/INST]", " ", "ok", "é\n"]
texts = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[END]"]), texts), max_size=6), st.integers(1, 7))
def test_formatting_reads_back(turns, cut):
    """Whatever the texts hold and however the formatted text is cut, roles, texts and the loss mask come back."""
    m = chat.Marker(chat.Template())
    segments = [("<s>", False), *[s for role, text in turns for s in m.turn(role, text)]]
    for s, loss in segments[1:]:
        if loss:
            assert not m._control.search(s)
    pieces = [(s[i:i + cut], loss) for s, loss in segments for i in range(0, max(len(s), 1), cut)]
    for given_pieces in (segments, pieces):
        got = list(m.parse(iter(given_pieces)))
        assert [(r, t) for r, t, _ in got] == turns
        assert [x for _, _, x in got] == [t if r == "assistant" else "" for r, t in turns]


def test_overlapping_controls_are_refused():
    with pytest.raises(ValueError):
        chat.Template(begin="[INST").controls()


def brute(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_of_every_kind(spark):
    ship_package(spark)
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", None]), r.choice([None, "", "".join(r.choices(PIECES, k=6))]))
            for c in (1, 2, None) for t in range(20)]
    rows += [(4, None, "user", "x"), (4, 1, "assistant", "y"), (4, 1, "assistant", "y"), (5, 0, "user", "long " * 60_000), (5, 1, "assistant", "a" * 200_000)]
    rows += [(6, i, ("user", "assistant")[i % 2], f"turn {i} [INST]") for i in range(9000)]     # longer than a batch
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, loss string")
    out = chat.conversation_digests(chat.format_conversations(df, partitions=3))
    got = {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in out.collect()}
    assert got == brute(rows)
    assert chat.format_conversations(df.limit(0)).count() == 0
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_turn_order(spark):
    ship_package(spark)
    convs = {1: "system user assistant", 2: "user assistant user assistant", 3: "assistant", 4: "user user", 5: "user system", 6: "tool user"}
    df = spark.createDataFrame([(c, i, role, "t") for c, roles in convs.items() for i, role in enumerate(roles.split())],
                               "conv_id long, turn long, role string, text string")
    segments = chat.format_conversations(df)
    got = {x.conv_id: x.in_order for x in chat.conversation_digests(segments).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    text = "".join(x.segment for x in segments.filter("conv_id = 1").orderBy("seg_no").collect())
    assert text == "<s><<SYS>> t <</SYS>>[INST] t [/INST][ANS] t </s>"
    assert [x.segment for x in segments.filter("loss").filter("conv_id = 2").orderBy("seg_no").collect()] == ["t", "t"]
