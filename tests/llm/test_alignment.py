import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from corpusflow.llm import alignment as al
from corpusflow.llm.queries import tokenizer_path
from corpusflow.session import ship_package

FILES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
POOL = ["the", " quick", "  ", "\n", "\t", "é", "中文", "🙂", "<|endoftext|>", "<s>", "don't", " 12345", "ﬁ", "­", "...", " supercalifragil", "x"]


@pytest.fixture(scope="module")
def pair():
    return al.Pair.of(al.read_files(*FILES))


def tokens(pair, text):
    """(A ids, B ids) straight from the libraries, or none."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders
    if not text:
        return [], []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    raw = (" " + text).encode()
    ok = b"".join(pair.bytes_a[i] for i in a) == raw and b"".join(pair.bytes_b[i] for i in b) == raw
    return (a, b) if ok else ([], [])


def brute(pair, texts):
    """Byte by byte."""
    made, count = [], Counter()
    for t in texts:
        a, b = tokens(pair, t)
        own_a = [i for i, x in enumerate(a) for _ in pair.bytes_a[x]]
        own_b = [i for i, x in enumerate(b) for _ in pair.bytes_b[x]]
        links = {(i, j) for i, j in zip(own_a, own_b)}
        groups, at = [], [0, 0]
        for k in range(len(own_a)):
            last = k + 1 == len(own_a)
            if last or (own_a[k] != own_a[k + 1] and own_b[k] != own_b[k + 1]):
                groups.append((a[at[0]:own_a[k] + 1], b[at[1]:own_b[k] + 1]))
                at = [own_a[k] + 1, own_b[k] + 1]
        made.append((a, b, links, groups))
        count.update((a[i], b[j]) for i, j in links)
    best = defaultdict(int)
    for (x, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for a, b, links, groups in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[a[i], b[j]] == best[b[j]] for i, j in links),
                    sum(count[a[i], b[j]] for i, j in links), hashlib.sha256(text.encode()).hexdigest() if a else "",
                    sum(len(x) * len(y) for x, y in groups)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.integers(1, 7), st.integers(0, 2**32), st.integers(1, 40))
def test_product_equals_dense(n, k, m, seed, block):
    r = np.random.default_rng(seed)
    dense = [r.integers(0, 3, s) * r.integers(0, 2, s) for s in ((n, k), (k, m))]
    made = [al.Csr(np.concatenate([[0], np.cumsum((d != 0).sum(axis=1))]), np.nonzero(d)[1], d[np.nonzero(d)], d.shape[1]) for d in dense]
    old, al.PRODUCTS = al.PRODUCTS, block
    try:
        got = al.product(*made)
    finally:
        al.PRODUCTS = old
    out = np.zeros((n, m), np.int64)
    out[got.row_of_entries(), got.indices] = got.data
    assert (out == dense[0] @ dense[1]).all()
    t = al.transpose(made[0])
    back = np.zeros((k, n), np.int64)
    back[t.row_of_entries(), t.indices] = t.data
    assert (back == dense[0].T).all()


def test_byte_tables_are_the_libraries(pair):
    assert pair.cuts
    text = " " + "".join(POOL) * 3
    for i in pair.a.encode(text, add_special_tokens=False).ids:
        if b"\xef\xbf\xbd" not in pair.a.decode([i]).encode():
            assert pair.bytes_a[i] == pair.a.decode([i]).encode()
    assert pair.a.token_to_id("<|endoftext|>") not in pair.a.encode("<|endoftext|>", add_special_tokens=False).ids


def test_long_texts_in_pieces(pair, monkeypatch):
    r = random.Random(2)
    text = " ".join("".join(r.choices(POOL, k=3)) for _ in range(4000)) + " " + "unbroken" * 3000
    want = tokens(pair, text)
    monkeypatch.setattr(al, "CHUNK", 200)
    parts = pair.pieces(text)
    assert len(parts) > 50 and "".join(parts) == text
    coded = pair.encode([(p, k == 0) for k, p in enumerate(parts)])
    assert coded.good.all() and coded.a.tolist() == want[0] and coded.b.tolist() == want[1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(POOL + ["a", " b", "\u0301", "Ⅷ", "ª b", "'s", " ", "_ x"]), max_size=25).map("".join), min_size=1, max_size=4))
def test_parts_of_texts_have_the_libraries_tokens(texts):
    pair = al.Pair.of(al.read_files(*FILES))
    coded = pair.encode([(t, True) for t in texts])
    for i, t in enumerate(texts):
        a, b = (x[f[i]:f[i + 1]].tolist() for x, f in ((coded.a, coded.first_a), (coded.b, coded.first_b)))
        assert (a, b) == tokens(pair, t) and coded.good[i] == bool(a)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]


def test_documents_of_every_kind(spark, pair, monkeypatch):
    ship_package(spark)
    r = random.Random(4)
    texts = ["".join(r.choices(POOL, k=r.choice([1, 3, 30, 300]))) for _ in range(80)]
    texts += [None, "", " ", "▁", "a▁b", "　", "same text", "same text", "word " * 20_000, "z" * 30_000]
    ids = [None if i == 5 else i // 2 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, 1, "p") for i, t in zip(ids, texts)], "doc_id long, text string, pack int, pair string").repartition(3)
    rows = brute(pair, texts)
    want = sorted([(i, *row) for i, row in zip(ids, rows)], key=repr)
    out = al.alignment_digests(df, *FILES)
    assert sorted([(x.doc_id, *[x[c] for c in COLUMNS]) for x in out.collect()], key=repr) == want
    assert al.alignment_digests(df.limit(0), *FILES).count() == 0


def test_small_packs_and_pieces_give_the_same(spark, pair, monkeypatch):
    r = random.Random(9)
    texts = [" ".join(r.choices(["red", "green", "blue", "éa", "中", "7"], k=400)) for _ in range(30)] + ["a▁b " * 500, None]
    rows = brute(pair, texts)
    for name, size in (("CHUNK", 100), ("BLOCK", 300), ("REMEMBER", 60), ("ENTRIES", 50), ("DOCS", 4)):
        monkeypatch.setattr(al, name, size)
    batch = __import__("pyarrow").RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    held, packs = al._Pack(pair), []
    for block in al._blocks(pair, iter([batch])):
        held.add(block)
        if block[-1][3] and held.full():
            packs += list(held.batches(len(packs)))
            held.clear()
    packs += list(held.batches(len(packs))) if held.docs else []
    count = Counter()
    for b in packs:
        if b.column(0)[0].as_py() == 1:
            count.update(dict(zip(b.column(2).to_pylist(), b.column(3).to_pylist())))
    docs = [b for b in packs if b.column(0)[0].as_py() == 2]
    assert len(docs) > 3
    got = [tuple(x) for b in docs for x in zip(*[b.column(i)[0].as_py() for i in range(5, 12)])]
    assert [(g[1], g[2], g[3], g[4], g[6], g[5]) for g in got] == [(w[0], w[1], w[2], w[3], w[6], w[7]) for w in rows]
    assert sum(count.values()) == sum(w[3] for w in rows)


def test_links(spark, pair):
    ship_package(spark)
    texts = ["the quick 中文 supercalifragil", "don't\n\n x", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for shared in (False, True):
        got = {(x.doc_id, x.a_pos, x.b_pos): (x.a_id, x.b_id, x.overlap, x.shared_group) for x in al.links(df, *FILES, shared=shared).collect()}
        want = {}
        for d, t in enumerate(texts):
            a, b = tokens(pair, t)
            ea, eb = (np.cumsum([0] + [len(table[i]) for i in ids]) for table, ids in ((pair.bytes_a, a), (pair.bytes_b, b)))
            cuts = sorted(set(ea.tolist()) & set(eb.tolist()) - {0})
            group = lambda e: sum(c < e for c in cuts)
            for i in range(len(a)):
                for j in range(len(b)):
                    over = min(ea[i + 1], eb[j + 1]) - max(ea[i], eb[j])
                    same = group(ea[i + 1]) == group(eb[j + 1])
                    if same if shared else over > 0:
                        want[d, i, j] = (a[i], b[j], None if shared else over, group(ea[i + 1]))
        assert got == want
