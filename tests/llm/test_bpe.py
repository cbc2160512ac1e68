import hashlib
import random
import unicodedata

import pytest

from corpusflow.llm import bpe
from corpusflow.llm.queries import tokenizer_path
from corpusflow.session import ship_package

PATH = tokenizer_path()
ALPHABET = "abcdefghijklmnopqrstuvwxyz'éñßΣÀ 01²⅓.,!?<|>~`\t\n 　漢字한éİſ\x85\x1c😀"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def hard_texts():
    r = random.Random(3)
    made = ["".join(r.choices(ALPHABET, k=r.randint(1, 60))) for _ in range(1500)]
    return made + ["aaaaaaa " * 5 + "a" * 300, "!" * 40, "<|endoftext|>hi<|startoftext|> x", "", " \n\t", "it's we'll 'sun 'tis", "h" * 3000,
                   "<|endoftext|>", "x<|endoftext", "İstanbul ΟΔΟΣ", "éé"]


def test_ids_and_decoding_equal_the_library(library):
    codec = bpe.Codec(bpe.read_file(PATH))
    for text in hard_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == want, repr(text)
        assert codec.lines(text)[1] == library.decode(want, skip_special_tokens=False)
        assert codec.decode(want) == codec.lines(text)[1]


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    codec = bpe.Codec(bpe.read_file(PATH))
    for text in hard_texts()[:200]:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_automaton_follows_merge_order():
    """Against merging by rank, on a small alphabet with overlapping merges."""
    merges = [("a", "a"), ("a", "b"), ("aa", "a</w>"), ("b", "a"), ("ab", "a</w>"), ("aa", "aa"), ("b", "b</w>")]
    vocab = {s: i for i, s in enumerate(["a", "b", "a</w>", "b</w>", *dict.fromkeys(x + y for x, y in merges)])}
    auto = bpe.Automaton(vocab, merges, "</w>")
    rank = {m: i for i, m in enumerate(merges)}
    for n in range(1, 10):
        for k in range(1 << n):
            word = "".join("ab"[(k >> i) & 1] for i in range(n))
            parts = [*word[:-1], word[-1] + "</w>"]
            while True:
                found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
                if not found:
                    break
                i = min(found)[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            assert [auto.label[t] for t in auto.encode(word)] == parts, word


def test_rows_of_every_kind(spark, library):
    ship_package(spark)
    rows = [(1, None, "x"), (2, "", "y"), (3, "One two", None), (3, "One two", None), (None, "w " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.encoding_digests(df, PATH, keep=("doc_id", "n_tokens"))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in out.collect())
    want = sorted((i or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                  for i, t, _ in rows for ids in [library.encode(t or "", add_special_tokens=False).ids])
    assert got == want
    both = bpe.decode(bpe.encode(df, PATH), PATH)
    assert set(both.columns) == {"doc_id", "text", "n_tokens", "token_ids", "decoded"}
    assert {r.decoded for r in both.filter("doc_id = 3").collect()} == {"one</w> two</w>"}
    assert bpe.encoding_digests(df.limit(0), PATH).count() == 0


def test_normal_form_is_composed_first(library):
    assert bpe.Codec(bpe.read_file(PATH)).encode("é") == library.encode(unicodedata.normalize("NFC", "é"), add_special_tokens=False).ids


def merged(parts, rank):
    """Merging by rank, the pair of least rank first."""
    parts = list(parts)
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_every_arc_is_laid_down_before_the_first_word():
    """The table of the whole vocabulary: an arc stands where merging by rank leaves the two tokens as they are, and encoding adds nothing."""
    import json
    spec = json.loads(bpe.read_file(PATH))["model"]
    rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in reversed(list(enumerate(spec["merges"])))}
    auto = bpe.Codec(bpe.read_file(PATH)).automaton
    before = [len(auto.arcs), sum(map(len, auto.arcs)), len(auto.next), hashlib.sha256(b"".join(auto.arcs)).hexdigest()]
    assert before[0] > 10_000 and before[1] < 64 << 20
    r, tokens, stands = random.Random(6), list(auto.state.items()), 0
    symbols = lambda s: [*s[:-5], s[-5] + "</w>"] if s.endswith("</w>") else list(s)
    merges = list(rank)
    pairs = [(r.choice(tokens)[0], r.choice(tokens)[0]) for _ in range(1500)] + r.sample(merges, 500)
    pairs += [(x, y[0]) for x, _ in r.sample(merges, 500) for y in [r.choice(merges)]]
    for a, b in pairs:
        if a in auto.state and b in auto.state and not a.endswith("</w>"):
            want = merged(symbols(a) + symbols(b), rank) == [a, b]
            assert auto.arc(auto.state[a], auto.state[b]) == want, (a, b)
            stands += want
    assert 100 < stands
    auto.encode("abcdefghij" * 50 + "k")
    assert before == [len(auto.arcs), sum(map(len, auto.arcs)), len(auto.next), hashlib.sha256(b"".join(auto.arcs)).hexdigest()]


def test_one_word_of_many_characters(library):
    """One pass, no copies of the rest: twice the word takes about twice the time; a part of it equals the library."""
    import time
    auto, r = bpe.Codec(bpe.read_file(PATH)).automaton, random.Random(8)
    word = "".join(r.choices("abcdefghiklmnoprstu", k=1_600_000))
    times = []
    for n in (400_000, 1_600_000):
        start = time.process_time()
        ids = auto.encode(word[:n])
        times.append(time.process_time() - start)
    assert times[1] < 8 * max(times[0], 0.1) and times[1] < 10
    assert auto.encode(word[:20_000]) == library.encode(word[:20_000], add_special_tokens=False).ids
