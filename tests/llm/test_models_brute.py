"""The trained operators' scores against plain loops: a document at a time, a term, pair or passage at a time."""
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import language, quality, textkernel as tk, toxicity

M = (1 << 64) - 1
WORDS = ["alpha", "beta", "Gamma", "délice", "straße", "x", "yy", "zz9", "implementation", "implements", "中文", "!!", "|", "#tag", "one.", "THE"]


def texts(seed, n=40):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, k=r.choice([0, 1, 2, 7, 64, 65, 400]))) + r.choice(["", "\n", " . "]) for _ in range(n)] + [None, "", "123 456", "é"]


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M
    return h ^ h >> 31


def poly(bs):
    return sum(int(tk._VALUE[b]) * pow(tk._BASE, i, 1 << 64) for i, b in enumerate(bs)) & M


def low(text):
    return (text or "").encode().translate(bytes(tk.LOWER.tolist()))


def trigram_counts(text):
    letters = [int(language._MAP[b]) for b in (text or "").encode()]
    out = Counter()
    for i, c in enumerate(letters):
        if c:
            before, after = letters[i - 1] if i else 0, letters[i + 1] if i + 1 < len(letters) else 0
            out[((before * 65599 + c * 257 + after) & 0xFFFFFFFF) * 2654435761 % (1 << 32) >> 18] += 1
    return out


def em(counts, p, share, steps):
    total = sum(counts.values())
    mixed = lambda g, s: sum(p[g][j] * s[j] for j in range(len(s)))
    for _ in range(steps):
        new = [0.0] * len(share)
        for g, k in counts.items():
            m = mixed(g, share)
            for j in range(len(share)):
                new[j] += k * p[g][j] * share[j] / m
        share = [x / total for x in new]
    return share, sum(k * math.log(mixed(g, share)) for g, k in counts.items())


def mixture(text, model):
    counts, n = trigram_counts(text), len(model.langs)
    if not counts:
        return [0.0] * n
    p = {g: model.p[g].tolist() for g in counts}
    share, fit = em(counts, p, [1 / n] * n, language.STEPS)
    cost = language.PENALTY * math.log(sum(counts.values()) + 1)
    while sum(s > 0 for s in share) > 1:
        least = min((j for j in range(n) if share[j] > 0), key=lambda j: (share[j], j))
        rest = [0.0 if j == least else s for j, s in enumerate(share)]
        new, new_fit = em(counts, p, [s / sum(rest) for s in rest], language.AGAIN)
        if new_fit + cost < fit:
            break
        share, fit = new, new_fit
    return share


def test_mixtures_equal_plain_estimation():
    r = np.random.default_rng(5)
    counts = np.zeros((language.SPACE, 3))
    for j, t in enumerate(["alpha beta Gamma one. THE yy", "délice straße x implementation", "中文 zz9 implements alpha"]):
        for g, k in trigram_counts(" ".join([t] * 30)).items():
            counts[g, j] += k
    model = language.Model(["a", "b", "c"], counts + r.integers(0, 2, counts.shape))
    rows = texts(1)
    got = model.mixtures(pa.array(rows, pa.string()))
    for t, s in zip(rows, got):
        assert s.tolist() == pytest.approx(mixture(t, model), abs=1e-9), t


def terms(text):
    out = set()
    for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text)):
        out.add(mix(poly(w) + len(w) * 0xD6E8FEB86659FD93 & M) & toxicity.SPACE - 1)
        for n in toxicity.STEMS:
            if len(w) > n:
                out.add(mix(poly(w[:n]) + n * 0xA24BAED4963EE407 & M) & toxicity.SPACE - 1)
    return out


def test_machine_equals_the_double_sum():
    rows, model = texts(2), toxicity.Model()
    every = sorted(set().union(*map(terms, rows)))
    kept = every[::2]
    model.keep[kept] = np.arange(len(kept))
    r = np.random.default_rng(3)
    model.w0, model.w, model.v = -0.3, r.normal(0, 0.3, len(kept)), r.normal(0, 0.2, (len(kept), toxicity.RANK))
    for t, s in zip(rows, model.scores(pa.array(rows, pa.string())).tolist()):
        mine = sorted(int(model.keep[x]) for x in terms(t) if model.keep[x] >= 0)
        z = model.w0 + sum(model.w[i] for i in mine)
        for a, i in enumerate(mine):
            for j in mine[:a]:
                z += sum(float(x) * float(y) for x, y in zip(model.v[i], model.v[j]))
        assert s == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, z)))), abs=1e-9), t


def test_bags_equal_a_loop_over_passages():
    rows, model = texts(3), quality.Model(seed=4)
    r = np.random.default_rng(6)
    model.mean, model.scale, model.shift = r.normal(0, 1, quality.N_FEATURES), r.uniform(0.5, 2, quality.N_FEATURES), 0.25
    p = {k: v.tolist() for k, v in model.p.items()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    column = lambda m, j: [row[j] for row in m]
    for t, s in zip(rows, model.scores(pa.array(rows, pa.string())).tolist()):
        (x, of, n), = quality._ranges(pa.array([t], pa.string()))
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", low(t)))
        assert n == 1 and len(x) == max(1, -(-words // quality.PASSAGE))
        codes, weights = [], []
        for row in ((x - model.mean) / model.scale).tolist():
            h = [math.tanh(dot(row, column(p["W"], j)) + p["b"][j]) for j in range(quality.CODE)]
            gate = [math.tanh(dot(h, column(p["V"], j))) * sig(dot(h, column(p["U"], j))) for j in range(quality.GATE)]
            codes.append(h)
            weights.append(math.exp(dot(gate, p["w"])))
        z = [sum(w * h[j] for w, h in zip(weights, codes)) / sum(weights) for j in range(quality.CODE)]
        assert s == pytest.approx(sig(dot(z, p["c"]) + p["d"][0] + model.shift), abs=1e-9), t
