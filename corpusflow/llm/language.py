"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte trigrams of letters, counted over
all documents that may be learned from.  A document is a mixture of languages:
expectation-maximisation estimates its proportions from its trigram counts, and
languages leave its set, least share first, as long as the penalised likelihood
does not fall.  The prediction is the language of the largest share.

Only the counts (languages x ``SPACE`` numbers) reach the driver.  They are
pre-aggregated in every task, so a language with most of the rows is no hot key.

Defined results: null texts and texts without a letter are ``und`` with score 0
and no languages; ties between shares go to the first language in code-point order;
repeated rows repeat; null languages are not learned; without any labelled row
every text is ``und``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusflow.llm import learning, textkernel as tk

#: Buckets of the trigram hash; most languages that a model may hold.
SPACE, MOST = 1 << 14, 1000
#: Steps of the first estimate and after each language that leaves; likelihood that one more language must bring, per log count.
STEPS, AGAIN, PENALTY = 8, 4, 4.0

_MAP = np.zeros(256, np.uint32)          # 0: not a letter
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def trigrams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, bucket, count), sorted by row, and the number of rows, chunk by chunk; a trigram has a letter in its middle."""
    for _, data, offsets in tk.text_chunks(column):
        n = len(offsets) - 1
        c = _MAP[data]
        before, after = np.zeros_like(c), np.zeros_like(c)
        before[1:], after[:-1] = c[:-1], c[1:]
        inner = offsets[1:-1]
        before[inner[inner < len(c)]] = 0
        after[inner[inner > 0] - 1] = 0
        code = ((before * np.uint32(65599) + c * np.uint32(257) + after) * np.uint32(2654435761)) >> np.uint32(18)
        at = np.flatnonzero(c)
        code = code[at].astype(np.int64)
        cuts = np.searchsorted(at, offsets)
        rows, buckets, counts = [], [], []
        for r in range(n):
            mine = code[cuts[r]:cuts[r + 1]]
            if len(mine) > 3000:
                full = np.bincount(mine, minlength=SPACE)
                g = np.flatnonzero(full)
                k = full[g]
            else:
                g, k = np.unique(mine, return_counts=True)
            rows.append(np.full(len(g), r))
            buckets.append(g)
            counts.append(k)
        yield np.concatenate(rows), np.concatenate(buckets), np.concatenate(counts), n


class Model:
    """``p`` holds the trigram distributions, one column per language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.p = (smooth / smooth.sum(axis=0)).astype(np.float64)

    @staticmethod
    def _em(p, k, of, heads, total, share, steps):
        """Shares after ``steps`` steps and their log-likelihood; a language of share 0 stays out."""
        for _ in range(steps):
            joint = p * share[of]
            mix = joint.sum(axis=1)
            share = np.add.reduceat(joint * (k / mix)[:, None], heads, axis=0) / total[:, None]
        return share, np.add.reduceat(k * np.log((p * share[of]).sum(axis=1)), heads)

    def mixtures(self, column: pa.Array) -> np.ndarray:
        """Shares of the languages of every text; a row without letters has zeros only."""
        out = [np.zeros((0, len(self.langs)))]
        for rows, buckets, counts, n in trigrams(column):
            shares = np.zeros((n, len(self.langs)))
            if len(rows):
                docs, heads, of = np.unique(rows, return_index=True, return_inverse=True)
                k = counts.astype(np.float64)
                total = np.add.reduceat(k, heads)
                p = self.p[buckets]
                shares[docs] = self._select(p, k, of, heads, total)
            out.append(shares)
        return np.concatenate(out)

    def _select(self, p, k, of, heads, total):
        m, langs = len(heads), p.shape[1]
        share, fit = self._em(p, k, of, heads, total, np.full((m, langs), 1 / langs), STEPS)
        cost = PENALTY * np.log(total + 1)
        for _ in range(langs - 1):
            inside = share > 0
            more = inside.sum(axis=1) > 1
            if not more.any():
                break
            least = np.where(inside, share, 2).argmin(axis=1)
            tried = share.copy()
            tried[np.arange(m), least] = 0
            tried[~more] = share[~more]
            tried /= np.maximum(tried.sum(axis=1, keepdims=True), 1e-300)
            new, new_fit = self._em(p, k, of, heads, total, tried, AGAIN)
            better = more & (new_fit + cost >= fit)
            if not better.any():
                break
            share[better], fit[better] = new[better], new_fit[better]
        return share


def train(docs: DataFrame) -> Model:
    """Counts over every row of ``docs(doc_id, text, lang)`` that may be learned from."""
    rows = (docs.filter(F.col("lang").isNotNull() & ~learning.held_out(F.col("doc_id")))
            .select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))

    if rows.select("lang").distinct().limit(MOST + 1).count() > MOST:       # before any counts come to the driver
        raise ValueError(f"a model holds {MOST} languages at most")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names, at = np.array(b.column(0).to_pylist(), object), 0
            for r, g, k, n in trigrams(b.column(1)):
                here = names[at:at + n]
                at += n
                for lang in set(here.tolist()):
                    mine = (here == lang)[r]
                    total = sums.setdefault(lang, np.zeros(SPACE, np.int64))
                    total += np.bincount(g[mine], k[mine], SPACE).astype(np.int64)
        for lang, total in sums.items():
            g = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(total[g])], names=["lang", "g", "k"])

    sums = rows.mapInArrow(run, "lang string, g long, k long").groupBy("lang", "g").agg(F.sum("k").alias("k")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((SPACE, len(langs)))
    index = {x: i for i, x in enumerate(langs)}
    counts[sums.column("g").to_numpy(), [index[x] for x in sums.column("lang").to_pylist()]] = sums.column("k").to_numpy()
    return Model(langs, counts)


PREDICTED = "lang_pred string, score double, languages array<string>, shares array<double>"


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep`` plus lang_pred, score (its share, 0 to 1) and the document's languages with their shares, largest first."""
    kept = [c for c in keep if c not in ("lang_pred", "score", "languages", "shares")]
    t = F.col(f"`{text}`").cast("string")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias("__letters"), t.alias("__text"))
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept], PREDICTED])
    langs = model.langs

    def run(batches):
        for b in batches:
            letters = np.array(b.column(len(kept)).to_pylist(), bool)
            shares = model.mixtures(b.column(len(kept) + 1)) if langs else np.zeros((b.num_rows, 0))
            letters &= shares.sum(axis=1) > 0
            best = shares.argmax(axis=1) if langs else np.zeros(b.num_rows, int)
            order = np.argsort(-shares, axis=1, kind="stable")
            found = [[langs[j] for j in o if s[j] > 0] if ok else [] for ok, o, s in zip(letters, order, shares)]
            parts = [[min(1.0, float(s[j])) for j in o if s[j] > 0] if ok else [] for ok, o, s in zip(letters, order, shares)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(len(kept))], pa.array([langs[j] if ok else "und" for ok, j in zip(letters, best)], pa.string()),
                 pa.array([p[0] if p else 0.0 for p in parts], pa.float64()), pa.array(found, pa.list_(pa.string())),
                 pa.array(parts, pa.list_(pa.float64()))], names=[*kept, "lang_pred", "score", "languages", "shares"])

    return source.mapInArrow(run, schema)
