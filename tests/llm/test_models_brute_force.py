"""Language ID and the quality verdict, row by row, against the definitions in plain Python and numpy."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from quern.llm import langid, quality

MASK = 0xFFFFFFFF


def buckets(text: str):
    """The bucket of every n-gram of a text, one code point at a time."""
    closed = text.lower() + "\n\n"
    for i in range(len(closed)):
        state = 0
        for n in range(langid.ORDERS):
            if i + n < len(closed):
                state = (state + ((ord(closed[i + n]) + n + 1) & MASK) * int(langid.PLACE[n])) & MASK
            yield (((state ^ (state >> 15)) * 0x2C1B3C6D) & MASK) >> 17


def test_naive_bayes_row_by_row(docs, corpus):
    counts, rows = {}, Counter()
    for _, text, lang, *_ in corpus:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(buckets(text))
            rows[lang] += 1
    names = sorted(counts)
    total = {k: sum(counts[k].values()) + 0.5 * langid.BUCKETS for k in names}
    prior = {k: math.log((rows[k] + 1) / sum(rows[x] + 1 for x in names)) for k in names}
    own = {k: sum((counts[k][b] + 0.5) / total[k] * math.log((counts[k][b] + 0.5) / total[k]) for b in range(langid.BUCKETS)) for k in names}

    def told(text):
        if text is None or not langid.LETTER.search(text):
            return langid.UNKNOWN, 0.0, None
        found = Counter(buckets(text))
        n = sum(found.values())
        fits = {k: sum(c * math.log((counts[k][b] + 0.5) / total[k]) for b, c in found.items()) for k in names}
        score = {k: fits[k] + prior[k] for k in names}
        best = max(names, key=lambda k: score[k])
        return best, 1 / sum(math.exp(score[k] - score[best]) for k in names), fits[best] / n - own[best]

    expected = sorted((text is not None, text or "", *told(text)) for _, text, *_ in corpus)
    got = sorted((r["text"] is not None, r["text"] or "", r["lang_pred"], r["score"], r["fit"]) for r in langid.identify(docs, langid.train(docs)).collect())
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    for mine, theirs in zip(got, expected):
        assert mine[3] == pytest.approx(theirs[3], abs=1e-6)
        assert mine[4] == (None if theirs[4] is None else pytest.approx(theirs[4], abs=1e-6))


def lower_median(values: np.ndarray) -> np.ndarray:
    return np.sort(values, axis=0)[math.ceil(len(values) / 2) - 1]


def floored(cov: np.ndarray) -> np.ndarray:
    np.fill_diagonal(cov, np.maximum(np.diag(cov), np.square(quality.FLOORS)) * (1 + quality.RIDGE))
    return cov


def least_determinant(x: np.ndarray, share: float = 0.75, steps: int = 4) -> tuple[float, np.ndarray, np.ndarray]:
    mu = lower_median(x)
    spread = np.maximum(1.4826 * lower_median(np.abs(x - mu)), quality.FLOORS)
    y = np.tanh((x - mu) / spread)
    cov = (y.T @ y) / len(y) - np.outer(y.mean(0), y.mean(0))
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    ratio = spread / np.where(dev > 1e-9, dev, 1)
    cov = cov * np.outer(ratio, ratio)
    np.fill_diagonal(cov, spread**2)
    scale = share / quality.chi2_cdf(quality.chi2_quantile(share, quality.DIM), quality.DIM + 2)
    results = []
    for shape in (np.diag(spread**2), floored(cov)):
        centre, inverse = mu, np.linalg.inv(shape)
        for _ in range(steps):
            away = x - centre
            bins = np.floor(np.log2(np.einsum("ni,ij,nj->n", away, inverse, away) + 2.0**-20) * 32)
            near = x[bins <= np.sort(bins)[math.ceil(len(x) * share) - 1]]
            centre = near.mean(0)
            scatter = floored(((near.T @ near) / len(near) - np.outer(centre, centre)) * scale)
            inverse = np.linalg.inv(scatter)
        results.append((round(float(np.linalg.slogdet(scatter)[1]), 6), centre, inverse))
    return min(results, key=lambda r: r[0])


@pytest.mark.parametrize("groups", [("lang",), ("lang", "source")])
def test_verdicts_row_by_row(spark, sf_dir, groups):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality.quality_rules(docs, groups=groups).toPandas()
    words = judged.n_words.clip(lower=1)
    x = np.stack([np.log1p(judged.n_words), judged.word_chars / words, np.sqrt(judged.n_symbols / judged.word_chars.clip(lower=1)), np.sqrt(judged.n_dup_lines / judged.n_lines.clip(lower=1)), np.sqrt(judged.n_repeat_words / words)], axis=1)
    cutoff, seen = quality.chi2_quantile(0.999, quality.DIM), 0
    failed = ((judged.n_words < 50) | (100 * judged.n_repeat_words > 50 * judged.n_words)).to_numpy()
    assert (judged.base_failed.to_numpy() == failed).all() and judged.distance.isna().to_numpy()[failed].all() and not judged.kept[failed].any()
    for _, group in judged[~failed].groupby(list(groups), dropna=False):
        at = group.index.to_numpy()
        _, mu, inverse = least_determinant(x[at])
        far = np.einsum("ni,ij,nj->n", x[at] - mu, inverse, x[at] - mu)
        assert group.distance.to_numpy() == pytest.approx(far, rel=1e-4, abs=1e-6)  # groups of two rows have a condition of 1e6
        assert (group.kept.to_numpy() == (far <= cutoff)).all()
        seen += len(at)
    assert seen == (~failed).sum() > 100
