"""Scores by models of all n-grams, whatever their number."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import lmscore
from quern.llm.queries import QUERIES
from tests.llm.test_corpus_operators import words


def wanted(rows) -> dict:
    """(background, target) loss of each text, from (text, is_target)."""
    uni, bi = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for text, good in rows:
        w = words(text)
        for k in (0, 1) if good else (0,):
            uni[k].update(w)
            bi[k].update(zip(w, w[1:]))
    total = [sum(u.values()) for u in uni]
    p = lambda k, w: (uni[k][w] + 1) / (total[k] + len(uni[0]) + 1)
    found = {}
    for text, _ in rows:
        w = words(text)
        given = [[p(k, w[0])] + [lmscore.WEIGHT * min(bi[k][a, b] / (p(k, a) * max(total[k], 1)), 1) + (1 - lmscore.WEIGHT) * p(k, b) for a, b in zip(w, w[1:])] for k in (0, 1)] if w else []
        found[text] = [-sum(map(np.log, g)) / len(w) for g in given] or [None, None]
    return found


@pytest.mark.parametrize("chunk,bucket", [(2_000_000, 2_000_000), (500, 3_000), (100_000, 900)])
def test_whole_scores(docs, corpus, spark, empty, monkeypatch, chunk, bucket):
    monkeypatch.setattr(lmscore, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(lmscore, "BUCKET_TOKENS", bucket)
    marked = docs.withColumn("is_target", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))
    want = wanted([(t, i is not None and i % 2 == 0) for i, t, *_ in corpus])
    texts = collections.defaultdict(collections.Counter)
    for i, t, *_ in corpus:
        texts[i][t] += 1
    rows = lmscore.score_whole(marked.select("doc_id", "text", "is_target")).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        near = [t for t in texts[r["doc_id"]] if len(words(t)) == r["n_tokens"]]
        if not r["n_tokens"]:
            assert near and r["score"] is None and r["target_loss"] is None
            continue
        close = [t for t in near if r["background_loss"] == pytest.approx(want[t][0]) and r["target_loss"] == pytest.approx(want[t][1])]
        assert close and r["score"] == pytest.approx(want[close[0]][0] - want[close[0]][1])
    assert lmscore.score_whole(empty.select("doc_id", "text", F.lit(True).alias("is_target"))).count() == 0


def test_more_ngrams_than_a_model_held(spark, tmp_path):
    """Over a million n-grams: rare bigrams of the target still count."""
    texts = [" ".join(f"v{i}x{j}" for j in range(40_000)) for i in range(15)] + ["alone again", "alone again"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1), (15, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    want = wanted([(t, i in (0, 15)) for i, t in enumerate(texts)])
    for r in QUERIES["op5_lm_score"](spark, str(tmp_path)).collect():
        assert [r["background_loss"], r["target_loss"]] == pytest.approx(want[texts[r["doc_id"]]])
