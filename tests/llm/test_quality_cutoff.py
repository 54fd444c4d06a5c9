"""The verdict on plain junk, and least variances."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quern.llm import quality


def test_word_lists_are_rejected(spark):
    rng = random.Random(5)
    draw = lambda: ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(80, 300))]
    rows = [(i, " ".join(draw()), "en", "s") for i in range(200)] + [(1000 + i, " ".join(w + "|" for w in draw()), "en", "s") for i in range(10)]
    judged = quality.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()
    assert not any(r["base_failed"] for r in judged)
    assert sorted(r["doc_id"] for r in judged if r["kept"]) == list(range(200))
    assert all(20 < r["distance"] < 60 for r in judged if r["doc_id"] >= 1000)


def test_floors_are_least_variances(spark):
    rng = np.random.default_rng(1)
    spread = np.array([2.0, 0.35, 1.0, 0.3, 0.0])
    rows = [("g", *map(float, x)) for x in rng.normal(0, 1, (4000, quality.DIM)) * spread]
    df = spark.createDataFrame(rows, "lang string, " + ", ".join(f"__x{i} double" for i in range(quality.DIM)))
    (r,) = quality.covariance_determinant(df, ["lang"]).collect()
    scatter = np.linalg.inv(np.array(r["__inverse"]).reshape(quality.DIM, -1))
    floors = np.square(quality.FLOORS)
    assert [scatter[1, 1], scatter[4, 4]] == pytest.approx([floors[1], floors[4]])
    assert np.diag(scatter)[[0, 2, 3]] == pytest.approx(np.square(spread[[0, 2, 3]]), rel=0.3)
