"""The wide measure of SimHash near-duplicates against all pairs, and links that hang on the Golay keys."""

from __future__ import annotations

import dataclasses
import itertools
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.textblocks import gram_hashes, mixed
from tests.llm.conftest import SCHEMA
from tests.llm.test_corpus_operators import words


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))


def prints_of(texts: list) -> dict:
    table = simhash.wide_fingerprints(pa.array([t or "" for t in texts], pa.string()), 5)
    return {t: tuple(map(int, fp)) for t, fp in zip(texts, table)}


def brute_groups(texts, radius: int = 36) -> dict:
    """The group of each text, by all pairs of fingerprints."""
    prints = prints_of(list(texts))
    fps = sorted(set(prints.values()))
    table = np.array(fps, np.uint64).reshape(-1, 3)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        near = np.bitwise_count(table[: i + 1] ^ table[i]).sum(axis=1) <= radius
        for j in np.flatnonzero(near).tolist():
            parent[max(find(i), find(j))] = min(find(i), find(j))
    root = {fp: find(i) for i, fp in enumerate(fps)}
    return {t: root[fp] for t, fp in prints.items()}


def near_copies() -> list[tuple]:
    """Groups of texts at similarities around 0.8, a chain among them, and a passage that many share."""
    rng = random.Random(3)
    draw = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    passage, rows = draw(40), []
    for g in range(25):
        base = draw(rng.randrange(6, 200))
        rows.append(base)
        for _ in range(6):
            w = base[:]
            for _ in range(rng.randrange(0, len(base) // 25 + 2)):
                w[rng.randrange(len(w))] = "changed"
            rows.append(w)
        rows.append(draw(50) + passage)
    w = draw(120)
    for i in range(30):
        w = w[:]
        w[4 * i] = "moved"
        rows.append(w)
    rng.shuffle(rows)
    return [(i, " ".join(w), "en", "s", None) for i, w in enumerate(rows)]


def test_wide_fingerprints():
    texts = ["", "one", "a b c", "A b c", "a b c d e f g " * 5, "x y z " * 40]
    for t, fp in prints_of(texts).items():
        hashes = set()
        w = pa.array([t])
        for n in range(1, 6):
            tokens = simhash.token_rows(w)[0]
            if len(tokens) == n < 5 or n == 5:
                hashes |= set(gram_hashes(tokens, n).tolist())
        for i, word in enumerate(fp):
            values = [int(mixed(np.array([h], np.uint64) ^ mixed(np.full(1, i + 1, np.uint64)))[0]) for h in hashes]
            assert word == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


@pytest.mark.parametrize("stage", [False, True])
def test_one_of_each_group(spark, docs, corpus, sf_dir, stage):
    rows = near_copies() if stage else corpus
    frame = spark.createDataFrame(rows, SCHEMA) if stage else docs
    root = brute_groups({r[1] for r in rows})
    done = corpus_pipeline.STAGES[2][1](spark, frame, sf_dir) if stage else simhash.one_of_each(frame)
    stay = done.collect()
    kept = [root[r["text"]] for r in stay]
    # keys miss a few links of the wide measure, so a group may stay in two parts
    assert set(kept) == set(root.values()) and len(kept) <= 1.03 * len(set(kept))
    assert len(kept) < len(set(r[1] for r in rows))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[root[t]] = min(least.get(root[t], i), i)
    assert {i for i in least.values()} <= {r["doc_id"] for r in stay}


def test_similar_sets_are_grouped(spark):
    """Nearly all pairs with a Jaccard similarity of 0.8 or more share a group; those under a third don't."""
    rows = near_copies()
    root = brute_groups({r[1] for r in rows})
    near = far = lost = 0
    for a, b in itertools.combinations({r[1] for r in rows}, 2):
        x, y = shingles(a), shingles(b)
        similarity = len(x & y) / len(x | y)
        if similarity >= 0.8:
            near += 1
            lost += root[a] != root[b]
        if similarity < 1 / 3 and not any("moved" in t for t in (a, b)):
            far += 1
            assert root[a] != root[b] or min(len(x), len(y)) < 12
    assert near > 60 and far > 1000 and lost <= 0.03 * near


def test_links_need_keys(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(63) for _ in range(40)]
    fps += [f ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for f in fps]
    classes = spark.createDataFrame([(f,) for f in set(fps)], "f0 long")
    assert simhash.links(classes, simhash.NARROW).count() == 40
    lonely = lambda found: (found, np.ones(len(found), np.int64))
    keyless = dataclasses.replace(simhash.NARROW, keys=lambda f: lonely(f[:, 0].astype(np.int64)))
    assert simhash.links(classes, keyless).count() == 0
    few = dataclasses.replace(simhash.NARROW, per_bucket=50)
    assert simhash.links(classes, few).count() == 40


def test_hot_key_is_united():
    """Thousands of fingerprints under one key, in a chain, without pairs in memory."""
    n = 4000
    steps = np.arange(n)
    fps = (np.uint64(1) << np.uint64(40)) + (steps ^ (steps >> 1)).astype(np.uint64)[:, None]
    far = fps + (np.uint64(0xFFFF) << np.uint64(45))
    table = np.concatenate([fps, far])
    parent = simhash.linked(np.zeros(2 * n, np.uint64), np.arange(2 * n), table, 1)
    assert parent.tolist() == [0] * n + [n] * n


def test_no_documents_and_clashing_names(empty, docs):
    assert simhash.one_of_each(empty).count() == 0 and simhash.simhash_near_dup(empty).count() == 0
    clash = docs.withColumnsRenamed({"lang": "fp", "source": "label", "n_chars": "component"}).withColumn("f0", F.lit("x")).withColumn("row", F.lit(1))
    assert simhash.one_of_each(clash).columns == clash.columns
    assert simhash.one_of_each(clash).count() == simhash.one_of_each(docs).count()
    assert simhash.simhash_near_dup(clash).columns == ["doc_id", "fp", "component", "component_id"]
