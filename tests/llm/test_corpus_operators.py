"""Operators that compare texts with each other, against brute force."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import decontamination, lmscore, simhash, suffixdedup
from tests.llm.conftest import lower_az
from tests.llm.test_text_operators import fingerprint

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return SPACES.findall(lower_az(text or ""))


def brute_components(fps: set[int]) -> dict[int, int]:
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = sorted(fps)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_near_duplicates(docs, corpus, empty):
    rows = simhash.simhash_near_dup(docs).collect()
    assert len(rows) == len(corpus)
    root = brute_components({fingerprint(t) for _, t, *_ in corpus})
    least = {}
    for i, t, *_ in corpus:
        if i is not None:
            r = root[fingerprint(t)]
            least[r] = min(least.get(r, i), i)
    for r in rows:
        assert r["component_id"] == least.get(root[r["fp"] & (1 << 64) - 1])
    assert simhash.simhash_near_dup(empty).count() == 0


def test_links_of_a_dense_cluster(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(150):
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(sorted(fps))], "doc_id long, fp long")
    found = {r["fp"] & (1 << 64) - 1: r["component_id"] for r in simhash.class_components(prints, "doc_id").collect()}
    root, number = brute_components(fps), {f: i for i, f in enumerate(sorted(fps))}
    least = collections.defaultdict(lambda: 1 << 60)
    for f in fps:
        least[root[f]] = min(least[root[f]], number[f])
    assert found == {f: least[root[f]] for f in fps}


def test_long_chains_make_one_component(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    random.Random(1).shuffle(edges)
    found = {r["a"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_golay_code():
    code = simhash.Golay()
    rng = np.random.default_rng(0)
    words23 = rng.integers(0, 1 << 23, 500)
    codeword = words23 ^ code.errors[[simhash.Golay.remainder(int(w)) for w in words23]]
    assert all(simhash.Golay.remainder(int(c)) == 0 for c in codeword)
    assert max(int(a ^ b).bit_count() for a, b in zip(words23, codeword)) <= 3
    for _ in range(500):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
        keys, n = simhash.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(keys[: n[0]]) & set(keys[n[0] :]) and n.max() <= 18


FOLDED = re.compile("[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+")


def folded(text: str | None) -> list[str]:
    return FOLDED.findall((text or "").lower())


def shared_cover(rows, n: int, seed: int) -> dict[str, list[bool]]:
    """For each text its words that lie in a run of ``n`` words, each ``seed`` of them varied, that another text has."""
    where = collections.defaultdict(set)
    texts = {t: folded(t) for t in {t or "" for _, t, *_ in rows}}
    for t, w in texts.items():
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(t)
    cover = {t: [False] * len(w) for t, w in texts.items()}
    for run, owners in where.items():
        if len(owners) > 1 and all(2 * len(set(run[i : i + seed])) >= seed for i in range(n - seed + 1)):
            for t in owners:
                w = texts[t]
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == run:
                        cover[t][i : i + n] = [True] * n
    return cover


def joined(cover: list[bool], gap: int) -> list[tuple[int, int]]:
    """Runs of covered words, with gaps of up to ``gap`` words closed."""
    spans: list[list[int]] = []
    for i, x in enumerate(cover):
        if x and spans and i - spans[-1][1] <= gap:
            spans[-1][1] = i + 1
        elif x:
            spans.append([i, i + 1])
    return [(a, b) for a, b in spans]


def check_passages(rows, found, seed: int, spread: int, gap: int, min_words: int) -> int:
    """Every covered passage is in a span; every word of a span is covered by a shared seed, but for gaps. Copies are whole."""
    sure, possible = shared_cover(rows, seed + spread - 1, seed), shared_cover(rows, seed, seed)
    any_run = {t: v for t, v in shared_cover(rows, seed, 1).items()}
    copies = collections.Counter(t or "" for _, t, *_ in rows)
    spans = collections.defaultdict(collections.Counter)
    for key, start, n in found:
        spans[key][start, start + n] += 1
    seen = 0
    expected = collections.Counter(k for k, *_ in rows)
    for key, text, *_ in rows:
        if expected[key] > 1:
            continue
        t = text or ""
        if copies[t] > 1:
            assert dict(spans[key]) == ({(0, len(sure[t])): 1} if len(sure[t]) >= min_words else {})
            continue
        for a, b in joined(sure[t], gap):
            assert b - a < min_words or any(x <= a and b <= y for x, y in spans[key])
        for a, b in spans[key]:
            seen += 1
            assert b - a >= min_words and any(possible[t][a:b]) and spans[key][a, b] == 1
            assert all(y - x <= b - a for x, y in joined(any_run[t][a:b], gap)) and joined(any_run[t][a:b], gap) == [(0, b - a)]
    return seen


@pytest.mark.parametrize("seed,spread,gap,min_words", [(12, 20, 3, 48), (6, 4, 0, 9), (4, 1, 1, 6)])
def test_repeated_passages(docs, corpus, empty, seed, spread, gap, min_words):
    got = suffixdedup.repeated_passages(docs, seed=seed, spread=spread, gap=gap, min_words=min_words)
    assert check_passages(corpus, [tuple(r) for r in got.collect()], seed, spread, gap, min_words) > 5
    assert suffixdedup.repeated_passages(empty).count() == 0
    clash = suffixdedup.repeated_passages(docs.withColumnsRenamed({"lang": "tid", "source": "suffix"}).withColumn("place", F.lit("x")))
    assert clash.columns == ["doc_id", "start", "n_words"] and clash.count() > 0


def test_passages_with_frayed_edges_and_glued_punctuation(spark):
    """Passages of 50 to 70 words in many texts; hot ones too; clean and babbling texts stay out."""
    rng = random.Random(3)
    draw = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n)]
    rows, planted = [], set()
    passages = [draw(rng.randrange(51, 70)) for _ in range(12)]
    for i in range(400):
        w = draw(rng.randrange(60, 200))
        if i % 4 == 0:
            p = passages[0 if i % 8 else (i // 8) % 12][:]
            glued = [x + rng.choice(["", ",", "!!", ".\n"]) for x in p]
            glued[0], glued[-1] = "x" + glued[0], glued[-1] + "x"
            w[30:30] = [x.upper() for x in glued] if i % 3 else glued
            planted.add(i)
        if i % 25 == 1:
            w[20:20] = ["the"] * 90
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in suffixdedup.repeated_passages(docs).collect()]
    assert {r[0] for r in got} == planted
    check_passages(rows, got, 12, 20, 3, 48)


def test_borders_between_ranges(spark, monkeypatch):
    """One suffix in all texts, sorted by many tasks: the nearest neighbour may be in another task."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(14)]
    rows = [(i, " ".join([f"a{rng.randrange(3)}" for _ in range(rng.randrange(8))] + common + [f"z{rng.randrange(2)}" for _ in range(rng.randrange(12))])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in suffixdedup.repeated_passages(docs, seed=4, spread=8, gap=0, min_words=11).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    check_passages(rows, got, 4, 8, 0, 11)


def test_varied():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 6, 300).astype(np.uint64)
    for seed in (2, 5, 12):
        want = [2 * len(set(tokens[i : i + seed].tolist())) >= seed for i in range(len(tokens) - seed + 1)]
        assert suffixdedup.varied(tokens, seed).tolist() == want


def test_sliding_argmin():
    values = np.random.default_rng(2).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 26, 200):
        want = [i + int(values[i : i + width].argmin()) for i in range(200 - width + 1)]
        assert suffixdedup.sliding_argmin(values, width).tolist() == want


def test_decontamination(spark, empty):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(rng.randrange(15, 60)))) for i in range(30)] + [(30, None), (31, ""), (32, "too short")]
    rows, planted = [], set()
    for i in range(300):
        w = draw(rng.randrange(0, 200))
        if i % 3 == 0:
            item, text = items[i % 30]
            part = text.split()
            for at in range(i % 7 + 4, len(part), 10):  # a substitution in ten words
                if i % 2:
                    part[at] = "substitute"
            w[len(w) // 2 : len(w) // 2] = part
            planted.add((i, item))
        rows.append((i, " ".join(w).upper()))
    rows += [(900, None), (901, ""), (902, items[0][1] + " " + items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 1500):
        found = decontamination.overlaps(docs, bench, limit=limit).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == planted | {(902, 0)}
        assert sorted(r["start"] for r in found if r["doc_id"] == 902) == [0, len(items[0][1].split())]
        for r in found:
            w, p = words(dict(rows)[r["doc_id"]]), words(dict(items)[r["item_id"]])
            same = sum(a == b for a, b in zip(w[r["start"] : r["start"] + r["length"]], p[r["item_start"] : r["item_start"] + r["length"]]))
            assert same == r["matched"] >= 0.8 * r["length"]
        kept = {r["doc_id"] for r in decontamination.decontaminated(docs, bench, limit=limit).collect()}
        assert kept == {r[0] for r in rows} - {i for i, _ in planted} - {902}
    assert decontamination.overlaps(empty, bench).count() == 0
    assert decontamination.overlaps(docs, bench.limit(0)).columns == ["doc_id", "item_id", "start", "item_start", "length", "matched"]
    assert decontamination.decontaminated(docs, bench.limit(0)).count() == len(rows)


def brute_overlaps(text: str, item: str, index) -> set[tuple[int, int]]:
    """(start, item start) of the stretches on all diagonals that hold a seed of some mask."""
    w, p, found = folded(text), folded(item), set()
    for shift in range(-len(p), len(w)):
        same = np.array([w[i] == p[i - shift] for i in range(max(0, shift), min(len(w), len(p) + shift))], bool)
        seeded = any(all(same[i + j] for j, bit in enumerate(m) if bit == "1") for m in index.masks for i in range(len(same) - len(m) + 1))
        if seeded:
            found |= {(max(0, shift) + a, max(0, shift) + a - shift) for a, _, _ in index.stretches(same, len(p))}
    return found


def test_decontamination_against_all_diagonals():
    rng = random.Random(2)
    draw = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [" ".join(draw(n)) for n in (8, 12, 20, 40)] + ["go " * 30, "go stop " * 20, "", "a b"]
    texts = []
    for _ in range(40):
        w = draw(rng.randrange(0, 60))
        part = items[rng.randrange(6)].split()
        part = [x if rng.random() > 0.15 else "other" for x in part]
        w[len(w) // 2 : len(w) // 2] = part
        texts.append(" ".join(w))
    index = decontamination.SeedIndex(pa.array(items), decontamination.MASKS, 13, 0.8)
    got = index.overlaps(pa.array(texts))
    want = {(t, i, a, b) for t, text in enumerate(texts) for i, item in enumerate(items) for a, b in brute_overlaps(text, item, index)}
    assert {(t, i, a, b) for t, i, a, b, _, _ in got} == want and len(want) > 30


def test_stretches_go_on_beside_rejected_ones():
    index = decontamination.SeedIndex(pa.array(["x"]), decontamination.MASKS, 13, 0.8)
    run = lambda *parts: np.array([bool(x) for n, x in parts for _ in range(n)])
    assert index.stretches(run((12, 1), (5, 0), (7, 1), (1, 0), (7, 1)), 60) == [(17, 32, 14)]
    six = run(*[(13, 1), (4, 0)] * 6)
    assert index.stretches(six, 200) == [(0, 13, 13), (17, 98, 65)]


def test_decontamination_of_one_word_over_and_over(monkeypatch):
    """Millions of equal seeds: their diagonals are found piece by piece."""
    index = decontamination.SeedIndex(pa.array(["go " * 300]), decontamination.MASKS, 13, 0.8)
    monkeypatch.setattr(decontamination, "LISTED", 10_000)
    got = index.overlaps(pa.array(["go " * 3000, "stop"]))
    assert {x[0] for x in got} == {0} and len({x[2] - x[3] for x in got}) == len(got) > 3000


def test_decontamination_names(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item long, text string")
    bench = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(30)))], "item long, start string").withColumnRenamed("start", "text")
    found = decontamination.overlaps(docs.withColumnRenamed("item", "doc_id"), bench, item="item").collect()
    assert [(r["doc_id"], r["item"], r["length"]) for r in found] == [(1, 7, 30)]


def test_language_model_counts_and_losses(docs, corpus, spark, empty):
    targets = spark.createDataFrame([(i,) for i in range(0, 100, 2)] + [(None,), (4,)], "doc_id long")
    marked = lmscore.with_targets(docs, targets)
    assert marked.count() == len(corpus)
    models = lmscore.train(marked.select("text", "is_target"))
    good = {i for i in range(0, 100, 2)}
    uni, bi = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for i, text, *_ in corpus:
        w = words(text)
        for k in (0, 1) if i in good else (0,):
            uni[k].update(w)
            bi[k].update(zip(w, w[1:]))
    total = [sum(u.values()) for u in uni]
    assert models.tokens.tolist() == total and len(models.ngrams) == len(uni[0]) + len(bi[0])
    p = lambda k, w: (uni[k][w] + 1) / (total[k] + len(uni[0]) + 1)
    for r in lmscore.score(docs.withColumn("SCORE", F.lit(1)), models).collect():
        w = words(r["text"])
        assert r["n_tokens"] == len(w)
        if not w:
            assert r["score"] is None and r["target_loss"] is None
            continue
        want = []
        for k in (0, 1):
            given = [p(k, w[0])] + [lmscore.WEIGHT * min(bi[k][a, b] / (p(k, a) * max(total[k], 1)), 1) + (1 - lmscore.WEIGHT) * p(k, b) for a, b in zip(w, w[1:])]
            want.append(-sum(map(np.log, given)) / len(w))
        assert r["background_loss"] == pytest.approx(want[0]) and r["target_loss"] == pytest.approx(want[1])
        assert r["score"] == pytest.approx(want[0] - want[1])
    small = lmscore.train(marked.select("text", "is_target"), model_size=100)
    assert 0 < len(small.ngrams) <= 100 and small.tokens.tolist() == total
    none = lmscore.train(empty.select("text", F.lit(True).alias("is_target")))
    assert lmscore.score(docs, none).count() == len(corpus) and lmscore.score(empty, models).count() == 0
