"""Per-text operators against brute force, odd texts and clashing columns included."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import bpe, langid, license, linededup, quality, secrets, simhash
from quern.llm.queries import vocabulary
from tests.llm.conftest import lower_az

SPACES = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def by_text(df, *columns):
    """Results by text; equal texts must agree."""
    found = {}
    for r in df.select("text", *columns).collect():
        value = tuple(r[1:])
        assert found.setdefault(r["text"], value) == value
    return found


def test_license_scan(docs, empty):
    found = by_text(license.license_scan(docs.withColumn("N_Words", F.lit("clash"))), "n_words", "places", "blocks")
    phrases = {t.label: t.words.split() for t in license.TEMPLATES if t.phrase}
    hits = 0
    for text, (n, places, blocks) in found.items():
        w = LICENSE_WORDS.findall(lower_az(text or ""))
        want = sorted((i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p)
        assert (n, [(p["start"], p["label"]) for p in places]) == (len(w), want)
        brute = []
        for b in range(max(1, -(-len(w) // license.BLOCK_STEP))):
            block = set(w[b * license.BLOCK_STEP : b * license.BLOCK_STEP + license.BLOCK_WORDS])
            for t in license.TEMPLATES:
                tokens = set(t.words.split())
                if not t.phrase and len(block & tokens) >= t.threshold * len(tokens) - 1e-9:
                    brute.append((t.label, b * license.BLOCK_STEP))
        assert sorted((m["label"], m["first"]) for m in blocks) == sorted(brute)
        hits += len(want)
    assert hits >= 4
    assert license.license_scan(empty).count() == 0


def test_license_templates_meet_threshold(spark):
    rng = random.Random(4)
    notice = next(t for t in license.TEMPLATES if t.label == "bsd").words.split()
    rows = []
    for i in range(60):
        part = notice[:]
        for _ in range(i % 8):
            part[rng.randrange(len(part))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join([f"w{j}" for j in range(rng.randrange(80))] + part)))
    scanned = license.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    tokens = set(notice)
    for r in scanned:
        w = r["text"].split()
        blocks = [set(w[s : s + 64]) for s in range(0, len(w), 32)]
        assert ("bsd" in {b["label"] for b in r["blocks"]}) == any(len(b & tokens) >= 0.8 * len(tokens) for b in blocks)


def test_bpe_equals_library(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    extra = docs.union(docs.limit(1).withColumn("text", F.lit("a<|endoftext|> b'll it's  \n\n x1２\U00010940 <|endoftext|>")))
    encoded = bpe.bpe_encode(extra.withColumn("IDS", F.lit(1)), vocabulary())
    found = by_text(bpe.bpe_decode(encoded, vocabulary()), "ids", "decoded")
    for text, (ids, decoded) in found.items():
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == want
        assert decoded == library.decode(want, skip_special_tokens=False) == (text or "")
    assert bpe.bpe_decode(bpe.bpe_encode(empty, vocabulary()), vocabulary()).count() == 0


def test_bpe_decodes_any_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    rng = random.Random(1)
    lists = [[rng.randrange(50257) for _ in range(n)] for n in (0, 1, 5, 400)]
    df = spark.createDataFrame([(x,) for x in lists] + [(None,), ([5, None, 99999, -1],)], "ids array<int>")
    got = [r["decoded"] for r in bpe.bpe_decode(df.coalesce(1), vocabulary()).collect()]
    assert got[:4] == [library.decode(x, skip_special_tokens=False) for x in lists]
    assert got[4:] == ["", library.decode([5])]


def strip_key(line: str) -> str:
    return lower_az(line.strip(" \t\n\x0b\x0c\r"))


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (3, 9)])
def test_line_dedup(docs, corpus, empty, batches, fanout):
    count = collections.Counter()
    for _, text, *_ in corpus:
        count.update({strip_key(line) for line in (text or "").split("\n")} - {""})
    assert max(count.values()) >= 10
    found = by_text(linededup.line_dedup(docs, batches=batches, fanout=fanout, out="kept"), "kept", "n_lines", "n_dropped")
    for text, (kept, n, dropped) in found.items():
        lines = (text or "").split("\n")
        stay = [line for line in lines if count[strip_key(line)] < 10]
        assert (kept, n, dropped) == ("\n".join(stay), len(lines), len(lines) - len(stay))
    assert linededup.line_dedup(docs).count() == len(corpus)
    assert linededup.line_dedup(empty).count() == 0


def test_line_keys_keep_letters_apart(spark):
    pairs = [("É", "é"), ("K", "k"), ("K", "k"), ("A", "a"), ("ſ", "S"), ("İ", "i"), ("ÃA", "ãa"), (" a", "a"), ("ΑΣ", "ας")]
    df = spark.createDataFrame(pairs, "a string, b string")
    same = [r[0] for r in df.select(linededup.keys_of(F.col("a")) == linededup.keys_of(F.col("b"))).collect()]
    assert same == [strip_key(a) == strip_key(b) for a, b in pairs]


def test_line_dedup_without_broadcast(docs, monkeypatch):
    want = sorted(map(str, linededup.line_dedup(docs).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", -1)
    assert sorted(map(str, linededup.line_dedup(docs).collect())) == want


def fingerprint(text: str | None) -> int:
    w = SPACES.findall(lower_az(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, min(len(w), 1)))]
    values = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in values) > len(values))


def test_fingerprints(docs):
    found = by_text(simhash.with_fingerprint(docs.withColumn("FP", F.lit(0))), "fp")
    assert all(fp & (1 << 64) - 1 == fingerprint(text) for text, (fp,) in found.items())


def test_xxh64_of_all_lengths():
    raw = bytes(random.Random(0).randrange(256) for _ in range(400))
    at, size = np.arange(200), np.arange(200)
    got = simhash.xxh64(np.frombuffer(raw, np.uint8), at, size)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[a : a + n], seed=42) for a, n in zip(at, size)]


def test_quality_counts(docs, empty):
    judged = quality.quality_rules(docs.withColumn("Kept", F.lit("clash")).withColumn("N_words", F.lit(1)).withColumn("x0", F.lit(7)).withColumn("mu", F.lit("mine")))
    assert judged.where("x0 = 7 and mu = 'mine'").count() == judged.count()
    for text, (n, chars, symbols, dup, repeat, failed) in by_text(judged, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").items():
        w = SPACES.findall(text or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count, inside = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            inside |= {i, i + 1, i + 2} if count[g] > 1 else set()
        seen, again = set(), 0
        for line in (text or "").split("\n"):
            if SPACES.search(line):
                again += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(inside))
        assert (n, chars, symbols, dup, repeat) == want
        assert failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
    assert judged.where("base_failed and kept").count() == 0
    assert quality.quality_rules(empty).count() == 0


def test_quality_rejects_outliers_of_their_group(spark):
    rng = random.Random(7)
    rows = [(i, " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(80, 400))), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join("ab#*$%" * 3 for _ in range(60)) + " " + rows[i][1], "en", "s") for i in range(20)]
    rows += [(2000 + i, " ".join(f"{chr(97 + j % 26)}{j}$$$$" for j in range(200)), "xx", None) for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(20)) and all(kept[2000 + i] for i in range(5))


def test_covariance_determinant_ignores_contamination(spark):
    rng = np.random.default_rng(3)
    clean, dirt = rng.normal(5, 2, (3000, quality.DIM)), rng.normal(60, 1, (600, quality.DIM))
    rows = [("g", *map(float, x)) for x in np.concatenate([clean, dirt])]
    df = spark.createDataFrame(rows, "lang string, " + ", ".join(f"__x{i} double" for i in range(quality.DIM)))
    (r,) = quality.covariance_determinant(df, ["lang"]).collect()
    scatter = np.linalg.inv(np.array(r["__inverse"]).reshape(quality.DIM, -1))
    assert np.abs(np.array(r["__mu"]) - 5).max() < 0.3
    assert np.abs(scatter - np.diag(4 + np.square(quality.FLOORS))).max() < 1.6
    assert quality.chi2_cdf(quality.chi2_quantile(0.95, 5), 5) == pytest.approx(0.95)
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def brute_spans(text: str) -> list[tuple]:
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans(docs, empty, spark):
    found = by_text(secrets.with_spans(docs.withColumn("Spans", F.lit(1)), "text"), "spans")
    for text, (spans,) in found.items():
        assert [(s["start"], s["kind"], s["end"]) for s in spans if s["kind"] < 3] == brute_spans(text or "")
    assert sum(len(s) for (s,) in found.values()) >= 5
    jwt = "é eyJabc_def-123.eyJpayload99.sig-nature_0 -----BEGIN RSA PRIVATE KEY-----"
    (r,) = secrets.with_spans(spark.createDataFrame([(jwt,)], "text string"), "text").collect()
    assert [(s["start"], s["kind"]) for s in r["spans"]] == [(2, 3), (jwt.index("---"), 4)]


def test_ledger_scans_only_unseen_blobs(docs, corpus, spark, empty):
    ledger = secrets.BlobLedger(spark)
    first = ledger.scan(docs)
    assert first.count() == len(corpus)
    blobs = {t or "" for _, t, *_ in corpus}
    assert ledger.read().count() == len(blobs)
    more = docs.union(docs.limit(1).withColumn("text", F.lit("token=abcdefgh is new")))
    assert ledger.scan(more).where(F.size("spans") > 0).count() == first.where(F.size("spans") > 0).count() + 1
    assert ledger.read().count() == len(blobs) + 1
    ledger.scan(more, rule_version="next")
    assert ledger.read().count() == 2 * (len(blobs) + 1)
    assert secrets.BlobLedger(spark).scan(empty).count() == 0


def test_language_model_on_held_out_rows(spark, empty, docs):
    rng = random.Random(9)
    syllables = {"aa": ["the", "an", "er", "on"], "bb": ["qu", "eau", "é", "ou"], "cc": ["sch", "ein", "ü", "z"]}
    rows = [(i, lang := rng.choice(sorted(syllables)), " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(df.where(langid.fold("doc_id") != 2))
    held = langid.identify(df.where(langid.fold("doc_id") == 2).withColumn("Score", F.lit("x")), model).collect()
    assert held and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in held)
    odd = {r["text"]: r for r in langid.identify(docs, model).collect()}
    assert odd[None]["lang_pred"] == odd[""]["lang_pred"] == odd["\n"]["lang_pred"] == "und" and odd["日本語 のテキスト です"]["lang_pred"] in syllables
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_gram_buckets_are_a_text_s_own():
    alone = [b.tolist() for b in langid.gram_buckets(["Éa b"])[0]]
    together, bounds = langid.gram_buckets(["zz", "éa B", ""])
    assert [b[bounds[1] : bounds[2]].tolist() for b in together] == alone
    assert pa.array(["x"]).type == pa.string()
