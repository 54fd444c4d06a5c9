"""The pipeline's stages against brute force on a small corpus, and the registered queries."""

from __future__ import annotations

import collections

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import langid
from quern.llm.queries import ORACLES, QUERIES
from quern.session import stage_table
from tests.llm.test_corpus_operators import words
from tests.llm.test_neardup import brute_groups
from tests.llm.test_text_operators import strip_key


def test_stages(spark, docs, corpus, sf_dir, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    bench = spark.createDataFrame([(0, " ".join(words(corpus[60][1])[:30])), (1, None)], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows, frame = [tuple(r) for r in corpus], docs
    columns = frame.columns

    def run(i):
        done = stage_table(corpus_pipeline.STAGES[i][1](spark, frame, str(tmp_path)), "test-stage")
        assert done.columns[: len(columns)] == columns
        return done

    model = langid.train(frame)
    frame = run(0)
    got = collections.Counter(tuple(r) for r in frame.collect())
    told = dict(zip([r[1] for r in rows], zip(*model.predict([r[1] or "" for r in rows]))))
    want = collections.Counter(r for r in rows if told[r[1]][0] != "und" and told[r[1]][1] >= 0.5 and told[r[1]][2] >= -5)
    assert got == want

    rows = list(got.elements())
    count = collections.Counter()
    for r in rows:
        count.update({strip_key(x) for x in r[1].split("\n")} - {""})
    frame = run(1)
    kept = ["\n".join(x for x in r[1].split("\n") if count[strip_key(x)] < 10) for r in rows]
    rows = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, kept)]
    assert collections.Counter(tuple(r) for r in frame.collect()) == collections.Counter(rows)

    root = brute_groups({r[1] for r in rows})
    frame = run(2)
    stay = [tuple(r) for r in frame.collect()]
    assert sorted(root[r[1]] for r in stay) == sorted(set(root.values()))
    assert set(stay) <= set(rows)

    frame = run(3)
    clean = {tuple(r) for r in frame.collect()}
    passage = words(bench.first()["text"])
    split = {r: words(r[1]) for r in stay}
    hit = {r for r, w in split.items() if any(w[i : i + len(passage)] == passage for i in range(len(w)))}
    assert hit and clean == set(stay) - hit

    last = run(4).collect()
    assert {tuple(r)[:5] for r in last} == clean
    assert all(r["n_tokens"] == len(r["ids"]) for r in last)


@pytest.mark.parametrize("i", range(5))
def test_stage_on_odd_tables(spark, docs, empty, sf_dir, i):
    """Empty tables, and columns that are called like what the operators add."""
    stage = corpus_pipeline.STAGES[i][1]
    added = ["n_tokens", "ids"] if i == 4 else []
    none = stage(spark, empty, sf_dir)
    assert none.columns == empty.columns + added and none.count() == 0
    extra = {c: F.lit(f"my {c}") for c in ("score", "lang_pred", "fit", "n_lines", "n_dropped", "fp", "f0", "label", "component", "hit", "decoded", "tid", "key", "item", "a b")}
    clash = stage(spark, docs.withColumns(extra | ({"ids": F.lit(1), "N_Tokens": F.lit(2)} if i == 4 else {})), sf_dir)
    assert clash.columns == docs.columns + list(extra) + added
    rows = clash.collect()
    assert all(r[c] == f"my {c}" for r in rows for c in extra)
    assert 0 < len(rows) <= docs.count()


def test_language_stage_rejects_other_scripts(spark, sf_dir):
    # with 200 texts only, random letters fit too well: the rule needs some training
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    odd = {-1: "Это предложение написано на русском языке и должно быть отклонено.", -2: "这是一个用中文写的句子，应该被拒绝。", -3: "xqzj wvkp qqzx jjvk zzxq wkpv " * 9, -4: "12 34 56"}
    added = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in odd.items()], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.union(added), sf_dir).select("doc_id").collect()}
    ours = {r["doc_id"] for r in docs.where("text is not null").select("doc_id").collect()}
    assert not kept & set(odd) and len(ours - kept) <= 0.01 * len(ours)


def test_run(spark, sf_dir):
    done = corpus_pipeline.run(spark, sf_dir)
    assert 0 < done.count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    mine, theirs = QUERIES[name](spark, sf_dir).toPandas(), engine.execute(ORACLES[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)

    def listed(frame):
        return sorted(tuple("-" if v is None or str(v) in ("<NA>", "nan") else str(float(v)) if isinstance(v, (int, float)) else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False, name=None))

    assert listed(mine) == listed(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    found = QUERIES[name](spark, sf_dir)
    assert found.columns[0] == "doc_id"
    assert found.count() == n or name in ("op4_suffix_dedup", "op9_decontamination")
