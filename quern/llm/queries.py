"""The registered queries of this subpackage, one for each operator, with oracle SQL where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontamination, langid, license, linededup, lmscore, quality, secrets, simhash, suffixdedup
from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@register
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.bpe_encode(docs, vocabulary(), keep_text=False)
    decoded = bpe.bpe_decode(encoded, vocabulary())
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.line_dedup(docs, out="kept_text")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op3_line_dedup"] = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows
), keys AS (
  SELECT r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM keyed
), frequent AS (
  SELECT key FROM keys WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keys k LEFT JOIN frequent f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, cast(sum(gone::int) AS bigint) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""


@register
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_near_dup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    judged = quality.quality_rules(docs, keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@register
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    names = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    n_base = F.size("places").cast("bigint")
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        names("places.label").alias("base_labels"),
        names("places.label", "blocks.label").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(best).alias("score"),
    )


@register
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", langid.fold("doc_id") == 2)
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), model, keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


@register
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.BlobLedger(spark).scan(versions)
    kinds = F.array(*[F.lit(rule.kind) for rule in secrets.RULES])
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


@register
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


@register
def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return lmscore.score_whole(lmscore.with_targets(docs, good))


@register
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def license_oracle() -> str:
    """Every block against every template, and every place against every phrase."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"('{t.label}', {listed(t.words.split())})" for t in license.TEMPLATES if t.phrase)
    templates = ", ".join(f"('{t.label}', {listed(sorted(set(t.words.split())))}, {t.threshold})" for t in license.TEMPLATES if not t.phrase)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), phrases(label, phrase) AS (VALUES {phrases}
), templates(label, tokens, threshold) AS (VALUES {templates}
), starts AS (
  SELECT r, words, unnest(range(len(words))) AS i FROM texts
), places AS (
  SELECT r, label, i FROM starts, phrases WHERE words[i + 1] = phrase[1] AND words[i + 1 : i + len(phrase)] = phrase
), blocks AS (
  SELECT r, words[{license.BLOCK_STEP} * b + 1 : {license.BLOCK_STEP} * b + {license.BLOCK_WORDS}] AS block
  FROM (SELECT r, words, unnest(range(cast(ceil(len(words) / {license.BLOCK_STEP}) AS bigint))) AS b FROM texts)
), matches AS (
  SELECT r, label, len(list_intersect(block, tokens)) / len(tokens) AS containment FROM blocks, templates
  WHERE len(list_intersect(block, tokens)) >= ceil(threshold * len(tokens) - 1e-9)
), base AS (
  SELECT r, count(*) AS n, min(i) AS low, max(i) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r
), named AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(containment) AS best
  FROM (SELECT r, label, 1.0::DOUBLE AS containment FROM places UNION ALL SELECT r, label, containment FROM matches) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, coalesce(best, 0)::DOUBLE AS score
FROM texts LEFT JOIN base USING (r) LEFT JOIN named USING (r)
"""


ORACLES["op1_license_scan"] = license_oracle()
