"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination and BPE.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of
documents; the last adds the tokens. Between two stages rows are written as Parquet to the
shared folder and read again, so no stage recomputes an earlier one, whatever is lost.
SQL can't express the stages; their tests compare them with brute force.

Rejected: rows without a letter, whose best language has a posterior under one half, or
that fit it badly (a mean log probability of an n-gram 5 nats under the language's own, as
texts in other scripts and random letters have); lines found in ten documents or more; all
but one of each group of near-duplicates (192-bit fingerprints of the five-word shingles
that agree in 0.8125 of their bits, linked directly or by others); rows that overlap a
benchmark item. Of a group the row with the smallest doc_id stays, null ids last, and of
rows equal in id and text any.

Null texts have no letter and go with the first stage; a text whose lines all go stays as
an empty text, and empty texts are near-duplicates. Texts of any length are processed
whole. Ties are resolved as the operators state: the first language by name, the smallest
id. Empty tables give empty results with the same columns. Further columns pass through
under any name; only the last stage's ``n_tokens`` and ``ids`` replace columns called so,
and names that begin with two underscores are the stages' own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, decontamination, langid, linededup, simhash
from quern.llm.textblocks import without
from quern.session import stage_table, table

ORACLE_SQL = None
#: Least posterior of a text's language, and least fit to it in nats an n-gram.
POSTERIOR, FIT = 0.5, -5.0


def listed(docs: DataFrame, *names: str) -> list:
    return [F.col(f"`{c}`") for c in docs.columns if c not in names]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = langid.identify(docs, langid.train(docs), names=("__lang", "__score", "__fit"))
    return told.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= POSTERIOR) & (F.col("__fit") >= FIT)).select(*listed(docs))


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.line_dedup(docs, names=("__lines", "__dropped"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*listed(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs).select(*listed(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*listed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = without(docs, ["n_tokens", "ids"])
    decoded = bpe.bpe_decode(bpe.bpe_encode(docs, path, ids="__ids", keep_text=False), path, ids="__ids", text="text")
    return decoded.select(*listed(docs), F.size("__ids").cast("bigint").alias("n_tokens"), F.col("__ids").alias("ids"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_frequent_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage_table(docs, name.lower().replace(" ", "-"))
    return docs
