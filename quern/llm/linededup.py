"""Line dedup over levelled sorted runs of line hashes, with DataFrame operations only.

A run holds (k1, k2, n): the 96-bit hash of a line's key and the number of documents of
one or more batches that have it, sorted by hash. Each new batch of documents

1. counts its own keys, once a document, with a partial aggregation before the shuffle;
2. merge-anti-joins the runs: keys that some run already shows in ``min_docs`` documents
   are settled and leave the batch;
3. adds the rest as a run of level 0.

When a level has ``fanout`` runs they are merged, with their counts summed, into one run
of the next level, so a key is rewritten once a level. Lines whose key has at least
``min_docs`` documents over all runs go from every document.

Defined results: a null or empty text is one empty line; empty keys (blank lines) always
stay; rows count as documents, so repeated rows count each time and are reduced alike,
even with a null or repeated id; an empty table gives an empty result. Input columns
named like a result are replaced. A hot line is counted by partial sums and looked up by
a join that adaptive execution can split; no group of rows is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.textblocks import without
from quern.session import drop_path, new_path

#: Frequent keys up to this number (12 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 200_000
#: White space stripped at both ends of a key: blank and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(text: Column) -> Column:
    """The lines' keys, equal exactly where lines are equal with their ends stripped and A-Z lower-cased.

    ``lower`` also maps letters beyond A-Z, which must stay apart here. So a text that is
    not ASCII is read as Latin-1, one letter a byte: lower-casing then maps A-Z and lead
    bytes C0-DE only. A mapped lead byte is still told from an original one by the number
    of bytes that follow it, so different texts keep different keys.
    """
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))
    )
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("k1"), F.hash(key).alias("k2")]


def key_counts(docs: DataFrame, text: str) -> DataFrame:
    """(k1, k2, n): keys of at least one code point, with the number of rows that have them."""
    keys = docs.select(F.explode(F.array_distinct(keys_of(F.col(text)))).alias("key")).where(F.col("key") != "")
    return keys.select(*key_hashes(F.col("key"))).groupBy("k1", "k2").agg(F.count("*").alias("n"))


class LineRuns:
    """The levels of sorted runs, as Parquet tables in the shared folder."""

    schema = "k1 bigint, k2 int, n bigint"

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[str]] = []

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def paths(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def write(self, counts: DataFrame, level: int) -> None:
        path = new_path(self.spark, f"line-run-{level}")
        counts.select("k1", "k2", "n").sortWithinPartitions("k1", "k2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def add(self, counts: DataFrame) -> None:
        """Add a batch's key counts, less the keys that the runs have settled."""
        if self.paths():
            settled = self.read(self.paths()).where(F.col("n") >= self.min_docs).select("k1", "k2")
            counts = counts.join(settled, ["k1", "k2"], "left_anti")
        self.write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self.levels[level], []
            self.write(self.summed(merged), level + 1)
            for path in merged:
                drop_path(self.spark, path)
            level += 1

    def summed(self, paths: list[str]) -> DataFrame:
        runs = self.read(paths)
        return runs if len(paths) == 1 else runs.groupBy("k1", "k2").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame:
        """The keys found in at least ``min_docs`` documents over all runs."""
        return self.summed(self.paths()).where(F.col("n") >= self.min_docs).select("k1", "k2").distinct()


def line_dedup(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    min_docs: int = 10,
    batches: int = 4,
    fanout: int = 4,
    out: str = "text",
    names: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with ``out``, the text without lines of frequent keys, and the lines' number and that of dropped ones, called ``names``.

    ``batches``: rows are fed to the runs in so many batches, dealt out by the hash of
    column ``key``; the result doesn't depend on it.
    """
    spark = docs.sparkSession
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(key_counts(docs.where(F.pmod(F.xxhash64(key), F.lit(batches)) == batch), text))
    path = new_path(spark, "frequent-lines")
    runs.frequent().write.parquet(path)
    frequent = spark.read.schema("k1 bigint, k2 int").parquet(path)
    if frequent.count() <= BROADCAST_KEYS:
        frequent = F.broadcast(frequent)
    # rows are told apart by content: rows that agree in key and text are reduced alike
    row = [F.xxhash64(key, text).alias("__r1"), F.hash(text, key).alias("__r2")]
    hits = (
        docs.select(*row, F.posexplode(keys_of(F.col(text))).alias("pos", "key"))
        .where(F.col("key") != "")
        .select("__r1", "__r2", "pos", *key_hashes(F.col("key")))
        .join(frequent, ["k1", "k2"], "left_semi")
        .groupBy("__r1", "__r2")
        .agg(F.collect_set("pos").alias("__dropped"))
    )
    kept = [c for c in without(docs, [*names, out]).columns]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], *row, lines_of(F.col(text)).alias("__lines"))
    n_lines, dropped = F.size("__lines"), F.col("__dropped")
    places = F.array_except(F.sequence(F.lit(0), n_lines - 1), dropped)
    reduced = F.array_join(F.transform(places, lambda p: F.get(F.col("__lines"), p)), "\n")
    return rows.join(hits, ["__r1", "__r2"], "left").select(
        *[F.col(f"`{c}`") for c in kept],
        F.when(dropped.isNull(), F.array_join("__lines", "\n")).otherwise(reduced).alias(out),
        n_lines.cast("bigint").alias(names[0]),
        F.coalesce(F.size(dropped), F.lit(0)).cast("bigint").alias(names[1]),
    )
