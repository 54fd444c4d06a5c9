"""Secret scans with an incremental ledger of blobs.

A version of a file or document is a row (path columns, text). Texts are addressed by
content: a blob is the SHA-256 of the text. The ledger, a Parquet table in the shared
folder, holds the findings of each (blob, rule version) that was scanned. A scan takes
only pairs that the ledger lacks: blobs of the versions are counted once, the ledger's
own are anti-joined away, each remaining blob is scanned once whatever the number of its
copies, and the findings are appended. Findings then join back to all paths.

Defined results: a null text is scanned as the empty text; it and texts without secrets
have no spans; repeated rows get the same findings each; null paths stay null; spans are
sorted by start, then by kind in the order of the rules; spans count code points, the end
exclusive; an empty table gives an empty result. Input columns named like a result are
replaced. Copies of one blob meet in partial aggregates before the shuffle, and the join
back to paths is one that adaptive execution splits, so a blob with a third of all rows
is no hot spot.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.textblocks import append_columns, without
from quern.session import new_path


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: bytes
    least: int
    group: int = 0
    any_case: bool = False


#: Base patterns (fixed values), matched on bytes so that letter case means A-Z alone; then further kinds.
RULES = (
    Rule("assign", rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)", 6, 2, True),
    Rule("access", rb"AKIA[A-Z0-9]+", 20),
    Rule("hex", rb"[0-9a-f]{24,}", 24),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
)
RULE_VERSION = "2"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))


def find_spans(raw: bytes, rules: tuple[tuple[re.Pattern, Rule], ...]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes; leftmost, not overlapping within a kind."""
    lowered, found = None, []
    for number, (pattern, rule) in enumerate(rules):
        if rule.any_case and lowered is None:
            lowered = raw.lower()
        for m in pattern.finditer(lowered if rule.any_case else raw):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), number, m.end()))
    return sorted(found)


def in_code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[dict]:
    if not spans:
        return []
    before = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    place = lambda at: int(before[at - 1]) if at else 0
    return [{"start": place(a), "kind": k, "end": place(b)} for a, k, b in spans]


def with_spans(df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, keep_text: bool = True) -> DataFrame:
    """``df`` with ``spans`` of each text."""

    def compute(texts: pa.Array, _: np.ndarray) -> list:
        compiled = tuple((re.compile(r.pattern), r) for r in rules)
        raw = texts.cast(pa.binary()).to_pylist()
        return [pa.array([in_code_points(x, find_spans(x, compiled)) for x in raw], ARROW_SPANS)]

    return append_columns(df, text, compute, [T.StructField("spans", SPANS)], keep_column=keep_text)


class BlobLedger:
    """The scanned (blob, rule version) pairs with their findings."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "blob-ledger")
        self.schema = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rule_version", T.StringType()), T.StructField("spans", SPANS)])
        self.spark.createDataFrame([], self.schema).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def scan(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
        """Scan unseen blobs of ``versions``; return its columns but ``text``, with ``blob`` and ``spans``."""
        blob = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        seen = self.read().where(F.col("rule_version") == rule_version)
        texts = versions.select(blob.alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        unseen = texts.join(seen.select("blob"), "blob", "left_anti")
        scanned = with_spans(unseen, "text", rules, keep_text=False).withColumn("rule_version", F.lit(rule_version))
        scanned.select(*self.schema.names).write.mode("append").parquet(self.path)
        found = self.read().where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
        paths = without(versions, ["blob", "spans"] + [text]).columns
        paths = versions.select(*[F.col(f"`{c}`") for c in paths], blob.alias("blob"))
        return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
