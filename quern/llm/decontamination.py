"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; words under a 0 are ignored, so a hit
survives substitutions there. Training and benchmark texts are hashed under every mask at
every place, equal hashes are joined, and each hit gives a diagonal: training place less
benchmark place. Along a hit's diagonal the words of both texts are compared one to one,
with substitutions allowed, and the best scoring stretch is taken, then the best left and
right of it; one with too many differing words is split at its longest gap. It counts as an
overlap if at least ``min_match`` of its words agree, or half of the item's where that is
fewer but still as long as a seed, and these are at least ``identity`` of the stretch.

The benchmark is the stated query set: it is cut into blocks of bounded size by a check
of its total length, and each block is broadcast and run against all rows. Training
texts are read whole, in place; nothing but the overlaps is shuffled.

Defined results: null and empty texts, and items of fewer words than the shortest mask
reaches, have no overlap; letter case, white space and ASCII punctuation don't count;
repeated rows and items are found each; several stretches of an item in a text give a row
each; empty tables give an empty result. Names of further columns don't matter.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.textblocks import LOWER, SPACE, TOKEN_POWERS, WORD, append_columns, flat_bytes, flat_ranges, mixed, span_hashes, word_spans

#: Masks over words: weights 6 to 10 in spans of 8 to 16. The short ones find items of 8 to 20 words with substitutions.
MASKS = ("11111111", "11011011", "110110011", "1110110101011", "1101011000110111", "111011001011011")
#: Pairs of equal seeds that are listed at once.
LISTED = 1_000_000
#: Most benchmark bytes in one broadcast block.
BLOCK_LIMIT = 8 << 20
#: What a differing word costs against what an equal one gains.
PENALTY = 3


def token_rows(texts: pa.Array, is_word: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with A-Z lower-cased, flat, and the n + 1 word bounds of the texts."""
    data, offsets = flat_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = LOWER[data]
    starts, ends = word_spans(data, is_word)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, _ = TOKEN_POWERS.upto(len(mask) + 1)
    total = np.zeros(n, np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total += tokens[i : i + n] * up[i]
    return mixed(total)


class SeedIndex:
    """A block of benchmark items with their spaced-seed hashes, sorted."""

    def __init__(self, texts: pa.Array, masks: tuple[str, ...], min_match: int, identity: float):
        self.masks, self.min_match, self.identity = masks, min_match, identity
        self.tokens, self.bounds = token_rows(pc.utf8_lower(texts), WORD)
        self.seeds = []
        row = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        for mask in masks:
            hashes = seed_hashes(self.tokens, mask)
            whole = np.flatnonzero(row[: len(hashes)] == row[len(mask) - 1 :][: len(hashes)])
            order = whole[np.argsort(hashes[whole], kind="stable")]
            keys = hashes[order]
            present = np.zeros(1 << 20, bool)
            present[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.seeds.append((keys, order, present))
        self.item = row

    def overlaps(self, texts: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, first word, first item word, length, words that agree) of each overlap."""
        tokens, bounds = token_rows(pc.utf8_lower(texts), WORD)
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        # a diagonal of a text and an item is compared once, however many seeds lie on it
        diagonals = [np.zeros(0, np.uint64)]
        for mask, (keys, order, present) in zip(self.masks, self.seeds):
            hashes = seed_hashes(tokens, mask)
            if not len(hashes) or not len(keys):
                continue
            at = np.flatnonzero(present[(hashes >> np.uint64(44)).astype(np.int64)])
            at = at[row[at] == row[at + len(mask) - 1]]
            low = np.searchsorted(keys, hashes[at], "left")
            n = np.searchsorted(keys, hashes[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            parts = np.searchsorted(np.cumsum(n), np.arange(LISTED, n.sum() + LISTED, LISTED), "right")
            first = 0
            for last in parts.tolist():
                last = max(last, first + 1)
                place, other = np.repeat(at[first:last], n[first:last]), order[flat_ranges(low[first:last], n[first:last])]
                diagonals.append(np.unique((row[place] << 44) | (self.item[other] << 24) | (place - other + (1 << 23))).astype(np.uint64))
                first = last
                if first >= len(at):
                    break
        codes = np.unique(np.concatenate(diagonals)).astype(np.int64)
        listed = zip((codes >> 44).tolist(), (codes >> 24 & 0xFFFFF).tolist(), ((codes & 0xFFFFFF) - (1 << 23)).tolist())
        found = []
        for r, item, shift in listed:
            first = max(int(bounds[r]), int(self.bounds[item]) + shift)
            last = min(int(bounds[r + 1]), int(self.bounds[item + 1]) + shift)
            same = tokens[first:last] == self.tokens[first - shift : last - shift]
            for a, b, agree in self.stretches(same, int(self.bounds[item + 1] - self.bounds[item])):
                found.append((r, item, first + a - int(bounds[r]), first + a - shift - int(self.bounds[item]), b - a, agree))
        return found

    def stretches(self, same: np.ndarray, item_words: int) -> list[tuple[int, int, int]]:
        """(start, end, words that agree) of the best stretch, and of the best left and right of it."""
        found, open_parts = [], [(0, len(same))]
        need = min(self.min_match, max(len(min(self.masks, key=len)), -(-item_words // 2)))
        while open_parts:
            low, high = open_parts.pop()
            part = same[low:high]
            if part.sum() < need:
                continue
            sums = np.r_[0, np.cumsum(np.where(part, 1, -PENALTY))]
            rise = sums - np.minimum.accumulate(sums)
            b = int(rise.argmax())
            a = int(sums[: b + 1].argmin())
            agree = int(part[a:b].sum())
            open_parts += [(low, low + a), (low + b, high)]
            if agree >= need and agree >= self.identity * (b - a):
                found.append((low + a, low + b, agree))
            elif agree >= need:
                # too many words differ: both sides of the longest gap
                turns = np.flatnonzero(np.diff(np.r_[True, part[a:b], True].astype(np.int8)))
                gap = int((turns[1::2] - turns[::2]).argmax())
                open_parts += [(low + a, low + a + int(turns[2 * gap])), (low + a + int(turns[2 * gap + 1]), low + b)]
        return sorted(found)


_INDEXES: dict[str, SeedIndex] = {}


def index_of(name: str, shared) -> SeedIndex:
    """The index of a broadcast block, built once in a worker and kept until the next one is."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = SeedIndex(*shared.value)
    return _INDEXES[name]


OVERLAP = "array<struct<item:int,start:bigint,item_start:bigint,length:bigint,matched:bigint>>"
ARROW_OVERLAP = pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64()), ("matched", pa.int64())]))


def benchmark_blocks(benchmark: DataFrame, item: str, text: str, limit: int):
    """The benchmark in blocks of about ``limit`` bytes, each as an Arrow table; one block is held at a time."""
    total = benchmark.agg(F.sum(F.octet_length(F.col(f"`{text}`"))).alias("n")).first()["n"] or 0
    n = -(-total // limit)
    for i in range(n):
        yield benchmark.select(item, text).where(F.pmod(F.xxhash64(item, text), F.lit(n)) == i).toArrow().combine_chunks()


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    min_match: int = 13,
    identity: float = 0.8,
    limit: int = BLOCK_LIMIT,
) -> DataFrame:
    """(``key``, ``item``, start, item_start, length, matched): all overlaps of texts with items, in words."""
    spark = docs.sparkSession
    parts = []
    for block in benchmark_blocks(benchmark, item, item_text, limit):
        texts = block.column(item_text).combine_chunks()
        shared = spark.sparkContext.broadcast((texts.fill_null(""), masks, min_match, identity))
        name = uuid.uuid4().hex

        def compute(rows: pa.Array, _: np.ndarray, shared=shared, name=name) -> list:
            index = index_of(name, shared)
            listed: list[list[dict]] = [[] for _ in range(len(rows))]
            for r, i, start, item_start, length, matched in index.overlaps(rows):
                listed[r].append({"item": i, "start": start, "item_start": item_start, "length": length, "matched": matched})
            return [pa.array(listed, ARROW_OVERLAP)]

        field = T.StructField("__overlaps", T.StructType.fromDDL(f"x {OVERLAP}")[0].dataType)
        found = append_columns(docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")), "__text", compute, [field], keep_column=False)
        names = spark.createDataFrame(pa.table({"__item": pa.array(np.arange(len(texts)), pa.int32()), "__name": block.column(item)}))
        rows = found.where(F.size("__overlaps") > 0).select("__key", F.inline("__overlaps")).withColumnRenamed("item", "__item")
        parts.append(rows.join(F.broadcast(names), "__item").select(F.col("__key").alias(key), F.col("__name").alias(item), "start", "item_start", "length", "matched"))
    if not parts:
        schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, benchmark.schema[item].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "item_start", "length", "matched")]])
        return spark.createDataFrame([], schema)
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, min_match: int = 13, identity: float = 0.8, limit: int = BLOCK_LIMIT
) -> DataFrame:
    """The rows of ``docs`` without any overlap; decided in place, without a shuffle."""
    spark = docs.sparkSession
    for block in benchmark_blocks(benchmark, item, item_text, limit):
        shared = spark.sparkContext.broadcast((block.column(item_text).combine_chunks().fill_null(""), masks, min_match, identity))
        name = uuid.uuid4().hex

        def compute(rows: pa.Array, _: np.ndarray, shared=shared, name=name) -> list:
            index = index_of(name, shared)
            hit = np.zeros(len(rows), bool)
            hit[[found[0] for found in index.overlaps(rows)]] = True
            return [pa.array(hit)]

        docs = append_columns(docs, text, compute, [T.StructField("__hit", T.BooleanType())]).where(~F.col("__hit")).drop("__hit")
    return docs
