"""Repeated passages by a sparse suffix array.

Words are hashed, with letter case and ASCII punctuation left out. Of every ``spread``
consecutive places the one with the smallest hash of its next ``seed`` words is retained:
places selected by content, so texts that share ``seed + spread - 1`` words retain the
same places there. A retained place stands for the suffix that starts at it. Suffixes
are sorted by their words, by range over the whole corpus, and each is compared with its
nearest neighbours that come from another text; what both share extends the match to the
right. The same places are sorted again by the words before them, read backwards, which
extends matches to the left. No neighbour further off shares more, so every run of
``seed + spread - 1`` words or more that two texts share is covered to its last word, and
every word covered lies in a run of at least ``seed`` words that another text has.
Covered words with at most ``gap`` others between them make one passage, so a passage
survives a changed word; passages of ``min_words`` words or more are the result. That is
a little less than the 50 words looked for, as words glued to its edges don't count.

Places whose seed has less than half as many different words as words are not retained:
a word or two over and over is no passage, whoever else has it. It only counts where a
shared run goes on through it.

Extensions reach as far as the next retained place at least, so a record holds a bounded
number of words on either side and long matches are covered from place to place. Sorting
by range splits a suffix that very many texts share among tasks; the records at the
borders of the tasks' ranges are compared once more by themselves. Texts are told apart
by 96 bits of hashes, words by 32 where they are compared and by 64 in a seed, of which a
passage has several. Equal texts are one text with a number of rows, whose whole length
is a repeated span if there are two rows or more. Only the narrow table of retained
suffixes is shuffled for all texts; only texts with a match are read again.

Defined results: null and empty texts and those shorter than ``min_words`` have no span;
passages repeated only within one text are no result; repeated rows count as copies, with
equal or null ids too; an empty table gives an empty result. Names of further columns
don't matter. A span may hold words of several matches with different texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.decontamination import token_rows
from quern.llm.textblocks import WORD, append_columns, blocks, flat_ranges, gram_hashes, list_of
from quern.session import map_arrow, stage_table

#: Words of a seed, which a retained place must share with another text.
SEED = 12
#: Of so many consecutive places one is retained.
SPREAD = 20
#: Words that a match may be interrupted by.
GAP = 3
#: Least words of a passage.
MIN_WORDS = 48


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each start the place of the first least value among ``width`` values, by doubling."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def varied(tokens: np.ndarray, seed: int) -> np.ndarray:
    """For each run of ``seed`` tokens whether at least half as many are different: counted by their last places."""
    n = len(tokens) - seed + 1
    order = np.argsort(tokens, kind="stable")
    after = np.full(len(tokens), len(tokens) + seed)
    same = tokens[order[1:]] == tokens[order[:-1]]
    after[order[:-1][same]] = order[1:][same]
    distance = after - np.arange(len(tokens))
    # a token repeated d places on is a repeat in the runs that hold both: starts from i - (seed - 1 - d) to i
    near = np.flatnonzero(distance < seed)
    repeats = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(repeats, np.maximum(near + distance[near] - seed + 1, 0), 1)
    np.add.at(repeats, near + 1, -1)
    return np.cumsum(repeats)[:n] <= seed // 2


class Suffixes:
    """The retained places of a block of texts, with their seeds' hashes."""

    def __init__(self, texts: pa.Array, seed: int, spread: int):
        self.tokens, self.bounds = token_rows(pc.utf8_lower(texts), WORD)
        empty = np.zeros(0, np.int64)
        self.place = self.row = empty
        self.keys = np.zeros(0, np.uint64)
        if len(self.tokens) < seed + spread - 1:
            return
        row = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        keys = gram_hashes(self.tokens, seed)
        keys[~varied(self.tokens, seed)] = np.iinfo(np.uint64).max
        chosen = sliding_argmin(keys, spread)
        whole = row[: len(chosen)] == row[seed + spread - 2 :][: len(chosen)]
        place = np.unique(chosen[whole])
        self.place = place[keys[place] != np.iinfo(np.uint64).max]
        self.row, self.keys = row[self.place], keys[self.place]


def text_keys(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("tid"), F.hash(text).alias("tie")]


def with_suffixes(docs: DataFrame, text: str, seed: int = SEED, spread: int = SPREAD) -> DataFrame:
    """``docs`` with ``n_words`` and the hashes (``suffixes``) and word numbers (``places``) of retained suffixes."""

    def compute(texts: pa.Array, _: np.ndarray) -> list:
        found = Suffixes(texts, seed, spread)
        counts = np.bincount(found.row, minlength=len(texts))
        return [
            pa.array(np.diff(found.bounds)),
            list_of(found.keys.view(np.int64), counts, pa.int64()),
            list_of((found.place - found.bounds[found.row]).astype(np.int32), counts, pa.int32()),
        ]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("suffixes", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))]
    return append_columns(docs, text, compute, fields, keep_column=False)


def context(words: np.ndarray, at: np.ndarray, step: int, width: int, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """For each of ``at`` the ``width`` words from there on in direction ``step``, four bytes each; zeros beyond its text."""
    places = at[:, None] + step * np.arange(width)[None, :]
    inside = (places >= low[:, None]) & (places < high[:, None])
    found = np.where(inside, words[np.clip(places, 0, max(len(words) - 1, 0))] if len(words) else 0, 0).astype(">u4")
    offsets = np.arange(len(at) + 1, dtype=np.int32) * (4 * width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(found.tobytes())])


RECORD = "suffix bigint, tid bigint, place int, after binary, before binary"


def records(texts: DataFrame, seed: int, spread: int) -> DataFrame:
    """(suffix, tid, place, after, before): each of ``places`` of (tid, text, places), with the words after its seed and before it."""

    def run(batches):
        for batch in batches:
            for block in blocks(batch, 1, 1 << 18):
                found = Suffixes(block.column("text").fill_null(""), seed, spread)
                listed = block.column("places")
                sizes = listed.value_lengths().to_numpy(zero_copy_only=False)
                wanted = listed.flatten().to_numpy() + np.repeat(found.bounds[:-1], sizes)
                use = np.flatnonzero(np.isin(found.place, wanted))
                words = (found.tokens >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                tids = block.column("tid").to_numpy()
                for part in np.array_split(use, -(-len(use) // 4096)) if len(use) else ():
                    place, row = found.place[part], found.row[part]
                    low, high = found.bounds[row], found.bounds[row + 1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.keys[part].view(np.int64)),
                            pa.array(tids[row]),
                            pa.array((place - low).astype(np.int32)),
                            context(words, place + seed, 1, spread, low, high),
                            context(words, place - 1, -1, spread, low, high),
                        ],
                        names=["suffix", "tid", "place", "after", "before"],
                    )

    return map_arrow(texts.select("tid", "text", "places"), run, RECORD)


def shared_words(suffix: np.ndarray, tids: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each of the sorted records the most words in common with a record of the same seed from another text; -1: none."""
    n = len(tids)
    opens = np.flatnonzero(np.r_[True, tids[1:] != tids[:-1]])
    run = np.searchsorted(opens, np.arange(n), "right") - 1
    closes = np.r_[opens[1:], n]
    best = np.full(n, -1)
    for other in (opens[run] - 1, closes[run]):
        at = np.flatnonzero((other >= 0) & (other < n))
        at = at[suffix[at] == suffix[other[at]]]
        differ = (words[at] != words[other[at]]) | (words[at] == 0)
        best[at] = np.maximum(best[at], np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1]))
    return best


def compared(sorted_records: DataFrame, side: str, width: int, borders: bool) -> DataFrame:
    """(tid, place, n, suffix, words) of sorted (suffix, words, tid, place): ``n`` words are shared on that side.

    With ``borders`` also the records at either end of the task's range follow, with n null
    and all they hold: the first and the last text's, and the nearest one of another text.
    """
    chunk = 1 << 16

    def told(table: pa.Table) -> pa.RecordBatch:
        suffix, tids = table.column("suffix").to_numpy(), table.column("tid").to_numpy()
        words = np.frombuffer(b"".join(table.column(side).to_pylist()), ">u4").reshape(-1, width)
        n = shared_words(suffix, tids, words)
        some = np.flatnonzero(n >= 0)
        place = table.column("place").to_numpy()
        return pa.RecordBatch.from_arrays(
            [pa.array(tids[some]), pa.array(place[some]), pa.array(n[some].astype(np.int32)), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary())],
            names=["tid", "place", "n", "suffix", "words"],
        )

    def edge(table: pa.Table, rows: np.ndarray) -> pa.RecordBatch:
        part = table.take(pa.array(rows)).combine_chunks()
        column = lambda c: part.column(c).combine_chunks()
        return pa.RecordBatch.from_arrays([column("tid"), column("place"), pa.nulls(len(rows), pa.int32()), column("suffix"), column(side)], names=["tid", "place", "n", "suffix", "words"])

    def run(batches):
        held: pa.Table | None = None
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < chunk:
                continue
            tids = held.column("tid").to_numpy()
            # the last text's records and the one before them see the next chunk too
            turns = np.flatnonzero(tids[1:] != tids[:-1])
            if len(turns) < 2:
                continue
            if first and borders:
                yield edge(held, np.arange(turns[0] + 2))
            first = False
            yield told(held)
            held = held.slice(int(turns[-2]) + 1)
        if held is None:
            return
        tids = held.column("tid").to_numpy()
        turns = np.flatnonzero(tids[1:] != tids[:-1])
        if borders:
            last = np.arange(turns[-1] if len(turns) else 0, len(tids))
            lead = np.arange((turns[0] + 2) if len(turns) else len(tids)) if first else last[:0]
            yield edge(held, np.unique(np.r_[lead, last]))
        yield told(held)

    return map_arrow(sorted_records, run, "tid bigint, place int, n int, suffix bigint, words binary")


def extensions(found: DataFrame, side: str, width: int) -> DataFrame:
    """(tid, place, n): words shared on one ``side`` of each place whose seed another text has."""
    keys = ["suffix", side, "tid", "place"]
    told = stage_table(compared(found.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys), side, width, True), f"shared-{side}")
    keys[1] = "words"
    # a bounded number of records from each task
    edges = told.where("n is null").select(*keys).dropDuplicates(["tid", "place"]).coalesce(1).sortWithinPartitions(*keys)
    again = compared(edges, "words", width, False)
    return told.where("n is not null").select("tid", "place", "n").union(again.select("tid", "place", "n"))


def repeated_passages(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS, seed: int = SEED, spread: int = SPREAD, gap: int = GAP
) -> DataFrame:
    """(``key``, start, n_words): the spans of each text, in words, that other texts or copies repeat."""
    rows = docs.select(F.col(key).alias("__key"), *text_keys(F.col(text)), F.col(text).alias("text"))
    listed = stage_table(with_suffixes(rows, "text", seed, spread), "suffixes")
    suffixes = listed.select("tid", F.explode(F.arrays_zip("suffixes", "places")).alias("s")).select("tid", F.col("s.suffixes").alias("suffix"), F.col("s.places").alias("place"))
    matched = stage_table(suffixes.groupBy("suffix").agg(F.min("tid").alias("least"), F.max("tid").alias("most")).where("least <> most").select("suffix"), "matched-suffixes")
    places = suffixes.join(matched, "suffix", "left_semi").groupBy("tid").agg(F.collect_set("place").alias("places"))
    texts = rows.groupBy("tid").agg(F.first("text").alias("text")).join(places, "tid")
    found = stage_table(records(texts, seed, spread), "records")
    right, left = extensions(found, "after", spread), extensions(found, "before", spread)
    reach = right.select("tid", F.col("place").cast("bigint").alias("low"), (F.col("place") + seed + F.col("n")).cast("bigint").alias("high")).union(
        left.select("tid", (F.col("place") - F.col("n")).cast("bigint"), (F.col("place") + seed).cast("bigint"))
    )
    runs = reach.groupBy("tid", "low").agg(F.max("high").alias("high"))
    before = Window.partitionBy("tid").orderBy("low")
    so_far = F.max(F.col("high") + gap).over(before.rowsBetween(Window.unboundedPreceding, -1))
    numbered = runs.select("tid", "low", "high", F.coalesce(F.col("low") > so_far, F.lit(True)).cast("int").alias("opens"))
    numbered = numbered.withColumn("span", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("tid", "span").agg(F.min("low").alias("start"), (F.max("high") - F.min("low")).alias("n_words")).where(F.col("n_words") >= min_words)
    long_rows = listed.where(F.col("n_words") >= min_words).select("__key", "tid", "tie", "n_words")
    # a table of its own, so that the joins with it can split a text with very many copies
    copies = stage_table(long_rows.groupBy("tid", "tie").agg(F.count("*").alias("n")).where("n > 1").select("tid", "tie"), "copied-texts")
    whole = long_rows.join(copies, ["tid", "tie"], "left_semi").select(F.col("__key").alias(key), F.lit(0).cast("bigint").alias("start"), "n_words")
    single = long_rows.join(copies, ["tid", "tie"], "left_anti").select("__key", "tid")
    return single.join(spans, "tid").select(F.col("__key").alias(key), "start", "n_words").union(whole)
