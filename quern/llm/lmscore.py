"""Language-model scoring by cross-entropy difference.

Two word bigram models are trained alike, one on target rows and one on all rows, the
background, over all words and bigrams of the corpus; none is cut, and no table of them
is ever broadcast or gathered. Tasks take the texts in chunks. A chunk sends its distinct
n-grams, with its own counts and sorted by key, in ranges of keys to as many buckets as
the corpus needs for them to be of one size. A bucket adds up the counts of its n-grams,
which are then those of the whole corpus, and sends each chunk the counts of what it had
sent, in the same order. The chunk itself, its words as numbers, goes by the bucket's
stage to where its counts meet it, and its texts are scored there. An n-gram makes one
row of a chunk, however frequent it is, so a bucket has no hot key. ``train`` and
``score`` do the same with a model in memory, for small corpora.

P(w | h) = weight * c(h w) / (N P(h)) + (1 - weight) * P(w), with P(w) = (c(w) + 1) / (N + V + 1).
Per token the losses of both models and their difference follow; a text's score is the
mean of background loss less target loss, higher for texts closer to the target.

Defined results: null and empty texts have no tokens and null losses; case doesn't count;
null labels and keys are no targets; without target rows the target model is uniform over
the shared vocabulary; repeated rows are counted and scored each; an empty table gives an
empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.decontamination import token_rows
from quern.llm.textblocks import KEY_BITS, append_columns, blocks, gram_hashes, mixed, packed, unpacked, without
from quern.session import map_arrow, stage_table

#: Tokens of a chunk of texts, and of the corpus for each bucket of n-grams.
CHUNK_TOKENS = BUCKET_TOKENS = 2_000_000
#: Weight of the bigram estimate against the unigram's.
WEIGHT = 0.6
#: Tokens that a task of ``train`` gathers before it emits their distinct n-grams with counts.
GATHERED_TOKENS = 600_000
#: Pieces of a chunk in a record batch.
PIECES = 256
#: Rows of a record batch that goes back to the JVM.
BATCH_ROWS = 100_000
#: Up to so many target keys are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def ngram_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unigram keys (even), bounds of the texts, bigram keys (odd) and the places of their second words."""
    tokens, bounds = token_rows(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pairs = gram_hashes(tokens, 2)
    whole = np.flatnonzero(row[:-1] == row[1:]) if len(row) else row
    one = np.uint64(1)
    return (tokens & ~one), bounds, pairs[whole] | one, whole + 1


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(ngram, n, target) from (text, is_target): counts in all rows and in target rows."""

    def emit(keys: list[np.ndarray], marks: list[np.ndarray]):
        ngram, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, minlength=len(ngram))
        target = np.bincount(inverse, weights=np.concatenate(marks), minlength=len(ngram)).astype(np.int64)
        for at in range(0, len(ngram), BATCH_ROWS):
            part = slice(at, at + BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(ngram[part].view(np.int64)), pa.array(n[part]), pa.array(target[part])], names=["ngram", "n", "target"])

    def run(batches):
        keys: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        for batch in batches:
            for block in blocks(batch, 0):
                one, bounds, two, second = ngram_keys(block.column(0).fill_null(""))
                mark = np.repeat(block.column(1).fill_null(False).to_numpy(zero_copy_only=False), np.diff(bounds))
                keys += [one, two]
                marks += [mark, mark[second]]
                if sum(map(len, keys)) >= 2 * GATHERED_TOKENS:
                    yield from emit(keys, marks)
                    keys, marks = [], []
        if keys:
            yield from emit(keys, marks)

    counted = map_arrow(rows, run, "ngram bigint, n bigint, target bigint")
    return counted.groupBy("ngram").agg(F.sum("n").alias("n"), F.sum("target").alias("target"))


@dataclass
class MatchedModels:
    """Counts of the shared n-grams in the background (row 0) and the target (row 1)."""

    ngrams: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.ngrams):
            return np.zeros((2, len(keys))), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.ngrams, keys), len(self.ngrams) - 1)
        known = self.ngrams[at] == keys
        return np.where(known, self.counts[:, at], 0.0), known

    def losses(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens and summed losses (background, target) of each text."""
        one, bounds, two, second = ngram_keys(texts)
        words = self.ngrams % 2 == 0
        seen = self.counts[:, words].sum(axis=1) if len(words) else np.zeros(2)
        total = self.tokens + words.sum() + 1
        count, known = self.look_up(one)
        unknown = np.maximum(self.tokens - seen, 0) + 1
        p = np.where(known, count + 1, unknown[:, None]) / total[:, None]
        pair, _ = self.look_up(two)
        given = p.copy()
        history = p[:, second - 1] * np.maximum(self.tokens, 1)[:, None]
        given[:, second] = WEIGHT * np.minimum(pair / history, 1) + (1 - WEIGHT) * p[:, second]
        sums = np.concatenate([np.zeros((2, 1)), np.cumsum(-np.log(given), axis=1)], axis=1)
        return np.diff(bounds), sums[:, bounds[1:]] - sums[:, bounds[:-1]]


def train(rows: DataFrame, model_size: int | None = None) -> MatchedModels:
    """Models from (text, is_target), in memory; only with ``model_size`` the rarest n-grams are left out."""
    counts = stage_table(count_ngrams(rows), "ngrams")
    totals = counts.where(F.pmod("ngram", F.lit(2)) == 0).agg(F.sum("n").alias("n"), F.sum("target").alias("target")).first()
    # a row for each different count; the cut-off is the least count that leaves no more than model_size n-grams
    sizes = counts.groupBy("n").agg(F.count("*").alias("ngrams")).toArrow().sort_by([("n", "descending")])
    kept = len(sizes) if model_size is None else np.searchsorted(np.cumsum(sizes.column("ngrams").to_numpy()), model_size, "right")
    cut = sizes.column("n")[int(kept) - 1].as_py() if kept else (sizes.column("n")[0].as_py() + 1 if len(sizes) else 1)
    found = counts.where(F.col("n") >= cut).toArrow()
    ngrams = found.column("ngram").to_numpy().view(np.uint64)
    order = np.argsort(ngrams)
    both = np.stack([found.column("n").to_numpy()[order], found.column("target").to_numpy()[order]]).astype(np.float64)
    return MatchedModels(ngrams[order], both, np.array([totals["n"] or 0, totals["target"] or 0], np.float64))


def score(docs: DataFrame, models: MatchedModels, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``background_loss``, ``target_loss`` (nats a token) and ``score``, their difference."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def compute(texts: pa.Array, _: np.ndarray) -> list:
        n, sums = shared.value.losses(texts)
        mean = sums / np.maximum(n, 1)
        none = n == 0
        return [pa.array(n.astype(np.int64)), *(pa.array(x, mask=none) for x in (mean[0], mean[1], mean[0] - mean[1]))]

    fields = [T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("background_loss", "target_loss", "score")]]
    return append_columns(docs, text, compute, fields, keep_column=keep_text)


def ngram_hashes(words: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all distinct words (even) and of bigrams (odd), by their words' hashes."""
    shift, one = np.uint64(64 - KEY_BITS), np.uint64(1)
    single = (mixed(words) >> shift) & ~one
    pairs = mixed(words[first] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[second])) >> shift
    return single, pairs | one


class Chunk:
    """Texts as numbers of their distinct words; ``keys`` are the sorted distinct n-grams."""

    def __init__(self, words: np.ndarray, number: np.ndarray, sizes: np.ndarray, marks: np.ndarray):
        self.words, self.number, self.sizes, self.marks = words, number, sizes, marks
        bounds = np.r_[0, np.cumsum(sizes)]
        self.starts = np.zeros(len(number), bool)
        self.starts[bounds[:-1][sizes > 0]] = True
        second = np.flatnonzero(~self.starts)
        self.second = second
        self.single, pairs = ngram_hashes(words, number[second - 1], number[second])
        self.pairs, self.pair_number = np.unique(pairs, return_inverse=True)
        self.keys = np.concatenate([self.single, self.pairs])
        self.order = np.argsort(self.keys)

    def counts(self) -> np.ndarray:
        """Counts of the sorted keys in all texts and in target texts."""
        mark = np.repeat(self.marks, self.sizes)
        found = []
        for weights in (None, mark):
            word = np.bincount(self.number, weights=weights, minlength=len(self.words))
            pair = np.bincount(self.pair_number, weights=None if weights is None else mark[self.second], minlength=len(self.pairs))
            found.append(np.concatenate([word, pair])[self.order])
        return np.stack(found).astype(np.int64)

    def losses(self, counts: np.ndarray, tokens: np.ndarray, n_words: int) -> np.ndarray:
        """Summed losses of the texts in both models, by the corpus counts of the sorted keys."""
        own = np.empty_like(counts, dtype=np.float64)
        own[:, self.order] = counts
        p = ((own[:, : len(self.words)] + 1) / (tokens + n_words + 1)[:, None])[:, self.number]
        given = p.copy()
        history = p[:, self.second - 1] * np.maximum(tokens, 1)[:, None]
        given[:, self.second] = WEIGHT * np.minimum(own[:, len(self.words) + self.pair_number] / history, 1) + (1 - WEIGHT) * p[:, self.second]
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return np.stack([np.bincount(row, weights=-np.log(x), minlength=len(self.sizes)) for x in given])


def sent(rows: DataFrame, n_buckets: int) -> DataFrame:
    """(dest, chunk, bucket, a, b, c): n-grams of chunks for the buckets, and the chunks themselves (bucket -1)."""

    def emit(parts: list, name: int):
        token, sizes, marks, ids = (np.concatenate(x) for x in zip(*parts))
        words, number = np.unique(token, return_inverse=True)
        chunk = Chunk(words, number, sizes, marks)
        keys, counts = chunk.keys[chunk.order], chunk.counts()
        texts = pickle.dumps([packed(sizes), packed(marks), packed(ids.view(np.uint64))])
        yield -1 - name, name, -1, packed(np.diff(words, prepend=np.uint64(0))), packed(number), texts
        edges = np.searchsorted(keys, [(i << KEY_BITS) // n_buckets for i in range(n_buckets)] + [1 << KEY_BITS])
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[bucket], edges[bucket + 1])
            yield bucket, name, bucket, packed(np.diff(keys[part], prepend=np.uint64(0))), packed(counts[0, part]), packed(counts[1, part])

    def batched(found):
        held: list = []
        for values in found:
            held.append(values)
            if len(held) == PIECES or values[2] < 0:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def batch_of(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*held), [pa.int64()] * 3 + [pa.binary()] * 3)], names=["dest", "chunk", "bucket", "a", "b", "c"])

    def run(batches):
        parts: list = []
        size, name = 0, TaskContext.get().partitionId() << 32  # the same chunks, if a task runs again
        for batch in batches:
            for block in blocks(batch, 0):
                token, bounds = token_rows(block.column(0).fill_null(""))
                parts.append((token, np.diff(bounds), block.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(np.int64), block.column(2).to_numpy()))
                size += len(token)
                if size >= CHUNK_TOKENS:
                    yield from batched(emit(parts, name))
                    parts, size, name = [], 0, name + 1
        if parts:
            yield from batched(emit(parts, name))

    return map_arrow(rows.select("text", "is_target", "id"), run, "dest bigint, chunk bigint, bucket bigint, a binary, b binary, c binary")


def summed(pieces: DataFrame) -> DataFrame:
    """(chunk, bucket, a, b, c): the corpus counts of each piece's n-grams; chunks pass unchanged."""

    def told(chunks: list, keys: list, counts: list):
        sizes = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        repeat = np.diff(np.r_[new, len(key)])
        totals = []
        for i in range(2):
            total = np.empty(len(key), np.int64)
            total[order] = np.repeat(np.add.reduceat(np.concatenate([c[i] for c in counts])[order], new), repeat)
            totals.append(total)
        ends = np.cumsum(sizes)
        for chunk, start, end in zip(chunks, (ends - sizes).tolist(), ends.tolist()):
            yield chunk, packed(totals[0][start:end]), packed(totals[1][start:end])

    def batch_of(bucket: int, found: list) -> pa.RecordBatch:
        chunk, a, b = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([bucket] * len(found), pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.nulls(len(found), pa.binary())], names=["chunk", "bucket", "a", "b", "c"])

    def run(batches):
        at, chunks, keys, counts = -1, [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, chunk, a, b, c = (batch.column(x)[i].as_py() for x in ("bucket", "chunk", "a", "b", "c"))
                if bucket != at and chunks:
                    yield batch_of(at, list(told(chunks, keys, counts)))
                    chunks, keys, counts = [], [], []
                at = bucket
                if bucket < 0:
                    yield batch.slice(i, 1).select(["chunk", "bucket", "a", "b", "c"])
                else:
                    chunks.append(chunk)
                    keys.append(np.cumsum(unpacked(a)))
                    counts.append((unpacked(b).astype(np.int64), unpacked(c).astype(np.int64)))
        if chunks:
            yield batch_of(at, list(told(chunks, keys, counts)))

    return map_arrow(pieces, run, "chunk bigint, bucket bigint, a binary, b binary, c binary")


def told_losses(counted: DataFrame, tokens: np.ndarray, n_words: int) -> DataFrame:
    """(id, n_tokens, l0, l1) of all texts, from the chunks and their counts in order."""

    def told(whole: tuple, counts: list) -> pa.RecordBatch:
        a, b, c = whole
        sizes, marks, ids = (unpacked(x) for x in pickle.loads(c))
        sizes = sizes.astype(np.int64)
        chunk = Chunk(np.cumsum(unpacked(a)), unpacked(b).astype(np.int64), sizes, marks.astype(np.int64))
        both = np.stack([np.concatenate([unpacked(x[i]) for x in counts]) if counts else np.zeros(0) for i in range(2)])
        sums = chunk.losses(both, tokens, n_words)
        return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1])], names=["id", "n_tokens", "l0", "l1"])

    def run(batches):
        whole, counts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, a, b, c = (batch.column(x)[i].as_py() for x in ("bucket", "a", "b", "c"))
                if bucket < 0:
                    if whole:
                        yield told(whole, counts)
                    whole, counts = (a, b, c), []
                else:
                    counts.append((a, b))
        if whole:
            yield told(whole, counts)

    return map_arrow(counted, run, "id bigint, n_tokens bigint, l0 double, l1 double")


def corpus_totals(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Tokens of all rows and of target rows, and the number of different words, from (text, is_target)."""

    def emit(tokens: list, totals: np.ndarray):
        words = np.unique(np.concatenate(tokens))
        for at in range(0, len(words), BATCH_ROWS):
            part = words[at : at + BATCH_ROWS].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64())], names=["word", "n", "target"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([int(x)]) for x in totals)], names=["word", "n", "target"])

    def run(batches):
        tokens: list = []
        totals = np.zeros(2, np.int64)
        for batch in batches:
            for block in blocks(batch, 0):
                token, bounds = token_rows(block.column(0).fill_null(""))
                mark = block.column(1).fill_null(False).to_numpy(zero_copy_only=False)
                totals += [len(token), np.diff(bounds)[mark].sum()]
                tokens.append(token)
                if sum(map(len, tokens)) >= CHUNK_TOKENS:
                    yield from emit(tokens, totals)
                    tokens, totals = [], np.zeros(2, np.int64)
        if tokens:
            yield from emit(tokens, totals)

    words = map_arrow(rows.select("text", "is_target"), run, "word bigint, n bigint, target bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("target").alias("target"))
    found = words.agg(F.count("word").alias("words"), F.sum("n").alias("n"), F.sum("target").alias("target")).first()
    return np.array([found["n"] or 0, found["target"] or 0], np.float64), found["words"]


def score_whole(docs: DataFrame, text: str = "text", target: str = "is_target") -> DataFrame:
    """``docs`` without text and target, with the columns of ``score`` by models of all n-grams of all rows."""
    results = ["n_tokens", "background_loss", "target_loss", "score"]
    others = [c for c in without(docs, results).columns if c not in (text, target)]
    # equal texts share an id if their rows fall in one of 64 groups, so that no id has all rows of a large group
    own = F.xxhash64(text, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in others]), F.lit(64)))
    marked = docs.withColumn("__id", own.bitwiseAND(F.lit(-2).cast("bigint")).bitwiseOR(F.coalesce(F.col(target), F.lit(False)).cast("bigint")))
    rows = marked.select(F.col(text).alias("text"), F.col(target).alias("is_target"), F.col("__id").alias("id"))
    tokens, n_words = corpus_totals(rows)
    pieces = sent(rows, int(tokens[0] // BUCKET_TOKENS) + 1).repartition("dest").sortWithinPartitions("dest")
    counted = summed(pieces).repartition("chunk").sortWithinPartitions("chunk", "bucket")
    losses = told_losses(counted, tokens, n_words).groupBy(F.col("id").alias("__id")).agg(*[F.max(c).alias(f"__{c}") for c in ("n_tokens", "l0", "l1")])
    mean = [F.when(F.col("__n_tokens") > 0, F.col(c) / F.col("__n_tokens")) for c in ("__l0", "__l1")]
    told = marked.select(*[F.col(f"`{c}`") for c in others], "__id").join(losses, "__id")
    return told.select(*[F.col(f"`{c}`") for c in others], F.col("__n_tokens").alias("n_tokens"), mean[0].alias("background_loss"), mean[1].alias("target_loss"), (mean[0] - mean[1]).alias("score"))


def with_targets(docs: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``is_target``: whether ``key`` is among those of ``targets``."""
    keys = targets.select(F.col(key).alias("__key")).where(F.col("__key").isNotNull()).distinct()
    few = keys.count() <= BROADCAST_KEYS
    marked = docs.join(F.broadcast(keys) if few else keys, F.col(key) == F.col("__key"), "left").withColumn("is_target", F.col("__key").isNotNull()).drop("__key")
    # rows that come out of a shuffle can come in another order if they are read again; staged ones can't
    return marked if few else stage_table(marked, "marked")
