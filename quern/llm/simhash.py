"""SimHash near-duplicates, found with Golay-code fuzzy hashing.

Fingerprint: 64 bits over the XXH64 values (seed 42) of word shingles, repeats included;
a bit is 1 where over half of the values have it. Fingerprints link at two or fewer
differing bits. A fingerprint is cut into three segments. Two errors leave one segment
exact and, in a fixed next one, at most one error: so the key of each (exact segment,
next segment) pair holds the exact bits and the index of a codeword of the perfect
(23, 12) Golay code. Each segment value gives the codewords nearest to it and to its
values with one bit flipped, one to six different ones, so values with one or two
differing bits share a key, and most with three or four do. No link is lost.

``one_of_each`` takes a wider measure: 192 bits over the set of five-word shingles, linked
where at least 0.8125 of the bits agree (36 or fewer differ), as the fingerprints of sets with
a Jaccard similarity of 0.8 nearly always do. Eight segments of 23 bits stand in a ring, and
a key holds the codeword indices of two neighbours: texts that link agree, but for few
errors, in some two neighbouring segments. The keys find all but few links (see README).

Fingerprints that share a key are compared in the task that holds the key, bit by bit,
and united; those that are united already aren't compared again, so a group of copies
costs about its size. What leaves a task is a tree of links for each group, never pairs.
Components follow by rounds of minimum labels with shortcuts, each round cut by a table
in the shared folder.

Defined results: a null or empty text, or one without words, has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle; repeated rows share
fingerprint and component; null ids never become a component id unless a whole component
has no id; an empty table gives an empty result. Equal fingerprints are one class with
one row from the first aggregation on, so groups of copies don't multiply. Names of
further columns don't matter, unless they begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.decontamination import token_rows
from quern.llm.textblocks import KEY_BITS, LOWER, SPACE, append_columns, flat_bytes, gram_hashes, mixed, packed, unpacked, word_spans
from quern.session import map_arrow, stage_table

#: Primes of XXH64 (fixed values).
P1, P2, P3, P4, P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
#: Generator polynomial of the binary (23, 12) Golay code (a fixed value).
GOLAY = 0xC75
#: Low bit and width of the three fingerprint segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans at once; all spans at the same step advance together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))

    def step(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
        return rotl(acc + value * P2, 31) * P1

    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed64 + P5)
        at, left = starts.copy(), lengths.copy()
        long = np.flatnonzero(lengths >= 32)
        if len(long):
            lanes = [np.full(len(long), x) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            live = np.arange(len(long))
            while len(live):
                rows = long[live]
                for i in range(4):
                    lanes[i][live] = step(lanes[i][live], words[at[rows] + 8 * i])
                at[rows] += 32
                left[rows] -= 32
                live = live[left[rows] >= 32]
            total = rotl(lanes[0], 1) + rotl(lanes[1], 7) + rotl(lanes[2], 12) + rotl(lanes[3], 18)
            for lane in lanes:
                total = (total ^ step(np.zeros_like(lane), lane)) * P1 + P4
            h[long] = total
        h += lengths.astype(np.uint64)
        rows = np.flatnonzero(left >= 8)
        while len(rows):
            h[rows] = rotl(h[rows] ^ step(np.uint64(0), words[at[rows]]), 27) * P1 + P4
            at[rows] += 8
            left[rows] -= 8
            rows = rows[left[rows] >= 8]
        rows = np.flatnonzero(left >= 4)
        h[rows] = rotl(h[rows] ^ ((words[at[rows]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[rows] += 4
        left[rows] -= 4
        rows = np.flatnonzero(left)
        while len(rows):
            h[rows] = rotl(h[rows] ^ (data[at[rows]].astype(np.uint64) * P5), 11) * P1
            at[rows] += 1
            left[rows] -= 1
            rows = rows[left[rows] > 0]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


#: For each byte value its eight bits, one in each byte of a 64-bit number.
SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits that over half of them have."""
    result = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return result
    # byte counters overflow at 256, so runs are summed in pieces of at most 255
    pieces = -(-counts[some] // 255)
    run_starts = np.cumsum(counts[some]) - counts[some]
    piece_of = np.repeat(np.arange(len(some)), pieces)
    nth = np.arange(len(piece_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    packed = np.add.reduceat(SPREAD[hashes.view(np.uint8).reshape(-1, 8)], run_starts[piece_of] + 255 * nth, axis=0)
    counted = packed.view(np.uint8).reshape(-1, 64).astype(np.int64)
    counted = np.add.reduceat(counted, np.cumsum(pieces) - pieces, axis=0)
    bits = counted * 2 > counts[some][:, None]
    result[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return result


def fingerprints(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    data, offsets = flat_bytes(texts)
    if not len(data):
        return np.zeros(len(texts), np.uint64)
    data = LOWER[data]
    starts, ends = word_spans(data, ~SPACE)
    # words with one blank after each
    keep = ~SPACE[data]
    keep[ends] = True
    joined = data[keep]
    sizes = ends - starts
    first = np.cumsum(sizes + 1) - (sizes + 1)
    joined[first + sizes] = 0x20
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    counts = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(counts)), counts)
    begin = bounds[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = begin + np.minimum(n_words, shingle)[row] - 1
    return majority(xxh64(joined, first[begin], first[last] + sizes[last] - first[begin]), counts)


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3, keep_text: bool = True) -> DataFrame:
    """``df`` with ``out``, the fingerprint as a signed bigint."""

    def compute(texts: pa.Array, _: np.ndarray) -> list:
        return [pa.array(fingerprints(texts, shingle).view(np.int64))]

    return append_columns(df, text, compute, [T.StructField(out, T.LongType())], keep_column=keep_text)


class Golay:
    """Nearest codewords of 23-bit words by their syndromes."""

    def __init__(self) -> None:
        self.parts = [np.array([self.remainder(b << (8 * i)) for b in range(256)], np.int64) for i in range(3)]
        self.errors = np.zeros(2048, np.int64)
        ones = [1 << i for i in range(23)]
        patterns = {0, *ones, *(a | b for a in ones for b in ones), *(a | b | c for a in ones for b in ones for c in ones)}
        for pattern in patterns:
            self.errors[self.remainder(pattern)] = pattern

    @staticmethod
    def remainder(word: int) -> int:
        for i in range(23, 10, -1):
            if word >> i & 1:
                word ^= GOLAY << (i - 11)
        return word

    def index(self, words: np.ndarray) -> np.ndarray:
        syndrome = self.parts[0][words & 255] ^ self.parts[1][words >> 8 & 255] ^ self.parts[2][words >> 16]
        return (words ^ self.errors[syndrome]) >> 11


_GOLAY: list[Golay] = []


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each fingerprint, flat, and their number for each."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    code = _GOLAY[0]
    segments = [((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    keys = []
    for i, exact in enumerate(segments):
        after = (i + 1) % 3
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[after][1]))])
        near = np.sort(code.index(segments[after][:, None] ^ flips[None, :]), axis=1)
        keys.append(np.where(np.diff(near, axis=1, prepend=-1) > 0, (i << 40) + (exact[:, None] << 12) + near, -1))
    table = np.concatenate(keys, axis=1)
    return table[table >= 0], (table >= 0).sum(axis=1)


def ring_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each wide fingerprint (rows of 64-bit words), flat, and their number for each."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    flips = np.array([0, *(1 << b for b in range(23))])
    n = bits.shape[1] // 23
    near = []
    for i in range(n):
        segment = bits[:, 23 * i : 23 * i + 23].astype(np.int64) @ (1 << np.arange(23))
        found = np.sort(_GOLAY[0].index(segment[:, None] ^ flips[None, :]), axis=1)
        # six different codewords at most, moved to the front
        new = np.diff(found, axis=1, prepend=-1) > 0
        place = np.where(new, np.cumsum(new, axis=1) - 1, 6)
        slots = np.full((len(fps), 7), -1)
        np.put_along_axis(slots, place, found, axis=1)
        near.append(slots[:, :6])
    keys = []
    for i in range(n):
        one, two = near[i][:, :, None], near[(i + 1) % n][:, None, :]
        keys.append(np.where((one >= 0) & (two >= 0), (i << 24) + (one << 12) + two, -1).reshape(len(fps), 36))
    table = np.concatenate(keys, axis=1)
    return table[table >= 0], (table >= 0).sum(axis=1)


@dataclass(frozen=True)
class Measure:
    """Fingerprints of ``words`` 64-bit words that link at ``radius`` differing bits or fewer.

    ``keys`` gives their fuzzy keys, about ``n_keys`` each; a bucket gets some ``per_bucket`` of all keys.
    """

    words: int
    radius: int
    keys: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    n_keys: int
    per_bucket: int


NARROW = Measure(1, 2, lambda fps: fuzzy_keys(fps[:, 0]), 16, 1_000_000)
WIDE = Measure(3, 36, ring_keys, 224, 1_000_000)
#: Fingerprints whose keys a task makes at once, and pairs that it compares at once.
KEYED, COMPARED = 2048, 250_000


def keyed(classes: DataFrame, measure: Measure, n_buckets: int) -> DataFrame:
    """(bucket, fps, keys, refs): the fuzzy keys of many fingerprints in one range of keys, sorted, and whose they are."""

    def pieces(fps: np.ndarray):
        keys, counts = measure.keys(fps)
        hashes = mixed(keys.astype(np.uint64)) >> np.uint64(64 - KEY_BITS)
        ref = np.repeat(np.arange(len(fps)), counts)
        order = np.argsort(hashes)
        hashes, ref = hashes[order], ref[order]
        edges = np.searchsorted(hashes, [(i << KEY_BITS) // n_buckets for i in range(n_buckets)] + [1 << KEY_BITS])
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[bucket], edges[bucket + 1])
            used, own = np.unique(ref[part], return_inverse=True)
            yield bucket, fps[used].tobytes(), packed(np.diff(hashes[part], prepend=np.uint64(0))), packed(own)

    def run(batches):
        for batch in batches:
            fps = np.stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False).view(np.uint64) for i in range(measure.words)], axis=1)
            for at in range(0, len(fps), KEYED):
                found = list(pieces(fps[at : at + KEYED]))
                for low in range(0, len(found), 64):
                    bucket, *rest = zip(*found[low : low + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], names=["bucket", "fps", "keys", "refs"])

    columns = [f"f{i}" for i in range(measure.words)]
    return map_arrow(classes.select(*columns), run, "bucket bigint, fps binary, keys binary, refs binary")


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each a and b; ``parent`` names the least member of every set, before and after."""
    while len(a):
        a, b = parent[a], parent[b]
        differ = a != b
        a, b = a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = parent[parent]
            if np.array_equal(further, parent):
                break
            parent[:] = further


def linked(keys: np.ndarray, refs: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the least one that it is connected with by links between sharers of a key."""
    order = np.argsort(keys, kind="stable")
    keys, refs = keys[order], refs[order]
    parent = np.arange(len(fps))

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), COMPARED):
            x, y = a[at : at + COMPARED], b[at : at + COMPARED]
            x, y = x[parent[x] != parent[y]], y[parent[x] != parent[y]]
            near = np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1) <= radius
            unite(parent, x[near], y[near])

    def runs() -> tuple[np.ndarray, np.ndarray]:
        opens = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return opens, np.diff(np.r_[opens, len(keys)])

    def unsettled(distance: int = 1) -> None:
        """Leave out keys whose sharers are all united, or that have none so far from another."""
        nonlocal keys, refs
        opens, sizes = runs()
        if len(opens):
            label = parent[refs]
            differ = np.minimum.reduceat(label, opens) != np.maximum.reduceat(label, opens)
            open_keys = np.repeat(differ & (sizes > distance), sizes)
            keys, refs = keys[open_keys], refs[open_keys]

    unsettled()
    for pivot in (0.0, 0.5, 1.0):
        opens, sizes = runs()
        compare(refs, np.repeat(refs[opens + (pivot * (sizes - 1)).astype(np.int64)], sizes))
        unsettled()
    distance = 1
    while distance < len(keys):
        same = np.flatnonzero(keys[distance:] == keys[:-distance])
        if not len(same):
            break
        compare(refs[same], refs[same + distance])
        distance += 1
        if distance < 8 or distance % 16 == 0:
            # whole keys go, so the distances of the other sharers stay
            unsettled(distance)
    return parent


def links(classes: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): trees of links, a > b, that join all fingerprints of ``classes`` (cls, f0...) that share a key and link."""
    n_buckets = classes.count() * measure.n_keys // measure.per_bucket + 1
    pieces = keyed(classes, measure, n_buckets).repartition("bucket").sortWithinPartitions("bucket")

    def told(held: list) -> pa.RecordBatch:
        fps = [np.frombuffer(f, np.uint64).reshape(-1, measure.words) for f, _, _ in held]
        shift = np.cumsum([0, *map(len, fps)])
        keys = np.concatenate([np.cumsum(unpacked(k)) for _, k, _ in held])
        refs = np.concatenate([unpacked(r).astype(np.int64) + at for (_, _, r), at in zip(held, shift)])
        table = np.concatenate(fps)
        parent = linked(keys, refs, table, measure.radius)
        some = np.flatnonzero(parent != np.arange(len(parent)))
        names = class_names(table)
        a, b = names[some], names[parent[some]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def run(batches):
        at, held = None, []
        for batch in batches:
            for bucket, *rest in zip(*(batch.column(c).to_pylist() for c in ("bucket", "fps", "keys", "refs"))):
                if bucket != at and held:
                    yield told(held)
                    held = []
                at = bucket
                held.append(rest)
        if held:
            yield told(held)

    return map_arrow(pieces, run, "a bigint, b bigint").distinct()


def class_names(fps: np.ndarray) -> np.ndarray:
    """A 64-bit name of each fingerprint: itself, if it has no more words."""
    if fps.shape[1] == 1:
        return fps[:, 0].view(np.int64)
    with np.errstate(over="ignore"):
        name = np.zeros(len(fps), np.uint64)
        for i in range(fps.shape[1]):
            name = mixed(name + fps[:, i] * np.uint64(0x9E3779B97F4A7C15))
    return name.view(np.int64)


def components(edges: DataFrame, label: str = "label") -> DataFrame:
    """(a, label): for each end of an edge the smallest one it is connected with."""
    both = stage_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stage_table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("theirs")), "b")
        least = near.groupBy("a").agg(F.min("theirs").alias("theirs"))
        told = labels.join(least, "a").select("a", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        hop = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
        told = told.join(hop, "label").select("a", "old", F.least("label", "further").alias("label"))
        told = stage_table(told, "labels")
        labels = told.select("a", "label")
        if told.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", label)


def class_components(prints: DataFrame, key: str, measure: Measure = NARROW) -> DataFrame:
    """(fp, component, component_id) for each distinct fingerprint of ``prints`` (``key``, fp and, if wide, f0...).

    ``component`` is the component's smallest fingerprint name, ``component_id`` its smallest key.
    """
    words = [F.col("fp").alias("f0")] if measure.words == 1 else [F.col(f"f{i}") for i in range(measure.words)]
    named = prints.select("fp", F.col(f"`{key}`").alias("__key"), *words)
    firsts = [F.first(f"f{i}").alias(f"f{i}") for i in range(measure.words)]
    classes = stage_table(named.groupBy("fp").agg(F.min("__key").alias("least_id"), *firsts), "fingerprint-classes")
    labels = components(links(classes, measure)).withColumnRenamed("a", "fp")
    named = classes.join(labels, "fp", "left").select("fp", "least_id", "label")
    joined = named.where("label is not null")
    least = joined.groupBy("label").agg(F.min("least_id").alias("component_id"))
    found = joined.join(least, "label").select("fp", F.col("label").alias("component"), "component_id")
    return found.union(named.where("label is null").select("fp", "fp", F.col("least_id").alias("component_id")))


def simhash_near_dup(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``key``, ``fp``, ``component`` and ``component_id`` for each row of ``docs``."""
    named = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    prints = stage_table(with_fingerprint(named, "__text", "fp", shingle, keep_text=False), "fingerprints")
    found = prints.join(class_components(prints, "__key"), "fp")
    return found.select(F.col("__key").alias(key), *[F.col(c).alias(f"{c}_" if c == key else c) for c in ("fp", "component", "component_id")])


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, flat and sorted, and the n + 1 bounds of the texts."""
    tokens, bounds = token_rows(texts)
    n_words = np.diff(bounds)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in range(1, shingle + 1):
        some = np.flatnonzero(n_words >= n) if n == shingle else np.flatnonzero(n_words == n)
        if not len(some):
            continue
        grams = gram_hashes(tokens, n)
        counts = n_words[some] - n + 1
        row = np.repeat(some, counts)
        at = bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        rows.append(row)
        found.append(grams[at])
    row, grams = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])] if len(row) else np.zeros(0, bool)
    return grams[new], np.searchsorted(row[new], np.arange(len(texts) + 1))


def wide_fingerprints(texts: pa.Array, shingle: int, words: int = WIDE.words) -> np.ndarray:
    """Fingerprints of the sets of shingles, a row of 64-bit words for each text."""
    grams, bounds = shingle_sets(texts, shingle)
    return np.stack([majority(mixed(grams ^ mixed(np.full(1, i + 1, np.uint64))), np.diff(bounds)) for i in range(words)], axis=1)


#: Rows to drop that are broadcast, 16 bytes each; more are dropped by a join by shuffle.
BROADCAST_ROWS = 1_000_000


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, measure: Measure = WIDE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest key, of equal rows any."""
    row = [F.xxhash64(F.col(f"`{key}`")).alias("__k"), F.xxhash64(F.col(f"`{text}`")).alias("__t")]
    named = docs.select(F.col(f"`{key}`").alias("__key"), *row, F.col(f"`{text}`").alias("__text"))

    def compute(texts: pa.Array, _: np.ndarray) -> list:
        fps = wide_fingerprints(texts, shingle, measure.words)
        return [pa.array(class_names(fps)), *(pa.array(fps[:, i].view(np.int64)) for i in range(measure.words))]

    fields = [T.StructField(c, T.LongType()) for c in ["fp", *(f"f{i}" for i in range(measure.words))]]
    prints = stage_table(append_columns(named, "__text", compute, fields, keep_column=False, limit=1 << 18), "wide-fingerprints")
    found = prints.join(class_components(prints, "__key", measure).select("fp", "component"), "fp")
    # the smallest key first, null keys last
    rank = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), "__k", "__t")
    chosen = found.groupBy("component").agg(F.min(rank).alias("row")).select("row.__k", "row.__t")
    rows = prints.groupBy("__k", "__t").agg(F.count("*").alias("n"))
    marked = rows.join(chosen.withColumn("stays", F.lit(True)), ["__k", "__t"], "left")
    # rows that go, and chosen rows that are there more than once
    odd = stage_table(marked.where(F.col("stays").isNull() | (F.col("n") > 1)).select("__k", "__t", F.coalesce("stays", F.lit(False)).alias("__repeated")), "rows-to-drop")
    if odd.count() <= BROADCAST_ROWS:
        odd = F.broadcast(odd)
    placed = docs.withColumns({"__k": row[0], "__t": row[1]}).join(odd, ["__k", "__t"], "left")
    once = placed.where(F.col("__repeated").isNull()).drop("__k", "__t", "__repeated")
    again = placed.where(F.col("__repeated")).dropDuplicates(["__k", "__t"]).drop("__k", "__t", "__repeated")
    return once.union(again)
