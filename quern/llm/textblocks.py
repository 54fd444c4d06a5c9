"""Arrow batches of texts as flat numpy arrays: splitting, hashing and run helpers.

All text operators that run in Python work on blocks of whole texts. A block holds at
most ``BLOCK_BYTES`` of text, or one text if that alone is longer, so a worker's memory
is bounded by the longest text and never by the size of a partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import map_arrow

BLOCK_BYTES = 1 << 20
TEXT_SLOT = "__quern_text"

Compute = Callable[[pa.Array, np.ndarray], list]


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add, whatever their letter case."""
    taken = {name.lower() for name in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def blocks(batch: pa.RecordBatch, at: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes in column ``at``, or one row."""
    if not batch.num_rows:
        return
    column = batch.column(at)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        sizes = pc.multiply(pc.list_value_length(column), 4)
    else:
        sizes = pc.binary_length(column)
    total = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(total):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(first, last - first)
        first = last


def append_columns(
    df: DataFrame,
    column: str,
    compute: Compute,
    fields: list[T.StructField],
    keep_column: bool = True,
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with ``fields`` computed from ``column`` block by block.

    ``compute`` gets the column without nulls (empty in their place) and a mask of the
    rows that were not null. Input columns that share a name with a new field are
    replaced by it; all others pass through unchanged.
    """
    taken = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken and (keep_column or f.name != column)]
    names = [f.name for f in kept]
    inside = column in names
    source = df.select(*[F.col(f"`{n}`") for n in names], *([] if inside else [F.col(f"`{column}`").alias(TEXT_SLOT)]))
    at = names.index(column) if inside else len(names)
    schema = T.StructType([*kept, *fields])
    out_names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at, limit):
                values = block.column(at)
                valid = pc.is_valid(values).to_numpy(zero_copy_only=False)
                if not pa.types.is_list(values.type) and not pa.types.is_large_list(values.type):
                    values = pc.fill_null(values, "")
                new = compute(values, valid)
                yield pa.RecordBatch.from_arrays([*[block.column(i) for i in range(len(names))], *new], names=out_names)

    return map_arrow(source, run, schema)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, each text closed by a line feed, and the n + 1 offsets.

    Text i is ``data[offsets[i]:offsets[i + 1] - 1]``.
    """
    empty, feed = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
    closed = pc.binary_join_element_wise(texts.cast(pa.large_string()), empty, feed)
    offsets = np.frombuffer(closed.buffers()[1], np.int64)[closed.offset : closed.offset + len(closed) + 1]
    if not len(closed):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(closed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: White space of the word rule: blank and the controls from tab to carriage return.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Word bytes of the word rule without punctuation: digits, letters A-Z and all beyond ASCII.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = is_word[data]
    step = np.diff(mask)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, step in (("up", self.base), ("down", self.inverse)):
                values = np.full(size, step, np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))
        return self.up, self.down


BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
TOKEN_POWERS = Powers(0xD6E8FEB86659FD93)
BYTE_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by prefix sums of a polynomial over random byte values."""
    up, down = BYTE_POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive tokens; the caller masks runs that cross texts."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    up, down = TOKEN_POWERS.upto(len(tokens) + 1)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[: len(tokens)], out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * down[: len(tokens) - n + 1])


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def list_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values, kind))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]] as 64-bit integers, empty segments included."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:], dtype=np.int64)
    return sums[bounds[1:]] - sums[bounds[:-1]]


#: Bits of the hashed keys that are dealt out by range.
KEY_BITS = 56


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers by byte planes: all low bytes, then all second bytes, and so on; compressed."""
    wide = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + zlib.compress(np.ascontiguousarray(wide[:, :width].T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : data[0]] = planes.T
    return wide.view("<u8")[:, 0]
