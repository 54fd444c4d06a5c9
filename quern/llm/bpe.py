"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. A round looks up all pairs of
neighbours by binary search over the sorted pair keys, takes each word's lowest-ranked
pair and merges all of its occurrences, left to right. A merged symbol has a later rank
than the merge that made it, so merging all occurrences at once equals one at a time.
Words that have no pair left drop out; the rounds end when none is left.

Defined results: a null or empty text has no ids; ids outside the vocabulary, and null
ids, decode to nothing; a null list of ids decodes to the empty text; bytes that are not
UTF-8 decode to U+FFFD. Repeated rows are encoded alike, one by one. Input columns named
like a result are replaced. Texts are never cut; a very long word only takes more rounds.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm.textblocks import append_columns, flat_ranges

#: Distinct words that a worker remembers with their ids, before it starts anew.
REMEMBERED_WORDS = 100_000
#: The published word pattern of the byte-level vocabulary (a fixed value).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letter[b] for b in range(256)]


def unsettled_letters() -> np.ndarray:
    """By code point: characters newer than this Python's Unicode tables.

    Libraries disagree on the class of recently assigned characters; texts with one are
    split by the tokenizers library itself.
    """
    known = regex.compile(r"[\p{L}\p{N}\p{M}\p{S}\p{P}\p{Z}\p{C}--\p{Cn}]", regex.V1)
    return np.array([unicodedata.category(chr(c)) == "Cn" and bool(known.match(chr(c))) for c in range(0x110000)])


class Remembered(dict):
    """Word to row number; a new word gets the next row and is queued for the merge rounds."""

    def __init__(self, first: int):
        super().__init__()
        self.next, self.queue = first, []

    def __missing__(self, word: str) -> int:
        row = self[word] = self.next
        self.next += 1
        self.queue.append(word)
        return row


class BytePairCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path = path
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[x] for x in token) if all(x in byte_of for x in token) else token.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_sizes = np.array([len(p) for p in pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.byte_ids = np.array([vocab[x] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.pair_made = keys[order], order.astype(np.int64), made[order]
        self.words = regex.compile(WORD_PATTERN).findall
        self.unsettled = unsettled_letters()
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.library = None
        self.forget()

    def forget(self) -> None:
        self.rows = Remembered(len(self.special))
        for row, word in enumerate(self.special):
            self.rows[word] = row
        self.row_ids = [np.array([*self.special.values()], np.int32)]
        self.row_sizes = [np.ones(len(self.special), np.int64)]

    def split(self, text: str) -> list[str]:
        if not text.isascii() and self.unsettled[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.words(text)

    def pieces(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self.split(text)
        found: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            found += [part] if i % 2 else self.split(part)
        return found

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and their number for each word."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            rank = np.full(len(symbols), NO_RANK)
            same = np.flatnonzero(owner[:-1] == owner[1:])
            keys = symbols[same] * self.size + symbols[same + 1]
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            known = self.pair_keys[place] == keys
            rank[same[known]] = self.pair_ranks[place[known]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(rank, starts)
            active = np.repeat(best < NO_RANK, lengths)
            done_symbols.append(symbols[~active])
            done_owner.append(owner[~active])
            symbols, owner, rank = symbols[active], owner[active], rank[active]
            if not len(symbols):
                break
            hits = np.flatnonzero(rank == np.repeat(best, lengths)[active])
            # of overlapping hits, as in a run of one symbol, every other one counts, from the left
            opens = np.r_[True, np.diff(hits) > 1]
            run = np.cumsum(opens) - 1
            hits = hits[(hits - hits[opens][run]) % 2 == 0]
            by_rank = self.made_by_rank
            symbols[hits] = by_rank[rank[hits]]
            gone = np.ones(len(symbols), bool)
            gone[hits + 1] = False
            symbols, owner = symbols[gone], owner[gone]
        ids, owners = np.concatenate(done_symbols or [symbols]), np.concatenate(done_owner or [owner])
        order = np.argsort(owners, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owners, minlength=len(raw)).astype(np.int64)

    @property
    def made_by_rank(self) -> np.ndarray:
        if not hasattr(self, "_made_by_rank"):
            self._made_by_rank = np.zeros(len(self.pair_ranks), np.int64)
            self._made_by_rank[self.pair_ranks] = self.pair_made
        return self._made_by_rank

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and their number for each text."""
        if len(self.rows) > REMEMBERED_WORDS:
            self.forget()
        found: list[str] = []
        counts = []
        for text in texts:
            before = len(found)
            found += self.pieces(text)
            counts.append(len(found) - before)
        row = np.fromiter(map(self.rows.__getitem__, found), np.int64, len(found))
        if self.rows.queue:
            ids, sizes = self.merge(self.rows.queue)
            self.row_ids, self.row_sizes = [*self.row_ids, ids], [*self.row_sizes, sizes]
            self.rows.queue = []
        self.row_ids, self.row_sizes = [np.concatenate(self.row_ids)], [np.concatenate(self.row_sizes)]
        sizes = self.row_sizes[0]
        starts = np.cumsum(sizes) - sizes
        ids = self.row_ids[0][flat_ranges(starts[row], sizes[row])]
        bounds = np.r_[0, np.cumsum(counts)].astype(np.int64)
        reach = np.r_[0, np.cumsum(sizes[row])]
        return ids, np.diff(reach[bounds])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < self.size)
        sizes = np.where(known, self.piece_sizes[np.where(known, ids, 0)], 0)
        data = self.piece_bytes[flat_ranges(self.piece_starts[np.where(known, ids, 0)], sizes)].tobytes()
        reach = np.r_[0, np.cumsum(sizes)]
        ends = reach[np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


_CODECS: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    """One codec a worker, kept over tasks."""
    if path not in _CODECS:
        _CODECS[path] = BytePairCodec(path)
    return _CODECS[path]


def bpe_encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = True) -> DataFrame:
    """``df`` with ``ids``, an array<int>: the byte-level BPE ids of ``text``.

    ``path`` names the vocabulary file, which every worker must be able to read.
    """

    def compute(texts: pa.Array, _: np.ndarray) -> list:
        flat, counts = codec(path).encode(texts.to_pylist())
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]

    return append_columns(df, text, compute, [T.StructField(ids, T.ArrayType(T.IntegerType()))], keep_column=keep_text)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``df`` with ``text``, the text that ``ids`` stand for."""

    def compute(lists: pa.Array, _: np.ndarray) -> list:
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        return [pa.array(codec(path).decode(flat, sizes), pa.string())]

    return append_columns(df, ids, compute, [T.StructField(text, T.StringType())], keep_column=keep_ids)
