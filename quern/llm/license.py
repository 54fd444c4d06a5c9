"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words are cut into overlapping blocks. A template matches a block if the block
holds at least ``threshold`` of the template's distinct tokens. The join is exact and
uses the usual filters. Tokens are ordered by their frequency over the whole corpus, the
rarest first, which one distributed count over all texts finds. A template with ``need``
tokens to share must share one of its first ``size - need + 1`` (prefix filter), a block
must have ``need`` words at least (length filter), and the merge of two ordered token
lists stops as soon as the tokens left on either side can't reach ``need`` (positional
filter). Templates marked as phrases are verified further: their words must stand one
after another; each such place is returned.

The templates are a parameter, their vocabulary bounds what is counted and broadcast.
Tokens outside that vocabulary can't be shared, so blocks are ordered without them.

Defined results: a null or empty text has no words, no places and no blocks; a phrase
that repeats is found at each place, overlaps included; equal rows give equal results;
an empty table gives an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.textblocks import LOWER, WORD, append_columns, blocks, flat_bytes, span_hashes, word_spans
from quern.session import map_arrow

#: Words of a block and between the starts of two blocks; a passage of up to half a block lies whole in one.
BLOCK_WORDS, BLOCK_STEP = 64, 32


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    threshold: float = 0.8
    phrase: bool = False


#: The base phrases (fixed values) and notices of common licenses.
TEMPLATES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", 0.95),
    Template("apache-2.0", "licensed under the apache license version 2 0", 0.95),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "licensed under a creative commons attribution license"),
    Template("cc-by-nc", "licensed under cc by nc", 1.0),
    Template("cc-by-sa", "licensed under cc by sa", 1.0),
    Template("cc0", "creative commons zero universal public domain dedication"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", 0.95),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    Template("proprietary", "all rights reserved", 1.0),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def spans_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, flat, and the n + 1 word bounds of the texts."""
    data, offsets = flat_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = LOWER[data]
    starts, ends = word_spans(data, WORD)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


class Vocabulary:
    """The templates' tokens, found in flat arrays of word hashes by binary search."""

    def __init__(self, templates: tuple[Template, ...]):
        self.tokens = sorted({w for t in templates for w in t.words.split()})
        hashes, _ = spans_of(pa.array([" ".join(self.tokens)]))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The token number of each word, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def token_ranks(docs: DataFrame, text: str, vocabulary: Vocabulary) -> list[int]:
    """Rank of each vocabulary token by its count over all texts, the rarest first."""
    n = len(vocabulary.tokens)

    def run(batches):
        counts = np.zeros(n, np.int64)
        for batch in batches:
            for block in blocks(batch, 0):
                hashes, _ = spans_of(block.column(0).fill_null(""))
                found = vocabulary.find(hashes)
                counts += np.bincount(found[found >= 0], minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(counts)], names=["token", "n"])

    counted = map_arrow(docs.select(text), run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    total = {row["token"]: row["n"] for row in counted.collect()}  # a row for each vocabulary token
    order = sorted(range(n), key=lambda t: (total.get(t, 0), vocabulary.tokens[t]))
    rank = [0] * n
    for r, token in enumerate(order):
        rank[token] = r
    return rank


def shared(template: list[int], block: list[int], need: int) -> int:
    """The number of shared tokens of two ordered lists, or 0 once ``need`` is out of reach."""
    i = j = have = 0
    while i < len(template) and j < len(block):
        if have + min(len(template) - i, len(block) - j) < need:
            return 0
        if template[i] == block[j]:
            have, i, j = have + 1, i + 1, j + 1
        elif template[i] < block[j]:
            i += 1
        else:
            j += 1
    return have if have >= need else 0


class Scanner:
    """Finds the matching (template, block) pairs of texts for one order of the tokens."""

    def __init__(self, templates: tuple[Template, ...], vocabulary: Vocabulary, rank: list[int]):
        self.templates, self.vocabulary, self.rank = templates, vocabulary, np.array(rank, np.int64)
        number = {w: i for i, w in enumerate(vocabulary.tokens)}
        self.sequence = [[rank[number[w]] for w in t.words.split()] for t in templates]
        self.ordered = [sorted(set(s)) for s in self.sequence]
        self.need = [max(1, math.ceil(t.threshold * len(o) - 1e-9)) for t, o in zip(templates, self.ordered)]
        self.by_prefix: dict[int, list[int]] = defaultdict(list)
        for t, (tokens, need) in enumerate(zip(self.ordered, self.need)):
            for token in tokens[: len(tokens) - need + 1]:
                self.by_prefix[token].append(t)
        self.in_prefix = np.zeros(len(rank) + 1, bool)
        self.in_prefix[[*self.by_prefix]] = True

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[dict]], list[list[dict]]]:
        """Number of words, phrase places and matched blocks of each text."""
        hashes, bounds = spans_of(texts)
        found = self.vocabulary.find(hashes)
        ranks = np.where(found >= 0, self.rank[found], -1) if len(self.rank) else found
        prefix = np.flatnonzero((ranks >= 0) & self.in_prefix[ranks])
        row = np.searchsorted(bounds, prefix, "right") - 1
        candidates: dict[tuple[int, int], set[int]] = defaultdict(set)
        for at, r in zip(prefix.tolist(), row.tolist()):
            last = (at - int(bounds[r])) // BLOCK_STEP
            for b in range(max(0, last - BLOCK_WORDS // BLOCK_STEP + 1), last + 1):
                candidates[r, b].update(self.by_prefix[int(ranks[at])])
        places: list[dict] = [{} for _ in range(len(texts))]
        matches: list[list[dict]] = [[] for _ in range(len(texts))]
        for (r, b), which in sorted(candidates.items()):
            low = int(bounds[r]) + b * BLOCK_STEP
            high = min(low + BLOCK_WORDS, int(bounds[r + 1]))
            inside = ranks[low:high]
            block = np.unique(inside[inside >= 0]).tolist()
            for t in sorted(which):
                if high - low < self.need[t] or not (have := shared(self.ordered[t], block, self.need[t])):
                    continue
                template = self.templates[t]
                if template.phrase:
                    words = self.sequence[t]
                    hit = np.ones(max(0, len(inside) - len(words) + 1), bool)
                    for k, word in enumerate(words):
                        hit &= inside[k : k + len(hit)] == word
                    for k in np.flatnonzero(hit).tolist():
                        places[r][b * BLOCK_STEP + k, template.label] = len(words)
                else:
                    matches[r].append({"label": template.label, "first": b * BLOCK_STEP, "last": b * BLOCK_STEP + high - low - 1, "containment": have / len(self.ordered[t])})
        listed = [[{"start": s, "label": label, "words": n} for (s, label), n in sorted(p.items())] for p in places]
        return np.diff(bounds), listed, matches


PLACES = "array<struct<start:bigint,label:string,words:bigint>>"
MATCHES = "array<struct<label:string,first:bigint,last:bigint,containment:double>>"
ARROW_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("words", pa.int64())]))
ARROW_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))


def license_scan(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``places`` of phrases and ``blocks`` that meet a template's threshold."""
    vocabulary = Vocabulary(templates)
    scanner = Scanner(templates, vocabulary, token_ranks(docs, text, vocabulary))

    def compute(texts: pa.Array, _: np.ndarray) -> list:
        n_words, places, matches = scanner.scan(texts)
        return [pa.array(n_words.astype(np.int64)), pa.array(places, ARROW_PLACES), pa.array(matches, ARROW_MATCHES)]

    kind = lambda ddl: T.StructType.fromDDL(f"x {ddl}")[0].dataType
    fields = [T.StructField("n_words", T.LongType()), T.StructField("places", kind(PLACES)), T.StructField("blocks", kind(MATCHES))]
    return append_columns(docs, text, compute, fields, keep_column=keep_text)
