"""Language identification by multinomial naive Bayes over hashed character n-grams.

Lower-cased texts give all n-grams of one to three code points, hashed to a fixed number
of buckets. Training counts them for each language over all given rows: every task sums
its rows in one array a language and emits a row for each used bucket, which are added
after a shuffle. The matrix of smoothed log probabilities has (languages x buckets)
entries, whatever the number of documents, and is broadcast. Texts are scored in blocks.

Beside the posterior, which is near 1 on any long text, ``fit`` tells whether the text is
in a learned language at all: its mean log probability of an n-gram less the language's
own mean, whatever the length; near 0 for the language, many nats below for others.

Defined results: the prediction is ``und`` with score 0 for a null text, for one without a
letter, and if there was nothing to learn from; ties go to the first language by name; the
score is the posterior of the predicted language, and a text without a prediction has fit null; training skips null texts and languages;
an empty table gives an empty result. Input columns named like a result are replaced.
Only the text is looked at when predicting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.textblocks import append_columns, blocks
from quern.session import map_arrow

BUCKETS = 1 << 15
ORDERS = 3
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Odd multipliers, one for each place of an n-gram and for the last mixing step.
PLACE = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def gram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram at every code point, and the n + 1 bounds of the texts."""
    closed = [t.lower() + "\n\n" for t in texts]
    points = np.frombuffer("".join(closed).encode("utf-32-le"), np.uint32)
    bounds = np.r_[0, np.cumsum([len(t) for t in closed])].astype(np.int64)
    state, found = np.zeros(len(points), np.uint32), []
    for n in range(ORDERS):
        further = np.zeros(len(points), np.uint32)
        further[: len(points) - n] = (points[n:] + np.uint32(n + 1)) * PLACE[n]
        for d in range(1, n + 1):
            further[bounds[1:] - d] = 0  # an n-gram ends with its text
        state = state + further
        h = (state ^ (state >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append((h >> np.uint32(17)).astype(np.intp))
    return found, bounds


@dataclass
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray
    log_prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior and fit of each text."""
        score, fit = np.zeros(len(texts)), np.full(len(texts), np.nan)
        label = [UNKNOWN] * len(texts)
        rows = [i for i, t in enumerate(texts) if LETTER.search(t)] if self.languages else []
        if not rows:
            return label, score, fit
        grams, bounds = gram_buckets([texts[i] for i in rows])
        total = np.tile(self.log_prior, (len(rows), 1))
        for k in range(len(self.languages)):
            for bucket in grams:
                total[:, k] += np.add.reduceat(self.log_probability[k][bucket], bounds[:-1])
        best = total.argmax(axis=1)
        own = (np.exp(self.log_probability) * self.log_probability).sum(axis=1)
        n_grams = ORDERS * np.diff(bounds)
        fit[rows] = (total - self.log_prior)[np.arange(len(rows)), best] / n_grams - own[best]
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, k, p in zip(rows, best.tolist(), posterior.tolist()):
            label[i], score[i] = self.languages[k], p
        return label, score, fit


def train(rows: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """A model of the labels in ``rows``; the driver gets one number for each label and bucket."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for block in blocks(batch, 1):
                labels, texts = block.column(0).to_pylist(), block.column(1).to_pylist()
                for name in set(labels):
                    own = [t for t, x in zip(texts, labels) if x == name]
                    counts = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    for bucket in gram_buckets(own)[0]:
                        counts[:-1] += np.bincount(bucket, minlength=BUCKETS)
                    counts[-1] += len(own)
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(counts[used])], names=["label", "bucket", "n"])

    known = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    counted = map_arrow(known, run, "label string, bucket bigint, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counted.column("label").to_pylist()))
    row = {name: i for i, name in enumerate(names)}
    counts = np.zeros((len(names), BUCKETS + 1))
    counts[[row[x] for x in counted.column("label").to_pylist()], counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    grams = counts[:, :-1] + smoothing
    documents = counts[:, -1] + 1
    return LanguageModel(names, np.log(grams / grams.sum(axis=1, keepdims=True)), np.log(documents / max(documents.sum(), 1)))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True, names: tuple[str, str, str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """``docs`` with the predicted language, its posterior and the text's fit, called ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array, _: np.ndarray) -> list:
        labels, score, fit = shared.value.predict(texts.to_pylist())
        return [pa.array(labels, pa.string()), pa.array(score), pa.array(fit, mask=np.isnan(fit))]

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    return append_columns(docs, text, compute, [T.StructField(n, k) for n, k in zip(names, kinds)], keep_column=keep_text)


def fold(key: str, folds: int = 4) -> Column:
    """The row's fold by the CRC-32 of its key as text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds
