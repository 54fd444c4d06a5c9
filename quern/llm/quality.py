"""Quality rules: base counts of a text and robust multivariate outliers.

Each text gives a vector of transformed statistics. For each language and source the
location and scatter of these vectors are estimated by minimum covariance determinant:
concentration steps keep the ``share`` of rows with the smallest Mahalanobis distance and
take their mean and covariance, which never raises the determinant. They run a fixed
number of times from two starts, medians with absolute deviations alone and these with
the correlations of squeezed values (tanh of standardised ones); of the two results the
one with the least determinant is taken, on a tie the first. A row is rejected if its squared distance from its own group's
estimate is beyond the chi-square ``quantile``. All steps are aggregations over a narrow table of statistics, with
partial sums before the shuffle, so a source with a third of all rows is no hot spot;
the distance that bounds the kept share is found in a histogram of bounded size. A small
least variance of each statistic keeps estimates regular where a statistic is constant.

Defined results: a null or empty text has no words and fails the base rule; null languages
and sources are groups of their own; a group of one row keeps it; repeated rows count each
time and get equal verdicts; an empty table gives an empty result. Input columns named
like a result are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.textblocks import SPACE, append_columns, byte_class, flat_bytes, gram_hashes, mixed, segment_sums, span_hashes, without, word_spans
from quern.session import map_arrow, stage_table

SYMBOLS = byte_class(*((ord(c), ord(c)) for c in "#*$%&|<>"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Least standard deviation of each statistic.
FLOORS = (0.5, 0.4, 0.08, 0.08, 0.12)
DIM = len(FLOORS)
#: What is added to each variance, as a share of it.
RIDGE = 1e-6


def text_counts(texts: pa.Array) -> list[np.ndarray]:
    """The ``COUNTS`` of each text."""
    data, offsets = flat_bytes(texts)
    n = len(texts)
    if not len(data):
        return [np.zeros(n, np.int64) for _ in COUNTS]
    in_word = ~SPACE[data]
    starts, ends = word_spans(data, ~SPACE)
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    word_chars = segment_sums(in_word & ((data & 0xC0) != 0x80), offsets)
    n_symbols = segment_sums(SYMBOLS[data], offsets)
    # lines equal to an earlier one of their text
    line_ends = np.flatnonzero(data == 0x0A)
    line_starts = np.r_[0, line_ends[:-1] + 1]
    line_bounds = np.searchsorted(line_starts, offsets)
    line_row = np.repeat(np.arange(n), np.diff(line_bounds))
    words_before = np.searchsorted(starts, np.r_[line_starts, len(data)])
    full = np.flatnonzero(np.diff(words_before) > 0)
    keys = mixed(span_hashes(data, line_starts[full], line_ends[full]) + line_row[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order[1:]] == keys[order[:-1]]]
    n_dup = np.bincount(line_row[full][again], minlength=n)
    # words inside windows of three that the text has twice or more
    tokens = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(n), n_words)
    grams = gram_hashes(tokens, 3)
    whole = np.flatnonzero(row[: len(grams)] == row[2:]) if len(grams) else np.zeros(0, np.int64)
    keys = mixed(grams[whole] + row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    repeated = whole[order[np.r_[same, False] | np.r_[False, same]]] if len(order) else whole
    change = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + 3, -1)
    n_repeat = segment_sums(np.cumsum(change[:-1]) > 0, bounds)
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, np.diff(line_bounds)]


def with_counts(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    def compute(texts: pa.Array, _: np.ndarray) -> list:
        return [pa.array(c.astype(np.int64)) for c in text_counts(texts)]

    return append_columns(df, text, compute, [T.StructField(c, T.LongType()) for c in COUNTS], keep_column=keep_text)


def statistics() -> list[Column]:
    """Transformed statistics: log length, mean word length and roots of three shares."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.col("word_chars") / words,
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 1e-9, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def distance() -> Column:
    """Squared Mahalanobis distance of __x0.. from the joined estimate (mu, inverse)."""
    away = [F.col(f"__x{i}") - F.get("__mu", F.lit(i)) for i in range(DIM)]
    squared = sum(
        (away[i] * away[j] * F.get("__inverse", F.lit(i * DIM + j)) * (1 if i == j else 2) for i in range(DIM) for j in range(i, DIM)),
        F.lit(0.0),
    )
    return F.when(squared < 0, 0.0).otherwise(squared)  # rounding, in groups of few rows


def estimates(moments: DataFrame, groups: list[str], scale: float, squeezed: bool = False) -> DataFrame:
    """(groups, mu, inverse, log determinant) from n, s0.. and s0_0.. of each group.

    ``squeezed``: the moments give correlations only; __mu and the deviations d0.. are given.
    """
    fields = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("__mu", "__inverse")] + [T.StructField("__logdet", T.DoubleType())]
    schema = T.StructType([moments.schema[g] for g in groups] + fields)
    pairs = [(i, j) for i in range(DIM) for j in range(i, DIM)]

    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            n = get("n")
            mu = np.stack([get(f"s{i}") / n for i in range(DIM)], axis=1)
            cov = np.zeros((len(n), DIM, DIM))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = get(f"s{i}_{j}") / n - mu[:, i] * mu[:, j]
            if squeezed:
                mu = np.array(batch.column("__mu").to_pylist(), float).reshape(-1, DIM)
                own, given = np.sqrt(np.maximum(np.einsum("nii->ni", cov), 0)), np.stack([get(f"d{i}") for i in range(DIM)], axis=1)
                ratio = given / np.where(own > 1e-9, own, 1)
                cov *= ratio[:, :, None] * ratio[:, None, :]
                np.einsum("nii->ni", cov)[:] = given**2
            cov *= scale
            own = np.einsum("nii->ni", cov)
            own[:] = np.maximum(own, np.square(FLOORS)) * (1 + RIDGE)  # still regular where statistics go together
            inverse = np.linalg.inv(cov)
            arrays = [pa.array(list(x.reshape(len(n), -1)), pa.list_(pa.float64())) for x in (mu, inverse)]
            arrays.append(pa.array(np.linalg.slogdet(cov)[1]))
            yield pa.RecordBatch.from_arrays([*[batch.column(g) for g in groups], *arrays], names=[*groups, "__mu", "__inverse", "__logdet"])

    return map_arrow(moments, run, schema)


def with_estimate(rows: DataFrame, estimate: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """Rows joined with their group's estimate; nulls are a group like any other."""
    theirs = estimate.select(*[F.col(g).alias(f"__{g}") for g in groups], "__mu", "__inverse")
    match = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    return rows.join(theirs, match, how).drop(*[f"__{g}" for g in groups])


def moments_of(xs: list[str]) -> list[Column]:
    products = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"s{i}_{j}") for i in range(DIM) for j in range(i, DIM)]
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)], *products]


def covariance_determinant(rows: DataFrame, groups: list[str], share: float = 0.75, steps: int = 4) -> DataFrame:
    """(groups, mu, inverse): minimum-covariance-determinant estimates of __x0.. for each group."""
    xs = [f"__x{i}" for i in range(DIM)]
    median = rows.groupBy(*groups).agg(F.array(*[F.percentile_approx(x, 0.5, 1000) for x in xs]).alias("__mu"), F.lit(None).cast("array<double>").alias("__inverse"))
    centred = with_estimate(rows, stage_table(median, "medians"), groups)
    spread = centred.groupBy(*groups).agg(
        F.first("__mu").alias("__mu"),
        *[F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(x) - F.get("__mu", F.lit(i))), 0.5, 1000), F.lit(FLOORS[i])).alias(f"d{i}") for i, x in enumerate(xs)],
    )
    spread = stage_table(spread, "spreads")
    start = [[F.lit(0.0)] * DIM for _ in range(DIM)]
    for i in range(DIM):
        start[i][i] = F.pow(f"d{i}", F.lit(-2.0))
    plain = spread.select(*groups, "__mu", F.array(*[v for line in start for v in line]).alias("__inverse"))
    given = spread.select(*[F.col(g).alias(f"__{g}") for g in groups], "__mu", *[f"d{i}" for i in range(DIM)])
    standard = rows.join(given, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]).drop(*[f"__{g}" for g in groups])
    standard = standard.withColumns({x: F.tanh((F.col(x) - F.get("__mu", F.lit(i))) / F.col(f"d{i}")) for i, x in enumerate(xs)})
    squeezed = standard.groupBy(*groups).agg(*moments_of(xs), F.first("__mu").alias("__mu"), *[F.first(f"d{i}").alias(f"d{i}") for i in range(DIM)])
    correlated = estimates(squeezed, groups, 1.0, squeezed=True).drop("__logdet")
    estimate = stage_table(plain.withColumn("__start", F.lit(0)).unionByName(correlated.withColumn("__start", F.lit(1))), "estimates")
    rows, owners = rows.withColumn("__start", F.explode(F.array(F.lit(0), F.lit(1)))), groups
    groups = [*groups, "__start"]
    # of a normal sample, the covariance of the nearest share is too small by this factor
    scale = share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)
    for _ in range(steps):
        placed = with_estimate(rows, estimate, groups).withColumn("bin", F.floor(F.log2(distance() + 2.0**-20) * 32).cast("int")).drop("__mu", "__inverse")
        counted = placed.groupBy(*groups, "bin").agg(F.count("*").alias("n"))
        per_group = counted.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))
        need = F.ceil(F.col("total") * share)
        walked = F.aggregate(
            "bins",
            F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("cut")),
            lambda acc, b: F.struct(
                (acc["seen"] + b["n"]).alias("seen"), F.when((acc["seen"] + b["n"] >= need) & acc["cut"].isNull(), b["bin"]).otherwise(acc["cut"]).alias("cut")
            ),
        )
        cuts = per_group.select(*[F.col(g).alias(f"__{g}") for g in groups], walked["cut"].alias("cut"))
        nearest = placed.join(cuts, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]).where("bin <= cut")
        estimate = stage_table(estimates(nearest.groupBy(*groups).agg(*moments_of(xs)), groups, scale), "estimates")
    least = F.min(F.struct(F.round("__logdet", 6).alias("logdet"), "__start", "__mu", "__inverse")).alias("least")
    return estimate.groupBy(*owners).agg(least).select(*owners, "least.__mu", "least.__inverse")


def quality_rules(
    docs: DataFrame, text: str = "text", groups: tuple[str, ...] = ("lang", "source"), keep_text: bool = True, share: float = 0.75, quantile: float = 0.999
) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``distance`` (squared, null where the base rule failed) and ``kept``."""
    added = ["base_failed", "distance", "kept", *COUNTS]
    counted = without(docs, [c for c in added if c not in (text, *groups)])
    counted = stage_table(with_counts(counted, text, keep_text), "counts")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = counted.withColumn("base_failed", failed).withColumns({f"__x{i}": s for i, s in enumerate(statistics())})
    sound = rows.where(~F.col("base_failed")).select(*groups, *[f"__x{i}" for i in range(DIM)])
    estimate = covariance_determinant(sound, list(groups), share)
    judged = with_estimate(rows, estimate, list(groups), "left")
    cutoff = chi2_quantile(quantile, DIM)
    far = F.when(~F.col("base_failed"), distance())
    return judged.withColumn("distance", far).withColumn("kept", F.coalesce(F.col("distance") <= cutoff, F.lit(False))).drop("__mu", "__inverse", *[f"__x{i}" for i in range(DIM)])
