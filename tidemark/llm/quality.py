"""Operator 10: quality rules - counts of each text, and robust multivariate outliers among them.

Workers count over whole texts. For each language and source, the minimum-covariance-determinant estimate of location and
scatter of four transformed statistics is found by concentration steps: distances from the present estimate, the nearest
share H of the rows, their mean and covariance, again. It starts at medians and median absolute deviations. A step is one
aggregation: the moments are summed by group and distance bin, and the bins up to the one that holds the H-quantile make
the new estimate, so no group is ever gathered. Documents beyond a chi-square quantile are rejected.

Groups with fewer than ``min_group`` documents are pooled by language, those that stay small over all languages; a pool
that is small even then rejects nothing.

Cases: null and empty texts have no words and fail the base rule; null language and source are groups of their own;
repeated rows count each time; an empty table gives no rows; other columns are kept by ``keep_good``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, aside, map_arrow, saved, table

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SHARE = 0.75
STEPS = 5
MIN_GROUP = 50
#: Quantile 1 - 1e-6 and median of chi-square with 4 degrees of freedom, fixed values.
CUTOFF, MEDIAN = 33.377, 3.3567
#: Variances never fall below these, so a statistic that is constant in a group doesn't reject its first exception.
FLOOR = (0.05**2, 0.25**2, 0.25**2, 0.25**2)
NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
WINDOW = 5
#: Up to so many groups their parameters (some 300 bytes each) are broadcast; beyond, keys are salted.
FEW_GROUPS = 10_000
SALTS = 64


def with_group(rows: DataFrame, small: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row that ``small`` has for each group. A group may hold a third of all rows, so rows are
    never dealt out by group alone."""
    if few:
        return rows.join(F.broadcast(small), keys, how)
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.spark_partition_id() % SALTS).join(copies, [*keys, "__salt"], how).drop("__salt")


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    n = len(words)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if n <= WINDOW or len(index) == n:
        return 0
    code = np.fromiter(map(index.__getitem__, words), np.int64, n)
    key, size = code[: n - WINDOW + 1], len(index)
    for k in range(1, WINDOW):
        if size > (1 << 62) // len(index):
            u, key = np.unique(key, return_inverse=True)
            size = len(u)
        key = key * len(index) + code[k : n - WINDOW + 1 + k]
        size *= len(index)
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    starts = order[np.r_[same, False] | np.r_[False, same]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), len(b"".join(words).decode("utf-8", "replace")), len(text.translate(None, NOT_SYMBOLS)), len(lines) - len(set(lines)), repeated(words), len(lines))


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` and the counts of each text."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([counts_of(t) for t in as_bytes(batch.column(text))], np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c) for c in rows.T)], [*keep, *COUNTS])

    schema = ", ".join([*(f"`{k}` {fields[k]}" for k in keep), *(f"{c} bigint" for c in COUNTS)])
    return map_arrow(df.select(*dict.fromkeys([*keep, text])), run, schema)


def vector() -> list[Column]:
    """Transformed statistics, each drawn towards its usual value where a text is short."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return [
        F.log((chars + 500.0) / (words + 100.0)),
        F.log1p(100.0 * F.col("n_symbols") / (chars + 500.0)),
        F.log1p(10.0 * F.col("n_dup_lines") / (lines + 20.0)),
        F.log1p(10.0 * F.col("n_repeat_words") / (words + 100.0)),
    ]


P = len(FLOOR)
X = [f"__x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def with_kind(df: DataFrame, others: str) -> str:
    """A schema of ``__g``, as ``df`` has it, and ``others``."""
    return f"__g {df.schema['__g'].dataType.simpleString()}, {others}"


def grouped(stats: DataFrame, min_group: int) -> tuple[DataFrame, bool]:
    """``stats`` with the group ``__g`` whose estimate judges the row, and whether groups are few enough to broadcast. Groups are
    64-bit hashes: a broadcast table of one long key is as large as its rows, one of any other key holds a whole memory page
    (16 MB and more) in every executor until the driver collects garbage, and a query broadcasts a dozen."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source"))
    keyed = stats.withColumn("__l", F.xxhash64(lang)).withColumn("__s", F.xxhash64(lang, source))
    sizes = keyed.groupBy("__l", "__s").agg(F.count("*").alias("__n"), F.count_if(~F.col("base_failed")).alias("__ok"))
    sizes = saved(sizes, "quality-sizes")
    few = sizes.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    small = sizes.filter(F.col("__ok") < min_group)
    pool = small.groupBy("__l").agg(F.sum("__ok").alias("__pool"))
    named = sizes.join(pool, "__l", "left").withColumn(
        "__g", F.when(F.col("__ok") >= min_group, F.col("__s")).when(F.col("__pool") >= min_group, F.col("__l")).otherwise(F.lit(0).cast("long"))
    )
    return with_group(keyed, named.select("__s", "__g"), ["__s"], few).drop("__l", "__s"), few


def estimate(total: np.ndarray) -> tuple[list[float], list[float]]:
    """Mean and inverse covariance from count, sums and sums of products, rounded so that summation order doesn't show."""
    n, mean = total[0], total[1 : 1 + P] / total[0]
    cov = np.zeros((P, P))
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = total[1 + P + k] / n - mean[i] * mean[j]
    return np.round(mean, 6).tolist(), np.round(np.linalg.inv(np.round(cov, 8) + np.diag(FLOOR)), 6).ravel().tolist()


def first_estimate(good: DataFrame, few: bool = False) -> DataFrame:
    """Medians and median absolute deviations by group, from counts in bins of 1/256."""
    fine = 256.0

    def median(counts: DataFrame) -> DataFrame:
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("bin")
            at = np.searchsorted(rows["n"].cumsum().to_numpy(), rows["n"].sum() / 2)
            return pd.DataFrame({"__g": [key[0]], "k": [key[1]], "m": [(rows["bin"].iloc[at] + 0.5) / fine]})

        return counts.groupBy("__g", "k").applyInPandas(run, with_kind(counts, "k int, m double"))

    long = good.select("__g", F.posexplode(F.array(*X)).alias("k", "x"))
    middle = median(long.groupBy("__g", "k", F.floor(F.col("x") * fine).alias("bin")).agg(F.count("*").alias("n")))
    # deviations of the bins' centres, so that the rows are read once
    wide = middle.groupBy("__g").pivot("k", list(range(P))).agg(F.first("m"))
    wide = wide.select("__g", F.array(*(F.col(str(k)) for k in range(P))).alias("mu"))
    off = with_group(good, wide, ["__g"], few).select("__g", F.posexplode(F.array(*(F.abs(F.col(x) - F.col("mu")[i]) for i, x in enumerate(X)))).alias("k", "x"), "mu")
    spread = median(off.groupBy("__g", "k", F.floor(F.col("x") * fine).alias("bin")).agg(F.count("*").alias("n")))
    spread = spread.groupBy("__g").pivot("k", list(range(P))).agg(F.first("m"))
    scale = [F.lit(1.0) / (F.pow(1.4826 * F.col(str(k)), 2) + FLOOR[k]) for k in range(P)]
    inv = F.array(*(scale[i] if i == j else F.lit(0.0) for i in range(P) for j in range(P)))
    return wide.join(spread.select("__g", inv.alias("inv")), "__g")


def distance() -> Column:
    off = [F.col(x) - F.col("mu")[i] for i, x in enumerate(X)]
    return sum((off[i] * off[j] * F.col("inv")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0))


def binned(good: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """Counts and moments by group and distance bin (eight to an octave)."""
    d = F.greatest(F.col("__d"), F.lit(1e-6))
    return (
        with_group(good, params, ["__g"], few).withColumn("__d", distance()).groupBy("__g", F.floor(8 * F.log2(d)).cast("int").alias("bin"))
        .agg(F.count("*").cast("double").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS))
    )


MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]


def concentrate(good: DataFrame, params: DataFrame, share: float, few: bool = False) -> DataFrame:
    """One concentration step: the estimate from the nearest rows."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        upto = np.searchsorted(rows["n"].cumsum().to_numpy(), share * rows["n"].sum()) + 1
        mu, inv = estimate(rows[MOMENTS].to_numpy()[:upto].sum(axis=0))
        return pd.DataFrame({"__g": [key[0]], "mu": [mu], "inv": [inv]})

    return binned(good, params, few).groupBy("__g").applyInPandas(run, with_kind(params, "mu array<double>, inv array<double>"))


def scaled(good: DataFrame, params: DataFrame, min_group: int, few: bool) -> DataFrame:
    """``params`` with ``cut``: the distance beyond which a row is an outlier, from the median distance; none for small groups."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        n = rows["n"].sum()
        at = np.searchsorted(rows["n"].cumsum().to_numpy(), n / 2)
        factor = max(1.0, 2 ** ((rows["bin"].iloc[at] + 1) / 8) / MEDIAN)
        return pd.DataFrame({"__g": [key[0]], "cut": [CUTOFF * factor if n >= min_group else math.inf]})

    return params.join(binned(good, params, few).groupBy("__g").applyInPandas(run, with_kind(params, "cut double")), "__g")


def judged(stats: DataFrame, share: float = SHARE, steps: int = STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """``stats`` with base_failed and kept. stats: saved output of ``statistics``."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows, few = grouped(stats.withColumn("base_failed", failed), min_group)
    rows = saved(rows, "quality-groups")
    rows = rows.withColumns(dict(zip(X, vector(), strict=True)))
    good = rows.filter(~F.col("base_failed")).select("__g", *X)
    params = saved(first_estimate(good, few), "quality-start")
    for _ in range(steps):
        params = concentrate(good, params, share, few)
    params = saved(scaled(good, params, min_group, few), "quality-model")
    verdict = F.col("base_failed") | F.coalesce(distance() > F.col("cut"), F.lit(False))
    return with_group(rows, params, ["__g"], few, "left").withColumn("kept", ~verdict).drop("__g", "mu", "inv", "cut", *X)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text passes, all columns kept. Rows are told apart by a hash of id and text."""

    def use(plain: DataFrame) -> DataFrame:
        keyed = plain.withColumn("key", F.xxhash64("doc_id", "text", "lang", "source"))
        verdict = judged(saved(statistics(keyed, keep=("key", "lang", "source")), "quality-stats")).filter("kept").select("key").distinct()
        return keyed.join(verdict, "key", "left_semi").select(*plain.columns)

    return aside(docs, ("doc_id", "text", "lang", "source"), use)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(statistics(table(spark, sf_dir, "documents")), "quality-stats")
    return judged(stats).select("doc_id", *COUNTS[:5], "base_failed", "kept")
