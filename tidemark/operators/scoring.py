"""Proper scores, calibration of distributions, block bootstrap and paired comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import prob


def checked(p: Column, what: str) -> Column:
    """A probability of an observed outcome; zero is an error and never floored."""
    return F.when(p > 0, p).otherwise(F.raise_error(F.concat(F.lit(f"no probability on an observed {what}: "), F.coalesce(p.cast("string"), F.lit("null")))).cast("double"))


def log_loss(pmf: Column, value: Column) -> Column:
    return -F.ln(checked(F.get(pmf, F.least(value, F.size(pmf) - 1)), "value"))


def ranked_score(pmf: Column, value: Column, categories: int = 8) -> Column:
    """Ranked probability score over ``categories``, the rest collapsed into the last."""
    folded = prob.fold(pmf, categories)
    target = F.least(value, F.lit(categories - 1))
    steps = F.transform(F.slice(prob.cdf(folded), 1, categories - 1), lambda c, i: F.pow(c - F.when(i >= target, 1.0).otherwise(0.0), 2))
    return prob.total(steps) / (categories - 1)


def brier(p: Column, event: Column) -> Column:
    return F.pow(p - event.cast("double"), 2)


def binary_log_loss(p: Column, event: Column) -> Column:
    return -F.ln(checked(F.when(event, p).otherwise(1 - p), "event"))


def pit(pmf: Column, value: Column, u: Column) -> Column:
    """Randomised probability integral transform."""
    top = F.least(value, F.size(pmf) - 1)
    below = prob.total(F.slice(pmf, 1, top))
    return below + u * F.get(pmf, top)


def bad_pmf(pmf: Column, tolerance: float = 1e-6) -> Column:
    """Reason why an array is no distribution, or null."""
    return (
        F.when(F.exists(pmf, lambda p: p.isNull() | F.isnan(p)), "not a number").when(F.exists(pmf, lambda p: p < 0), "negative").when(F.abs(prob.total(pmf) - 1) > tolerance, "sum")
    )


def draw(replicate: Column, i: Column, n: Column) -> Column:
    """A pseudo-random integer in [0, n): two rounds of a linear congruential generator, the same in any engine."""
    first = (replicate * 1103515245 + i * 12345 + 67) % 2147483648
    return (((first * 1103515245 + 12345) % 2147483648) / 65536).cast("long") % n


def block_sums(losses: DataFrame, stratum: str, block: str, value: str) -> DataFrame:
    return losses.groupBy(stratum, block).agg(F.sum(value).alias("s"), F.count("*").alias("n"))


def resampled(sums: DataFrame, stratum: str, block: str, columns: Sequence[str], replicates: int) -> DataFrame:
    """replicate and the sums of ``columns`` over resamples that draw in each stratum as many blocks as it has. ``sums`` has one
    row for each block, so what is multiplied by the replicates doesn't grow with the rows of a block."""
    numbered = sums.withColumn("b", (F.row_number().over(W.partitionBy(stratum).orderBy(block)) - 1).cast("long")).withColumn("nb", F.count("*").over(W.partitionBy(stratum)))
    slots = numbered.select(stratum, F.col("b").alias("i"), "nb").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("r", F.col("r").cast("long"))
    picks = slots.withColumn("b", draw(F.col("r"), F.col("i"), F.col("nb"))).select(stratum, "r", "b")
    return picks.join(numbered.select(stratum, "b", *columns), [stratum, "b"]).groupBy(F.col("r").alias("replicate")).agg(*(F.sum(c).alias(c) for c in columns))


def bootstrap_means(losses: DataFrame, stratum: str, block: str, value: str, replicates: int) -> DataFrame:
    """replicate, mean of the losses of resampled blocks."""
    return resampled(block_sums(losses, stratum, block, value), stratum, block, ["s", "n"], replicates).select("replicate", (F.col("s") / F.col("n")).alias("mean"))


def interval_of(draws: DataFrame, value: str, level: float) -> DataFrame:
    """One row: low and high, the percentiles of ``value`` that hold ``level`` of the draws."""
    a = (1 - level) / 2
    return draws.agg(F.expr(f"percentile({value}, {a})").alias("low"), F.expr(f"percentile({value}, {1 - a})").alias("high"))


def bootstrap_interval(losses: DataFrame, stratum: str, block: str, value: str, replicates: int = 10_000, level: float = 0.95) -> DataFrame:
    bounds = interval_of(bootstrap_means(losses, stratum, block, value, replicates), "mean", level)
    return losses.agg(F.avg(value).alias("mean"), F.count("*").alias("n")).crossJoin(bounds)  # one row by one row


MOMENTS = ["n", "sx", "sy", "sxy", "sxx"]


def slope() -> Column:
    """Of the least-squares line of sums n, sx, sy, sxy, sxx; null where x doesn't vary."""
    spread = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    return F.when(spread > 1e-12, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / spread)


def slope_interval(rows: DataFrame, stratum: str, block: str, x: str, y: str, replicates: int = 10_000, level: float = 0.95, least: int = 5) -> DataFrame:
    """One row: slope of y on x, its bootstrap interval over blocks drawn within strata, rows and blocks. Blocks come down to
    five sums each; a replicate's slope is solved from their totals. All but the counts are null where x doesn't vary or blocks
    are fewer than ``least``."""
    known = rows.select(stratum, block, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    sums = known.groupBy(stratum, block).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    whole = sums.agg(F.count("*").alias("blocks"), *(F.sum(c).alias(c) for c in MOMENTS)).select("n", "blocks", slope().alias("slope"))
    bounds = interval_of(resampled(sums, stratum, block, MOMENTS, replicates).select(slope().alias("slope")), "slope", level)
    enough = F.col("slope").isNotNull() & (F.col("blocks") >= least)
    return whole.crossJoin(bounds).select(F.coalesce("n", F.lit(0)).alias("n"), "blocks", *(F.when(enough, F.col(c)).alias(c) for c in ("slope", "low", "high")))  # one row by one row


def diebold_mariano(losses: DataFrame, block: str, value: str) -> DataFrame:
    """Mean difference over its block-clustered standard error, with the two-sided normal p value."""
    blocks = losses.groupBy(block).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    t = blocks.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("n")).alias("sn"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    mean = F.col("s") / F.col("n")
    var = (F.col("ss") - 2 * mean * F.col("sn") + mean * mean * F.col("nn")) / (F.col("n") * F.col("n"))
    stat = mean / F.nullif(F.sqrt(var), F.lit(0.0))
    return t.select("n", mean.alias("mean"), F.sqrt(var).alias("se"), stat.alias("dm"), (2 * (1 - prob.normal_cdf(F.abs(stat)))).alias("p_value"))


def holm(tests: DataFrame, p: str, order: Sequence[str] = ()) -> DataFrame:
    """Adjusted p values: running maximum of (n - rank + 1) p. Tests are a few rows by nature."""
    w = W.orderBy(p, *order)
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    raw = tests.withColumn("__a", F.least(F.lit(1.0), (F.count("*").over(everyone) - F.row_number().over(w) + 1) * F.col(p)))
    return raw.withColumn("p_holm", F.max("__a").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__a")


def compare(losses: DataFrame, fold: str, a: str, b: str) -> DataFrame:
    """Gain of b over a by fold, and pooled in the row whose fold is null."""
    gain = F.col(a) - F.col(b)
    return losses.rollup(fold).agg(F.count("*").alias("n"), F.avg(gain).alias("gain"), F.avg((gain > 1e-9).cast("double")).alias("share_better"))


def decision(folds: int, positive: int, low: float, mean: float, gap_increase: float, slope: float) -> str:
    """Whether B replaces A: the interval excludes zero with a positive mean, three folds gain, and calibration holds."""
    if folds < 3:
        return "not applicable"
    return "replace" if low > 0 and mean > 0 and positive >= 3 and gap_increase <= 0.005 and 0.9 <= slope <= 1.1 else "keep"


def decided(folds: Column, positive: Column, low: Column, mean: Column, gap_increase: Column, slope: Column) -> Column:
    """``decision`` for each row; an unknown figure counts against B."""
    good = (low > 0) & (mean > 0) & (positive >= 3) & (gap_increase <= 0.005) & slope.between(0.9, 1.1)
    return F.when(folds < 3, "not applicable").when(F.coalesce(good, F.lit(False)), "replace").otherwise("keep")


def replacement(losses: DataFrame, fold: str, a: str, b: str, gap_increase: float = 0.0, slope: float = 1.0) -> DataFrame:
    """One row: folds, folds that gain, mean gain of b over a, the lower end of its 95 % interval by folds as blocks, and the
    decision. Folds are counted and averaged first, so one row a fold is all that is compared."""
    by_fold = losses.select(fold, (F.col(a) - F.col(b)).alias("__g")).dropna().groupBy(fold).agg(F.avg("__g").alias("gain"), F.sum("__g").alias("s"), F.count("*").alias("n"))
    total = by_fold.agg(F.count("*").alias("folds"), F.count_if(F.col("gain") > 0).alias("positive"), *(F.sum(x).alias(k) for k, x in {"s": F.col("s"), "n": F.col("n"), "ss": F.col("s") ** 2, "sn": F.col("s") * F.col("n"), "nn": F.col("n") * F.col("n")}.items()))
    mean = F.col("s") / F.col("n")
    low = mean - 1.959963984540054 * F.sqrt(F.greatest(F.lit(0.0), F.col("ss") - 2 * mean * F.col("sn") + mean * mean * F.col("nn"))) / F.col("n")
    return total.select("folds", "positive", mean.alias("mean"), low.alias("low")).withColumn("decision", decided(F.col("folds"), F.col("positive"), F.col("low"), F.col("mean"), F.lit(gap_increase), F.lit(slope)))
