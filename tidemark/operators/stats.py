"""Aggregations: weighted and conditional means, variance components, calibration, agreement of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import written


def safe_ratio(top: Column, under: Column) -> Column:
    return top / F.nullif(under, F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null-safe weighted mean; null where the known weights sum to zero."""
    known = value.isNotNull() & weight.isNotNull()
    return safe_ratio(F.sum(F.when(known, value * weight)), F.sum(F.when(known, weight)).cast("double"))


def variance_components(rows: DataFrame, entity: str, value: str, weight: str) -> DataFrame:
    """Within- and between-entity variances (unbalanced one-way layout, weights as multiplicities of information) and the
    shrinkage constant k = within / between. One aggregation by entity, one of the entities."""
    w, x = F.col(weight).cast("double"), F.col(value).cast("double")
    each = rows.filter(F.col(value).isNotNull() & (w > 0)).groupBy(entity).agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    total = each.agg(
        F.sum("n").alias("rows"), F.count("*").alias("entities"), F.sum(F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")).alias("ss_within"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"), F.sum("wx").alias("wx"),
        F.sum(F.col("wx") * F.col("wx") / F.col("w")).alias("between_raw"),
    )
    within = safe_ratio(F.col("ss_within"), (F.col("rows") - F.col("entities")).cast("double"))
    between = (F.col("between_raw") - F.col("wx") * F.col("wx") / F.col("w") - (F.col("entities") - 1) * F.col("sigma2")) / F.nullif(F.col("w") - F.col("w2") / F.col("w"), F.lit(0.0))
    out = total.withColumn("sigma2", within).withColumn("tau2", F.greatest(between, F.lit(0.0)))
    return out.select("rows", "entities", "sigma2", "tau2", safe_ratio(F.col("sigma2"), F.col("tau2")).alias("k"))


def ordered_bins(rows: DataFrame, order: Sequence[str], bins: int, partition: Sequence[str] = (), name: str = "bin") -> DataFrame:
    """Equal-count bins floor(i * bins / n) of the ordered rows, i from 0.

    Without a partition the ranks come from range partitions and their counts, not from one task's sort.
    """
    if partition:
        w = W.partitionBy(*partition)
        return rows.withColumn(name, F.floor((F.row_number().over(w.orderBy(*order)) - 1) * bins / F.count("*").over(w)).cast("int"))
    # written, as both uses must see one division: planned anew, it may be sampled and coalesced otherwise
    placed = written(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ordered")
    ranked = placed.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__o"), F.sum("__n").over(everyone).alias("__t"))
    return ranked.join(F.broadcast(offsets), "__p").withColumn(name, F.floor((F.col("__o") + F.col("__r") - 1) * bins / F.col("__t")).cast("int")).drop("__p", "__r", "__o", "__t")


def calibration(rows: DataFrame, predicted: str, observed: str, tie: str, bins: int = 10) -> DataFrame:
    """Mean prediction, observed share and their gap in equal-count bins."""
    binned = ordered_bins(rows, [predicted, tie], bins)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_p"), F.avg(F.col(observed).cast("double")).alias("observed")).withColumn("gap", F.col("observed") - F.col("mean_p"))


def equal_width_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Right-closed bins of one width, the lowest value included; null outside."""
    at = F.ceil((value - low) * bins / (high - low)) - 1
    return F.when((value >= low) & (value <= high), F.greatest(at, F.lit(0))).cast("int")


def agreement(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, mean absolute error, bias and share of equal values of two sources, by group and in all (group null)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = rows.filter(x.isNotNull() & y.isNotNull())
    measures = [F.count("*").alias("n"), F.corr(x, y).alias("corr"), F.avg(F.abs(x - y)).alias("mae"), F.avg(x - y).alias("bias"), F.avg((x == y).cast("double")).alias("same")]
    return both.rollup(*by).agg(*measures) if by else both.agg(*measures)


def null_shares(rows: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of nulls of each column by group, long."""
    wide = rows.groupBy(*by).agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    return wide.unpivot(list(by), list(columns), "column", "null_share")


def dispersion(rows: DataFrame, mean: str, count: str) -> DataFrame:
    """Pearson's phi and the Cameron-Trivedi slope with its t value, of counts against fitted means."""
    m, y = F.col(mean).cast("double"), F.col(count).cast("double")
    z = ((y - m) * (y - m) - y) / m
    s = rows.agg(F.count("*").alias("n"), F.avg((y - m) * (y - m) / m).alias("phi"), F.sum(z * m).alias("zm"), F.sum(m * m).alias("mm"), F.sum(z * z).alias("zz"))
    slope = F.col("zm") / F.col("mm")
    return s.select("n", "phi", slope.alias("alpha"), (slope / F.sqrt((F.col("zz") - slope * F.col("zm")) / (F.col("n") - 1) / F.col("mm"))).alias("t"))


def demean(rows: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    return rows.withColumn(name, F.col(value) - F.avg(value).over(W.partitionBy(*keys)))
