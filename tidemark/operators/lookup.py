"""Joins beyond equality: nearest within a tolerance, unambiguous keys, periods, versions, keyed merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.session import written


def latest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest version of each key, as one aggregation (no window, so a hot key combines before the shuffle)."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("__r"))
    return newest.select(*keys, "__r.*").select(*rows.columns)


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """drop_duplicates that keeps the first row in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    oldest = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return oldest.select(*keys, "__r.*").select(*rows.columns)


def nearest_day(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, left_id: str, right_id: str, tolerance: int = 1) -> DataFrame:
    """left_id, right_id, gap: the right row of the same keys nearest in days within ``tolerance``, ties to the smaller id.
    The band becomes an equality: right rows are repeated for each day that they may serve."""
    spread = right.select(*keys, F.col(right_id), F.col(day).alias("__d"), F.explode(F.sequence(F.col(day) - tolerance, F.col(day) + tolerance)).alias(day))
    pairs = left.select(*keys, day, left_id).join(spread, [*keys, day])
    gap = F.abs(F.col(day) - F.col("__d"))
    best = pairs.groupBy(left_id).agg(F.min(F.struct(gap.alias("gap"), F.col(right_id))).alias("__b"))
    return best.select(left_id, f"__b.{right_id}", "__b.gap")


def unambiguous(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once."""
    rest = [c for c in rows.columns if c not in keys]
    alone = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__r")).filter("__n = 1")
    return alone.select(*keys, "__r.*").select(*rows.columns)


def in_periods(rows: DataFrame, periods: DataFrame, key: str, day: str, name: str) -> DataFrame:
    """Whether a period of the row's key covers its day surely and none covers it doubtfully. periods: key, start, end
    (days), sure. Each period is repeated for its days, so the join is an equality."""
    days = periods.select(key, F.explode(F.sequence("start", "end")).alias(day), "sure").groupBy(key, day).agg((F.max("sure") & F.min("sure")).alias(name))
    return rows.join(days, [key, day], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keyed merge: a new row replaces the old one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, keys, ["__new"]).drop("__new")


def only_new(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Idempotent append: rows whose keys aren't stored."""
    return rows.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def intersection(rows: DataFrame, item: str, source: str, sources: int) -> DataFrame:
    """Items that every one of ``sources`` has."""
    return rows.groupBy(item).agg(F.countDistinct(source).alias("__n")).filter(F.col("__n") == sources).select(item)


def overlay(current: DataFrame, late: DataFrame, keys: Sequence[str], frozen: Column, values: Sequence[str]) -> DataFrame:
    """Late corrections of ``values``: never of ``frozen`` rows, never by an ambiguous key."""
    good = unambiguous(late.select(*keys, *values), keys).select(*keys, *(F.col(v).alias(f"__{v}") for v in values))
    out = current.join(good, list(keys), "left").withColumn("changed", ~frozen & F.coalesce(*(F.col(f"__{v}") for v in values)).isNotNull())
    for v in values:
        out = out.withColumn(v, F.when(F.col("changed"), F.coalesce(f"__{v}", v)).otherwise(F.col(v)))
    return out.drop(*(f"__{v}" for v in values))


def surrogate_ids(rows: DataFrame, natural: str, name: str = "id") -> DataFrame:
    """Dense ids in the order of natural ids, for dimensions. Counts per range partition give each partition its offset, so
    no task sorts everything."""
    distinct = written(rows.select(natural).distinct().repartitionByRange(natural).withColumn("__p", F.spark_partition_id()), "ordered")  # one division for both uses
    local = distinct.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy(natural)))
    sizes = local.groupBy("__p").agg(F.count("*").alias("__n"))
    offsets = sizes.select(F.col("__p"), (F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__o"))
    return local.join(F.broadcast(offsets), "__p").select(natural, (F.col("__o") + F.col("__r")).cast("long").alias(name))


#: A list of up to so many values is written into the filter, which the scan gets; a longer one is joined.
LISTED = 1000


def among(rows: DataFrame, column: str, values: Sequence, listed: int = LISTED) -> DataFrame:
    """Rows whose ``column`` is one of ``values``; no values, no rows; nulls match nothing."""
    values = list(dict.fromkeys(v for v in values if v is not None))
    if len(values) <= listed:
        return rows.filter(F.col(column).isin(values))
    kind = rows.select(column).schema[0].dataType
    held = rows.sparkSession.createDataFrame([(v,) for v in values], StructType([StructField(column, kind)]))
    return rows.join(held, column, "left_semi").select(*(F.col(f"`{c}`") for c in rows.columns))


def looked_up(wanted: DataFrame, rows: DataFrame, key: str, position: str, strict: bool = True) -> DataFrame:
    """A row for each wanted key, in the order of ``position``, keys repeated as wanted. A key that ``rows`` lacks is an error, or
    has nulls unless ``strict``. Keys of ``rows`` are unique."""
    found = wanted.join(rows.withColumn("__there", F.lit(True)), key, "left")
    if strict:
        missing = F.raise_error(F.concat(F.lit(f"no {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
        found = found.filter(F.coalesce("__there", missing))
    return found.drop("__there").orderBy(position)
