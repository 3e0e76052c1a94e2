"""Between one row for each contest and one for each of its two sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unpivot_sides(contests: DataFrame, shared: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Two rows for each contest from one scan: ``shared`` columns, ``is_home``, and for each name in ``pairs`` the own
    side's column. ``pairs`` names (home column, away column); mirrored pairs such as for/against are two entries."""

    def side(home: bool) -> Column:
        return F.struct(*shared, F.lit(home).alias("is_home"), *(F.col(h if home else a).alias(n) for n, (h, a) in pairs.items()))

    return contests.select(F.inline(F.array(side(True), side(False))))


def pivot_sides(rows: DataFrame, contest: str, values: Sequence[str], shared: Sequence[str] = ()) -> DataFrame:
    """One row for each contest that has both sides: ``home_*`` and ``away_*`` of ``values``."""
    picked = [F.max(F.when(F.col("is_home") == flag, F.col(v))).alias(f"{side}_{v}") for side, flag in (("home", True), ("away", False)) for v in values]
    both = F.count_if("is_home").alias("__h"), F.count_if(~F.col("is_home")).alias("__a")
    return rows.groupBy(contest, *shared).agg(*picked, *both).filter("__h = 1 AND __a = 1").drop("__h", "__a")


def with_opponent(rows: DataFrame, contest: str, values: Sequence[str]) -> DataFrame:
    """``opp_*``: the other side's values in the same contest. The two rows of a contest meet in one aggregation."""
    other = rows.select(contest, (~F.col("is_home")).alias("is_home"), *(F.col(v).alias(f"opp_{v}") for v in values))
    return rows.join(other, [contest, "is_home"], "left")


def complete_contests(rows: DataFrame, contest: str) -> DataFrame:
    """Rows of contests that have both sides."""
    both = rows.groupBy(contest).agg(F.count("*").alias("__n")).filter("__n = 2").select(contest)
    return rows.join(both, contest, "left_semi")


def usable(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Complete cases; count what goes with ``excluded_count``."""
    return rows.na.drop(subset=list(features))


def excluded_count(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How many rows ``usable`` drops, and how many there were."""
    missing = F.lit(False)
    for f in features:
        missing = missing | F.col(f).isNull()
    return rows.groupBy(*by).agg(F.count_if(missing).alias("excluded"), F.count("*").alias("total"))
