"""The dependence of two low counts at given rates: the bounded maximum of a sum of logarithms, searched by Spark aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

POINTS = 9


def tau(h: str, a: str, home_rate: str, away_rate: str, rho: str) -> str:
    """The factor by which rho changes the probability of a score, as SQL."""
    return f"CASE WHEN {h} = 0 AND {a} = 0 THEN 1 - {home_rate} * {away_rate} * {rho} WHEN {h} = 0 AND {a} = 1 THEN 1 + {home_rate} * {rho} WHEN {h} = 1 AND {a} = 0 THEN 1 + {away_rate} * {rho} WHEN {h} = 1 AND {a} = 1 THEN 1 - {rho} ELSE 1D END"


def bounds(rows: DataFrame, home_rate: str, away_rate: str) -> tuple[float, float]:
    """Between which every factor is positive."""
    lh, la = F.col(home_rate), F.col(away_rate)
    got = rows.agg(F.max(F.greatest(lh, la)).alias("most"), F.max(lh * la).alias("both")).first()
    if got["most"] is None:
        return -1.0, 1.0
    return -1.0 / max(got["most"], 1e-12), min(1.0 / max(got["both"], 1e-12), 1.0)


def rho(rows: DataFrame, home_goals: str = "home_goals", away_goals: str = "away_goals", home_rate: str = "home_rate", away_rate: str = "away_rate", tolerance: float = 1e-7, digits: int | None = None) -> float | None:
    """The rho of greatest likelihood; None without a contest. The sum over contests is concave, so of equally spaced points
    in a bracket, all summed in one aggregation, the best one's neighbours hold the maximum: the bracket shrinks to a quarter
    each time. Equal scores at equal rates are counted once beforehand; ``digits`` rounds the rates, for fewer of them."""
    cols = {"h": F.col(home_goals), "a": F.col(away_goals), "lh": F.col(home_rate).cast("double"), "la": F.col(away_rate).cast("double")}
    if digits is not None:
        cols |= {k: F.round(cols[k], digits) for k in ("lh", "la")}
    plain = rows.select(*(c.alias(k) for k, c in cols.items())).dropna()
    low, high = bounds(plain, "lh", "la")
    cells = written(plain.filter("h <= 1 AND a <= 1").groupBy("h", "a", "lh", "la").agg(F.count("*").alias("n")), "rho-cells")
    if cells.isEmpty():
        return None
    margin = 1e-6 * (high - low)
    low, high = low + margin, high - margin
    while high - low > tolerance:
        points = np.linspace(low, high, POINTS)
        got = cells.selectExpr(*(f"sum(n * ln({tau('h', 'a', 'lh', 'la', f'({float(x)!r}D)')})) AS f{k}" for k, x in enumerate(points))).first()
        at = int(np.argmax([v if v is not None else -np.inf for v in got]))
        low, high = float(points[max(0, at - 1)]), float(points[min(POINTS - 1, at + 1)])
    return (low + high) / 2
