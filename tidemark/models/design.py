"""Design matrices: what fitting learns is a few numbers a column, what transforming does is column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of a categorical column that a design may have; more is refused, as each becomes a column.
MOST_LEVELS = 1000


@dataclass
class Design:
    """Numeric columns standardised (population deviation), categorical ones one-hot without their first level, products of
    both; columns that are constant where the design was fitted are left out. Unknown and null levels are the first one's,
    null numbers the mean's."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    interactions: Sequence[tuple[str, str]] = ()
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    def fit(self, rows: DataFrame) -> Design:
        moments = [e for c in self.numeric for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
        got = rows.agg(F.count("*").alias("n"), *moments, *(F.approx_count_distinct(c).alias(f"k_{c}") for c in self.categorical)).first()
        self.scale = {c: (float(got[f"m_{c}"]), float(got[f"s_{c}"])) for c in self.numeric if (got[f"s_{c}"] or 0.0) > 1e-12}
        for c in self.categorical:
            if got[f"k_{c}"] > MOST_LEVELS:
                raise ValueError(f"{c} has about {got[f'k_{c}']} levels, more than {MOST_LEVELS}")
            self.levels[c] = sorted(str(r[0]) for r in rows.filter(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().collect())
        return self

    def columns(self) -> dict[str, Column]:
        out = {c: F.coalesce((F.col(c).cast("double") - m) / s, F.lit(0.0)) for c, (m, s) in self.scale.items()}
        dummies = {c: {f"{c}_{v}": F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("double") for v in self.levels[c][1:]} for c in self.categorical}
        products = {f"{n}_x_{d}": out[n] * x for n, c in self.interactions if n in out for d, x in dummies[c].items()}
        return out | {d: x for c in self.categorical for d, x in dummies[c].items()} | products

    def transform(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        return rows.select(*keep, *(x.alias(name) for name, x in self.columns().items()))
