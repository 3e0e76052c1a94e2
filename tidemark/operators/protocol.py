"""Walk-forward evaluation: expanding folds, inner validation, intersection of predictions, pooled losses."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import written

TARGETS = ("goals_for", "goals_against", "y")


@dataclass(frozen=True)
class Fold:
    first: int
    valid: int

    def train(self, season: str = "season") -> Column:
        return (F.col(season) >= self.first) & (F.col(season) < self.valid)

    def test(self, season: str = "season") -> Column:
        return F.col(season) == self.valid


def folds(first_train: int, valid: Sequence[int], least: int = 1) -> list[Fold]:
    """Expanding folds; each must have ``least`` seasons to train on."""
    if any(v - first_train < least for v in valid):
        raise ValueError("a fold has too few seasons to train on")
    return [Fold(first_train, v) for v in sorted(valid)]


@dataclass(frozen=True)
class Model:
    """``fit(train rows, parameters)`` returns the predicted mean as a column; ``grid`` names parameters to choose from."""

    fit: Callable[[DataFrame, dict], Column]
    grid: tuple[tuple[str, tuple], ...] = ()

    def settings(self) -> list[dict]:
        names = [k for k, _ in self.grid]
        return [dict(zip(names, values, strict=True)) for values in product(*(v for _, v in self.grid))]


def mean_loss(rows: DataFrame, mean: Column, target: str) -> float:
    """Mean Poisson log-loss without the constant."""
    m = F.greatest(mean, F.lit(1e-9))
    return rows.agg(F.avg(m - F.col(target) * F.ln(m))).first()[0]


def select_and_fit(model: Model, train: DataFrame, target: str, season: str = "season") -> tuple[Column, dict]:
    """Each setting is fitted without the last training season and scored on it; the best is fitted on all."""
    settings = model.settings()
    best = settings[0]
    if len(settings) > 1:
        last = train.agg(F.max(season)).first()[0]
        inner, valid = train.filter(F.col(season) < last), train.filter(F.col(season) == last)
        best = min(settings, key=lambda s: mean_loss(valid, model.fit(inner, s), target))
    return model.fit(train, best), best


def walk_forward(rows: DataFrame, models: dict[str, Model], some: Sequence[Fold], item: str, target: str, season: str = "season") -> DataFrame:
    """model, fold, item, mean, target of every test row, for rows that all models predict; ``item`` is a key of ``rows``. Nothing
    but the training rows of a fold reaches a fit, and a mean that needs a target is refused. The rows are written once, since every
    fit reads them; the means of all models stand side by side in a row of them, so nothing is joined or sorted."""
    rows = written(rows, "walk-forward")
    out = None
    for fold in some:
        train, test = rows.filter(fold.train(season)), rows.filter(fold.test(season))
        blind = test.drop(*{t for t in (*TARGETS, target) if t in test.columns})
        means = {name: select_and_fit(model, train, target, season)[0] for name, model in models.items()}
        blind.select(*means.values())  # fails if one names a target
        each = test.filter(F.col(item).isNotNull()).select(item, F.col(target).alias("target"), *(m.alias(f"__mean{k}") for k, m in enumerate(means.values())))
        each = each.dropna(subset=[f"__mean{k}" for k in range(len(means))])
        parts = F.array(*(F.struct(F.lit(name).alias("model"), F.col(f"__mean{k}").cast("double").alias("mean")) for k, name in enumerate(means)))
        part = each.select(F.inline(parts), F.lit(fold.valid).alias("fold"), item, "target").select("model", "fold", item, "mean", "target")
        out = part if out is None else out.unionByName(part)
    return out


def pooled(predictions: DataFrame) -> DataFrame:
    """Mean loss by model and fold, and by model over all folds (fold null)."""
    m = F.greatest(F.col("mean"), F.lit(1e-9))
    loss = m - F.col("target") * F.ln(m)
    return predictions.withColumn("loss", loss).groupBy("model", "fold").agg(F.sum("loss").alias("s"), F.count("*").alias("n")).rollup("model", "fold").agg((F.sum("s") / F.sum("n")).alias("loss"), F.sum("n").alias("n")).filter("model is not null")


def contribution(scores: DataFrame, order: Sequence[str]) -> DataFrame:
    """model, loss, step and cumulative gain along nested models, from their pooled losses."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    w = W.orderBy("rank")  # a few models
    first = F.first("loss").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return scores.filter("fold is null").withColumn("rank", rank).filter("rank > 0").select("rank", "model", "loss", (F.lag("loss").over(w) - F.col("loss")).alias("step"), (first - F.col("loss")).alias("gain"))
