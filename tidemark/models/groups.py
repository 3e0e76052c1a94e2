"""Clusters of standardised vectors, and ordered outcomes by rating gaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.operators.ratings import gap_counts
from tidemark.session import written


def standardised(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's median, then mean 0 and deviation 1 (0 where constant)."""
    medians = rows.agg(*(F.median(c).alias(c) for c in columns)).first()
    filled = rows.na.fill({c: float(medians[c] or 0.0) for c in columns}) if columns else rows
    filled = filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0))) for c in columns})
    s = filled.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return filled.withColumns({c: (F.col(c) - float(s[f"m_{c}"])) / float(s[f"s_{c}"]) if s[f"s_{c}"] else F.lit(0.0) for c in columns})


@dataclass
class Mixtures:
    """Gaussian mixtures of several sizes over the same columns; ``best`` is the size of least BIC."""

    columns: list[str]
    scale: dict[str, tuple[float, float, float]]
    weights: dict[int, np.ndarray]
    means: dict[int, np.ndarray]
    covariances: dict[int, np.ndarray]
    bic: dict[int, float] = field(default_factory=dict)

    @property
    def best(self) -> int:
        return min(self.bic, key=lambda k: (self.bic[k], k))

    def vectors(self, rows: pd.DataFrame) -> np.ndarray:
        """Standardised as in training; what is unknown is the training median."""
        x = rows[self.columns].to_numpy(float)
        median, mean, deviation = (np.array([self.scale[c][i] for c in self.columns]) for i in range(3))
        return (np.where(np.isnan(x), median, x) - mean) / deviation

    def densities(self, x: np.ndarray, k: int) -> np.ndarray:
        """log of weight times density, rows by components."""
        out = np.empty((len(x), k))
        for c in range(k):
            low = np.linalg.cholesky(self.covariances[k][c])
            z = np.linalg.solve(low, (x - self.means[k][c]).T)
            out[:, c] = np.log(max(self.weights[k][c], 1e-300)) - 0.5 * ((z**2).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
        return out

    def assign(self, rows: DataFrame, k: int | None = None) -> DataFrame:
        """``rows``, of training or new, with ``cluster`` and its ``probability``."""
        size, columns = k or self.best, self.columns

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                logs = self.densities(self.vectors(batch), size)
                top = logs.argmax(1)
                batch["cluster"] = top.astype("int32")
                batch["probability"] = np.exp(logs.max(1) - np.logaddexp.reduce(logs, axis=1)) if len(batch) else np.empty(0)
                yield batch

        if {"cluster", "probability"} & set(rows.columns):
            raise ValueError("rows have a cluster or probability already")
        cast = rows.withColumns({c: F.col(c).cast("double") for c in columns})
        return cast.mapInPandas(run, StructType([*cast.schema.fields, StructField("cluster", IntegerType()), StructField("probability", DoubleType())]))


def mixtures(rows: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 9), least: int = 50, seed: int = 1, steps: int = 60, tolerance: float = 1e-4, first: int = 2000) -> Mixtures:
    """Mixtures of all sizes ``ks``, fitted together: a step of expectation-maximisation is one pass over the rows for every size,
    whose tasks give sums by size and component, added up by Spark. A size rests once its mean log likelihood gains less than
    ``tolerance`` twice. Starting means are rows of a sample of about ``first``, each far from those before (the sample chooses
    starts only). Under ``least`` rows are refused."""
    if any(c.startswith("__") for c in columns):
        raise ValueError("names that begin with __ are kept for the fit")
    doubles = written(rows.select(*(F.col(c).cast("double").alias(c) for c in columns)), "mixture-rows")
    n = doubles.count()
    if n < least:
        raise ValueError(f"{n} rows are too few for clusters")
    medians = doubles.agg(*(F.median(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in columns)).first()
    filled = [F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(float(medians[c] or 0.0))) for c in columns]
    figures = doubles.agg(*(F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)), *(F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled))).first()
    scale = {c: (float(medians[c] or 0.0), float(figures[f"m{i}"]), float(figures[f"s{i}"]) or 1.0) for i, c in enumerate(columns)}
    d, sizes = len(columns), sorted(set(ks))
    model = Mixtures(list(columns), scale, {}, {}, {})
    some = model.vectors(doubles.sample(min(1.0, 2.0 * first / n), seed=seed).limit(first).toPandas() if n > first else doubles.toPandas())
    order = np.lexsort(some.T)
    some, draw = some[order], np.random.default_rng(seed)
    for k in sizes:
        centres = [some[draw.integers(len(some))]]
        while len(centres) < k:
            gap = np.min([((some - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(some[draw.choice(len(some), p=gap / gap.sum())] if gap.sum() > 0 else some[draw.integers(len(some))])
        model.weights[k], model.means[k], model.covariances[k] = np.full(k, 1 / k), np.array(centres), np.repeat(np.eye(d)[None] / k, k, 0)
    held = {k: -np.inf for k in sizes}
    active, calm = list(sizes), dict.fromkeys(sizes, 0)
    width = 2 + d + d * d
    for step in range(steps + 1):
        now = list(active)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {k: np.zeros((k, width)) for k in now}
            for batch in batches:
                x = model.vectors(batch)
                for k in now:
                    logs = model.densities(x, k)
                    all_ = np.logaddexp.reduce(logs, axis=1)
                    r = np.exp(logs - all_[:, None])
                    sums[k][:, 0] += r.sum(0)
                    sums[k][0, 1] += all_.sum()
                    sums[k][:, 2 : 2 + d] += r.T @ x
                    sums[k][:, 2 + d :] += np.einsum("nc,ni,nj->cij", r, x, x).reshape(k, d * d)
            flat = [(k, c, i, v) for k, s in sums.items() for c in range(k) for i, v in enumerate(s[c])]
            yield pd.DataFrame(flat, columns=["k", "c", "i", "v"])

        partial = doubles.mapInPandas(run, "k int, c int, i int, v double").groupBy("k", "c", "i").agg(F.sum("v").alias("v"))
        sums = {k: np.zeros((k, width)) for k in now}
        for row in partial.collect():
            sums[row["k"]][row["c"], row["i"]] = row["v"]
        for k in now:
            s, likelihood = sums[k], sums[k][0, 1] / n
            model.bic[k] = float(-2 * sums[k][0, 1] + (k - 1 + k * d + k * d * (d + 1) / 2) * np.log(n))
            calm[k] = calm[k] + 1 if likelihood - held[k] < tolerance else 0
            held[k] = likelihood
            if calm[k] >= 2 or step == steps:
                active.remove(k)
                continue
            count = np.maximum(s[:, 0], 1e-9)
            model.weights[k], model.means[k] = s[:, 0] / n, s[:, 2 : 2 + d] / count[:, None]
            spread = s[:, 2 + d :].reshape(k, d, d) / count[:, None, None] - np.einsum("ci,cj->cij", model.means[k], model.means[k])
            model.covariances[k] = spread + 1e-6 * np.eye(d)
        if not active:
            break
    return model


def mixture(rows: DataFrame, columns: Sequence[str], ks: Sequence[int] = range(2, 9), least: int = 50, seed: int = 1) -> tuple[DataFrame, int]:
    """``rows`` with ``cluster`` from the Gaussian mixture of least BIC, and its number of components."""
    model = mixtures(rows, columns, ks, least, seed)
    return model.assign(rows).drop("probability"), model.best


def ordered_logit(gap: np.ndarray, outcome: np.ndarray, count: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Slope and two thresholds of P(outcome <= j) = expit(c_j - b gap), outcomes 0 (away), 1, 2, and the mean log-loss."""
    x, theta = gap / 100.0, np.array([0.5, -0.5, 0.5])
    total = count.sum()

    def loss(t: np.ndarray) -> float:
        low, high = 1 / (1 + np.exp(-(t[1] - t[0] * x))), 1 / (1 + np.exp(-(t[2] - t[0] * x)))
        p = np.where(outcome == 0, low, np.where(outcome == 1, high - low, 1 - high))
        return float(-(count * np.log(np.maximum(p, 1e-12))).sum() / total)

    def slope(t: np.ndarray) -> np.ndarray:
        return np.array([(loss(t + e) - loss(t - e)) / 2e-6 for e in 1e-6 * np.eye(3)])

    inverse, g = np.eye(3), slope(theta)
    for _ in range(steps):
        step, rate, here = -inverse @ g, 1.0, loss(theta)
        while rate > 1e-8 and not loss(theta + rate * step) < here:
            rate /= 2
        if rate <= 1e-8:
            break
        s = rate * step
        new = slope(theta + s)
        y = new - g
        theta, g = theta + s, new
        if abs(s @ y) > 1e-14:
            rho = 1 / (s @ y)
            a = np.eye(3) - rho * np.outer(s, y)
            inverse = a @ inverse @ a.T + rho * np.outer(s, s)
    return theta, loss(theta)


def tune_elo(contests: DataFrame, ladder: str, grid: Sequence[dict], first_season: int) -> DataFrame:
    """setting, loss, n: ordered-logit loss of home win, draw and away win by rating gap, for each Elo setting. A ladder's season
    is read and rated once for all settings; gaps are counted in steps of five points before they are fitted."""
    binned = gap_counts(contests, ladder, grid, first_season)

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, loss = ordered_logit(rows["gap"].to_numpy(float), rows["outcome"].to_numpy(), rows["n"].to_numpy(float))
        return pd.DataFrame({"setting": [int(key[0])], "loss": [loss], "n": [int(rows["n"].sum())]})

    return binned.groupBy("setting").applyInPandas(score, "setting int, loss double, n long")
