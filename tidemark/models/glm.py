"""Generalised linear models by Newton steps on moments that Spark sums: only p x p numbers reach the driver."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    hessian: np.ndarray
    rows: int

    def linear(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for n, b in zip(self.names[1:], self.beta[1:], strict=True):
            out = out + F.col(n) * float(b)
        return out

    def describe(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist(), strict=True))


def cells(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Counts (``__n``) of the distinct complete rows of covariates and target, written once: what iterations read again and
    again. Covariates of few values make few of them; continuous ones make as many as there are rows, a second, narrow table."""
    if "__n" in rows.columns:
        return rows
    plain = rows.select(*(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, target]))).dropna()
    return written(plain.groupBy(*plain.columns).agg(F.count("*").alias("__n")), "glm-cells")


def moments(rows: DataFrame, xs: list[Column], weight: Column, value: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of weight x x' and value x, and the row count."""
    p = len(xs)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    n = F.col("__n") if "__n" in rows.columns else F.lit(1)
    got = rows.agg(*(F.sum(n * weight * xs[i] * xs[j]).alias(f"h{i}_{j}") for i, j in pairs), *(F.sum(n * value * xs[i]).alias(f"g{i}") for i in range(p)), F.sum(n).alias("n")).first()
    h = np.zeros((p, p))
    for i, j in pairs:
        h[i, j] = h[j, i] = got[f"h{i}_{j}"] or 0.0
    return h, np.array([got[f"g{i}"] or 0.0 for i in range(p)]), got["n"] or 0


def design(features: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *(F.col(f).cast("double") for f in features)]


def ols(rows: DataFrame, features: Sequence[str], target: str) -> Fit:
    h, g, n = moments(rows, design(features), F.lit(1.0), F.col(target).cast("double"))
    return Fit(["intercept", *features], np.linalg.lstsq(h, g, rcond=None)[0], h, n)


@dataclass
class Residuals:
    """An ordinary least-squares fit with what its residuals say: R squared, residual deviation, and the Breusch-Pagan statistic
    (rows times R squared of squared residuals on the covariates) with its degrees of freedom."""

    fit: Fit
    r2: float
    sigma: float
    breusch_pagan: float
    degrees: int


def ols_checked(rows: DataFrame, features: Sequence[str], target: str) -> Residuals:
    """Least squares and the regression of squared residuals from one aggregation: all fourth-degree moments of covariates and
    target, from which both are solved, so residuals are never computed row by row. Moments are taken about a first row near
    the data, against cancellation; their number is about p^4 / 24, for few covariates."""
    known = rows.select(*(F.col(c).cast("double").alias(c) for c in [*features, target])).dropna()
    first = known.first()
    names = ["1D", *(f"({c} - {first[c]!r}D)" for c in [*features, target])] if first else ["1D", *features, target]
    m, keys = len(names), list(itertools.combinations_with_replacement(range(len(names)), 4))
    got = known.selectExpr(*(f"sum({' * '.join(names[i] for i in key)}) AS m{k}" for k, key in enumerate(keys))).first()
    moment = np.zeros((m,) * 4)
    for k, key in enumerate(keys):
        for p in set(itertools.permutations(key)):
            moment[p] = got[k] or 0.0
    n, x = moment[0, 0, 0, 0], slice(0, m - 1)
    second = moment[0, 0]
    beta = np.linalg.lstsq(second[x, x], second[x, -1], rcond=None)[0]
    c = np.r_[-beta, 1.0]
    squared = np.einsum("ijkl,k,l->ij", moment, c, c)[0]
    fourth = np.einsum("ijkl,i,j,k,l->", moment, c, c, c, c)
    rss, tss = squared[0], second[-1, -1] - second[0, -1] ** 2 / max(n, 1)
    gamma = np.linalg.lstsq(second[x, x], squared[x], rcond=None)[0]
    spread = fourth - squared[0] ** 2 / max(n, 1)
    explained = (gamma @ squared[x] - squared[0] ** 2 / max(n, 1)) / spread if spread > 0 else 0.0
    shift = np.array([float(first[c]) for c in features]) if first else np.zeros(len(features))
    fit = beta.copy()
    fit[0] += (float(first[target]) if first else 0.0) - beta[1:] @ shift
    free = n - len(beta)
    return Residuals(Fit(["intercept", *features], fit, second[x, x], int(n)), float(1 - rss / tss) if tss > 0 else 0.0, float(np.sqrt(rss / free)) if free > 0 else float("nan"), float(n * explained), len(features))


def variance_by_fitted(rows: DataFrame, fit: Fit, target: str, parts: int = 5) -> DataFrame:
    """part, n and variance of the residuals, by equal parts of the fitted values (equal values together). The cuts are ranks
    to one in a million, whatever the number of rows."""
    known = rows.select(fit.linear().alias("fitted"), F.col(target).cast("double").alias("y")).dropna()
    cuts = known.agg(F.percentile_approx("fitted", [k / parts for k in range(1, parts)], 1_000_000)).first()[0] or []
    part = sum(((F.col("fitted") > float(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    return known.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.var_samp(F.col("y") - F.col("fitted")).alias("variance"))


def negative_binomial_loglik(table: DataFrame, mean: str, target: str, alphas: Sequence[float]) -> list[float]:
    """Log likelihoods of counts in ``table`` (with ``__n``) at means ``mean``, SQL, for each alpha; Poisson's for zero."""
    y = target
    parts = []
    for a in alphas:
        if a <= 0:
            parts.append(f"{y} * ln({mean}) - ({mean})")
        else:
            grown = f"1 + {a!r}D * ({mean})"
            rising = f"aggregate(sequence(0, greatest(cast({y} AS INT) - 1, 0)), 0D, (s, i) -> s + if(i < {y}, ln(1 + {a!r}D * i), 0D))"
            parts.append(f"{rising} - {1 / a!r}D * ln({grown}) + {y} * (ln({mean}) - ln({grown}))")
    got = table.selectExpr(*(f"sum(__n * ({p})) AS l{k}" for k, p in enumerate(parts))).first()
    return [float(v or 0.0) for v in got]


def overdispersion_test(rows: DataFrame, features: Sequence[str], target: str, most: float = 64.0, tolerance: float = 1e-9) -> dict[str, float]:
    """Likelihood ratio of NB2 against Poisson, alpha on the boundary under the null: half of chi-square's tail. Coefficients are
    those of each model; alpha is the maximum in a bracket whose points are summed in one aggregation a step."""
    table = cells(rows, features, target)
    restricted, (full, alpha) = poisson(table, features, target), negative_binomial(table, features, target)

    def mean(fit: Fit) -> str:
        return "exp(" + " + ".join([f"{float(fit.beta[0])!r}D", *(f"{float(b)!r}D * {n}" for n, b in zip(fit.names[1:], fit.beta[1:], strict=True))]) + ")"

    low, high = 0.0, most
    while high - low > tolerance * max(1.0, high):
        points = [low + (high - low) * k / 8 for k in range(9)]
        at = int(np.argmax(negative_binomial_loglik(table, mean(full), target, points)))
        low, high = points[max(0, at - 1)], points[min(8, at + 1)]
    alpha = (low + high) / 2 if high > tolerance * 2 else 0.0
    base = negative_binomial_loglik(table, mean(restricted), target, [0.0])[0]
    best = negative_binomial_loglik(table, mean(full), target, [alpha])[0] if alpha else base
    return {"alpha": alpha, "lr": max(0.0, 2 * (best - base))}


def nnls_two(rows: DataFrame, a: str, b: str, target: str) -> tuple[float, float]:
    """Non-negative least squares without an intercept for two coefficients: the best of the active sets."""
    x, y, t = (F.col(c).cast("double") for c in (a, b, target))
    s = rows.agg(*(F.sum(e).alias(k) for k, e in {"aa": x * x, "ab": x * y, "bb": y * y, "at": x * t, "bt": y * t}.items())).first()
    options = [(0.0, 0.0), (max(0.0, s["at"] / s["aa"]), 0.0), (0.0, max(0.0, s["bt"] / s["bb"]))]
    det = s["aa"] * s["bb"] - s["ab"] ** 2
    if det > 0:
        both = ((s["at"] * s["bb"] - s["bt"] * s["ab"]) / det, (s["bt"] * s["aa"] - s["at"] * s["ab"]) / det)
        if min(both) >= 0:
            options.append(both)
    return min(options, key=lambda o: o[0] ** 2 * s["aa"] + 2 * o[0] * o[1] * s["ab"] + o[1] ** 2 * s["bb"] - 2 * (o[0] * s["at"] + o[1] * s["bt"]))


def poisson(rows: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0, steps: int = 25, tolerance: float = 1e-10) -> Fit:
    """Poisson regression with log link; ridge adds ridge/2 |slopes|^2 to the mean deviance / 2."""
    rows, xs, y = cells(rows, features, target), design(features), F.col(target).cast("double")
    mean, n = rows.agg((F.sum(F.col("__n") * y) / F.sum(F.when(y.isNotNull(), F.col("__n")))).alias("m"), F.sum("__n").alias("n")).first()
    beta = np.zeros(len(xs))
    beta[0] = np.log(max(mean or 1.0, 1e-9))
    penalty = np.diag([0.0] + [ridge * (n or 0)] * len(features))
    h = np.eye(len(xs))
    for _ in range(steps):
        mu = F.exp(sum((x * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0)))
        h, g, n = moments(rows, xs, mu, y - mu)
        step = np.linalg.solve(h + penalty + 1e-12 * np.eye(len(xs)), g - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return Fit(["intercept", *features], beta, h + penalty, n)


def clustered_errors(rows: DataFrame, fit: Fit, target: str, cluster: str) -> np.ndarray:
    """Cluster-robust standard errors of a Poisson fit: score sums by cluster, their outer products summed."""
    xs = design(fit.names[1:])
    residual = F.col(target).cast("double") - F.exp(fit.linear())
    scores = rows.groupBy(cluster).agg(*(F.sum(residual * x).alias(f"s{i}") for i, x in enumerate(xs)))
    meat, _, _ = moments(scores, [F.col(f"s{i}") for i in range(len(xs))], F.lit(1.0), F.lit(0.0))
    bread = np.linalg.inv(fit.hessian)
    return np.sqrt(np.diag(bread @ meat @ bread))


def logistic(rows: DataFrame, features: Sequence[str], target: str, steps: int = 30, tolerance: float = 1e-10) -> Fit:
    """Logistic regression, Platt's calibration among others."""
    rows, xs, y = cells(rows, features, target), design(features), F.col(target).cast("double")
    beta, h, n = np.zeros(len(xs)), np.eye(len(xs)), 0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-sum((x * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))))
        h, g, n = moments(rows, xs, p * (1 - p), y - p)
        step = np.linalg.solve(h + 1e-9 * np.eye(len(xs)), g)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return Fit(["intercept", *features], beta, h, n)


def negative_binomial(rows: DataFrame, features: Sequence[str], target: str, rounds: int = 6) -> tuple[Fit, float]:
    """NB2: IRLS steps for the coefficients, the moment equation for alpha, in turns."""
    rows, y, alpha = cells(rows, features, target), F.col(target).cast("double"), 0.0
    fit = poisson(rows, features, target)
    for _ in range(rounds):
        mu = F.exp(fit.linear())
        r = rows.agg(F.sum(F.col("__n") * ((y - mu) * (y - mu) - mu)).alias("a"), F.sum(F.col("__n") * mu * mu).alias("b")).first()
        alpha = max(0.0, r["a"] / r["b"])
        w = 1 / (1 + alpha * mu)
        h, g, n = moments(rows, design(features), mu * w, (y - mu) * w)
        fit = Fit(fit.names, fit.beta + np.linalg.solve(h, g), h, n)
    return fit, alpha


def elastic_net(rows: DataFrame, features: Sequence[str], target: str, strength: float, mix: float = 0.5, steps: int = 20) -> Fit:
    """Poisson regression with elastic-net penalty: proximal Newton, coordinate descent on the p x p moments."""
    rows = cells(rows, features, target)
    base = poisson(rows, [], target)
    beta = np.r_[base.beta, np.zeros(len(features))]
    xs, y = design(features), F.col(target).cast("double")
    h, n = np.eye(len(xs)), base.rows
    for _ in range(steps):
        mu = F.exp(sum((x * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0)))
        h, g, n = moments(rows, xs, mu, y - mu)
        a, c = h / n, (g + h @ beta) / n
        new = beta.copy()
        for _ in range(200):
            last = new.copy()
            for j in range(len(new)):
                z = c[j] - a[j] @ new + a[j, j] * new[j]
                new[j] = z / a[j, j] if j == 0 else np.sign(z) * max(0.0, abs(z) - strength * mix) / (a[j, j] + strength * (1 - mix))
            if np.abs(new - last).max() < 1e-12:
                break
        moved = np.abs(new - beta).max()
        beta = new
        if moved < 1e-9:
            break
    return Fit(["intercept", *features], beta, h, n)
