"""Discrete distributions as array columns: index k holds P(X = k), the last index the whole tail."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def let(x: Column, use) -> Column:
    """use(x), with x evaluated once a row however often ``use`` names it."""
    return F.transform(F.array(x), use)[0]


def poisson(mean: Column, size: int) -> Column:
    """Poisson probabilities of 0 .. size - 1, by p(k) = p(k-1) mean / k; nothing is folded."""
    start = F.array(F.exp(-mean))
    return F.aggregate(F.sequence(F.lit(1), F.lit(size - 1)), start, lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * mean / k)))


def negative_binomial(mean: Column, alpha: Column, size: int) -> Column:
    """Variance mean + alpha mean^2."""
    n = 1.0 / alpha
    q = mean / (n + mean)
    start = F.array(F.pow(1.0 - q, n))
    return F.aggregate(F.sequence(F.lit(1), F.lit(size - 1)), start, lambda a, k: F.concat(a, F.array(F.element_at(a, -1) * (n + k - 1.0) / k * q)))


def fold(pmf: Column, size: int) -> Column:
    """The first size - 1 probabilities, and the rest as the last."""
    return let(F.slice(pmf, 1, size - 1), lambda head: F.concat(head, F.array(F.greatest(F.lit(0.0), 1.0 - total(head)))))


def convolve(a: Column, b: Column, size: int) -> Column:
    """Probabilities 0 .. size - 1 of the sum of independent variables."""

    def both(ab: Column) -> Column:
        x, y = ab["a"], ab["b"]

        def at(k: Column) -> Column:
            low = F.greatest(F.lit(0), k - F.size(y) + 1)
            high = F.least(k, F.size(x) - 1)
            return F.when(low <= high, total(F.transform(F.sequence(low, F.greatest(low, high)), lambda i: F.get(x, i) * F.get(y, k - i)))).otherwise(0.0)

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)

    return let(F.struct(a.alias("a"), b.alias("b")), both)


def joint(home: Column, away: Column) -> Column:
    return let(away, lambda other: F.transform(home, lambda h: F.transform(other, lambda a: h * a)))


def total_of_joint(matrix: Column, size: int) -> Column:
    """Distribution of the sum of both coordinates, folded."""

    def sums(m: Column) -> Column:
        def at(k: Column) -> Column:
            return total(F.transform(F.sequence(F.lit(0), F.least(k, F.size(m) - 1)), lambda i: F.coalesce(F.get(F.get(m, i), k - i), F.lit(0.0))))

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)

    return let(let(matrix, sums), lambda p: fold(p, size))


def outcomes(matrix: Column) -> Column:
    """struct(home, draw, away), summing to one."""
    rows = F.transform(matrix, lambda r, i: F.struct(total(F.slice(r, 1, i)).alias("home"), F.get(r, i).alias("draw"), total(F.filter(r, lambda _, j: j > i)).alias("away")))

    def normalised(x: Column) -> Column:
        sums = [total(_field(x, k)) for k in ("home", "draw", "away")]
        s = sums[0] + sums[1] + sums[2]
        return F.struct(*((v / s).alias(k) for v, k in zip(sums, ("home", "draw", "away"), strict=True)))

    return let(rows, normalised)


def independent_outcomes(home: Column, away: Column) -> Column:
    """``outcomes`` of the joint of two independent distributions of one size, in one pass over both with a running sum."""
    start = F.struct(*(F.lit(0.0).alias(k) for k in ("below", "rest", "home", "draw")))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["below"] + x["a"]).alias("below"), (acc["rest"] + x["h"]).alias("rest"), (acc["home"] + x["h"] * acc["below"]).alias("home"), (acc["draw"] + x["h"] * x["a"]).alias("draw"))

    def shares(acc: Column) -> Column:
        whole = acc["below"] * acc["rest"]
        return F.struct((acc["home"] / whole).alias("home"), (acc["draw"] / whole).alias("draw"), ((whole - acc["home"] - acc["draw"]) / whole).alias("away"))

    return F.aggregate(F.zip_with(home, away, lambda h, a: F.struct(h.alias("h"), a.alias("a"))), start, step, shares)


def _field(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda x: x[name])


def low_score_factor(h: Column, a: Column, lh: Column, la: Column, rho: Column) -> Column:
    """Dixon-Coles correction of the four lowest scores."""
    return (
        F.when((h == 0) & (a == 0), 1 - lh * la * rho).when((h == 0) & (a == 1), 1 + lh * rho).when((h == 1) & (a == 0), 1 + la * rho).when((h == 1) & (a == 1), 1 - rho).otherwise(1.0)
    )


def corrected_joint(lh: Column, la: Column, rho: Column, size: int) -> Column:
    raw = joint(poisson(lh, size), poisson(la, size))
    return F.transform(raw, lambda r, h: F.transform(r, lambda p, a: F.greatest(F.lit(0.0), p * low_score_factor(h, a, lh, la, rho))))


def _corrected(lh: np.ndarray, la: np.ndarray, rho: np.ndarray, size: int) -> np.ndarray:
    """``corrected_joint`` of arrays: rows x home x away."""
    home, away = (np.cumprod(np.column_stack([np.exp(-m), *(m / k for k in range(1, size))]), axis=1) for m in (lh, la))
    p = home[:, :, None] * away[:, None, :]
    for h, a, tau in ((0, 0, 1 - lh * la * rho), (0, 1, 1 + lh * rho), (1, 0, 1 + la * rho), (1, 1, 1 - rho)):
        if max(h, a) < size:
            p[:, h, a] *= tau
    return np.maximum(p, 0.0)


def corrected_summary(lh: Column, la: Column, rho: Column, size: int) -> Column:
    """struct(p00, p01, p10, p11, mass, home_mean, away_mean, squares) of ``corrected_joint``, whose cells are only made in arrays
    of a batch; ``size`` is two at least, nulls give nulls."""
    names = ("p00", "p01", "p10", "p11", "mass", "home_mean", "away_mean", "squares")

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def summary(lh: pd.Series, la: pd.Series, rho: pd.Series) -> pd.DataFrame:
        parts = [np.empty((0, len(names)))]
        for i in range(0, len(lh), 4096):
            p = _corrected(*(s.iloc[i : i + 4096].to_numpy(float) for s in (lh, la, rho)), size)
            k = np.arange(size)
            parts.append(np.column_stack([p[:, 0, 0], p[:, 0, 1], p[:, 1, 0], p[:, 1, 1], p.sum(axis=(1, 2)), p.sum(axis=2) @ k, p.sum(axis=1) @ k, (p * p).sum(axis=(1, 2))]))
        return pd.DataFrame(np.concatenate(parts), columns=list(names))

    return summary(lh.cast("double"), la.cast("double"), rho.cast("double"))


def corrected_outcomes(lh: Column, la: Column, rho: Column, size: int) -> Column:
    """``outcomes`` of ``corrected_joint``, whose cells are only made in arrays of a batch; nulls give nulls, as do rates so
    large that no cell has any mass."""
    names = ("home", "draw", "away")

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def sums(lh: pd.Series, la: pd.Series, rho: pd.Series) -> pd.DataFrame:
        parts = [np.empty((0, len(names)))]
        for i in range(0, len(lh), 4096):
            p = _corrected(*(s.iloc[i : i + 4096].to_numpy(float) for s in (lh, la, rho)), size)
            some = np.column_stack([np.tril(p, -1).sum(axis=(1, 2)), np.trace(p, axis1=1, axis2=2), np.triu(p, 1).sum(axis=(1, 2))])
            mass = some.sum(axis=1, keepdims=True)
            parts.append(np.divide(some, mass, out=np.full_like(some, np.nan), where=mass > 0))
        return pd.DataFrame(np.concatenate(parts), columns=list(names))

    return sums(lh.cast("double"), la.cast("double"), rho.cast("double"))


def cdf(pmf: Column) -> Column:
    return let(pmf, lambda p: F.transform(p, lambda _, i: total(F.slice(p, 1, i + 1))))


def quantile(pmf: Column, q: float) -> Column:
    """The least k with P(X <= k) >= q, up to rounding."""
    return F.size(F.filter(cdf(pmf), lambda x: x < q - 1e-12))


def interval_mass(pmf: Column, low: Column, high: Column) -> Column:
    return total(F.slice(pmf, low + 1, high - low + 1))


def tail(pmf: Column, above: float) -> Column:
    """P(X > above)."""
    return total(F.filter(pmf, lambda _, i: i > above))


def mean_of(pmf: Column) -> Column:
    return total(F.transform(pmf, lambda p, i: p * i))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function (Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-z * z)
    return 0.5 * (1.0 + F.when(x < 0, -erf).otherwise(erf))


#: Coefficients of Lanczos' series for the logarithm of the gamma function (g = 7), fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Of positive ``x``, to about fourteen digits."""
    z = x - 1.0
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (z + float(k))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def _gamma_tails(a: np.ndarray, x: np.ndarray, log_gammas: np.ndarray, terms: int) -> np.ndarray:
    """``gamma_tail`` of arrays. Rows leave a round of the series or the fraction once a step moves them no more."""
    out = np.where(np.isnan(x) | np.isnan(a), np.nan, 1.0)
    with np.errstate(all="ignore"):
        scale = np.exp(-x + a * np.log(x) - log_gammas)
        at = np.flatnonzero((x > 0) & (x < a + 1))
        term = total = 1.0 / a[at]
        for k in range(1, terms + 1):
            if not len(at):
                break
            term = term * x[at] / (a[at] + k)
            new = total + term
            done = (new == total) | (k == terms)
            out[at[done]] = 1.0 - scale[at[done]] * new[done]
            at, term, total = at[~done], term[~done], new[~done]
        at = np.flatnonzero((x > 0) & (x >= a + 1))
        b0 = x[at] + 1.0 - a[at]
        d, c, h = 1.0 / b0, np.full(len(at), 1e300), 1.0 / b0
        for k in range(1, terms + 1):
            if not len(at):
                break
            step, b = -(k * (k - a[at])), x[at] + 1.0 - a[at] + 2.0 * k
            d = 1.0 / (step * d + b)
            c = b + step / c
            held = h * d * c
            done = (np.abs(d * c - 1.0) < 1e-15) | (step == 0) | np.isnan(held) | (k == terms)  # a zero step ends the fraction
            out[at[done]] = scale[at[done]] * held[done]
            at, d, c, h = at[~done], d[~done], c[~done], held[~done]
    return out


def gamma_tail(a: Column, x: Column, terms: int = 250) -> Column:
    """The regularised upper incomplete gamma function Q(a, x): below a + 1 one less its series, above it its continued fraction
    (both of at most ``terms`` terms, enough for a up to some hundreds, and no more than a row needs). One where x isn't positive."""

    @F.pandas_udf("double")
    def tails(a: pd.Series, x: pd.Series, log_gammas: pd.Series) -> pd.Series:
        return pd.Series(_gamma_tails(*(s.to_numpy(float) for s in (a, x, log_gammas)), terms))

    a, x = a.cast("double"), x.cast("double")
    return F.when(a.isNotNull() & x.isNotNull(), tails(a, x, log_gamma(a)))


def chi_square_tail(x: Column, degrees: Column | float) -> Column:
    """P(X > x) of chi-square."""
    k = F.lit(float(degrees)) if isinstance(degrees, int | float) else degrees.cast("double")
    return gamma_tail(k / 2.0, x.cast("double") / 2.0)


def normal_tail(x: Column) -> Column:
    """P(X > x) of the standard normal, to about thirteen digits."""
    far = 0.5 * gamma_tail(F.lit(0.5), x * x / 2.0)
    return F.when(x < 0, 1.0 - far).otherwise(far)


def discretised_normal(mean: Column, sd: Column, size: int) -> Column:
    """P(k - 1/2 < X <= k + 1/2), all below in the first and all above in the last."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(size - 2)), lambda k: normal_cdf((k + 0.5 - mean) / sd))
    return let(edges, lambda e: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.when(k == size - 1, 1.0).otherwise(F.get(e, k)) - F.when(k == 0, 0.0).otherwise(F.get(e, k - 1))))


def implied(over: Column, under: Column) -> Column:
    """Probability of the first of two odds, the margin removed; null for odds of one or less."""
    return F.when((over > 1) & (under > 1), (1 / over) / (1 / over + 1 / under))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def labelled(pmf: Column, last: int) -> Column:
    """Map '0', '1', ..., '{last}+' to probabilities."""
    keys = F.array(*(F.lit(str(k) if k < last else f"{last}+") for k in range(last + 1)))
    return F.map_from_arrays(keys, pmf)
