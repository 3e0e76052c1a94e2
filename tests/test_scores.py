"""The score model, decay search and dependence against generators and plain numpy."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.functions import prob
from tidemark.models import dependence, glm, scores
from tidemark.operators import scoring


def generate(seed, n=6000, sides=8, rho=-0.1, gamma=0.3, delta=0.2):
    r = np.random.default_rng(seed)
    attack, defence = r.normal(0.1, 0.25, sides), r.normal(0, 0.2, sides)
    h = r.integers(0, sides, n)
    a = (h + r.integers(1, sides, n)) % sides
    x = r.choice([-1.0, 0.0, 1.0], (n, 2))
    lh, la = np.exp(attack[h] - defence[a] + gamma + delta * x[:, 0]), np.exp(attack[a] - defence[h] + delta * x[:, 1])
    yh, ya = r.poisson(lh), r.poisson(la)
    tau = np.ones(n)
    for (i, j), t in {(0, 0): 1 - lh * la * rho, (1, 0): 1 + la * rho, (0, 1): 1 + lh * rho, (1, 1): np.full(n, 1 - rho)}.items():
        tau = np.where((yh == i) & (ya == j), t, tau)
    keep = r.random(n) < tau / 1.6  # rejection: scores in proportion to the corrected probabilities
    day = r.integers(0, 1000, n)
    return np.c_[h, a, yh, ya, day, x][keep], attack, defence


@pytest.fixture(scope="module")
def contests(spark):
    rows, attack, defence = generate(1)
    df = spark.createDataFrame([(k, *map(int, r[:5]), *map(float, r[5:])) for k, r in enumerate(rows)], "match_id long, home_id long, away_id long, home_goals int, away_goals int, day int, home_x double, away_x double")
    return df.cache(), rows, attack, defence


def gradient(rows, attack, defence, gamma, delta, rho, w):
    """Slopes of the weighted log likelihood by differences, all parameters."""
    h, a, yh, ya = rows[:, :4].T.astype(int)
    s = len(attack)

    def value(theta):
        at, de, g, d, r = theta[:s], theta[s : 2 * s], *theta[2 * s :]
        lh, la = np.exp(at[h] - de[a] + g + d * rows[:, 5]), np.exp(at[a] - de[h] + d * rows[:, 6])
        tau = np.select([(yh == 0) & (ya == 0), (yh == 1) & (ya == 0), (yh == 0) & (ya == 1), (yh == 1) & (ya == 1)], [1 - lh * la * r, 1 + la * r, 1 + lh * r, np.full(len(h), 1 - r)], 1.0)
        return (w * (np.log(tau) + yh * np.log(lh) - lh + ya * np.log(la) - la)).sum()

    theta = np.r_[attack, defence, gamma, delta, rho]
    return np.array([(value(theta + e) - value(theta - e)) / 2e-5 for e in np.eye(len(theta)) * 1e-5])


def strengths_of(model, k=0):
    got = {r["side"]: r for r in model.strengths.collect()}
    return (np.array([got[i][f"{what}{k}"] for i in sorted(got)]) for what in ("attack", "defence"))


def test_score_model_is_the_maximum_and_recovers_parameters(contests):
    df, rows, attack, defence = contests
    model = scores.fit(df, [0.0, 0.002], features=["x"])
    assert model.moved < 1e-5 and model.strengths.count() == 8
    for k, xi in enumerate(model.decays):
        at, de = strengths_of(model, k)
        gamma, delta, rho = model.shared[k]
        slope = gradient(rows, at, de, gamma, delta, rho, np.exp(-xi * (rows[:, 4].max() - rows[:, 4])))
        assert np.abs(slope).max() < 0.05, slope
        assert at[0] == 0
    at, de = strengths_of(model)
    assert np.abs(at - (attack - attack[0])).max() < 0.12 and np.abs(de - (defence - attack[0])).max() < 0.12
    assert np.abs(model.shared[0] - [0.3, 0.2, -0.1]).max() < 0.08


def test_decay_search_equals_one_by_one(spark, contests):
    df, rows, *_ = contests
    grid = [0.0, 0.003]
    found, best, _ = scores.decay_search(df, grid, 800, features=["x"], steps=4)
    alone = []
    for xi in grid:
        model = scores.fit(df.filter("day < 800"), [xi], features=["x"], steps=4)
        alone.append(scores.log_loss(model, df.filter("day >= 800"))[0])
    assert np.allclose([v for _, v in found], alone, atol=1e-9) and best == int(np.argmin(alone))
    tracker = spark.sparkContext.statusTracker()

    def jobs(values, group):
        spark.sparkContext.setJobGroup(group, group)
        scores.decay_search(df, values, 800, features=["x"], steps=1, tolerance=0.0)
        return len(tracker.getJobIdsForGroup(group))

    one, many = jobs([0.001], "one"), jobs([0.0, 0.001, 0.01], "many")
    spark.sparkContext._jsc.clearJobGroup()
    assert abs(one - many) <= 2


def test_score_model_edges(spark):
    schema = "match_id long, home_id long, away_id long, home_goals int, away_goals int, day int"
    empty = scores.fit(spark.createDataFrame([], schema), [0.0])
    assert empty.strengths.count() == 0
    some = spark.createDataFrame([(1, 1, 2, 2, 0, 1), (2, 2, 1, 1, 0, 2), (3, 1, 2, None, 1, 3), (4, None, 2, 1, 1, 3), (5, 3, 1, 0, 1, 4)], schema)
    model = scores.fit(some, [0.0], steps=5)
    got = {r["side"]: r for r in model.strengths.collect()}
    assert set(got) == {1, 2, 3} and all(np.isfinite(r["attack0"]) for r in got.values())
    assert np.isnan(scores.log_loss(model, some.limit(0))[0])


def test_exact_scores_refuse_without_history(spark, contests):
    df, rows, *_ = contests
    model = scores.fit(df, [0.0], features=["x"], steps=3)
    fixtures = spark.createDataFrame([(1, 0, 1, 500, 0.0, 0.0), (2, 0, 1, 0, 0.0, 0.0), (3, 0, 99, 2000, 0.0, 0.0)], "match_id long, home_id long, away_id long, day int, home_x double, away_x double")
    got = {r["match_id"]: r for r in scores.exact_scores(model, fixtures, df, least=5, size=15).collect()}
    assert got[1]["refused"] is None and abs(sum(map(sum, got[1]["joint"])) - 1) < 1e-6
    played = ((rows[:, 0] == 0) | (rows[:, 1] == 0)) & (rows[:, 4] < 500)
    assert got[1]["home_games"] == played.sum()
    assert got[2]["refused"] == "home side lacks history" and got[2]["joint"] is None and got[2]["home_rate"] is None
    assert got[3]["refused"] == "away side lacks history" and got[3]["away_games"] == 0


def test_rho_by_bracket(spark):
    rows, attack, defence = generate(3, n=4000, delta=0.0)
    h, a = rows[:, 0].astype(int), rows[:, 1].astype(int)
    lh, la = np.exp(attack[h] - defence[a] + 0.3), np.exp(attack[a] - defence[h])
    yh, ya = rows[:, 2], rows[:, 3]
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.c_[yh, ya, lh, la]], "home_goals double, away_goals double, home_rate double, away_rate double")
    grid = np.linspace(-0.25, 0.12, 3701)
    value = [np.log(np.select([(yh == 0) & (ya == 0), (yh == 1) & (ya == 0), (yh == 0) & (ya == 1), (yh == 1) & (ya == 1)], [1 - lh * la * r, 1 + la * r, 1 + lh * r, np.full(len(lh), 1 - r)], 1.0)).sum() for r in grid]
    got = dependence.rho(df)
    assert abs(got - grid[int(np.argmax(value))]) <= 1e-4
    assert abs(dependence.rho(df, digits=3) - got) < 1e-3
    assert dependence.rho(df.limit(0)) is None
    only = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0)], df.schema)
    assert abs(dependence.rho(only) - -1.0) < 1e-4


def test_least_squares_from_fourth_moments(spark):
    r = np.random.default_rng(5)
    x = r.normal(1000, 2, (3000, 2))
    y = 3 + 0.5 * x[:, 0] - x[:, 1] + r.normal(0, 1, 3000) * (1 + 0.3 * np.abs(x[:, 0] - 1000))
    df = spark.createDataFrame([tuple(map(float, v)) for v in np.c_[x, y]] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = glm.ols_checked(df, ["a", "b"], "y")
    X = np.c_[np.ones(3000), x - 1000]
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    e2 = (y - X @ beta) ** 2
    g = np.linalg.lstsq(X, e2, rcond=None)[0]
    want = 3000 * ((X @ g - e2.mean()) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    assert got.fit.rows == 3000 and np.allclose(got.fit.beta[1:], beta[1:], atol=1e-6) and abs(got.breusch_pagan / want - 1) < 1e-6
    assert abs(got.sigma - np.sqrt(e2.sum() / 2997)) < 1e-8 and abs(got.r2 - (1 - e2.sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    parts = glm.variance_by_fitted(df, got.fit, "y").orderBy("part").collect()
    fitted = X @ beta
    cut = np.quantile(fitted, [0.2, 0.4, 0.6, 0.8])
    for k, row in enumerate(parts):
        mine = (y - fitted)[np.searchsorted(cut, fitted) == k]
        assert row["n"] == len(mine) and abs(row["variance"] - mine.var(ddof=1)) < 1e-6
    assert glm.ols_checked(df.limit(0), ["a"], "y").fit.rows == 0


def test_tails(spark):
    row = spark.createDataFrame([(0.0, 0), (1e-3, 1), (0.7, 2), (3.841458820694124, 3), (11.0, 4), (60.0, 5), (-2.0, 6)], "x double, i int")
    for r in row.select("x", prob.chi_square_tail(row.x, 1).alias("one"), prob.chi_square_tail(row.x, 3).alias("three"), prob.normal_tail(row.x).alias("normal"), prob.log_gamma(F.abs("x") + 0.1).alias("lg")).collect():
        x = max(r["x"], 0.0)
        assert abs(r["one"] - math.erfc(math.sqrt(x / 2))) < 1e-9
        assert abs(r["three"] - (math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2))) < 1e-9
        assert abs(r["normal"] - 0.5 * math.erfc(r["x"] / math.sqrt(2))) < 1e-9
        assert abs(r["lg"] - math.lgamma(abs(r["x"]) + 0.1)) < 1e-9 * max(1, abs(r["lg"]))


def test_overdispersion(spark):
    r = np.random.default_rng(2)
    clumped = spark.createDataFrame([(int(v),) for v in r.negative_binomial(2, 0.25, 2000)], "y int")
    even = spark.createDataFrame([(int(v),) for v in r.binomial(20, 0.5, 2000)], "y int")
    got, none = glm.overdispersion_test(clumped, [], "y"), glm.overdispersion_test(even, [], "y")
    assert 0.4 < got["alpha"] < 0.62 and got["lr"] > 500
    assert none == {"alpha": 0.0, "lr": 0.0}


def test_slope_interval(spark):
    r = np.random.default_rng(3)
    rows = [(s, b, float(x), float(2 * x + e)) for s in range(2) for b in range(12) for x, e in zip(r.normal(0, 1, 20), r.normal(0, 1, 20), strict=True)]
    df = spark.createDataFrame([*rows, (0, 0, None, 1.0)], "s int, b int, x double, y double")
    got = scoring.slope_interval(df, "s", "b", "x", "y", replicates=500).first()
    x, y = np.array([v[2:] for v in rows]).T
    assert got["n"] == 480 and got["blocks"] == 24 and abs(got["slope"] - np.polyfit(x, y, 1)[0]) < 1e-9
    assert got["low"] < got["slope"] < got["high"] and got["high"] - got["low"] < 0.4
    flat = scoring.slope_interval(df.withColumn("x", F.lit(1.0)), "s", "b", "x", "y", replicates=10).first()
    few = scoring.slope_interval(df.filter("s = 0 AND b < 3"), "s", "b", "x", "y", replicates=10).first()
    none = scoring.slope_interval(df.limit(0), "s", "b", "x", "y", replicates=10).first()
    assert flat["slope"] is None and few["low"] is None and few["n"] == 60 and none["n"] == 0
