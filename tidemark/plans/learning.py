"""L-: models, fitted on sums that Spark computes and reported as rows of (name, value)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from tidemark.functions import prob
from tidemark.models import calibrate, dependence, glm, groups, scores, trees
from tidemark.models.design import Design
from tidemark.operators import protocol, stats
from tidemark.plans.base import MATCHES, matches, query, r6, table
from tidemark.session import written


def rows_of(spark, sf):
    m = matches(spark, sf)
    return m.select("match_id", "league", "season", "home_goals", "away_goals", (F.col("home_goals") + F.col("away_goals")).alias("y"), ((F.col("day") % 100) / 100.0).alias("a"), (F.col("match_id") % 10 / 10.0).alias("b"))


BASE = f"WITH {MATCHES}, x AS (SELECT match_id, league, season, home_goals, away_goals, home_goals + away_goals AS y, (day % 100) / 100.0 AS a, (match_id % 10) / 10.0 AS b FROM matches)"


def report(spark, values: dict[str, float]):
    return spark.createDataFrame([(k, round(float(v), 6) + 0.0) for k, v in values.items()], "name string, value double")


@query(BASE + """, s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb FROM x) SELECT 'a' AS name, round((ay * bb - yb * ab) / (aa * bb - ab * ab), 6) + 0.0 AS value FROM s UNION ALL SELECT 'b', round((yb * aa - ay * ab) / (aa * bb - ab * ab), 6) + 0.0 FROM s""")
def l01_nnls(spark, sf):
    a, b = glm.nnls_two(rows_of(spark, sf), "a", "b", "y")
    return report(spark, {"a": a, "b": b})


@query(BASE + """ SELECT 'intercept' AS name, round(regr_intercept(y, a), 6) + 0.0 AS value FROM x UNION ALL SELECT 'a', round(regr_slope(y, a), 6) + 0.0 FROM x""")
def l04_least_squares(spark, sf):
    return report(spark, glm.ols(rows_of(spark, sf), ["a"], "y").describe())


MOMENTS_AB = BASE + """, c AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb, var_pop(y) AS yy FROM x),
f AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS ka, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM c),
e AS (SELECT match_id, a, b, y - my - ka * (a - ma) - kb * (b - mb) AS r, my + ka * (a - ma) + kb * (b - mb) AS fitted FROM x, f)"""


@query(MOMENTS_AB + """, s AS (SELECT count(*) AS n, var_pop(r * r) AS v, covar_pop(a, r * r) AS va, covar_pop(b, r * r) AS vb, sum(r * r) AS rss FROM e),
t AS (SELECT s.n, 1 - rss / (s.n * yy) AS r2, sqrt(rss / (s.n - 3)) AS sigma, s.n * (va * (va * bb - vb * ab) + vb * (vb * aa - va * ab)) / (aa * bb - ab * ab) / v AS bp FROM s, f)
SELECT n, round(r2, 6) + 0.0 AS r2, round(sigma, 6) + 0.0 AS sigma, round(bp, 5) + 0.0 AS breusch_pagan, round(exp(-bp / 2), 6) + 0.0 AS p_value FROM t""")
def l04_breusch_pagan(spark, sf):
    """Least squares of totals with the test for unequal variance, from one aggregation."""
    got = glm.ols_checked(rows_of(spark, sf), ["a", "b"], "y")
    row = spark.createDataFrame([(got.fit.rows, got.r2, got.sigma, got.breusch_pagan)], "n long, r2 double, sigma double, breusch_pagan double")
    p = prob.chi_square_tail(F.col("breusch_pagan"), got.degrees)
    return row.withColumn("p", p).select("n", r6("r2").alias("r2"), r6("sigma").alias("sigma"), (F.round("breusch_pagan", 5) + 0.0).alias("breusch_pagan"), r6("p").alias("p_value"))


@query(MOMENTS_AB + """, q AS (SELECT round(quantile_disc(fitted, 0.2), 9) AS q1, round(quantile_disc(fitted, 0.4), 9) AS q2, round(quantile_disc(fitted, 0.6), 9) AS q3, round(quantile_disc(fitted, 0.8), 9) AS q4 FROM e),
g AS (SELECT r, (round(fitted, 9) > q1)::INT + (round(fitted, 9) > q2)::INT + (round(fitted, 9) > q3)::INT + (round(fitted, 9) > q4)::INT AS part FROM e, q)
SELECT part, count(*) AS n, round(var_samp(r), 6) + 0.0 AS variance FROM g GROUP BY part""")
def l04_variance_by_fitted(spark, sf):
    """Variance of the residuals by fifths of the fitted values."""
    rows = rows_of(spark, sf)
    return glm.variance_by_fitted(rows, glm.ols_checked(rows, ["a", "b"], "y").fit, "y").select("part", "n", r6("variance").alias("variance"))


@query()
def l05_poisson_total(spark, sf):
    return report(spark, glm.poisson(rows_of(spark, sf), ["a", "b"], "y").describe())


@query()
def l06_poisson_clustered(spark, sf):
    rows = rows_of(spark, sf)
    fit = glm.poisson(rows, ["a", "b"], "y")
    errors = glm.clustered_errors(rows, fit, "y", "league")
    return report(spark, fit.describe() | {f"se_{n}": e for n, e in zip(fit.names, errors, strict=True)})


@query()
def l07_negative_binomial(spark, sf):
    fit, alpha = glm.negative_binomial(rows_of(spark, sf), ["a"], "y")
    return report(spark, fit.describe() | {"alpha": alpha})


@query()
def l09_ridge_and_elastic_net(spark, sf):
    rows = rows_of(spark, sf)
    ridge, net = glm.poisson(rows, ["a", "b"], "y", ridge=0.1), glm.elastic_net(rows, ["a", "b"], "y", 0.01)
    return report(spark, {f"ridge_{k}": v for k, v in ridge.describe().items()} | {f"net_{k}": v for k, v in net.describe().items()})


@query()
def l14_platt(spark, sf):
    rows = rows_of(spark, sf).withColumn("over", (F.col("y") > 4).cast("int"))
    return report(spark, glm.logistic(rows, ["a"], "over").describe())


@query(BASE + """, m AS (SELECT *, avg(y) OVER () AS mu FROM x) SELECT count(*) AS n, round(avg(pow(y - mu, 2) / mu), 6) + 0.0 AS phi, round(sum((pow(y - mu, 2) - y) / mu * mu) / sum(mu * mu), 6) + 0.0 AS alpha FROM m""")
def l16_dispersion_tests(spark, sf):
    rows = rows_of(spark, sf)
    mean = rows.agg(F.avg("y").alias("mu"))
    return stats.dispersion(rows.join(F.broadcast(mean)), "mu", "y").select("n", r6("phi").alias("phi"), r6("alpha").alias("alpha"))


@query(BASE + """, c AS (SELECT CAST(home_goals AS INT) AS h, CAST(away_goals AS INT) AS a, count(*) AS n FROM x WHERE home_goals <= 1 AND away_goals <= 1 GROUP BY ALL) SELECT h, a, n FROM c""")
def l08_low_score_cells(spark, sf):
    """The four counts that the dependence parameter is estimated from."""
    low = rows_of(spark, sf).filter("home_goals <= 1 AND away_goals <= 1")
    return low.groupBy(F.col("home_goals").cast("int").alias("h"), F.col("away_goals").cast("int").alias("a")).agg(F.count("*").alias("n"))


def orders_of_customers(spark, sf):
    made = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("y"))
    return table(spark, sf, "customer").join(made, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("y", F.lit(0)).cast("double").alias("y"))


@query("""WITH c AS (SELECT c_custkey, count(o_orderkey)::INT AS y FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL), m AS (SELECT avg(y) AS mu FROM c),
h AS (SELECT y, count(*) AS n FROM c GROUP BY y), coarse AS (SELECT unnest(range(0, 64001)) / 1000.0::DOUBLE AS alpha),
l1 AS (SELECT alpha, sum(n * CASE WHEN alpha = 0 THEN y * ln(mu) - mu ELSE coalesce(list_sum(list_transform(range(0, y), lambda i: ln(1 + alpha * i))), 0) - ln(1 + alpha * mu) / alpha + y * (ln(mu) - ln(1 + alpha * mu)) END) AS l FROM coarse, h, m GROUP BY alpha),
best AS (SELECT arg_max(alpha, l) AS peak FROM l1), fine AS (SELECT DISTINCT greatest(0.0::DOUBLE, peak + k / 1000000.0::DOUBLE) AS alpha FROM best, range(-1000, 1001) s(k)),
l2 AS (SELECT alpha, sum(n * CASE WHEN alpha = 0 THEN y * ln(mu) - mu ELSE coalesce(list_sum(list_transform(range(0, y), lambda i: ln(1 + alpha * i))), 0) - ln(1 + alpha * mu) / alpha + y * (ln(mu) - ln(1 + alpha * mu)) END) AS l FROM fine, h, m GROUP BY alpha),
t AS (SELECT arg_max(alpha, l) AS alpha, 2 * (max(l) - (SELECT l FROM l1 WHERE alpha = 0)) AS lr FROM l2), u AS (SELECT alpha, greatest(lr, 0) AS lr FROM t)
SELECT round(alpha, 4) + 0.0 AS alpha, round(lr, 3) + 0.0 AS lr, round(CASE WHEN lr <= 0 THEN 0.5 WHEN lr > 600 THEN 0.0 ELSE 0.5 * (1 - list_sum(list_transform(range(0, 400), lambda i: exp((i + 0.5) * ln(lr / 2) - lr / 2 - lgamma(i + 1.5))))) END, 4) + 0.0 AS p_value FROM u""")
def l16_boundary_test(spark, sf):
    """Orders of a customer: likelihood ratio of the negative binomial against Poisson, at the boundary."""
    got = glm.overdispersion_test(orders_of_customers(spark, sf), [], "y")
    row = spark.createDataFrame([(got["alpha"], got["lr"])], "alpha double, lr double")
    p = F.when(F.col("lr") > 0, 0.5 * prob.chi_square_tail(F.col("lr"), 1)).otherwise(0.5)
    # p is computed before: beside an alias of the same name a lambda reads the rounded column
    return row.withColumn("p", p).select((F.round("alpha", 4) + 0.0).alias("alpha"), (F.round("lr", 3) + 0.0).alias("lr"), (F.round("p", 4) + 0.0).alias("p_value"))


def with_league_rates(spark, sf):
    """Contests with the mean goals of their league as rates."""
    rows = rows_of(spark, sf)
    means = rows.groupBy("league").agg(F.avg("home_goals").alias("home_rate"), F.avg("away_goals").alias("away_rate"))
    return rows.join(means, "league")


@query(BASE + """, m AS (SELECT league, avg(home_goals) AS lh, avg(away_goals) AS la FROM x GROUP BY ALL), b AS (SELECT -1 / max(greatest(lh, la)) AS low, least(1.0, 1 / max(lh * la)) AS high FROM m),
c AS (SELECT home_goals AS h, away_goals AS a, lh, la, count(*) AS n FROM x JOIN m USING (league) WHERE home_goals <= 1 AND away_goals <= 1 GROUP BY ALL),
g1 AS (SELECT low + (high - low) * unnest(range(1, 2000)) / 2000.0 AS r FROM b),
f1 AS (SELECT r, sum(n * ln(CASE WHEN h = 0 AND a = 0 THEN 1 - lh * la * r WHEN h = 0 THEN 1 + lh * r WHEN a = 0 THEN 1 + la * r ELSE 1 - r END)) AS f FROM g1, c GROUP BY r), b1 AS (SELECT arg_max(r, f) AS r FROM f1),
g2 AS (SELECT b1.r + unnest(range(-2000, 2001)) / 2000000.0 AS r FROM b1), f2 AS (SELECT r, sum(n * ln(CASE WHEN h = 0 AND a = 0 THEN 1 - lh * la * r WHEN h = 0 THEN 1 + lh * r WHEN a = 0 THEN 1 + la * r ELSE 1 - r END)) AS f FROM g2, c, b WHERE r > low AND r < high GROUP BY r)
SELECT round(arg_max(r, f), 4) + 0.0 AS rho FROM f2""")
def l08_rho(spark, sf):
    """The dependence of low scores, by a bracket of points summed together."""
    got = dependence.rho(with_league_rates(spark, sf))
    return spark.createDataFrame([(got,)], "rho double").select((F.round("rho", 4) + 0.0).alias("rho"))


@query()
def l13_score_model(spark, sf):
    """Attack and defence of every side, home advantage and dependence, weights halving in about two years."""
    played = contests_once(spark, sf).filter("status = 'played'")
    model = scores.fit(played, [0.001], tolerance=1e-2)
    gamma, rho = (round(float(v), 4) for v in model.shared[0])
    return model.strengths.select("side", F.round("attack0", 3).alias("attack"), F.round("defence0", 3).alias("defence"), F.lit(gamma).alias("gamma"), F.lit(rho).alias("rho"))


GRID = (0.0, 0.001, 0.002, 0.005, 0.01)


def contests_once(spark, sf):
    """What the score model reads of contests, written once: the search, the fit, the losses and the histories read it again."""
    return written(matches(spark, sf).select("match_id", "day", "home_id", "away_id", "home_goals", "away_goals", "status"), "contests")


@query()
def g03_decay_search(spark, sf):
    """Losses of five decays on the contests of the last seasons, all fitted in one go, and which is chosen."""
    played = contests_once(spark, sf).filter("status = 'played'")
    found, best, _ = scores.decay_search(played, GRID, 365 * 3, steps=6)
    return spark.createDataFrame([(xi, round(loss, 5), k == best) for k, (xi, loss) in enumerate(found)], "decay double, loss double, chosen boolean")


@query()
def g05_exact_scores(spark, sf):
    """Outcomes of the contests still to come, null with the reason where a side has played fewer than five before."""
    both = contests_once(spark, sf)
    played = both.filter("status = 'played'")
    model = scores.fit(played, [0.001], tolerance=1e-2)
    got = scores.exact_scores(model, both.filter("status <> 'played'").select("match_id", "home_id", "away_id", "day"), played)
    # the outcomes alone are asked for: the joint distributions, of 121 cells each, need not be rows
    o = prob.corrected_outcomes(F.col("home_rate"), F.col("away_rate"), F.lit(float(model.shared[0, -1])), 11)
    got = got.select("match_id", "home_games", "away_games", "refused", "home_rate", "away_rate").withColumn("o", F.when(F.col("refused").isNull(), o))
    return got.select("match_id", "home_games", "away_games", "refused", F.round("home_rate", 3).alias("home_rate"), *(F.round(f"o.{k}", 3).alias(k) for k in ("home", "draw", "away")))


#: 576 settings: step, home advantage, regression between seasons, margins, gap of the second level.
ELO_GRID = [dict(zip(("k", "home", "regress", "margin", "gap"), v, strict=True)) for v in itertools.product((10.0, 15.0, 20.0, 25.0, 30.0, 40.0), (40.0, 60.0, 80.0, 100.0), (0.0, 0.1, 0.2, 0.33), (False, True), (0.0, 100.0, 200.0))]


@query()
def l02_elo_tuning(spark, sf):
    m = matches(spark, sf).withColumn("level", F.when(F.col("home_id") % 2 == 0, 1).otherwise(2)).withColumn("played", F.col("status") == "played")
    m = m.select("match_id", "league", "season", "level", "day", "home_id", "away_id", "home_goals", "away_goals", "played")
    got = groups.tune_elo(m, "league", ELO_GRID, 1996)
    return got.select("setting", r6("loss").alias("loss"), "n")


@query()
def l10_boosted_poisson(spark, sf):
    rows = rows_of(spark, sf)
    model = trees.fit(rows, ["a", "b"], "y", trees=10, depth=3)
    return rows.select("match_id", r6(F.exp(model.score())).alias("mean"))


@query()
def l15_mixture_clusters(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    got, _ = groups.mixture(lines, ["q", "d", "t"])
    return got.groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def r05_calibration_slope(spark, sf):
    rows = rows_of(spark, sf).withColumn("over", (F.col("y") > 4).cast("int")).withColumn("z", prob.logit(0.3 + 0.2 * F.col("a")))
    return report(spark, glm.logistic(rows, ["z"], "over").describe())


def nested_models():
    def poisson(features):
        return lambda train, s: F.exp(glm.poisson(train, features, "y", ridge=s.get("ridge", 0.0)).linear())

    return {
        "mean": protocol.Model(lambda train, s: F.lit(train.agg(F.avg("y")).first()[0])),
        "a": protocol.Model(poisson(["a"])),
        "ab": protocol.Model(poisson(["a", "b"]), (("ridge", (0.0, 0.1)),)),
    }


@query()
def r16_r17_r19_walk_forward(spark, sf):
    got = protocol.walk_forward(rows_of(spark, sf), nested_models(), protocol.folds(1995, [1998, 1999]), "match_id", "y")
    return protocol.contribution(protocol.pooled(got), ["mean", "a", "ab"]).select("rank", "model", r6("loss").alias("loss"), r6("step").alias("step"), r6("gain").alias("gain"))


@query(BASE + """ SELECT match_id, CAST(sum(y) AS BIGINT) AS total, bool_or(y > 4) AS over FROM x GROUP BY ALL""")
def r18_outcomes(spark, sf):
    return rows_of(spark, sf).groupBy("match_id").agg(F.sum("y").alias("total"), F.bool_or(F.col("y") > 4).alias("over"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderdate < TIMESTAMP '1999-01-01') AS before_, count(*) FILTER (o_orderdate >= TIMESTAMP '1999-01-01') AS after_ FROM orders GROUP BY ALL""")
def r21_tracing_counts(spark, sf):
    limit = F.to_timestamp_ntz(F.lit("1999-01-01"))
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderdate") < limit).alias("before_"), F.count_if(F.col("o_orderdate") >= limit).alias("after_"))


@query(BASE + """, d AS (SELECT league, avg(y) AS m, var_samp(y) / count(*) AS v FROM x GROUP BY ALL) SELECT league, round(m, 6) + 0.0 AS effect, round(m - 1.96 * sqrt(v), 6) + 0.0 AS low, round(m + 1.96 * sqrt(v), 6) + 0.0 AS high FROM d""")
def r20_effect_intervals(spark, sf):
    d = rows_of(spark, sf).groupBy("league").agg(F.avg("y").alias("m"), (F.var_samp("y") / F.count("*")).alias("v"))
    half = 1.96 * F.sqrt("v")
    return d.select("league", r6("m").alias("effect"), r6(F.col("m") - half).alias("low"), r6(F.col("m") + half).alias("high"))


DUMMIES = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(BASE + f""", s AS (SELECT *, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS z FROM x)
SELECT match_id, round(z, 6) + 0.0 AS a, {", ".join(f"CASE WHEN league = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS league_{v}, round(CASE WHEN league = '{v}' THEN z ELSE 0 END, 6) + 0.0 AS a_x_league_{v}" for v in DUMMIES)} FROM s""")
def l12_design_matrix(spark, sf):
    """Standardised, one-hot and product columns; the constant one is left out."""
    rows = rows_of(spark, sf).withColumn("same", F.lit(1.0))
    made = Design(["a", "same"], ["league"], [("a", "league"), ("same", "league")]).fit(rows).transform(rows, ["match_id"])
    return made.select("match_id", r6("a").alias("a"), *(c if c.startswith("league") else r6(c).alias(c) for c in made.columns[2:]))


@query(BASE + """, g AS (SELECT a AS s, count(*) AS n, sum(CASE WHEN y > 4 THEN 1.0 ELSE 0.0 END) AS t FROM x GROUP BY a),
c AS (SELECT s, sum(n) OVER (ORDER BY s) AS cn, sum(t) OVER (ORDER BY s) AS ct, n, t FROM g),
m AS (SELECT p.s, j.s AS j, min((k.ct - j.ct + j.t) / (k.cn - j.cn + j.n)) AS low FROM c p JOIN c j ON j.s <= p.s JOIN c k ON k.s >= p.s GROUP BY ALL)
SELECT s AS score, round(max(low), 6) + 0.0 AS calibrated FROM m GROUP BY s""")
def l14_isotonic(spark, sf):
    """Isotonic calibration of the score a for totals above four."""
    rows = rows_of(spark, sf).withColumn("over", (F.col("y") > 4).cast("double"))
    return calibrate.isotonic(rows, "a", "over").groupBy(F.col("a").cast("double").alias("score")).agg(r6(F.max("calibrated")).alias("calibrated"))


@query()
def l14_one_against_rest(spark, sf):
    """Home, draw and away calibrated one by one and renormalised: counts and mean probabilities."""
    h, a = F.col("home_goals"), F.col("away_goals")
    got = calibrate.one_against_rest(rows_of(spark, sf), {"home": h > a, "draw": h == a, "away": h < a}, {"home": "a", "draw": "b", "away": "a"})
    return got.agg(F.count("*").alias("n"), *(r6(F.avg(f"p_{c}")).alias(f"p_{c}") for c in ("home", "draw", "away")), r6(F.max(F.abs(F.col("p_home") + F.col("p_draw") + F.col("p_away") - 1))).alias("off"))
