"""M-, R-, F-, D-, N-: distributions, scores and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import prob, text
from tidemark.operators import scoring
from tidemark.plans.base import EPOCH, MATCHES, matches, query, r6, table
from tidemark.sources.raw import parse_day

LAMBDAS = f"""WITH {MATCHES}, l AS (SELECT match_id, season, league, round, day, home_goals, away_goals, 0.8 + (match_id % 13) * 0.1 AS lh, 0.6 + (match_id % 7) * 0.15 AS la FROM matches),
k AS (SELECT unnest(range(0, 11)) AS k)"""


def lambdas(spark, sf):
    return matches(spark, sf).withColumn("lh", F.lit(0.8) + (F.col("match_id") % 13) * 0.1).withColumn("la", F.lit(0.6) + (F.col("match_id") % 7) * 0.15)


PMF = "exp(-(lh + la)) * pow(lh + la, k) / factorial(CAST(k AS INT))"


@query(LAMBDAS + f""" SELECT match_id, CAST(k AS INT) AS k, round(CASE WHEN k < 10 THEN {PMF} ELSE greatest(0.0, 1.0 - sum(CASE WHEN k < 10 THEN {PMF} ELSE 0 END) OVER (PARTITION BY match_id)) END, 6) + 0.0 AS p FROM l, k""")
def m01_m03_m05_poisson_total(spark, sf):
    pmf = prob.fold(prob.poisson(F.col("lh") + F.col("la"), 11), 11)
    return lambdas(spark, sf).select("match_id", F.posexplode(pmf).alias("k", "p")).select("match_id", "k", r6("p").alias("p"))


@query(LAMBDAS + """, nb AS (SELECT match_id, k, exp(lgamma(k + 2.5) - lgamma(2.5) - lgamma(k + 1.0)) * pow(2.5 / (2.5 + lh), 2.5) * pow(lh / (2.5 + lh), k) AS p FROM l, k) SELECT match_id, CAST(k AS INT) AS k, round(p, 6) + 0.0 AS p FROM nb""")
def m02_negative_binomial(spark, sf):
    return lambdas(spark, sf).select("match_id", F.posexplode(prob.negative_binomial(F.col("lh"), F.lit(0.4), 11)).alias("k", "p")).select("match_id", "k", r6("p").alias("p"))


@query(LAMBDAS + """, h AS (SELECT match_id, k, exp(-lh) * pow(lh, k) / factorial(CAST(k AS INT)) AS p FROM l, k), a AS (SELECT match_id, k, exp(-la) * pow(la, k) / factorial(CAST(k AS INT)) AS p FROM l, k)
SELECT h.match_id, CAST(h.k + a.k AS INT) AS k, round(sum(h.p * a.p), 6) + 0.0 AS p FROM h JOIN a USING (match_id) WHERE h.k + a.k <= 10 GROUP BY ALL""")
def m04_convolution(spark, sf):
    both = prob.convolve(prob.poisson(F.col("lh"), 11), prob.poisson(F.col("la"), 11), 11)
    return lambdas(spark, sf).select("match_id", F.posexplode(both).alias("k", "p")).select("match_id", "k", r6("p").alias("p"))


JOINT = LAMBDAS + """, j AS (SELECT match_id, home_goals, away_goals, x.k AS h, y.k AS a, exp(-lh) * pow(lh, x.k) / factorial(CAST(x.k AS INT)) * exp(-la) * pow(la, y.k) / factorial(CAST(y.k AS INT)) AS p0,
  CASE WHEN x.k = 0 AND y.k = 0 THEN 1 - lh * la * -0.05 WHEN x.k = 0 AND y.k = 1 THEN 1 + lh * -0.05 WHEN x.k = 1 AND y.k = 0 THEN 1 + la * -0.05 WHEN x.k = 1 AND y.k = 1 THEN 1 + 0.05 ELSE 1 END AS tau FROM l, k x, k y)"""


@query(JOINT + """, s AS (SELECT match_id, sum(p0) FILTER (h > a) AS w, sum(p0) FILTER (h = a) AS d, sum(p0) FILTER (h < a) AS l, sum(p0) AS t FROM j GROUP BY ALL) SELECT match_id, round(w / t, 6) + 0.0 AS home, round(d / t, 6) + 0.0 AS draw, round(l / t, 6) + 0.0 AS away FROM s""")
def m06_m08_joint_outcomes(spark, sf):
    o = prob.independent_outcomes(prob.poisson(F.col("lh"), 11), prob.poisson(F.col("la"), 11))
    return lambdas(spark, sf).withColumn("o", o).select("match_id", r6("o.home").alias("home"), r6("o.draw").alias("draw"), r6("o.away").alias("away"))


@query(JOINT + """, t AS (SELECT match_id, h + a AS k, sum(p0) AS p FROM j GROUP BY ALL), f AS (SELECT match_id, CASE WHEN k < 10 THEN k ELSE 10 END AS k, CASE WHEN k < 10 THEN p END AS p FROM t), g AS (SELECT match_id, k, sum(p) AS p FROM f GROUP BY ALL)
SELECT match_id, CAST(k AS INT) AS k, round(CASE WHEN k < 10 THEN p ELSE greatest(0.0, 1 - sum(p) OVER (PARTITION BY match_id)) END, 6) + 0.0 AS p FROM g""")
def m07_total_of_joint(spark, sf):
    total = prob.total_of_joint(prob.joint(prob.poisson(F.col("lh"), 11), prob.poisson(F.col("la"), 11)), 11)
    return lambdas(spark, sf).select("match_id", F.posexplode(total).alias("k", "p")).select("match_id", "k", r6("p").alias("p"))


@query()
def m09_discretised_normal(spark, sf):
    pmf = prob.discretised_normal(F.col("lh") + F.col("la"), F.lit(1.6), 11)
    return lambdas(spark, sf).select("match_id", F.posexplode(pmf).alias("k", "p")).select("match_id", "k", r6("p").alias("p"))


@query(JOINT + """, c AS (SELECT match_id, h, a, greatest(0.0, p0 * tau) AS p FROM j)
SELECT match_id, round(max(p) FILTER (h = 0 AND a = 0), 6) + 0.0 AS p00, round(max(p) FILTER (h = 0 AND a = 1), 6) + 0.0 AS p01, round(max(p) FILTER (h = 1 AND a = 0), 6) + 0.0 AS p10, round(max(p) FILTER (h = 1 AND a = 1), 6) + 0.0 AS p11,
  round(sum(p), 6) + 0.0 AS mass, round(sum(h * p), 6) + 0.0 AS home_mean, round(sum(a * p), 6) + 0.0 AS away_mean, round(sum(p * p), 6) + 0.0 AS squares FROM c GROUP BY match_id""")
def m10_corrected_joint(spark, sf):
    got = lambdas(spark, sf).select("match_id", prob.corrected_summary(F.col("lh"), F.col("la"), F.lit(-0.05), 11).alias("s")).select("match_id", "s.*")
    return got.select("match_id", *(r6(c).alias(c) for c in got.columns if c != "match_id"))


@query("""SELECT p_partkey, round(exp(-x / 2) * list_sum(list_transform(range(0, k), lambda i: pow(x / 2, i) / factorial(i::INT))), 9) + 0.0 AS tail FROM (SELECT p_partkey, p_size * 1.5::DOUBLE AS x, (p_partkey % 8 + 1) AS k FROM part)""")
def m20_chi_square_tail(spark, sf):
    """Tails of chi-square with 2 to 16 degrees of freedom."""
    tail = prob.chi_square_tail(F.col("p_size") * 1.5, 2 * (F.col("p_partkey") % 8 + 1))
    return table(spark, sf, "part").select("p_partkey", (F.round(tail, 9) + 0.0).alias("tail"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN o > 1 AND u > 1 THEN (1 / o) / (1 / o + 1 / u) END, 6) + 0.0 AS p_over FROM (SELECT *, 0.9 + l_discount * 10 AS o, 1 + l_tax * 10 AS u FROM lineitem)""")
def m11_l11_implied_probability(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(prob.implied(0.9 + F.col("l_discount") * 10, 1 + F.col("l_tax") * 10)).alias("p_over"))


@query(f"""WITH {MATCHES} SELECT match_id, round(1 / (1 + pow(10, -((home_id % 7) * 40.0 + 40 - (away_id % 7) * 40) / 400)), 6) + 0.0 AS expected, round(CASE WHEN abs(home_goals - away_goals) <= 1 THEN 1 WHEN abs(home_goals - away_goals) = 2 THEN 1.5 ELSE (11 + abs(home_goals - away_goals)) / 8.0 END, 6) + 0.0 AS factor FROM matches""")
def m12_elo_expectation(spark, sf):
    gap = (F.col("home_id") % 7) * 40.0 + 40 - (F.col("away_id") % 7) * 40
    n = F.abs(F.col("home_goals") - F.col("away_goals"))
    return matches(spark, sf).select("match_id", r6(1 / (1 + F.pow(F.lit(10.0), -gap / 400))).alias("expected"), r6(F.when(n <= 1, 1.0).when(n == 2, 1.5).otherwise((11 + n) / 8.0)).alias("factor"))


@query("""SELECT p_partkey, CAST(round(CASE WHEN p_size - 10 >= 0 THEN 0.30765 * 10 + 0.0 * (p_size - 10) END, 6) AS DOUBLE) + 0.0 AS proxy, round(ln(0.2 / (1 - 0.2)) + 0 * p_size, 6) + 0.0 AS logit, round(CASE WHEN p_size <= 17 THEN 1.0 WHEN p_size <= 26 THEN 1 - (p_size - 17) / 9.0 * 0.5 WHEN p_size <= 32 THEN 0.5 - (p_size - 26) / 6.0 * 0.5 ELSE 0.0 END, 6) + 0.0 AS age_curve, round(ln(greatest(p_size / 100.0, 0.05)), 6) + 0.0 AS floored, least(p_size, 14) AS capped FROM part""")
def m13_m14_m15_m18_scalars(spark, sf):
    s = F.col("p_size")
    curve = F.when(s <= 17, 1.0).when(s <= 26, 1 - (s - 17) / 9.0 * 0.5).when(s <= 32, 0.5 - (s - 26) / 6.0 * 0.5).otherwise(0.0)
    return table(spark, sf, "part").select(
        "p_partkey", r6(F.when(s - 10 >= 0, 0.30765 * 10 + 0.0 * (s - 10))).alias("proxy"), r6(prob.logit(F.lit(0.2)) + 0 * s).alias("logit"), r6(curve).alias("age_curve"), r6(F.ln(F.greatest(s / 100.0, F.lit(0.05)))).alias("floored"), F.least(s, F.lit(14)).alias("capped")
    )


@query("""SELECT p_partkey, round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.2 END, 0), 6) + 0.0 AS score FROM (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_size END AS a, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS b, CASE WHEN p_partkey % 5 > 0 THEN p_partkey END AS c FROM part)""")
def m17_renormalised_mean(spark, sf):
    items = {"a": (F.when(F.col("p_size") > 10, F.col("p_size")), 0.5), "b": (F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")), 0.3), "c": (F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey")), 0.2)}
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in items.values()), F.lit(0.0))
    under = sum((F.when(v.isNull(), 0.0).otherwise(w) for v, w in items.values()), F.lit(0.0))
    return table(spark, sf, "part").select("p_partkey", r6(top / F.nullif(under, F.lit(0.0))).alias("score"))


SCORED = LAMBDAS + f""", t AS (SELECT match_id, k, home_goals + away_goals AS y, league, season, round, day, CASE WHEN k < 10 THEN {PMF} ELSE greatest(0.0, 1.0 - sum(CASE WHEN k < 10 THEN {PMF} ELSE 0 END) OVER (PARTITION BY match_id)) END AS p FROM l, k),
c AS (SELECT *, sum(p) OVER (PARTITION BY match_id ORDER BY k) AS c FROM t)"""


def scored(spark, sf):
    return lambdas(spark, sf).withColumn("pmf", prob.fold(prob.poisson(F.col("lh") + F.col("la"), 11), 11)).withColumn("y", F.col("home_goals") + F.col("away_goals"))


@query(SCORED + """ SELECT match_id, round(max(-ln(p)) FILTER (k = least(y, 10)), 6) + 0.0 AS log_loss, round(sum(pow(c - CASE WHEN k >= least(y, 7) THEN 1.0 ELSE 0.0 END, 2)) FILTER (k < 7) / 7, 6) + 0.0 AS rps, round(pow(sum(p) FILTER (k > 2) - CASE WHEN any_value(y) > 2 THEN 1 ELSE 0 END, 2), 6) + 0.0 AS brier, round(sum(p * k), 6) + 0.0 AS mean FROM c GROUP BY match_id""")
def r01_r02_r03_r04_scores(spark, sf):
    over = prob.tail(F.col("pmf"), 2.5)
    return scored(spark, sf).select("match_id", r6(scoring.log_loss(F.col("pmf"), F.col("y"))).alias("log_loss"), r6(scoring.ranked_score(F.col("pmf"), F.col("y"))).alias("rps"), r6(scoring.brier(over, F.col("y") > 2)).alias("brier"), r6(prob.mean_of(F.col("pmf"))).alias("mean"))


@query(SCORED + """, q AS (SELECT match_id, any_value(y) AS y, count(*) FILTER (c < 0.1 - 1e-12) AS lo, count(*) FILTER (c < 0.9 - 1e-12) AS hi FROM c GROUP BY ALL)
SELECT q.match_id, CAST(lo AS INT) AS low, CAST(hi AS INT) AS high, round(sum(p), 6) + 0.0 AS announced, any_value(q.y) BETWEEN any_value(lo) AND any_value(hi) AS covered FROM q JOIN t ON q.match_id = t.match_id AND t.k BETWEEN lo AND hi GROUP BY q.match_id, lo, hi""")
def m19_r07_intervals(spark, sf):
    got = scored(spark, sf).withColumn("low", prob.quantile(F.col("pmf"), 0.1)).withColumn("high", prob.quantile(F.col("pmf"), 0.9))
    return got.select("match_id", "low", "high", r6(prob.interval_mass(F.col("pmf"), F.col("low"), F.col("high"))).alias("announced"), F.col("y").between(F.col("low"), F.col("high")).alias("covered"))


@query(SCORED + """ SELECT match_id, round(coalesce(sum(p) FILTER (k < least(y, 10)), 0) + (match_id % 1000) / 1000.0 * max(p) FILTER (k = least(y, 10)), 6) + 0.0 AS pit FROM t GROUP BY match_id""")
def r06_randomised_pit(spark, sf):
    return scored(spark, sf).select("match_id", r6(scoring.pit(F.col("pmf"), F.col("y"), (F.col("match_id") % 1000) / 1000.0)).alias("pit"))


@query(JOINT + """, o AS (SELECT match_id, home_goals, away_goals, sum(p0) FILTER (h > a) / sum(p0) AS w, sum(p0) FILTER (h = a) / sum(p0) AS d, sum(p0) FILTER (h < a) / sum(p0) AS l, max(-ln(p0)) FILTER (h = home_goals AND a = away_goals) AS e FROM j GROUP BY ALL)
SELECT match_id, round(e, 6) + 0.0 AS exact_loss, round(pow(w - CAST(home_goals > away_goals AS INT), 2) + pow(d - CAST(home_goals = away_goals AS INT), 2) + pow(l - CAST(home_goals < away_goals AS INT), 2), 6) + 0.0 AS brier_1x2 FROM o""")
def r08_exact_score_loss(spark, sf):
    j = prob.joint(prob.poisson(F.col("lh"), 11), prob.poisson(F.col("la"), 11))
    got = lambdas(spark, sf).withColumn("j", j).withColumn("o", prob.outcomes(F.col("j")))
    h, a = F.col("home_goals"), F.col("away_goals")
    b = scoring.brier(F.col("o.home"), h > a) + scoring.brier(F.col("o.draw"), h == a) + scoring.brier(F.col("o.away"), h < a)
    return got.select("match_id", r6(-F.ln(scoring.checked(F.get(F.get("j", h), a), "score"))).alias("exact_loss"), r6(b).alias("brier_1x2"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'negative' WHEN p_size % 4 = 1 THEN 'sum' END AS reason FROM part""")
def r09_pmf_validation(spark, sf):
    s = F.col("p_size") % 4
    pmf = F.when(s == 0, F.array(F.lit(-0.1), F.lit(1.1))).when(s == 1, F.array(F.lit(0.5), F.lit(0.6))).otherwise(F.array(F.lit(0.5), F.lit(0.5)))
    return table(spark, sf, "part").select("p_partkey", scoring.bad_pmf(pmf).alias("reason"))


LOSSES = LAMBDAS + """, d AS (SELECT match_id, league, league || ':' || season || ':' || round AS block, pow(home_goals - lh, 2) - pow(home_goals - 1.4, 2) AS diff FROM l)"""


def losses(spark, sf):
    h = F.col("home_goals")
    return lambdas(spark, sf).select("match_id", "league", "season", F.concat_ws(":", "league", "season", "round").alias("block"), (F.pow(h - F.col("lh"), 2) - F.pow(h - 1.4, 2)).alias("diff"))


@query(LOSSES + """, b AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY league) AS nb FROM (SELECT league, block, sum(diff) AS s, count(*) AS n FROM d GROUP BY league, block)),
r AS (SELECT unnest(range(0, 200)) AS r), f AS (SELECT b.league, r.r, nb, (r.r * 1103515245 + i * 12345 + 67) % 2147483648 AS g FROM b, r),
p AS (SELECT league, r, CAST(floor(((g * 1103515245 + 12345) % 2147483648) / 65536) AS BIGINT) % nb AS i FROM f)
SELECT p.r AS replicate, round(sum(b.s) / sum(b.n), 6) + 0.0 AS mean FROM p JOIN b ON b.league = p.league AND b.i = p.i GROUP BY ALL""")
def r10_block_bootstrap(spark, sf):
    return scoring.bootstrap_means(losses(spark, sf), "league", "block", "diff", 200).select("replicate", r6("mean").alias("mean"))


@query(LOSSES + """, b AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY league) AS nb FROM (SELECT league, block, sum(diff) AS s, count(*) AS n FROM d GROUP BY league, block)),
r AS (SELECT unnest(range(0, 10000)) AS r), f AS (SELECT b.league, r.r, nb, (r.r * 1103515245 + i * 12345 + 67) % 2147483648 AS g FROM b, r),
p AS (SELECT league, r, CAST(floor(((g * 1103515245 + 12345) % 2147483648) / 65536) AS BIGINT) % nb AS i FROM f),
m AS (SELECT p.r, sum(b.s) / sum(b.n) AS mean FROM p JOIN b ON b.league = p.league AND b.i = p.i GROUP BY ALL)
SELECT (SELECT round(avg(diff), 6) + 0.0 FROM d) AS mean, (SELECT count(*) FROM d) AS n, round(quantile_cont(m.mean, 0.025), 6) + 0.0 AS low, round(quantile_cont(m.mean, 0.975), 6) + 0.0 AS high FROM m""")
def r10_bootstrap_interval(spark, sf):
    return scoring.bootstrap_interval(losses(spark, sf), "league", "block", "diff").select(*(r6(c).alias(c) if c != "n" else c for c in ("mean", "n", "low", "high")))


@query(LOSSES + """, x AS (SELECT d.league, block, d.diff AS y, (season - 1995) + lh / 10 AS x FROM d JOIN l USING (match_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY league) AS nb FROM (SELECT league, block, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM x GROUP BY league, block)),
r AS (SELECT unnest(range(0, 10000)) AS r), f AS (SELECT b.league, r.r, nb, (r.r * 1103515245 + i * 12345 + 67) % 2147483648 AS g FROM b, r),
p AS (SELECT league, r, CAST(floor(((g * 1103515245 + 12345) % 2147483648) / 65536) AS BIGINT) % nb AS i FROM f),
t AS (SELECT p.r, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxy) AS sxy, sum(sxx) AS sxx FROM p JOIN b ON b.league = p.league AND b.i = p.i GROUP BY p.r), s AS (SELECT (sxy - sx * sy / n) / (sxx - sx * sx / n) AS k FROM t)
SELECT (SELECT count(*) FROM x) AS n, (SELECT count(*) FROM b) AS blocks, (SELECT round(regr_slope(y, x), 6) + 0.0 FROM x) AS slope, round(quantile_cont(k, 0.025), 6) + 0.0 AS low, round(quantile_cont(k, 0.975), 6) + 0.0 AS high FROM s""")
def r15_slope_interval(spark, sf):
    """Trend of the loss difference, with an interval from 10,000 resamples of blocks."""
    rows = losses(spark, sf).join(lambdas(spark, sf).select("match_id", "lh"), "match_id").withColumn("x", (F.col("season") - 1995) + F.col("lh") / 10)
    return scoring.slope_interval(rows, "league", "block", "x", "diff").select("n", "blocks", *(r6(c).alias(c) for c in ("slope", "low", "high")))


@query(LOSSES + """, b AS (SELECT block, sum(diff) AS s, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT sum(s) / sum(n) AS m, sum(n) AS n FROM b)
SELECT CAST(t.n AS BIGINT) AS n, round(m, 6) + 0.0 AS mean, round(sqrt(sum(pow(b.s - b.n * m, 2)) / pow(t.n, 2)), 6) + 0.0 AS se, round(m / sqrt(sum(pow(b.s - b.n * m, 2)) / pow(t.n, 2)), 4) + 0.0 AS dm FROM b, t GROUP BY t.n, t.m""")
def r11_diebold_mariano(spark, sf):
    return scoring.diebold_mariano(losses(spark, sf), "block", "diff").select("n", r6("mean").alias("mean"), r6("se").alias("se"), (F.round("dm", 4) + 0.0).alias("dm"))


@query(LAMBDAS + """ SELECT season, count(*) AS n, round(avg(abs(home_goals - 1.4) - abs(home_goals - lh)), 6) + 0.0 AS gain, round(avg(CASE WHEN abs(home_goals - 1.4) - abs(home_goals - lh) > 1e-9 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_better FROM l GROUP BY ROLLUP (season)""")
def r12_paired_comparison(spark, sf):
    rows = lambdas(spark, sf).select("season", F.abs(F.col("home_goals") - 1.4).alias("a"), F.abs(F.col("home_goals") - F.col("lh")).alias("b"))
    return scoring.compare(rows, "season", "a", "b").select("season", "n", r6("gain").alias("gain"), r6("share_better").alias("share_better"))


@query(LAMBDAS + """, f AS (SELECT season, avg(g) AS gain, sum(g) AS s, count(*) AS n FROM (SELECT season, abs(home_goals - 1.4) - abs(home_goals - lh) AS g FROM l) GROUP BY season),
t AS (SELECT sum(s) / sum(n) AS mean, sum(n) AS n FROM f), u AS (SELECT count(*) AS folds, count(*) FILTER (gain > 0) AS positive, t.mean, t.mean - 1.959963984540054 * sqrt(sum(pow(s - f.n * t.mean, 2))) / t.n AS low FROM f, t GROUP BY t.mean, t.n)
SELECT folds, positive, round(mean, 6) + 0.0 AS mean, round(low, 6) + 0.0 AS low, CASE WHEN folds < 3 THEN 'not applicable' WHEN low > 0 AND mean > 0 AND positive >= 3 THEN 'replace' ELSE 'keep' END AS decision FROM u""")
def r13_decision(spark, sf):
    rows = lambdas(spark, sf).select("season", F.abs(F.col("home_goals") - 1.4).alias("a"), F.abs(F.col("home_goals") - F.col("lh")).alias("b"))
    return scoring.replacement(rows, "season", "a", "b").withColumns({c: r6(c) for c in ("mean", "low")})


@query("""WITH t AS (SELECT n_nationkey AS k, ((n_nationkey * 37) % 100) / 1000.0 AS p FROM nation), r AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1) * p) AS a FROM t)
SELECT k, round(max(a) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS p_holm FROM r""")
def r14_holm(spark, sf):
    t = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), (((F.col("n_nationkey") * 37) % 100) / 1000.0).alias("p"))
    return scoring.holm(t, "p", ["k"]).select("k", r6("p_holm").alias("p_holm"))


@query("""SELECT DISTINCT n_name, lower(regexp_replace(n_name, '[^A-Za-z0-9]+', ' ', 'g')) AS norm, CAST(regexp_extract(n_name, '(\\d+)\\s*$', 1) AS INT) AS number FROM nation""")
def f01_f09_names_and_numbers(spark, sf):
    return table(spark, sf, "nation").select("n_name", text.normalize_name(F.col("n_name")).alias("norm"), text.trailing_number(F.col("n_name")).alias("number")).distinct()


@query("""SELECT p_partkey, TRY_CAST(v AS DOUBLE) AS x FROM (SELECT p_partkey, regexp_replace(trim(CASE WHEN p_partkey % 3 = 0 THEN p_size || '%' WHEN p_partkey % 3 = 1 THEN ' ' || p_size || '.5 ' ELSE 'n/a' END), '%$', '') AS v FROM part)""")
def f10_loose_numbers(spark, sf):
    v = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit("%"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.col("p_size"), F.lit(".5 "))).otherwise("n/a")
    return table(spark, sf, "part").select("p_partkey", text.loose_number(v).alias("x"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS INT) AS season, c_name || ':' || isoyear(o_orderdate) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS block, sha256(o_orderpriority) AS sha, md5(o_orderstatus) AS md5 FROM orders JOIN customer ON o_custkey = c_custkey""")
def f11_f12_d06_d07_labels(spark, sf):
    season = F.year("o_orderdate") - (F.month("o_orderdate") < 7).cast("int")
    week = F.concat(F.col("c_name"), F.lit(":"), F.extract(F.lit("YEAROFWEEK"), "o_orderdate"), F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", season.alias("season"), week.alias("block"), F.sha2("o_orderpriority", 256).alias("sha"), F.md5("o_orderstatus").alias("md5"))


@query("""SELECT event_id, CAST(ts AS DATE) AS day, CAST(datediff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS INT) AS number, coalesce(CASE WHEN event_type = 'click' THEN ts END, CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS deadline FROM events""")
def d01_d02_d09_days(spark, sf):
    midnight = F.to_date("ts").cast("timestamp_ntz")
    return table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"), F.datediff(F.to_date("ts"), F.to_date(F.lit("2000-01-01"))).alias("number"), F.coalesce(F.when(F.col("event_type") == "click", F.col("ts")), midnight).alias("deadline"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def d03_two_date_formats(spark, sf):
    d = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.date_format(d, "dd/MM/"), F.date_format(d, "yyyy"))).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", parse_day(raw).alias("day"))


@query(f"""SELECT o_orderkey, round(datediff('day', DATE '{EPOCH}', CAST(o_orderdate AS DATE)) / 365.25, 6) + 0.0 AS age, datediff('day', DATE '{EPOCH}', CAST(o_orderdate AS DATE)) < 2000 - 1 AS stale FROM orders""")
def d08_d10_age_and_staleness(spark, sf):
    days = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit(EPOCH)))
    return table(spark, sf, "orders").select("o_orderkey", r6(days / 365.25).alias("age"), (days < 2000 - 1).alias("stale"))


@query(LAMBDAS + f""" SELECT match_id, CASE WHEN k < 10 THEN CAST(k AS VARCHAR) ELSE '10+' END AS label, round({PMF}, 6) + 0.0 AS p FROM l, k WHERE k < 10""")
def n04_label_map(spark, sf):
    rows = scored(spark, sf).select("match_id", F.explode(prob.labelled(F.col("pmf"), 10)).alias("label", "p"))
    return rows.filter("label <> '10+'").select("match_id", "label", r6("p").alias("p"))


@query("""SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events""")
def n01_n02_n03_exploded_map(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode_outer(F.from_json("props", "map<string,string>")).alias("key", "value"))
