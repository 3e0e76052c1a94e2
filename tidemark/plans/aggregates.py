"""A-, G-: aggregations, calibration tables, exploratory statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import stats
from tidemark.plans.base import HISTORY, MATCHES, SIDES, history, matches, query, r6, sides, table


@query(f"""WITH {SIDES} SELECT league, season, count(*) AS rows, count(DISTINCT match_id) AS matches, CAST(min(day) AS INT) AS first_day, CAST(max(day) AS INT) AS last_day FROM sides GROUP BY GROUPING SETS ((league, season), (season))""")
def a01_counts_grouping_sets(spark, sf):
    sides(spark, sf).createOrReplaceTempView("tm_sides")
    return spark.sql("SELECT league, season, count(*) AS rows, count(DISTINCT match_id) AS matches, min(day) AS first_day, max(day) AS last_day FROM tm_sides GROUP BY GROUPING SETS ((league, season), (season))")


@query(f"""WITH {SIDES} SELECT league, is_home, round(avg(goals_for), 6) + 0.0 AS rate, count(*) AS n FROM sides WHERE status = 'played' AND season > (SELECT max(season) FROM sides) - 3 GROUP BY ALL""")
def a02_side_rates_last_seasons(spark, sf):
    rows = sides(spark, sf)
    last = rows.agg(F.max("season").alias("m"))
    return rows.join(F.broadcast(last), F.col("season") > F.col("m") - 3).filter("status = 'played'").groupBy("league", "is_home").agg(r6(F.avg("goals_for")).alias("rate"), F.count("*").alias("n"))


@query(f"""WITH {MATCHES} SELECT round(avg(home_goals + away_goals), 6) + 0.0 AS mean_total, count(*) AS n FROM matches WHERE status = 'played'""")
def a03_l03_global_mean(spark, sf):
    return matches(spark, sf).filter("status = 'played'").agg(r6(F.avg(F.col("home_goals") + F.col("away_goals"))).alias("mean_total"), F.count("*").alias("n"))


@query("""SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, round(sum(l_quantity), 6) + 0.0 AS total, count(*) AS n FROM lineitem GROUP BY ALL""")
def a04_daily_sums(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("day")).agg(r6(F.sum("l_quantity")).alias("total"), F.count("*").alias("n"))


@query("""SELECT l_partkey, round(sum(CASE WHEN w IS NOT NULL THEN l_quantity * w END) / nullif(sum(w), 0), 6) + 0.0 AS weighted FROM (SELECT l_partkey, l_quantity, CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS w FROM lineitem) GROUP BY ALL""")
def a05_weighted_mean(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("w", F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")))
    return lines.groupBy("l_partkey").agg(r6(stats.weighted_mean(F.col("l_quantity"), F.col("w"))).alias("weighted"))


@query("""SELECT l_partkey, round(90 * sum(l_discount * 100) / nullif(sum(l_quantity), 0), 6) + 0.0 AS per90, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) / nullif(sum(l_quantity), 0), 6) + 0.0 AS ratio, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS coverage, count(*) FILTER (l_linenumber = 1) AS firsts, bool_and(l_quantity > 1) AS all_large FROM lineitem GROUP BY ALL HAVING count(*) >= 15""")
def a06_a07_g07_per90_vectors(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        r6(90 * stats.safe_ratio(F.sum(F.col("l_discount") * 100), F.sum(q))).alias("per90"), r6(stats.safe_ratio(F.sum(F.when(F.col("l_returnflag") == "R", q)), F.sum(q))).alias("ratio"),
        r6(F.avg((F.col("l_tax") > 0.04).cast("double"))).alias("coverage"), F.count_if(F.col("l_linenumber") == 1).alias("firsts"), F.bool_and(q > 1).alias("all_large"), F.count("*").alias("n"),
    ).filter("n >= 15").drop("n")


@query("""SELECT status, round(avg(lines), 6) + 0.0 AS mean_lines, max(lines) AS max_lines, count(*) AS orders FROM (SELECT o_orderstatus AS status, o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY ALL""")
def a08_two_levels(spark, sf):
    per_order = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    joined = table(spark, sf, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_orderstatus").alias("status")).agg(r6(F.avg("lines")).alias("mean_lines"), F.max("lines").alias("max_lines"), F.count("*").alias("orders"))


@query("""SELECT p_type, arg_max(p_brand, (n, p_brand)) AS mode FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) GROUP BY ALL""")
def a10_mode(spark, sf):
    n = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    return n.groupBy("p_type").agg(F.max_by("p_brand", F.struct("n", "p_brand")).alias("mode"))


@query("""SELECT l_suppkey, arg_max(l_returnflag, (w, l_returnflag)) AS modal FROM (SELECT l_suppkey, l_returnflag, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def a12_modal_bucket_by_weight(spark, sf):
    w = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("w"))
    return w.groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("w", "l_returnflag")).alias("modal"))


@query("""WITH e AS (SELECT l_partkey, count(*) AS n, sum(l_quantity) AS w, sum(l_quantity * l_discount) AS wx, sum(l_quantity * l_discount * l_discount) AS wxx FROM lineitem GROUP BY ALL),
t AS (SELECT sum(n) AS nr, count(*) AS ne, sum(wxx - wx * wx / w) AS ssw, sum(w) AS w, sum(w * w) AS w2, sum(wx) AS wx, sum(wx * wx / w) AS br FROM e),
s AS (SELECT *, ssw / (nr - ne) AS sigma2 FROM t), u AS (SELECT *, greatest((br - wx * wx / w - (ne - 1) * sigma2) / (w - w2 / w), 0.0) AS tau2 FROM s)
SELECT CAST(nr AS BIGINT) AS rows, ne AS entities, round(sigma2, 6) + 0.0 AS sigma2, round(tau2, 6) + 0.0 AS tau2 FROM u""")
def a13_l17_variance_components(spark, sf):
    got = stats.variance_components(table(spark, sf, "lineitem"), "l_partkey", "l_discount", "l_quantity")
    return got.select("rows", "entities", r6("sigma2").alias("sigma2"), r6("tau2").alias("tau2"))


@query("""WITH x AS (SELECT o_orderpriority AS g, o_totalprice / 1000 AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders)
SELECT g, count(*) AS n, round(corr(a, b), 6) + 0.0 AS corr, round(avg(abs(a - b)), 6) + 0.0 AS mae, round(avg(a - b), 6) + 0.0 AS bias, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS same FROM x GROUP BY ROLLUP (g)""")
def a14_a15_source_agreement(spark, sf):
    x = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 1000).alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return stats.agreement(x, "a", "b", ["g"]).select("g", "n", *(r6(c).alias(c) for c in ("corr", "mae", "bias", "same")))


@query("""SELECT l_linestatus, round(count(*) FILTER (l_returnflag = 'A') * 1.0 / count(*), 6) + 0.0 AS a, round(count(*) FILTER (l_returnflag = 'N') * 1.0 / count(*), 6) + 0.0 AS n, round(count(*) FILTER (l_returnflag = 'R') * 1.0 / count(*), 6) + 0.0 AS r FROM lineitem GROUP BY ALL""")
def a16_normalised_pivot(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count()
    total = F.coalesce("A", F.lit(0)) + F.coalesce("N", F.lit(0)) + F.coalesce("R", F.lit(0))
    return wide.select("l_linestatus", *(r6(F.coalesce(c, F.lit(0)) / total).alias(c.lower()) for c in ("A", "N", "R")))


@query("""SELECT p_type, "column", round(null_share, 6) + 0.0 AS null_share FROM (SELECT p_type, avg(CASE WHEN p_size < 10 THEN 1.0 ELSE 0.0 END) AS size, avg(CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END) AS price FROM part GROUP BY ALL) UNPIVOT (null_share FOR "column" IN (size, price))""")
def a17_g17_null_shares(spark, sf):
    part = table(spark, sf, "part").select("p_type", F.when(F.col("p_size") >= 10, F.col("p_size")).alias("size"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("price"))
    return stats.null_shares(part, ["size", "price"], ["p_type"]).select("p_type", "column", r6("null_share").alias("null_share"))


CALIBRATION = """WITH x AS (SELECT l_orderkey * 100 + l_linenumber * 10 AS id, l_partkey, l_suppkey, l_discount * 9 + 0.05 AS p, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS o FROM lineitem),
r AS (SELECT p, o, CAST(floor((row_number() OVER (ORDER BY p, tie) - 1) * 10 / count(*) OVER ()) AS INT) AS bin FROM (SELECT p, o, hash_ AS tie FROM (SELECT *, id * 100000 + l_partkey * 7 + l_suppkey AS hash_ FROM x)))
SELECT bin, count(*) AS n, round(avg(p), 6) + 0.0 AS mean_p FROM r GROUP BY ALL"""


@query(CALIBRATION)
def a19_calibration_deciles(spark, sf):
    x = table(spark, sf, "lineitem").select((F.col("l_discount") * 9 + 0.05).alias("p"), (F.col("l_returnflag") == "R").alias("o"), ((F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10) * 100000 + F.col("l_partkey") * 7 + F.col("l_suppkey")).alias("tie"))
    return stats.calibration(x, "p", "o", "tie").select("bin", "n", r6("mean_p").alias("mean_p"))


@query("""SELECT CAST(CASE WHEN l_discount BETWEEN 0 AND 0.1 THEN greatest(ceil(l_discount * 5 / 0.1) - 1, 0) END AS INT) AS bin, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS observed FROM (SELECT round(l_discount, 2) AS l_discount, l_returnflag FROM lineitem) GROUP BY ALL""")
def a20_equal_width_bins(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("d", F.round("l_discount", 2))
    return lines.groupBy(stats.equal_width_bin(F.col("d"), 0.0, 0.1, 5).alias("bin")).agg(F.count("*").alias("n"), r6(F.avg((F.col("l_returnflag") == "A").cast("double"))).alias("observed"))


@query(f"""WITH {MATCHES}, x AS (SELECT match_id, price AS e, home_goals + away_goals AS y FROM matches), b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY e, match_id) - 1) * 5 / count(*) OVER ()) AS INT) AS bin FROM x)
SELECT bin, count(*) AS n, CAST(sum(y) AS BIGINT) AS observed, round(sum(e) / 100000, 4) + 0.0 AS expected FROM b GROUP BY ALL""")
def a21_observed_expected(spark, sf):
    x = matches(spark, sf).select("match_id", F.col("price").alias("e"), (F.col("home_goals") + F.col("away_goals")).alias("y"))
    return stats.ordered_bins(x, ["e", "match_id"], 5).groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("observed"), (F.round(F.sum("e") / 100000, 4) + 0.0).alias("expected"))


@query(f"""WITH {MATCHES}, x AS (SELECT league, league || ':' || season || ':' || round AS block, CAST(home_goals AS DOUBLE) AS x, CAST(away_goals AS DOUBLE) AS y FROM matches) SELECT league, block, count(*) AS n, round(sum(x), 6) + 0.0 AS sx, round(sum(y), 6) + 0.0 AS sy, round(sum(x * y), 6) + 0.0 AS sxy, round(sum(x * x), 6) + 0.0 AS sxx, round(regr_slope(y, x), 6) + 0.0 AS slope FROM x GROUP BY ALL""")
def a22_a23_block_moments(spark, sf):
    x, y = F.col("home_goals").cast("double"), F.col("away_goals").cast("double")
    block = F.concat_ws(":", "league", "season", "round")
    return matches(spark, sf).groupBy("league", block.alias("block")).agg(F.count("*").alias("n"), r6(F.sum(x)).alias("sx"), r6(F.sum(y)).alias("sy"), r6(F.sum(x * y)).alias("sxy"), r6(F.sum(x * x)).alias("sxx"), r6(F.regr_slope(y, x)).alias("slope"))


@query(f"""WITH {MATCHES} SELECT match_id, round(home_goals - avg(home_goals) OVER (PARTITION BY league, season), 6) + 0.0 AS centred FROM matches""")
def a24_demean(spark, sf):
    return stats.demean(matches(spark, sf), "home_goals", ["league", "season"], "c").select("match_id", r6("c").alias("centred"))


@query(f"""WITH {MATCHES} SELECT league, season, CAST(grouping(league) AS INT) AS all_leagues, count(*) AS n, round(avg(home_goals + away_goals), 6) + 0.0 AS mean_total, round(avg(CASE WHEN home_goals + away_goals > 2 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS over FROM matches GROUP BY CUBE (league, season)""")
def a25_cube_summary(spark, sf):
    total = F.col("home_goals") + F.col("away_goals")
    return matches(spark, sf).cube("league", "season").agg(F.grouping("league").cast("int").alias("all_leagues"), F.count("*").alias("n"), r6(F.avg(total)).alias("mean_total"), r6(F.avg((total > 2).cast("double"))).alias("over"))


@query("""SELECT event_type, count(*) FILTER (value > 50) AS ok, count(*) AS total, round(count(*) FILTER (value > 50) * 1.0 / count(*), 6) + 0.0 AS rate FROM events GROUP BY ROLLUP (event_type)""")
def a26_a27_rates(spark, sf):
    ok = F.count_if(F.col("value") > 50)
    return table(spark, sf, "events").rollup("event_type").agg(ok.alias("ok"), F.count("*").alias("total"), r6(ok / F.count("*")).alias("rate"))


@query("""SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS season, count(*) AS starts, round(count(*) FILTER (o_orderstatus = 'P') * 1.0 / count(*), 6) + 0.0 AS excluded FROM orders GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (o_orderstatus = 'P') * 2 > count(*)""")
def a28_over_exclusion(spark, sf):
    p = F.count_if(F.col("o_orderstatus") == "P")
    got = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("season")).agg(F.count("*").alias("starts"), p.alias("p"))
    return got.filter("starts >= 3 AND p * 2 > starts").select("o_custkey", "season", "starts", r6(F.col("p") / F.col("starts")).alias("excluded"))


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.1), 6) + 0.0 AS p10, round(median(l_extendedprice), 6) + 0.0 AS median FROM lineitem GROUP BY ALL""")
def a29_percentiles(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.percentile("l_quantity", 0.1)).alias("p10"), r6(F.median("l_extendedprice")).alias("median"))


@query("""WITH x AS (SELECT p_partkey, p_brand, CASE WHEN p_size > 5 THEN p_size END AS v FROM part), m AS (SELECT p_brand, median(v) AS m FROM x GROUP BY ALL), y AS (SELECT p_partkey, p_brand, coalesce(v, m) AS v FROM x JOIN m USING (p_brand))
SELECT p_partkey, round((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 6) + 0.0 AS z FROM y WINDOW w AS (PARTITION BY p_brand)""")
def a30_a31_impute_standardise(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 5, F.col("p_size")).alias("v"))
    m = x.groupBy("p_brand").agg(F.median("v").alias("m"))
    y = x.join(m, "p_brand").withColumn("v", F.coalesce(F.col("v").cast("double"), "m"))
    w = W.partitionBy("p_brand")
    return y.select("p_partkey", r6((F.col("v") - F.avg("v").over(w)) / F.nullif(F.stddev_pop("v").over(w), F.lit(0.0))).alias("z"))


@query("""SELECT CAST(least(floor(l_discount * 100 / 11.0 * 10), 9) AS INT) AS bin, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) + 0.0 AS share FROM (SELECT round(l_discount, 2) AS l_discount FROM lineitem) GROUP BY ALL""")
def a32_pit_histogram(spark, sf):
    bins = table(spark, sf, "lineitem").groupBy(F.least(F.floor(F.round("l_discount", 2) * 100 / 11.0 * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # ten rows
    return bins.select("bin", r6(F.col("n") / F.sum("n").over(everyone)).alias("share"))


@query(f"""WITH {MATCHES} SELECT h, a, round(avg(CASE WHEN home_goals = h AND away_goals = a THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS observed FROM matches, (VALUES (0), (1)) x(h), (VALUES (0), (1)) y(a) GROUP BY ALL""")
def a34_low_scores(spark, sf):
    cells = [F.avg(((F.col("home_goals") == h) & (F.col("away_goals") == a)).cast("double")).alias(f"c{h}{a}") for h in (0, 1) for a in (0, 1)]
    one = matches(spark, sf).agg(*cells)
    return one.select(F.inline(F.array(*(F.struct(F.lit(h).alias("h"), F.lit(a).alias("a"), r6(f"c{h}{a}").alias("observed")) for h in (0, 1) for a in (0, 1)))))


@query(f"""WITH {MATCHES} SELECT league, count(*) AS n, round(var_samp(home_goals) / avg(home_goals), 6) + 0.0 AS dispersion, round(avg(CASE WHEN home_goals = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS empirical0, round(exp(-avg(home_goals)), 6) + 0.0 AS poisson0 FROM matches GROUP BY ALL""")
def g12_l16_dispersion(spark, sf):
    g = F.col("home_goals")
    return matches(spark, sf).groupBy("league").agg(F.count("*").alias("n"), r6(F.var_samp(g) / F.avg(g)).alias("dispersion"), r6(F.avg((g == 0).cast("double"))).alias("empirical0"), r6(F.exp(-F.avg(g))).alias("poisson0"))


@query(f"""WITH {SIDES}, t AS (SELECT team_id, season, avg(goals_for) AS m FROM sides GROUP BY ALL), p AS (SELECT *, lead(m) OVER (PARTITION BY team_id ORDER BY season) AS nx, lead(season) OVER (PARTITION BY team_id ORDER BY season) AS ns FROM t)
SELECT count(*) AS n, round(corr(m, nx), 6) + 0.0 AS autocorrelation FROM p WHERE ns = season + 1""")
def g14_autocorrelation(spark, sf):
    t = sides(spark, sf).groupBy("team_id", "season").agg(F.avg("goals_for").alias("m"))
    w = W.partitionBy("team_id").orderBy("season")
    return t.withColumn("nx", F.lead("m").over(w)).withColumn("ns", F.lead("season").over(w)).filter("ns = season + 1").agg(F.count("*").alias("n"), r6(F.corr("m", "nx")).alias("autocorrelation"))


@query(f"""WITH {HISTORY} SELECT c_mktsegment, CASE WHEN gap IS NULL THEN 'none' WHEN gap <= 30 THEN 'short' WHEN gap <= 180 THEN 'medium' ELSE 'long' END AS rest, count(*) AS n, round(avg(o_totalprice), 2) + 0.0 AS response, round(corr(o_totalprice, gap), 6) + 0.0 AS r FROM (SELECT *, day - max(day) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM hist) GROUP BY ALL""")
def g15_g16_response_by_rest(spark, sf):
    from tidemark.operators.temporal import days_since

    rows = days_since(history(spark, sf), "o_custkey", "day", F.lit(True), "gap")
    rest = F.when(F.col("gap").isNull(), "none").when(F.col("gap") <= 30, "short").when(F.col("gap") <= 180, "medium").otherwise("long")
    return rows.groupBy("c_mktsegment", rest.alias("rest")).agg(F.count("*").alias("n"), (F.round(F.avg("o_totalprice"), 2) + 0.0).alias("response"), r6(F.corr("o_totalprice", "gap")).alias("r"))


@query(f"""WITH {MATCHES} SELECT season, round(avg(home_goals) FILTER (league = 'BUILDING'), 6) + 0.0 AS building, round(avg(home_goals) FILTER (league = 'MACHINERY'), 6) + 0.0 AS machinery FROM matches GROUP BY ALL""")
def g11_pivot_means(spark, sf):
    wide = matches(spark, sf).groupBy("season").pivot("league", ["BUILDING", "MACHINERY"]).agg(F.avg("home_goals"))
    return wide.select("season", r6("BUILDING").alias("building"), r6("MACHINERY").alias("machinery"))


@query("""SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS with_stats, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS kept FROM orders GROUP BY ALL HAVING count(*) > 1""")
def g08_g09_duplicate_references(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("with_stats"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("kept")).filter("n > 1")


@query(f"""WITH {SIDES}, o AS (SELECT a.*, b.goals_for AS og FROM sides a JOIN sides b ON a.match_id = b.match_id AND a.is_home <> b.is_home)
SELECT match_id, team_id, CAST(league = 'BUILDING' AS INT) AS league_b, CAST(league = 'FURNITURE' AS INT) AS league_f, og, day < 2000 AS is_train FROM o WHERE goals_for IS NOT NULL AND status = 'played'""")
def g01_g02_legacy_dataset_split(spark, sf):
    from tidemark.operators.sides import usable, with_opponent

    rows = usable(with_opponent(sides(spark, sf).filter("status = 'played'"), "match_id", ["goals_for"]), ["goals_for", "opp_goals_for"])
    return rows.select("match_id", "team_id", (F.col("league") == "BUILDING").cast("int").alias("league_b"), (F.col("league") == "FURNITURE").cast("int").alias("league_f"), F.col("opp_goals_for").alias("og"), (F.col("day") < 2000).alias("is_train"))
