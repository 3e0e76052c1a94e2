"""Remaining inventory ids: scans, projections, string and time functions, entity rules, exploratory tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import prob, text
from tidemark.operators import lookup as L
from tidemark.operators import resolve, stats
from tidemark.operators import temporal as T
from tidemark.plans.base import HISTORY, MATCHES, SIDES, history, matches, query, r6, sides, table


@query("""SELECT k, arg_max(event_id, (ts, event_id)) AS event_id FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts, event_id FROM events) GROUP BY ALL""")
def s02_newest_batch_of_exploded(spark, sf):
    """Elements of nested responses, of repeated keys the newest batch's."""
    e = table(spark, sf, "events").select(F.array(F.struct(F.from_json("props", "k long")["k"].alias("k"), "event_id")).alias("response"), "ts")
    rows = e.select("ts", F.explode("response").alias("i")).select("ts", "i.k", "i.event_id")
    return L.latest(rows, ["k"], ["ts", "event_id"]).select("k", "event_id")


@query("""SELECT c_mktsegment, count(*) AS rows, count(c_acctbal) AS filled, count(*) FILTER (c_acctbal < 0) AS negative, CAST(max(length(c_name)) AS INT) AS widest FROM customer GROUP BY ALL""")
def s07_file_shape(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("rows"), F.count("c_acctbal").alias("filled"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.max(F.length("c_name")).alias("widest"))


@query("""SELECT o_orderkey, league_id, country FROM orders JOIN customer ON o_custkey = c_custkey JOIN (VALUES ('BUILDING', 39, 'England'), ('MACHINERY', 140, 'Spain')) d(seg, league_id, country) ON seg = c_mktsegment""")
def s16_dimension_mapping(spark, sf):
    dim = spark.createDataFrame([("BUILDING", 39, "England"), ("MACHINERY", 140, "Spain")], "c_mktsegment string, league_id int, country string")
    return history(spark, sf).join(F.broadcast(dim), "c_mktsegment").select("o_orderkey", "league_id", "country")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000""")
def s18_journal_scan(spark, sf):
    return table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000").select("o_orderkey", "o_custkey")


@query("""SELECT c_mktsegment, CAST(count(*) AS VARCHAR) || '-' || CAST(sum(CAST(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS version FROM customer GROUP BY ALL""")
def s19_data_version(spark, sf):
    """What a group holds, whatever its order: the sum of its ids' hashes, so no group is gathered."""
    mark = F.conv(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.concat_ws("-", F.count("*").cast("string"), F.sum(mark).cast("string")).alias("version"))


@query("""SELECT o_orderkey, o_orderpriority IS NULL OR starts_with(o_orderpriority, '3-') AS is_regular FROM orders""")
def p06_regular_season(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderpriority").isNull() | F.col("o_orderpriority").startswith("3-")).alias("is_regular"))


@query(f"""WITH {SIDES} SELECT match_id, team_id, """ + ", ".join(f"round(pow(0.5, day / {h}.0), 9) + 0.0 AS decay_h{h}" for h in (60, 120, 240)) + " FROM sides")
def p10_p17_templated_columns(spark, sf):
    """Columns from a template over half-lives, after the targets are dropped."""
    blind = sides(spark, sf).drop("goals_for", "goals_against")
    return blind.select("match_id", "team_id", *((F.round(F.pow(F.lit(0.5), F.col("day") / float(h)), 9) + 0.0).alias(f"decay_h{h}") for h in (60, 120, 240)))


@query("""SELECT o_orderkey, CASE WHEN year(o_orderdate) NOT IN (1997, 1998) THEN round(o_totalprice, 2) + 0.0 END AS price FROM orders""")
def p20_mask_one_source(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(~F.year("o_orderdate").isin(1997, 1998), F.round("o_totalprice", 2) + 0.0).alias("price"))


@query(f"""WITH {MATCHES} SELECT match_id, league, season FROM matches JOIN (SELECT match_id AS k, count(*) AS n FROM matches GROUP BY ALL HAVING count(*) = 1) ON k = match_id""")
def j04_asserted_one_to_one(spark, sf):
    m = matches(spark, sf)
    other = m.groupBy("match_id").agg(F.count("*").alias("n"))
    one = other.withColumn("n", F.when(F.col("n") == 1, 1).otherwise(F.raise_error(F.lit("key isn't unique")).cast("int")))
    return m.join(one, "match_id").filter("n = 1").select("match_id", "league", "season")


@query("""SELECT n_nationkey AS a, p AS b, round(1 - levenshtein(lower(n_name), lower(p)) / greatest(length(n_name), length(p)), 6) + 0.0 AS score FROM nation, (SELECT r_name AS p FROM region)""")
def j19_all_pairs_of_dimensions(spark, sf):
    """Both sides are dimensions of a few rows."""
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), F.lower("n_name").alias("x"))
    b = table(spark, sf, "region").select(F.col("r_name").alias("b"))
    return a.crossJoin(b).select("a", "b", r6(text.similarity(F.col("x"), F.lower("b"))).alias("score"))


@query(f"""WITH {MATCHES} SELECT t, n, round(p, 6) + 0.0 AS observed FROM (SELECT t, count(*) FILTER (home_goals + away_goals <= t) AS n, avg(CASE WHEN home_goals + away_goals <= t THEN 1.0 ELSE 0.0 END) AS p FROM matches, (VALUES (0), (1), (2)) v(t) GROUP BY ALL)""")
def a33_small_totals(spark, sf):
    total = F.col("home_goals") + F.col("away_goals")
    one = matches(spark, sf).agg(*(F.count_if(total <= t).alias(f"n{t}") for t in range(3)), F.count("*").alias("n"))
    return one.select(F.inline(F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"n{t}").alias("n"), r6(F.col(f"n{t}") / F.col("n")).alias("observed")) for t in range(3)))))


@query("""SELECT n_nationkey AS k, CAST(i AS INT) AS i, round(sum(p) OVER (PARTITION BY n_nationkey ORDER BY i), 6) + 0.0 AS c FROM (SELECT n_nationkey, i, exp(-(0.5 + n_nationkey * 0.1)) * pow(0.5 + n_nationkey * 0.1, i) / factorial(CAST(i AS INT)) AS p FROM nation, (SELECT unnest(range(0, 8)) AS i))""")
def w26_cumulative_distribution(spark, sf):
    mean = 0.5 + F.col("n_nationkey") * 0.1
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.posexplode(prob.cdf(prob.poisson(mean, 8))).alias("i", "c")).select("k", "i", r6("c").alias("c"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders""")
def t02_ordered_groups(spark, sf):
    w = W.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("""SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name AND split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2)""")
def f02_f03_shared_tokens(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    tokens = names.select("p_name", F.element_at(text.significant_tokens(F.col("p_name")), 2).alias("t"))
    b = tokens.select(F.col("p_name").alias("b"), "t")
    return tokens.withColumnRenamed("p_name", "a").join(b, "t").filter("a < b").filter(text.compatible(F.col("a"), F.col("b"))).select("a", "b")


@query("""SELECT name, coalesce(alias, name) AS canonical FROM (SELECT DISTINCT lower(n_name) AS name FROM nation) LEFT JOIN (VALUES ('nation_1', 'first'), ('nation_2', 'second')) a(k, alias) ON k = name""")
def f05_f08_alias_dictionary(spark, sf):
    alias = F.create_map(*map(F.lit, ("nation_1", "first", "nation_2", "second")))
    return table(spark, sf, "nation").select(F.lower("n_name").alias("name")).distinct().select("name", F.coalesce(F.try_element_at(alias, F.col("name")), "name").alias("canonical"))


@query("""SELECT event_id, ts - INTERVAL 2 HOUR AS utc FROM events""")
def d04_offset_to_utc(spark, sf):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return table(spark, sf, "events").select("event_id", F.to_timestamp(iso).cast("timestamp_ntz").alias("utc"))


@query("""SELECT o_orderkey, o_orderdate + INTERVAL 12 HOUR - CASE WHEN CAST(o_orderdate AS DATE) >= spring - CAST(dayofweek(spring) AS INT) AND CAST(o_orderdate AS DATE) < autumn - CAST(dayofweek(autumn) AS INT) THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS utc
FROM (SELECT *, make_date(year(o_orderdate), 3, 31) AS spring, CASE year(o_orderdate) WHEN 1995 THEN DATE '1995-10-22' ELSE make_date(year(o_orderdate), 10, 31) END AS autumn FROM orders)""")
def d05_local_to_utc(spark, sf):
    local = (F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS")).cast("timestamp")
    return table(spark, sf, "orders").select("o_orderkey", F.to_utc_timestamp(local, "Europe/London").cast("timestamp_ntz").alias("utc"))


@query("""SELECT p_brand, p_partkey, round(CASE WHEN n > 1 THEN 100.0 * (n - r) / (n - 1) END, 6) + 0.0 AS reputation FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)""")
def m16_rank_reputation(spark, sf):
    w = W.partitionBy("p_brand")
    r, n = F.row_number().over(w.orderBy(F.desc("p_retailprice"), "p_partkey")), F.count("*").over(w)
    return table(spark, sf, "part").select("p_brand", "p_partkey", r6(F.when(n > 1, 100.0 * (n - r) / (n - 1))).alias("reputation"))


@query("""SELECT l_orderkey, CAST(len(list_intersect(a, b)) AS INT) AS common, CAST(len(a) AS INT) AS announced FROM (SELECT l_orderkey, list(DISTINCT l_partkey) AS a, list(DISTINCT l_partkey) FILTER (l_quantity > 20) AS b FROM lineitem GROUP BY ALL) WHERE b IS NOT NULL""")
def n05_x07_set_comparison(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_partkey"))).alias("b"))
    return s.filter("size(b) > 0").select("l_orderkey", F.size(F.array_intersect("a", "b")).alias("common"), F.size("a").alias("announced"))


@query("""SELECT l_partkey, CASE WHEN count(DISTINCT l_orderkey) = count(*) THEN min(l_suppkey) END AS never_together, arg_min(l_suppkey, (-n, l_suppkey)) AS primary_id FROM (SELECT l_partkey, l_suppkey, l_orderkey, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n FROM lineitem) GROUP BY ALL""")
def e05_alias_selection(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", F.count("*").over(W.partitionBy("l_partkey", "l_suppkey")).alias("n"))
    apart = F.countDistinct("l_orderkey") == F.count("*")
    return lines.groupBy("l_partkey").agg(F.when(apart, F.min("l_suppkey")).alias("never_together"), F.min_by("l_suppkey", F.struct(-F.col("n"), "l_suppkey")).alias("primary_id"))


PAIRED = f"""WITH {MATCHES}, p AS (SELECT DISTINCT a, a + 5000 + CASE WHEN a % 11 = 0 THEN 1 ELSE 0 END AS b FROM (SELECT home_id AS a FROM matches UNION SELECT away_id FROM matches) WHERE a % 13 <> 0),
o AS (SELECT DISTINCT day + CASE WHEN match_id % 29 = 0 THEN 2 WHEN match_id % 17 = 0 THEN 1 ELSE 0 END AS day, home_id + 5000 AS home, away_id + 5000 AS away FROM matches),
k AS (SELECT home_id, away_id, EXISTS (SELECT 1 FROM o WHERE o.home = h.b AND o.away = w.b AND abs(o.day - m.day) <= 1) AS good FROM matches m LEFT JOIN p h ON h.a = home_id LEFT JOIN p w ON w.a = away_id),
e AS (SELECT home_id AS a, good FROM k UNION ALL SELECT away_id, good FROM k)"""


@query(PAIRED + """ SELECT e.a, p.b, count(*) AS played, count(*) FILTER (good) AS ok, round(count(*) FILTER (good) / count(*), 6) + 0.0 AS share, p.b IS NOT NULL AND count(*) FILTER (good) >= 0.6 * count(*) AS confirmed FROM e LEFT JOIN p ON p.a = e.a GROUP BY e.a, p.b""")
def e03_confirmation(spark, sf):
    """Pairs of sides, some wrong and some lacking, applied to both schedules: the share of an entity's contests that the second
    schedule has between the paired sides, a day apart at most."""
    m = matches(spark, sf).select("match_id", "day", F.col("home_id").alias("home"), F.col("away_id").alias("away"))
    late = F.when(F.col("match_id") % 29 == 0, 2).when(F.col("match_id") % 17 == 0, 1).otherwise(0)
    other = m.select((F.col("day") + late).alias("day"), (F.col("home") + 5000).alias("home"), (F.col("away") + 5000).alias("away"))
    every = m.select(F.explode(F.array("home", "away")).alias("a")).distinct().filter("a % 13 <> 0")
    pairs = every.select("a", (F.col("a") + 5000 + F.when(F.col("a") % 11 == 0, 1).otherwise(0)).alias("b"))
    return resolve.confirmed(m, other, pairs, least=0.6).withColumn("share", r6("share"))


@query("""SELECT c_mktsegment, list_sort(list(DISTINCT o_orderpriority)) AS names FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def g10_distinct_raw_names(spark, sf):
    got = history(spark, sf).groupBy("c_mktsegment").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("names"))
    return got


@query(f"""WITH {MATCHES}, x AS (SELECT match_id, (home_id % 7) - (away_id % 7) AS gap, home_goals - away_goals AS d FROM matches)
SELECT CASE WHEN gap <= -3 THEN 'low' WHEN gap <= 2 THEN 'even' ELSE 'high' END AS band, count(*) AS n, round(avg(CASE WHEN d > 0 THEN 1.0 WHEN d = 0 THEN 0.5 ELSE 0.0 END), 6) + 0.0 AS score, round(avg(abs(d)), 6) + 0.0 AS margin FROM x GROUP BY ALL""")
def g13_response_by_gap(spark, sf):
    gap, d = F.col("home_id") % 7 - F.col("away_id") % 7, F.col("home_goals") - F.col("away_goals")
    band = F.when(gap <= -3, "low").when(gap <= 2, "even").otherwise("high")
    return matches(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"), r6(F.avg(F.when(d > 0, 1.0).when(d == 0, 0.5).otherwise(0.0))).alias("score"), r6(F.avg(F.abs(d))).alias("margin"))


@query(f"""WITH {MATCHES}, x AS (SELECT league, season, CASE WHEN home_goals + away_goals > 4 THEN 1.0 ELSE 0.0 END AS o, CASE WHEN match_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS p FROM matches)
SELECT league, season, count(*) AS n, round(avg(CASE WHEN o = p THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate, round(greatest(avg(o), 1 - avg(o)), 6) + 0.0 AS naive FROM x GROUP BY GROUPING SETS ((league, season), (league), ())""")
def g18_hit_rates(spark, sf):
    x = matches(spark, sf).select("league", "season", (F.col("home_goals") + F.col("away_goals") > 4).cast("double").alias("o"), (F.col("match_id") % 3 == 0).cast("double").alias("p"))
    hits = [F.count("*").alias("n"), F.sum((F.col("o") == F.col("p")).cast("double")).alias("h"), F.sum("o").alias("s")]
    rolled = x.rollup("league", "season").agg(*hits)
    return rolled.select("league", "season", "n", r6(F.col("h") / F.col("n")).alias("hit_rate"), r6(F.greatest(F.col("s") / F.col("n"), 1 - F.col("s") / F.col("n"))).alias("naive"))


@query(f"""WITH {HISTORY} SELECT round(corr(rx, ry), 6) + 0.0 AS partial FROM (SELECT o_totalprice - (regr_slope(o_totalprice, day) OVER () * day + regr_intercept(o_totalprice, day) OVER ()) AS rx, season - (regr_slope(season, day) OVER () * day + regr_intercept(season, day) OVER ()) AS ry FROM hist)""")
def g17_partial_correlation(spark, sf):
    """From pairwise correlations, in one aggregation."""
    c = history(spark, sf).agg(F.corr("o_totalprice", "season").alias("xy"), F.corr("o_totalprice", "day").alias("xz"), F.corr("season", "day").alias("yz"))
    return c.select(r6((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("partial"))


@query("""SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) - avg(p), 6) + 0.0 AS bias, round(avg(pow(p - CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END, 2)), 6) + 0.0 AS brier FROM (SELECT *, (o_custkey % 10) / 10.0 AS p FROM orders) GROUP BY ALL""")
def g06_calibration_brier(spark, sf):
    o, p = (F.col("o_orderstatus") == "F").cast("double"), (F.col("o_custkey") % 10) / 10.0
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(r6(F.avg(o) - F.avg(p)).alias("bias"), r6(F.avg(F.pow(p - o, 2))).alias("brier"))


@query(f"""WITH {SIDES}, h AS (SELECT *, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS points, CASE WHEN goals_for <> 4 THEN goals_for END AS xg FROM sides WHERE status = 'played' AND day < 1500),
f AS (SELECT team_id, is_home, avg(points) AS fp, avg(goals_for) AS ff, avg(goals_against) AS fa FROM (SELECT *, row_number() OVER (PARTITION BY team_id, is_home ORDER BY day DESC, match_id DESC) AS rn FROM h) WHERE rn <= 10 GROUP BY ALL),
g AS (SELECT team_id, is_home, avg(xg) AS fx FROM (SELECT *, row_number() OVER (PARTITION BY team_id, is_home ORDER BY day DESC, match_id DESC) AS rn FROM h WHERE xg IS NOT NULL) WHERE rn <= 5 GROUP BY ALL),
t AS (SELECT league, season, team_id, sum(points) AS sp, sum(goals_for - goals_against) AS sd, row_number() OVER (PARTITION BY league, season ORDER BY sum(points) DESC, sum(goals_for - goals_against) DESC, team_id) AS place FROM h GROUP BY league, season, team_id)
SELECT league, season, team_id, is_home, round(fp, 6) + 0.0 AS form_points, round(ff, 6) + 0.0 AS form_for, round(fa, 6) + 0.0 AS form_against, round(fx, 6) + 0.0 AS form_xg, CAST(sp AS BIGINT) AS standing_points, CAST(sd AS BIGINT) AS standing_diff, CAST(place AS INT) AS standing_place
FROM (SELECT DISTINCT league, season, team_id, is_home FROM sides WHERE season = 1999) LEFT JOIN f USING (team_id, is_home) LEFT JOIN g USING (team_id, is_home) LEFT JOIN t USING (league, season, team_id)""")
def g04_live_features(spark, sf):
    """What a prediction made on day 1500 knows of every side of that season, at home and away."""
    rows = sides(spark, sf).withColumn("xg", F.when(F.col("goals_for") != 4, F.col("goals_for")))
    asked = rows.filter("season = 1999").select("league", "season", "team_id", "is_home").distinct()
    return T.live_features(rows.filter("status = 'played'"), asked, 1500).withColumns({c: r6(c) for c in ("form_points", "form_for", "form_against", "form_xg")})


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 6) + 0.0 AS weighted, count(DISTINCT l_suppkey) FILTER (l_tax > 0.03) AS suppliers FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def a05_a07_cube_filter(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(r6(stats.weighted_mean(F.col("l_discount"), F.col("l_quantity"))).alias("weighted"), F.countDistinct(F.when(F.col("l_tax") > 0.03, F.col("l_suppkey"))).alias("suppliers"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey < 4500 AND o_custkey % 3 = 0 AND o_orderstatus IN ('F', 'P')""")
def s12_value_lists(spark, sf):
    """A short list that reaches the scan and a long one that is joined."""
    short = L.among(table(spark, sf, "orders"), "o_orderstatus", ["F", "P"])
    return L.among(short, "o_custkey", range(0, 4500, 3)).select("o_orderkey")


@query("""SELECT o_orderkey AS position, o_custkey AS c_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey""")
def j14_ordered_lookup(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("c_custkey"))
    return L.looked_up(wanted, table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", "position")


@query("""SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"order":' || o_orderkey || ',"status":' || CASE WHEN o_orderstatus = 'F' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS digest FROM orders""")
def n06_canonical_digest(spark, sf):
    json = text.canonical_json({"status": F.nullif("o_orderstatus", F.lit("F")), "order": F.col("o_orderkey"), "customer": F.col("o_custkey")})
    return table(spark, sf, "orders").select("o_orderkey", F.sha2(json, 256).alias("digest"))
