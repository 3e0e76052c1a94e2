"""S-, P-, J-, T-, U-, E-: scans, projections, joins, top-k, sets and entity resolution."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import lookup as L
from tidemark.operators import resolve, sides as S
from tidemark.plans.base import HISTORY, MATCHES, SIDES, history, matches, query, r6, sides, table
from tidemark.sources.snapshot import gate

SEAL = "2000-07-01"


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) + 0.0 AS value FROM events GROUP BY ALL""")
def s01_latest_version(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return L.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", r6("value").alias("value"))


@query("""SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50""")
def s03_s05_nested_json(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").select("event_id", "user_id", k.alias("k")).filter("k >= 50")


@query("""SELECT DISTINCT c_mktsegment AS league, CAST(year(o_orderdate) AS INT) AS season FROM orders JOIN customer ON o_custkey = c_custkey""")
def s04_partitions(spark, sf):
    return history(spark, sf).select(F.col("c_mktsegment").alias("league"), "season").distinct()


@query("""SELECT o_orderkey, round(o_totalprice, 2) + 0.0 AS price, c_name, n_name, r_name, CAST(o_orderdate AS DATE) AS day, starts_with(o_orderpriority, '1') OR o_orderpriority IS NULL AS is_regular FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate < TIMESTAMP '2000-07-01' AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def s08_j01_gated_scan(spark, sf):
    orders = gate(table(spark, sf, "orders"), "o_orderdate", SEAL)
    customer = table(spark, sf, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    regular = F.col("o_orderpriority").startswith("1") | F.col("o_orderpriority").isNull()
    return joined.select("o_orderkey", (F.round("o_totalprice", 2) + 0.0).alias("price"), "c_name", "n_name", "r_name", F.to_date("o_orderdate").alias("day"), regular.alias("is_regular"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p_brand, s_name FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45""")
def s09_s10_s11_other_gated_scans(spark, sf):
    lines = gate(table(spark, sf, "lineitem"), "l_shipdate", "1996-01-01").filter("l_quantity > 45")
    return lines.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "s_name")


@query("""SELECT count(*) FILTER (o_orderdate >= TIMESTAMP '2000-07-01') AS sealed, count(*) AS total FROM orders""")
def p18_sealed_count(spark, sf):
    return table(spark, sf, "orders").agg(F.count_if(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit(SEAL))).alias("sealed"), F.count("*").alias("total"))


@query(f"""WITH {SIDES} SELECT match_id, team_id, CASE WHEN status = 'played' AND goals_for IS NOT NULL THEN goals_for END AS goals, CASE WHEN season < 1996 THEN 'burn_in' WHEN season < 1999 THEN 'train' WHEN season < 2000 THEN 'valid' ELSE 'sealed' END AS phase, league IN ('BUILDING', 'FURNITURE') AS top FROM sides""")
def p04_p05_p07_p11_masks_and_phases(spark, sf):
    phase = F.when(F.col("season") < 1996, "burn_in").when(F.col("season") < 1999, "train").when(F.col("season") < 2000, "valid").otherwise("sealed")
    history_row = (F.col("status") == "played") & F.col("goals_for").isNotNull()
    return sides(spark, sf).select("match_id", "team_id", F.when(history_row, F.col("goals_for")).alias("goals"), phase.alias("phase"), F.col("league").isin("BUILDING", "FURNITURE").alias("top"))


@query("""SELECT p_brand, count(*) FILTER (v IS NULL OR w IS NULL) AS excluded, count(*) AS total FROM (SELECT p_brand, CASE WHEN p_size > 5 THEN p_size END AS v, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice END AS w FROM part) GROUP BY ALL""")
def p08_complete_cases(spark, sf):
    part = table(spark, sf, "part").select("p_brand", F.when(F.col("p_size") > 5, F.col("p_size")).alias("v"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_retailprice")).alias("w"))
    return S.excluded_count(part, ["v", "w"], ["p_brand"])


@query(f"""WITH {SIDES}, k AS (SELECT * FROM sides WHERE NOT (is_home AND match_id % 5 = 0)) SELECT match_id, team_id FROM k WHERE match_id IN (SELECT match_id FROM k GROUP BY match_id HAVING count(*) = 2)""")
def p09_both_legs(spark, sf):
    return S.complete_contests(sides(spark, sf).filter("NOT (is_home AND match_id % 5 = 0)"), "match_id").select("match_id", "team_id")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'played' WHEN 'P' THEN 'postponed' WHEN 'O' THEN 'scheduled' END AS status, o_orderpriority = '5-LOW' AS excluded, CASE WHEN o_orderpriority = '5-LOW' THEN 'low' END AS reason FROM orders""")
def p12_status_decoding(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "played").when(F.col("o_orderstatus") == "P", "postponed").when(F.col("o_orderstatus") == "O", "scheduled")
    low = F.col("o_orderpriority") == "5-LOW"
    return table(spark, sf, "orders").select("o_orderkey", status.alias("status"), low.alias("excluded"), F.when(low, "low").alias("reason"))


@query("""SELECT p_partkey, CASE WHEN a THEN p_size ELSE p_partkey % 9 END AS shots, CASE WHEN a THEN 'api' WHEN p_partkey % 9 > 0 THEN 'csv' END AS source FROM (SELECT *, p_size > 10 AND p_brand <> 'Brand#2' AS a FROM part)""")
def p13_source_selection(spark, sf):
    api = (F.col("p_size") > 10) & (F.col("p_brand") != "Brand#2")
    other = F.col("p_partkey") % 9
    return table(spark, sf, "part").select("p_partkey", F.when(api, F.col("p_size")).otherwise(other).cast("long").alias("shots"), F.when(api, "api").when(other > 0, "csv").alias("source"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount > 0.05 AND l_tax > 0.04 THEN 1 + l_discount * 10 WHEN l_quantity > 10 THEN l_quantity / 10 END, 6) + 0.0 AS odds, CASE WHEN l_discount > 0.05 AND l_tax > 0.04 THEN 'first' WHEN l_quantity > 10 THEN 'second' END AS source FROM lineitem""")
def p14_priority_pairs(spark, sf):
    first = F.when((F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.04), F.struct((1 + F.col("l_discount") * 10).alias("odds"), F.lit("first").alias("source")))
    second = F.when(F.col("l_quantity") > 10, F.struct((F.col("l_quantity") / 10).alias("odds"), F.lit("second").alias("source")))
    return table(spark, sf, "lineitem").withColumn("o", F.coalesce(first, second)).select("l_orderkey", "l_linenumber", "l_partkey", r6("o.odds").alias("odds"), "o.source")


@query("""SELECT l_returnflag, count(*) FILTER (l_quantity BETWEEN 1 AND 45) AS plausible, count(*) FILTER (l_discount BETWEEN 0.01 AND 0.08) AS usable, count(*) AS total FROM lineitem GROUP BY ALL""")
def p15_plausible_ranges(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity").between(1, 45)).alias("plausible"), F.count_if(F.col("l_discount").between(0.01, 0.08)).alias("usable"), F.count("*").alias("total"))


PERIODS = [("BUILDING", 300, 400, True), ("BUILDING", 380, 420, False), ("MACHINERY", 1000, 1200, True)]


@query(f"""WITH {MATCHES}, p(league, s, e, sure) AS (VALUES ('BUILDING', 300, 400, true), ('BUILDING', 380, 420, false), ('MACHINERY', 1000, 1200, true))
SELECT m.match_id, coalesce(bool_or(p.sure) AND bool_and(p.sure), false) AS closed FROM matches m LEFT JOIN p ON p.league = m.league AND m.day BETWEEN p.s AND p.e GROUP BY m.match_id""")
def p16_periods(spark, sf):
    periods = spark.createDataFrame(PERIODS, "league string, start int, end int, sure boolean")
    return L.in_periods(matches(spark, sf), periods, "league", "day", "closed").select("match_id", "closed")


@query(f"""WITH {MATCHES} SELECT match_id, CASE WHEN day = 1500 THEN 'played' ELSE status END AS status, CASE WHEN day < 1500 THEN home_goals ELSE 0 END AS home_goals FROM matches WHERE day <= 1500""")
def p19_x02_day_mask(spark, sf):
    target = F.col("day") == 1500
    return matches(spark, sf).filter("day <= 1500").select("match_id", F.when(target, "played").otherwise(F.col("status")).alias("status"), F.when(target, 0).otherwise(F.col("home_goals")).alias("home_goals"))


@query("""SELECT k, h, gap FROM (VALUES (10), (15), (20)) a(k), (VALUES (20), (40)) b(h), (VALUES (50), (100), (150)) c(gap)""")
def p21_parameter_grid(spark, sf):
    one = spark.range(1)
    return one.select(F.explode(F.array(*map(F.lit, (10, 15, 20)))).alias("k")).withColumn("h", F.explode(F.array(F.lit(20), F.lit(40)))).withColumn("gap", F.explode(F.array(*map(F.lit, (50, 100, 150)))))


@query("""SELECT o_orderkey, coalesce(a.q, 0) AS home_lines, round(coalesce(a.s, 0), 2) + 0.0 AS home_amount, b.q AS away_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS q, sum(l_extendedprice) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL) a ON a.l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey, count(*) AS q FROM lineitem WHERE l_linenumber > 3 GROUP BY ALL) b ON b.l_orderkey = o_orderkey""")
def j02_j03_role_played_left_joins(spark, sf):
    """Both roles from one aggregation of the lines, instead of two joins."""
    first = F.col("l_linenumber") <= 3
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(first).alias("a"), F.sum(F.when(first, F.col("l_extendedprice"))).alias("s"), F.nullif(F.count_if(~first), F.lit(0)).alias("b"))
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("a", F.lit(0)).alias("home_lines"), (F.round(F.coalesce("s", F.lit(0.0)), 2) + 0.0).alias("home_amount"), F.col("b").alias("away_lines"))


@query(f"""WITH {HISTORY}, a AS (SELECT * FROM hist WHERE o_orderkey % 2 = 0), b AS (SELECT * FROM hist WHERE o_orderkey % 2 = 1),
p AS (SELECT a.o_orderkey AS left_id, b.o_orderkey AS right_id, abs(a.day - b.day) AS gap, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(a.day - b.day), b.o_orderkey) AS rn FROM a JOIN b ON a.o_custkey = b.o_custkey AND abs(a.day - b.day) <= 20)
SELECT left_id, right_id, CAST(gap AS INT) AS gap FROM p WHERE rn = 1""")
def j08_nearest_within_tolerance(spark, sf):
    h = history(spark, sf)
    left = h.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("left_id"), "o_custkey", "day")
    right = h.filter("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("right_id"), "o_custkey", "day")
    return L.nearest_day(left, right, ["o_custkey"], "day", "left_id", "right_id", 20)


@query(f"""WITH {MATCHES} SELECT a.match_id, b.match_id AS return_id FROM matches a JOIN (SELECT league, away_id AS home_id, home_id AS away_id, any_value(match_id) AS match_id FROM matches GROUP BY ALL HAVING count(*) = 1) b USING (league, home_id, away_id)""")
def j09_unambiguous_key(spark, sf):
    """Each contest's return fixture, where the sides met the other way round once only."""
    m, keys = matches(spark, sf), ["league", "home_id", "away_id"]
    back = L.unambiguous(m.select("league", F.col("away_id").alias("home_id"), F.col("home_id").alias("away_id"), F.col("match_id").alias("return_id")), keys)
    return m.join(back, keys).select("match_id", "return_id")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)""")
def j10_j11_j12_semi_anti_exists(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, sf, "customer").join(orders.filter("o_orderstatus = 'P'"), "c_custkey", "left_semi")
    return c.join(orders.filter("o_totalprice > 480000"), "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = 3""")
def j13_u02_intersection(spark, sf):
    return L.intersection(table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "N", "R")), "l_partkey", "l_returnflag", 3)


@query("""SELECT e.event_id, coalesce(a.n_name, b.n_name) AS name FROM events e LEFT JOIN nation a ON a.n_nationkey = e.user_id LEFT JOIN nation b ON b.n_nationkey = e.user_id % 25""")
def j15_fallback_key(spark, sf):
    nation = table(spark, sf, "nation")
    a = nation.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("a"))
    b = nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("b"))
    return table(spark, sf, "events").join(a, F.col("user_id") == F.col("k1"), "left").join(b, F.col("user_id") % 25 == F.col("k2"), "left").select("event_id", F.coalesce("a", "b").alias("name"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_partkey), 6) + 0.0 AS above_mean FROM lineitem""")
def j16_aggregate_join_back(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(F.col("l_quantity") - F.avg("l_quantity").over(W.partitionBy("l_partkey"))).alias("above_mean"))


@query("""SELECT l_partkey, CAST(l_shipdate AS DATE) AS day, count(DISTINCT l_suppkey) AS teams FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1""")
def j17_q10_same_day_pairs(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey", F.to_date("l_shipdate").alias("day")).agg(F.countDistinct("l_suppkey").alias("teams")).filter("teams > 1")


@query("""WITH a AS (SELECT DISTINCT s_nationkey AS a, CAST(s_acctbal / 500 AS INT) AS t FROM supplier), b AS (SELECT DISTINCT c_nationkey AS b, CAST(c_acctbal / 500 AS INT) AS t FROM customer),
c AS (SELECT a, b, count(*) AS common FROM a JOIN b USING (t) GROUP BY ALL)
SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, common, round(common * 1.0 / ((SELECT count(*) FROM a x WHERE x.a = c.a) + (SELECT count(*) FROM b y WHERE y.b = c.b) - common), 6) + 0.0 AS jaccard FROM c""")
def j18_u06_set_jaccard(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("a"), F.round(F.col("s_acctbal") / 500).cast("int").alias("t"))
    b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("b"), F.round(F.col("c_acctbal") / 500).cast("int").alias("t"))
    return resolve.set_jaccard(a, b, "a", "b", "t").select("a", "b", "common", r6("jaccard").alias("jaccard"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def t01_t03_top_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""SELECT c_mktsegment, round(avg(c_acctbal), 6) + 0.0 AS entry FROM (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS rn FROM customer) WHERE rn <= 3 GROUP BY ALL""")
def t04_three_lowest(spark, sf):
    w = W.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf, "customer").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").groupBy("c_mktsegment").agg(r6(F.avg("c_acctbal")).alias("entry"))


@query("""SELECT p_brand, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest, arg_max(p_partkey, (p_retailprice, p_partkey)) AS dearest, min(p_size) AS least_size FROM part GROUP BY ALL""")
def t06_t07_argmin_argmax(spark, sf):
    order = F.struct("p_retailprice", "p_partkey")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", order).alias("cheapest"), F.max_by("p_partkey", order).alias("dearest"), F.min("p_size").alias("least_size"))


@query("""SELECT p_type, b AS brand, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, b) AS rn FROM (SELECT p_type, p_brand AS b, count(*) AS n FROM part GROUP BY p_type, p_brand)) WHERE rn <= 3""")
def t05_top_per_group(spark, sf):
    n = table(spark, sf, "part").groupBy("p_type", F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))
    return n.withColumn("rn", F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("n"), "brand"))).filter("rn <= 3").drop("rn")


@query("""SELECT source, count(*) AS n FROM (SELECT s_nationkey AS k, 'supplier' AS source FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer) GROUP BY ALL""")
def u01_union_all(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("source")).unionByName(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("source"))).groupBy("source").agg(F.count("*").alias("n"))


@query("""SELECT 'minus' AS op, p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40) UNION ALL SELECT 'both', k FROM (SELECT s_suppkey AS k FROM supplier INTERSECT SELECT p_partkey FROM part WHERE p_size < 20) UNION ALL SELECT 'any', k FROM (SELECT s_suppkey AS k FROM supplier UNION SELECT n_nationkey FROM nation)""")
def u03_u04_set_operations(spark, sf):
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    minus = part.select(F.col("p_partkey").alias("k")).join(table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("k")), "k", "left_anti")
    both = supplier.intersect(part.filter("p_size < 20").select(F.col("p_partkey").alias("k")))
    either = supplier.union(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"))).distinct()
    return minus.select(F.lit("minus").alias("op"), "k").union(both.select(F.lit("both"), "k")).union(either.select(F.lit("any"), "k"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY ALL""")
def u05_first_of_each(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return L.first_by(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'X' FROM orders WHERE o_orderkey % 3 = 0""")
def u07_k11_keyed_merge(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return L.merged(old, old.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1""")
def k08_k09_append_only_new(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return L.only_new(orders.filter("o_orderkey % 2 = 1"), orders.filter("o_orderkey % 4 = 3"), ["o_orderkey"])


@query(f"""WITH {MATCHES}, late AS (SELECT home_id, away_id, any_value(day) AS d FROM matches WHERE match_id % 3 = 0 GROUP BY ALL HAVING count(*) = 1)
SELECT m.match_id, CAST(CASE WHEN m.status <> 'played' AND l.d IS NOT NULL THEN l.d ELSE m.day END AS INT) AS day, m.status <> 'played' AND l.d IS NOT NULL AS changed FROM matches m LEFT JOIN late l USING (home_id, away_id)""")
def x03_late_overlay(spark, sf):
    m = matches(spark, sf).select("match_id", "home_id", "away_id", "day", "status")
    late = m.filter("match_id % 3 = 0").select("home_id", "away_id", "day")
    return L.overlay(m, late, ["home_id", "away_id"], F.col("status") == "played", ["day"]).select("match_id", "day", "changed")


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS id FROM part WHERE p_size > 3""")
def e07_surrogate_ids(spark, sf):
    return L.surrogate_ids(table(spark, sf, "part").filter("p_size > 3"), "p_partkey")


@query("""SELECT e.event_id, coalesce(a.to_id, e.user_id) AS user_id FROM events e LEFT JOIN (SELECT n_nationkey AS from_id, CAST(n_nationkey + 1000 AS BIGINT) AS to_id FROM nation) a ON a.from_id = e.user_id""")
def e08_apply_aliases(spark, sf):
    alias = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), (F.col("n_nationkey") + 1000).cast("long").alias("to_id"))
    return table(spark, sf, "events").join(alias, "user_id", "left").select("event_id", F.coalesce("to_id", "user_id").alias("user_id"))


@query(f"""WITH {HISTORY} SELECT o_custkey, arg_max(c_mktsegment || '/' || o_orderpriority, (season, o_orderkey)) AS latest_name, count(DISTINCT o_orderpriority) > 1 AS conflict FROM hist GROUP BY ALL""")
def e06_a11_latest_name(spark, sf):
    return history(spark, sf).groupBy("o_custkey").agg(F.max_by(F.concat_ws("/", "c_mktsegment", "o_orderpriority"), F.struct("season", "o_orderkey")).alias("latest_name"), (F.countDistinct("o_orderpriority") > 1).alias("conflict"))


@query()
def e01_e02_schedule_matching(spark, sf):
    """The same schedule under two sets of names, the second a day later for some: pairs found."""
    m = matches(spark, sf).select("day", F.col("home_id").alias("home"), F.col("away_id").alias("away"))
    other = m.select((F.col("day") + F.when(F.pmod(F.xxhash64("day", "home"), F.lit(17)) == 0, 1).otherwise(0)).alias("day"), (F.col("home") + 5000).alias("home"), (F.col("away") + 5000).alias("away"))
    return resolve.match_schedules(m, other)


@query("""WITH RECURSIVE u AS (SELECT DISTINCT n_name AS name, unnest(string_split(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), ' ')) AS token FROM nation), t AS (SELECT * FROM u WHERE length(token) >= 2),
r AS (SELECT DISTINCT name, name AS reached FROM t UNION SELECT r.name, b.name FROM r JOIN t a ON a.name = r.reached JOIN t b ON b.token = a.token)
SELECT name, min(reached) AS grp FROM r GROUP BY ALL""")
def f04_name_groups(spark, sf):
    return resolve.name_groups(table(spark, sf, "nation").select(F.col("n_name").alias("name")))


@query()
def e04_f06_f07_fuzzy_names(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return resolve.fuzzy_names(names.select(F.concat("name", F.lit("s")).alias("name")), names)


@query("""SELECT match_id, player_id, CASE WHEN count(DISTINCT team_id) > 1 THEN 'two_teams' WHEN count(DISTINCT number) > 1 THEN 'same_team' ELSE 'repeated_entry' END AS kind FROM (SELECT l_orderkey AS match_id, l_partkey % 50 AS player_id, l_suppkey % 2 AS team_id, l_linenumber AS number FROM lineitem) GROUP BY ALL HAVING count(*) > 1""")
def q09_collisions(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("match_id"), (F.col("l_partkey") % 50).alias("player_id"), (F.col("l_suppkey") % 2).alias("team_id"), F.col("l_linenumber").alias("number"))
    return resolve.collisions(a).select("match_id", "player_id", "kind")
