"""Q-, K-: data-quality rules, fingerprints, snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators import temporal as T
from tidemark.plans.base import HISTORY, MATCHES, SIDES, history, matches, query, r6, sides, table
from tidemark.session import shared_folder


@query(f"""WITH {SIDES} SELECT league, season, count(*) // 2 AS listed, count(DISTINCT team_id) * (count(DISTINCT team_id) - 1) AS expected FROM sides GROUP BY ALL""")
def q01_listed_vs_expected(spark, sf):
    n = F.countDistinct("team_id")
    return sides(spark, sf).groupBy("league", "season").agg(F.expr("count(*) div 2").alias("listed"), (n * (n - 1)).alias("expected"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def q02_q14_finished_without_detail(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    return Q.orphans(done, "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey")


@query("""SELECT l_orderkey, count(*) AS players, count(*) FILTER (l_linenumber = 1) AS keepers, count(DISTINCT l_suppkey) AS teams, sum(CASE WHEN l_partkey IS NULL THEN 1 ELSE 0 END) > 0 AS missing_id FROM lineitem GROUP BY ALL HAVING count(*) < 3 OR count(*) FILTER (l_linenumber = 1) <> 1""")
def q03_q04_q06_lineup_shape(spark, sf):
    got = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("players"), F.count_if(F.col("l_linenumber") == 1).alias("keepers"), F.countDistinct("l_suppkey").alias("teams"), (F.count_if(F.col("l_partkey").isNull()) > 0).alias("missing_id"))
    return got.filter("players < 3 OR keepers <> 1")


@query(f"""WITH {MATCHES}, g AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS goals FROM lineitem GROUP BY ALL) SELECT match_id, CAST(home_goals + away_goals AS INT) AS score, goals FROM matches JOIN g ON l_orderkey = match_id WHERE goals <> home_goals + away_goals""")
def q05_q19_goals_from_events(spark, sf):
    goal = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(goal).alias("goals"))
    m = matches(spark, sf).withColumn("score", (F.col("home_goals") + F.col("away_goals")).cast("int"))
    return m.join(g, F.col("match_id") == F.col("l_orderkey")).filter("goals <> score").select("match_id", "score", "goals")


@query("""SELECT lower(p_name) AS name, p_size, count(DISTINCT p_partkey) AS ids FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1""")
def q07_q08_probable_duplicates(spark, sf):
    from tidemark.functions.text import normalize_name

    return table(spark, sf, "part").groupBy(normalize_name(F.col("p_name")).alias("name"), "p_size").agg(F.countDistinct("p_partkey").alias("ids")).filter("ids > 1")


@query("""WITH b AS (SELECT l_partkey, l_quantity % 3 AS birth, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY ALL)
SELECT l_partkey, CASE WHEN max(first) > min(last) AND count(*) = 2 THEN 'correction' ELSE 'collision' END AS kind, round(arg_max(birth, (last, birth)), 6) + 0.0 AS retained FROM b GROUP BY ALL HAVING count(*) > 1""")
def q11_birth_corrections(spark, sf):
    b = table(spark, sf, "lineitem").groupBy("l_partkey", (F.col("l_quantity") % 3).alias("birth")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    got = b.groupBy("l_partkey").agg(F.count("*").alias("n"), F.when((F.max("first") > F.min("last")) & (F.count("*") == 2), "correction").otherwise("collision").alias("kind"), F.max_by("birth", F.struct("last", "birth")).alias("r"))
    return got.filter("n > 1").select("l_partkey", "kind", r6("r").alias("retained"))


@query("""SELECT l_orderkey, l_suppkey, CASE WHEN count(DISTINCT l_linenumber) = 1 THEN min(l_linenumber) END AS number FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def q12_resolved_number(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.when(F.countDistinct("l_linenumber") == 1, F.min("l_linenumber")).alias("number"), F.count("*").alias("n")).filter("n > 1").drop("n")


@query("""WITH r AS (SELECT l_returnflag, count(*) FILTER (l_quantity <= 49) AS a, count(*) FILTER (l_discount <= 0.09) AS b, count(*) AS total FROM lineitem GROUP BY ALL), u AS (SELECT l_returnflag, 'minutes' AS rule, a * 1.0 / total AS rate FROM r UNION ALL SELECT l_returnflag, 'rating', b * 1.0 / total FROM r)
SELECT l_returnflag, rule, round(rate, 6) + 0.0 AS rate, CASE WHEN rate >= 0.99 THEN 'OK' WHEN rate >= 0.95 THEN 'WATCH' ELSE 'BLOCK' END AS severity FROM u""")
def q13_q16_q18_rates_and_severity(spark, sf):
    got = Q.rates(table(spark, sf, "lineitem"), {"minutes": F.col("l_quantity") <= 49, "rating": F.col("l_discount") <= 0.09}, ["l_returnflag"])
    return got.select("l_returnflag", "rule", r6("rate").alias("rate"), Q.severity(F.col("rate")).alias("severity"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def q17_a09_duplicate_keys(spark, sf):
    return Q.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT rule, count(*) AS n FROM (SELECT 'different_sides' AS rule FROM lineitem WHERE l_suppkey = l_partkey UNION ALL SELECT 'implication' FROM lineitem WHERE (l_returnflag = 'R') <> (l_linestatus = 'F')) GROUP BY ALL""")
def q20_check_constraints(spark, sf):
    rules = {"different_sides": F.col("l_suppkey") != F.col("l_partkey"), "implication": (F.col("l_returnflag") == "R") == (F.col("l_linestatus") == "F")}
    return Q.failing(table(spark, sf, "lineitem"), rules).groupBy("rule").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders),
j AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, (o_orderstatus IS DISTINCT FROM s) AS ds, (o_totalprice IS NULL) <> (p IS NULL) OR coalesce(abs(o_totalprice - p) > 1e-12, false) AS dp FROM orders a FULL JOIN b ON a.o_orderkey = b.o_orderkey),
c AS (SELECT count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL) AS matched, count(*) FILTER (kb IS NULL) AS only_left, count(*) FILTER (ka IS NULL) AS only_right, count(*) FILTER (ds) AS ns, count(*) FILTER (dp) AS np FROM j)
SELECT matched, only_left, only_right, 'o_orderstatus' AS "column", ns AS differing FROM c UNION ALL SELECT matched, only_left, only_right, 'o_totalprice', np FROM c""")
def q21_r22_snapshot_comparison(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    return Q.differing_columns(a, b, ["o_orderkey"], ["o_orderstatus", "o_totalprice"], 1e-12)


def _forms(rows):
    w = "PARTITION BY {} ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING"
    return f"""(SELECT o_orderkey, round(CASE WHEN w > 0 THEN (wx + 3.0 * mu) / (w + 3.0) END, 6) AS ewm
  FROM (SELECT *, sum(pow(0.5, -day / 120.0) * o_totalprice) OVER w * pow(0.5, day / 120.0) AS wx, sum(pow(0.5, -day / 120.0)) OVER w * pow(0.5, day / 120.0) AS w FROM {rows} WINDOW w AS ({w.format("o_custkey")}))
  JOIN (SELECT c_mktsegment, day, sum(sum(o_totalprice)) OVER w / nullif(sum(count(o_totalprice)) OVER w, 0) AS mu FROM {rows} GROUP BY c_mktsegment, day WINDOW w AS ({w.format("c_mktsegment")})) USING (c_mktsegment, day) WHERE day <= 1500)"""


@query(f"""WITH {HISTORY}, cut AS (SELECT * FROM hist WHERE day <= 1500), a AS {_forms("hist")}, b AS {_forms("cut")}
SELECT count(*) AS differing_rows FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR (a.ewm IS NULL) <> (b.ewm IS NULL) OR abs(a.ewm - b.ewm) > 1e-4""")
def q22_cut_date_invariance(spark, sf):
    """Forms built on history cut at day 1500 equal the earlier rows of forms built on everything."""
    h = history(spark, sf)

    def build(rows):
        got = T.decayed_mean(rows, "o_custkey", ["c_mktsegment"], "day", "o_totalprice", 120.0)
        return got.filter("day <= 1500").select("o_orderkey", F.round("ewm", 6).alias("ewm"))

    return Q.same_values(build(h), build(h.filter("day <= 1500")), ["o_orderkey"], "ewm", 1e-4).agg(F.count("*").alias("differing_rows"))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (l_linenumber <= 4) AS announced, list(DISTINCT l_partkey) AS final FROM lineitem GROUP BY ALL) SELECT l_orderkey, CAST(len(list_intersect(announced, final)) AS INT) AS kept, CAST(len(final) AS INT) AS n FROM s WHERE announced IS NOT NULL""")
def q23_announced_vs_final(spark, sf):
    announced = F.collect_set(F.when(F.col("l_linenumber") <= 4, F.col("l_partkey")))
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(announced.alias("a"), F.collect_set("l_partkey").alias("f"))
    return s.filter("size(a) > 0").select("l_orderkey", F.size(F.array_intersect("a", "f")).alias("kept"), F.size("f").alias("n"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN value IS NULL OR value < 1 THEN 'suspect' ELSE 'done' END AS result, value < 5 AND event_type = 'click' AS overdue FROM events""")
def q24_x08_task_results(spark, sf):
    result = F.when(F.col("event_type") == "error", "failed").when(F.col("value").isNull() | (F.col("value") < 1), "suspect").otherwise("done")
    return table(spark, sf, "events").select("event_id", result.alias("result"), ((F.col("value") < 5) & (F.col("event_type") == "click")).alias("overdue"))


@query("""SELECT doc_id, regexp_matches(text, '[\\x{200b}\\x{feff}]') AS forbidden, contains(text, chr(92)) AS backslash FROM documents""")
def q25_forbidden_characters(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike(r"[\u200b\ufeff]").alias("forbidden"), F.contains("text", F.lit("\\")).alias("backslash"))


@query()
def k05_fingerprint(spark, sf):
    return Q.fingerprint(table(spark, sf, "orders"))


@query(f"""WITH {HISTORY} SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers FROM hist""")
def k07_snapshot_round_trip(spark, sf):
    """A snapshot written, found and read again."""
    from tidemark.sources import snapshot

    root = f"{shared_folder(spark)}/tidemark-snapshots-{uuid.uuid4().hex}"
    manifest = snapshot.write_snapshot(history(spark, sf), root, "2000-07-01")
    rows, _ = snapshot.read_snapshot(spark, root, manifest["version"])
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("customers"))
