"""W-: windows over strictly earlier days, and J-06/J-07."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.operators import sides as S
from tidemark.operators import temporal as T
from tidemark.operators.ratings import elo
from tidemark.plans.base import HISTORY, LINEUPS, MATCHES, SIDES, history, lineups, matches, query, r6, sides, table
from tidemark.session import shared_folder

W01 = f"""WITH {HISTORY},
daily AS (SELECT c_mktsegment, day, sum(o_totalprice) AS s, count(o_totalprice) AS c FROM hist GROUP BY ALL),
mu AS (SELECT c_mktsegment, day, sum(s) OVER w / nullif(sum(c) OVER w, 0) AS mu FROM daily WINDOW w AS (PARTITION BY c_mktsegment ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, sum(pow(0.5, -day / 120.0) * o_totalprice) OVER w * pow(0.5, day / 120.0) AS wx, sum(pow(0.5, -day / 120.0)) OVER w * pow(0.5, day / 120.0) AS w FROM hist WINDOW w AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, o_custkey, CAST(day AS INT) AS day, round(CASE WHEN w > 0 THEN (wx + 3.0 * mu) / (w + 3.0) END, 4) + 0.0 AS ewm, round(coalesce(w, 0.0), 6) + 0.0 AS ewm_weight
FROM x JOIN mu USING (c_mktsegment, day)"""


@query(W01)
def w01_decayed_mean(spark, sf):
    got = T.decayed_mean(history(spark, sf), "o_custkey", ["c_mktsegment"], "day", "o_totalprice", 120.0)
    return got.select("o_orderkey", "o_custkey", "day", (F.round("ewm", 4) + 0.0).alias("ewm"), r6("ewm_weight").alias("ewm_weight"))


@query(f"""WITH {SIDES},
known AS (SELECT *, CASE WHEN status = 'played' THEN CAST(goals_for AS DOUBLE) END AS x FROM sides),
daily AS (SELECT league, day, sum(x) AS s, count(x) AS c FROM known GROUP BY ALL),
mu AS (SELECT league, day, sum(s) OVER w / nullif(sum(c) OVER w, 0) AS mu FROM daily WINDOW w AS (PARTITION BY league ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, sum(CASE WHEN x IS NOT NULL THEN pow(0.5, -day / 60.0) * x END) OVER w * pow(0.5, day / 60.0) AS wx, sum(CASE WHEN x IS NOT NULL THEN pow(0.5, -day / 60.0) END) OVER w * pow(0.5, day / 60.0) AS w
  FROM known WINDOW w AS (PARTITION BY team_id ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING))
SELECT match_id, team_id, round(CASE WHEN w > 0 THEN (wx + 3.0 * mu) / (w + 3.0) END, 6) + 0.0 AS goals_for_ewm_h60, round(coalesce(w, 0.0), 6) + 0.0 AS goals_weight
FROM r JOIN mu USING (league, day)""")
def w02_goal_form_and_weight(spark, sf):
    got = T.decayed_mean(sides(spark, sf), "team_id", ["league"], "day", "goals_for", 60.0, history=F.col("status") == "played", name="g")
    return got.select("match_id", "team_id", r6("g").alias("goals_for_ewm_h60"), r6("g_weight").alias("goals_weight"))


@query(f"""WITH {SIDES}, daily AS (SELECT league, day, sum(goals_for) AS s, count(*) AS c FROM sides WHERE status = 'played' GROUP BY ALL)
SELECT league, CAST(day AS INT) AS day, round(sum(s) OVER w / nullif(sum(c) OVER w, 0), 6) + 0.0 AS league_mean FROM daily WINDOW w AS (PARTITION BY league ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING)""")
def w03_league_prior(spark, sf):
    daily = sides(spark, sf).filter("status = 'played'").groupBy("league", "day").agg(F.sum("goals_for").alias("s"), F.count("*").alias("c"))
    w = T.before(["league"], "day", 730)
    return daily.select("league", "day", r6(F.sum("s").over(w) / F.nullif(F.sum("c").over(w), F.lit(0))).alias("league_mean"))


def _gap(event: str, reach: str) -> str:
    return f"""WITH {SIDES}, g AS (SELECT match_id, team_id, day - max(CASE WHEN {event} THEN day END) OVER (PARTITION BY team_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM sides)
SELECT match_id, team_id, CAST(CASE WHEN g <= {reach} THEN g END AS INT) AS gap FROM g"""


@query(_gap("status = 'played' AND is_home", "730"))
def w04_days_since_last_valid(spark, sf):
    return T.days_since(sides(spark, sf), "team_id", "day", (F.col("status") == "played") & F.col("is_home"), "gap", 730).select("match_id", "team_id", F.col("gap").cast("int").alias("gap"))


@query(_gap("status = 'played'", "100000"))
def w06_rest_days(spark, sf):
    return T.days_since(sides(spark, sf), "team_id", "day", F.col("status") == "played", "gap").select("match_id", "team_id", F.col("gap").cast("int").alias("gap"))


@query(f"""WITH {SIDES} SELECT match_id, team_id, count(CASE WHEN status = 'played' THEN 1 END) OVER (PARTITION BY team_id ORDER BY day RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) AS matches_last_14d,
coalesce(bool_or(status = 'played' AND league = 'MACHINERY') OVER (PARTITION BY team_id ORDER BY day RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING), false) AS cup_last_4d, season >= CASE league WHEN 'BUILDING' THEN 1996 ELSE 1995 END AS rest_reliable FROM sides""")
def w07_w08_w09_calendar_load(spark, sf):
    rows = T.count_before(sides(spark, sf), "team_id", "day", F.col("status") == "played", 14, "matches_last_14d")
    rows = T.any_before(rows, "team_id", "day", (F.col("status") == "played") & (F.col("league") == "MACHINERY"), 4, "cup_last_4d")
    return rows.select("match_id", "team_id", "matches_last_14d", "cup_last_4d", (F.col("season") >= F.when(F.col("league") == "BUILDING", 1996).otherwise(1995)).alias("rest_reliable"))


@query()
def w05_elo(spark, sf):
    m = matches(spark, sf).withColumn("level", F.when(F.col("home_id") % 2 == 0, 1).otherwise(2)).withColumn("played", F.col("status") == "played")
    got = elo(m.select("match_id", "league", "season", "level", "day", "home_id", "away_id", "home_goals", "away_goals", "played"), "league")
    return got.select("match_id", r6("home_elo").alias("home_elo"), r6("away_elo").alias("away_elo"), "home_played", "away_played")


@query(f"""WITH {HISTORY},
k AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN substr(o_orderpriority, 1, 1) END AS h FROM hist),
v AS (SELECT * FROM k WHERE h IS NOT NULL),
c AS (SELECT *, CASE WHEN lag(h) OVER w <> h THEN 1 ELSE 0 END AS ch FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM c),
s AS (SELECT *, min(day) OVER (PARTITION BY o_custkey, run) AS st, row_number() OVER (PARTITION BY o_custkey, run ORDER BY day, o_orderkey) AS rk FROM r),
d AS (SELECT o_custkey, day, arg_max(h, o_orderkey) AS h, arg_max(st, o_orderkey) AS st, arg_max(rk, o_orderkey) AS rk FROM s GROUP BY ALL),
p AS (SELECT o_custkey, day, lag(h) OVER w AS ph, lag(st) OVER w AS ps, lag(rk) OVER w AS pn FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day))
SELECT k.o_orderkey, CAST(CASE WHEN k.h IS NULL THEN NULL WHEN p.ph = k.h THEN least(k.day - p.ps, 365) ELSE 0 END AS INT) AS tenure_days, CAST(CASE WHEN k.h IS NULL THEN NULL WHEN p.ph = k.h THEN p.pn ELSE 0 END AS INT) AS rows_in_spell,
  CASE WHEN k.h IS NULL THEN NULL WHEN p.ph = k.h THEN p.pn < 5 ELSE true END AS is_new
FROM k LEFT JOIN p ON p.o_custkey = k.o_custkey AND p.day = k.day AND k.h IS NOT NULL""")
def w10_spells(spark, sf):
    rows = history(spark, sf).withColumn("h", F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1)))
    got = T.spells(rows, "o_custkey", "day", "o_orderkey", "h")
    return got.select("o_orderkey", F.col("tenure_days").cast("int").alias("tenure_days"), F.col("rows_in_spell").cast("int").alias("rows_in_spell"), "is_new")


@query(f"""WITH {LINEUPS} SELECT match_id, team_id, CASE WHEN p IS NOT NULL THEN CAST(len(list_intersect(xi, p)) AS INT) END AS overlap_prev FROM (SELECT *, lag(xi) OVER (PARTITION BY team_id ORDER BY day, match_id) AS p FROM xi)""")
def w11_overlap_previous(spark, sf):
    return T.overlap_previous(lineups(spark, sf), "team_id", ["day", "match_id"], "xi").select("match_id", "team_id", F.col("overlap_prev").cast("int").alias("overlap_prev"))


@query(f"""WITH {LINEUPS},
p AS (SELECT a.match_id, a.team_id, a.season, b.season AS s2, len(list_intersect(a.xi, b.xi)) AS s, row_number() OVER (PARTITION BY a.match_id ORDER BY b.day DESC, b.match_id DESC) - 1 AS rk FROM xi a JOIN xi b ON a.team_id = b.team_id AND b.day < a.day),
v AS (SELECT *, s * (s - 1) / 110.0 AS v FROM p),
g AS (SELECT match_id, sum(v * pow(0.5, rk / 3.0)) / sum(pow(0.5, rk / 3.0)) AS h3, sum(v * pow(0.5, rk / 20.0)) / sum(pow(0.5, rk / 20.0)) AS h20, avg(v) AS hinf, avg(v) FILTER (rk < 10) AS win10, avg(v) FILTER (s2 = season) AS reset FROM v GROUP BY match_id)
SELECT match_id, team_id, round(h3, 6) + 0.0 AS cohesion_h3, round(h20, 6) + 0.0 AS cohesion_h20, round(hinf, 6) + 0.0 AS cohesion_inf, round(win10, 6) + 0.0 AS cohesion_win10, round(reset, 6) + 0.0 AS cohesion_reset FROM xi LEFT JOIN g USING (match_id)""")
def w12_w13_w14_cohesion(spark, sf):
    got = T.cohesion(lineups(spark, sf), "team_id", ["day", "match_id"], "day", "xi", 11, {"cohesion_h3": 3.0, "cohesion_h20": 20.0, "cohesion_inf": None}, season="season")
    return got.select("match_id", "team_id", *(r6(c).alias(c) for c in ("cohesion_h3", "cohesion_h20", "cohesion_inf", "cohesion_win10", "cohesion_reset")))


@query(f"""WITH {LINEUPS}, e AS (SELECT match_id, team_id, day, unnest(xi) AS m FROM xi),
n AS (SELECT *, count(*) OVER (PARTITION BY team_id, m ORDER BY day RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING) AS n FROM e)
SELECT match_id, team_id, count(*) FILTER (n < 3) AS new_members FROM n GROUP BY ALL""")
def w15_new_members(spark, sf):
    return T.new_members(lineups(spark, sf), "team_id", "match_id", "day", "xi").select("match_id", "team_id", "new_members")


@query(f"""WITH {LINEUPS},
p AS (SELECT a.match_id, b.xi AS pxi, row_number() OVER (PARTITION BY a.match_id ORDER BY b.day DESC, b.match_id DESC) AS rk FROM xi a JOIN xi b ON a.team_id = b.team_id AND b.day < a.day),
e AS (SELECT match_id, unnest(pxi) AS m FROM p WHERE rk <= 4),
full_ AS (SELECT match_id FROM p WHERE rk <= 4 GROUP BY match_id HAVING count(*) >= 4),
r AS (SELECT match_id, m FROM e GROUP BY ALL HAVING count(*) >= 2),
g AS (SELECT r.match_id, avg(CASE WHEN list_contains(x.xi, r.m) THEN 0.0 ELSE 1.0 END) AS q FROM r JOIN full_ USING (match_id) JOIN xi x USING (match_id) GROUP BY ALL)
SELECT match_id, team_id, round(q, 6) + 0.0 AS regulars_missing FROM xi LEFT JOIN g USING (match_id)""")
def w18_regulars_missing(spark, sf):
    got = T.regulars_missing(lineups(spark, sf), "team_id", "match_id", "day", "xi", last=4, least=2)
    return got.select("match_id", "team_id", r6("regulars_missing").alias("regulars_missing"))


QUALITY_SQL = f"""WITH {SIDES},
perf AS (SELECT *, 3 + goals_for AS rating, 30 + (match_id % 61) AS minutes FROM sides WHERE status = 'played'),
own AS (SELECT team_id, day, sum(sum(minutes)) OVER w AS m, sum(sum(minutes * rating)) OVER w AS mr FROM perf GROUP BY team_id, day WINDOW w AS (PARTITION BY team_id ORDER BY day)),
pos AS (SELECT round, day, sum(sum(minutes)) OVER w AS m, sum(sum(minutes * rating)) OVER w AS mr FROM perf GROUP BY round, day WINDOW w AS (PARTITION BY round ORDER BY day)),
a AS (SELECT s.*, o.m AS om, o.mr AS omr FROM sides s ASOF LEFT JOIN own o ON s.team_id = o.team_id AND s.day > o.day),
b AS (SELECT a.*, p.m AS pm, p.mr AS pmr FROM a ASOF LEFT JOIN pos p ON a.round = p.round AND a.day > p.day)
SELECT match_id, team_id, round((coalesce(omr, 0) + 772.6 * (pmr / pm)) / (coalesce(om, 0) + 772.6), 6) + 0.0 AS quality FROM b"""


@query(QUALITY_SQL)
def w16_w17_shrunk_quality(spark, sf):
    rows = sides(spark, sf)
    perf = rows.filter("status = 'played'").select("team_id", "round", "day", (F.lit(3) + F.col("goals_for")).alias("rating"), (30 + F.col("match_id") % 61).alias("minutes"))

    def cumulative(key, m, mr):
        daily = perf.groupBy(key, "day").agg(F.sum("minutes").alias("m"), F.sum(F.col("minutes") * F.col("rating")).alias("mr"))
        w = T.W.partitionBy(key).orderBy("day").rowsBetween(T.W.unboundedPreceding, 0)
        return daily.select(key, "day", F.sum("m").over(w).alias(m), F.sum("mr").over(w).alias(mr))

    got = T.strict_asof(rows, cumulative("team_id", "om", "omr"), ["team_id"], "day", ["om", "omr"])
    got = T.strict_asof(got, cumulative("round", "pm", "pmr"), ["round"], "day", ["pm", "pmr"])
    q = (F.coalesce("omr", F.lit(0)) + 772.6 * (F.col("pmr") / F.col("pm"))) / (F.coalesce("om", F.lit(0)) + 772.6)
    return got.select("match_id", "team_id", r6(q).alias("quality"))


@query(f"""WITH {HISTORY}, p AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN substr(o_orderpriority, 1, 1) END AS pos FROM hist),
k AS (SELECT o_custkey, day, arg_max(pos, o_orderkey) AS pos FROM p WHERE pos IS NOT NULL GROUP BY ALL)
SELECT p.o_orderkey, k.pos AS last_known FROM p ASOF LEFT JOIN k ON p.o_custkey = k.o_custkey AND p.day > k.day""")
def w17_last_known_position(spark, sf):
    """The last known value of earlier days, rows without one passed over."""
    rows = history(spark, sf).withColumn("pos", F.when(F.col("o_orderstatus") == "F", F.substring("o_orderpriority", 1, 1)))
    return T.last_known(rows, "o_custkey", "day", "o_orderkey", "pos", "last_known").select("o_orderkey", "last_known")


REPLAYED = (2370, 2371, 2372)


@query(f"""WITH {HISTORY}, x AS (SELECT *, sum(o_totalprice) OVER w AS s, count(*) OVER w AS n FROM hist WINDOW w AS (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, CAST(day AS INT) AS day, round(s / nullif(n, 0), 4) + 0.0 AS form FROM x WHERE day IN {REPLAYED}""")
def x02_x09_replay(spark, sf):
    """Three days played as they came, each from what was known up to it; a second pass reads what the first one kept."""
    rows = history(spark, sf)

    def build(known):
        own = T.before(["o_custkey"], "day", 730)
        return known.withColumn("form", F.sum("o_totalprice").over(own) / F.nullif(F.count("*").over(own), F.lit(0))).select("o_orderkey", "day", "form")

    root = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    version = replay.data_version(rows)
    replay.replay(rows, "day", REPLAYED, build, root, version)
    again = replay.replay(rows, "day", REPLAYED, build, root, version)
    return again.select("o_orderkey", "day", (F.round("form", 4) + 0.0).alias("form"))


@query(f"""WITH {LINEUPS}, b AS (SELECT match_id, team_id, unnest(xi) AS m, day FROM xi) SELECT match_id, team_id, round(CASE WHEN count(*) >= 4 THEN avg((day + 9000 - m * 100) / 365.25) END, 6) + 0.0 AS mean_age FROM b GROUP BY ALL""")
def w19_mean_age(spark, sf):
    each = lineups(spark, sf).select("match_id", "team_id", F.explode("xi").alias("m"), "day")
    return each.groupBy("match_id", "team_id").agg(r6(F.when(F.count("*") >= 4, F.avg((F.col("day") + 9000 - F.col("m") * 100) / 365.25))).alias("mean_age"))


def _last(n, where=""):
    return f"""WITH {SIDES}, h AS (SELECT *, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS points, CASE WHEN goals_for <> 4 THEN goals_for END AS xg FROM sides),
p AS (SELECT a.match_id, a.team_id, b.points, b.goals_for, b.goals_against, b.xg, row_number() OVER (PARTITION BY a.match_id, a.team_id ORDER BY b.day DESC, b.match_id DESC) AS rk FROM h a JOIN h b ON a.team_id = b.team_id AND a.is_home = b.is_home AND b.day < a.day {where})"""


@query(_last(10) + """, g AS (SELECT match_id, team_id, avg(points) AS p, avg(goals_for) AS f, avg(goals_against) AS a FROM p WHERE rk <= 10 GROUP BY ALL)
SELECT match_id, team_id, round(p, 6) + 0.0 AS points_last10, round(f, 6) + 0.0 AS goals_for_last10, round(a, 6) + 0.0 AS goals_against_last10 FROM sides LEFT JOIN g USING (match_id, team_id)""")
def w20_same_venue_form(spark, sf):
    rows = sides(spark, sf).withColumn("points", F.when(F.col("goals_for") > F.col("goals_against"), 3).when(F.col("goals_for") == F.col("goals_against"), 1).otherwise(0))
    rows = rows.select("match_id", "team_id", "is_home", "day", "points", "goals_for", "goals_against")
    got = T.last_rows_mean(rows, ["team_id", "is_home"], "day", "match_id", ["points", "goals_for", "goals_against"], 10)
    return got.select("match_id", "team_id", *(r6(c).alias(c) for c in ("points_last10", "goals_for_last10", "goals_against_last10")))


@query(_last(5, "AND b.xg IS NOT NULL") + """, g AS (SELECT match_id, team_id, avg(xg) AS x FROM p WHERE rk <= 5 GROUP BY ALL)
SELECT match_id, team_id, round(x, 6) + 0.0 AS xg_last5 FROM sides LEFT JOIN g USING (match_id, team_id)""")
def w21_same_venue_xg(spark, sf):
    rows = sides(spark, sf).withColumn("xg", F.when(F.col("goals_for") != 4, F.col("goals_for"))).select("match_id", "team_id", "is_home", "day", "xg")
    return T.last_rows_mean(rows, ["team_id", "is_home"], "day", "match_id", ["xg"], 5).select("match_id", "team_id", r6("xg_last5").alias("xg_last5"))


@query(f"""WITH {SIDES}, d AS (SELECT league, season, team_id, sum(CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END) AS points, sum(goals_for - goals_against) AS diff FROM sides WHERE status = 'played' AND day < 1500 GROUP BY ALL)
SELECT league, season, team_id, CAST(points AS BIGINT) AS points, CAST(diff AS BIGINT) AS diff, CAST(row_number() OVER (PARTITION BY league, season ORDER BY points DESC, diff DESC, team_id) AS INT) AS rank FROM d""")
def w22_a18_standings(spark, sf):
    won = F.when(F.col("goals_for") > F.col("goals_against"), 3).when(F.col("goals_for") == F.col("goals_against"), 1).otherwise(0)
    d = sides(spark, sf).filter("status = 'played' AND day < 1500").groupBy("league", "season", "team_id").agg(F.sum(won).alias("points"), F.sum(F.col("goals_for") - F.col("goals_against")).alias("diff"))
    return d.withColumn("rank", F.row_number().over(T.W.partitionBy("league", "season").orderBy(F.desc("points"), F.desc("diff"), "team_id")))


@query("""SELECT p_partkey, p_brand, round(CASE WHEN v IS NOT NULL THEN 100.0 * (rank() OVER (PARTITION BY p_brand, v IS NOT NULL ORDER BY v) + (count(*) OVER (PARTITION BY p_brand, v) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand, v IS NOT NULL) END, 6) + 0.0 AS pct
FROM (SELECT p_partkey, p_brand, CASE WHEN p_size <> 7 THEN p_size END AS v FROM part)""")
def w24_percentile_rank(spark, sf):
    rows = table(spark, sf, "part").withColumn("v", F.when(F.col("p_size") != 7, F.col("p_size")))
    return T.percentile_rank(rows, ["p_brand"], "v", "pct").select("p_partkey", "p_brand", r6("pct").alias("pct"))


@query(f"""WITH {MATCHES}, r AS (SELECT match_id, league, season, CAST(substr(round, 1, 1) AS INT) + CAST(month(DATE '1995-01-01' + CAST(day AS INT)) AS INT) AS rnd FROM matches),
n AS (SELECT league, season, max(rnd) AS n FROM r GROUP BY ALL), l AS (SELECT league, season, n, lag(n) OVER (PARTITION BY league ORDER BY season) AS prev FROM n)
SELECT match_id, round(least(greatest((rnd - 1.0) / nullif(CASE WHEN season = 2001 THEN coalesce(prev, n) ELSE n END - 1, 0), 0.0), 1.0), 6) + 0.0 AS progress FROM r JOIN l USING (league, season)""")
def w25_season_progress(spark, sf):
    rnd = F.substring("round", 1, 1).cast("int") + F.month(F.date_add(F.to_date(F.lit("1995-01-01")), F.col("day")))
    r = matches(spark, sf).select("match_id", "league", "season", rnd.alias("rnd"))
    n = r.groupBy("league", "season").agg(F.max("rnd").alias("n")).withColumn("prev", F.lag("n").over(T.W.partitionBy("league").orderBy("season")))
    rounds = F.when(F.col("season") == 2001, F.coalesce("prev", "n")).otherwise(F.col("n"))
    progress = F.least(F.greatest((F.col("rnd") - 1.0) / F.nullif(rounds - 1, F.lit(0)), F.lit(0.0)), F.lit(1.0))
    return r.join(n, ["league", "season"]).select("match_id", r6(progress).alias("progress"))


@query("""WITH e AS (SELECT user_id, event_id, value, ts, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS hour FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, hour, max(value) AS value FROM (SELECT user_id, value, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS hour FROM events WHERE event_type = 'purchase') GROUP BY ALL)
SELECT e.event_id, e.user_id, round(r.value, 6) + 0.0 AS last_purchase FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.hour > r.hour""")
def j06_strict_asof(spark, sf):
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    events = table(spark, sf, "events").withColumn("hour", hour)
    left = events.filter("event_type = 'click'").select("event_id", "user_id", "hour")
    right = events.filter("event_type = 'purchase'").select("user_id", "hour", "value")
    return T.strict_asof(left, right, ["user_id"], "hour", ["value"]).select("event_id", "user_id", r6("value").alias("last_purchase"))


@query(f"""WITH {SIDES} SELECT a.match_id, a.team_id, count(b.match_id) AS earlier FROM sides a LEFT JOIN sides b ON a.team_id = b.team_id AND b.day BETWEEN a.day - 30 AND a.day - 1 GROUP BY ALL""")
def j07_band_count(spark, sf):
    return T.count_before(sides(spark, sf), "team_id", "day", F.lit(True), 30, "earlier").select("match_id", "team_id", "earlier")


@query(f"""WITH {SIDES} SELECT league, CAST(least(coalesce(min(CASE WHEN status <> 'played' THEN day END) - 1, 2500), 2500) AS INT) AS complete_until FROM sides WHERE day > 1000 GROUP BY league""")
def w27_x04_freshness(spark, sf):
    from tidemark.streaming.streams import freshness

    got = freshness(sides(spark, sf).filter("day > 1000"), "league", "day", "status", 2500)
    return got.select("league", F.col("complete_until").cast("int").alias("complete_until"))


@query(f"""WITH {SIDES} SELECT DISTINCT team_id FROM sides WHERE day > 1000 AND day < 1010 AND status = 'played'""")
def w28_busy_between(spark, sf):
    return sides(spark, sf).filter("day > 1000 AND day < 1010 AND status = 'played'").select("team_id").distinct()


@query(f"""WITH {MATCHES} SELECT match_id, round(exp(-0.0018 * (2400 - day)), 9) + 0.0 AS w FROM matches WHERE status = 'played'""")
def w29_time_decay_weights(spark, sf):
    return matches(spark, sf).filter("status = 'played'").select("match_id", (F.round(F.exp(-0.0018 * (2400 - F.col("day"))), 9) + 0.0).alias("w"))


@query(f"""WITH {HISTORY} SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, o_orderkey DESC) AS rn FROM hist WHERE day < 2000) WHERE rn <= 5""")
def w23_s17_newest_rows_before(spark, sf):
    w = T.W.partitionBy("o_custkey").orderBy(F.desc("day"), F.desc("o_orderkey"))
    return history(spark, sf).filter("day < 2000").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("o_orderkey", "o_custkey")


@query(f"""WITH {SIDES} SELECT match_id, max(CASE WHEN is_home THEN team_id END) AS home_team_id, max(CASE WHEN NOT is_home THEN team_id END) AS away_team_id, max(CASE WHEN is_home THEN goals_for END) AS home_goals_for, max(CASE WHEN NOT is_home THEN goals_for END) AS away_goals_for FROM sides GROUP BY match_id HAVING count(*) = 2""")
def p01_p02_unpivot_pivot(spark, sf):
    return S.pivot_sides(sides(spark, sf), "match_id", ["team_id", "goals_for"])


@query(f"""WITH {SIDES} SELECT a.match_id, a.team_id, b.goals_for AS opp_goals_for, b.day AS opp_day FROM sides a JOIN sides b ON a.match_id = b.match_id AND a.is_home <> b.is_home""")
def p03_j05_opponent(spark, sf):
    return S.with_opponent(sides(spark, sf), "match_id", ["goals_for", "day"]).select("match_id", "team_id", "opp_goals_for", F.col("opp_day").cast("long").alias("opp_day"))
