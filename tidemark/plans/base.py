"""The driver's tables as contests, sides, sets and histories, in Spark and in SQL.

A contest is an order with two lines from different suppliers: the suppliers of its first two lines are the sides, their
quantities modulo five the goals, the customer's segment the league. These are stand-ins with the right shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sides import unpivot_sides

EPOCH = "1995-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Rounded to six places, without a negative zero: what both engines agree on."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def day_of(c: str) -> Column:
    return F.datediff(F.to_date(c), F.to_date(F.lit(EPOCH)))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q"))
    two = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(line)), 1, 2).alias("two")).filter("size(two) = 2")
    a, b = F.col("two")[0], F.col("two")[1]
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        orders.join(two, F.col("o_orderkey") == F.col("l_orderkey")).filter(a["l_suppkey"] != b["l_suppkey"])
        .select(
            F.col("o_orderkey").alias("match_id"), day_of("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), F.col("c_mktsegment").alias("league"), F.col("o_orderpriority").alias("round"),
            a["l_suppkey"].alias("home_id"), b["l_suppkey"].alias("away_id"), (a["q"] % 5).alias("home_goals"), (b["q"] % 5).alias("away_goals"),
            F.when(F.col("o_orderstatus") == "F", "played").when(F.col("o_orderstatus") == "P", "postponed").otherwise("scheduled").alias("status"), F.col("o_totalprice").alias("price"),
        )
    )


MATCHES = """
lines AS (SELECT l_orderkey, l_suppkey, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(l_quantity AS INT)) AS rn FROM lineitem),
matches AS (
  SELECT o_orderkey AS match_id, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, CAST(year(o_orderdate) AS INT) AS season, c_mktsegment AS league, o_orderpriority AS round,
    a.l_suppkey AS home_id, b.l_suppkey AS away_id, a.q % 5 AS home_goals, b.q % 5 AS away_goals,
    CASE o_orderstatus WHEN 'F' THEN 'played' WHEN 'P' THEN 'postponed' ELSE 'scheduled' END AS status, o_totalprice AS price
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lines a ON a.l_orderkey = o_orderkey AND a.rn = 1 JOIN lines b ON b.l_orderkey = o_orderkey AND b.rn = 2
  WHERE a.l_suppkey <> b.l_suppkey)"""

SHARED = ["match_id", "day", "season", "league", "round", "status"]
PAIRS = {"team_id": ("home_id", "away_id"), "opp_id": ("away_id", "home_id"), "goals_for": ("home_goals", "away_goals"), "goals_against": ("away_goals", "home_goals")}


def sides(spark: SparkSession, sf: str) -> DataFrame:
    return unpivot_sides(matches(spark, sf), SHARED, PAIRS)


SIDES = (
    MATCHES
    + """,
sides AS (
  SELECT match_id, day, season, league, round, status, true AS is_home, home_id AS team_id, away_id AS opp_id, home_goals AS goals_for, away_goals AS goals_against FROM matches
  UNION ALL
  SELECT match_id, day, season, league, round, status, false, away_id, home_id, away_goals, home_goals FROM matches)"""
)


def lineups(spark: SparkSession, sf: str) -> DataFrame:
    """Sets of parts (modulo 40) of an order, as a customer's line-ups over time."""
    parts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set((F.col("l_partkey") % 40).cast("long"))).alias("xi"))
    return table(spark, sf, "orders").join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("team_id"), day_of("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), "xi")


LINEUPS = """
xi AS (SELECT o_orderkey AS match_id, o_custkey AS team_id, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, CAST(year(o_orderdate) AS INT) AS season, xi
  FROM orders JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey % 40)) AS xi FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders over time."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("o_orderkey", "o_custkey", day_of("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), "c_mktsegment", "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")


HISTORY = """
hist AS (SELECT o_orderkey, o_custkey, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day, CAST(year(o_orderdate) AS INT) AS season, c_mktsegment, o_orderpriority, o_orderstatus, o_totalprice, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL if it has one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add
