"""S-, K-, Q-: files, refreshes and manifests, over files that Spark writes from the given tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.base import query, table
from tidemark.session import shared_folder
from tidemark.sources import lines, raw, snapshot, store


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT o_orderkey::VARCHAR AS orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority, CASE WHEN year(o_orderdate) >= 1997 THEN o_orderstatus END AS status,
CASE WHEN year(o_orderdate) % 2 = 0 THEN 'iso-8859-1' ELSE 'utf-8' END AS encoding FROM orders WHERE o_orderkey % 7 <> 0""")
def s06_numbered_csv(spark, sf):
    """Orders as yearly CSV files, headers drifting and every second year in Latin-1, read again; undated lines go."""
    path = folder(spark, "yearly-csv")
    date = F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yy"))
    late = F.year("o_orderdate") >= 1997
    body = F.concat_ws(",", date, F.col("o_orderkey").cast("string"), F.concat(F.lit("Málaga "), "o_orderpriority"), F.when(late, F.col("o_orderstatus")))
    orders = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.lit(1).alias("o"), body.alias("value"), "o_orderkey")
    header = orders.select("year").distinct().select("year", F.lit(0).alias("o"), F.when(F.col("year") >= 1997, "Date,Key,Priority,Status").otherwise("Date,Key,Priority").alias("value"), F.lit(0).cast("long").alias("o_orderkey"))
    every = header.unionByName(orders).repartition(8, "year").sortWithinPartitions("year", "o", "o_orderkey")
    for encoding, even in (("iso-8859-1", True), ("utf-8", False)):
        some = every.filter((F.col("year") % 2 == 0) == even).select("year", "value")
        some.write.mode("append").partitionBy("year").option("encoding", encoding).option("header", False).option("quote", "").option("sep", "\t").csv(path)
    got = lines.read_numbered_csv(spark, f"{path}/*/*.csv")
    return got.select(F.col("Key").alias("orderkey"), F.col("day").cast("string").alias("day"), F.regexp_replace("Priority", "^Málaga ", "").alias("priority"), F.col("Status").alias("status"), "encoding")


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation UNION ALL SELECT 1000)
SELECT k::INT AS nation, CASE WHEN k = 1000 THEN 'missing' WHEN k % 7 = 3 THEN 'unlisted' WHEN k % 5 = 1 THEN 'differs' ELSE 'ok' END AS status FROM n WHERE k = 1000 OR k IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT -1, 'bad lines ' || 2""")
def s14_k14_q15_manifest(spark, sf):
    """Suppliers as a file for each nation against a manifest with wrong, lacking, superfluous and unreadable lines."""
    root = folder(spark, "nations")
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.concat_ws("|", "s_suppkey", "s_name").alias("value"), "s_suppkey")
    rows.repartition(8, "nation").sortWithinPartitions("nation", "s_suppkey").select("nation", "value").write.partitionBy("nation").text(f"{root}/raw")
    name = lines.relative(F.col("path"), root)
    listed = raw.checksums(spark, f"{root}/raw/*/*.txt").select(name.alias("file"), "sha256").withColumn("k", F.regexp_extract("file", "nation=([0-9]+)", 1).cast("int")).filter("k % 7 <> 3")
    entries = listed.select(F.to_json(F.struct("file", F.when(F.col("k") % 5 == 1, "0").otherwise(F.col("sha256")).alias("sha256"))).alias("value"))
    more = spark.createDataFrame([(json.dumps({"file": "raw/nation=1000/gone.txt", "sha256": "0"}),), ("",), ('{"file": "raw/na',), ("?",)], "value string")
    entries.unionByName(more).coalesce(1).write.text(f"{root}/manifest")
    good, bad = lines.read_manifest_lines(spark, f"{root}/manifest/*.txt", "file string, sha256 string")
    found = lines.compared(spark, root, good, "raw/*/*.txt").select(F.regexp_extract("file", "nation=([0-9]+)", 1).cast("int").alias("nation"), "status")
    return found.unionByName(bad.agg(F.count("*").alias("n")).select(F.lit(-1).alias("nation"), F.concat(F.lit("bad lines "), "n").alias("status")))


@query("""SELECT n_nationkey::INT AS nation FROM nation WHERE n_nationkey % 7 = 3 AND n_nationkey IN (SELECT s_nationkey FROM supplier)""")
def k03_manifest_rebuilt(spark, sf):
    """The files that a manifest lacks, found by an anti-join on checksummed files."""
    root = folder(spark, "nations")
    table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("value")).repartition(8, "nation").write.partitionBy("nation").text(f"{root}/raw")
    files = raw.checksums(spark, f"{root}/raw/*/*.txt").select(lines.relative(F.col("path"), root).alias("file"))
    nation = F.regexp_extract("file", "nation=([0-9]+)", 1).cast("int")
    return lines.rebuilt(spark, root, files.filter(nation % 7 != 3), "raw/*/*.txt").select(nation.alias("nation"))


@query("""SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'runs ok', 2 UNION ALL SELECT 'runs failed', 1""")
def k01_k04_k06_refresh(spark, sf):
    """Two tables refreshed together, a refresh that a check refuses, a refresh of one: what readers see, and the run log."""
    root = folder(spark, "store")
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    store.refresh(spark, root, {"nation": nation, "supplier": supplier})

    def full(name: str, figures: dict) -> None:
        if name == "supplier" and figures["rows"] == 0:
            raise ValueError("an empty table")

    try:
        store.refresh(spark, root, {"nation": nation.limit(1), "supplier": supplier.limit(0)}, full)
    except ValueError as e:
        if "empty table" not in str(e):
            raise
    store.refresh(spark, root, {"supplier": supplier.filter("s_suppkey % 2 = 0")})
    seen = None
    for name in ("nation", "supplier"):
        one = store.read_table(spark, root, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        seen = one if seen is None else seen.unionByName(one)
    return seen.unionByName(store.runs(spark, root).groupBy(F.concat(F.lit("runs "), "status").alias("name")).agg(F.count("*").alias("n")))


@query("""SELECT o_orderpriority AS version, count(*) AS orders, o_orderpriority = (SELECT max(o_orderpriority) FROM orders) AS active FROM orders GROUP BY o_orderpriority""")
def k10_model_registry(spark, sf):
    """A model for each priority registered in order, each made active in turn: the last one alone is."""
    root = folder(spark, "models")
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy("o_orderpriority")
    for r in counts.collect():  # five rows
        state = store.register(spark, root, r["o_orderpriority"], {"orders": r["n"]}, f"{root}/{r['o_orderpriority']}", activate=True)
    return spark.createDataFrame([(v, m["card"]["orders"], v == state["active"]) for v, m in state["models"].items()], "version string, orders long, active boolean")


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN '2000-07-01' WHEN 'O' THEN '2001-07-01' ELSE '2002-07-01' END AS day, count(*) AS rows, CAST(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END AS INT) AS place FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_orderstatus""")
def s13_snapshot_listing(spark, sf):
    """Three snapshots written, listed newest first."""
    root = folder(spark, "snapshots")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for day, status in (("2001-07-01", "O"), ("2002-07-01", "P"), ("2000-07-01", "F")):
        snapshot.write_snapshot(orders.filter(F.col("o_orderstatus") == status), root, day)
    # as many rows as there are snapshots
    return snapshot.list_snapshots(spark, root).select("day", "rows", F.row_number().over(W.orderBy(F.desc("day"), "version")).alias("place"))


@query("""SELECT c_custkey, CAST(1 AS INT) AS as_of, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS DOUBLE) ELSE c_acctbal END AS score FROM customer
UNION ALL SELECT c_custkey, 2, NULL, CAST(c_custkey AS DOUBLE) FROM customer WHERE c_custkey % 5 = 0""")
def k12_score_upserts(spark, sf):
    """Scores by customer and day: some replaced, their other columns kept, and those of a new day added."""
    root = folder(spark, "scores")
    c = table(spark, sf, "customer").select("c_custkey", F.lit(1).alias("as_of"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("score"))
    store.upsert(spark, root, "scores", c, ["c_custkey", "as_of"])
    key = F.col("c_custkey")
    new = c.filter(key % 3 == 0).select("c_custkey", "as_of", key.cast("double").alias("score")).unionByName(c.filter(key % 5 == 0).select("c_custkey", F.lit(2).alias("as_of"), key.cast("double").alias("score")))
    store.upsert(spark, root, "scores", new, ["c_custkey", "as_of"])
    return store.read_table(spark, root, "scores")
