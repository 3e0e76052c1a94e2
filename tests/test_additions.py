"""Mixtures, boosted trees, running totals, confirmed pairs, lists, lookups, upserts, decisions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.models import groups, trees
from tidemark.operators import lookup, resolve, scoring, temporal
from tidemark.sources import store
from tidemark.streaming import streams


def test_mixtures_find_the_blobs_and_assign_new_rows(spark):
    draw = np.random.default_rng(3)
    centres = np.array([[0.0, 0.0], [8.0, 0.0], [0.0, 9.0]])
    rows = [(i, *map(float, centres[i % 3] + draw.normal(0, 0.5, 2))) for i in range(300)]
    df = spark.createDataFrame([*rows, (300, None, 9.0)], "id int, x double, y double")
    model = groups.mixtures(df, ["x", "y"])
    assert sorted(model.bic) == list(range(2, 9)) and model.best == 3
    got = {r["id"]: r for r in model.assign(df).collect()}
    assert len(got) == 301 and got[300]["x"] is None
    for c in range(3):
        assert len({got[i]["cluster"] for i in range(c, 300, 3)}) == 1
    new = model.assign(spark.createDataFrame([(8.1, 0.2, "a")], "x double, y double, note string")).first()
    assert new["cluster"] == got[1]["cluster"] and new["note"] == "a" and new["probability"] > 0.99
    assert model.assign(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="too few"):
        groups.mixtures(df.limit(49), ["x", "y"])


def test_mixture_step_is_that_of_whole_data(spark):
    """Likelihoods do not depend on how rows are dealt to tasks."""
    draw = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(map(float, draw.normal(0, 1, 3))) for _ in range(200)], "a double, b double, c double")
    one, many = (groups.mixtures(df.repartition(n), ["a", "b", "c"], (2, 3), steps=8) for n in (1, 7))
    for k in (2, 3):
        assert one.bic[k] == pytest.approx(many.bic[k], rel=1e-9)


def test_boosted_cells_equal_rows(spark):
    """Sums by cell give the trees that sums by row would: a cut that splits the data is found, nulls lie in the lowest bin."""
    draw = random.Random(1)
    rows = [(x, draw.random(), 1.0 if x <= 0.5 else 4.0) for x in [draw.random() for _ in range(600)]] + [(None, 0.5, 1.0), (0.1, 0.1, None)]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    model = trees.fit(df, ["x", "z"], "y", trees=25, depth=1, rate=0.3)
    assert all(t[0]["feature"] == "x" for t in model.trees[:3])
    near = df.filter("y is not null and abs(x - 0.5) > 0.05").select(F.max(F.abs(F.exp(model.score()) - F.col("y"))).alias("e")).first()["e"]
    assert near < 0.15
    assert df.filter("x is null").select(F.exp(model.score()).alias("m")).first()["m"] < 1.5


@pytest.mark.parametrize("reach", [None, 0, 3, 730])
def test_running_totals_equal_the_window(spark, reach):
    draw = random.Random(reach or 7)
    rows = [(draw.randrange(3), draw.randrange(900), draw.choice([None, 1.5, -2.0])) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e int, day int, v double")
    got = df.select("i", temporal.total_before(F.sum, F.col("v"), ["e"], "day", reach).alias("s"), temporal.total_before(F.count, F.col("v"), ["e"], "day", reach).alias("n")).collect()
    for r in got:
        e, day, _ = rows[r["i"]]
        seen = [v for f, d, v in rows if f == e and d < day and (reach is None or d >= day - reach) and v is not None]
        assert r["n"] == len(seen) and r["s"] == pytest.approx(sum(seen))


def test_decayed_mean_without_rows_in_reach_is_null(spark):
    df = spark.createDataFrame([("a", "l", 0, 5.0), ("a", "l", 9, 7.0), ("a", "l", 1000, 1.0)], "e string, l string, day int, v double")
    got = {r["day"]: (r["ewm"], r["ewm_weight"]) for r in temporal.decayed_mean(df, "e", ["l"], "day", "v", 30.0, 100).collect()}
    assert got[0] == got[1000] == (None, 0.0) and got[9][0] == pytest.approx(5.0)


def test_found_pairs_are_confirmed_and_wrong_ones_refused(spark):
    teams, r = list("abcdefgh"), random.Random(2)
    rows = [(d, *r.sample(teams, 2)) for d in range(120)]
    a = spark.createDataFrame(rows, "day int, home string, away string")
    b = spark.createDataFrame([(d + (d % 9 == 0), h.upper(), w.upper()) for d, h, w in rows] + [(5000, "A", "B")], a.schema)
    found = resolve.match_schedules(a, b)
    assert {(x["a"], x["b"]) for x in found.collect()} == {(t, t.upper()) for t in teams}
    good = resolve.confirmed(a, b, found).collect()
    assert len(good) == 8 and all(x["confirmed"] and x["share"] == 1.0 for x in good)
    swapped = found.filter("a not in ('a', 'h')").unionByName(spark.createDataFrame([("a", "B")], "a string, b string"))
    got = {x["a"]: x for x in resolve.confirmed(a, b, swapped).collect()}
    pair = {t: t.upper() for t in teams if t not in "ah"} | {"a": "B"}
    there = {(d + (d % 9 == 0), h.upper(), w.upper()) for d, h, w in rows}
    for t in teams:
        want = sum(any((d + k, pair.get(h), pair.get(w)) in there for k in (-1, 0, 1)) for d, h, w in rows if t in (h, w))
        assert got[t]["ok"] == want
    assert got["a"]["share"] < 0.1 and not got["a"]["confirmed"]
    assert got["h"]["b"] is None and not got["h"]["confirmed"]
    assert sum(x["played"] for x in got.values()) == 240
    assert resolve.confirmed(a.limit(0), b, found).count() == 0


def test_shared_letters_bound_the_ratio(spark):
    names = ["real madrid", "madrid real", "inter", "", "aaa", "aab 1"]
    pairs = spark.createDataFrame([(x, y) for x in names for y in names], "a string, b string")
    got = pairs.select(resolve.shared_letters("a", "b").alias("s"), (F.length("a") + F.length("b")).alias("n"), text.matching_ratio("a", "b").alias("r")).collect()
    assert all(2 * x["s"] >= x["r"] * x["n"] - 1e-9 for x in got if x["n"])


def test_lists_and_ordered_lookups(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    for listed in (0, 1000):
        assert [r["v"] for r in lookup.among(df, "k", [2, 2, None, 9], listed).collect()] == ["y"]
        assert lookup.among(df, "v", [], listed).count() == 0
    wanted = spark.createDataFrame([(0, 2), (1, 1), (2, 2)], "p int, k int")
    assert [r["v"] for r in lookup.looked_up(wanted, df, "k", "p").collect()] == ["y", "x", "y"]
    more = wanted.unionByName(spark.createDataFrame([(3, 7), (4, None)], wanted.schema))
    assert [r["v"] for r in lookup.looked_up(more, df, "k", "p", strict=False).collect()] == ["y", "x", "y", None, None]
    with pytest.raises(Exception, match="no k 7|no k null"):
        lookup.looked_up(more, df, "k", "p").collect()


def test_upserts_keep_other_columns_and_lose_no_writer(spark, tmp_path):
    root = str(tmp_path / "store")
    one = spark.createDataFrame([(1, "a", 1.0), (None, "n", 2.0)], "k int, note string, score double")
    store.upsert(spark, root, "t", one, ["k"])
    two = spark.createDataFrame([(1, 5.0), (1, 4.0), (2, 6.0), (None, 7.0)], "k int, score double")
    other = spark.createDataFrame([(3, 3.0)], two.schema)
    store.upsert(spark, root, "t", two, ["k"], before=lambda: store.upsert(spark, root, "t", other, ["k"]))
    got = {r["k"]: (r["note"], r["score"]) for r in store.read_table(spark, root, "t").collect()}
    assert got == {1: ("a", 5.0), None: ("n", 7.0), 2: (None, 6.0), 3: (None, 3.0)}
    assert {r["status"]: r["count"] for r in store.runs(spark, root).groupBy("status").count().collect()} == {"ok": 3, "failed": 1}


def test_a_repeated_batch_refuses_once(spark, tmp_path):
    write = streams.idempotent_sink(str(tmp_path), ["k"], ("made", "limit"))
    df = spark.createDataFrame([(1, 5, 9), (2, 9, 9)], "k int, made int, limit int")
    for _ in range(2):
        write(df, 4)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 1
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "refused")).collect()] == [(2, 9, 9, 4)]


def test_decided_like_the_rule(spark):
    cases = [(2, 2, 1.0, 1.0, 0.0, 1.0), (4, 3, 0.01, 0.02, 0.005, 1.0), (4, 3, -0.01, 0.02, 0.0, 1.0), (4, 2, 0.01, 0.02, 0.0, 1.0), (4, 3, 0.01, 0.02, 0.006, 1.0), (4, 3, 0.01, 0.02, 0.0, 1.2)]
    df = spark.createDataFrame(cases, "f int, p int, l double, m double, g double, s double")
    got = df.select("*", scoring.decided(*map(F.col, "fplmgs")).alias("d")).collect()
    assert all(r["d"] == scoring.decision(*(r[c] for c in "fplmgs")) for r in got)
    unknown = spark.createDataFrame([(4, 3, None, 1.0, 0.0, 1.0)], df.schema)
    assert unknown.select(scoring.decided(*map(F.col, "fplmgs")).alias("d")).first()["d"] == "keep"


def test_canonical_json_sorts_and_keeps_nulls(spark):
    got = spark.range(1).select(text.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")}).alias("j")).first()["j"]
    assert got == '{"a":null,"b":1}'
