"""Findings of round 3: steps that grew faster than their input, and what they must still give."""

import math
import random
import re
import time

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import prob
from tidemark.llm import bpe, common, ngramjoin, packing
from tidemark.llm import quality as llm_quality
from tidemark.operators import lookup, protocol, quality, ratings, resolve, stats, temporal
from tidemark.plans import base, learning


@pytest.mark.parametrize("block", [1 << 22, 40])
def test_seed_of_schedules_makes_no_pairs(spark, monkeypatch, block):
    """entities of equal or similar sets, in one block and in many, against all pairs; no join is on the tokens."""
    monkeypatch.setattr(resolve, "BLOCK_TOKENS", block)
    r = random.Random(5)
    base = [r.sample(range(60), 12) for _ in range(8)]
    sets = {name: [] for name in "ab"}
    for name in sets:
        for i in range(30):
            kept = [t for t in base[i % 8] if i < 8 or r.random() < 0.9]
            sets[name] += [(f"{name}{i}", t) for t in (kept if i < 24 else r.sample(range(60), 5)) + ([99] if i < 3 else [])]
    sets["a"] += [("twin1", 70), ("twin2", 70), ("alone", 71), (None, 71)]
    sets["b"] += [("twin", 70), ("both1", 72), ("both2", 72), ("own", 71)]
    a, b = (spark.createDataFrame(sets[k], f"{k} string, t int") for k in "ab")
    for least, ratio in ((0.6, 1.5), (0.5, 1.0), (0.6, 1.05)):
        want = {tuple(x) for x in resolve.mutual_best(resolve.set_jaccard(a, b, "a", "b", "t"), "a", "b", "jaccard", least, ratio).collect()}
        got = resolve.mutual_jaccard(a, b, "a", "b", "t", least, ratio)
        assert {tuple(x) for x in got.collect()} == want
        assert ("alone", "own", 1.0) in want and not {x for x in want if x[0].startswith("twin")}
        assert " t#" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert resolve.mutual_jaccard(a.limit(0), b, "a", "b", "t").count() == 0


def test_best_two_keeps_ties_and_copies():
    left = [np.array([1, 2, 3]), np.array([7]), np.array([9])]
    right = [np.array([1, 2, 3, 4]), np.array([1, 2, 3, 5]), np.array([7]), np.array([8])]
    best, score, after = resolve.best_two(left, right, np.array([False, False, True, False]), 0.4)
    assert best.tolist() == [0, 2, -1] and score.tolist() == [0.75, 1.0, 0.0] and after.tolist() == [0.75, 1.0, 0.0]


def test_elo_passes_in_pieces(monkeypatch):
    """a long ladder is rated a few days at a time and a few settings at a time, whatever the batches; as all in one."""
    days = np.repeat(np.arange(40), r := 5)
    g = np.random.default_rng(3)
    rows = pd.DataFrame({"match_id": np.arange(len(days)), "season": 2000 + days // 15, "level": g.integers(1, 3, len(days)), "day": days, "home_id": g.integers(0, 9, len(days)), "away_id": g.integers(9, 14, len(days))})
    rows = rows.assign(home_goals=g.integers(0, 4, len(days)), away_goals=g.integers(0, 4, len(days)), played=g.random(len(days)) < 0.9)
    grid = [{"k": 10.0 + k, "regress": 0.1 * k, "gap": 50.0 * k} for k in range(5)]
    _, want = ratings.Ladder(grid).play(rows)
    monkeypatch.setattr(ratings, "SETTINGS", 2)
    monkeypatch.setattr(ratings, "CELLS", 2 * 2 * r)
    seen = []

    def told(part, before, first):
        seen.append(len(part))
        return pd.DataFrame({"match_id": part["match_id"], "first": first, "home": list(before[0]), "away": list(before[1])})

    keyed = pd.concat([rows.assign(__ladder=x, __first=f) for x in ("A", "B", None) for f in (0, 2, 4)], ignore_index=True)
    for size in (1, 7, 1000):
        got = pd.concat(ratings.played_through((keyed[i : i + size] for i in range(0, len(keyed), size)), "day", grid, told))
        assert len(got) == len(keyed)
        for first, part in got.groupby("first"):
            for side, whole in (("home", want[0]), ("away", want[1])):
                assert np.allclose(np.stack(part[side].to_list()), np.tile(whole[:, first : first + 2], (3, 1)), rtol=0, atol=1e-9)
    assert max(seen) <= 2 * r


def test_ordered_bins_divide_once(spark):
    """what ranks and what counts a range must be the same ranges, also where wide rows make more of them than narrow ones."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        rows = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(1000)).alias("e"), "id", F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        got = {r["id"]: r["bin"] for r in stats.ordered_bins(rows.repartition(8, "id"), ["e", "id"], 7).collect()}
        order = sorted((r["e"], r["id"]) for r in rows.select("e", "id").collect())
        assert got == {i: k * 7 // len(order) for k, (_, i) in enumerate(order)}
        ids = [r["n"] for r in lookup.surrogate_ids(rows, "id", "n").orderBy("id").collect()]
        assert ids == list(range(1, 20_001))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_same_values_allow_for_rounding(spark):
    """what differs by the order of addition alone is the same; what one side lacks, or has null, isn't."""
    kind = "k int, v double"
    a = spark.createDataFrame([(1, 150000.123456), (2, None), (3, 1.0), (4, 2.0), (5, None)], kind)
    b = spark.createDataFrame([(1, 150000.123457), (2, None), (3, 1.001), (5, 7.0), (6, None)], kind)
    assert {r["k"] for r in quality.same_values(a, b, ["k"], "v", 1e-4).collect()} == {3, 4, 5, 6}


def test_gamma_tail_stops_when_done():
    """the tail takes the rounds that its rows need, not 250 of each, and keeps its value."""
    k, x = np.meshgrid(np.arange(1, 9), np.r_[0.0, 0.01, 0.5, np.arange(1.0, 76.0)])
    k, x = k.ravel().astype(float), x.ravel()
    want = [math.exp(-v) * sum(v**i / math.factorial(i) for i in range(int(n))) for n, v in zip(k, x, strict=True)]
    lg = np.array([math.lgamma(n) for n in k])
    assert np.allclose(prob._gamma_tails(k, x, lg, 250), want, rtol=1e-12, atol=1e-14)
    half = prob._gamma_tails(np.full(60, 0.5), x[:480:8] / 2, np.full(60, math.lgamma(0.5)), 250)
    assert np.allclose(half, [math.erfc(math.sqrt(v / 2)) for v in x[:480:8]], rtol=1e-11, atol=1e-14)
    assert np.isnan(prob._gamma_tails(np.array([np.nan, 1.0]), np.array([1.0, np.nan]), np.zeros(2), 250)).all()
    began = time.perf_counter()
    prob._gamma_tails(np.full(100_000, 4.0), np.full(100_000, 30.0), np.full(100_000, math.lgamma(4.0)), 100_000)
    assert time.perf_counter() - began < 30


def test_summary_of_corrected_joint(spark):
    """F8: moments made in arrays equal those of the matrix, also where a corrected cell would be negative."""
    rows = spark.createDataFrame([(0.8, 0.6, -0.05), (3.0, 2.5, 0.9), (0.1, 4.0, -0.9), (0.0, 1.0, 0.1), (None, 1.0, 0.1)], "x double, y double, r double")
    got = rows.select(prob.corrected_joint(F.col("x"), F.col("y"), F.col("r"), 11).alias("j"), prob.corrected_summary(F.col("x"), F.col("y"), F.col("r"), 11).alias("s")).collect()
    for j, s in got[:4]:
        p, k = np.array(j), np.arange(11)
        want = [p[0, 0], p[0, 1], p[1, 0], p[1, 1], p.sum(), k @ p.sum(axis=1), k @ p.sum(axis=0), (p * p).sum()]
        assert list(s) == pytest.approx(want, abs=1e-12)
    assert got[4]["s"] is None or all(v is None for v in got[4]["s"])


def test_components_join_few_links(spark, monkeypatch):
    """Checks of op5_linededup and pipeline: each text of a large group links with many of its members, and chains run across;
    the stars are made over the links that remain between least neighbours, and every component is found."""
    r = random.Random(11)
    ends = [-1000 + i for i in range(20)]
    links = [(x, e) for x in range(400) for e in r.sample(ends, 15)] + [(e, ends[0]) for e in ends[1:]]
    links += [(1000 + i, 1001 + i) for i in range(40)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(150)] + [(5, 5), (9000, 9000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(links, "a long, b long")
    own, left = ngramjoin.merged(df)
    assert own.count() == len(root) and left.count() < len(set(links)) / 20
    got, held = ngramjoin.components(df)
    assert {x["node"]: x["comp"] for x in got.collect()} == {x: find(x) for x in root}
    assert ngramjoin.components(df.limit(0))[0].count() == 0


def test_walk_forward_joins_nothing(spark):
    """means of all models stand in one row, so predictions are neither joined nor sorted; rows that a model leaves out are
    left out of all, and no mean may read a target."""
    data = [(i, 2000 + i % 4, float(i % 7), None if i % 5 == 0 else float(i % 3)) for i in range(80)] + [(None, 2003, 1.0, 1.0)]
    rows = spark.createDataFrame(data, "id int, season int, y double, x double")
    mean = lambda train: float(train.agg(F.avg("y")).first()[0])
    models = {"all": protocol.Model(lambda train, s: F.lit(mean(train))), "x": protocol.Model(lambda train, s: F.col("x") + s["k"] * mean(train), (("k", (0.5, 1.0)),))}
    got = protocol.walk_forward(rows, models, protocol.folds(2000, [2002, 2003]), "id", "y")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for valid in (2002, 2003):
        train = [r for r in data if r[1] < valid]
        m = np.mean([r[2] for r in train])
        inner, last = [r for r in train if r[1] < valid - 1], [r for r in train if r[1] == valid - 1 and r[3] is not None]
        loss = lambda k: np.mean([max(r[3] + k * np.mean([q[2] for q in inner]), 1e-9) - r[2] * np.log(max(r[3] + k * np.mean([q[2] for q in inner]), 1e-9)) for r in last])  # noqa: E731, B023
        k = min((0.5, 1.0), key=loss)
        want |= {(n, valid, r[0], round(float(v), 9), r[2]) for r in data if r[0] is not None and r[1] == valid and r[3] is not None for n, v in (("all", m), ("x", r[3] + k * m))}
    assert {(r["model"], r["fold"], r["id"], round(r["mean"], 9), r["target"]) for r in got.collect()} == want
    with pytest.raises(Exception, match="y"):
        protocol.walk_forward(rows, {"sees": protocol.Model(lambda train, s: F.col("y"))}, protocol.folds(2000, [2003]), "id", "y")


@pytest.mark.parametrize("size", [1, 3, 64])
def test_rolling_means_pass_in_batches(size):
    """rows pass in order, a few at a time; what is carried is the open key's last values, so days, keys and nulls may fall on
    any edge of a batch."""
    r = random.Random(size)
    rows = sorted(((r.choice(["a", "b", "c"]), r.random() < 0.5, r.randrange(12)) for _ in range(150)), key=lambda x: x)
    rows = [(*x, i, None if r.random() < 0.3 else float(r.randrange(9))) for i, x in enumerate(rows)] + [(None, True, 3, 150, 1.0), (None, True, 4, 151, 2.0)]
    table = pa.table(dict(zip(["k", "home", "day", "id", "x"], map(list, zip(*rows, strict=True)), strict=True)))
    got = pa.Table.from_batches(temporal.rolling_means(iter(table.to_batches(max_chunksize=size)), ["k", "home"], "day", {"x": "m"}, 4)).to_pylist()
    for row in got:
        past = [q[4] for q in rows if q[:2] == (row["k"], row["home"]) and q[2] < row["day"] and q[4] is not None][-4:]
        assert row["m"] == (pytest.approx(sum(past) / len(past)) if past and row["k"] else None)


def test_last_rows_mean_sorts_once(spark):
    rows = spark.createDataFrame([(1, 1, 1, 4.0), (1, 2, 2, None), (1, 2, 3, 2.0), (1, 5, 4, 9.0), (2, 5, 5, 1.0), (None, 6, 6, 1.0), (1, 6, 7, 0.0)], "k int, day int, id int, x double")
    got = temporal.last_rows_mean(rows, ["k"], "day", "id", ["x"], 2)
    assert {r["id"]: r["x_last2"] for r in got.collect()} == {1: None, 2: 4.0, 3: 4.0, 4: 3.0, 5: None, 6: None, 7: 5.5}
    assert got.columns == [*rows.columns, "x_last2"] and "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_outcomes_of_corrected_joint(spark):
    """outcomes made in arrays equal those of the matrix; nulls give nulls."""
    rows = spark.createDataFrame([(0.8, 0.6, -0.05), (3.0, 2.5, 0.9), (0.1, 4.0, -0.9), (0.0, 1.0, 0.1), (None, 1.0, 0.1)], "x double, y double, r double")
    x, y, rho = map(F.col, "xyr")
    got = rows.select("x", F.when(x.isNotNull(), prob.outcomes(prob.corrected_joint(x, y, rho, 11))).alias("j"), prob.corrected_outcomes(x, y, rho, 11).alias("o")).collect()
    for i, j, o in got:
        if i is not None:
            assert list(o) == pytest.approx(list(j), abs=1e-12)
        else:
            assert o is None or all(v is None for v in o)


def test_score_queries_read_contests_once(spark, sf, monkeypatch):
    """contests are built from lines and orders once a query, however often they are read again."""
    made = []
    monkeypatch.setattr(learning, "matches", lambda *a: made.append(1) or base.matches(*a))
    for name in ("g03_decay_search", "g05_exact_scores"):
        made.clear()
        plan = getattr(learning, name)(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert len(made) == 1 and "l_orderkey" not in plan


def test_quality_broadcasts_are_as_large_as_their_rows(spark, sf, monkeypatch):
    """Check of pipeline: a table broadcast by a key that isn't one long holds a whole memory page in each executor."""
    plans, keep = [], llm_quality.saved
    monkeypatch.setattr(llm_quality, "saved", lambda df, name: plans.append(df) or keep(df, name))
    plans.append(llm_quality.keep_good(spark.read.parquet(f"{sf}/documents.parquet")))
    text = "\n".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    keys = re.findall(r"HashedRelationBroadcastMode\(List\((.*?)\),", text)
    assert len(keys) >= 8
    assert {re.sub(r"input\[\d+, (\w+), \w+\]", r"\1", k) for k in keys} == {"bigint"}


def test_star_tables_have_files_by_their_rows(spark, monkeypatch):
    """Check of pipeline: the few links of a round of stars were written as one file for each shuffle partition."""
    files, keep = [], ngramjoin.saved

    def counted(df, name):
        out = keep(df, name)
        files.append((name, len(out.inputFiles()), out.count()))
        return out

    monkeypatch.setattr(ngramjoin, "saved", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20] + [(100, 7), (100, 45)], "a long, b long")
        got, _ = ngramjoin.components(df)
        assert {r["comp"] for r in got.collect()} == {1, 21}
        stars = [x for x in files if x[0] == "join-stars"][1:]
        assert stars and all(x[1] == 1 for x in stars)
        monkeypatch.setattr(ngramjoin, "STARS_A_FILE", 1)
        files.clear()
        assert {r["comp"] for r in ngramjoin.components(df)[0].collect()} == {1, 21}
        assert max(x[1] for x in files if x[0] == "join-stars") > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_workers_forget_the_encoder_of_another_step(spark):
    """Check of pipeline: workers that packing had used held its encoder and chunks while the next stages ran."""
    docs = spark.createDataFrame([(i, f"some words {i} of text") for i in range(400)], "doc_id long, text string").repartition(8)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pieces(docs, path).count() == 400

    def held(batch):
        return pa.RecordBatch.from_arrays([pa.array([bpe.encoder.cache_info().currsize])], ["n"])

    assert sum(r["n"] for r in common.map_arrow(docs, held, "n bigint", keeps="bpe").collect()) > 0
    assert sum(r["n"] for r in common.map_arrow(docs, held, "n bigint").collect()) == 0
    assert packing.pieces(docs, path).count() == 400


def test_near_labels_after_each_number_of_hops(spark):
    """Check of pipeline: only labels that have changed are told again, and every label is the least within so many links."""
    r = random.Random(3)
    links = [(i, i + 1) for i in range(12)] + [(r.randrange(20, 90), r.randrange(20, 90)) for _ in range(80)] + [(100, 200 + i) for i in range(30)]
    links = [(a, b) for a, b in links if a != b]
    near = {}
    for a, b in links:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    df, want = spark.createDataFrame(links, "a long, b long"), {x: x for x in near}
    for hops in range(1, 5):
        want = {x: min(want[y] for y in near[x]) for x in near}
        assert {x["node"]: x["comp"] for x in ngramjoin.near_labels(df, hops).collect()} == want
