"""Operators that SQL doesn't express, against plain Python."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import prob, text
from tidemark.models import glm
from tidemark.operators import lookup, quality, ratings, resolve, scoring, stats, temporal
from tidemark.sources import raw, snapshot
from tidemark.streaming import streams

CONTESTS = "match_id long, league string, season int, level int, day int, home_id long, away_id long, home_goals int, away_goals int, played boolean"


def contests(n=120, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        h, a = r.sample(range(8), 2)
        day = i // 4
        out.append((i, "AB"[i % 2], 2000 + day // 12, 1 + (h % 2), day, h, a, r.randint(0, 4), r.randint(0, 3), r.random() < 0.9))
    return out


def brute_elo(rows):
    out, ladders = {}, {}
    for row in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        ladders.setdefault(row[1], {}).setdefault(row[4], []).append(row)
    for days in ladders.values():
        state = {}
        opened, entry = None, {}
        for day in sorted(days):
            pending = []
            for m, _, season, level, _, h, a, hg, ag, played in days[day]:
                for t in (h, a):
                    if t in state and season <= state[t]["season"]:
                        continue
                    if opened is None or season > opened:
                        opened, by = season, {}
                        for s in state.values():
                            if s["season"] == season - 1:
                                by.setdefault(s["level"], []).append(s["r"])
                        entry = {k: sum(sorted(v)[:3]) / len(sorted(v)[:3]) for k, v in by.items()}
                        mean = {k: sum(v) / len(v) for k, v in by.items()}
                    if t in state and state[t]["season"] == season - 1:
                        rating = state[t]["r"] if level not in mean else mean[level] + (state[t]["r"] - mean[level])
                    else:
                        rating = entry.get(level, 1500.0 - (100.0 if level == 2 else 0.0))
                    state[t] = {"r": rating, "season": season, "level": level, "n": state.get(t, {"n": 0})["n"]}
                state[h]["level"] = state[a]["level"] = level
                out[m] = (state[h]["r"], state[a]["r"], state[h]["n"], state[a]["n"])
                if played:
                    margin = hg - ag
                    g = 1 if abs(margin) <= 1 else 1.5 if abs(margin) == 2 else (11 + abs(margin)) / 8
                    e = 1 / (1 + 10 ** (-(state[h]["r"] + 40 - state[a]["r"]) / 400))
                    pending.append((h, a, 15 * g * ((margin > 0) + 0.5 * (margin == 0) - e)))
            for h, a, d in pending:
                state[h]["r"] += d
                state[a]["r"] -= d
                state[h]["n"] += 1
                state[a]["n"] += 1
    return out


def test_elo_is_a_daily_fold(spark):
    rows = contests()
    got = {r["match_id"]: (r["home_elo"], r["away_elo"], r["home_played"], r["away_played"]) for r in ratings.elo(spark.createDataFrame(rows, CONTESTS), "league").collect()}
    want = brute_elo(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_elo_settings_rated_together(spark, monkeypatch):
    """Many settings at once, a season a step: as one by one, all seasons in one task."""
    rows = contests()
    df = spark.createDataFrame(rows, CONTESTS)
    grid = [{}, {"k": 30.0, "margin": False}, {"regress": 0.3, "gap": 200.0, "home": 0.0}]
    whole = [{r["match_id"]: (r["home_elo"], r["away_elo"]) for r in ratings.elo(df, "league", params=p).collect()} for p in grid]
    monkeypatch.setattr(ratings, "STEP_ROWS", 1)
    stepped = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in ratings.elo(df, "league", params=grid[2]).collect()}
    assert stepped == whole[2]
    want = {}
    for k, got in enumerate(whole):
        for m, _, season, _, _, _, _, hg, ag, played in rows:
            if played and season >= 2001:
                key = (k, (got[m][0] - got[m][1]) // 5 * 5, 1 + (hg > ag) - (hg < ag))
                want[key] = want.get(key, 0) + 1
    assert {(r["setting"], r["gap"], r["outcome"]): r["n"] for r in ratings.gap_counts(df, "league", grid, 2001).collect()} == want


def test_streamed_elo_equals_batch(spark, tmp_path):
    rows = [r for r in contests() if r[1] == "A"]
    df = spark.createDataFrame(rows, CONTESTS).withColumn("ladder", F.col("league"))
    for i, (a, b) in enumerate([(0, 10), (10, 20), (20, 99)]):
        df.filter((F.col("day") >= a) & (F.col("day") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = {}

    def keep(batch, _):
        got.update({r["match_id"]: (r["home_elo"], r["away_elo"]) for r in batch.collect()})

    streams.run_available(streams.incremental_elo(stream, "ladder"), str(tmp_path / "cp"), keep)
    want = {k: v[:2] for k, v in brute_elo(rows).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_idempotent_sink_and_windows(spark, tmp_path):
    write = streams.idempotent_sink(str(tmp_path), ["k"], ("made", "limit"))
    df = spark.createDataFrame([(1, 5, 9), (1, 5, 9), (2, 9, 9)], "k int, made int, limit int")
    write(df, 0)
    write(df.union(spark.createDataFrame([(3, 1, 2)], df.schema)), 1)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == [1, 3]
    assert spark.read.parquet(str(tmp_path / "refused")).count() == 2


def test_streamed_windows_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), events.schema)
    rows = []
    streams.run_available(streams.tumbling(stream, "ts", "1 hour", ["event_type"]), str(tmp_path / "cp"), lambda b, _: rows.extend(b.collect()), "update")
    assert len({(r["start"], r["event_type"]) for r in rows}) == streams.tumbling(events, "ts", "1 hour", ["event_type"]).count()


def test_raw_versions_newest_wins(spark, tmp_path):
    for v, n in (("20240101", 1), ("20240301", 2)):
        for stem in ("a", "b_c"):
            (tmp_path / f"{stem}__{v}.json").write_text(json.dumps({"n": n}))
    got = {(r["stem"], r["version"], r["n"]) for r in raw.read_latest(spark, str(tmp_path), "n int").collect()}
    assert got == {("a", "20240301", 2), ("b_c", "20240301", 2)}


def test_drifting_csv_and_odds(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Date,Home,Avg>2.5,Avg<2.5\n01/02/03,x,1.9,2.0\n,,,\n")
    (tmp_path / "2.csv").write_text("Date,Home,B365>2.5,B365<2.5\n01/02/2003,y,0.5,2.0\n")
    got = raw.read_drifting_csv(spark, [str(tmp_path / "1.csv"), str(tmp_path / "2.csv")])
    odds = raw.first_pair([("B365>2.5", "B365<2.5"), ("Avg>2.5", "Avg<2.5")], got.columns)
    rows = {r["Home"]: (str(r["day"]), r["o"] and r["o"]["source"]) for r in got.withColumn("o", odds).collect()}
    assert rows == {"x": ("2003-02-01", "Avg>2.5"), "y": ("2003-02-01", None)}


def test_snapshot_registry_and_seal(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    m1 = snapshot.write_snapshot(df, str(tmp_path), "2020-01-01")
    m2 = snapshot.write_snapshot(df.repartition(3), str(tmp_path), "2020-01-01")
    assert m1 == m2
    back, _ = snapshot.read_snapshot(spark, str(tmp_path), m1["version"])
    assert sorted(map(tuple, back.collect()), key=str) == [(1, "a"), (2, None)]
    assert snapshot.list_snapshots(spark, str(tmp_path)).count() == 1
    reg = snapshot.Registry(("ID", "G1"), 2, [snapshot.Entry("id", "ID", "bigint"), snapshot.Entry("ewm_h{h}", "G1", "double", both=True, half_lives=(60, 120))])
    assert reg.columns() == ["id", "ewm_h60", "opp_ewm_h60", "ewm_h120", "opp_ewm_h120"]
    with pytest.raises(ValueError):
        reg.project(df)
    with pytest.raises(ValueError):
        snapshot.Registry(("ID", "G0"), 1, [snapshot.Entry("id", "ID", "int"), snapshot.Entry("id", "G0", "int")])
    when = spark.sql("SELECT timestamp_ntz'2020-01-01' AS t UNION ALL SELECT timestamp_ntz'2021-01-01'")
    assert snapshot.gate(when, "t", "2020-06-01").count() == 1


def test_zero_probability_is_an_error(spark):
    df = spark.range(1).select(F.array(F.lit(0.0), F.lit(1.0)).alias("p"))
    with pytest.raises(Exception, match="no probability"):
        df.select(scoring.log_loss(F.col("p"), F.lit(0))).collect()


def test_distribution_algebra(spark):
    pmf = prob.poisson(F.lit(1.4), 30)
    r = spark.range(1).select(prob.total(pmf).alias("s"), prob.mean_of(pmf).alias("m"), prob.quantile(pmf, 0.5).alias("q"), prob.normal_cdf(F.lit(1.959964)).alias("z"), prob.total(prob.negative_binomial(F.lit(1.4), F.lit(0.3), 60)).alias("nb")).first()
    assert r["s"] == pytest.approx(1) and r["m"] == pytest.approx(1.4) and r["q"] == 1 and r["z"] == pytest.approx(0.975, abs=1e-6) and r["nb"] == pytest.approx(1)


def test_regressions_recover_parameters(spark):
    r = np.random.default_rng(0)
    x, z = r.normal(size=4000), r.normal(size=4000)
    y = r.poisson(np.exp(0.3 + 0.5 * x))
    df = spark.createDataFrame([(float(a), float(b), int(c), i % 500) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "x double, z double, y int, g int")
    fit = glm.poisson(df, ["x", "z"], "y")
    assert fit.beta == pytest.approx([0.3, 0.5, 0.0], abs=0.06)
    assert (glm.clustered_errors(df, fit, "y", "g") < 0.05).all()
    assert abs(glm.poisson(df, ["x", "z"], "y", ridge=1.0).beta[1]) < 0.5
    assert glm.elastic_net(df, ["x", "z"], "y", 0.1, 1.0).beta[2] == 0.0
    assert glm.negative_binomial(df, ["x"], "y")[1] < 0.1
    assert glm.ols(df, ["x"], "z").beta[1] == pytest.approx(0, abs=0.06)
    big = df.withColumn("o", (F.col("x") > 0).cast("int"))
    assert glm.logistic(big.withColumn("x", F.col("x") + F.col("z")), ["x"], "o").beta[1] > 0.5


def test_schedules_and_names(spark):
    teams, r = list("abcdef"), random.Random(0)
    rows = [(d, *r.sample(teams, 2)) for d in range(40)]
    a = spark.createDataFrame(rows, "day int, home string, away string")
    b = spark.createDataFrame([(d, h.upper(), w.upper()) for d, h, w in rows], a.schema)
    assert {(x["a"], x["b"]) for x in resolve.match_schedules(a, b, 1).collect()} == {(t, t.upper()) for t in teams}
    f = spark.createDataFrame([("Müller FC",), ("zzz",)], "name string")
    c = spark.createDataFrame([("Muller F.C.",), ("Other",)], "name string")
    got = {x["foreign"]: (x["canonical"], x["verdict"]) for x in resolve.fuzzy_names(f, c).collect()}
    assert got == {"Müller FC": ("Muller F.C.", "accepted"), "zzz": (None, "unknown")}
    n = spark.range(1).select(text.normalize_name(F.lit("  Ærøskøbing-Łódź ß ")).alias("n")).first()["n"]
    assert n == "aeroskobing lodz ss"


def test_rules_and_fingerprint(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (2, 7)], "k int, v int")
    assert [r["k"] for r in quality.duplicates(df, ["k"]).collect()] == [2]
    assert [(r["k"], r["rule"]) for r in quality.failing(df, {"small": F.col("v") < 6}).collect()] == [(2, "small")]
    assert quality.fingerprint(df).first() == quality.fingerprint(df.repartition(3)).first()
    assert lookup.latest(df, ["k"], ["v"]).count() == 2
    bins = [r["bin"] for r in stats.ordered_bins(spark.range(25), ["id"], 10).orderBy("id").collect()]
    assert bins == [i * 10 // 25 for i in range(25)]


def test_decision_rule():
    assert scoring.decision(2, 2, 1, 1, 0, 1) == "not applicable"
    assert scoring.decision(4, 3, 0.01, 0.02, 0.005, 1.0) == "replace"
    assert scoring.decision(4, 3, -0.01, 0.02, 0.0, 1.0) == "keep"
