"""Stores, registries, numbered lines, drifting CSVs and manifests."""

import hashlib
import json
import threading

import pytest

from tidemark.sources import lines, store


def test_refresh_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    one, two = spark.range(5).toDF("a"), spark.range(7).toDF("b")
    store.refresh(spark, root, {"one": one, "two": two})
    assert store.read_table(spark, root, "one").count() == 5

    def refuse(name, figures):
        if name == "two":
            raise ValueError(f"{name} has {figures['rows']} rows")

    with pytest.raises(ValueError):
        store.refresh(spark, root, {"one": spark.range(50).toDF("a"), "two": spark.range(70).toDF("b")}, refuse)
    with pytest.raises(Exception):  # noqa: B017  dies while the second table is written
        store.refresh(spark, root, {"one": spark.range(60).toDF("a"), "two": spark.range(9).selectExpr("raise_error('no') AS b")})
    assert store.read_table(spark, root, "one").count() == 5 and store.read_table(spark, root, "two").count() == 7
    store.refresh(spark, root, {"two": spark.range(8).toDF("b")})
    assert store.read_table(spark, root, "one").count() == 5 and store.read_table(spark, root, "two").count() == 8
    assert sorted((r["status"], r["counts"].get("two") if r["counts"] else None) for r in store.runs(spark, root).collect()) == [("failed", None), ("failed", None), ("ok", 7), ("ok", 8)]
    with pytest.raises(KeyError):
        store.read_table(spark, root, "three")


def test_one_active_model_whoever_writes(spark, tmp_path):
    root, gate, errors = str(tmp_path), threading.Barrier(4), []
    assert store.active_model(spark, root) is None

    def write(k):
        try:
            store.register(spark, root, f"v{k}", {"k": k}, f"/models/{k}", activate=True, before=gate.wait)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    seen, state = store.Log(spark, root, "_models").newest()
    assert seen == 4 and sorted(state["models"]) == ["v0", "v1", "v2", "v3"] and state["active"] in state["models"]
    store.register(spark, root, "v9", {}, "/models/9")
    assert store.active_model(spark, root)[0] == state["active"]
    with pytest.raises(store.Conflict):
        store.Log(spark, root, "_models").append(seen, {})


def test_line_numbers_survive_splits(spark, tmp_path):
    for f, n in (("a.txt", 4000), ("b.txt", 3), ("c.txt", 0)):
        (tmp_path / f).write_text("".join(f"{f} {k}" + "\n" * (1 + k % 3 // 2) for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = lines.numbered_lines(spark, str(tmp_path)).collect()
        parts = lines.numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {(f, k + 1): line for f in ("a.txt", "b.txt") for k, line in enumerate((tmp_path / f).read_text().split("\n")[:-1])}
    assert {(r["file"].rsplit("/", 1)[1], r["number"]): r["line"] for r in got} == want and len(got) == len(want)
    assert parts > 1


def test_drifting_csv_of_two_encodings(spark, tmp_path):
    (tmp_path / "new.csv").write_bytes("\ufeffDate,HomeTeam,AwayTeam,FTHG\n01/02/2020,Köln,\"A, B\",1\n\n,X,Y,2\n3/4/21,Ünion,Z,\n".encode())
    (tmp_path / "old.csv").write_bytes("Date,HomeTeam,AwayTeam,Avg>2.5\n05/06/99,Málaga,Q,1.9\n06/06/1999,,Q,1\nnever,A,B,1\n".encode("latin-1"))
    got = sorted((r["file"].rsplit("/", 1)[1], r["number"], r["encoding"], str(r["day"]), r["HomeTeam"], r["AwayTeam"], r["FTHG"], r["Avg>2.5"]) for r in lines.read_numbered_csv(spark, str(tmp_path), required=["HomeTeam"]).collect())
    assert got == [("new.csv", 2, "utf-8", "2020-02-01", "Köln", "A, B", "1", None), ("new.csv", 5, "utf-8", "2021-04-03", "Ünion", "Z", None, None), ("old.csv", 2, "iso-8859-1", "1999-06-05", "Málaga", "Q", None, "1.9")]


def test_manifest_against_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    sha = {}
    for name in ("a", "b", "c"):
        (tmp_path / "raw" / f"{name}.json").write_text(name * 3)
        sha[name] = hashlib.sha256((name * 3).encode()).hexdigest()
    entry = lambda n, s: json.dumps({"file": f"raw/{n}.json", "sha256": s})
    (tmp_path / "m.jsonl").write_text("\n".join([entry("a", "old"), "", entry("a", sha["a"]), '{"file": "raw/x', entry("b", "wrong"), entry("gone", "1"), "not json"]) + "\n")
    good, bad = lines.read_manifest_lines(spark, str(tmp_path / "m.jsonl"), "file string, sha256 string")
    assert sorted(r["number"] for r in good.collect()) == [1, 3, 5, 6] and sorted((r["number"], r["line"]) for r in bad.collect()) == [(4, '{"file": "raw/x'), (7, "not json")]
    got = {r["file"]: r["status"] for r in lines.compared(spark, str(tmp_path), good, "raw/*.json").collect()}
    assert got == {"raw/a.json": "ok", "raw/b.json": "differs", "raw/c.json": "unlisted", "raw/gone.json": "missing"}
    assert [(r["file"], r["sha256"]) for r in lines.rebuilt(spark, str(tmp_path), good, "raw/*.json").collect()] == [("raw/c.json", sha["c"])]


def test_a_dead_writer_does_not_block(spark, tmp_path, monkeypatch):
    log = store.Log(spark, str(tmp_path), "_models")
    claim = log.files.path("_claims/_models/000000000001.json")
    log.files.fs.create(claim, False).close()
    with pytest.raises(store.Conflict):
        log.append(0, {})
    monkeypatch.setattr(store, "STALE", -1.0)
    assert log.change(lambda s: s | {"a": 1}) == {"a": 1} and log.newest() == (1, {"a": 1})
