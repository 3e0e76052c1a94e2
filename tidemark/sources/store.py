"""Tables that are refreshed together or not at all, a log of the runs, and a registry with one active model.

A store is a folder. A refresh writes each table into a folder of its own run, then one commit record that names the folder of
every table; readers go by the newest record, so a refresh that dies leaves the old tables as they were. Records are numbered and
made by exclusive creation, which HDFS and local file systems grant to one writer alone: of two that saw the same record one
succeeds, and the other learns of it and starts from the new one. (Object stores need a committer with that guarantee.)
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.quality import fingerprint


STALE = 60.0


class Conflict(RuntimeError):
    """Another writer made the record first."""


class Files:
    """Small text files of a folder, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root, spark.sparkContext._jvm
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, text: str) -> None:
        """A new file; ``Conflict`` if it is there. Its whole text comes under a name that is free, then gets its own: readers
        never see a part of it."""
        staged = f"_staged/{uuid.uuid4().hex}"
        out = self.fs.create(self.path(staged), False)
        out.write(bytearray(text.encode()))
        out.close()
        claim = self.path(f"_claims/{name}")
        try:
            self.fs.create(claim, False).close()
        except Py4JJavaError as e:
            self.fs.delete(self.path(staged), False)
            if "AlreadyExists" not in str(e.java_exception) and "already exists" not in str(e.java_exception):
                raise
            self.drop_stale(claim, name)
            raise Conflict(name) from None
        self.fs.mkdirs(self.path(name).getParent())
        if not self.fs.rename(self.path(staged), self.path(name)):
            raise Conflict(name)

    def drop_stale(self, claim, name: str) -> None:
        """A claim whose writer died before its record came goes after a minute, so that the next try gets it."""
        if not self.fs.exists(self.path(name)) and self.fs.exists(claim) and time.time() - self.fs.getFileStatus(claim).getModificationTime() / 1000 > STALE:
            self.fs.delete(claim, False)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, spark: SparkSession, name: str) -> str:
        return "\n".join(r["value"] for r in spark.read.text(f"{self.root}/{name}", wholetext=True).collect())


class Log:
    """Numbered records, each the whole state after a change."""

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.folder, self.files = spark, folder, Files(spark, root)

    def newest(self) -> tuple[int, dict]:
        names = [n for n in self.files.names(self.folder) if n.endswith(".json")]
        if not names:
            return 0, {}
        return int(names[-1].split(".")[0]), json.loads(self.files.read(self.spark, f"{self.folder}/{names[-1]}"))

    def append(self, seen: int, state: dict) -> None:
        self.files.create(f"{self.folder}/{seen + 1:012d}.json", json.dumps(state, sort_keys=True))

    def change(self, how: Callable[[dict], dict], tries: int = 20, before: Callable[[], None] | None = None) -> dict:
        """Apply ``how`` to the newest state, again on the newer one where another writer came first."""
        for attempt in range(tries):
            seen, state = self.newest()
            new = how(json.loads(json.dumps(state)))
            if before and not attempt:
                before()
            try:
                self.append(seen, new)
                return new
            except Conflict:
                time.sleep(0.01 * (attempt + 1))
        raise Conflict(f"{tries} tries lost")


def refresh(spark: SparkSession, root: str, tables: dict[str, DataFrame], check: Callable[[str, dict], None] | None = None, seen: dict[str, str | None] | None = None) -> dict:
    """Replace ``tables`` of the store, all or none, and log the run. ``check`` sees each staged table's name and figures (rows,
    sum, xor) and may raise. Tables that aren't named stay. With ``seen`` (paths by table, None for
    none) it is a ``Conflict`` if another writer has replaced one of those meanwhile. Returns the run's row."""
    run, began, files = uuid.uuid4().hex, time.time(), Files(spark, root)
    row = {"run": run, "started_at": datetime.now(UTC).isoformat(), "status": "running", "tables": sorted(tables), "counts": {}, "seconds": None, "error": None}
    files.create(f"_runs/{run}-running.json", json.dumps(row))
    try:
        staged = {}
        for name, rows in tables.items():
            rows.write.option("compression", "zstd").parquet(f"{root}/{name}/{run}")
            got = fingerprint(spark.read.parquet(f"{root}/{name}/{run}")).first()
            staged[name] = {"path": f"{name}/{run}", "rows": got["rows"], "sum": str(got["sum"]), "xor": str(got["xor"])}
            if check:
                check(name, staged[name])

        def commit(state: dict) -> dict:
            for name, path in (seen or {}).items():
                if state.get(name, {}).get("path") != path:
                    raise Conflict(f"{name} was replaced")
            return state | staged

        Log(spark, root, "_commits").change(commit)
        row |= {"status": "ok", "counts": {k: v["rows"] for k, v in staged.items()}}
    except BaseException as e:
        row |= {"status": "failed", "error": f"{type(e).__name__}: {e}"[:500]}
        raise
    finally:
        row["seconds"] = round(time.time() - began, 3)
        files.create(f"_runs/{run}-{row['status']}.json", json.dumps(row))
    return row


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as the newest commit has it."""
    _, state = Log(spark, root, "_commits").newest()
    if name not in state:
        raise KeyError(f"no table {name}")
    return spark.read.parquet(f"{root}/{state[name]['path']}")


def upsert(spark: SparkSession, root: str, name: str, rows: DataFrame, keys: Sequence[str], tries: int = 5, before: Callable[[], None] | None = None) -> dict:
    """Rows of the table with the keys of ``rows`` take over its columns and keep their others; new keys are added, and columns
    that a side lacks are null. Of repeated keys in ``rows`` the greatest row counts; null keys are keys like others. Merged anew
    when another writer was faster."""
    rest = [c for c in rows.columns if c not in keys]
    new = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__new")) if rest else rows.select(*keys).distinct().withColumn("__new", F.struct(F.lit(1)))
    for attempt in range(tries):
        _, state = Log(spark, root, "_commits").newest()
        path = state.get(name, {}).get("path")
        if path is None:
            merged = new.select(*keys, *(F.col("__new").getField(c).alias(c) for c in rest))
        else:
            old = spark.read.parquet(f"{root}/{path}").withColumn("__old", F.lit(True))
            same = reduce(lambda a, b: a & b, (F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys))
            both = old.alias("o").join(new.alias("n"), same, "full")
            chosen = [F.when(F.col("o.__old"), F.col(f"o.`{k}`")).otherwise(F.col(f"n.`{k}`")).alias(k) for k in keys]
            taken = [F.when(F.col("n.__new").isNotNull(), F.col("n.__new").getField(c)).otherwise(F.col(f"o.`{c}`") if c in old.columns else F.lit(None)).alias(c) for c in rest]
            kept = [F.col(f"o.`{c}`") for c in old.columns if c not in keys and c not in rest and c != "__old"]
            merged = both.select(*chosen, *kept, *taken)
        if before and not attempt:
            before()
        try:
            return refresh(spark, root, {name: merged}, seen={name: path})
        except Conflict:
            time.sleep(0.01 * (attempt + 1))
    raise Conflict(f"{tries} tries lost")


RUN = "run string, started_at string, status string, tables array<string>, counts map<string,long>, seconds double, error string"


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Of each run its last row: failed and ok ones, and those that never ended as running."""
    if not Files(spark, root).names("_runs"):
        return spark.createDataFrame([], RUN)
    return spark.read.schema(RUN).json(f"{root}/_runs").groupBy("run").agg(F.max_by(F.struct("started_at", "status", "tables", "counts", "seconds", "error"), F.col("status") != "running").alias("r")).select("run", "r.*")


def register(spark: SparkSession, root: str, version: str, card: dict, path: str, activate: bool = False, before: Callable[[], None] | None = None) -> dict:
    """Enter a model or replace its entry; with ``activate`` it alone is active. Concurrent writers both succeed, one after the
    other; the last one to activate is the active one."""

    def change(state: dict) -> dict:
        models = state.get("models", {}) | {version: {"card": card, "path": path}}
        return {"models": models, "active": version if activate else state.get("active")}

    return Log(spark, root, "_models").change(change, before=before)


def active_model(spark: SparkSession, root: str) -> tuple[str, dict] | None:
    _, state = Log(spark, root, "_models").newest()
    return (state["active"], state["models"][state["active"]]) if state.get("active") else None
