"""Dataset registry, snapshots with manifests, and the sealed gate to contests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.quality import fingerprint


@dataclass(frozen=True)
class Entry:
    """A declared column; {h} in its name is a half-life, ``both`` gives it an ``opp_`` twin. ``horizon`` counts from 1: later
    ones hold all columns of those before."""

    name: str
    group: str
    type: str
    horizon: int = 1
    both: bool = False
    half_lives: tuple = ()

    def columns(self) -> list[str]:
        names = [self.name.format(h=h) for h in self.half_lives] if self.half_lives else [self.name]
        return [n for base in names for n in ([base, f"opp_{base}"] if self.both else [base])]


@dataclass
class Registry:
    """Declared columns, each of one of ``groups``, over ``horizons`` horizons."""

    groups: tuple[str, ...]
    horizons: int
    entries: list[Entry] = field(default_factory=list)

    def __post_init__(self) -> None:
        for e in self.entries:
            if e.group not in self.groups or not 1 <= e.horizon <= self.horizons:
                raise ValueError(f"unknown group or horizon: {e}")
        names = self.columns()
        if twice := {n for n in names if names.count(n) > 1}:
            raise ValueError(f"declared twice: {sorted(twice)}")

    def columns(self, horizon: int | None = None) -> list[str]:
        return [c for e in self.entries if e.horizon <= (horizon or self.horizons) for c in e.columns()]

    def schema(self, horizon: int | None = None) -> StructType:
        return StructType.fromDDL(", ".join(f"`{c}` {e.type}" for e in self.entries if e.horizon <= (horizon or self.horizons) for c in e.columns()))

    def project(self, rows: DataFrame, horizon: int | None = None) -> DataFrame:
        """Exactly the declared columns, cast; a missing or an undeclared one is an error."""
        want, have = self.columns(horizon), rows.columns
        if set(want) != set(have):
            raise ValueError(f"missing {sorted(set(want) - set(have))}, undeclared {sorted(set(have) - set(want))}")
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema(horizon)))


class SealError(RuntimeError):
    pass


def gate(contests: DataFrame, when: str, seal: str, opened: bool = False) -> DataFrame:
    """The only way to contests: nothing at or after the seal unless opened. The bound is a filter that the scan gets, and
    is checked again on what passes."""
    if opened:
        return contests
    bound = F.to_timestamp(F.lit(seal)).cast(contests.schema[when].dataType)
    kept = contests.filter(F.col(when) < bound)
    return kept.withColumn(when, F.when(F.col(when) < bound, F.col(when)).otherwise(F.raise_error(F.lit("sealed row read")).cast(contests.schema[when].dataType)))


def sealed_count(contests: DataFrame, when: str, seal: str) -> Column:
    return contests.agg(F.count_if(F.col(when) >= F.to_timestamp(F.lit(seal)).cast(contests.schema[when].dataType)).alias("sealed"))


def write_snapshot(rows: DataFrame, root: str, day: str, partitions: int | None = None) -> dict:
    """Parquet (zstd) under ``root/ds-<day>-<hash of content and columns>`` with a manifest; idempotent."""
    spark = rows.sparkSession
    print_ = fingerprint(rows).first()
    content = {"columns": rows.columns, "rows": print_["rows"], "sum": print_["sum"], "xor": print_["xor"]}
    version = f"ds-{day}-{hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()[:8]}"
    (rows if partitions is None else rows.repartition(partitions)).write.mode("ignore").option("compression", "zstd").parquet(f"{root}/{version}/data")
    manifest = {"version": version, "day": day} | content
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{version}/manifest")
    return manifest


def read_snapshot(spark: SparkSession, root: str, version: str) -> tuple[DataFrame, dict]:
    manifest = json.loads(spark.read.text(f"{root}/{version}/manifest").first()["value"])
    rows = spark.read.parquet(f"{root}/{version}/data")
    if rows.columns != manifest["columns"]:
        raise ValueError("columns differ from the manifest")
    return rows, manifest


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """version, day and rows of all snapshots, newest first."""
    found = spark.read.text(f"{root}/*/manifest").select(F.from_json("value", "version string, day string, rows long").alias("m")).select("m.*")
    return found.orderBy(F.desc("day"), "version")
