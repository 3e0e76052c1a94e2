"""Versioned raw files: JSON documents ``<stem>__<version>.json[.gz]`` that are never overwritten, drifting CSVs, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.lookup import latest

NAME = r"([^/]+?)__([^/_]+)\.json(?:\.gz)?$"


def read_versions(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All versions with ``stem`` and ``version``; hive-style folders (league=, season=) become columns."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path, pathGlobFilter="*.json*", recursiveFileLookup=False)
    file = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(file, NAME, 1).alias("stem"), F.regexp_extract(file, NAME, 2).alias("version"))


def read_latest(spark: SparkSession, path: str, schema: StructType | str, partitions: Sequence[str] = ()) -> DataFrame:
    """The newest version of each stem (within each partition folder)."""
    return latest(read_versions(spark, path, schema), [*partitions, "stem"], ["version"])


def write_version(rows: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    """New gzip JSON files beside the old ones; an existing folder is an error, never overwritten."""
    writer = rows.write.mode("errorifexists").option("compression", "gzip")
    (writer.partitionBy(*partitions) if partitions else writer).json(path)


def explode_response(documents: DataFrame, key: str, version: str = "version") -> DataFrame:
    """One row for each element of ``body.response``, of repeated keys the newest batch's. Missing bodies give no row."""
    rows = documents.select(version, F.explode("body.response").alias("item")).withColumn("__key", F.col(f"item.{key}"))
    return latest(rows, ["__key"], [version]).drop("__key")


def read_manifest(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Manifest lines, and the lines that can't be read, which are recorded and not fatal."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null").drop("_bad"), rows.filter("_bad is not null").select("_bad")


def parse_day(value):
    """dd/MM/yyyy or dd/MM/yy (years 69 to 99 are of the last century); null for the rest."""
    v = F.trim(value)
    long = F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(v, "d/M/yyyy"))
    short = F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(v, "d/M/yy"))
    return F.coalesce(long, F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short))


def read_drifting_csv(spark: SparkSession, paths: Sequence[str], day: str = "Date", encoding: str = "UTF-8") -> DataFrame:
    """Files whose headers drift over the years, all columns as strings, united by name; blank and undated rows go."""
    out = None
    for path in paths:
        one = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).csv(path).withColumn("file", F.col("_metadata.file_name"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.withColumn("day", parse_day(F.col(day))).filter(F.col("day").isNotNull())


def first_pair(pairs: Sequence[tuple[str, str]], columns: Sequence[str]):
    """The first pair of odds columns, in order of preference, whose values are both above one: struct(over, under, source).
    Pairs whose columns a file lacks are passed over."""
    options = []
    for over, under in pairs:
        if over in columns and under in columns:
            a, b = F.col(f"`{over}`").try_cast("double"), F.col(f"`{under}`").try_cast("double")
            options.append(F.when((a > 1) & (b > 1), F.struct(a.alias("over"), b.alias("under"), F.lit(over).alias("source"))))
    return F.coalesce(*options) if options else F.lit(None)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length and sha256 of files, for comparing with a manifest."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
