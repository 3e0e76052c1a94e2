"""Text files by line: numbers that survive splitting, encodings by file, drifting CSVs and manifests against files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.raw import checksums, parse_day


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """file, number (from 1, in its file), line: of files that Spark may split.

    A task reads the lines of a block in order; blocks start where the lines of the blocks before end. So a line's number is its
    place in the block and the sum of the earlier blocks' counts, a few rows for each file; no file is gathered."""
    read = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    blocks = read.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("file", "block", (earlier - F.col("first") + 1).alias("shift"))
    return read.join(starts, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("number"), F.col("value").alias("line"))


def decoded(lines: DataFrame, fallback: str = "iso-8859-1") -> DataFrame:
    """``lines`` with the text of each file's encoding: UTF-8 where all its lines are valid, else ``fallback``; a byte-order
    mark goes."""
    files = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("line")).alias("utf8"))
    text = F.when(F.col("utf8"), F.col("line")).otherwise(F.decode(F.col("line").cast("binary"), fallback))
    plain = F.when(F.col("number") == 1, F.regexp_replace(text, "^\\uFEFF", "")).otherwise(text)
    return lines.join(files, "file").withColumn("line", plain).withColumn("encoding", F.when(F.col("utf8"), "utf-8").otherwise(fallback)).drop("utf8")


def read_numbered_csv(spark: SparkSession, paths: str | Sequence[str], day: str = "Date", required: Sequence[str] = (), fallback: str = "iso-8859-1") -> DataFrame:
    """Rows of CSV files with drifting headers and encodings, all columns as strings: with file, number (of the line; the header
    is the first), encoding and day. Lines that are blank, undated or lack one of ``required`` go. Files of one header are read
    together; headers are few. Fields don't span lines."""
    lines = decoded(numbered_lines(spark, paths), fallback)
    headers = lines.filter("number = 1").select("file", F.col("line").alias("header"))
    body = lines.filter(F.col("number") > 1).join(headers, "file")
    out = None
    for r in sorted(headers.select("header").distinct().collect()):  # one row a header
        names = [n for n in (c.strip().strip('"') for c in r["header"].split(",")) if n]
        schema = ", ".join(f"`c{k}` string" for k in range(len(names)))
        got = body.filter(F.col("header") == r["header"]).withColumn("row", F.from_csv("line", schema))
        one = got.select("file", "number", "encoding", *(F.nullif(F.trim(F.col(f"row.c{k}")), F.lit("")).alias(n) for k, n in enumerate(names)))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "file string, number long, encoding string, day date")
    for c in (day, *required):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.withColumn("day", parse_day(F.col(f"`{day}`"))).dropna(subset=["day", *required])


def read_manifest_lines(spark: SparkSession, path: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Entries of JSON-lines manifests with manifest and number, and the lines that can't be read (file, number, line), which
    are recorded and not fatal; blank lines are neither."""
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    parsed = lines.withColumn("e", F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = parsed.filter("e IS NOT NULL AND e._bad IS NULL").select(F.col("file").alias("manifest"), "number", "e.*").drop("_bad")
    return good, parsed.filter("e IS NULL OR e._bad IS NOT NULL").select("file", "number", "line")


def relative(path: Column, root: str) -> Column:
    """``path`` below ``root``, without a scheme."""
    plain = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    return F.regexp_replace(plain, "^" + "/" + root.split(":", 1)[-1].strip("/") + "/", "")


def compared(spark: SparkSession, root: str, entries: DataFrame, files: str = "*/*") -> DataFrame:
    """file, sha256 (of the file), listed (its newest entry's) and status: ok, differs, missing (listed, no file) or unlisted.
    ``entries``: file (below ``root``), sha256, number. Checksums are made where the files are read."""
    have = checksums(spark, f"{root}/{files}").select(relative(F.col("path"), root).alias("file"), "length", F.col("sha256").alias("have"))
    want = entries.groupBy("file").agg(F.max_by("sha256", "number").alias("listed"))
    both = have.join(want, "file", "full_outer")
    status = F.when(F.col("have").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("have") == F.col("listed"), "ok").otherwise("differs")
    return both.select("file", F.col("have").alias("sha256"), "listed", "length", status.alias("status"))


def rebuilt(spark: SparkSession, root: str, entries: DataFrame, files: str = "*/*") -> DataFrame:
    """file, sha256, length of the files that ``entries`` lack: what a manifest is to be appended with."""
    have = checksums(spark, f"{root}/{files}").select(relative(F.col("path"), root).alias("file"), "sha256", "length")
    return have.join(entries.select("file").distinct(), "file", "left_anti")
