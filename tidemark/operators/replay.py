"""A day-at-a-time replay: what each day would have seen, kept by day and data version."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import path_exists


def replay(rows: DataFrame, day: str, days: Sequence[int], build: Callable[[DataFrame], DataFrame], root: str, version: str) -> DataFrame:
    """``build`` of the rows up to each of ``days``, that day's rows of it. A day that ``root`` has for this version is read
    instead of built again; a new version builds anew and leaves the old one's rows."""
    spark, out = rows.sparkSession, None
    for d in days:
        path = f"{root}/version={version}/day={d}"
        if not path_exists(spark, f"{path}/_SUCCESS"):
            build(rows.filter(F.col(day) <= d)).filter(F.col(day) == d).write.mode("overwrite").parquet(path)
        got = spark.read.parquet(path)
        out = got if out is None else out.unionByName(got)
    return out


def data_version(rows: DataFrame) -> str:
    """Changes with any change of the rows, not with their order."""
    mark = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    got = rows.agg(F.count("*").alias("n"), F.sum(mark).alias("s")).first()
    return f"{got['n']}-{got['s'] or 0}"
