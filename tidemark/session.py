"""Session settings that the operators are written for."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "tidemark", cpus: int | str = "*", **more: str) -> SparkSession:
    """A local session; on a cluster use its own builder with SETTINGS."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus}]")
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; without one only local sessions have a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), f"tidemark-{os.getuid()}")


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` written as Parquet in the shared folder (partitioned by ``by``) and read again: cuts the lineage and outlives
    lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
