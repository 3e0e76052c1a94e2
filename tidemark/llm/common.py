"""What several operators share: intermediate tables, sizing and Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is set, a local one, but only if the
    executors are threads of the driver's process, as in tests: elsewhere they would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), f"tidemark-{os.getuid()}")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Lets Spark delete a query's shuffle files when it ends; what is written as a table needs them no longer.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until none of ``columns`` has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def aside(docs: DataFrame, used: tuple[str, ...], use: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``use`` of ``docs`` whose columns other than ``used`` have numbers for names meanwhile, so that no name of a caller's
    column meets one of an operator's own or has to be quoted. Columns that ``use`` adds get a name that is free."""
    plain = [c if c in used else f"__column_{k}__" for k, c in enumerate(docs.columns)]
    out = use(docs.toDF(*plain))
    back = dict(zip(plain, docs.columns, strict=True))
    return out.toDF(*(back[c] if c in back else free_name(c, docs.columns) for c in out.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Small batches by rows and by bytes, so that what a worker holds depends neither on Spark's batch size nor on how long
    the texts are that come together."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            some = batch.slice(start, rows)
            while some.num_rows > 1 and some.nbytes > size:
                some = some.slice(0, some.num_rows // 2)
            yield some
            start += some.num_rows


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def quoted(name: str) -> str:
    """``name`` as SQL reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


#: What operators keep in a Python worker from task to task, by name: how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def forget(but: str = "") -> None:
    """Let go of what other operators have kept in this worker: Spark reuses workers, and all that they hold adds up."""
    for name, clear in KEPT.items():
        if name != but:
            clear()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | StructType, rows: int = 512, keeps: str = "") -> DataFrame:
    """``mapInArrow`` of a function of one small batch. Columns may have any names: Spark sees numbered ones. keeps: what of
    ``KEPT`` the function uses; the rest is dropped."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        for batch in slices(batches, rows):
            out = fn(batch.rename_columns(names))
            yield from (out.to_batches() if isinstance(out, pa.Table) else [out])

    return df.toDF(*(f"c{k}" for k in range(len(names)))).mapInArrow(run, schema)
