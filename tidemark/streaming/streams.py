"""Streams: windows, sessions, late corrections, incremental ratings and an idempotent sink."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.lookup import only_new
from tidemark.operators.ratings import RATINGS, rate, start


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, when: str, size: str, keys: Sequence[str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by tumbling (or sliding) window; works on tables and, with a watermark, on streams."""
    source = events.withWatermark(when, late) if events.isStreaming else events
    out = source.groupBy(F.window(when, size, slide) if slide else F.window(when, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, when: str, gap: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    source = events.withWatermark(when, late) if events.isStreaming else events
    out = source.groupBy(F.session_window(when, gap), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "total")


def deduplicated(events: DataFrame, when: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(when, late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def attach_results(predictions: DataFrame, results: DataFrame, key: str, made: str, known: str, within: str = "30 days", late: str = "1 day") -> DataFrame:
    """Predictions with the results that come within ``within``: a left outer join, of streams by watermarks."""
    p = predictions.withWatermark(made, late) if predictions.isStreaming else predictions
    r = results.withColumnRenamed(key, "__key")
    r = r.withWatermark(known, late) if results.isStreaming else r
    return p.join(r, (F.col(key) == F.col("__key")) & (F.col(known) >= F.col(made)) & (F.col(known) <= F.col(made) + F.expr(f"interval {within}")), "left_outer").drop("__key")


RATED = "ladder string, match_id long, home_elo double, away_elo double, home_played int, away_played int"


def incremental_elo(contests: DataFrame, ladder: str, day: str = "day") -> DataFrame:
    """Ratings before each contest, kept in state by ladder. A micro-batch holds whole days, in order; contests of a day that
    the state has passed are refused (the batch operator sorts them in)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"day": None, "ladder": start()}
        rows = pd.concat(list(frames))
        if held["day"] is not None:
            rows = rows[rows[day] > held["day"]]
        frame = pd.DataFrame(columns=RATINGS)
        if len(rows):
            frame, held["ladder"] = rate(rows, held["ladder"], day)
            held["day"] = int(rows[day].max())
        state.update((json.dumps(held),))
        frame.insert(0, "ladder", key[0])
        yield frame

    return contests.groupBy(ladder).applyInPandasWithState(step, RATED, "state string", "append", GroupStateTimeout.NoTimeout)


def idempotent_sink(path: str, keys: Sequence[str], deadline: tuple[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends rows whose keys aren't stored. With deadline (made, limit), rows made too late go to
    ``path/refused``, once for each batch however often it is repeated."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if deadline:
            made, limit = deadline
            late = F.coalesce(F.col(made) >= F.col(limit), F.lit(False))
            batch.filter(late).write.mode("overwrite").parquet(f"{path}/refused/batch={batch_id}")
            rows = batch.filter(~late)
        rows = rows.dropDuplicates(list(keys))
        try:
            stored = spark.read.parquet(f"{path}/rows")
        except Exception as e:  # the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
        (rows if stored is None else only_new(rows, stored, keys)).write.mode("append").parquet(f"{path}/rows")

    return write


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Everything that is there, then stop: what a scheduled passage does."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def freshness(contests: DataFrame, league: str, day: str, status: str, today: int) -> DataFrame:
    """The last day up to which a league is complete: the day before its first contest that is neither played nor called
    off, at most today."""
    open_day = F.min(F.when(~F.col(status).isin("played", "cancelled"), F.col(day)))
    return contests.groupBy(league).agg(F.least(F.coalesce(open_day - 1, F.lit(today)), F.lit(today)).alias("complete_until"))
