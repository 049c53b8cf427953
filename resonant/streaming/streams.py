"""Structured Streaming forms of the window operators: an extension for event-time input that may arrive late.

Every stream runs to the end of what is there (availableNow) into a table in the shared folder, with its own checkpoint,
so an interrupted run resumes. Windows close when the watermark passes their end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from resonant.sources.storage import scratch

DELAY = "10 minutes"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a folder as a stream. Event time needs an instant; the session's time zone says which one a local time is."""
    shape = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(shape).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there and return its output table."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, "stream")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def tumbling(stream: DataFrame, size: str, delay: str = DELAY) -> DataFrame:
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, size: str, step: str, delay: str = DELAY) -> DataFrame:
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "peak")


def sessions(stream: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    """Runs of a user's events that no gap interrupts: the stream's form of quiet runs."""
    w = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def without_replays(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event id once, for as long as the watermark keeps it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def _smooth(rate: float) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, x in zip(rows["event_id"], rows["value"], strict=True):
            level += rate * (x - level)
            n += 1
            out.append((key[0], event_id, n, level))
        state.update((level, n))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "k", "level"])

    return run


def smoothed(stream: DataFrame, rate: float) -> DataFrame:
    """A one-pole filter whose register is kept for each user between batches."""
    return stream.groupBy("user_id").applyInPandasWithState(_smooth(rate), "user_id long, event_id long, k long, level double", "level double, n long", "append", GroupStateTimeout.NoTimeout)
