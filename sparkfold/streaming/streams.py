"""Structured Streaming counterparts of the incremental parts.

The event stream is append-only.  State is bounded by watermarks, or by one row per key where a key must
be remembered for good (a cache of first writers).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; the checkpoint keeps what has been read."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def counts_per_window(events: DataFrame, time: str, keys: list[str], width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events by window and key; windows close when the watermark has passed."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def over_cap(counts: DataFrame, cap: float, tolerance: float = 1.05) -> DataFrame:
    """Windows with more events than the cap allows."""
    return counts.where(F.col("n") > cap * tolerance)


def distinct_within(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Drops events that come again within the watermark."""
    return events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark(keys).drop("__t")


def changed_files(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None, max_age: str = "7d") -> DataFrame:
    """Only files that are new since the last run, and not older than ``max_age``, are read."""
    reader = spark.readStream.schema(schema).option("maxFileAge", max_age)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def first_writer(events: DataFrame, key: str, value: str, order: str, time: str | None = None, forget_after: str = "7 days", late: str = "1 day") -> DataFrame:
    """A keyed cache: the first value of a key (by ``order`` within a batch) is emitted once and stays.

    With a ``time`` column, keys that have not been seen for ``forget_after`` of event time are dropped, which bounds
    the state; a key that comes again then counts as new.  Rows later than ``late`` are dropped.
    """
    wait = int(pd.Timedelta(forget_after).total_seconds() * 1000)

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, latest = None, 0
        for part in batches:
            row = part.loc[part[order].idxmin()]
            if best is None or row[order] < best[0]:
                best = (int(row[order]), str(row[value]))
            if time:
                latest = max(latest, int(part["seen"].max()))
        if best is not None and not state.exists:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], value: [best[1]], order: [best[0]]})
        if time and state.exists:
            state.setTimeoutTimestamp(max(latest + wait, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)[key]
    columns = [key, F.col(value).cast("string").alias(value), F.col(order).cast("bigint").alias(order)]
    if time:
        events = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
        columns += ["at", F.unix_millis("at").alias("seen")]
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return events.select(*columns).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {value} string, {order} bigint", "first bigint, value string", "append", timeout)


class Listener(StreamingQueryListener):
    """Hands the start, the progress and the end of streams to a function (kind, event)."""

    def __init__(self, handler: Callable[[str, object], None]) -> None:
        self.handler = handler

    def onQueryStarted(self, event) -> None:
        self.handler("started", event)

    def onQueryProgress(self, event) -> None:
        self.handler("progress", event.progress)

    def onQueryIdle(self, event) -> None:
        self.handler("idle", event)

    def onQueryTerminated(self, event) -> None:
        self.handler("terminated", event)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over what is there; a restart goes on from the checkpoint and no row is written twice."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append" and on_batch is None:
        query = writer.format("parquet").option("path", f"{folder}/rows").outputMode("append").start()
    else:

        def store(batch: DataFrame, number: int) -> None:
            if on_batch:
                on_batch(batch, number)
            batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

        query = writer.foreachBatch(store).outputMode(mode).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
