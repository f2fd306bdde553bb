"""Keyed state of streams in RocksDB (T03, T04): a cache of first writers, with what was offered besides.

The processor keeps a value per key (the first one and its order) and a map per key (how often each value was
offered).  With event time a timer of each key forgets it some time after it was last seen; by the clock a time to
live of the state does.  A table of earlier first writers can be given as initial state.  What is kept can be
read as a table by the state data source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class FirstWriters(StatefulProcessor):
    """Emits the first value of a key, by the order of the rows of its first batch, once."""

    def __init__(self, names: tuple[str, str, str], wait: int | None, ttl: int | None) -> None:
        self.names, self.wait, self.ttl = names, wait, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        first = StructType([StructField("value", StringType()), StructField("order", LongType())])
        self.handle = handle
        self.first = handle.getValueState("first", first, self.ttl)
        self.offered = handle.getMapState("offered", StructType([StructField("value", StringType())]), StructType([StructField("n", LongType())]), self.ttl)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        _, value, order = self.names
        row = initialState.loc[initialState[order].idxmin()]
        self.first.update((str(row[value]), int(row[order])))
        self._wake(int(initialState["seen"].max()) if "seen" in initialState else 0, timerValues)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        name, value, order = self.names
        best, counts, latest = None, {}, 0
        for part in rows:
            row = part.loc[part[order].idxmin()]
            if best is None or row[order] < best[1]:
                best = (str(row[value]), int(row[order]))
            for v, n in part[value].value_counts().items():
                counts[v] = counts.get(v, 0) + int(n)
            if "seen" in part:
                latest = max(latest, int(part["seen"].max()))
        for v, n in counts.items():
            old = self.offered.getValue((v,)) if self.offered.containsKey((v,)) else (0,)
            self.offered.updateValue((v,), (old[0] + n,))
        new = best is not None and not self.first.exists()
        if new:
            self.first.update(best)
        self._wake(latest, timerValues)
        if new:
            yield pd.DataFrame({name: [key[0]], value: [best[0]], order: [best[1]]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        self.offered.clear()
        yield from ()

    def _wake(self, latest: int, timerValues: TimerValues) -> None:
        """One timer for each key, some time after it was last seen."""
        if self.wait is None:
            return
        old = list(self.handle.listTimers())
        at = max([latest + self.wait, timerValues.getCurrentWatermarkInMs() + 1, *old])
        for t in old:
            if t != at:
                self.handle.deleteTimer(t)
        if at not in old:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def first_writers(events: DataFrame, key: str, value: str, order: str, time: str | None = None, forget_after: str | None = None, late: str = "1 day", earlier: DataFrame | None = None) -> DataFrame:
    """The first value of a key (by ``order`` within a batch) is emitted once and stays.

    With a ``time`` column keys are forgotten ``forget_after`` of event time (7 days) after they were last seen, and then
    count as new; rows later than ``late`` are dropped.  Without one, ``forget_after`` is the time to live of a key by the
    clock (such a stream has always something to do, so it does not end by itself), and where it is not given keys stay.
    ``earlier`` (key, value, order) holds first writers from before: they are not emitted again.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"state of this kind needs {PROVIDER} set to {ROCKSDB}")
    wait = int(pd.Timedelta(forget_after or "7 days").total_seconds() * 1000) if time or forget_after else None
    kind = events.schema[key].dataType
    columns = [key, F.col(value).cast("string").alias(value), F.col(order).cast("bigint").alias(order)]
    if time:
        events = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
        columns += ["at", F.unix_millis("at").alias("seen")]
    schema = StructType([StructField(key, kind), StructField(value, StringType()), StructField(order, LongType())])
    start = earlier.select(*columns[:3], *([F.unix_millis(F.col(time).cast("timestamp")).alias("seen")] if time and time in earlier.columns else [])).groupBy(key) if earlier is not None else None
    processor = FirstWriters((key, value, order), wait if time else None, None if time else wait)
    mode = "EventTime" if time else "ProcessingTime" if wait else "None"
    return events.select(*columns).groupBy(key).transformWithStateInPandas(processor, schema, "Append", mode, start)


def state_table(spark: SparkSession, checkpoint: str, variable: str, batch: int | None = None) -> DataFrame:
    """What a stream has kept in one of its variables, as a table: the last batch, or an earlier one."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    if batch is not None:
        reader = reader.option("batchId", batch)
    return reader.load()
