"""Queries of the streaming part: streams over the event table give what a batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from ..streaming import state as K
from ..streaming import streams as S
from .registry import query


def _in_order(t, folder: str, parts: int = 4, closing: bool = False):
    """The event table as files of successive times, one after the other.

    With ``closing`` one row a year later follows, which lets the watermark pass all windows.
    """
    events = t("events")
    spark = events.sparkSession
    rows = events.repartitionByRange(parts, "ts")
    first = f"{folder}/in"
    rows.sortWithinPartitions("ts").write.parquet(first)
    if closing:
        late = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
        # written after the others, so the stream reads it last
        events.limit(0).unionByName(late, allowMissingColumns=True).write.mode("append").parquet(first)
    return S.read_events(spark, first, events.schema, files_per_trigger=1)


@query("SELECT date_trunc('minute', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t01_counts_per_minute(t):
    """A stream in append mode: a window is written once, when the watermark has passed it.

    Files come in the order of time, so nothing is later than the watermark allows.
    """
    folder = shared_folder(t("events").sparkSession)
    stream = _in_order(t, folder, closing=True)
    out = S.run_to_table(S.counts_per_window(stream, "ts", ["event_type"], late="40 days"), folder)
    return out.where("event_type IS NOT NULL").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM events WHERE event_id % 2 = 0) GROUP BY ALL")
def t02_t06_incremental_read(t):
    """Two runs over a folder that grows: the second reads the new files alone, events that come again are dropped."""
    events = t("events")
    spark, folder = events.sparkSession, shared_folder(events.sparkSession)
    even = events.where("event_id % 2 = 0")
    even.where("event_id % 4 = 0").write.parquet(f"{folder}/in")
    stream = lambda: S.distinct_within(S.changed_files(spark, f"{folder}/in", events.schema), "ts", ["event_id"], "400 days")
    S.run_to_table(stream(), folder)
    even.write.mode("append").parquet(f"{folder}/in")  # half of them have come before
    rows = S.run_to_table(stream(), folder)
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def t03_first_writer(t):
    """One batch, so the first writer is the least event of all."""
    events = t("events")
    spark = events.sparkSession
    folder = shared_folder(spark)
    events.select("user_id", "event_type", "event_id").write.parquet(f"{folder}/in")
    stream = S.read_events(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    return S.run_to_table(S.first_writer(stream, "user_id", "event_type", "event_id"), folder).select("user_id", "event_type")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def t04_prompt_cache(t):
    """Two runs: what the first has cached is kept by the second, whose keys are new to it or known; state is bounded by event time."""
    events = t("events").select("user_id", "event_type", "event_id", "ts")
    spark, folder = events.sparkSession, shared_folder(events.sparkSession)
    marked = events.join(events.groupBy("user_id").agg(F.min("event_id").alias("least")), "user_id")
    stream = lambda: S.first_writer(S.read_events(spark, f"{folder}/in", events.schema), "user_id", "event_type", "event_id", "ts", "400 days", "400 days")
    marked.where("event_id = least AND user_id % 2 = 0").drop("least").write.parquet(f"{folder}/in")
    S.run_to_table(stream(), folder)
    marked.where("user_id % 2 = 1 OR event_id > least").drop("least").write.mode("append").parquet(f"{folder}/in")
    return S.run_to_table(stream(), folder).select("user_id", "event_type")


@query("SELECT start, CAST(count(*) AS BIGINT) AS kinds FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE n > 3 * 1.05 GROUP BY start")
def t05_rate_caps(t):
    """A stream of windows that closed, those above the cap."""
    folder = shared_folder(t("events").sparkSession)
    counts = S.counts_per_window(_in_order(t, folder, closing=True), "ts", ["event_type"], width="1 hour", late="40 days")
    out = S.run_to_table(S.over_cap(counts, 3), folder)
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("kinds"))


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def e08_batches_to_a_handler(t):
    """Each batch is given to a handler, which stores what it counts; the parts add up."""
    events = t("events")
    spark, folder = events.sparkSession, shared_folder(events.sparkSession)
    stream = _in_order(t, folder)

    def handler(batch, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")

    S.run_to_table(stream, folder, on_batch=handler)
    return spark.read.parquet(f"{folder}/seen").groupBy(F.col("event_type").alias("kind")).agg(F.sum("n").alias("n"))


def _kept_in_state(t, folder: str):
    """Two runs over the events, the earlier half first; every tenth user was known before.  The rows that came out."""
    events = t("events").select("user_id", "event_type", "event_id")
    spark = events.sparkSession
    half = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    earlier = events.where("user_id % 10 = 0").groupBy("user_id").agg(F.lit("known").alias("event_type"), F.lit(-1).cast("long").alias("event_id"))
    before = spark.conf.get(K.PROVIDER)
    spark.conf.set(K.PROVIDER, K.ROCKSDB)  # the runs end here, so the session gets its setting back
    try:
        for part in (f"event_id <= {half}", f"event_id > {half}"):
            events.where(part).write.mode("append").parquet(f"{folder}/in")
            stream = K.first_writers(S.read_events(spark, f"{folder}/in", events.schema), "user_id", "event_type", "event_id", earlier=earlier)
            rows = S.run_to_table(stream, folder)
    finally:
        spark.conf.set(K.PROVIDER, before)
    return rows


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events WHERE user_id % 10 > 0 GROUP BY user_id")
def t03_keyed_state(t):
    """First writers from keyed state with an initial state and a restart; a key is emitted once."""
    return _kept_in_state(t, shared_folder(t("events").sparkSession))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def t04_state_as_a_table(t):
    """The map of each key, read from the state of the stream: what was offered, and how often."""
    spark = t("events").sparkSession
    folder = shared_folder(spark)
    _kept_in_state(t, folder)
    return K.state_table(spark, f"{folder}/checkpoint", "offered").select(F.col("key.user_id").alias("user_id"), F.col("user_map_key.value").alias("event_type"), F.col("user_map_value.n").alias("n"))
