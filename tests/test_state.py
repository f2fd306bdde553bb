"""Keyed state in RocksDB: batches, restarts, late rows, forgotten keys, initial state, and the state as a table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkfold.streaming import state, streams

SCHEMA = "user long, kind string, n long, ts timestamp"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(state.PROVIDER)
    spark.conf.set(state.PROVIDER, state.ROCKSDB)
    yield spark
    spark.conf.set(state.PROVIDER, before)


def put(spark, folder, rows):
    spark.createDataFrame(rows, "user long, kind string, n long, t string").select("user", "kind", "n", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def test_batches_restart_late_rows_and_forgotten_keys(rocks, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = streams.read_events(rocks, source, SCHEMA, files_per_trigger=1)
        return {tuple(r) for r in streams.run_to_table(state.first_writers(stream, "user", "kind", "n", "ts", "2 days", "1 day"), out).collect()}

    put(rocks, source, [(1, "a", 5, "2024-01-01"), (1, "b", 3, "2024-01-01"), (2, "c", 9, "2024-01-01")])
    assert run() == {(1, "b", 3), (2, "c", 9)}
    put(rocks, source, [(1, "z", 1, "2024-01-02"), (3, "d", 2, "2024-01-02")])  # a restart: user 1 is known
    assert run() == {(1, "b", 3), (2, "c", 9), (3, "d", 2)}
    first = {r.key.user: tuple(r.value) for r in state.state_table(rocks, f"{out}/checkpoint", "first").collect()}
    assert first == {1: ("b", 3), 2: ("c", 9), 3: ("d", 2)}
    offered = {(r.key.user, r.user_map_key.value): r.user_map_value.n for r in state.state_table(rocks, f"{out}/checkpoint", "offered").collect()}
    assert offered == {(1, "a"): 1, (1, "b"): 1, (1, "z"): 1, (2, "c"): 1, (3, "d"): 1}
    put(rocks, source, [(4, "e", 7, "2024-02-01")])  # the watermark passes all that was seen
    run()
    put(rocks, source, [(5, "f", 1, "2024-01-01"), (1, "g", 8, "2024-02-01")])  # a late row goes, user 1 counts as new
    assert run() == {(1, "b", 3), (2, "c", 9), (3, "d", 2), (4, "e", 7), (1, "g", 8)}
    assert {r.key.user for r in state.state_table(rocks, f"{out}/checkpoint", "first").collect()} == {1, 4}


def test_initial_state(rocks, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(rocks, source, [(1, "a", 5, "2024-01-01"), (2, "c", 9, "2024-01-01")])
    earlier = rocks.createDataFrame([(1, "old", 0), (1, "older", -1)], "user long, kind string, n long")
    stream = state.first_writers(streams.read_events(rocks, source, SCHEMA), "user", "kind", "n", earlier=earlier)
    assert {tuple(r) for r in streams.run_to_table(stream, out).collect()} == {(2, "c", 9)}
    assert {(r.key.user, *r.value) for r in state.state_table(rocks, f"{out}/checkpoint", "first").collect()} == {(1, "older", -1), (2, "c", 9)}


def test_another_store_is_refused(spark, tmp_path):
    if spark.conf.get(state.PROVIDER) != state.ROCKSDB:
        put(spark, str(tmp_path / "in"), [(1, "a", 5, "2024-01-01")])
        with pytest.raises(ValueError):
            state.first_writers(streams.read_events(spark, str(tmp_path / "in"), SCHEMA), "user", "kind", "n")
