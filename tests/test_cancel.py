"""Cancelling a bulk write while its job runs."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from sparkfold.sources import sinks


def rows(spark, n=40):
    return spark.range(n).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path")).repartition(2)


def slow(seconds):
    def run(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                time.sleep(seconds)
            yield batch

    def write(part):
        done = part.mapInArrow(run, "path string")
        return done.select("path", F.col("path").alias("target"), F.lit(True).alias("written"), F.lit(1).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("error"))

    return write


def test_a_running_job_is_interrupted(spark, tmp_path):
    asked, calls = threading.Event(), []
    began = time.time()

    def write(part):
        calls.append(1)
        if len(calls) == 3:
            threading.Timer(3, asked.set).start()
        return slow(0 if len(calls) < 3 else 20)(part)  # the third window would take minutes

    found = sinks.in_windows(rows(spark), write, str(tmp_path / "r"), 4, cancelled=asked.is_set).collect()
    assert time.time() - began < 90
    assert sorted(r.path for r in found) == sorted(r.path for r in rows(spark).collect())
    errors = {e: sum(r.error == e for r in found) for e in (None, "interrupted", "cancelled")}
    assert all(errors.values()) and all(r.written == (r.error is None) for r in found) and len(calls) == 3
    assert spark.range(5).count() == 5  # the session goes on


def test_other_errors_pass_through(spark, tmp_path):
    def broken(part):
        return slow(0)(part).withColumn("bytes", F.raise_error(F.lit("broken")).cast("bigint"))

    with pytest.raises(Exception, match="broken"):
        sinks.in_windows(rows(spark), broken, str(tmp_path / "r"), 2)


def test_all_windows_without_a_cancel(spark, tmp_path):
    found = sinks.in_windows(rows(spark), slow(0), str(tmp_path / "r"), 3).collect()
    assert len(found) == 40 and all(r.written for r in found)
