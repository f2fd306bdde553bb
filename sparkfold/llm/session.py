"""Session settings and intermediate tables that the operators rely on."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Rows that one Arrow batch may hold; 10 000 texts at once would not be a bounded amount of memory.
BATCH_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    """Keeps Arrow batches small, by rows and by bytes.

    The settings are read when a plan runs, long after an operator has returned, so they stay set.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def fresh_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores behind it until no column has that name (whatever its case)."""
    known = {t.lower() for t in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a folder of this machine; any other session is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/sparkfold-checkpoints"
    return f"{base.rstrip('/')}/sparkfold-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Writes a frame as Parquet to the shared folder and reads it back: columnar, prunable, safe from lost executors."""
    path = shared_dir(frame.sparkSession)
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    return out


TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_tidily(frame: DataFrame) -> DataFrame:
    """As ``stored``, for a frame that nothing runs again: its shuffle files go with the end of the write, not when the driver collects its garbage."""
    conf = frame.sparkSession.conf
    before = conf.get(TIDY, "false")
    conf.set(TIDY, "true")
    try:
        return stored(frame)
    finally:
        conf.set(TIDY, before)


def discard(*frames: DataFrame) -> None:
    """Deletes the tables of ``stored`` frames that nothing reads any more; others are left alone."""
    for frame in frames:
        if path := getattr(frame, "stored_at", None):
            spark = frame.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
