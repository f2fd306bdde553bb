"""Lists are sorted and made distinct without comparing each entry with all."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from sparkfold.operators import shape


def test_long_lists_are_made_distinct_in_one_pass(spark):
    n = 20_000
    rows = spark.range(n).repartition(1).agg(F.collect_list(F.struct(((F.col("id") * 7919) % (n // 2)).cast("string").alias("a"), F.col("id").alias("n"))).alias("v"))
    began = time.monotonic()
    found = rows.select(shape.sorted_list(F.col("v"), ("a",)).alias("x")).first().x
    assert time.monotonic() - began < 60
    assert [e.a for e in found] == sorted({str(i * 7919 % (n // 2)) for i in range(n)}) and len({e.a for e in found}) == len(found) == n // 2
