"""Profiles and offers that are the same but for their ids are compared once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfold.operators import resolve


def test_copies_are_compared_once_and_all_are_found(spark, monkeypatch):
    given, plain = [], resolve.name_pairs

    def name_pairs(seekers, offers, effort):
        given.append((seekers.count(), offers.count()))
        return plain(seekers, offers, effort)

    monkeypatch.setattr(resolve, "name_pairs", name_pairs)
    people = spark.range(60).select(
        F.col("id").cast("string").alias("path"), F.when(F.col("id") % 3 == 2, None).when(F.col("id") % 3 == 1, "Alpha Bet (1990)").otherwise("Alpha Beta").alias("series"), F.lit("01").alias("issue"), F.lit(1).cast("bigint").alias("issue_int"), F.lit(1990).alias("year"),
        F.lit(None).cast("string").alias("publisher"), F.lit(None).cast("int").alias("pages"), F.lit(None).cast("int").alias("volume"),
    )
    catalog = spark.range(40).select(
        F.col("id").alias("issue_id"), F.when(F.col("id") % 2 == 0, "Alpha Beta").otherwise("Gamma").alias("series"), F.lit("1").alias("issue"), F.when(F.col("id") < 20, 1990).otherwise(1991).alias("year"), F.lit(None).cast("string").alias("publisher"),
        F.lit(None).cast("int").alias("pages"), F.lit(5).alias("volume"), F.when(F.col("id") == 3, F.array(F.lit("Alpha Betas"))).alias("aliases"),
    )
    found = resolve.candidates(people, catalog, effort="minimal")
    assert given == [(2, 6)]  # the names of two kinds of profiles, of five kinds of offers, one of which has two
    rows = {}
    for r in found.collect():
        rows.setdefault(int(r.path), set()).add((r.c_issue_id, r.tier))
    named = {(i, 0) for i in range(0, 20, 2)} | {(3, 0)}
    assert rows == {p: named if p % 3 < 2 else {(i, 0) for i in range(20)} for p in range(60)}
