"""Blocks of benchmark items: bounded, each different item once, every id of it in the result."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparkfold.llm import decontaminate


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    r = random.Random(0)
    rows = [(i, prose(i, r.randint(3, 60))) for i in range(300)] + [(1000 + i, prose(7, 30)) for i in range(50)] + [(2000, prose(8, 1500)), (2001, None), (2002, " . ")]
    items = decontaminate._distinct_items(spark.createDataFrame(rows, "item_id long, text string"), "text")
    blocks = list(decontaminate._blocks_of(items))
    assert all(sum(len(t) for _, t in b) <= 2000 for b in blocks if len(b) > 1)
    assert len(blocks) < 3 * sum(len(t or "") for t in {t for _, t in rows}) / 2000
    keys = [k for b in blocks for k, _ in b]
    assert len(keys) == len(set(keys)) == len({t for _, t in rows if t and t.strip(" .")})


def test_many_equal_items(spark, monkeypatch):
    """A hundred thousand copies of an item are one item to the workers, and a row each where it is found."""
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    copies = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit(prose(1, 20)).alias("text"))
    others = spark.createDataFrame([(-1 - i, prose(50 + i, 20)) for i in range(60)] + [(None, prose(1, 20))], "item_id long, text string")
    docs = spark.createDataFrame([(1, prose(9, 50) + " " + prose(1, 20)), (2, prose(10, 80)), (3, prose(55, 20)), (3, prose(55, 20))], "doc_id long, text string")
    found = decontaminate.find_items(docs, copies.unionByName(others)).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("ids"), F.max("distance").alias("worst")).collect()
    assert {tuple(r) for r in found} == {(1, 100_001, 100_000, 0), (3, 2, 1, 0)}
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, copies.unionByName(others)).collect()] == [2]
