"""A user's merger over groups of any size, against a plain fold."""

from __future__ import annotations

import random
from datetime import date

from pyspark.sql import functions as F

from sparkfold.operators.fold import Merger, fold


def overlay() -> Merger:
    """A merger that travels to the workers by value, as one of a notebook would."""

    class Overlay(Merger):
        """Later values before earlier ones, but what is marked stays; with the number of rows and a trail of their order."""

        def start(self):
            return {"n": 0, "value": None, "kept": False, "trail": 0}

        def add(self, state, row):
            trail = (state["trail"] * 31 + row["i"] + 1) % 1_000_003
            value, kept = (state["value"], True) if state["kept"] else (row["v"] if row["v"] is not None else state["value"], bool(row["stays"]))
            return {"n": state["n"] + 1, "value": value, "kept": kept, "trail": trail}

        def join(self, a, b):
            value, kept = (a["value"], True) if a["kept"] else (b["value"] if b["value"] is not None else a["value"], b["kept"])
            return {"n": a["n"] + b["n"], "value": value, "kept": kept, "trail": (a["trail"] * pow(31, b["n"], 1_000_003) + b["trail"]) % 1_000_003}

        def result(self, state):
            return {"n": state["n"], "value": state["value"], "trail": state["trail"]}

    return Overlay()


def test_groups_of_any_size(spark):
    r = random.Random(0)
    rows = [("hot", date(2024, 1, 1), i, f"v{i}" if r.random() < 0.8 else None, r.random() < 0.0005) for i in range(6000)]
    rows += [(r.choice("abcdefgh"), None if r.random() < 0.3 else date(2024, 1, 1 + r.randrange(3)), 10_000 + i, f"w{i}" if r.random() < 0.5 else None, r.random() < 0.1) for i in range(2000)]
    rows.append((None, None, -1, "only", False))
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, d date, i long, v string, stays boolean").repartition(5)
    found = fold(frame, ["k", "d"], ["i"], overlay(), "n long, value string, trail long")
    want, merger = {}, overlay()
    for k, d, i, v, stays in sorted(rows, key=lambda x: x[2]):
        want[k, d] = merger.add(want.get((k, d)) or merger.start(), {"i": i, "v": v, "stays": stays})
    assert {(x.k, x.d): (x.n, x.value, x.trail) for x in found.collect()} == {k: (s["n"], s["value"], s["trail"]) for k, s in want.items()}
    assert found.columns == ["k", "d", "n", "value", "trail"]


def test_a_large_group_is_the_work_of_many_tasks(spark):
    """Every range hands on one state of the group, so no task has more than its range."""
    frame = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.col("id").cast("string").alias("v"), F.lit(False).alias("stays"))
    row = fold(frame, ["k"], ["i"], overlay(), "n long, value string").collect()
    assert [tuple(x) for x in row] == [(1, 20_000, "19999")]
    assert fold(frame.limit(0), ["k"], ["i"], overlay(), "n long, value string").count() == 0
