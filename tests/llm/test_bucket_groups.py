"""The buckets of a family that shares many of them: which texts meet, and how many rows that takes."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from sparkfold.llm import near_dup


def edited_family(n: int, words: int, edits: int) -> list[str]:
    r, out = random.Random(8), []
    for _ in range(n):
        text = [f"w{i}" for i in range(words)]
        for _ in range(edits):
            text[r.randrange(words)] = f"x{r.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def dealt_rows(spark, monkeypatch, run) -> list:
    """The rows that ``run`` deals out to the tasks that compare whole buckets."""
    kind, found = type(spark.range(0)), []
    deal = kind.repartition

    def seen(self, *columns):
        found.extend(self.collect())
        return deal(self, *columns)

    monkeypatch.setattr(kind, "repartition", seen)
    run()
    monkeypatch.setattr(kind, "repartition", deal)
    return found


def test_texts_of_many_buckets_are_compared_once(spark, monkeypatch):
    """A family about the threshold: each text shares some tens of large buckets, and has one row."""
    texts = edited_family(1500, 400, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(5)
    rows = dealt_rows(spark, monkeypatch, lambda: near_dup.classes(docs))
    assert 1000 < len(rows) <= 1.2 * len(texts)


def meetings(spark, monkeypatch, buckets: dict[int, list[int]], component: dict[int, int]) -> tuple[list, dict]:
    """The rows, and the texts of each task; texts share nothing, so that no link is found."""
    members = spark.createDataFrame([(k, n) for k, nodes in buckets.items() for n in nodes], "key long, node long")
    linked = spark.createDataFrame(list(component.items()), "node long, component long")
    nodes = sorted({n for x in buckets.values() for n in x})
    tables = spark.createDataFrame([(n, bytearray(np.array([(n, 1)], near_dup._SHINGLE).tobytes())) for n in nodes], "node long, shingles binary")
    rows = dealt_rows(spark, monkeypatch, lambda: near_dup.with_whole_buckets(linked, members, tables, 0.8))
    tasks = defaultdict(list)
    for unit, low, high, _, table in rows:
        tasks[unit, low, high].append(int(np.frombuffer(table, near_dup._SHINGLE)["h"][0]))
    return rows, tasks


def test_every_pair_of_a_bucket_meets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PART_TEXTS", 5)
    r = random.Random(4)
    buckets = {1000 + k: r.sample(range(60), 30) for k in range(20)}  # a family
    buckets |= {2000 + k: list(range(100 + 6 * k, 100 + 6 * k + 9)) for k in range(15)}  # a chain of buckets
    buckets |= {3000 + k: r.sample(range(300, 340), 12) for k in range(6)}  # one class already
    buckets |= {4000: list(range(400, 408)), 4001: [410]}
    component = {n: 0 for n in range(40)} | {n: 300 for n in range(300, 340)} | {n: 100 + n % 7 for n in range(100, 150)}
    rows, tasks = meetings(spark, monkeypatch, buckets, component)
    met = {(a, b) for nodes in tasks.values() for a in nodes for b in nodes}
    of = lambda n: component.get(n, n)
    assert all((a, b) in met for nodes in buckets.values() for a in nodes for b in nodes if of(a) != of(b))
    assert all(len(nodes) == len(set(nodes)) for nodes in tasks.values())
    units = {u for u, _, _ in tasks}
    assert any(u in buckets for u in units) and any(u not in buckets for u in units)
    assert not any(300 <= n < 340 or n == 410 for nodes in tasks.values() for n in nodes)


def test_rows_of_a_large_class_do_not_grow_with_its_parts(spark, monkeypatch):
    """200 texts of a class in 40 parts and three others: each of the 200 has one row, each of the three one for each part."""
    monkeypatch.setattr(near_dup, "PART_TEXTS", 5)
    rows, tasks = meetings(spark, monkeypatch, {7: list(range(203))}, {n: 0 for n in range(200)})
    assert len(rows) <= 200 + 3 * 40
    met = {(a, b) for nodes in tasks.values() for a in nodes for b in nodes}
    assert all((a, b) in met for a in range(200, 203) for b in range(203))
