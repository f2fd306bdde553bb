"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import discard, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def _with_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and all its v; the minimum is combined before the shuffle, no neighbourhood is gathered."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    return _with_least(_both_ways(edges)).where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    found = _with_least(down)
    return found.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()


#: Nodes that a task remembers while it drops links that close a cycle.
REMEMBERED = 1 << 20


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task without those that close a cycle among its own; they change no component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        kept = []
        for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if (x := root(a)) != (y := root(b)):
                parent[x] = y
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))
        if len(parent) > REMEMBERED:  # a new start keeps more links than needed, never fewer
            parent.clear()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of the links ``a``, ``b`` (long, not null).

    Each task first drops links that close a cycle, then come rounds of two steps until nothing changes; their
    number grows with the logarithm of the longest path.  Each round is written to the shared folder, so a lost
    executor costs one round at most; the result is a stored table.
    Self links and repeated links are allowed; an empty table gives an empty result.
    """
    whole = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # a dense group of n nodes leaves n - 1 links in each task that read it, so the rounds don't carry its pairs
    edges = stored(whole.select("a", "b").mapInArrow(forest, "a long, b long"))
    discard(whole)
    mark = None
    while True:
        before, edges = edges, stored(_small_star(_large_star(edges)))
        discard(before)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    out = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    discard(edges)
    return out
