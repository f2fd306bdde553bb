"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters (lower case, runs of other than letters and numbers as one space) may occur in a
text with up to ``k = m * rate`` edits.  It is split into k + 1 pieces; at least one of them then occurs
without an edit.  An Aho-Corasick automaton over all pieces finds the exact hits in whole texts.

Most hits are chance.  They are ruled out by the same principle, step by step: the pieces are the leaves of
a binary tree, and where an item occurs within its budget there is a leaf whose ancestors all do: one of p
pieces with p - 1 edits at most.  So a hit is followed upwards, in regions that double, until a step fails.
A step fails at once if more halves of the p pieces than edits are allowed don't occur exactly in the region.
What is left, hits of an item on neighbouring diagonals, makes one region that is verified as a whole.
Every verification is Myers' bit-parallel algorithm.

An item of fewer than ``short`` characters has too few for an edit budget to mean anything: it must occur
exactly, as whole words.

Each different item goes to the workers once, in blocks of at most BLOCK_CHARS characters (an item beyond that
is a block of its own), so what is broadcast has a bound; each block is one pass over the texts.  Texts don't
move; what was found is joined with the ids of its items.

Defined results: null and empty texts and items, and items without a letter or number, match nothing;
repeated items give a row each, repeated documents as well; the end is that of the best match, the first
one on ties; a null doc_id stays null; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .session import bounded

#: Characters of items in one block: the bound of what a worker holds.
BLOCK_CHARS = 8_000_000
RATE = 0.1
#: Items of fewer characters must occur exactly.
SHORT = 32
#: Verified regions that a worker remembers; a passage that many texts share is verified once.
MEMORY = 50_000


def normalized(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Words of each text in lower case, one space between them."""
    out: list[list[str]] = [[] for _ in range(len(column))]
    for data, offsets, rows in K.blocks(column):
        points, starts, ends, segment = K.words(data, offsets)
        if not len(starts):
            continue
        lengths = ends - starts + 1
        at = np.concatenate([[0], np.cumsum(lengths)])
        text = np.full(at[-1], 32, np.uint32)
        place = np.ones(at[-1], bool)
        place[at[1:] - 1] = False
        text[place] = points[K.ragged(starts, ends - starts)]
        whole = text.astype("<u4").tobytes().decode("utf-32-le", "replace")
        first = np.searchsorted(segment, np.arange(len(rows) + 1))
        for row, a, b in zip(rows.tolist(), at[first[:-1]].tolist(), at[first[1:]].tolist(), strict=True):
            if b > a:
                out[row].append(whole[a : b - 1])
    return [" ".join(x) for x in out]


class Part:
    """Some successive pieces of an item: their text, place and budget, and the bit masks of Myers' algorithm.

    ``halves`` cuts the text in twice as many stretches as it has pieces; each edit spoils one of them at most.
    """

    __slots__ = ("text", "start", "budget", "masks", "halves")

    def __init__(self, text: str, start: int, budget: int) -> None:
        self.text, self.start, self.budget = text, start, budget
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        n = 2 * (budget + 1)
        edges = [len(text) * i // n for i in range(n + 1)]
        self.halves = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def region(self, text: str, at: int) -> str:
        """Where this part can be, if the item starts at about ``at``."""
        start = at + self.start - self.budget
        return text[start if start > 0 else 0 : max(0, at + self.start + len(self.text) + self.budget)]

    def within(self, region: str) -> bool:
        """Whether the region can hold this part within its budget: all but so many of its halves occur exactly."""
        spoilt = 0
        for half in self.halves:
            if half not in region:
                spoilt += 1
                if spoilt > self.budget:
                    return False
        return self.distance(region, self.budget)[0] <= self.budget

    def distance(self, region: str, enough: int = 0) -> tuple[int, int]:
        """Least edit distance to a stretch of the region, and where that ends; budget + 1 if it is beyond.

        The search ends at the first distance that is ``enough``.
        """
        m = len(self.text)
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best, end = full, 0, m, self.budget + 1, 0
        find = self.masks.get
        for j, c in enumerate(region):
            eq = find(c, 0)
            across = eq | minus
            down = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(down | plus) & full
            low = plus & down
            if up & top:
                score += 1
            elif low & top:
                score -= 1
                if score < best:
                    best, end = score, j + 1
                    if best <= enough:
                        break
            up = up << 1 & full
            plus = low << 1 & full | ~(across | up) & full
            minus = up & across
        return best, end


class Pattern:
    """An item with its pieces and, for each piece, what holds it: two pieces, four, and so on, below the whole."""

    def __init__(self, item: str, text: str, rate: float, short: int = 0) -> None:
        self.exact = len(text) < short
        self.item, self.text, self.budget = item, text, 0 if self.exact else int(len(text) * rate)
        n = self.budget + 1
        edges = [len(text) * i // n for i in range(n + 1)]
        self.whole = Part(text, 0, self.budget)
        self.pieces: list[tuple[str, int, list[Part]]] = []
        self._split(edges, 0, n, [])

    def _split(self, edges: list[int], a: int, b: int, above: list[Part]) -> None:
        if b - a == 1:
            self.pieces.append((self.text[edges[a] : edges[b]], edges[a], above[::-1]))
            return
        held = above if b - a == len(edges) - 1 else [*above, Part(self.text[edges[a] : edges[b]], edges[a], b - a - 1)]
        middle = (a + b) // 2
        self._split(edges, a, middle, held)
        self._split(edges, middle, b, held)

    def verify(self, region: str) -> tuple[int, int]:
        if self.text in region:
            return 0, region.index(self.text) + len(self.text)
        return self.whole.distance(region)


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[str, str]], rate: float, short: int = 0) -> None:
        import ahocorasick

        self.patterns = [Pattern(i, text, rate, short) for i, text in items]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int, list[Part]]]] = {}
        for n, p in enumerate(self.patterns):
            for piece, offset, above in p.pieces:
                where.setdefault(piece, []).append((n, offset, above))
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()
        self.empty, self.memory = not where, {}

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """(item, distance, end in the normalised text) of every item that the text holds."""
        if self.empty or not text:
            return []
        diagonals: dict[int, list[int]] = {}
        whole: dict[int, int] = {}
        for end, (length, uses) in self.automaton.iter(text):
            for n, offset, above in uses:
                at = end + 1 - length - offset
                if self.patterns[n].exact:
                    if n not in whole and (not at or text[at - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " "):
                        whole[n] = end + 1
                    continue
                for part in above:
                    if not part.within(part.region(text, at)):
                        break
                else:
                    diagonals.setdefault(n, []).append(at)
        out = [(self.patterns[n].item, 0, end) for n, end in whole.items()]
        for n, found in diagonals.items():
            p = self.patterns[n]
            found.sort()
            best, end, first = p.budget + 1, 0, 0
            for i in range(1, len(found) + 1):
                if i < len(found) and found[i] - found[i - 1] <= p.budget:
                    continue
                start = max(0, found[first] - p.budget)
                region = text[start : max(0, found[i - 1] + len(p.text) + p.budget)]
                first = i
                key = (n, region)
                if (hit := self.memory.get(key)) is None:
                    if len(self.memory) >= MEMORY:
                        self.memory.clear()
                    hit = self.memory[key] = p.verify(region)
                if hit[0] < best:
                    best, end = hit[0], start + hit[1]
                if not best:
                    break
            if best <= p.budget:
                out.append((p.item, best, end))
        return out


def _distinct_items(benchmark: DataFrame, text: str) -> DataFrame:
    """key and text of each different item."""
    texts = benchmark.select(F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    return texts.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])


def _blocks_of(items: DataFrame, size: int | None = None, depth: int = 0) -> Iterator[list[tuple[str, str]]]:
    """(key, normalised text) of the items, in blocks of at most BLOCK_CHARS characters, read one after the other.

    Items are dealt to half blocks by a hash; what has become too large is dealt again, small ones are joined.  Only
    an item that is longer than a block makes a larger one.
    """
    if size is None:
        size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if not size:
        return
    n = -(-2 * size // BLOCK_CHARS)
    at = F.pmod(F.xxhash64("key", F.lit(depth)), F.lit(n)) if size > BLOCK_CHARS else F.lit(0)
    dealt = items.withColumn("at", at)
    sizes = dealt.groupBy("at").agg(F.sum(F.length("text")).alias("size"), F.count("*").alias("n")).orderBy("at").collect()
    groups: list[tuple[int, list[int]]] = []
    for row in sizes:
        if row["size"] > BLOCK_CHARS and row["n"] > 1:
            yield from _blocks_of(dealt.where(F.col("at") == row["at"]).drop("at"), row["size"], depth + 1)
        elif groups and groups[-1][0] + row["size"] <= BLOCK_CHARS:
            groups[-1] = groups[-1][0] + row["size"], [*groups[-1][1], row["at"]]
        else:
            groups.append((row["size"], [row["at"]]))
    for _, parts in groups:
        rows = dealt.where(F.col("at").isin(parts)).collect()
        texts = normalized(pa.array([r["text"] for r in rows], pa.large_string()))
        found = [(r["key"], t) for r, t in zip(rows, texts, strict=True) if t]
        if found:
            yield found


_MATCHERS: dict[tuple, Matcher] = {}


class Block:
    """Broadcast items with what they are matched by; each worker process makes one automaton of the block that it works on."""

    def __init__(self, docs: DataFrame, items: list[tuple[str, str]], rate: float, short: int) -> None:
        self.items, self.rate, self.short = docs.sparkSession.sparkContext.broadcast(items), rate, short
        self.key = hash(tuple(items)), len(items), rate, short

    def matcher(self) -> Matcher:
        if self.key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[self.key] = Matcher(self.items.value, self.rate, self.short)
        return _MATCHERS[self.key]


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, short: int = SHORT, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance (long) and end (long, in the normalised text) of each item that a text holds."""
    bounded(docs.sparkSession)
    target = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, key string, distance long, end long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks_of(_distinct_items(benchmark, item_text)):

        def run(batches: Iterator[pa.RecordBatch], block=Block(docs, items, rate, short)) -> Iterator[pa.RecordBatch]:
            match = block.matcher()
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for i, body in zip(ids, normalized(batch.column(1)), strict=True):
                    rows += [(i, *hit) for hit in match(body)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["doc_id", "key", "distance", "end"])

        out = out.unionByName(target.mapInArrow(run, schema))
    # every item of a text that was found
    ids = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.sha2(F.col(f"`{item_text}`"), 256).alias("key"))
    return out.join(ids, "key").select("doc_id", "item_id", "distance", "end")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, short: int = SHORT, text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    bounded(docs.sparkSession)
    at = docs.columns.index(text)
    for items in _blocks_of(_distinct_items(benchmark, item_text)):

        def run(batches: Iterator[pa.RecordBatch], block=Block(docs, items, rate, short)) -> Iterator[pa.RecordBatch]:
            match = block.matcher()
            for batch in batches:
                yield batch.filter(pa.array([not match(body) for body in normalized(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, StructType(docs.schema.fields))
    return docs
