"""Token counts by heap-and-linked-list byte-pair merging.

A text is split into pre-tokens (``kernels.pretoken_starts``).  Every distinct pre-token is merged
once per worker: its symbols form a doubly linked list, all adjacent pairs that have a merge wait in
a heap, and the pair of lowest rank (leftmost on ties) is popped and joined until none is left.  The
count is the number of initial symbols minus the number of merges; no token identifier is looked up.
Counts are kept for each pre-token, so a common word costs one search; a pre-token of many megabytes
without a break is merged in arrays (``MergeTable``).

Defined results: a null or empty text has 0 tokens; a special string inside a text (such as an
end-of-text mark) counts as one token and splits the text, as the tokenizers library does by default.
Repeated rows and ties give one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels as K
from .session import bounded

#: Bytes of a pre-token from which on it is merged in arrays, and bytes whose pairs are looked up together.
LONG, LONG_BLOCK = 1 << 14, 1 << 20
#: Distinct pre-tokens a worker keeps; beyond it the cache starts anew (results don't depend on it).
CACHE_LIMIT = 1 << 21


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """Merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.ranks = {}
        for rank, merge in enumerate(model["merges"]):
            self.ranks[tuple(merge.split(" ") if isinstance(merge, str) else merge)] = rank
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
            raise ValueError(f"{path} has special tokens that strip their surroundings")
        self.vocab = model["vocab"]

    @cached_property
    def table(self) -> MergeTable:
        return MergeTable(self.ranks)

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        if len(piece) > LONG and self.table.rising:
            return self.table.count(piece)
        symbols = byte_symbols()
        text = [symbols[b] for b in piece]
        n, ranks = len(text), self.ranks
        if n < 2:
            return n
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i, text[i], text[i + 1]) for i in range(n - 1) if (rank := ranks.get((text[i], text[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = behind[i]
            if text[i] != a or j >= n or text[j] != b:  # one of the two is gone or has grown
                continue
            text[i], text[j] = a + b, ""
            left -= 1
            k = behind[i] = behind[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get((text[i], text[k]))) is not None:
                    heapq.heappush(heap, (rank, i, text[i], text[k]))
            h = before[i]
            if h >= 0 and (rank := ranks.get((text[h], text[i]))) is not None:
                heapq.heappush(heap, (rank, h, text[h], text[i]))
        return left


class MergeTable:
    """The merges as arrays, for pre-tokens so long that lists of Python objects would not fit into memory.

    The heap holds ranks, each with the places of its pairs; all pairs of the lowest rank are popped together,
    leftmost first.  This gives the result of popping one pair at a time if every pair with a symbol ranks
    behind the merges that make this symbol (``rising``), as then no merge makes a pair of a lower rank.
    A byte of text takes about 30 bytes of memory.
    """

    def __init__(self, ranks: dict[tuple[str, str], int]) -> None:
        number = {c: i for i, c in enumerate(byte_symbols())}
        for a, b in ranks:
            for name in (a, b, a + b):
                number.setdefault(name, len(number))
        n = len(ranks)
        left, right, made, rank = (np.zeros(n, np.int64) for _ in range(4))
        for i, ((a, b), r) in enumerate(ranks.items()):
            left[i], right[i], made[i], rank[i] = number[a], number[b], number[a + b], r
        self.symbols = len(number)
        keys = left * self.symbols + right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], rank[order].astype(np.int32)
        by_rank = np.argsort(rank)
        self.by_rank, self.made, self.left, self.right = rank[by_rank], made[by_rank], left[by_rank], right[by_rank]
        last_made, first_used = np.full(self.symbols, -1), np.full(self.symbols, np.iinfo(np.int64).max)
        np.maximum.at(last_made, made, rank)
        np.minimum.at(first_used, left, rank)
        np.minimum.at(first_used, right, rank)
        self.rising = bool((first_used > last_made).all())

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where there is no merge."""
        keys = a.astype(np.int64) * self.symbols + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], -1)

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token, which is not empty."""
        symbol = np.frombuffer(piece, np.uint8).astype(np.int32)
        n = left_over = len(symbol)
        behind, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        waiting: dict[int, list[np.ndarray]] = {}

        def push(places: np.ndarray) -> None:
            """Places whose symbol and the next one may be a pair."""
            places = places[behind[places] < n]
            rank = self.ranks_of(symbol[places], symbol[behind[places]])
            places, rank = places[rank >= 0].astype(np.int32), rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[cuts].tolist(), np.split(places, cuts[1:]) if len(cuts) else [], strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part.copy())

        heap: list[int] = []
        for k in range(0, n, LONG_BLOCK):
            push(np.arange(k, min(n, k + LONG_BLOCK)))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            m = int(np.searchsorted(self.by_rank, r))
            a, b, made = self.left[m], self.right[m], self.made[m]
            at = at[(symbol[at] == a) & (behind[at] < n)]
            at = at[symbol[behind[at]] == b]
            if a == b and len(at):  # of pairs that overlap each second one, from the left
                new = np.ones(len(at), bool)
                new[1:] = behind[at[:-1]] != at[1:]
                run = np.flatnonzero(new)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            if not len(at):
                continue
            gone = behind[at]
            symbol[at], symbol[gone] = made, -1
            behind[at] = behind[gone]
            after = behind[at]
            before[after[after < n]] = at[after < n]
            left_over -= len(at)
            earlier = before[at]
            push(np.unique(np.concatenate([at, earlier[earlier >= 0]])))
        return left_over


def split_specials(column: pa.Array, specials: dict[str, int]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Parts of the texts between special strings; the row of each part and the id that follows it, or -1."""
    n = len(column)
    rows, follow = np.arange(n), np.full(n, -1)
    hit = np.zeros(n, bool)
    for mark in specials:
        hit |= pc.match_substring(column, mark).fill_null(False).to_numpy(zero_copy_only=False)
    if not hit.any():
        return column, rows, follow
    import re

    pattern = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")")
    parts: list[tuple[str, int, int]] = []
    for row, text in enumerate(column.to_pylist()):
        found = pattern.split(text or "") if hit[row] else [text or ""]
        parts += [(found[i], row, specials[found[i + 1]] if i + 1 < len(found) else -1) for i in range(0, len(found), 2)]
    return pa.array([p[0] for p in parts], pa.large_string()), np.array([p[1] for p in parts]), np.array([p[2] for p in parts])


class PretokenCache:
    """Values of distinct pre-tokens; ``make`` gets those that are new.

    They are found by a 64-bit hash and compared with what was stored under it, so a collision costs time and
    changes nothing: pre-tokens whose hash belongs to another one are kept by their text.
    """

    def __init__(self, make) -> None:
        self.make = make
        self._clear()

    def _clear(self) -> None:
        self.index, self.slots = K.HashIndex(), np.zeros(0, np.int64)  # value of the index -> slot
        self.pool, self.starts, self.lengths = Grown(np.uint32), Grown(np.int64), Grown(np.int64)
        self.others: dict[str, int] = {}
        self.size = 0

    def _add(self, pieces: list[str]) -> np.ndarray:
        self.make(pieces)
        self.size += len(pieces)
        return np.arange(self.size - len(pieces), self.size)

    def _by_text(self, pieces: list[str]) -> list[int]:
        new = list(dict.fromkeys(p for p in pieces if p not in self.others))
        if new:
            self.others.update(zip(new, self._add(new).tolist(), strict=True))
        return [self.others[p] for p in pieces]

    def look_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot in the cache, and segment, of each pre-token of a block."""
        points, at = K.code_points(data, offsets)
        starts = K.pretoken_starts(points, at)
        segment = np.searchsorted(at, starts, "right") - 1
        if not len(starts):
            return np.zeros(0, np.int64), segment
        if self.size > CACHE_LIMIT:
            self._clear()
            self.make(None)
        ends = np.append(starts[1:], len(points))
        lengths = ends - starts
        distinct, first, inverse = np.unique(K.span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        found = self.index.find(distinct)
        old, new = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        strange = np.zeros(len(distinct), bool)  # hashes that are known for another pre-token
        strange[old] = ~equal_spans(points, starts[first[old]], lengths[first[old]], self.pool.data, self.starts.data[found[old]], self.lengths.data[found[old]])
        slots = np.full(len(distinct), -1, np.int64)
        slots[old] = self.slots[found[old]]
        if len(new):
            begin = starts[first[new]]
            slots[new] = self._add(_texts(points, begin, ends[first[new]]))
            self.index.add(distinct[new])
            self.slots = np.concatenate([self.slots, slots[new]])
            self.starts.extend(self.pool.size + np.cumsum(lengths[first[new]]) - lengths[first[new]])
            self.lengths.extend(lengths[first[new]])
            self.pool.extend(points[K.ragged(begin, lengths[first[new]])])
        out = slots[inverse]
        odd = np.flatnonzero(strange[inverse] | ~equal_spans(points, starts, lengths, points, starts[first][inverse], lengths[first][inverse]))
        if len(odd):
            out[odd] = self._by_text(_texts(points, starts[odd], ends[odd]))
        return out, segment


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.room, self.size = np.zeros(1024, kind), 0

    @property
    def data(self) -> np.ndarray:
        return self.room[: self.size]

    def extend(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.room):
            grown = np.zeros(max(2 * len(self.room), self.size + len(values)), self.room.dtype)
            grown[: self.size] = self.data
            self.room = grown
        self.room[self.size : self.size + len(values)] = values
        self.size += len(values)


def equal_spans(a: np.ndarray, a_starts: np.ndarray, a_lengths: np.ndarray, b: np.ndarray, b_starts: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """Whether the spans of one array are those of another, pair by pair."""
    out = a_lengths == b_lengths
    same = np.flatnonzero(out & (a_lengths > 0))
    lengths = a_lengths[same]
    hit = a[K.ragged(a_starts[same], lengths)] == b[K.ragged(b_starts[same], lengths)]
    if not hit.all():
        out[same] = np.logical_and.reduceat(hit, np.cumsum(lengths) - lengths)
    return out


def _texts(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    lengths = ends - starts
    text = points[K.ragged(starts, lengths)].astype("<u4").tobytes().decode("utf-32-le")
    cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [text[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


class Counter:
    """Token counts of string columns."""

    def __init__(self, path: str) -> None:
        self.merges, self.cache = Merges(path), PretokenCache(self._make)
        self.counts = np.zeros(0, np.int64)

    def _make(self, pieces: list[str] | None) -> None:
        if pieces is None:
            self.counts = np.zeros(0, np.int64)
        else:
            count = self.merges.count
            self.counts = np.concatenate([self.counts, np.fromiter((count(p.encode()) for p in pieces), np.int64, len(pieces))])

    def __call__(self, column: pa.Array) -> np.ndarray:
        parts, owner, follow = split_specials(column, self.merges.specials)
        out = np.zeros(len(column), np.int64)
        np.add.at(out, owner, (follow >= 0).astype(np.int64))
        for data, offsets, rows in K.blocks(parts):
            slots, segment = self.cache.look_up(data, offsets)
            out += np.bincount(owner[rows[segment]], weights=self.counts[slots], minlength=len(out)).astype(np.int64)
        return out


@cache
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with a column ``out`` (long): tokens of ``text`` under the byte-level BPE file at ``path``.

    Other columns pass through untouched; an existing column ``out`` is replaced.
    """
    spark = docs.sparkSession
    bounded(spark)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    target = docs.select(*kept)
    at = target.columns.index(text)
    schema = StructType([*target.schema.fields, StructField(out, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            counts = pa.array(count(batch.column(at)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, out])

    return target.mapInArrow(run, schema)


def op10_token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    kept = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(kept, path)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
