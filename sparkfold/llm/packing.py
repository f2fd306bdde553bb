"""Harmonic packing of token sequences.

A document is cut into pieces whose lengths fit reciprocal-capacity classes: class k takes pieces of
at most capacity/k tokens, and k of them fill a bin, whatever their exact lengths.  Cutting is free, so
a remainder is first cut at the largest capacity/k that it holds (those bins fill up without a gap) and
only a rest of at most capacity/CUT_CLASS tokens goes to its class as it is, where a bin wastes at most
one part in k + 1.  Every worker fills the bins of its own classes on its own: there is no shuffle, and
what waits in open bins is bounded by the number of classes.  Pieces that still wait in open bins when a
worker's input ends are laid end to end and cut at the capacity; the last of these sequences is cut at
powers of two, so it needs no padding.

Defined results: a null or empty text is the closing id alone; repeated rows are packed once each; a null
doc_id stays null; an empty table gives no piece.  A retried task packs its partition anew and as a whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import bounded
from .token_count import Merges, PretokenCache, split_specials

#: Pre-tokens that the library gets at a time.
BATCH = 4096
#: Remainders below capacity/CUT_CLASS tokens are not cut any more.
CUT_CLASS = 16

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class int"


class Encoder:
    """Token ids of string columns by the tokenizers library; distinct pre-tokens are encoded once per worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.specials = Merges(path).specials
        self.library = Tokenizer.from_file(path)
        self.cache = PretokenCache(self._make)
        self._make(None)

    def _make(self, pieces: list[str] | None) -> None:
        if pieces is None:
            self.pool, self.start, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        # a pre-token stands alone: the library does not split it again
        found = [x.ids for i in range(0, len(pieces), BATCH) for x in self.library.encode_batch_fast(pieces[i : i + BATCH], add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in found for i in x), np.uint32, int(length.sum()))])

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Row and chunks of ids of each text, in order."""
        parts, owner, follow = split_specials(column, self.specials)
        row, chunks, last = 0, [], -1

        def close(part: int) -> None:
            if follow[part] >= 0:
                chunks.append(np.array([follow[part]], np.uint32))

        for data, offsets, segments in K.blocks(parts):
            slots, segment = self.cache.look_up(data, offsets)
            length = self.length[slots]
            ids = self.pool[K.ragged(self.start[slots], length)]
            ends = np.cumsum(np.bincount(segment, weights=length, minlength=len(segments))).astype(np.int64)
            begin = 0
            for part, end in zip(segments.tolist(), ends.tolist(), strict=True):
                if part != last:
                    if last >= 0:
                        close(last)
                    if owner[part] != row:
                        yield row, chunks
                        row, chunks = int(owner[part]), []
                    last = part
                chunks.append(ids[begin:end])
                begin = end
        if last >= 0:
            close(last)
            yield row, chunks


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@cache
def cut_plan(rest: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """(length, class) of the pieces of a remainder that is shorter than the capacity."""
    out = []
    while rest:
        k = -(-capacity // rest)
        if capacity // k == rest or k > CUT_CLASS:
            out.append((rest, capacity // rest))
            break
        out.append((capacity // k, k))
        rest -= capacity // k
    return tuple(out)


def pack_stream(documents: Iterator[tuple[int | None, np.ndarray]], capacity: int, first_id: int) -> Iterator[tuple]:
    """Rows of SCHEMA for a stream of (doc_id, ids); sequence ids count up from ``first_id``."""
    bins: dict[int, list] = {}
    sequence = first_id

    def row(doc, start, ids, total, at, offset, kind):
        return doc, start, len(ids), zlib.crc32(ids.tobytes()), total, at, offset, kind

    for doc, ids in documents:
        total, start = len(ids), 0
        while total - start >= capacity:
            yield row(doc, start, ids[start : start + capacity], total, sequence, 0, 1)
            sequence += 1
            start += capacity
        for length, kind in cut_plan(total - start, capacity):
            waiting = bins.setdefault(kind, [])
            # a copy: the piece must not keep a whole long document in memory
            waiting.append((doc, start, ids[start : start + length].copy(), total))
            start += length
            if len(waiting) == kind:
                offset = 0
                for d, s, piece, t in waiting:
                    yield row(d, s, piece, t, sequence, offset, kind)
                    offset += len(piece)
                sequence += 1
                bins[kind] = []
    waiting = [piece for kind in sorted(bins) for piece in bins[kind]]
    left, room, offset = sum(len(p[2]) for p in waiting), 0, 0
    for doc, start, ids, total in waiting:
        while len(ids):
            if not room:
                room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                left -= room
                offset = 0
            take = ids[:room]
            yield row(doc, start, take, total, sequence, offset, 0)
            start, ids, room, offset = start + len(take), ids[room:], room - len(take), offset + len(take)
            if not room:
                sequence += 1


def pack(docs: DataFrame, path: str, capacity: int = 1024, closing_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every whole text into sequences of at most ``capacity`` tokens; one row per piece.

    ``sequence_id`` is unique over the table: the partition stands in its upper bits.  Within a sequence
    the offsets are gapless from 0.  ``bin_class`` is the class whose bin holds the piece, 0 for the
    sequences made of what was left in open bins.
    """
    bounded(docs.sparkSession)
    target = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        closing = np.array([closing_id], np.uint32)

        def documents():
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for row, chunks in encode(batch.column(1)):
                    yield ids[row], np.concatenate([*chunks, closing]).astype("<u4")

        rows = []
        for x in pack_stream(documents(), capacity, TaskContext.get().partitionId() << 40):
            rows.append(x)
            if len(rows) == 8192:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return target.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
