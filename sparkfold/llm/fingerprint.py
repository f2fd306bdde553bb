"""Document fingerprints from improbable byte windows, kept in chained Bloom filters.

The entropy of every window of ``WINDOW`` bytes is a sum of whole numbers that slides along the text.  How
often each level of entropy occurs is counted over all texts; the rarer its level, the better a window ranks.
Within every ``AROUND`` successive windows the best one (leftmost on ties) gets a point, and a window with
``POPULAR`` points is a feature.  Windows of little entropy (runs of one character) rank last, whatever
their number.  The features of a text, each once and in order, go to Bloom filters of ``BITS`` bits, which
are chained: after ``PER_FILTER`` features the next filter begins.

Two fingerprints are compared filter by filter.  The overlap of two filters is the number of common bits
beyond what chance gives, as a share of the most that is possible; within four standard deviations of
chance it is 0.  Each filter of the shorter chain takes its best counterpart; their mean, weighted by
features, is the likeness.

A choice of features depends on the bytes around them alone, so texts are walked in blocks of bounded size.
Comparing two chains costs the product of their lengths (one filter stands for about 4 kB).

Defined results: a null text is an empty one, without features, its fingerprint is the empty string; a text
in which no window is popular (as in all very short ones) has one feature, its whole bytes; equal
fingerprints have likeness 1, an empty one and any other 0.  Neighbours are in the order of doc_id, a null
one last, equal ones by a hash of their texts; the last is followed by the first, a lone document by itself.
Repeated rows stay; an empty table gives an empty result; other columns pass through or are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import kernels as K
from .session import bounded

WINDOW, AROUND, POPULAR = 32, 32, 8
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Entropy (bits a byte) below which a window ranks last.
WEAK = 2.0
#: Bytes that are looked at together.
BLOCK = 1 << 18

_UNIT, _SHIFT = 1 << 16, 13
#: c * log2(c) as whole numbers; the sum over the bytes of a window falls as its entropy rises.
_TERM = np.array([0, *(round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1))], np.int32)
LEVELS = (int(_TERM[WINDOW]) >> _SHIFT) + 1
_PLACE = 19


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Level of the window that begins at each byte: 0 where all bytes differ, LEVELS - 1 where all are equal."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    behind, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    same = np.empty(n, bool)
    for k in range(1, WINDOW):  # equal bytes among the WINDOW - 1 before and after each
        hit = np.equal(data[k:], data[:-k], out=same[: n - k]).view(np.uint8)
        behind[k:] += hit
        ahead[:-k] += hit
    step = _TERM[:-1] - _TERM[1:]  # change of the sum as the last but m equal bytes lose one
    first = _TERM[np.bincount(data[:WINDOW], minlength=256)].sum()
    change = step[ahead[: n - WINDOW]] - step[behind[WINDOW:]]
    return np.concatenate([[first], first + np.cumsum(change, dtype=np.int32)]).astype(np.int32) >> _SHIFT


def _overhang(offsets: np.ndarray) -> np.ndarray:
    """Starts of windows that reach over the end of their text."""
    starts = np.maximum(offsets[:-1], offsets[1:] - WINDOW + 1)
    return K.ragged(starts, offsets[1:] - starts)


def level_counts(column: pa.Array) -> np.ndarray:
    """Windows of each level in the texts of a column."""
    data, offsets = K.text_buffers(column)
    counts, over = np.zeros(LEVELS, np.int64), _overhang(offsets)
    for at in range(0, len(data), BLOCK):
        levels = entropy_levels(data[at : at + BLOCK + WINDOW - 1])
        counts += np.bincount(levels, minlength=LEVELS)
        cut = over[np.searchsorted(over, at) : np.searchsorted(over, at + len(levels))] - at
        counts -= np.bincount(levels[cut], minlength=LEVELS)
    return counts


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, 0 for the rarest (ties: the higher entropy); weak ones come after all others."""
    weak = np.log2(WINDOW) - (np.arange(LEVELS) << _SHIFT) / (WINDOW * _UNIT) < WEAK
    order = np.lexsort((np.arange(LEVELS), counts, weak))
    ranks = np.empty(LEVELS, np.int32)
    ranks[order] = np.arange(LEVELS)
    return ranks


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the levels of entropy, counted over the windows of all texts; one number per level comes to the driver."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            total += level_counts(batch.column(0))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["level", "n"])

    counts = np.zeros(LEVELS, np.int64)
    for level, n in docs.select(F.col(f"`{text}`")).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n")).collect():
        counts[level] = n
    return ranks_of(counts)


def feature_places(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Starts of the windows that are features, ascending; texts are data[offset:next offset]."""
    span, out, total = WINDOW + AROUND - 1, [], len(data)
    long = np.flatnonzero(np.diff(offsets) >= span)
    begin, end = offsets[long], offsets[long + 1] - span + 1  # of the stretches of AROUND windows
    for at in range(0, total, BLOCK):
        to = min(total, at + BLOCK)
        low, high = max(0, at - AROUND + 1), min(total, to + span - 1)
        if high - low < span:
            continue
        best = (ranks[entropy_levels(data[low:high])] << _PLACE) | np.arange(high - low - WINDOW + 1, dtype=np.int32)
        width = 1
        while width < AROUND:
            take = min(width, AROUND - width)
            best = np.minimum(best[:-take], best[take:])
            width += take
        change = np.zeros(len(best) + 1, np.int64)
        a, b = np.searchsorted(end, low, "right"), np.searchsorted(begin, low + len(best))
        np.add.at(change, np.maximum(begin[a:b] - low, 0), 1)
        np.add.at(change, np.minimum(end[a:b] - low, len(best)), -1)
        winners = best[np.cumsum(change[:-1]) > 0] & ((1 << _PLACE) - 1)
        places = np.flatnonzero(np.bincount(winners, minlength=1) >= POPULAR) + low
        out.append(places[(places >= at) & (places < to)])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Digest:
    """Chained filters (as 64-bit numbers) and the features in each."""

    __slots__ = ("counts", "filters", "sizes")

    def __init__(self, filters: np.ndarray, counts: np.ndarray) -> None:
        self.filters, self.counts = filters, counts
        self.sizes = np.bitwise_count(filters).sum(1, dtype=np.int64)

    def __str__(self) -> str:
        return ",".join(f"{n}:{base64.b64encode(f.tobytes()).decode()}" for n, f in zip(self.counts.tolist(), self.filters, strict=True))

    @classmethod
    def parse(cls, text: str) -> Digest:
        parts = [x.split(":") for x in text.split(",")] if text else []
        raw = b"".join(base64.b64decode(x[1]) for x in parts)
        return cls(np.frombuffer(raw, np.uint64).reshape(-1, BITS // 64), np.array([int(x[0]) for x in parts], np.int64))


def digests(column: pa.Array, ranks: np.ndarray) -> list[Digest]:
    """The fingerprint of each text of a column."""
    data, offsets = K.text_buffers(column)
    raw, n = memoryview(np.ascontiguousarray(data)), len(offsets) - 1
    places = feature_places(data, offsets, ranks)
    rows = np.searchsorted(offsets, places, "right") - 1
    lone = np.flatnonzero((np.bincount(rows, minlength=n)[:n] == 0) & (np.diff(offsets) > 0))
    spans = [(p, p + WINDOW) for p in places.tolist()] + [(int(offsets[r]), int(offsets[r + 1])) for r in lone]
    rows = np.concatenate([rows, lone])
    hashes = np.frombuffer(b"".join([hashlib.sha1(raw[a:b], usedforsecurity=False).digest() for a, b in spans]), ">u4").reshape(-1, HASHES)
    name = (hashes[:, 0].astype(np.uint64) << np.uint64(32)) | hashes[:, 1]
    _, first = np.unique(np.rec.fromarrays([rows, name]), return_index=True)
    first.sort()  # rows ascend, but for lone texts
    first = first[np.argsort(rows[first], kind="stable")]
    rows, bits = rows[first], hashes[first].astype(np.int64) % BITS
    begin = np.searchsorted(rows, np.arange(n + 1))
    chains = -(-np.diff(begin) // PER_FILTER)
    base = np.concatenate([[0], np.cumsum(chains)])
    nth = np.arange(len(rows)) - begin[rows]
    owner = base[rows] + nth // PER_FILTER
    filled = np.bincount(owner, minlength=base[-1])
    out = []
    for row in range(n):  # bits of one text at a time: what is unpacked stays small
        flags = np.zeros((chains[row], BITS), bool)
        own = slice(begin[row], begin[row + 1])
        flags[np.repeat(owner[own] - base[row], HASHES), bits[own].ravel()] = True
        out.append(Digest(np.packbits(flags, axis=1).view(np.uint64).reshape(-1, BITS // 64), filled[base[row] : base[row + 1]]))
    return out


#: Pairs of filters that are compared at once.
PAIRS = 1 << 14


def likeness(a: Digest, b: Digest) -> float:
    """Likeness of two fingerprints, 0 to 1; it does not depend on their order."""
    if a.filters.shape == b.filters.shape and (a.filters == b.filters).all():
        return 1.0
    if not len(a.filters) or not len(b.filters):
        return 0.0
    if (len(b.filters), int(b.counts.sum()), b.filters.tobytes()) < (len(a.filters), int(a.counts.sum()), a.filters.tobytes()):
        a, b = b, a
    best, step = np.zeros(len(a.filters)), max(1, PAIRS // len(b.filters))
    for i in range(0, len(best), step):
        ours = a.sizes[i : i + step, None].astype(float)
        both = np.zeros((len(ours), len(b.filters)))
        for j in range(0, len(b.filters), PAIRS):
            both[:, j : j + PAIRS] = np.bitwise_count(a.filters[i : i + step, None] & b.filters[None, j : j + PAIRS]).sum(2, dtype=np.int64)
        most, chance = np.minimum(ours, b.sizes), ours * b.sizes / BITS
        noise = 4 * np.sqrt(chance * (1 - ours / BITS) * (1 - b.sizes / BITS))
        share = np.where(both > chance + noise, (both - chance) / np.maximum(most - chance, 1e-9), 0)
        best[i : i + step] = share.max(1)
    return float(min(1.0, (best * a.counts).sum() / a.counts.sum()))


def fingerprint(docs: DataFrame, ranks: np.ndarray, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text; a column of that name is replaced."""
    bounded(docs.sparkSession)
    target = docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in docs.columns if c not in (text, out)])
    schema = StructType([*target.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(str, digests(batch.column(0), ranks)), pa.string())], names=[*batch.schema.names, out])

    return target.mapInArrow(run, schema).select(*[c for c in docs.columns if c != out], out)


def _sort_key(doc_id: Column, text: Column) -> Column:
    return F.struct(doc_id.isNull().alias("last"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"))


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """part, guest, doc_id, text: the documents sorted, in range partitions that each end with a guest, the first row of the next.

    The first keys of the partitions come to the driver, as for any range partitioning.  Texts are shuffled
    once; a partition's row and its successor are then next to each other.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", _sort_key(F.col("doc_id"), F.col("text")))
    ranged = rows.select("key.*").repartitionByRange(n, "last", "id", "tie")
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct("last", "id", "tie")).alias("key")).collect()
    starts = sorted(tuple(r.key) for r in firsts)
    if not starts:
        return rows.select(F.lit(0).alias("part"), F.lit(False).alias("guest"), "doc_id", "text")
    table = F.from_json(F.lit(json.dumps([dict(zip(("last", "id", "tie"), s, strict=True)) for s in starts])), "array<struct<last:boolean,id:bigint,tie:bigint>>")
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
    at_most = F.aggregate(jumps, F.lit(0), lambda k, jump: F.when(F.get(table, k + jump - 1) <= F.col("key"), k + jump).otherwise(k))
    dealt = rows.withColumn("part", at_most - 1)
    before = F.when(F.get(table, F.col("part")) == F.col("key"), F.struct(F.pmod(F.col("part") - 1, F.lit(len(starts))).alias("part"), F.lit(True).alias("guest")))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    dealt = dealt.select("key", "doc_id", "text", F.explode(F.array_compact(F.array(own, before))).alias("to"))
    dealt = dealt.select("to.part", "to.guest", "key", "doc_id", "text").repartitionById(len(starts), F.col("part"))
    return dealt.sortWithinPartitions("part", "guest", "key").drop("key")


def compare_with_next(docs: DataFrame, ranks: np.ndarray, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Every document beside its edited text and the next document.

    The edited text is the text with its last half (rounded down) replaced by as many characters from the
    start of the next document, or by all of it.
    """
    bounded(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # a document whose successor has not come yet: doc_id, text, digest
        for batch in batches:
            pairs = []
            for guest, key, value, mark in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), digests(batch.column(3), ranks), strict=True):
                if waiting:
                    pairs.append((*waiting, value, mark))
                waiting = None if guest else (key, value, mark)
            edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for _, a, _, b, _ in pairs]
            marks = digests(pa.array(edited, pa.large_string()), ranks)
            rows = [
                (key, len(a), hashlib.sha256(e.encode()).hexdigest(), str(own), str(mark), likeness(own, mark), likeness(own, following))
                for (key, a, own, _, following), e, mark in zip(pairs, edited, marks, strict=True)
            ]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return in_order(docs, doc_id, text, parts).mapInArrow(run, schema)


def op12_fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with likenesses."""
    return compare_with_next(docs, rarity(docs))
