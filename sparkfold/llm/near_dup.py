"""Near duplicates by improved consistent weighted sampling over TF-IDF word shingles.

1. *Inverse document frequency.*  A shingle is five successive words.  Its TF-IDF weight is its count in
   the text times ``1 + ln(documents / documents that hold it)``, and every shingle is counted, exactly and over
   all documents: those that a document in 16 holds come to the driver first (by the pigeonhole principle one that is
   frequent in all is half as frequent, at least, in blocks that add up to half of it: blocks report what they
   hold often, and these candidates, at most twice the mean number of shingles over RARE whatever the size of the
   corpus, are then counted), so that they are no hot keys; all others are dealt out by their hash,
   and how many documents hold them goes back to their texts.  What comes back for no text is held by one document.
2. *Sampling.*  In each of ten rounds shingles fall into 64 bins anew and a consistent weighted sample is
   drawn from each bin by the TF-IDF weights (an empty bin borrows from another one, in an order of its own in each
   round), which makes 640 samples at the cost of ten evaluations a shingle.  A bin is one sample whatever it weighs, so a
   shingle that a text repeats is dealt out over bins: it is cut into pieces of the weight that one occurrence of the rarest shingle
   has, the last one less.  Sums of least and greatest weights, and so similarities, are those of the whole shingles, and a text has no more pieces than
   words.  As no two rounds share their bins, the samples of a band are independent for short texts as well.
3. *Banding.*  128 bands of 5 samples, each from a round of its own.  By TF-IDF a pair of copies is less alike than
   by step 4, as what they share is held by more documents than what they don't: where that is 0.67 in place of 0.8, a pair shares no
   band in about 1 of 10⁷ cases, with 0.53 in 1 of 240.  Rows are sorted by band key and further samples, and the first texts of a bucket are all tied to each other, later ones to
   the text before them, as similar texts are neighbours in that order (step 5 compares all other pairs of such a bucket).  The order is dealt out by ranges, so a key
   that a third of all texts share is the work of many tasks.
4. *Verification.*  Candidate links are checked by the Jaccard similarity of whole texts, which a shingle enters with its
   count; only one that a document in 16 holds has less weight there, ``1 + ln(documents / documents that hold it)`` over
   ``1 + ln 16``.  So the threshold means the same on corpora of every size.  The
   connected components of the links that hold are the classes so far.
5. *The rest of a bucket.*  In a bucket with more texts than are tied to each other, or one that a border of
   two tasks may cut, all other pairs are compared as well, unless the classes have joined them already: whole tables of overlaps are computed, in
   parts of bounded size, and what they join is added to the classes.  Buckets that share texts or classes are compared
   as one group where that is less work, so a family that shares a hundred buckets is compared once.  So each pair that shares a band and
   reaches the threshold is in one class.

Equal texts are one node from the start (by a 64-bit hash of the text), so copies cost nothing beyond
the first one of each task.

A letter of a script that is written without spaces (Han, Kana, Thai and others) is a word of its own.

Defined results: a null text counts as empty; texts without a word are in one class only with equal
texts; a text of one to four words is a single shingle; repeated rows share a class; a null doc_id gets
the class of its text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .graph import components
from .session import bounded, discard, stored, stored_tidily

U64 = np.uint64
SHINGLE_WORDS = 5
#: Shingles in less than this share of the documents have full weight in the check of a link, and are counted by a shuffle.
RARE = 1 / 16
BINS, ROUNDS, BANDS = 64, 10, 128
#: Samples of a band; bands beyond the first BINS take the next rounds.
BAND_SAMPLES = ROUNDS * BINS // BANDS
#: Shingles of a block that reports what it holds often; a block goes on over the batches of a task, so that it has many documents.
BLOCK_SHINGLES = 1 << 21
#: Ranges of hashes that shingles are counted in: one for so many bytes of text, and so many at least.
RANGE_BYTES, RANGES = 1 << 24, 64
#: Rows before it, in the order of further samples, that each of the first texts of a bucket is tied to.
NEIGHBOURS = 5
#: Hashes of texts that a task remembers, so as not to send a copy again.
REMEMBERED = 1 << 20
#: Distinct texts of a bucket that are all tied to each other by that.
TIED = NEIGHBOURS + 2
#: Texts, and bytes of their shingles, of a part of a bucket or group; two parts are compared in one task.
PART_TEXTS, PART_BYTES = 4096, 1 << 24
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)


def shingles(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 52-bit shingle hash, count), sorted by row and hash."""
    word, row = K.word_hashes(column)
    n = len(word)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    # segments of one text follow each other, so its words do as well
    wide, rows = np.concatenate([word, np.zeros(4, U64)]), np.concatenate([row, np.full(4, -1)])
    total = word * _STEPS[0]
    for k in range(1, SHINGLE_WORDS):
        total += np.where(rows[k : n + k] == row, wide[k : n + k] * _STEPS[k], U64(0))
    counts = np.bincount(row)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    valid = (rows[4 : n + 4] == row) | (first & (counts[row] < SHINGLE_WORDS))
    key = (row[valid].astype(U64) << U64(52)) | (K.mix64(total[valid]) >> U64(12))
    key, count = np.unique(key, return_counts=True)
    return (key >> U64(52)).astype(np.int64), key & U64((1 << 52) - 1), count


def _slices(column: pa.Array, *others: pa.Array) -> Iterator[tuple]:
    """At most 4096 rows at a time, as the row has 12 bits in a key."""
    for i in range(0, len(column), 4096):
        yield column.slice(i, 4096), *(x.slice(i, 4096) for x in others)


def _unseen(nodes: list[int], seen: set[int]) -> list[int]:
    """Places of the hashes that are not in ``seen``, which learns them; it starts anew when it is full."""
    fresh = []
    for i, x in enumerate(nodes):
        if x not in seen:
            seen.add(x)
            fresh.append(i)
    if len(seen) > REMEMBERED:  # later copies are sent again, and dropped behind the shuffle
        seen.clear()
    return fresh


def _text(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def _nodes(docs: DataFrame, text: str) -> DataFrame:
    return _text(docs, text).select(F.xxhash64("text").alias("node"), "text")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each node of a task, so that copies don't move."""
    seen: set[int] = set()
    for batch in batches:
        yield batch.take(pa.array(_unseen(batch.column(0).to_numpy().tolist(), seen), pa.int64()))


def frequent_shingles(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and weights of the shingles that at least the share RARE of all documents hold."""
    texts = _text(docs, text)

    def report(found: list[np.ndarray], held_by: int) -> pa.RecordBatch:
        shingle, held = np.unique(np.concatenate(found), return_counts=True)
        kept = held >= RARE / 2 * held_by
        # one row with hash -1 counts the documents of the block
        return pa.RecordBatch.from_arrays([pa.array(np.append(shingle[kept].astype(np.int64), -1)), pa.array(np.append(held[kept], held_by))], names=["shingle", "held"])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held_by, size = [], 0, 0
        for batch in batches:
            for (column,) in _slices(batch.column(0)):
                found.append(shingles(column)[1])
                held_by, size = held_by + len(column), size + len(found[-1])
                if size >= BLOCK_SHINGLES:
                    yield report(found, held_by)
                    found, held_by, size = [], 0, 0
        if held_by:
            yield report(found, held_by)

    reported = stored(texts.mapInArrow(often, "shingle long, held long").groupBy("shingle").agg(F.sum("held").alias("held")))
    total = reported.where("shingle = -1").first()
    if total is None:
        discard(reported)
        return np.zeros(0, U64), np.zeros(0)
    least = RARE * total.held
    # at most 2 * (mean number of shingles) / RARE rows
    candidates = np.sort(np.array([r.shingle for r in reported.where((F.col("shingle") >= 0) & (F.col("held") >= least / 2)).collect()], U64))
    discard(reported)
    if not len(candidates):
        return candidates, np.zeros(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(candidates), np.int64)
        for batch in batches:
            for (column,) in _slices(batch.column(0)):
                found = shingles(column)[1]
                place = np.minimum(np.searchsorted(candidates, found), len(candidates) - 1)
                held += np.bincount(place[candidates[place] == found], minlength=len(held))
        hit = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(held[hit])], names=["place", "held"])

    held = np.zeros(len(candidates), np.int64)
    for r in texts.mapInArrow(count, "place long, held long").groupBy("place").agg(F.sum("held").alias("held")).collect():
        held[r.place] = r.held
    kept = held >= least
    return candidates[kept], 1 + np.log(total.held / held[kept])


def _lookup(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The value of each frequent shingle, 0 for the others."""
    known, value = frequent
    if not len(known):
        return np.zeros(len(hashes))
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[place] == hashes, value[place], 0)


def weights(hashes: np.ndarray, counts: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weight of each shingle in the check of a link: full weight for all that are not frequent."""
    idf = _lookup(hashes, frequent)
    return (counts * np.where(idf > 0, idf, 1 + np.log(1 / RARE))).astype(np.float32)


#: A shingle that two or more documents hold: its place in the sorted shingles of a text, and their number.
_HELD = np.dtype([("place", "<u4"), ("held", "<u4")])


def _packed(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _unpacked(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """Arrays of these types and of one length, which lie one behind another."""
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += out[-1].nbytes
    return out


#: What a part of a block says of each shingle: its hash in three pieces, its text, its place less its number in the part, copies of its text.
_SENT = ("<u4", "<u2", "u1", "<u2", "<i4", "<u2")
#: What comes back: text, place, number of documents.
_BACK = ("<u2", "<u4", "<u4")


def document_frequencies(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, text: str = "text") -> DataFrame:
    """(node, held) of every text hash: as bytes, how many documents hold each of its shingles, if that is two or more.

    The shingles of a block of texts go by ranges of their hashes to the parts in which they are counted, and what two or more
    documents hold goes back to the block.  ``size`` is the bytes of all texts: a part has the shingles of RANGE_BYTES of them.  The
    frequent shingles are left out, so no range has many rows of one of them.  A stored table; nodes can repeat, with equal values.
    """
    ranges = max(RANGES, -(-size // RANGE_BYTES))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column, texts in _slices(batch.column(0), batch.column(1)):
                node, first, copies = np.unique(column.to_numpy(), return_index=True, return_counts=True)
                row, hashes, _ = shingles(texts.take(pa.array(first)))
                place = np.arange(len(row)) - np.searchsorted(row, row)
                rare = _lookup(hashes, frequent) == 0
                row, hashes, place = row[rare], hashes[rare], place[rare]
                part = ((hashes >> U64(20)) * U64(ranges) >> U64(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                row, hashes, place = row[order], hashes[order], place[order]
                cuts = np.searchsorted(part[order], np.arange(ranges + 1))
                # the same for the same texts, should a task run again
                block = int.from_bytes(blake2b(node.tobytes(), digest_size=8).digest(), "little", signed=True)
                keeper, parts, sent, nodes = block % ranges, [], [], []
                for p, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if i < j or p == keeper:
                        h = hashes[i:j]
                        pieces = h.astype(np.uint32), (h >> U64(32)).astype(np.uint16), (h >> U64(48)).astype(np.uint8)
                        parts.append(p)
                        # within a text the places of a range of hashes follow each other, so the differences compress well
                        sent.append(_packed(*pieces, row[i:j].astype(np.uint16), (place[i:j] - np.arange(j - i)).astype(np.int32), copies[row[i:j]].astype(np.uint16)))
                        nodes.append(node.tobytes() if p == keeper else None)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array(sent, pa.binary()), pa.array(nodes, pa.binary())], names=["part", "block", "sent", "nodes"])

    def count(table: pa.Table) -> pa.Table:
        columns = [_unpacked(x, _SENT) for x in table.column("sent").to_pylist()]
        low, middle, high, copies = (np.concatenate([c[i] for c in columns]) for i in (0, 1, 2, 5))
        hashes = low | middle.astype(U64) << U64(32) | high.astype(U64) << U64(48)
        order = np.argsort(hashes)
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        held = np.zeros(len(hashes), np.uint32)
        if len(first):
            held[order] = np.repeat(np.add.reduceat(copies[order].astype(np.int64), first), np.diff(np.append(first, len(hashes))))
        back, at = [], 0
        for column in columns:
            here = held[at : at + len(column[0])]
            at += len(here)
            kept = np.flatnonzero(here > 1)
            back.append(_packed(column[3][kept], (column[4][kept] + kept).astype(np.uint32), here[kept]))
        return pa.table([table.column("block"), pa.array(back, pa.binary()), table.column("nodes")], names=["block", "back", "nodes"])

    def gather(table: pa.Table) -> pa.Table:
        node = np.frombuffer(next(x for x in table.column("nodes").to_pylist() if x is not None), np.int64)
        columns = [_unpacked(x, _BACK) for x in table.column("back").to_pylist()]
        row, place, held = (np.concatenate([c[i] for c in columns]) for i in range(3))
        order = np.lexsort((place, row))
        known = np.empty(len(row), _HELD)
        known["place"], known["held"] = place[order], held[order]
        present = np.unique(row)
        cuts = np.searchsorted(row[order], np.append(present, len(node)))
        return pa.table([pa.array(node[present]), pa.array([known[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["node", "held"])

    sent = _nodes(docs, text).mapInArrow(deal, "part int, block long, sent binary, nodes binary")
    back = sent.groupBy("part").applyInArrow(count, "block long, back binary, nodes binary")
    return stored_tidily(back.groupBy("block").applyInArrow(gather, "node long, held binary"))


def tf_idf(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], held: pa.Array, documents: int) -> np.ndarray:
    """TF-IDF weight of each shingle of the texts; ``held`` is their column of ``document_frequencies``, null without any."""
    idf = _lookup(hashes, frequent)
    idf[idf == 0] = 1 + np.log(documents)
    starts = np.searchsorted(rows, np.arange(len(held)))
    for start, table in zip(starts.tolist(), held.to_pylist(), strict=True):
        if table:
            known = np.frombuffer(table, _HELD)
            idf[start + known["place"]] = 1 + np.log(documents / known["held"])
    return (counts * idf).astype(np.float32)


def pieces(rows: np.ndarray, hashes: np.ndarray, weight: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles in pieces that weigh ``most``, the last one of each what is left; a first piece has the hash of its shingle."""
    exact = weight.astype(np.float64)
    number = np.maximum(np.ceil(exact / most - 1e-6), 1).astype(np.int64)
    if not len(number) or number.max() == 1:
        return rows, hashes, weight
    shingle = np.repeat(np.arange(len(number)), number)
    piece = np.arange(len(shingle)) - np.repeat(np.cumsum(number) - number, number)
    cut = np.full(len(shingle), most, np.float32)
    last = np.cumsum(number) - 1
    cut[last] = exact - (number - 1) * most
    named = np.where(piece > 0, K.mix64(hashes[shingle] + piece.astype(U64) * _STEPS[0]), hashes[shingle])
    return rows[shingle], named, cut


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of a Gamma(2, 1) variable in 65 536 steps, their logarithms, and the order in which empty bins borrow in each round."""
    p, x = (np.arange(65536) + 0.5) / 65536, np.linspace(0, 40, 2_000_001)
    gamma = np.interp(p, 1 - (1 + x) * np.exp(-x), x)
    order = np.array([[np.random.default_rng(j * BINS + b).permutation([c for c in range(BINS) if c != b]) for b in range(BINS)] for j in range(ROUNDS)])
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32), order


def signatures(rows: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a shingle, their samples as uint32 [rows, ROUNDS, BINS])."""
    gamma, log_gamma, order = _tables()
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, ROUNDS, BINS), np.uint32)
    log_w = np.log(weight)
    present, row = np.unique(rows, return_inverse=True)
    out = np.zeros((len(present), ROUNDS, BINS), np.uint32)
    for j in range(ROUNDS):
        x = K.mix64(hashes + U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r = gamma[(x & U64(0xFFFF)).astype(np.int64)]
        beta = ((x >> U64(32)) & U64(0xFFFF)).astype(np.float32) / np.float32(65536)
        t = np.floor(log_w / r + beta)
        log_a = log_gamma[((x >> U64(16)) & U64(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
        bits = np.ascontiguousarray(log_a, np.float32).view(np.uint32)
        bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
        code = K.mix64(x + t.astype(np.int64).astype(U64)) >> U64(32)
        least = np.full((len(present), BINS), ~U64(0))
        np.minimum.at(least.reshape(-1), row * BINS + (x >> U64(58)).astype(np.int64), (bits.astype(U64) << U64(32)) | code)
        filled = least != ~U64(0)
        out[:, j] = (least & U64(0xFFFFFFFF)).astype(np.uint32)
        missing = np.argwhere(~filled)
        step = 0
        while len(missing):
            lender = order[j, missing[:, 1], step]
            good = filled[missing[:, 0], lender]
            out[missing[good, 0], j, missing[good, 1]] = out[missing[good, 0], j, lender[good]]
            missing, step = missing[~good], step + 1
    return present, out


def band_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands, uint64 [rows, BANDS], and the order within a bucket: four more samples, 16 bits each."""
    keys, orders = np.zeros((len(samples), BANDS), U64), np.zeros((len(samples), BANDS), U64)
    for i in range(BANDS):
        first = i // BINS * BAND_SAMPLES
        for j in range(first, first + BAND_SAMPLES):
            keys[:, i] = K.mix64(keys[:, i] + samples[:, j, (i + 9 * j) % BINS].astype(U64) + U64(i + 1))
        for j in range(first, first + 4):
            orders[:, i] = (orders[:, i] << U64(16)) | (samples[:, j, (i + 9 * j + 31) % BINS].astype(U64) & U64(0xFFFF))
    return keys, orders >> U64(1)


def candidate_links(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], held: DataFrame, documents: int, text: str) -> DataFrame:
    """Distinct pairs (a, b), a < b, of hashes of texts that are neighbours in some bucket, with a null key.

    A bucket with more than TIED texts adds a row (a, a, key) for each of its texts, and so do the first and the
    last bucket of each task, which its neighbours may hold a part of.
    """
    nodes = _nodes(docs, text)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, column, known in _slices(batch.column(0), batch.column(1), batch.column(2)):
                rows, hashes, counts = shingles(column)
                weight = tf_idf(rows, hashes, counts, frequent, known, documents)
                present, samples = signatures(*pieces(rows, hashes, weight, 1 + np.log(documents)), len(node))
                keys, orders = band_rows(samples)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(orders.view(np.int64).ravel()), pa.array(np.repeat(node.to_numpy()[present], BANDS))], names=["key", "further", "node"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last rows before a batch, and the first node and the size of the bucket that is still open
        keys, nodes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        opening_key, leader_key, leader, size = None, None, 0, 0

        def rows(both: np.ndarray, held_keys: np.ndarray, held_nodes: np.ndarray) -> pa.RecordBatch:
            key_column = pa.concat_arrays([pa.nulls(both.shape[1], pa.int64()), pa.array(held_keys, pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.append(both[0], held_nodes)), pa.array(np.append(both[1], held_nodes)), key_column], names=["a", "b", "key"])

        for batch in batches:
            key, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            # a text that several tasks have sent takes one place
            before = np.concatenate([keys[-1:], key]), np.concatenate([nodes[-1:], node])
            fresh = np.concatenate([np.ones(1 - min(1, len(keys)), bool), (before[0][1:] != before[0][:-1]) | (before[1][1:] != before[1][:-1])])[: len(key)]
            key, node = key[fresh], node[fresh]
            if not len(key):
                continue
            if opening_key is None:
                opening_key = key[0]
            old = len(keys)
            keys, nodes = np.concatenate([keys, key]), np.concatenate([nodes, node])
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lengths = np.diff(np.append(first, len(key)))
            rank = np.arange(len(key)) - np.repeat(first, lengths)
            heads = node[first].copy()
            if key[0] == leader_key:
                heads[0] = leader
                rank[: lengths[0]] += size
            pairs = []
            for lag in range(1, NEIGHBOURS + 1):
                at = np.arange(max(old, lag), len(keys))
                at = at[keys[at] == keys[at - lag]]
                if lag > 1:  # a larger bucket is compared as a whole later on
                    at = at[rank[at - old] < TIED]
                pairs.append(np.stack([nodes[at - lag], nodes[at]]))
            few = rank < TIED  # as above
            pairs.append(np.stack([np.repeat(heads, lengths)[few], node[few]]))
            leader_key, leader, size = key[-1], heads[-1], rank[-1] + 1
            # the first text beyond TIED brings those before it along; the task's first bucket is reported from its first text
            edge = key == opening_key
            beyond, opening = old + np.flatnonzero((rank >= TIED) | edge), old + np.flatnonzero((rank == TIED) & ~edge)
            held = np.concatenate([beyond, (opening[:, None] - np.arange(1, TIED + 1)).ravel()])
            held_keys, held_nodes = keys[held], nodes[held]
            keys, nodes = keys[-TIED:], nodes[-TIED:]
            both = np.concatenate(pairs, axis=1)
            both = both[:, both[0] != both[1]]
            both.sort(axis=0)
            order = np.lexsort((both[1], both[0]))
            both = both[:, order]
            if both.shape[1]:
                both = both[:, np.concatenate([[True], (both[:, 1:] != both[:, :-1]).any(axis=0)])]
            yield rows(both, held_keys, held_nodes)
        last = np.flatnonzero(keys == leader_key) if len(keys) else keys
        if len(last) and size <= TIED:  # a larger one has been reported
            yield rows(np.zeros((2, 0), np.int64), keys[last], nodes[last])

    # stored first: the borders of the ranges are taken from a sample of the rows
    texts = nodes.mapInArrow(_once, nodes.schema).join(held.dropDuplicates(["node"]).hint("merge"), "node", "left").dropDuplicates(["node"])
    bands = stored_tidily(texts.mapInArrow(sketch, "key long, further long, node long"))
    found = stored_tidily(bands.repartitionByRange("key", "further", "node").sortWithinPartitions("key", "further", "node").mapInArrow(neighbours, "a long, b long, key long").distinct())
    discard(bands)
    return found


def similarity(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of shingle tables (structured arrays, sorted by h)."""
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if not len(x) or not len(y):
            continue
        place = np.minimum(np.searchsorted(y["h"], x["h"]), len(y) - 1)
        same = y["h"][place] == x["h"]
        low = float(np.minimum(x["w"][same], y["w"][place[same]]).sum())
        total = float(x["w"].sum()) + float(y["w"].sum()) - low
        out[i] = low / total
    return out


_SHINGLE = np.dtype([("h", "<u4"), ("w", "<f4")])


def shingle_tables(docs: DataFrame, links: DataFrame, frequent: tuple[np.ndarray, np.ndarray], text: str) -> DataFrame:
    """(node, shingles) of every text in ``links``: its shingles and their weights, as bytes."""
    nodes = _nodes(docs, text)
    wanted = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, column in _slices(batch.column(0), batch.column(1)):
                rows, hashes, counts = shingles(column)
                weight = weights(hashes, counts, frequent)
                at = np.searchsorted(rows, np.arange(len(column) + 1))
                table = np.empty(len(rows), _SHINGLE)
                # the upper 32 of the 52 bits keep the order
                table["h"], table["w"] = (hashes >> U64(20)).astype(np.uint32), weight
                yield pa.RecordBatch.from_arrays([node, pa.array([table[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "shingles"])

    # a task sends one text of each node, and the join is the same at every size
    distinct = nodes.mapInArrow(_once, nodes.schema)
    return distinct.join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(tabulate, "node long, shingles binary")


def verified_links(candidates: DataFrame, tables: DataFrame, threshold: float) -> DataFrame:
    """The candidate links whose texts have a weighted Jaccard similarity of ``threshold`` at least."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(x, _SHINGLE) for x in batch.column(i).to_pylist()] for i in (2, 3))
            good = pa.array(similarity(left, right) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    left, right = (tables.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_shingles")) for side in "ab")
    return candidates.join(left, "a").join(right, "b").select("a", "b", "a_shingles", "b_shingles").mapInArrow(check, "a long, b long")


def overlaps(some: np.ndarray, n: int, h: np.ndarray, w: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Sum of the lesser weights, float32 [some, n], of the texts ``some`` and all n; (h, w, row) are sorted by h."""
    out = np.zeros((len(some), n), np.float32)
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(h)))
    often = lengths >= max(16, n // 32)
    # shingles of many texts: columns of a matrix; the least weight of a column is a product, what exceeds it goes on
    chosen = np.flatnonzero(often)
    for i in range(0, len(chosen), 512):
        part = chosen[i : i + 512]
        entry = K.ragged(starts[part], lengths[part])
        x = np.zeros((n, len(part)), np.float32)
        x[row[entry], np.repeat(np.arange(len(part)), lengths[part])] = w[entry]
        for _ in range(4):
            held = x > 0
            least = np.where(held, x, np.inf).min(axis=0).astype(np.float32)
            some_held = held[some] * least
            out += some_held @ held.astype(np.float32).T
            x = np.where(held, x - least, 0)
            x = x[:, x.any(axis=0)]
            if not x.shape[1]:
                break
        for c in range(x.shape[1]):
            out += np.minimum.outer(x[some, c], x[:, c])
    # shingles of few texts: their entries meet one by one
    run = np.repeat(np.arange(len(starts)), lengths)
    back = np.full(n, -1)
    back[some] = np.arange(len(some))
    mine = np.flatnonzero((back[row] >= 0) & ~often[run] & (lengths[run] > 1))
    pairs = np.cumsum(lengths[run[mine]])
    cuts = np.searchsorted(pairs, np.arange(1 << 20, pairs[-1] + (1 << 20), 1 << 20)) if len(mine) else []
    for part in np.split(mine, cuts):
        size = lengths[run[part]]
        other, own = K.ragged(starts[run[part]], size), np.repeat(part, size)
        np.add.at(out.reshape(-1), back[row[own]] * n + row[other], np.minimum(w[own], w[other]))
    return out


def joined(tables: list[np.ndarray], component: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between components that hold a pair of similar texts: as many as join all that these pairs join."""
    ids, group = np.unique(component, return_inverse=True)
    if len(ids) < 2:
        return []
    n, links = len(tables), []
    total = np.array([t["w"].sum(dtype=np.float64) for t in tables])
    row = np.repeat(np.arange(n), [len(t) for t in tables])
    whole = np.concatenate(tables)
    order = np.argsort(whole["h"], kind="stable")
    h, w, row = whole["h"][order], whole["w"][order], row[order]
    # a pair of two components has a text outside the largest one
    main = int(np.bincount(group).argmax())
    todo = np.flatnonzero(group != main)
    while len(todo):
        some, todo = todo[:1024], todo[1024:]
        low = overlaps(some, n, h, w, row)
        likely = low / (total[some, None] + total - low) >= threshold - 1e-4
        for i, found in zip(some.tolist(), likely, strict=True):
            others = np.flatnonzero(found & (group != group[i]))
            while len(others):
                j = int(others[0])
                others = others[1:]
                if similarity([tables[i]], [tables[j]])[0] >= threshold:
                    links.append((int(component[i]), int(component[j])))
                    a, b = group[i], group[j]
                    if a == main:
                        a, b = b, a
                    group[group == a] = b
                    others = others[group[others] != group[i]]
        todo = todo[group[todo] != main]
    return links


def bucket_groups(placed: DataFrame) -> DataFrame:
    """(unit, node, component): the texts of ``placed`` (key, node, component) that have to be compared with each other.

    A bucket whose texts are all in one component is left out.  A family of alike texts shares many buckets, so buckets that are
    tied to each other by a component, directly or by others, become one unit, in which each text has one row: where all pairs of
    the group are no more than all pairs of its buckets, one by one.  Else each bucket stays a unit.  No pair of a bucket is lost.
    """
    mixed = stored(placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y").select("key", "x", "n"))
    rows = stored(placed.join(mixed.select("key", "x"), "key"))
    tied = components(rows.select(F.col("x").alias("a"), F.col("component").alias("b")))
    groups = tied.select(F.col("node").alias("component"), F.col("component").alias("group"))
    texts = stored(rows.select("node", "component").distinct().join(groups, "component"))
    singly = mixed.withColumnRenamed("x", "component").join(groups, "component").groupBy("group").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("singly"))
    at_once = texts.groupBy("group").agg(F.count("*").cast("double").alias("n")).join(singly, "group")
    at_once = stored(at_once.select("group", (F.col("n") * F.col("n") <= F.col("singly")).alias("at_once")))
    apart = rows.select("key", "node", "component").join(groups.join(at_once.where("NOT at_once"), "group").select("component"), "component")
    whole = texts.join(at_once.where("at_once"), "group")
    out = stored(whole.select(F.col("group").alias("unit"), "node", "component").unionByName(apart.select(F.col("key").alias("unit"), "node", "component")))
    discard(mixed, rows, tied, texts, at_once)
    return out


def _parts(texts: Column, size: Column) -> Column:
    return F.ceil(F.greatest(texts / PART_TEXTS, size / PART_BYTES)).cast("int")


def with_whole_buckets(linked: DataFrame, members: DataFrame, tables: DataFrame, threshold: float) -> DataFrame:
    """The components ``linked`` after all pairs of the buckets ``members`` (key, node) have been compared.

    The texts of the largest component of a unit and the others are dealt out to parts of their own.  Any two parts meet
    in one task, but for two of the largest component, which has nothing to compare: so where the others are one part, each text of that
    component has one row, however many there are.
    """
    placed = stored(members.join(linked, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")))
    units = bucket_groups(placed)
    discard(placed)
    sized = stored(units.join(tables.select("node", F.octet_length("shingles").alias("bytes")), "node"))
    discard(units)
    shares = sized.groupBy("unit", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    shares = shares.groupBy("unit").agg(F.max(F.struct("n", "component", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    others, most = _parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")), _parts(F.col("main.n"), F.col("main.size"))
    # stored, so that the join deals out both sides anew and Spark can split a large unit
    dealt = stored(shares.select("unit", F.col("main.component").alias("main"), others.alias("others"), most.alias("most")))
    here = F.hash("node")
    rows = sized.join(dealt, "unit").withColumn("p", F.when(F.col("component") == F.col("main"), F.col("others") + F.pmod(here, F.col("most"))).otherwise(F.pmod(here, F.col("others"))))
    rows = rows.withColumn("q", F.explode(F.expr("filter(sequence(0, others + most - 1), q -> q <> p AND least(p, q) < others)")))
    rows = rows.select("unit", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), "node", "component").join(tables, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            links = joined(held, np.array(component, np.int64), threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        held: list[np.ndarray] = []
        component: list[int] = []
        last = None
        for batch in batches:
            for *place, here, table in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != last:
                    if held:
                        yield found()
                    held, component, last = [], [], place
                held.append(np.frombuffer(table, _SHINGLE))
                component.append(here)
        if held:
            yield found()

    rows = rows.select("unit", "low", "high", "component", "shingles").repartition("unit", "low", "high").sortWithinPartitions("unit", "low", "high")
    links = stored(rows.mapInArrow(compare, "a long, b long"))
    discard(sized, dealt)
    if links.isEmpty():
        return linked
    moved = components(links).select(F.col("node").alias("component"), F.col("component").alias("least"))
    discard(links)
    alone = moved.join(linked.select("component"), "component", "left_anti").select(F.col("component").alias("node"), F.col("least").alias("component"))
    return linked.join(moved, "component", "left").select("node", F.coalesce("least", "component").alias("component")).unionByName(alone)


def classes(docs: DataFrame, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """(node, component) of every text hash that has a verified link to another text; a stored table."""
    bounded(docs.sparkSession)
    frequent = frequent_shingles(docs, text)
    documents, size = _text(docs, text).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    held = document_frequencies(docs, frequent, size, text)
    found = candidate_links(docs, frequent, held, documents, text)
    discard(held)
    candidates = found.where("key IS NULL").select("a", "b")
    tables = stored(shingle_tables(docs, found, frequent, text))
    linked = components(verified_links(candidates, tables, threshold))
    members = found.where("key IS NOT NULL").select("key", F.col("a").alias("node"))
    out = linked
    if not members.isEmpty():
        out = stored(with_whole_buckets(linked, members, tables, threshold))
        discard(linked)
    discard(found, tables)
    return out


def _node(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) of every row of ``docs``."""
    linked = classes(docs, threshold, text)
    placed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _node(text).alias("node")).join(linked, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    # stored, so that the join below deals both sides out anew and Spark can split the rows of a large class
    least = stored(placed.groupBy("component").agg(F.min("doc_id").alias("class_id")))
    return placed.join(least, "component").select("doc_id", "class_id")


def keep_first(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that of the least doc_id.  The columns are those of ``docs``; a row travels as one struct."""
    linked = classes(docs, threshold, text)
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1)).alias("id"), _node(text).alias("node"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    placed = rows.select("id", "node").join(linked, "node", "left")
    chosen = placed.groupBy(F.coalesce("component", "node").alias("component")).agg(F.min(F.struct("id", "node")).alias("x")).select("x.id", "x.node")
    kept = rows.join(chosen, ["node", "id"], "left_semi").dropDuplicates(["node", "id"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
