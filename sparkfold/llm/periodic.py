"""Periodic runs of words by Main-Lorentz divide and conquer.

A run is a stretch of successive words with smallest period q (words q apart are equal) that no neighbour
extends, long enough by words and by periods.  The words of a text become numbers.  A segment is halved at
its midpoint; Z-functions of the halves tell for every period how far the repetition that crosses the
midpoint reaches to either side, so all runs of a segment cost time in proportion to it, and those of a text
n log n.  A repetition that a segment's border cuts off belongs to a larger segment and is left to it;
intervals found for several periods keep the smallest.

A run of at least ``least`` words and ``periods`` periods repeats its first least - least // periods words
(see ``needed``) one period on.  Segments in which no such repetition begins within reach are skipped, which
changes no result: most texts have none and cost one sort of hashes.

Texts are split to words in pieces of bounded size; a text is held as one number per word, its distinct
words, and at most two Z-functions of the segment at hand.

Defined results: words are maximal runs of characters other than the six ASCII white spaces; a null or
blank text has no word and no run; repeated rows are treated alike; an empty table gives an empty result;
other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .session import bounded

#: Bytes of text that are split to words at a time.
PIECE_BYTES = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def pieces(data: memoryview | bytes) -> Iterator[bytes]:
    """The text in pieces that end at white space; a longer word stays whole."""
    at, raw = 0, np.frombuffer(data, np.uint8)
    while at < len(raw):
        end = at + PIECE_BYTES
        while end < len(raw):
            gap = np.flatnonzero(_SPACES[raw[end : end + PIECE_BYTES]])
            if len(gap):
                end += int(gap[0])
                break
            end += PIECE_BYTES
        yield bytes(data[at : min(end, len(raw))])
        at = end


def intern_words(data: memoryview | bytes) -> tuple[list[bytes], array]:
    """The distinct words of UTF-8 text in order of appearance, and the number of each of its words."""
    known: dict[bytes, int] = {}
    ids = array("i")
    for piece in pieces(data):
        ids.extend([known.setdefault(w, len(known)) for w in piece.split()])  # bytes split at the six ASCII spaces alone
    return list(known), ids


def z_function(word: array) -> np.ndarray:
    """For each place the length of the longest common prefix of the (non-empty) word and of what begins there."""
    n = len(word)
    z = array("i", bytes(4 * n))
    z[0] = n
    first, left, right, i = word[0], 0, 0, 1
    while i < n:
        if i >= right:
            try:
                i = word.index(first, i)  # all places before it have length 0
            except ValueError:
                break
            right = i
        elif z[i - left] < right - i:
            z[i] = z[i - left]
            i += 1
            continue
        while right < n and word[right] == word[right - i]:
            right += 1
        z[i] = right - i
        left = i
        i += 1
    return np.frombuffer(z, np.int32)


def needed(least: int, periods: int) -> int:
    """Words that every run repeats one period on: length - q >= (1 - 1/periods) * length, at its least."""
    return max(1, least - least // periods)


def next_alike(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``size`` words occur again, and the distance to the next occurrence (too small where hashes collide)."""
    n = len(ids) - size + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    unit = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    unit ^= unit >> np.uint64(29)
    total, factor = np.zeros(n, np.uint64), 1
    for k in range(size):
        total += unit[k : k + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    order = np.argsort(total, kind="stable")
    same = np.flatnonzero(total[order[1:]] == total[order[:-1]])
    at, distance = order[same], order[same + 1] - order[same]
    by = np.argsort(at)
    return at[by], distance[by]


def crossing(ids: np.ndarray, low: int, mid: int, high: int, least: int, periods: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the repetitions that cross ``mid`` within [low, high), as far as the segment lets them."""
    u, v, mark = ids[low:mid], ids[mid:high], np.array([-1], np.int32)
    ahead = z_function(array("i", np.concatenate([v, mark, u]).tobytes()))
    back = z_function(array("i", np.concatenate([u[::-1], mark, v[::-1]]).tobytes()))
    nu, nv = len(u), len(v)

    def reach(n: int, own: np.ndarray, other: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Periods 1 to n whose first repetition lies in the half of n words; how far each goes on in it, and into the other half."""
        q = np.arange(1, n + 1)
        along = np.append(own[1:n], 0)
        across = other[cap + 1 + n - q]
        # the other half is compared with the repetition, then with itself
        full = (across >= q) & (q < cap)
        across[full] += other[q[full]]
        return q, along, across

    for right, (q, along, across) in ((True, reach(nv, ahead, back, nu)), (False, reach(nu, back, ahead, nv))):
        length = q + along + across
        hit = np.flatnonzero((across > 0) & (length >= least) & (length >= periods * q))
        for p, a, b in zip(q[hit].tolist(), along[hit].tolist(), across[hit].tolist(), strict=True):
            yield (mid - b, mid + p + a, p) if right else (mid - p - a, mid + b, p)


def find_runs(ids: np.ndarray, least: int = 24, periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words and ``periods`` (two or more) periods, by start, then period."""
    n, size = len(ids), needed(least, periods)
    at, distance = next_alike(ids, size)
    if not len(at):
        return []
    found: dict[tuple[int, int], int] = {}
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        a, b = np.searchsorted(at, [low, high])
        near = distance[a:b]
        if not ((near * periods <= high - low) & (at[a:b] + near + size <= high)).any():
            continue
        mid = (low + high) // 2
        for start, end, q in crossing(ids, low, mid, high, least, periods):
            cut = (start == low > 0 and ids[low - 1] == ids[low - 1 + q]) or (end == high < n and ids[high] == ids[high - q])
            if not cut:  # else it goes on: a larger segment has it
                found[start, end] = min(q, found.get((start, end), q))
        todo += [(low, mid), (mid, high)]
    return sorted((start, end - start, q) for (start, end), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbers of the words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def collapse(words: list[bytes], ids: array, runs: list[tuple[int, int, int]]) -> bytes:
    """The kept words, joined by one space."""
    numbers = np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)
    if runs:
        numbers = numbers[kept_words(len(ids), runs)]
    step = 1 << 16
    return b" ".join(b" ".join([words[i] for i in numbers[k : k + step].tolist()]) for k in range(0, len(numbers), step))


RUNS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())]))


def periodic_runs(docs: DataFrame, text: str = "text", runs_as: str = "runs", collapsed_as: str = "collapsed", least: int = 24, periods: int = 3) -> DataFrame:
    """``docs`` with its runs (array of start, length, period, by start and period) and the text without repetitions.

    Columns of the names that are added are replaced.
    """
    if least < 2 or periods < 2:
        raise ValueError("a run has two words and two periods at least")
    bounded(docs.sparkSession)
    target = docs.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in docs.columns if c not in (text, runs_as, collapsed_as)])
    schema = StructType([*target.schema.fields, StructField(runs_as, RUNS), StructField(collapsed_as, StringType())])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for value in batch.column(0):
                words, ids = intern_words(value.as_buffer() if value.is_valid else b"")
                runs = find_runs(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32), least, periods)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                left.append(collapse(words, ids, runs))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, spans), pa.array(left, pa.binary()).cast(pa.string())], names=[*batch.schema.names, runs_as, collapsed_as])

    out = target.mapInArrow(run, schema)
    return out.select(*[c for c in docs.columns if c not in (runs_as, collapsed_as)], runs_as, collapsed_as)


def repeat_tail(text: Column, doc_id: Column) -> Column:
    """The text with, for a tenth of the documents, all words from one on replaced by repetitions of a stretch.

    With h = crc32(doc_id) and g = h div 10, where h is divisible by 10 each word i >= a becomes word
    a + (i - a) mod p, for a = g mod n and p = 1 + (n - a) div (3 + g mod 8).  Words are joined by spaces.
    A null doc_id changes nothing.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    words = F.array_remove(F.split(text, " "), "")
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    block = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op13_periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of the words of every whole text, a tenth of the texts with a repeated stretch."""
    texts = docs.select("doc_id", repeat_tail(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text"))
    found = periodic_runs(texts)
    exponent = lambda r: F.struct((r["length"] / r["period"]).alias("e"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r.alias("run"))
    best = F.array_max(F.transform("runs", exponent))["run"]
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
