"""Similarity of names (X15, X16): insert/delete ratio and a weighted combination, as Arrow UDFs over distinct pairs.

The ratio is ``100 * 2 * LCS / (len a + len b)``, with the longest common subsequence from a bit-parallel
scan.  The weighted ratio takes the best of the plain ratio and of the ratios of sorted and of shared words
(weight 0.95); where one name is at least 1.5 times as long, parts of the longer one are compared with
weight 0.9, or 0.6 from eight times on.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; two empty names are equal."""
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter name to a part of the longer one of at most its length.

    A part that ends with a character that the shorter name lacks is no better than the one before it.  Of the others
    only those are compared whose characters, counted without their order, could still give a better ratio.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0 if long else 100.0
    n, best = len(short), 0.0
    room = Counter(short)  # what the part may still take; below zero: what it has too many of
    shared = 0
    for end in range(1, len(long) + n):
        if end > n:  # the part loses its first character
            c = long[end - n - 1]
            room[c] += 1
            shared -= room[c] > 0
        if end <= len(long):
            c = long[end - 1]
            shared += room[c] > 0
            room[c] -= 1
            if c not in short:
                continue
        part = long[max(0, end - n) : end]
        if 200.0 * shared / (n + len(part)) > best:
            best = max(best, ratio(short, part))
    return best


def token_ratio(a: str, b: str, compare=ratio) -> float:
    """Best ratio of the sorted words, and of what the names share with what each adds to it."""
    left, right = a.split(), b.split()
    best = compare(" ".join(sorted(left)), " ".join(sorted(right)))
    x, y = set(left), set(right)
    shared = " ".join(sorted(x & y))
    if shared and (x <= y or y <= x):
        return 100.0
    one = " ".join([shared, *sorted(x - y)]).strip()
    two = " ".join([shared, *sorted(y - x)]).strip()
    best = max(best, compare(one, two))
    return max(best, compare(shared, one), compare(shared, two)) if shared else best


def weighted_ratio(a: str | None, b: str | None) -> float:
    """0 to 100; 0 if either name is missing or empty."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if longer < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * token_ratio(a, b, partial_ratio))


#: Characters of a name that fit into one machine word, and pairs that are scanned together.
_WORD, _PAIRS = 64, 4096


def _characters(names: list[str], width: int) -> np.ndarray:
    """Code points, a row for each name, zeros behind its end."""
    flat = np.frombuffer("".join(n.ljust(width, "\0") for n in names).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(names), width)


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """``lcs`` of many pairs; those with a name of at most 64 characters are scanned side by side."""
    out = np.zeros(len(a), np.int64)
    short = np.array([0 < min(len(x), len(y)) <= _WORD and "\0" not in x and "\0" not in y for x, y in zip(a, b, strict=True)], bool)
    for i in np.flatnonzero(~short):
        out[i] = lcs(a[i], b[i])
    rows = np.flatnonzero(short)
    for k in range(0, len(rows), _PAIRS):
        at = rows[k : k + _PAIRS]
        pairs = [sorted((a[i], b[i]), key=len) for i in at]
        pattern = _characters([p for p, _ in pairs], _WORD)
        pattern = np.where(pattern == 0, np.uint32(0xFFFFFFFF), pattern)
        other = _characters([t for _, t in pairs], max(len(t) for _, t in pairs))
        row = np.full(len(at), ~np.uint64(0))
        for j in range(other.shape[1]):
            mask = np.packbits(pattern == other[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
            hit = row & mask
            row = (row + hit) | (row - hit)
        length = np.array([len(p) for p, _ in pairs], np.uint64)
        full = np.where(length == _WORD, ~np.uint64(0), (np.uint64(1) << (length % np.uint64(_WORD))) - np.uint64(1))
        out[at] = np.bitwise_count(~row & full)
    return out


@F.pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    x, y = a[known].tolist(), b[known].tolist()
    total = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.float64)
    out = np.full(len(a), np.nan)
    out[known] = np.where(total > 0, 200.0 * lcs_many(x, y) / np.maximum(total, 1), 100.0)
    return pd.Series(out)  # no number where a name is missing: null


@F.pandas_udf(DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def with_similarity(pairs: DataFrame, a: str, b: str, out: str, udf=weighted_ratio_udf) -> DataFrame:
    """Adds the similarity of two columns (0 to 1), computed once for each distinct pair of names."""
    distinct = pairs.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    scored = distinct.withColumn(out, udf("__a", "__b") / 100)
    joined = pairs.join(scored, pairs[a].eqNullSafe(scored["__a"]) & pairs[b].eqNullSafe(scored["__b"]), "left")
    return joined.drop("__a", "__b")
