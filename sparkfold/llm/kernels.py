"""Vectorised text kernels on Arrow batches, shared by the operators of this folder.

All kernels take whole texts.  A text beyond ``SEGMENT_BYTES`` is walked in segments that are cut where
neither a word nor a pre-token can go on: before a space between two letters, or where a letter or number
and a character that is neither of them nor white space nor an apostrophe meet.  So the result is that of
the uncut text.  A run without such a place (letters and numbers alone) is one word and stays whole; memory
is bounded by the segment and by the longest such run.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one kernel call works on.
BLOCK_BYTES = 1 << 20
#: Longer texts are walked in segments of about this size.
SEGMENT_BYTES = 1 << 20

_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


#: Powers that a worker keeps; longer tables are made anew for the block that needs them.
_KEPT_POWERS = 1 << 21


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


@cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_KEPT_POWERS, _MULT), _powers(_KEPT_POWERS, _INV)


def _power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _KEPT_POWERS:
        return _powers(n, _MULT), _powers(n, _INV)
    power, inverse = _kept_powers()
    return power[:n], inverse[:n]


@cache
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return table


@cache
def lower_table() -> np.ndarray:
    """Lower case of every code point that has a single one."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(0x1E944):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes that the search for a cut looks at in one step.
LOOK_BYTES = 1 << 16


def _cut_in(data: np.ndarray, low: int, high: int) -> int:
    """The first safe cut of a text within data[low:high], -1 if there is none."""
    heads = low + np.flatnonzero((data[low:high] & 0xC0) != 0x80)
    if len(heads) < 3:
        return -1
    points, _ = code_points(data[heads[0] : heads[-1]], np.zeros(1, np.int64))
    kind = class_table()[points]
    solid = kind <= NUMBER
    plain = (kind == OTHER) & (points != 39)
    turn = np.zeros(len(points), bool)
    turn[1:] = (solid[1:] & plain[:-1]) | (plain[1:] & solid[:-1])
    turn[1:-1] |= (points[1:-1] == 32) & (kind[:-2] == LETTER) & (kind[2:] == LETTER)
    at = np.flatnonzero(turn)
    return int(heads[at[0]]) if len(at) else -1


def _cuts(data: np.ndarray, start: int, end: int) -> list[int]:
    """Safe places to cut the text data[start:end] into segments."""
    out, at = [], start
    while end - at > SEGMENT_BYTES:
        place, look = -1, at + SEGMENT_BYTES
        while place < 0 and look < end:
            # the windows overlap by some characters, as a cut is judged by its neighbours
            place = _cut_in(data, max(at + 1, look - 16), min(end, look + LOOK_BYTES))
            look += LOOK_BYTES
        if place < 0:
            break
        out.append(place)
        at = place
    return out


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets of segments, row of each segment), about BLOCK_BYTES at a time."""
    data, offsets = text_buffers(column)
    rows = np.arange(len(offsets) - 1)
    long = np.flatnonzero(np.diff(offsets) > SEGMENT_BYTES)
    if len(long):
        extra = [(place, row) for row in long for place in _cuts(data, offsets[row], offsets[row + 1])]
        if extra:
            starts = np.concatenate([offsets[:-1], [p for p, _ in extra]])
            rows = np.concatenate([rows, [r for _, r in extra]])
            order = np.lexsort((starts, rows))
            rows, offsets = rows[order], np.append(starts[order], offsets[-1])
    at, n = 0, len(rows)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1
        to = min(n, max(at + 1, to))
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], rows[at:to]
        at = to


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets of the segments in them."""
    text = data.tobytes().decode("utf-8", "replace")
    if len(text) == len(data):
        return data.astype(np.uint32), offsets
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), heads[offsets]


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of points[start:end] for each span; it depends on these points alone."""
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _power_pair(len(points))
    total = np.zeros(len(points) + 1, U64)
    np.cumsum((points.astype(U64) + U64(1)) * power, out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64))


@cache
def lone_table() -> np.ndarray:
    """Letters of scripts that are written without spaces (Han, Kana, Thai, Lao, Khmer, Burmese, Yi and others)."""
    table = np.zeros(sys.maxunicode + 1, bool)
    # fixed values: blocks of Unicode
    for low, high in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF)):
        table[low : high + 1] = True
    return table & (class_table() <= NUMBER)


def words(data: np.ndarray, offsets: np.ndarray, lone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, and start, end and segment of each maximal run of letters and numbers.

    With ``lone`` each letter of a script without spaces is a word of its own.
    """
    points, at = code_points(data, offsets)
    points = lower_table()[points]
    inside = class_table()[points] <= NUMBER
    flag = np.zeros(len(points) + 1, bool)
    flag[1:-1] = inside[1:] != inside[:-1]
    if len(points):
        flag[0], flag[-1] = inside[0], inside[-1]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(points))]
    # two texts that touch without a separator: a word ends and another begins at the same place
    touch = np.unique(inner[inside[inner - 1] & inside[inner]]) if len(inner) else inner
    if lone and len(points) > 1:
        alone = lone_table()[points]
        more = 1 + np.flatnonzero((alone[1:] | alone[:-1]) & inside[1:] & inside[:-1])
        touch = np.union1d(touch, more) if len(more) else touch
    edge = np.flatnonzero(flag)
    starts, ends = edge[::2], edge[1::2]
    if len(touch):
        starts = np.sort(np.concatenate([starts, touch]))
        ends = np.sort(np.concatenate([ends, touch]))
    return points, starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of a batch, in order; letters of scripts without spaces are words of their own."""
    hashes, rows = [], []
    for data, offsets, row in blocks(column):
        points, starts, ends, segment = words(data, offsets, lone=True)
        hashes.append(span_hashes(points, starts, ends))
        rows.append(row[segment] if len(segment) else np.zeros(0, np.int64))
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def pretoken_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of a byte-level BPE, whose pattern is

    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``

    ``at`` holds the offsets of the segments, where a pre-token always starts.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = class_table()[points]
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < n]] = True
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new |= first
    # the last character of white space before a text run: a plain space joins that run, any other stands alone
    space = kind == SPACE
    body = np.flatnonzero(new & ~space)
    led = body[(body > 0)]
    led = led[space[led - 1] & ~first[led]]
    joined = led[points[led - 1] == 32]
    new[led - 1] = True
    new[joined] = False
    # contractions: an apostrophe that starts a token, with letters straight behind
    mark = np.flatnonzero((points == 39) & new)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
    if len(mark):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[mark + 1], padded[mark + 2]
        end_first = np.concatenate([first, np.ones(2, bool)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        double &= ~end_first[mark + 2]
        for hit, length in ((mark[short], 2), (mark[double & ~short], 3)):
            new[hit + 1] = False
            behind = hit + length
            behind = behind[behind < n]
            new[behind] |= kind[behind] == LETTER
    return np.flatnonzero(new)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(shift, lengths) + np.arange(total)


class HashIndex:
    """Maps 64-bit hashes to the values 0, 1, 2, ... in the order in which they were added."""

    def __init__(self) -> None:
        self.keys, self.values = np.zeros(0, U64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 if it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.values[place], -1)

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct new keys; their values follow those that exist."""
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        values = len(self.keys) + order
        self.keys = np.insert(self.keys, place, keys[order])
        self.values = np.insert(self.values, place, values)
