"""Matroska: EBML elements, clusters, lacing and cues parsed into packet tables, and a writer for audio samples.

``packets`` walks the element tree of a file in memory: variable-length element ids and sizes (unknown
sizes included), tracks, clusters, SimpleBlocks and BlockGroups with Xiph, EBML, fixed or no lacing, and
cues.  A packet is one frame: track, timestamp in nanoseconds, byte range in the file, key frame flag and
kind of lacing.  ``mux_samples`` stores 8-bit samples as PCM frames of 192 bytes in laced blocks.

Defined results: a null or empty file has no packet and no error; a broken or truncated file gives the
packets before the fault and a row that names it; an unknown element is skipped; null texts are stored as
empty ones; equal bytes give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import bounded

# Element ids of the format (fixed values).
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements of the segment's own level, which end a cluster of unknown size.
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME, RATE, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 192, 8000, 8, 16
FRAME_MS = FRAME * 1000 // RATE


class Packet(NamedTuple):
    track: int
    timestamp: int  # nanoseconds
    offset: int
    size: int
    keyframe: bool
    lacing: str


class Media(NamedTuple):
    packets: list[Packet]
    codecs: dict[int, str]
    clusters: int
    blocks: int
    cues: list[tuple[int, int, int]]  # timestamp (ns), track, byte offset of the cluster
    error: str | None


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    """Element id (with its length marker) and the place behind it."""
    length = 9 - data[at].bit_length() if at < end and data[at] else 9
    if length > 4 or at + length > end:
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(data[at : at + length]), at + length


def read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """Variable-length number (None: all ones, unknown) and the place behind it."""
    length = 9 - data[at].bit_length() if at < end and data[at] else 9
    if length > 8 or at + length > end:
        raise ValueError(f"no element size at byte {at}")
    value = int.from_bytes(data[at : at + length]) & ((1 << 7 * length) - 1)
    return (None if value == (1 << 7 * length) - 1 else value), at + length


def elements(data: bytes, at: int, end: int, stop: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start, end, whether the size is known) of the children in data[at:end]; ends before an id in ``stop``.

    The consumer of an element of unknown size sends the place where it ended.
    """
    while at < end:
        kind, body = read_id(data, at, end)
        if kind in stop:
            return
        size, body = read_size(data, body, end)
        if size is not None and body + size > end:
            raise ValueError(f"element {kind:X} at byte {at} is longer than what holds it")
        ended = yield kind, body, end if size is None else body + size, size is not None
        if ended is not None:
            yield 0, 0, 0, True
        at = ended if ended is not None else end if size is None else body + size


def unsigned(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end])


def laced_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a laced block whose lace head starts at ``at``, and where the first frame starts."""
    if at >= end:
        raise ValueError(f"a laced block ends at byte {end} before its number of frames")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"a lace head runs beyond byte {end}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif lacing == 3 and count > 1:
        size, at = read_size(data, at, end)
        sizes.append(size or 0)
        for _ in range(count - 2):
            before = at
            value, at = read_size(data, at, end)
            width = at - before
            raw = (1 << 7 * width) - 1 if value is None else value
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
    elif lacing == 2:
        if (end - at) % count:
            raise ValueError(f"fixed lacing does not divide the block that ends at byte {end}")
        return [(end - at) // count] * count, at
    last = end - at - sum(sizes)
    if last < 0 or any(s < 0 for s in sizes):
        raise ValueError(f"the frames of a block exceed it at byte {end}")
    return [*sizes, last], at


#: Timestamps in nanoseconds stay below this.
LIMIT = 1 << 63


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.scale, self.durations, self.codecs = data, 1_000_000, {}, {}
        self.packets, self.cues, self.clusters, self.blocks, self.base = [], [], 0, 0, 0

    def block(self, start: int, end: int, time: int, key: bool | None) -> None:
        track, at = read_size(self.data, start, end)
        if at + 3 > end:
            raise ValueError(f"a block ends at byte {end} within its head")
        relative, flags = struct.unpack(">hB", self.data[at : at + 3])
        lacing = flags >> 1 & 3
        sizes, at = laced_sizes(self.data, at + 3, end, lacing) if lacing else ([end - at - 3], at + 3)
        stamp, step = (time + relative) * self.scale, self.durations.get(track, 0)
        if not -LIMIT <= stamp <= stamp + (len(sizes) - 1) * step < LIMIT:
            raise ValueError(f"a block that ends at byte {end} has a timestamp beyond 64 bits")
        keyframe = bool(flags & 0x80) if key is None else key
        for i, size in enumerate(sizes):
            self.packets.append(Packet(track or 0, stamp + i * step, at, size, keyframe, LACINGS[lacing]))
            at += size
        self.blocks += 1

    def track(self, start: int, end: int) -> None:
        number, codec, step = 0, "", 0
        for kind, a, b, _ in elements(self.data, start, end):
            if kind == TRACK_NUMBER:
                number = unsigned(self.data, a, b)
            elif kind == CODEC_ID:
                codec = self.data[a:b].rstrip(b"\0").decode("ascii", "replace")
            elif kind == DEFAULT_DURATION:
                step = unsigned(self.data, a, b)
        self.codecs[number], self.durations[number] = codec, step

    def cluster(self, start: int, end: int, known: bool) -> int:
        """Reads a cluster and returns where it ended."""
        time, at = 0, start
        self.clusters += 1
        for kind, a, b, _ in elements(self.data, start, end, frozenset() if known else TOP_LEVEL):
            at = b
            if kind == TIMESTAMP:
                time = unsigned(self.data, a, b)
            elif kind == SIMPLE_BLOCK:
                self.block(a, b, time, None)
            elif kind == BLOCK_GROUP:
                parts = list(elements(self.data, a, b))
                key = all(x[0] != REFERENCE_BLOCK for x in parts)
                for inner, c, d, _ in parts:
                    if inner == BLOCK:
                        self.block(c, d, time, key)
        return at

    def cue(self, start: int, end: int) -> None:
        time = 0
        for kind, a, b, _ in elements(self.data, start, end):
            if kind == CUE_TIME:
                time = unsigned(self.data, a, b)
            elif kind == CUE_TRACK_POSITIONS:
                found = {inner: unsigned(self.data, c, d) for inner, c, d, _ in elements(self.data, a, b)}
                self.cues.append((time * self.scale, found.get(CUE_TRACK, 0), self.base + found.get(CUE_CLUSTER_POSITION, 0)))

    def segment(self, start: int, end: int) -> None:
        self.base = start
        walk = elements(self.data, start, end)
        for kind, a, b, known in walk:
            if kind == INFO:
                for inner, c, d, _ in elements(self.data, a, b):
                    if inner == TIMESTAMP_SCALE:
                        self.scale = unsigned(self.data, c, d)
            elif kind == TRACKS:
                for inner, c, d, _ in elements(self.data, a, b):
                    if inner == TRACK_ENTRY:
                        self.track(c, d)
            elif kind == CLUSTER:
                ended = self.cluster(a, b, known)
                if not known:
                    walk.send(ended)
            elif kind == CUES:
                for inner, c, d, _ in elements(self.data, a, b):
                    if inner == CUE_POINT:
                        self.cue(c, d)


def parse(data: bytes | None) -> Media:
    """Packets, tracks and cues of a Matroska file; ``error`` names the first fault."""
    reader, error = _Reader(data or b""), None
    try:
        seen = False
        for kind, a, b, _ in elements(reader.data, 0, len(reader.data)):
            if not seen and kind != EBML:
                raise ValueError("the file does not start with an EBML head")
            seen = True
            if kind == SEGMENT:
                reader.segment(a, b)
    except ValueError as fault:
        error = str(fault)
    return Media(reader.packets, reader.codecs, reader.clusters, reader.blocks, reader.cues, error)


def number(value: int) -> bytes:
    """A size as the shortest variable-length number."""
    length = 1
    while value >= (1 << 7 * length) - 1:
        length += 1
    return (value | 1 << 7 * length).to_bytes(length)


def element(kind: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8))
    elif isinstance(body, str):
        body = body.encode()
    return kind.to_bytes((kind.bit_length() + 7) // 8) + number(len(body)) + body


def lace_head(frames: list[bytes], lacing: int) -> bytes:
    """Number of frames and their sizes, as the kind of lacing writes them."""
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == 1:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if lacing == 3 and len(sizes) > 1:
        head += number(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = 1
            while not -((1 << 7 * width - 1) - 1) < b - a < (1 << 7 * width - 1):
                width += 1
            head += ((b - a + (1 << 7 * width - 1) - 1) | 1 << 7 * width).to_bytes(width)
    return head


def block(track: int, relative: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    flags = (0x80 if key else 0) | lacing << 1
    return number(track) + struct.pack(">hB", relative, flags) + (lace_head(frames, lacing) if lacing else b"") + b"".join(frames)


_HEAD = element(EBML, element(EBML_VERSION, 1) + element(EBML_READ_VERSION, 1) + element(MAX_ID, 4) + element(MAX_SIZE, 8) + element(DOC_TYPE, "matroska") + element(DOC_VERSION, 4) + element(DOC_READ_VERSION, 2))
_TRACKS = element(
    TRACKS,
    element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC_ID, "A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))),
)


def mux_samples(payload: bytes, lacing: int = 2) -> bytes:
    """A file with one mono track of 8-bit samples; the payload is a multiple of FRAME bytes."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)) + element(MUXING_APP, "sparkfold") + element(WRITING_APP, "sparkfold"))
    body, cues, per = [info, _TRACKS], [], FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    at = len(info) + len(_TRACKS)
    for i in range(0, len(frames), per):
        blocks = [element(TIMESTAMP, i * FRAME_MS)]
        for j in range(i, min(i + per, len(frames)), FRAMES_PER_BLOCK):
            blocks.append(element(SIMPLE_BLOCK, block(1, (j - i) * FRAME_MS, frames[j : min(j + FRAMES_PER_BLOCK, i + per)], lacing)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, i * FRAME_MS) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of a text in bytes, and the text filled up with spaces to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def feature(media: Media, samples: bytes) -> str:
    """Shape and signal of a track, as text."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    crossings = int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())
    span = media.packets[-1].timestamp // 1_000_000 + FRAME_MS if media.packets else 0
    return f"packets={len(media.packets)};blocks={media.blocks};clusters={media.clusters};cues={len(media.cues)};ms={span};mean={x.mean():.4f};std={x.std():.4f};peak={x.max()};crossings={crossings}"


def packet_table(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """One row per packet of each file: key, packet, track, codec, timestamp_ns, offset, size, keyframe, lacing; a fault gives a row with ``error`` and no packet."""
    bounded(files.sparkSession)
    target = files.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{content}`").alias("content"))
    kinds = [("key", pa.string()), ("packet", pa.int64()), ("track", pa.int64()), ("codec", pa.string()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.string()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                media = parse(data.as_py())
                rows = [(name, i, p.track, media.codecs.get(p.track), p.timestamp, p.offset, p.size, p.keyframe, p.lacing, None) for i, p in enumerate(media.packets)]
                if media.error:
                    rows.append((name, *[None] * 8, media.error))
                for i in range(0, len(rows), 10_000):
                    part = list(zip(*rows[i : i + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(part, kinds, strict=True)], names=[n for n, _ in kinds])

    return target.mapInArrow(run, "key string, packet long, track long, codec string, timestamp_ns long, offset long, size long, keyframe boolean, lacing string, error string")


def as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (binary): every whole text stored as samples of a Matroska file."""
    bounded(docs.sparkSession)
    target = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1):
                n, payload = padded(text.as_py())
                sizes.append(n)
                media.append(mux_samples(payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return target.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe(files: DataFrame) -> DataFrame:
    """Digests and features of stored files (doc_id, n_bytes, media), from the bytes that their packets hold."""
    bounded(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                data = value.as_py()
                media = parse(data)
                if media.error:
                    raise ValueError(media.error)
                payload = b"".join(data[p.offset : p.offset + p.size] for p in media.packets)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, payload)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op3_media(docs: DataFrame) -> DataFrame:
    """Every whole text stored as a Matroska file, read back from its packets and described."""
    return describe(as_media(docs))
