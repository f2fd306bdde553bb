"""Containers built from the part table, for queries that read and write files.

Part n is the file ``g<n % 4>/p<n>.<suffix>`` below a folder of the session: by n % 20 a tar (1), a damaged zip (3), a RAR
head (5), a small PDF (7), else a zip with a ComicInfo document, p_size % 4 + 1 pages and, for even n, a comment.
"""

from __future__ import annotations

import io
import os
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.shared import shared_folder

#: SQL of what the containers hold, for oracles: key, kind (CBZ, CBT, BAD, CBR, PDF) and number of pages of each part.
BOX = """box AS (SELECT *, p_size % 4 + 1 AS n, CASE p_partkey % 20 WHEN 1 THEN 'CBT' WHEN 3 THEN 'BAD' WHEN 5 THEN 'CBR' WHEN 7 THEN 'PDF' ELSE 'CBZ' END AS kind,
'g' || p_partkey % 4 || '/p' || p_partkey || CASE p_partkey % 20 WHEN 1 THEN '.cbt' WHEN 5 THEN '.cbr' WHEN 7 THEN '.pdf' ELSE '.cbz' END AS file FROM part)"""
#: Formats that the containers hold; fewer readers make smaller plans.
FORMATS = Settings(read=("comic_info", "comic_book_info", "mupdf", "filename", "native_line"))
#: Edge of the square grey pictures and, in SQL, the value of the pixel (x, y) of part p.
EDGE, PIXEL = 32, "(x * x * 3 + y * y * 5 + x * y * (p % 11) + x * (p % 17) + y * (p % 23) + p) % 256"
_BUILT: dict[tuple, str] = {}


def _container(n: int, name: str, brand: str, size: int) -> tuple[str, bytes]:
    kind, out = n % 20, io.BytesIO()
    if kind == 3:
        return "cbz", b"PK\x03\x04damaged"
    if kind == 5:
        return "cbr", b"Rar!\x1a\x07\x00"
    if kind == 7:
        pages = b"".join(b"%d 0 obj << /Type /Page >> endobj\n" % (i + 4) for i in range(size % 4 + 1))
        return "pdf", b"%PDF-1.4\n1 0 obj << /Type /Pages /Count " + str(size % 4 + 1).encode() + b" >> endobj\n2 0 obj << /Title (" + name.encode() + rb") /Author (A \(B\)) >> endobj" + b"\n" + pages + b"trailer << /Info 2 0 R >>"
    xml = f"<ComicInfo><Title>Part {n}</Title><Series>{name}</Series><Number>{size}</Number><Publisher>{brand}</Publisher><Year>{1950 + size}</Year><Pages><Page Image=\"{size % 4}\" Type=\"FrontCover\"/><Page Image=\"99\"/></Pages></ComicInfo>"
    members = [(f"pages/P{i}.jpg", f"{n}-{i}".encode()) for i in range(1, size % 4 + 2)] + [("ComicInfo.xml", xml.encode())]
    if kind == 1:
        with tarfile.open(fileobj=out, mode="w") as tar:
            for member, body in members:
                info = tarfile.TarInfo(member)
                info.size, info.mtime = len(body), 1_700_000_000
                tar.addfile(info, io.BytesIO(body))
        return "cbt", out.getvalue()
    with zipfile.ZipFile(out, "w") as target:
        for member, body in members:
            target.writestr(zipfile.ZipInfo(member, (2023, 1, 1, 0, 0, 0)), body)
        if n % 2 == 0:
            target.comment = b'{"ComicBookInfo/1.0":{"genre":"Drama","publisher":"Other"}}'
    return "cbz", out.getvalue()


def _picture(p: int) -> bytes:
    """A grey PNG of the pixels that PIXEL states."""
    y, x = np.mgrid[0:EDGE, 0:EDGE]
    pixels = (x * x * 3 + y * y * 5 + x * y * (p % 11) + x * (p % 17) + y * (p % 23) + p) % 256
    lines = np.pad(pixels.astype(np.uint8), ((0, 0), (1, 0))).tobytes()
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", EDGE, EDGE, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in chunks)


def pictures(t) -> str:
    """The folder of the pictures ``g<n % 4>/p<n>.png``, built once in a session."""
    return _built(t, "pictures", lambda n, name, brand, size: ("png", _picture(n)))


def containers(t) -> str:
    """The folder of the containers, built once in a session."""
    return _built(t, "containers", _container)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows that are much work each: a table of few files would be the work of few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _built(t, what: str, make: Callable[[int, str, str, int], tuple[str, bytes]]) -> str:
    part = t("part")
    spark = part.sparkSession
    key = id(spark.sparkContext), part.inputFiles()[0], what
    if key in _BUILT:
        return _BUILT[key]
    folder = shared_folder(spark)
    root = folder.removeprefix("file://").removeprefix("file:")

    def build(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            for k in range(4):
                os.makedirs(f"{root}/g{k}", exist_ok=True)
            for r in rows:
                suffix, body = make(r["p_partkey"], r["p_name"], r["p_brand"], r["p_size"])
                with open(f"{root}/g{r['p_partkey'] % 4}/p{r['p_partkey']}.{suffix}", "wb") as file:
                    file.write(body)
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], names=["n"])

    _dealt(part.select("p_partkey", "p_name", "p_brand", "p_size")).mapInArrow(build, "n long").agg(F.sum("n")).collect()
    _BUILT[key] = f"file://{root}"
    return _BUILT[key]


def file_of(path: str = "path"):
    """The file below the folder of the containers."""
    return F.regexp_extract(path, r"(g\d/p\d+[^/]*)$", 1)


def key_of(path: str = "path"):
    """The part of a file."""
    return F.regexp_extract(path, r"/p(\d+)[./]", 1).cast("bigint")


def no_rows(frame: DataFrame) -> DataFrame:
    return frame.limit(0)
