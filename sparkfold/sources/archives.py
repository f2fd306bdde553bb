"""Archives as DataFrames: one row per container, its members in an array.

``listing`` reads each file once, in one pass that lists all members and takes out the bytes of those that
are asked for: by default the metadata members only, so page images are never decompressed.  Documents,
pages and comments are array expressions over that row; nothing is read again or shuffled.

The files below a folder that all workers mount are listed, dealt out and opened by the workers: only names
are shuffled, and the driver holds none of them.  Other stores are read by Spark's binaryFile source.

A container that cannot be read gives a row with ``error``; a member that cannot be read has an error of its
own.  RAR and 7Z containers need libraries that Spark does not bring and give an error row.  Of a PDF the
document information and the number of pages are read where they are not in compressed object streams.
"""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType

from ..functions import numbers as N
from ..operators.evaluate import is_page

MEMBER = "struct<name:string,size:bigint,modified:timestamp,is_dir:boolean,content:binary,error:string>"
LISTING = f"path string, modified timestamp, file_type string, comment string, header string, error string, members array<{MEMBER}>"
MEMBERS = "path string, file_type string, comment string, name string, size bigint, modified timestamp, is_dir boolean, content binary, error string"
#: Names of metadata members by format (fixed values).
METADATA_NAMES = {
    "comicinfo.xml": "comic_info", "metroninfo.xml": "metron_info", "comet.xml": "comet", "comic-book-info.json": "comic_book_info", "mupdf.json": "mupdf",
    "record.json": "native_json", "record.yaml": "native_yaml",
}
#: Member that a format is written to.
FILE_NAMES = {"comic_info": "ComicInfo.xml", "metron_info": "MetronInfo.xml", "comet": "CoMet.xml", "comic_book_info": "comic-book-info.json", "mupdf": "MuPDF.json", "native_json": "record.json", "native_yaml": "record.yaml"}
IMAGES = (".jpg", ".jpeg", ".jxl", ".webp", ".png", ".gif", ".bmp", ".tif", ".tiff", ".avif", ".svg")
SUFFIXES = ("cbz", "cbt", "cbr", "cb7", "zip", "tar", "rar", "7z", "pdf")
#: Which members' bytes are taken out.
Wanted = Callable[[str], bool]


def no_content(name: str) -> bool:
    return False


def all_content(name: str) -> bool:
    return True


def metadata_content(name: str) -> bool:
    """Whether a member is a metadata document, by its lower-case base name."""
    return os.path.basename(name).lower() in METADATA_NAMES


def file_type(name: str, head: bytes) -> str | None:
    """Type of a container, by extension if the first bytes agree, else by first bytes."""
    found = [kind for kind, at, digits in N.CONTAINERS if head[at - 1 :].startswith(bytes.fromhex(digits))]
    hint = N.EXTENSIONS.get(os.path.splitext(name)[1].lstrip(".").lower())
    return hint if hint in found else (found[0] if found else None)


def _taken(read: Callable[[], bytes], wanted: bool) -> tuple[bytes | None, str | None]:
    if not wanted:
        return None, None
    try:
        return read(), None
    except Exception as fault:  # encrypted, damaged or of an unknown method: the error of this member alone
        return None, f"{type(fault).__name__}: {fault}"


def _zip_time(parts: tuple[int, ...]) -> datetime | None:
    try:
        return datetime(*parts)
    except ValueError:  # a month or day 0
        return None


def _zip(data: bytes, wanted: Wanted) -> tuple[str | None, list[tuple]]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        rows = []
        for m in archive.infolist():
            body, error = _taken(lambda m=m: archive.read(m), not m.is_dir() and wanted(m.filename))
            rows.append((m.filename, m.file_size, _zip_time(m.date_time), m.is_dir(), body, error))
        return archive.comment.decode("utf-8", "replace") or None, rows


def _tar(data: bytes, wanted: Wanted) -> tuple[None, list[tuple]]:
    with tarfile.open(fileobj=io.BytesIO(data)) as archive:
        rows = []
        for m in archive.getmembers():
            body, error = _taken(lambda m=m: archive.extractfile(m).read(), m.isfile() and wanted(m.name))
            rows.append((m.name, m.size, datetime.fromtimestamp(m.mtime, timezone.utc).replace(tzinfo=None), m.isdir(), body, error))
        return None, rows


def _pdf_text(raw: bytes) -> str:
    """A PDF string without its brackets, as text."""
    if raw.startswith(b"<"):
        digits = re.sub(rb"\s", b"", raw[1:-1])
        value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii", "replace"))
    else:
        names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        value = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else names.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    return value[2:].decode("utf-16-be", "replace") if value.startswith(b"\xfe\xff") else value.decode("latin-1")


def pdf_facts(data: bytes) -> tuple[str | None, int]:
    """The document information of a PDF as a MuPDF document, and its number of pages."""
    info = {}
    if at := re.search(rb"/Info\s+(\d+)\s+(\d+)\s+R", data):
        body = re.search(rb"(?<!\d)%s\s+%s\s+obj\b(.*?)endobj" % (at[1], at[2]), data, re.DOTALL)
        for tag, key in ((b"Author", "author"), (b"Creator", "creator"), (b"Keywords", "keywords"), (b"ModDate", "modDate"), (b"Producer", "producer"), (b"Subject", "subject"), (b"Title", "title")):
            if body and (found := re.search(rb"/%s\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)" % tag, body[1], re.DOTALL)):
                info[key] = _pdf_text(found[1])
    counts = [int(n) for n in re.findall(rb"/Count\s+(\d+)", data)]
    return json.dumps({"MuPDF": info}) if info else None, max(counts, default=0)


def read_container(path: str, data: bytes, wanted: Wanted) -> tuple:
    """file_type, comment, header, error and members (sorted without regard to case) of one container."""
    kind = None
    try:
        kind = file_type(path, data[:600])
        comment, header = None, None
        if kind == "CBZ":
            comment, rows = _zip(data, wanted)
        elif kind == "CBT":
            comment, rows = _tar(data, wanted)
        elif kind == "PDF":
            header, n = pdf_facts(data)
            return kind, None, header, None, [(str(i), None, None, False, None, None) for i in range(n)]
        else:
            return kind, None, None, f"cannot read {kind or 'unknown'} containers", []
        return kind, comment, header, None, sorted(rows, key=lambda r: (r[0].lower(), r[0]))
    except Exception as fault:  # S22: one bad file is a row, never the end of the job
        return kind, None, None, f"{type(fault).__name__}: {fault}", []


#: Folders that are listed by tasks of their own, and bytes of a batch that a worker sends.
FOLDERS, BATCH_BYTES, BATCH_ROWS = 64, 16 << 20, 1000


def local_path(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def read_file(path: str) -> bytes:
    """The bytes of a file of a mounted folder."""
    with open(local_path(path), "rb") as file:
        return file.read()


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that workers can open themselves, None of other stores, patterns and single files."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", folder)
    if scheme and scheme[1] != "file" or re.search(r"[*?\[\]{}\\]", folder):
        return None
    if not scheme and not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
        return None
    path = re.sub("/+", "/", os.path.abspath(folder) if not scheme else "/" + local_path(folder).lstrip("/"))
    return path if os.path.isdir(path) else None


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return (name.startswith(("_", ".")) and not (name.startswith("_") and "=" in name) and not name.startswith(("_metadata", "_common_metadata"))) or name.endswith("._COPYING_")


def _folders(root: str) -> list[tuple[str, bool, int, int]]:
    """Parts that together hold all files below ``root``, of bounded number: a folder, whether the folders in it belong to it, which share of its entries, of how many."""
    alone, whole, shared = [], [root], []
    while whole and len(alone) + len(whole) < FOLDERS:
        with os.scandir(at := whole.pop(0)) as entries:
            below = list(islice((e.path for e in entries if not _hidden(e.name) and e.is_dir()), FOLDERS + 1))
        if len(below) > FOLDERS:
            shared += [(at, True, k, FOLDERS) for k in range(FOLDERS)]
        else:
            alone.append((at, False, 0, 1))
            whole += sorted(below)
    return alone + shared + [(p, True, 0, 1) for p in whole]


def _names(root: str, deep: bool, share: int = 0, of: int = 1) -> Iterator[str]:
    """The paths of the files below a folder; ``share`` counts for its own entries."""
    waiting = [root]
    while waiting:
        with os.scandir(at := waiting.pop()) as entries:
            for e in entries:
                if _hidden(e.name) or (of > 1 and at == root and zlib.crc32(os.fsencode(e.name)) % of != share):
                    continue
                if e.is_dir():
                    if deep:
                        waiting.append(e.path)
                else:
                    yield e.path


class _Folder(InputPartition):
    def __init__(self, *part) -> None:
        self.part = part


class _FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.suffixes = options["path"], tuple(options["suffixes"].split())

    def partitions(self) -> list[InputPartition]:
        return [_Folder(*part) for part in _folders(self.root)]

    def read(self, partition: _Folder) -> Iterator:
        import pyarrow as pa

        names = (n for n in _names(*partition.part) if not self.suffixes or n.rpartition(".")[2].lower() in self.suffixes)
        while some := list(islice(names, 10_000)):
            # a name that is no UTF-8 cannot be opened by its text, and gives an error row
            yield pa.RecordBatch.from_arrays([pa.array(["file:" + n.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for n in some], pa.string())], names=["path"])


class FolderSource(DataSource):
    """The paths of the files below a folder that all workers mount, listed by tasks."""

    @classmethod
    def name(cls) -> str:
        return "mounted_folder"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options)


def mounted_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The path of each file below a mounted folder, by suffix; the names are dealt out, as a task can list many more files than it should open."""
    spark.dataSource.register(FolderSource)
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.read.format("mounted_folder").option("suffixes", " ".join(suffixes)).load(mounted(spark, folder)).repartition(tasks)


@F.pandas_udf(LongType())
def size_of(path: pd.Series) -> pd.Series:
    """Bytes of the files of a mounted folder."""
    return pd.Series([os.path.getsize(local_path(p)) for p in path], dtype="int64")


def container_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Path of all containers below a folder, by suffix, none of which is opened."""
    return mounted_files(spark, folder, SUFFIXES) if mounted(spark, folder) else container_files(spark, folder).select("path")


def container_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Path, modificationTime and content of all containers below a folder, by suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES))


def with_content(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """``rows`` (path, ...) of the containers below ``folder`` for a sink, with their content unless workers open the files themselves."""
    return rows.join(container_paths(spark, folder), "path", "left_semi") if mounted(spark, folder) else container_files(spark, folder).select("path", "content").join(rows, "path")


def listing(spark: SparkSession, folder: str, recursive: bool = True, wanted: Wanted = metadata_content) -> DataFrame:
    """One row (LISTING) per container below a folder on any file system that Spark reads.

    Spark lists and splits the files; a worker opens one container at a time.
    """

    def batch_of(rows: list[tuple]):
        import pyarrow as pa

        member = pa.struct([("name", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("is_dir", pa.bool_()), ("content", pa.binary()), ("error", pa.string())])
        kinds = [pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.string()]
        *columns, members = zip(*rows, strict=True)
        flat = [m for ms in members for m in ms]
        parts = [pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True) if flat else [()] * 6, member, strict=True)]
        offsets = pa.array([0, *accumulate(len(ms) for ms in members)], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(member)))
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), lists], names=["path", "modified", "file_type", "comment", "header", "error", "members"])

    def each(batches):
        for batch in batches:
            for path, modified, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                yield path, modified.value, *read_container(path, data.as_py(), wanted)

    def opened(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    modified, data = os.stat(local_path(path)).st_mtime_ns // 1_000_000 * 1000, read_file(path)
                except OSError as fault:  # a file that cannot be opened is a row as well
                    yield path, None, None, None, None, f"{type(fault).__name__}: {fault}", []
                    continue
                yield path, modified, *read_container(path, data, wanted)

    def run(batches, rows_of):
        rows, size = [], 0
        for row in rows_of(batches):
            rows.append(row)
            size += sum(len(m[4] or b"") for m in row[6])
            if size > BATCH_BYTES or len(rows) == BATCH_ROWS:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    if recursive and mounted(spark, folder):
        return container_paths(spark, folder).mapInArrow(lambda batches: run(batches, opened), LISTING)
    files = container_files(spark, folder, recursive).select("path", F.col("modificationTime").alias("modified"), "content")
    return files.mapInArrow(lambda batches: run(batches, each), LISTING)


def members(spark: SparkSession, folder: str, recursive: bool = True, content: bool = True) -> DataFrame:
    """One row (MEMBERS) per member, or with the error of a container that cannot be read."""
    rows = listing(spark, folder, recursive, all_content if content else no_content)
    each = rows.select("path", "file_type", "comment", "error", F.explode_outer("members").alias("m"))
    return each.select("path", "file_type", "comment", "m.name", "m.size", "m.modified", "m.is_dir", "m.content", F.coalesce("error", "m.error").alias("error"))


class _OnePath(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.content = options["path"], options.get("content", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found = [os.path.join(d, f) for d, _, names in os.walk(self.folder) for f in sorted(names) if f.rpartition(".")[2].lower() in SUFFIXES]
        return [_OnePath(p) for p in sorted(found)] or [_OnePath("")]

    def read(self, partition: _OnePath) -> Iterator[tuple]:
        if partition.path:
            with open(partition.path, "rb") as file:
                kind, comment, _, error, rows = read_container(partition.path, file.read(), all_content if self.content else no_content)
            if error:
                yield partition.path, kind, comment, None, None, None, None, None, error
            for name, size, modified, is_dir, body, fault in rows:
                yield partition.path, kind, comment, name, size, modified, is_dir, body, fault


class ArchiveSource(DataSource):
    """``spark.dataSource.register(ArchiveSource)``, then ``spark.read.format("archives").load(folder)``, for folders that all workers mount."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


# documents and pages: expressions over a listing ------------------------------


def shallowest(members_: Column, base_name: str) -> Column:
    """Content of the member with this lower-case base name that has the fewest separators, ties to the first in order."""
    fits = F.filter(members_, lambda m: ~m["is_dir"] & (F.lower(F.element_at(F.split(m["name"], "/"), -1)) == base_name))
    ranked = F.transform(fits, lambda m: F.struct((F.length(m["name"]) - F.length(F.replace(m["name"], F.lit("/"), F.lit("")))).alias("depth"), F.lower(m["name"]).alias("folded"), m["name"].alias("name"), m["content"].alias("content")))
    return F.array_min(ranked)["content"]


def page_members(members_: Column, pdf: Column | None = None) -> Column:
    """The pages of a container in order: images that are no dot files and no resource forks; of a PDF, numbers."""
    pages = F.filter(members_, lambda m: ~m["is_dir"] & is_page(m["name"]))
    return pages if pdf is None else F.when(pdf, F.filter(members_, lambda m: m["name"].rlike("^[0-9]+$"))).otherwise(pages)


def _document(source: str, fmt: Column | str, payload: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), (F.lit(fmt) if isinstance(fmt, str) else fmt).alias("fmt"), F.lit(0).alias("ordinal"), payload.alias("payload"))


def documents_of(page_lists: bool = False, extra: tuple[tuple[str, str, str], ...] = ()) -> Column:
    """Array of the raw documents of a listing's row: members, comment, header, file name and ``extra`` ones (source, fmt, text) for all."""
    found = [_document("archive_file", fmt, F.decode(shallowest(F.col("members"), name), "UTF-8")) for name, fmt in METADATA_NAMES.items()]
    found.append(_document("archive_comment", "comic_book_info", F.col("comment")))
    found.append(_document("archive_pdf", "mupdf", F.col("header")))
    found.append(_document("archive_filename", "filename", F.element_at(F.split("path", "/"), -1)))
    found += [_document(source, fmt, F.lit(text)) for source, fmt, text in extra]
    if page_lists:
        pages = page_members(F.col("members"), F.col("file_type") == "PDF")
        sizes = F.to_json(F.struct(F.transform(pages, lambda m: F.coalesce(m["size"], F.lit(-1).cast("bigint"))).alias("sizes")))
        found.append(_document("archive_pages", "page_list", F.when(F.col("error").isNull(), sizes)))
    return F.filter(F.array(*found), lambda d: d["payload"].isNotNull())


def metadata_documents(rows: DataFrame, page_lists: bool = False, extra: tuple[tuple[str, str, str], ...] = ()) -> DataFrame:
    """Raw documents (path, source, fmt, ordinal, payload) of a listing.  ``page_lists`` adds one that counts the pages."""
    return rows.select("path", F.explode(documents_of(page_lists, extra)).alias("d")).select("path", "d.source", "d.fmt", "d.ordinal", "d.payload")


def latest_time() -> Column:
    """Time of a listing's row: of its latest metadata member; with a comment or header, or without such a member, that of the file."""
    times = F.transform(F.filter("members", lambda m: F.lower(F.element_at(F.split(m["name"], "/"), -1)).isin(*METADATA_NAMES)), lambda m: m["modified"])
    return F.when(F.col("comment").isNotNull() | F.col("header").isNotNull(), F.col("modified")).otherwise(F.coalesce(F.array_max(times), F.col("modified")))


def gated_documents(rows: DataFrame, old: DataFrame, page_lists: bool = False) -> DataFrame:
    """Raw documents with modified, fresh and failed of their container, which is listed once.

    ``old`` has path and old.  Of a container that is not newer, or cannot be read, there is one empty document.
    """
    gate = rows.join(old, "path", "left").withColumn("latest", latest_time()).withColumn("fresh", F.col("latest") > F.coalesce("old", F.lit("1970-01-01").cast("timestamp")))
    none = F.array(_document("archive_pages", "page_list", F.lit(None).cast("string")))
    documents = F.when(F.col("fresh") & F.col("error").isNull(), documents_of(page_lists)).otherwise(none)
    each = gate.select("path", F.col("latest").alias("modified"), "fresh", F.col("error").alias("failed"), F.explode(documents).alias("d"))
    return each.select("path", "modified", "fresh", "failed", "d.source", "d.fmt", "d.ordinal", "d.payload")


def pages(rows: DataFrame) -> DataFrame:
    """Path, page (zero-based number), name, size and content of the pages of a listing."""
    each = rows.select("path", F.posexplode(page_members(F.col("members"), F.col("file_type") == "PDF")).alias("page", "m"))
    return each.select("path", "page", "m.name", "m.size", "m.content", "m.error")


def taken(path: str, data: bytes, names: list[str]) -> list[tuple]:
    """Page, name, content and error of the members of a container that ``names`` asks for, or one row with its error."""
    asked = {n: i for i, n in enumerate(names)}
    _, _, _, error, rows = read_container(path, data, asked.__contains__)
    return sorted(((asked[r[0]], r[0], r[4], r[5]) for r in rows if r[0] in asked), key=lambda r: r[:2]) or [(None, None, None, error or "no such members")]
