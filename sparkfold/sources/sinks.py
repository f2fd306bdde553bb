"""Sinks: documents, patched and converted archives, extracted pages and covers, renamed files.

Archives, pages and renames are written to folders that all workers mount.  A file is written beside its
target and renamed, so a retried or doubled task leaves whole files only.  Every writer gives one result row per
input, with ``error`` where it failed; two inputs with one target are errors, neither is written.
"""

from __future__ import annotations

import io
import os
import threading
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import archives as A

RESULT = "path string, target string, written boolean, bytes bigint, error string"


def safe_target(folder: str, name: str) -> str:
    """The place of a member below a folder; a name that leads out of it is an error."""
    target = os.path.normpath(os.path.join(folder, name))
    if os.path.isabs(name) or not target.startswith(os.path.normpath(folder) + os.sep):
        raise ValueError(f"{name} leads out of {folder}")
    return target


def _write(target: str, body: bytes) -> None:
    os.makedirs(os.path.dirname(target), exist_ok=True)
    waiting = f"{target}.{uuid.uuid4().hex}"
    with open(waiting, "wb") as file:
        file.write(body)
    os.replace(waiting, target)


def rebuild_zip(name: str, data: bytes, documents: dict[str, str], comment: str | None = None) -> bytes:
    """A zip with the members of a container, without its old metadata, and the new documents.

    Images are stored, other members deflated.  ``comment`` replaces the container's own; None keeps it.
    """
    kind, old_comment, _, error, members = A.read_container(name, data, lambda n: not A.metadata_content(n))
    if error or kind not in ("CBZ", "CBT"):
        raise ValueError(error or f"cannot convert {kind} containers")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as target:
        for member, _, modified, is_dir, body, fault in members:
            if fault:
                raise ValueError(f"{member}: {fault}")
            if is_dir or A.metadata_content(member):
                continue
            moment = modified.timetuple()[:6] if modified and modified.year >= 1980 else (1980, 1, 1, 0, 0, 0)
            info = zipfile.ZipInfo(member, moment)
            info.compress_type = zipfile.ZIP_STORED if member.lower().endswith(A.IMAGES) else zipfile.ZIP_DEFLATED
            target.writestr(info, body, compresslevel=9)
        for member, text in sorted(documents.items()):
            if text is not None:
                target.writestr(zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED, 9)
        kept = old_comment if comment is None else comment
        if kept:
            target.comment = kept.encode()[:65535]
    return out.getvalue()


def relative_to(path: Column, root: str) -> Column:
    """A file's path below the folder that was read, without its suffix."""
    base = "/" + root.split("://", 1)[-1].split(":", 1)[-1].strip("/") + "/"
    tail = F.when(F.contains(path, F.lit(base)), F.substring_index(path, base, -1)).otherwise(F.element_at(F.split(path, "/"), -1))
    return F.regexp_replace(tail, r"\.[^./]*$", "")


def with_targets(rows: DataFrame, target: Column) -> DataFrame:
    """``rows`` (path, ...) with ``target`` and ``clash``: the number of other rows with that target.

    Rows are made once.  Of rows with the content of their files only names are shuffled.
    """
    if "content" not in rows.columns:
        return rows.withColumn("target", target).withColumn("clash", F.count("*").over(Window.partitionBy("target")) - 1)
    named = rows.select("path", target.alias("target"))
    n = named.groupBy("target").agg((F.count("*") - 1).alias("clash"))
    return rows.join(named.join(n, "target"), "path")


def write_archives(rows: DataFrame, folder: str, root: str, dry_run: bool = False, delete_original: bool = False) -> DataFrame:
    """Writes (path, content, documents map<string,string>, comment) as zips below ``folder``; RESULT rows.

    Files of a mounted folder need no content, the workers open them.  The path below ``root`` is kept, so equal base names don't meet.  ``delete_original`` removes a source that
    has been written elsewhere.
    """
    given = ["content"] if "content" in rows.columns else []
    columns = ["path", *given, *[c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("documents", "comment")]]
    placed = with_targets(rows.select(*columns), F.concat(relative_to(F.col("path"), root), F.lit(".cbz")))

    def one(path: str, documents: dict, comment: str | None, name: str, clash: int, data: bytes | None = None) -> tuple:
        if clash:
            raise ValueError(f"{clash} other files have the target {name}")
        body = rebuild_zip(path, data if given else A.read_file(path), documents, comment)
        target = safe_target(folder, name)
        if dry_run:
            return path, None, False, len(body), None
        _write(target, body)
        local = path.removeprefix("file://").removeprefix("file:")
        if delete_original and os.path.abspath(local) != os.path.abspath(target) and os.path.exists(local):
            os.remove(local)
        return path, target, True, len(body), None

    return _results(placed.select("path", "documents", "comment", "target", "clash", *given), one)


def _guarded(one: Callable, *values):
    """What ``one`` gives; what it raises is the error of a row."""
    try:
        return one(*values)
    except Exception as fault:  # K13: a failure is a row and does not stop the others
        return values[0], None, False, None, f"{type(fault).__name__}: {fault}"


def _results(rows: DataFrame, one: Callable, several: bool = False) -> DataFrame:
    """A RESULT row for each row, or a list of them; what ``one`` raises is its error."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
        for batch in batches:
            done = []
            for i in range(len(batch)):
                values = [dict(c[i].as_py() or []) if pa.types.is_map(c.type) else c[i].as_py() for c in batch.columns]
                found = _guarded(one, *values)
                done += found if several and isinstance(found, list) else [found]
            columns = list(zip(*done, strict=True)) if done else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "target", "written", "bytes", "error"])

    return rows.mapInArrow(run, RESULT)


def _extracted(path: str, name: str | None, content: bytes | None, error: str | None, place: str, folder: str, dry_run: bool) -> tuple:
    if error or content is None:
        raise ValueError(error or f"{name} has no content")
    target = safe_target(folder, os.path.join(place, name))
    if not dry_run:
        _write(target, content)
    return path, target, not dry_run, len(content), None


def extract_members(wanted: DataFrame, folder: str, root: str, dry_run: bool = False) -> DataFrame:
    """Writes the members that ``wanted`` (path, names and, unless workers open the files, content) asks for; RESULT rows, one a member.

    Nothing else is decompressed.
    """
    given = ["content"] if "content" in wanted.columns else []
    rows = wanted.select("path", "names", relative_to(F.col("path"), root).alias("place"), *given)

    def each(path: str, names: list[str], place: str, data: bytes | None = None) -> list[tuple]:
        members = A.taken(path, data if given else A.read_file(path), names)
        return [_guarded(_extracted, path, name, content, error, place, folder, dry_run) for _, name, content, error in members]

    return _results(rows, each, several=True)


def extract(pages: DataFrame, folder: str, root: str, dry_run: bool = False) -> DataFrame:
    """Writes pages (path, name, content, error) to a folder for each container; RESULT rows, one a page.

    Without ``content`` a page is the whole file of its path, which the workers open.
    """
    given = ["content"] if "content" in pages.columns else []
    rows = pages.select("path", "name", "error", relative_to(F.col("path"), root).alias("place"), *given)

    def one(path: str, name: str, error: str | None, place: str, data: bytes | None = None) -> tuple:
        return _extracted(path, name, data if given or error else A.read_file(path), error, place, folder, dry_run)

    return _results(rows, one)


def page_range(pages: DataFrame, first: int, last: int | None) -> DataFrame:
    """Pages with numbers from ``first`` to ``last``, both inclusive; no end means until the last page."""
    return pages.where(F.col("page") >= first) if last is None else pages.where(F.col("page").between(first, last))


def rename_files(rows: DataFrame, dry_run: bool = False) -> DataFrame:
    """Gives files (path, name) their new base names in their folders; RESULT rows.  An existing file is never replaced."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    placed = with_targets(rows.where("name IS NOT NULL").select("path", "name"), F.concat(folder, "name"))

    def one(path: str, name: str, target: str, clash: int) -> tuple:
        source, goal = (p.removeprefix("file://").removeprefix("file:") for p in (path, target))
        if clash:
            raise ValueError(f"{clash} other files have the target {goal}")
        if source == goal:
            return path, goal, False, os.path.getsize(source), None
        if os.path.exists(goal):
            raise FileExistsError(f"{goal} exists")
        size = os.path.getsize(source)
        if not dry_run:
            os.rename(source, goal)
        return path, goal, not dry_run, size, None

    return _results(placed.select("path", "name", "target", "clash"), one)


def export(rows: DataFrame, folder: str, root: str, formats: list[str], dry_run: bool = False) -> DataFrame:
    """Rendered documents (a column for each format) as one file for each record and format, named after the container; RESULT rows."""
    stem = relative_to(F.col("path"), root)
    each = F.explode(F.array(*[F.struct(F.lit(A.FILE_NAMES.get(f, f"{f}.txt")).alias("file"), F.col(f).alias("text")) for f in formats]))
    documents = rows.select("path", stem.alias("stem"), each.alias("d")).select("path", F.concat_ws("/", "stem", "d.file").alias("place"), "d.text").where("text IS NOT NULL")

    def one(path: str, place: str, text: str) -> tuple:
        target, body = safe_target(folder, place), text.encode()
        if not dry_run:
            _write(target, body)
        return path, target, not dry_run, len(body), None

    return _results(documents, one)


def export_table(rows: DataFrame, folder: str, formats: list[str]) -> None:
    """K03 for any file system: Parquet with path, fmt and text, a folder for each format."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("fmt"), F.col(f).alias("text")) for f in formats]))
    documents = rows.select("path", each.alias("d")).select("path", "d.fmt", "d.text").where("text IS NOT NULL")
    documents.write.mode("overwrite").partitionBy("fmt").parquet(folder)


#: Seconds between two looks at whether a run has been cancelled.
LOOK = 0.2


class Watch:
    """Interrupts the jobs of a tag as soon as ``cancelled`` says so, while the body of the ``with`` runs.

    ``cancelled`` is asked in another thread.  The error with which interrupted jobs end is swallowed; ``hit`` tells
    whether it came to that.
    """

    def __init__(self, spark: SparkSession, cancelled: Callable[[], bool]) -> None:
        self.spark, self.cancelled, self.tag = spark, cancelled, f"sparkfold-{uuid.uuid4().hex}"
        self.over, self.hit = threading.Event(), False
        self.thread = threading.Thread(target=self._look, daemon=True)

    def _look(self) -> None:
        while not self.over.wait(LOOK):
            if self.cancelled():
                self.hit = True
                while not self.over.wait(LOOK):  # a plan has several jobs, and the next one may just begin
                    self.spark.sparkContext.cancelJobsWithTag(self.tag)
                return

    def __enter__(self) -> Watch:
        context = self.spark.sparkContext  # tags of the context are seen by all threads, those of a session by their own
        context.addJobTag(self.tag)
        context.setInterruptOnCancel(True)
        self.thread.start()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> bool:
        self.over.set()
        self.thread.join()
        self.spark.sparkContext.removeJobTag(self.tag)
        self.spark.sparkContext.setInterruptOnCancel(False)
        return self.hit and isinstance(error, Exception)


def in_windows(rows: DataFrame, write: Callable[[DataFrame], DataFrame], results: str, windows: int = 8, stop_on_error: bool = False, cancelled: Callable[[], bool] = lambda: False) -> DataFrame:
    """Runs ``write`` window after window, each a Spark job, and returns its RESULT rows from the folder ``results``.

    Rows are dealt to windows by a hash of their path.  ``cancelled`` is asked all the time: the job that runs is
    interrupted, and no further one begins.  With ``stop_on_error`` no further one begins after an error.  What finished
    windows have written stays.  There is one row for each input: those of an interrupted window get the error
    ``interrupted`` (a file of theirs is whole or not there, as files are written under another name first), those of
    windows that were not run get ``cancelled``.
    """
    spark, stopped = rows.sparkSession, False
    window = F.pmod(F.xxhash64("path"), F.lit(windows))

    def report(part: DataFrame, error: str, at: str) -> None:
        part.select("path", F.lit(None).cast("string").alias("target"), F.lit(False).alias("written"), F.lit(None).cast("bigint").alias("bytes"), F.lit(error).alias("error")).write.mode("overwrite").parquet(at)

    for i in range(windows):
        part, at = rows.where(window == i), f"{results}/window={i}"
        stopped = stopped or cancelled()
        if stopped:
            report(part, "cancelled", at)
            continue
        whole = False
        with Watch(spark, cancelled) as watch:
            write(part).write.parquet(at)
            whole = True
        stopped = watch.hit
        if not whole:
            report(part, "interrupted", at)
        elif stop_on_error and not stopped:
            stopped = not spark.read.schema(RESULT).parquet(at).where("error IS NOT NULL").isEmpty()
    return spark.read.schema(RESULT).parquet(results)
