"""Line deduplication by overlapping three-line windows, in DataFrame operations only.

Every three successive lines of a text form a window; windows are hashed (two 64-bit hashes) and counted
over the whole table.  The first occurrence, in the order of doc_id and line, stays.  The lines that later
occurrences cover are removed, after overlapping windows of a text have been merged to runs.

A window that many documents share is pre-aggregated before its shuffle and meets its occurrences in a
join that Spark can split, so no group of occurrences is gathered anywhere.  Only the runs of one text
come together, and they are no more than its own lines.

Defined results: lines end at a line feed and are compared without the spaces around them; windows of
blank lines alone don't count; texts of fewer than three lines stay as they are; a null text stays null;
rows with the same doc_id are one document (none is later than the other, a window that they share stays
in both, repeated rows get the same result); a null doc_id comes after all others; an empty table gives an
empty result.  Extra columns pass through, whatever their names: a row travels as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a window.
LINES = 3
_LAST = (1 << 63) - 1


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The order of the document, a hash that tells texts of one doc_id apart, and the lines."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(body).alias("version"), F.split(body, "\n", -1).alias("lines"))


def _windows(keyed: DataFrame) -> DataFrame:
    """doc, version, at (line), h1, h2 of every window."""
    trimmed = F.transform("lines", lambda x: F.trim(x))

    def window(i: Column) -> Column:
        lines = [F.get("trimmed", i + k) for k in range(LINES)]
        return F.when(F.concat(*lines) != "", F.struct(F.xxhash64(*lines).alias("h1"), F.xxhash64(F.lit(7), *reversed(lines)).alias("h2")))

    rows = keyed.where(F.size("lines") >= LINES).select("doc", "version", trimmed.alias("trimmed"))
    rows = rows.select("doc", "version", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("trimmed") - LINES), window)).alias("at", "w"))
    return rows.where("w IS NOT NULL").select("doc", "version", "at", "w.h1", "w.h2")


def _mark(doc: str, at: str) -> Column:
    """Document and line in one number, whose minimum a hash aggregation can keep."""
    return F.col(doc).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(at).cast("decimal(10,0)")


def covered_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, version and runs (array of first line, line behind the last) of the texts with later occurrences."""
    windows = _windows(_keyed(docs, doc_id, text))
    first = windows.groupBy("h1", "h2").agg(F.min(_mark("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).where(_mark("doc", "at") > F.col("first")).select("doc", "version", "at")
    later = later.dropDuplicates(["doc", "version", "at"])
    order = Window.partitionBy("doc", "version").orderBy("at")
    starts = later.withColumn("new", F.coalesce((F.col("at") > F.lag("at").over(order) + LINES).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(order)).groupBy("doc", "version", "run").agg(F.min("at").alias("start"), (F.max("at") + LINES).alias("end"))
    return runs.groupBy("doc", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def deduplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines_as: str | None = None, removed_as: str | None = None) -> DataFrame:
    """``docs`` with the lines of later occurrences removed from ``text``.

    ``lines_as`` and ``removed_as`` name columns (int) for the numbers of lines and of removed lines; they
    replace columns of that name.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(body).alias("version"))
    found = rows.join(covered_runs(docs, doc_id, text), ["doc", "version"], "left")
    old = F.col(f"row.`{text}`")
    lines = F.split(F.coalesce(old, F.lit("")), "\n", -1)

    def piece(k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("runs", k - 1)["end"])
        end = F.coalesce(F.get("runs", k)["start"], F.size(lines))
        return F.slice(lines, start + 1, end - start)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), piece))
    removed = F.coalesce(F.aggregate("runs", F.lit(0), lambda n, r: n + r["end"] - r["start"]), F.lit(0))
    changed = F.when(F.col("runs").isNull(), old).otherwise(F.array_join(kept, "\n"))
    extra = {name: value for name, value in ((lines_as, F.size(lines)), (removed_as, removed)) if name}
    own = [(changed if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in extra]
    return found.select(*own, *[v.alias(n) for n, v in extra.items()])


def op7_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the MD5 of the text that is left."""
    kept = deduplicate_lines(docs.select("doc_id", "text"), lines_as="n_lines", removed_as="n_removed")
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, u.i - 1 AS pos, u.l AS line, trim(u.l) AS t
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'l': x, 'i': i})) AS u FROM documents)
), windows AS (
  SELECT doc_id, pos, md5(concat_ws(chr(10), t, t1, t2)) AS h
  FROM (SELECT doc_id, pos, t, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  WHERE t2 IS NOT NULL AND t || t1 || t2 <> ''
), later AS (
  SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (SELECT unnest([0, 1, 2]) AS k)
)
SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
       md5(coalesce(string_agg(CASE WHEN c.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_md5
FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
GROUP BY l.doc_id
"""
