"""Queries of document formats: documents are built from table rows, read, merged and written again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import records as R
from ..sources import documents as D
from .registry import query


def _json(t):
    """One ComicBookInfo document per part."""
    body = F.struct(F.col("p_name").alias("series"), F.col("p_size").cast("string").alias("issue"), F.col("p_brand").alias("publisher"), F.col("p_type").alias("genre"), (F.col("p_size") + 1950).cast("string").alias("publicationYear"), F.lit(None).cast("double").alias("rating"))
    return t("part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("archive_file").alias("source"), F.lit("comic_book_info").alias("fmt"), F.lit(0).alias("ordinal"), F.to_json(F.struct(body.alias("ComicBookInfo/1.0"))).alias("payload"))


def _xml(t):
    """One ComicInfo document per part: it has another series and a title."""
    payload = F.concat(F.lit("<ComicInfo><Series>"), F.upper("p_name"), F.lit("</Series><Title>"), "p_type", F.lit("</Title><Genre>"), "p_type", F.lit(", Extra</Genre></ComicInfo>"))
    return t("part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("archive_file").alias("source"), F.lit("comic_info").alias("fmt"), F.lit(0).alias("ordinal"), payload.alias("payload"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS series, CAST(p_size AS VARCHAR) AS issue, p_brand AS publisher, p_type AS genres, CAST(p_size + 1950 AS INTEGER) AS year FROM part")
def f02_json_documents(t):
    r = D.normalize(_json(t), ["comic_book_info"])
    return r.select("path", F.col("record.series.name").alias("series"), F.col("record.issue.name").alias("issue"), F.col("record.publisher.name").alias("publisher"), F.array_join(F.array_sort(F.map_keys("record.genres")), ",").alias("genres"), F.col("record.date.year").alias("year"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, upper(p_name) AS series, p_type AS title, array_to_string(list_sort(list_distinct([p_type, 'Extra'])), ',') AS genres FROM part")
def f01_xml_documents(t):
    r = D.normalize(_xml(t), ["comic_info"])
    return r.select("path", F.col("record.series.name").alias("series"), F.col("record.title").alias("title"), F.array_join(F.array_sort(F.map_keys("record.genres")), ",").alias("genres"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, upper(p_name) AS series, CAST(p_size AS VARCHAR) AS issue, p_type AS title, array_to_string(list_sort(list_distinct([p_type, 'Extra'])), ',') AS genres FROM part")
def a01_document_merge(t):
    """The XML document wins over the JSON one; genres of both are united."""
    merged = R.merge_documents(D.normalize(_json(t).unionByName(_xml(t)), ["comic_book_info", "comic_info"]))
    return merged.select("path", F.col("record.series.name").alias("series"), F.col("record.issue.name").alias("issue"), F.col("record.title").alias("title"), F.array_join(F.array_sort(F.map_keys("record.genres")), ",").alias("genres"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS series, CAST(p_size AS BIGINT) AS issue, p_type AS genre FROM part")
def k02_render(t):
    """JSON documents are read and written again; what was written is read as plain JSON."""
    out = D.render(D.normalize(_json(t), ["comic_book_info"]), ["comic_book_info"])
    body = F.from_json("comic_book_info", "`ComicBookInfo/1.0` struct<series:string,issue:bigint,genre:string>")["ComicBookInfo/1.0"]
    return out.select("path", body["series"].alias("series"), body["issue"].alias("issue"), body["genre"].alias("genre"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE p_size % 4 WHEN 0 THEN 'comic_info' WHEN 1 THEN 'comic_book_info' WHEN 2 THEN 'native_json' ELSE 'filename' END AS fmt FROM part")
def f08_sniff_format(t):
    payload = F.element_at(F.array(F.lit("<ComicInfo></ComicInfo>"), F.lit('{"ComicBookInfo/1.0": {}}'), F.lit(f'{{"{D.NATIVE_ROOT}": {{}}}}'), F.col("p_name")), F.col("p_size") % 4 + 1)
    return t("part").select(F.col("p_partkey").cast("string").alias("path"), D.sniff_format(payload).alias("fmt"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'comic_info' WHEN 1 THEN 'native_json' ELSE 'native_yaml' END AS fmt FROM part")
def f09_guess_format(t):
    name = F.element_at(F.array(F.lit("ComicInfo.xml"), F.lit("a.json"), F.lit("b.YAML")), F.col("p_size") % 3 + 1)
    return t("part").select("p_partkey", D.guess_format(name).alias("fmt"))


@query("SELECT p_partkey, p_name || ' #' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ' (' || (1900 + p_size) || ') a_b.cbz' AS name FROM part")
def f06_filename_of(t):
    name = T.filename_from_fields(F.col("p_name"), F.col("p_size").cast("string"), 1900 + F.col("p_size"), F.lit("a/b"), F.lit("cbz"))
    return t("part").select("p_partkey", name.alias("name"))


@query("SELECT p_partkey, p_size % 3 > 0 AS document FROM part")
def f07_looks_like_document(t):
    text = F.element_at(F.array(F.col("p_name"), F.lit("<?xml version='1.0'?>"), F.lit("root:\n  a: 1")), F.col("p_size") % 3 + 1)
    return t("part").select("p_partkey", T.looks_like_document(text).alias("document"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, upper(p_name) AS series, CAST(p_size AS DOUBLE) AS issue, 'cbz' AS ext, p_type AS title FROM part")
def lifecycle(t):
    """Whole records: JSON and XML documents and file names are read, merged and derived."""
    names = t("part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("archive_filename").alias("source"), F.lit("filename").alias("fmt"), F.lit(0).alias("ordinal"), F.concat("p_name", F.lit(" #00"), "p_size", F.lit(".cbz")).alias("payload"))
    records = R.read_records(_json(t).unionByName(_xml(t)).unionByName(names), formats=["comic_book_info", "comic_info", "filename"])
    return records.select("path", F.col("record.series.name").alias("series"), F.col("record.issue.number").cast("double").alias("issue"), F.col("record.ext").alias("ext"), F.col("record.title").alias("title"))
