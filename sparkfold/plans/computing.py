"""Queries of the derivation rules on columns of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import derive as R
from ..operators import lookup as L
from ..sources import documents as D
from .registry import query


@query("SELECT l_orderkey, CAST(count(*) AS INTEGER) AS pages FROM lineitem GROUP BY l_orderkey")
def c01_page_count(t):
    counted = t("lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").cast("int").alias("n"))
    return counted.select("l_orderkey", R.page_count(F.lit(None).cast("int"), F.col("n")).alias("pages"))


_NOTES = "'Tagged with X dev on ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || ' [RELDATE:' || strftime(o_orderdate, '%Y-%m-%d') || '] urn:metron:issue:' || o_orderkey || ' [CVDB' || o_custkey || ']'"


def _notes():
    return F.concat(F.lit("Tagged with X dev on "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" [RELDATE:"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("] urn:metron:issue:"), F.col("o_orderkey").cast("string"), F.lit(" [CVDB"), F.col("o_custkey").cast("string"), F.lit("]"))


@query(rf"""SELECT o_orderkey, trim(regexp_extract(n, 'Tagged\s(?:with|by)\s(\w+(?:\s(?:dev|test|[\d.]+\S+))?)', 1)) AS tagger, regexp_extract(n, '\son\s([12]\d{{3}}-[01]\d-[0-3]\d)', 1) AS updated, CAST(regexp_extract(n, 'RELDATE:([0-9-]+)', 1) AS DATE) AS released,
'comicvine=' || o_custkey || ',metron=' || o_orderkey AS ids FROM (SELECT *, {_NOTES} AS n FROM orders)""")
def c03_notes(t):
    rows = t("orders").select("o_orderkey", _notes().alias("n"))
    tagger, updated, released = R.notes_facts(F.col("n"))
    ids = F.array_sort(F.transform(R.notes_identifiers(F.col("n")), lambda x: F.concat(x["source"], F.lit("="), x["key"])))
    return rows.select("o_orderkey", tagger.alias("tagger"), F.date_format(updated, "yyyy-MM-dd").alias("updated"), released.alias("released"), F.array_join(ids, ",").alias("ids"))


@query("SELECT o_orderkey, 'Tagged with me on 1970-01-01T00:00:00Z urn:metron:issue:' || o_orderkey AS notes FROM orders")
def c04_stamp(t):
    ids = F.create_map(F.lit("metron"), F.struct(F.col("o_orderkey").cast("string").alias("key"), F.lit(None).cast("string").alias("url")))
    return t("orders").select("o_orderkey", R.stamp(F.lit("me"), F.lit("1970-01-01").cast("timestamp"), ids).alias("notes"))


@query("SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS number, 'S' AS suffix FROM part")
def c05_issue_parts(t):
    number, suffix = R.issue_from_name(F.concat(F.col("p_partkey").cast("string"), F.lit("S")))
    return t("part").select("p_partkey", number.cast("double").alias("number"), suffix.alias("suffix"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey || '.5' ELSE CAST(p_partkey AS VARCHAR) END || p_type AS name FROM part")
def c06_issue_name(t):
    number = (F.col("p_partkey") + F.when(F.col("p_size") % 2 == 0, 0.5).otherwise(0.0)).cast("decimal(12,3)")
    return t("part").select("p_partkey", R.issue_from_parts(number, F.col("p_type")).alias("name"))


@query("SELECT p_partkey, 'leagueofcomicgeeks' AS source, 'series' AS type, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_size % 2 = 0")
def c09_tag_identifiers(t):
    tags = F.array(F.lit("plain"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("leagueofcomicgeeks:series:"), "p_partkey")).otherwise(F.lit("x:y")))
    rows = t("part").select("p_partkey", F.explode(R.tag_identifiers(tags)).alias("i"))
    return rows.select("p_partkey", F.col("i.source").alias("source"), F.col("i.type").alias("type"), F.col("i.key").alias("key"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS key, 'https://comicvine.gamespot.com/c/4050-' || p_partkey || '/' AS url FROM part")
def c10_missing_urls(t):
    ids = F.create_map(F.lit("comicvine"), F.struct(F.concat(F.lit("4050-"), "p_partkey").alias("key"), F.lit(None).cast("string").alias("url")))
    found = R.with_urls(ids, I.DEFAULT_TYPE)["comicvine"]
    return t("part").select("p_partkey", found["key"].alias("key"), found["url"].alias("url"))


@query("""SELECT o_orderkey, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN TRY_CAST(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) END AS cover_date, CAST(y AS BIGINT) AS year, CAST(CASE WHEN m BETWEEN 1 AND 12 THEN m END AS BIGINT) AS month, CAST(CASE WHEN d BETWEEN 1 AND 31 THEN d END AS BIGINT) AS day
FROM (SELECT o_orderkey, year(o_orderdate) AS y, o_custkey % 14 AS m, o_orderkey % 33 AS d FROM orders)""")
def c11_dates(t):
    whole, year, month, day = R.dates(F.lit(None).cast("date"), F.year("o_orderdate"), F.col("o_custkey") % 14, F.col("o_orderkey") % 33)
    return t("orders").select("o_orderkey", whole.alias("cover_date"), year.cast("bigint").alias("year"), month.cast("bigint").alias("month"), day.cast("bigint").alias("day"))


@query("SELECT p_partkey, p_type AS added FROM part WHERE p_type <> p_name")
def c12_title_stories(t):
    rows = t("part").select("p_partkey", F.explode(R.title_stories(F.concat_ws("; ", "p_name", "p_type"), F.array("p_name"))).alias("added"))
    return rows


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' '), '; ') AS title FROM part")
def c13_stories_title(t):
    return t("part").select("p_partkey", R.stories_title(F.split("p_name", " ")).alias("title"))


@query("""SELECT user_id, string_agg(series || ':' || language, ',' ORDER BY first) AS entries FROM (SELECT user_id, min(event_id) AS first, CASE WHEN min(event_id) % 3 = 0 THEN upper(event_type) ELSE event_type END AS series,
coalesce(max(CASE WHEN event_id % 2 = 0 THEN 'en' END), '') AS language FROM events GROUP BY user_id, event_type) GROUP BY user_id""")
def c14_reprint_consolidation(t):
    """Entries that agree in all they have are one: the first spelling, the language of any."""
    entry = F.struct(F.when(F.col("event_id") % 2 == 0, F.lit("en")).alias("language"), F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("series"))
    rows = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))).alias("m"))
    folded = L.consolidate(F.transform("m", lambda x: x["e"]), ["language", "series"])
    return rows.select("user_id", F.array_join(F.transform(folded, lambda e: F.concat_ws(":", e["series"], F.coalesce(e["language"], F.lit("")))), ",").alias("entries"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN 'Digital' END AS original_format FROM part")
def c15_format_from_scan(t):
    original = F.when(F.col("p_size") % 3 == 0, F.col("p_type"))
    scan = F.when(F.col("p_size") % 3 == 1, F.lit("(DIGITAL) group")).otherwise(F.lit("group"))
    return t("part").select("p_partkey", R.format_from_scan(original, scan).alias("original_format"))


@query("SELECT o_orderkey, o_orderstatus, CAST(NULL AS VARCHAR) AS priority FROM orders")
def p04_delete_paths(t):
    rows = t("orders").select("o_orderkey", F.struct("o_orderstatus", F.struct(F.col("o_orderpriority").alias("priority")).alias("inner")).alias("r"))
    return R.delete_paths(rows, "r", ("inner.priority", "not.there")).select("o_orderkey", "r.o_orderstatus", F.col("r.inner.priority").alias("priority"))


@query(r"""SELECT p_partkey, p_name AS series, CAST(p_size AS VARCHAR) AS issue, CAST(1900 + p_size AS INTEGER) AS year, 'cbz' AS ext, p_type AS title FROM part""")
def f05_filename(t):
    """Fields of file names built from parts."""
    name = F.concat("p_name", F.lit(" #00"), "p_size", F.lit(" ("), 1900 + F.col("p_size"), F.lit(") "), "p_type", F.lit(".cbz"))
    r = t("part").select("p_partkey", D.filename(name).alias("r"))
    return r.select("p_partkey", F.col("r.series.name").alias("series"), F.col("r.issue.name").alias("issue"), F.col("r.date.year").alias("year"), F.col("r.ext").alias("ext"), F.col("r.title").alias("title"))
