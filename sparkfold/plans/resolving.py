"""Queries of dimensions, containers, lookup order and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enums as E
from ..functions import numbers as N
from ..operators import lookup as L
from ..operators import resolve as R
from ..operators import validate as V
from .registry import query


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Everyone' WHEN 1 THEN 'Teen Plus' WHEN 2 THEN 'Mature' WHEN 3 THEN 'Adult' END AS rating FROM part")
def x36_age_rating(t):
    raw = F.element_at(F.array(F.lit("all ages"), F.lit("MA15+"), F.lit("MATURE 17+"), F.lit("AdultsOnly 18+"), F.lit("none of them")), F.col("p_size") % 5 + 1)
    return t("part").select("p_partkey", E.metron_age_rating(raw).alias("rating"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' END AS language, CASE p_size % 2 WHEN 0 THEN 'US' ELSE 'GB' END AS country FROM part")
def x37_iso_codes(t):
    language = F.element_at(F.array(F.lit("English"), F.lit("FR"), F.lit("Klingon")), F.col("p_size") % 3 + 1)
    country = F.when(F.col("p_size") % 2 == 0, F.lit("United States")).otherwise(F.lit("gb"))
    return t("part").select("p_partkey", E.language_code(language).alias("language"), E.country_code(country).alias("country"))


@query("""WITH m(a, c) AS (VALUES (0, 'Colorist'), (0, 'Inker'), (0, 'Penciller'), (1, 'Inker'), (1, 'Penciller'), (2, 'Writer')) SELECT p_partkey, string_agg(c, ',' ORDER BY c) AS roles FROM part JOIN m ON a = p_size % 3 GROUP BY p_partkey""")
def j05_native_roles(t):
    part = t("part")
    role = F.element_at(F.array(F.lit("Painter"), F.lit("ARTIST"), F.lit("plot")), F.col("p_size") % 3 + 1)
    rows = L.expand(part.select("p_partkey", role.alias("role")), "role", E.dimension(part.sparkSession, E.COMIC_INFO_ROLES), "tag")
    return rows.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("roles"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'CB7' WHEN 2 THEN 'CBZ' WHEN 3 THEN 'CBR' END AS file_type FROM part")
def s01_container_type(t):
    heads = ["255044462D", "377ABCAF271C00", "504B0304AA", "526172211A0700", "0011"]
    content = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), F.col("p_size") % 5 + 1))
    return t("part").select("p_partkey", N.container_type(F.lit("x"), content).alias("file_type"))


@query("""SELECT o_orderkey AS path, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS issue_id, CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 5 = 0 THEN 1 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM orders""")
def m14_lookup_order(t):
    keys = t("orders").select(F.col("o_orderkey").alias("path"))
    part = lambda n, v: keys.select("path", F.when(F.col("path") % n == 0, F.lit(v)).cast("bigint").alias("issue_id"))
    return R.lookup_order(part(7, 1), part(5, 2), part(3, 3), part(1, 4))


@query("""WITH f AS (SELECT o_orderkey, lower(o_orderstatus) || '|' || year(o_orderdate) AS fingerprint, o_custkey % 10 AS volume_id FROM orders), d AS (SELECT fingerprint, arg_min(volume_id, o_orderkey) AS v FROM f GROUP BY fingerprint)
SELECT o_orderkey, volume_id = v AS chosen FROM f JOIN d USING (fingerprint)""")
def m17_decisions(t):
    rows = t("orders").select("o_orderkey", F.concat_ws("|", F.lower("o_orderstatus"), F.year("o_orderdate")).alias("fingerprint"), (F.col("o_custkey") % 10).alias("volume_id"))
    decisions = rows.groupBy("fingerprint").agg(F.min_by("volume_id", "o_orderkey").alias("volume_id"))
    return R.apply_decisions(rows, decisions).select("o_orderkey", "chosen")


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_size % 20 <= 5 AND p_size % 15 BETWEEN 1 AND 12 AS valid FROM part")
def m24_validation(t):
    """A container is valid if both its documents fit the schemas of their formats."""
    xml = F.concat(F.lit("<ComicInfo><CommunityRating>"), F.col("p_size") % 20, F.lit("</CommunityRating></ComicInfo>"))
    json = F.concat(F.lit('{"ComicBookInfo/1.0": {"publicationMonth": '), F.col("p_size") % 15, F.lit("}}"))
    rows = t("part").select(F.col("p_partkey").cast("string").alias("path"), F.explode(F.map_from_arrays(F.array(F.lit("comic_info"), F.lit("comic_book_info")), F.array(xml, json))).alias("fmt", "payload"))
    return V.validate(rows, ["comic_info", "comic_book_info"])


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' END AS country, CAST(n_nationkey * 1.25 AS DOUBLE) AS price FROM nation")
def a23_currency(t):
    money = F.element_at(F.array(F.lit("usd"), F.lit("GBP"), F.lit("XXX")), F.col("n_nationkey") % 3 + 1)
    return t("nation").select("n_nationkey", E.country_of_currency(money).alias("country"), F.round(F.col("n_nationkey") * 1.25, 2).alias("price"))
