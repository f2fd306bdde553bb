"""Scalar functions applied to whole tables (X01 to X39, projections and filters of single values)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import numbers as N
from ..functions import text as T
from ..operators import shape as H
from .registry import query


@query(r"SELECT p_partkey, regexp_replace('  ' || p_name || chr(9) || ' ', '^\s+|\s+$', '', 'g') AS stripped, regexp_replace(translate(' ' || p_name || chr(9) || p_brand, chr(9), ' '), '^\s+|\s+$', '', 'g') AS tabless FROM part")
def x01_strip(t):
    return t("part").select("p_partkey", T.strip(F.concat(F.lit("  "), "p_name", F.lit("\t "))).alias("stripped"), T.clean_tabs(F.concat(F.lit(" "), "p_name", F.lit("\t"), "p_brand")).alias("tabless"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace('# 00' || p_partkey || ' 1/2..', ' ', ''), '^#+', ''), '^0+([0-9A-Za-z_])', '\1'), '\.+$', ''), '½|1/2', '.5', 'g') AS issue FROM part""")
def x02_issue_name(t):
    return t("part").select("p_partkey", T.issue_name(F.concat(F.lit("# 00"), "p_partkey", F.lit(" 1/2.."))).alias("issue"))


@query("SELECT p_partkey, regexp_replace(p_size || '½ and 1/2', '½|1/2', '.5', 'g') AS halved FROM part")
def x03_halves(t):
    return t("part").select("p_partkey", T.halves(F.concat(F.col("p_size").cast("string"), F.lit("½ and 1/2"))).alias("halved"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(n, '[0-9]') THEN n END AS number, regexp_extract(v, '^[0-9]*\.?[0-9]*(.*)$', 1) AS suffix
FROM (SELECT *, regexp_extract(v, '^([0-9]*\.?[0-9]*)', 1) AS n FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_size || '.5' || p_type END AS v FROM part))""")
def x04_issue_parts(t):
    value = F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5"), F.col("p_type")))
    return t("part").select("p_partkey", T.issue_number(value).alias("number"), T.issue_suffix(value).alias("suffix"))


@query(r"SELECT p_partkey, regexp_replace('000' || p_partkey || 'A', '^0+([0-9])', '\1') AS stripped FROM part")
def x05_strip_leading_zeros(t):
    return t("part").select("p_partkey", T.strip_leading_zeros(F.concat(F.lit("000"), "p_partkey", F.lit("A"))).alias("stripped"))


@query(r"SELECT p_partkey, TRY_CAST(CASE WHEN regexp_matches(trim(v), '^[0-9]+$') THEN trim(v) END AS BIGINT) AS issue FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ' ' || p_size || ' ' ELSE p_size || 'A' END AS v FROM part)")
def x06_issue_int(t):
    value = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" "), "p_size", F.lit(" "))).otherwise(F.concat("p_size", F.lit("A")))
    return t("part").select("p_partkey", T.issue_int(value).alias("issue"))


@query(r"SELECT o_orderkey, TRY_CAST(nullif(regexp_extract('v' || o_custkey || ' in (' || year(o_orderdate) || ')', '\b([0-9]{4})\b', 1), '') AS INTEGER) AS year FROM orders")
def x07_first_year(t):
    return t("orders").select("o_orderkey", T.first_year(F.concat(F.lit("v"), "o_custkey", F.lit(" in ("), F.year("o_orderdate"), F.lit(")"))).alias("year"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('The ' || p_name || ' (Vol. ' || p_size || ')'), '(?i)\s*(?:\(\s*)?(?:vol(?:ume|\.)?)\s*\d+\s*\)?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS series FROM part""")
def x08_normalize_series(t):
    return t("part").select("p_partkey", T.normalize_series(F.concat(F.lit("The "), "p_name", F.lit(" (Vol. "), "p_size", F.lit(")"))).alias("series"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_brand || ' Comics, Inc. ' || p_type), '(?i)\b(?:inc|incorporated|comics?|publishing|press|llc|ltd|publications?)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS publisher FROM part""")
def x09_normalize_publisher(t):
    return t("part").select("p_partkey", T.normalize_publisher(F.concat("p_brand", F.lit(" Comics, Inc. "), "p_type")).alias("publisher"))


@query("SELECT p_partkey, p_name || CASE p_size % 4 WHEN 0 THEN ' x' WHEN 1 THEN ' x' WHEN 2 THEN ' (1990-) x' ELSE ' (v2) x' END AS name FROM part")
def x10_strip_years(t):
    """Years and ranges of years go, with spaces around them; an open range and other parentheses stay."""
    years = F.element_at(F.array(*[F.lit(x) for x in (" ( 1990 ) x", " (1990 – 2001) x", " (1990-) x", " (v2) x")]), F.col("p_size") % 4 + 1)
    return t("part").select("p_partkey", T.strip_years(F.concat("p_name", years)).alias("name"))


@query(r"SELECT p_partkey, array_to_string(list_sort(list_distinct([lower(v), replace(lower(v), ' ', ''), regexp_replace(lower(v), '[^a-z0-9]', '', 'g')])), '|') AS keys FROM (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '-X' ELSE '' END AS v FROM part)")
def x11_key_variations(t):
    value = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, F.lit("-X")).otherwise(F.lit("")))
    return t("part").select("p_partkey", F.array_join(F.array_sort(T.key_variations(value)), "|").alias("keys"))


@query(r"SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(p_name, ' ', ' , ') || ';;' || p_type, '[,;]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def x12_split_list(t):
    return t("part").select("p_partkey", F.array_join(T.split_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit(";;"), "p_type")), "|").alias("parts"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_name, ' '))), ',') AS joined FROM part")
def x13_join_sorted(t):
    return t("part").select("p_partkey", T.join_sorted(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")).alias("joined"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(?:script|style)\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<\s*(?:br|/p|/div|/li|/tr|/h[1-6]|/ul|/ol|/blockquote)\s*/?\s*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages""")
def x14_strip_html(t):
    return t("pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("text_md5"))


@query("""SELECT o_orderkey, TRY_CAST(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS cover_date, year(o_orderdate) AS y2, month(o_orderdate) AS m2, day(o_orderdate) AS d2
FROM (SELECT *, year(o_orderdate) AS y, o_custkey % 14 AS m, o_orderkey % 33 AS d FROM orders)""")
def x17_compose_date(t):
    return t("orders").select("o_orderkey", N.compose_date(F.year("o_orderdate"), F.col("o_custkey") % 14, F.col("o_orderkey") % 33).alias("cover_date"), F.year("o_orderdate").cast("long").alias("y2"), F.month("o_orderdate").cast("long").alias("m2"), F.dayofmonth("o_orderdate").cast("long").alias("d2"))


@query(r"""SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(n, '\[RELDATE:([^\]\s]+)\]', 1), '') AS DATE) AS released
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'no date' ELSE 'Tagged [RELDATE:' || strftime(o_orderdate, '%Y-%m-%d') || '] x' END AS n FROM orders)""")
def x18_reldate(t):
    notes = F.when(F.col("o_orderkey") % 7 == 0, F.lit("no date")).otherwise(F.concat(F.lit("Tagged [RELDATE:"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("] x")))
    return t("orders").select("o_orderkey", N.reldate(notes).alias("released"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def x19_iso_seconds(t):
    return t("events").select("event_id", N.iso_seconds(F.col("ts")).alias("iso"))


@query("""SELECT event_id, CAST(least(round(CAST(CASE WHEN v <= 0 THEN 0 WHEN v <= 10 THEN v / 2 ELSE v / (pow(10.0, ceil(log10(v))) / 5) END AS DECIMAL(18,8)), 1), 5) AS DOUBLE) AS rating
FROM (SELECT event_id, value - 1 AS v FROM events)""")
def x20_canonical_rating(t):
    return t("events").select("event_id", N.canonical_rating(F.col("value") - 1).alias("rating"))


@query("SELECT event_id, CAST(least(greatest(round(CAST(value / 20 AS DECIMAL(18,8)) * 2, 0), 0), 10) AS INTEGER) AS rating FROM events")
def x21_rating_of_ten(t):
    return t("events").select("event_id", N.rating_of_ten(F.col("value") / 20).alias("rating"))


@query("SELECT p_partkey, least(greatest(p_size, 10), 40) AS clamped FROM part")
def x22_clamp(t):
    return t("part").select("p_partkey", N.clamp(F.col("p_size"), 10, 40).alias("clamped"))


@query("""SELECT n_nationkey, least(pow(2.0, n_nationkey), 60.0) AS backoff, CAST(list_extract([30, 60, 120, 300, 600, 600, 600, 600], least(greatest(n_nationkey, 1), 8)) AS INTEGER) AS wait, CAST(CASE WHEN n_regionkey = 0 THEN list_extract([30, 60, 120, 300, 600, 600, 600, 600], least(greatest(n_nationkey, 1), 8)) ELSE least(n_regionkey * 1500, 3600) END AS INTEGER) AS hinted FROM nation""")
def x23_backoff(t):
    hint = F.when(F.col("n_regionkey") > 0, F.col("n_regionkey") * 1500)
    return t("nation").select("n_nationkey", N.backoff(F.col("n_nationkey")).alias("backoff"), N.rate_limit_wait(F.col("n_nationkey")).alias("wait"), N.rate_limit_wait(F.col("n_nationkey"), hint).alias("hinted"))


@query("""SELECT doc_id, CAST(bit_count(xor(a1, b1)) + bit_count(xor(a2, b2)) AS INTEGER) AS distance, greatest(0.0, 1 - (bit_count(xor(a1, b1)) + bit_count(xor(a2, b2))) / 64.0) AS score FROM (
SELECT doc_id, CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) AS a1, CAST('0x' || substr(md5(text), 9, 8) AS BIGINT) AS a2, CAST('0x' || substr(md5(source), 1, 8) AS BIGINT) AS b1, CAST('0x' || substr(md5(source), 9, 8) AS BIGINT) AS b2 FROM documents)""")
def x24_hamming(t):
    d = N.hamming(F.md5("text"), F.md5("source"))
    return t("documents").select("doc_id", d.alias("distance"), N.hash_score(d).alias("score"))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'gif' WHEN 4 THEN 'webp' END AS kind FROM part""")
def x26_sniff(t):
    heads = ["255044462D312E37", "FFD8FFE000104A46", "89504E470D0A1A0A00", "474946383961", "524946460000000057454250", "00010203"]
    content = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), F.col("p_size") % 6 + 1))
    return t("part").select("p_partkey", N.sniff(content).alias("kind"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '') AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/', '') || regexp_extract(url, '(\?[^#]*)', 1) || regexp_extract(url, '(#.*)', 1) AS key FROM pages""")
def x27_parse_url(t):
    return t("pages").select("page_id", I.host_of(F.col("url")).alias("host"), I.unknown_key(F.col("url")).alias("key"))


@query("SELECT p_partkey, s AS source, 'issue' AS type, CAST(p_partkey AS VARCHAR) AS key FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'metron' WHEN 1 THEN 'comicvine' WHEN 2 THEN 'grandcomicsdatabase' WHEN 3 THEN 'marvel' ELSE 'upc' END AS s FROM part)")
def x28_url_type_and_key(t):
    """Every third path is in capitals."""
    source = F.element_at(F.array(*[F.lit(s) for s in ("metron", "comicvine", "grandcomicsdatabase", "marvel", "upc")]), F.col("p_size") % 5 + 1)
    path = F.try_parse_url(I.url_of(source, F.lit("issue"), F.col("p_partkey").cast("string")), F.lit("PATH"))
    found = I.url_type_and_key(source, F.when(F.col("p_partkey") % 3 == 0, F.upper(path)).otherwise(path))
    return t("part").select("p_partkey", source.alias("source"), found["type"].alias("type"), found["key"].alias("key"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'https://metron.cloud/series/' || p_partkey WHEN 1 THEN 'https://comicvine.gamespot.com/c/4050-' || p_partkey || '/' WHEN 2 THEN 'https://marvel.com/comics/series/' || p_partkey || '/s' ELSE '' END AS url FROM part""")
def x29_url_of(t):
    source = F.element_at(F.array(*[F.lit(s) for s in ("metron", "comicvine", "marvel", "upc")]), F.col("p_size") % 4 + 1)
    return t("part").select("p_partkey", I.url_of(source, F.lit("series"), F.col("p_partkey").cast("string")).alias("url"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'series' WHEN 1 THEN 'series' ELSE 'issue' END AS type, CAST(p_partkey AS VARCHAR) AS key FROM part""")
def x30_normalize_key(t):
    text = F.element_at(F.array(F.lit("series:"), F.lit("4050-"), F.lit("urn:comicvine:")), F.col("p_size") % 3 + 1)
    found = I.normalize_key(F.lit("comicvine"), F.lit("issue"), F.concat(text, F.col("p_partkey").cast("string")))
    return t("part").select("p_partkey", found["type"].alias("type"), found["key"].alias("key"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS key, 'https://metron.cloud/issue/' || p_partkey AS url FROM part")
def x31_identifier(t):
    found = I.identifier(F.lit("metron"), F.lit(None).cast("string"), F.concat(F.lit("urn:metron:issue:"), F.col("p_partkey").cast("string")))
    return t("part").select("p_partkey", found["key"].alias("key"), found["url"].alias("url"))


@query("SELECT p_partkey, 'metron' AS source, CASE WHEN p_size % 2 = 0 THEN 'series' ELSE 'issue' END AS type, CAST(p_partkey AS VARCHAR) AS key FROM part")
def x32_parse_urn(t):
    urn = F.concat(F.lit("urn:metron:"), F.when(F.col("p_size") % 2 == 0, F.lit("series:")).otherwise(F.lit("")), F.col("p_partkey").cast("string"))
    found = I.parse_urn(urn)
    return t("part").select("p_partkey", found["source"].alias("source"), found["type"].alias("type"), found["key"].alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'urn:upc:issue:' || p_partkey END AS urn FROM part")
def x33_urn_of(t):
    source = F.when(F.col("p_size") % 2 == 0, F.lit("example.org")).otherwise(F.lit("upc"))
    return t("part").select("p_partkey", I.urn_of(source, F.lit("issue"), F.col("p_partkey").cast("string")).alias("urn"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'comicvine' WHEN 1 THEN 'marvel' ELSE 'comicvine' END AS source, CASE p_size % 3 WHEN 0 THEN 'issue' WHEN 1 THEN 'series' ELSE 'character' END AS type, CAST(p_partkey AS VARCHAR) AS key FROM part")
def x34_parse_other(t):
    head = F.element_at(F.array(F.lit("CVDB"), F.lit("marvel:series:"), F.lit("4005-")), F.col("p_size") % 3 + 1)
    found = I.parse_other(F.concat(head, F.col("p_partkey").cast("string")))
    return t("part").select("p_partkey", found["source"].alias("source"), found["type"].alias("type"), found["key"].alias("key"))


@query("SELECT n_nationkey, CAST(CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 13 ELSE 16 END AS INTEGER) AS rank FROM nation")
def x35_source_rank(t):
    source = F.element_at(F.array(F.lit("Metron"), F.lit("upc"), F.lit("elsewhere")), F.col("n_nationkey") % 3 + 1)
    return t("nation").select("n_nationkey", I.rank_of(source).alias("rank"))


@query("SELECT p_partkey, p_size AS number, CASE WHEN p_size % 2 = 0 THEN p_size + 3 END AS number_to, CASE WHEN p_size % 2 = 0 THEN p_size || '-' || (p_size + 3) ELSE CAST(p_size AS VARCHAR) END AS text FROM part")
def x39_volume_range(t):
    text = F.when(F.col("p_size") % 2 == 0, F.concat_ws("-", "p_size", F.col("p_size") + 3)).otherwise(F.col("p_size").cast("string"))
    number, to = H.volume_range(text)
    return t("part").select("p_partkey", number.alias("number"), to.alias("number_to"), H.volume_text(number, to).alias("text"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE coalesce(year(o_orderdate) <= 1996 + CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 3 END, true)")
def p11_causality_filter(t):
    year = F.when(F.col("o_custkey") % 7 > 0, 1995 + F.col("o_custkey") % 3)
    return t("orders").where(H.predates(F.year("o_orderdate"), year)).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, CASE WHEN v NOT BETWEEN 1900 AND 2100 THEN v END AS volume FROM (SELECT c_custkey, c_custkey * 3 AS v FROM customer)")
def p17_year_shaped_volume(t):
    return t("customer").select("c_custkey", H.real_volume(F.col("c_custkey") * 3).alias("volume"))


@query("SELECT c_custkey, array_to_string(list_filter([nullif(c_mktsegment, 'BUILDING'), CAST(c_nationkey AS VARCHAR), ''], lambda x: x IS NOT NULL AND x <> ''), '|') AS kept FROM customer")
def p06_prune_empty(t):
    values = F.array(F.nullif("c_mktsegment", F.lit("BUILDING")), F.col("c_nationkey").cast("string"), F.lit(""))
    return t("customer").select("c_custkey", F.array_join(T.keep_nonempty(values), "|").alias("kept"))


@query("SELECT c_custkey, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, '') AS name, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), c_mktsegment) AS label FROM customer")
def p02_skip_empty_coalesce(t):
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_name"))
    return t("customer").select("c_custkey", H.nonempty(name).alias("name"), H.first_nonempty(name, F.col("c_mktsegment")).alias("label"))
