"""Queries of aggregations, reports and filters of members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ttl_seconds
from ..operators import evaluate as E
from ..operators import merge as M
from ..operators import online as O
from ..operators import records as R
from ..operators import shape as H
from .registry import query

KINDS = ["click", "error", "purchase", "signup", "view"]


_MEMBER = "p_name || CASE p_size % 6 WHEN 0 THEN '.JPG' WHEN 1 THEN '.txt' WHEN 2 THEN '/.hidden.png' WHEN 3 THEN '/__MACOSX/a.png' WHEN 4 THEN '/b.Webp' ELSE '.xml' END"


@query(f"SELECT p_brand, count(*) FILTER (p_size % 6 IN (0, 4)) AS kept, count(*) FILTER (p_size % 6 NOT IN (0, 4)) AS ignored, min({_MEMBER}) FILTER (p_size % 6 IN (0, 4)) AS first FROM part GROUP BY p_brand")
def p08_member_filter(t):
    tails = F.array(*[F.lit(x) for x in (".JPG", ".txt", "/.hidden.png", "/__MACOSX/a.png", "/b.Webp", ".xml")])
    name = F.concat("p_name", F.element_at(tails, F.col("p_size") % 6 + 1))
    page = E.is_page(F.col("name"))
    return t("part").select("p_brand", name.alias("name")).groupBy("p_brand").agg(F.count_if(page).alias("kept"), F.count_if(~page).alias("ignored"), F.min(F.when(page, F.col("name"))).alias("first"))


@query("""SELECT doc_id, CAST(len(list_filter(list_transform(range(1, 7), lambda i: CASE i WHEN 1 THEN 'p/' || doc_id || '.JPG' WHEN 2 THEN '__MACOSX/a.png' WHEN 3 THEN 'p/.hidden.png' WHEN 4 THEN 'info.xml' WHEN 5 THEN 'b.webp' ELSE CASE WHEN doc_id % 2 = 0 THEN 'c.gif' ELSE 'c.txt' END END), lambda n: regexp_matches(n, '(?i)\\.(jpe?g|jxl|webp|png|gif|bmp|tiff?|avif|svg)$') AND NOT starts_with(string_split(n, '/')[-1], '.') AND NOT regexp_matches(n, '(^|/)__MACOSX(/|$)'))) AS INTEGER) AS pages FROM documents""".replace("\\\\", "\\"))
def a05_page_count(t):
    names = F.array(F.concat(F.lit("p/"), "doc_id", F.lit(".JPG")), F.lit("__MACOSX/a.png"), F.lit("p/.hidden.png"), F.lit("info.xml"), F.lit("b.webp"), F.when(F.col("doc_id") % 2 == 0, F.lit("c.gif")).otherwise(F.lit("c.txt")))
    return t("documents").select("doc_id", F.size(F.filter(names, E.is_page)).alias("pages"))


@query("SELECT user_id, max(CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-01-01' ELSE ts END) AS modified FROM events GROUP BY user_id")
def a06_latest_time(t):
    return O.latest_times(t("events"), "user_id", "ts", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("event_type") == "error")


@query("SELECT coalesce(CAST(b AS VARCHAR), 'all') AS source, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in KINDS) + ", count(*) AS total FROM (SELECT *, user_id % 5 AS b FROM events) GROUP BY ROLLUP (b)")
def a07_outcome_counts(t):
    rows = t("events").withColumn("b", (F.col("user_id") % 5).cast("string"))
    return E.outcome_counts(rows, "b", "event_type", KINDS).withColumn("source", F.coalesce("b", F.lit("all"))).drop("b")


@query("SELECT count(*) FILTER (value > 20) AS parsed, count(*) FILTER (value <= 20 AND event_type <> 'error') AS short_circuited, count(*) FILTER (value <= 20 AND event_type = 'error') AS errored, count(*) AS total FROM events")
def a08_batch_totals(t):
    return O.batch_totals(t("events"), F.col("value") > 20, F.col("event_type") == "error")


@query("""SELECT event_type, band, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok) AS wrong, round(count(*) FILTER (ok) / count(*), 6) AS accuracy FROM (
SELECT event_type, event_id % 3 > 0 AS ok, CASE WHEN s >= 0.95 THEN '>=0.95' WHEN s >= 0.85 THEN '0.85-0.95' WHEN s >= 0.70 THEN '0.70-0.85' WHEN s >= 0.50 THEN '0.50-0.70' ELSE '<0.50' END AS band FROM (SELECT *, value / 100 AS s FROM events)) GROUP BY ALL""")
def a09_accuracy_report(t):
    rows = t("events").select("event_type", (F.col("value") / 100).alias("s"), (F.col("event_id") % 3 > 0).alias("ok"))
    return E.accuracy_report(rows, "event_type", "s", "ok")


@query("SELECT event_type, 'k' AS method, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS calls FROM events GROUP BY event_type")
def a10_sum_calls(t):
    return E.sum_calls(t("events"), ["event_type"], F.from_json("props", "map<string,bigint>"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a11_outcome_buckets(t):
    return O.bucket_counts(t("events"), F.col("event_type"))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def a12_representative(t):
    return M.first_by(t("orders"), ["o_custkey"], "o_orderkey", ["o_totalprice", "o_orderkey"]).withColumnRenamed("o_totalprice", "price")


@query("SELECT regexp_extract(url, '^([^0-9]*)', 1) AS prefix, min(page_id) AS page_id FROM pages GROUP BY 1")
def a13_first_of_prefix(t):
    return O.first_of_prefix(t("pages"), "url", "^([^0-9]*)", "page_id")


@query("SELECT CAST(year(o_orderdate) // 10 * 10 AS VARCHAR) || 's' AS decade, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def a14_bucket_counts(t):
    return O.bucket_counts(t("orders"), O.decade(F.col("o_orderdate")).alias("decade"), F.col("o_orderpriority"))


@query("SELECT o_orderstatus AS person, string_agg(DISTINCT r, '|' ORDER BY r) AS roles FROM (SELECT o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'Penciller' WHEN '2-HIGH' THEN 'Penciller' ELSE o_orderpriority END AS r FROM orders) GROUP BY o_orderstatus")
def a15_credits(t):
    role = F.when(F.col("o_orderpriority") == "1-URGENT", "penciler").when(F.col("o_orderpriority") == "2-HIGH", "Penciller").otherwise(F.col("o_orderpriority"))
    found = H.credits(t("orders").withColumn("role", role), "o_orderstatus", "role")
    return found.select("person", F.array_join("roles", "|").alias("roles"))


@query("SELECT DISTINCT o_orderstatus AS person, o_orderpriority AS role FROM orders")
def a16_credit_rows(t):
    return H.credit_rows(H.credits(t("orders"), "o_orderstatus", "o_orderpriority"))


@query("SELECT source, lower(lang) AS name, min(doc_id) AS doc_id FROM documents WHERE lower(lang) <> 'en' GROUP BY ALL")
def a18_alternative_names(t):
    return O.alternative_names(t("documents"), ["source"], "lang", F.lit("EN"), "doc_id")


@query("SELECT CAST(sum((r_regionkey + 1) * 300) AS BIGINT) AS requests, CAST(sum(ceil((r_regionkey + 1) * 300 * 60 / (20 - r_regionkey))) AS BIGINT) AS seconds FROM region")
def a21_run_estimate(t):
    rates = t("region").select((F.col("r_regionkey") + 1).alias("per_file"), (20 - F.col("r_regionkey")).alias("per_minute"))
    return E.run_estimate(rates, 300, merge=True)


@query("SELECT CAST(max((r_regionkey + 1) * 300) AS BIGINT) AS requests, CAST(max(ceil((r_regionkey + 1) * 300 * 60 / (20 - r_regionkey))) AS BIGINT) AS seconds FROM region")
def a21_run_estimate_first_wins(t):
    rates = t("region").select((F.col("r_regionkey") + 1).alias("per_file"), (20 - F.col("r_regionkey")).alias("per_minute"))
    return E.run_estimate(rates, 300, merge=False)


@query("""SELECT user_id, string_agg(event_type || '=' || d, ',' ORDER BY event_type) AS added FROM (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 1) - count(*) FILTER (event_id % 2 = 0) AS d FROM events GROUP BY ALL) WHERE d > 0 GROUP BY user_id""")
def a22_added_counts(t):
    n = t("events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 2 == 0).alias("a"), F.count_if(F.col("event_id") % 2 == 1).alias("b"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "a"))).alias("a"), F.map_from_entries(F.collect_list(F.struct("event_type", "b"))).alias("b"))
    added = maps.select("user_id", F.map_entries(E.added_counts(F.col("a"), F.col("b"))).alias("e")).where(F.size("e") > 0)
    return added.select("user_id", F.array_join(F.array_sort(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ",").alias("added"))


@query("""SELECT n_regionkey, string_agg(n_name || '=' || round(n_nationkey * 1.5, 2), ',' ORDER BY n_name || '=') AS prices FROM nation GROUP BY n_regionkey""")
def a23_prices(t):
    prices = t("nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.round(F.col("n_nationkey") * 1.5, 2).alias("price")))).alias("m"))
    return prices.select("n_regionkey", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("prices"))


@query(r"""SELECT count(*) FILTER (regexp_matches(l, '(?i)\bthe\b')) AS retries, count(*) FILTER (regexp_matches(l, '(?i)\band\b') AND NOT contains(l, 'thin')) AS warnings, count(*) FILTER (regexp_matches(l, '^[A-Z][a-z]+\.$')) AS errors, count(*) AS lines
FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)""")
def a24_log_counters(t):
    lines = t("documents").select(F.explode(F.split("text", "\n", -1)).alias("l"))
    return O.log_counters(lines, "l", r"(?i)\bthe\b", r"(?i)\band\b", "thin", r"^[A-Z][a-z]+\.$")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 5 * 1.05")
def a25_rate_compliance(t):
    return E.rate_failures(t("events"), "event_type", "ts", 5, "hour").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("SELECT page_id, CAST(row_number() OVER (ORDER BY lower(url), url, page_id) AS INTEGER) AS place FROM pages")
def s07_member_listing(t):
    """Places in the global order without regard to case."""
    return E.global_places(t("pages").select("page_id", F.lower("url").alias("k"), "url"), ["k", "url", "page_id"]).select("page_id", F.col("place").cast("int").alias("place"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, arg_min(url, (length(url) - length(replace(url, '/', '')), lower(url), url)) AS url FROM pages GROUP BY 1")
def s17_shallowest_member(t):
    return E.shallowest(t("pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), "url"), ["host"], "url")


@query("SELECT event_id, CASE WHEN ts > old THEN value END AS value FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS old FROM events)")
def s23_time_gate(t):
    events = t("events").withColumn("modified", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "path")
    gate = R.fresh_paths(events, events.groupBy("path").agg(F.min("modified").alias("old")))
    return gate.select("event_id", F.when(F.col("fresh"), F.col("value")).alias("value"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS fetched FROM events GROUP BY ALL")
def s25_keyed_upsert(t):
    return O.keyed_upsert(t("events"), ["user_id", "event_type"], ["ts", "event_id"], ["value", "ts"]).withColumnRenamed("ts", "fetched")


@query("""SELECT mode, event_id, value FROM events, (VALUES ('on'), ('off'), ('refresh')) m(mode) WHERE mode = 'on' AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY""")
def s24_response_cache(t):
    """The cache is as old as its latest response; switched off or refreshed it gives none."""
    events = t("events")
    latest = events.agg(F.max("ts").cast("timestamp").alias("now"))
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).join(F.broadcast(latest))  # one row
    parts = [O.cached_responses(rows, F.col("now"), ttl_seconds("7d"), mode, "at").select(F.lit(mode).alias("mode"), "event_id", "value") for mode in ("on", "off", "refresh")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT l_orderkey, array_to_string(list_slice(list(l_partkey ORDER BY l_linenumber, l_partkey), 2, 4), ',') AS pages FROM lineitem GROUP BY l_orderkey")
def k09_page_range(t):
    members = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    pages = E.page_slice(F.transform("m", lambda x: x["l_partkey"].cast("string")), 1, 3)
    return members.select("l_orderkey", F.array_join(pages, ",").alias("pages"))


@query("SELECT event_id, lower(event_type) || '|' || coalesce(CAST(CASE WHEN event_id % 3 > 0 THEN year(ts) END AS VARCHAR), '') || '|' || user_id % 3 AS fingerprint FROM events")
def m15_series_fingerprint(t):
    year = F.when(F.col("event_id") % 3 > 0, F.year("ts"))
    return t("events").select("event_id", O.series_fingerprint(F.col("event_type"), year, F.col("user_id") % 3).alias("fingerprint"))


@query("""SELECT o_custkey, string_agg(DISTINCT v, ',' ORDER BY v) AS fingerprint FROM (SELECT o_custkey, CAST(CASE WHEN o_custkey % 4 > 0 THEN o_orderkey % 7 ELSE o_orderkey END AS VARCHAR) AS v FROM orders) GROUP BY o_custkey""")
def m16_prompt_fingerprint(t):
    rows = t("orders").select("o_custkey", F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderkey") % 7).alias("volume"), "o_orderkey")
    return O.prompt_fingerprints(rows, ["o_custkey"], "volume", "o_orderkey")
