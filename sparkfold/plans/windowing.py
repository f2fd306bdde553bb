"""Queries of windows, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import online as O
from ..operators import shape as H
from .registry import query


@query("""SELECT l_orderkey, CAST(coalesce(min(l_linenumber * 100000 + l_partkey) FILTER (l_returnflag = 'R'), min(l_linenumber * 100000 + l_partkey)) AS BIGINT) AS cover FROM lineitem GROUP BY l_orderkey""")
def w06_cover(t):
    page = F.struct((F.col("l_linenumber") * 100000 + F.col("l_partkey")).cast("string").alias("name"), F.when(F.col("l_returnflag") == "R", F.lit("FrontCover")).otherwise(F.lit("Story")).alias("type"))
    pages = t("lineitem").select("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("n"), page.alias("page")).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "page"))), lambda x: x["page"]).alias("pages"))
    covers = E.cover_candidates(F.col("pages"), F.lit(None).cast("string"))
    return pages.select("l_orderkey", F.get(covers, F.lit(0)).cast("bigint").alias("cover"))


@query("""SELECT o_orderkey, turn FROM (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) AS INTEGER) AS turn, year(o_orderdate) AS y, o_orderpriority FROM orders) ORDER BY turn, y, o_orderpriority LIMIT 200""")
def w07_stratified_sample(t):
    rows = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), "o_orderpriority")
    return E.stratified(rows, ["y", "o_orderpriority"], "o_orderkey", 200).select("o_orderkey", "turn")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def w09_rolling_mean(t):
    return E.rolling_mean(t("events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("mean", 6).alias("mean"))


@query("SELECT p_type, string_agg(p_brand || ':' || p_size, ',' ORDER BY p_brand, p_size) AS parts FROM (SELECT DISTINCT p_type, p_brand, p_size FROM part) GROUP BY p_type")
def l03_multi_key_sort(t):
    size = F.lpad("p_size", 3, "0")
    distinct = t("part").select("p_type", "p_brand", "p_size").distinct()  # the list of a type holds no copies
    parts = distinct.groupBy("p_type").agg(H.sorted_list(F.collect_list(F.struct("p_brand", "p_size", size.alias("k"))), ("p_brand", "k")).alias("m"))
    return parts.select("p_type", F.array_join(F.transform("m", lambda x: F.concat(x["p_brand"], F.lit(":"), x["p_size"].cast("string"))), ",").alias("parts"))


@query("SELECT p_type, p_partkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 20")
def l04_cap_full(t):
    return E.keep_cap(t("part"), ["p_type"], [F.col("p_retailprice").desc(), F.col("p_partkey")], E.CAP_FULL).select("p_type", "p_partkey", "rank")


@query("SELECT p_type, p_partkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 5")
def l04_cap_minimal(t):
    return E.keep_cap(t("part"), ["p_type"], [F.col("p_retailprice").desc(), F.col("p_partkey")], E.CAP_MINIMAL).select("p_type", "p_partkey", "rank")


@query("SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CASE WHEN c_custkey % 10 = 0 THEN '~' ELSE lower(c_mktsegment) END, c_custkey) AS cluster FROM customer GROUP BY c_nationkey")
def l05_cluster_sort(t):
    series = F.when(F.col("c_custkey") % 10 > 0, F.col("c_mktsegment"))
    key = O.cluster_order(series, F.lit(None).cast("int"), F.col("c_custkey"))
    rows = t("customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(key)).alias("m"))
    return rows.select("c_nationkey", F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",").alias("cluster"))


@query("SELECT o_custkey, array_to_string(list_slice(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_totalprice DESC, o_orderkey), 1, 3), ',') AS top FROM orders GROUP BY o_custkey")
def l06_top_three(t):
    kept = E.keep_cap(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    rows = kept.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))).alias("m"))
    return rows.select("o_custkey", F.array_join(F.transform("m", lambda x: x["o_orderkey"].cast("string")), ",").alias("top"))
