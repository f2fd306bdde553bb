"""Queries of the merge engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merge as M
from ..operators import shape as H
from .registry import query


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type")
def a01_precedence_fold(t):
    return M.fold_last(t("events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query("""SELECT user_id, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS kinds, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counter
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id""")
def a02_additive_merge(t):
    """Counters of the even and the odd events, as maps, merged by adding."""
    events = t("events")

    def counter(part):
        return events.where(F.col("event_id") % 2 == part).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias(f"c{part}"))

    both = counter(0).join(counter(1), "user_id", "full_outer").select("user_id", M.add_counters(F.col("c0"), F.col("c1")).alias("c"))
    entries = F.array_sort(F.transform(F.map_entries("c"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    total = F.aggregate(F.map_values("c"), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return both.select("user_id", total.alias("total"), F.size("c").cast("bigint").alias("kinds"), F.array_join(entries, ",").alias("counter"))


_HALVES = """a AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
b AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_id % 2 = 1 AND event_id % 3 > 0 GROUP BY ALL)"""


def _halves(t):
    events = t("events")
    even = events.where("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"), F.count("*").alias("n"))
    odd = events.where("event_id % 2 = 1 AND event_id % 3 > 0").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return even, odd


@query(f"WITH {_HALVES} SELECT user_id, event_type, n, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (user_id, event_type)")
def a03_replace_merge(t):
    even, odd = _halves(t)
    return M.merge_records(even, odd, ["user_id", "event_type"], M.REPLACE)


@query(f"WITH {_HALVES} SELECT user_id, event_type, n, coalesce(b.v, a.v) AS v FROM a LEFT JOIN b USING (user_id, event_type)")
def a04_update_merge(t):
    even, odd = _halves(t)
    return M.merge_records(even, odd, ["user_id", "event_type"], M.UPDATE)


@query("""WITH a AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
b AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || coalesce(b.v, a.v), ',' ORDER BY event_type) AS merged FROM a FULL JOIN b USING (user_id, event_type) GROUP BY user_id""")
def j01_map_overlay(t):
    events = t("events")

    def side(part):
        last = events.where(F.col("event_id") % 2 == part).groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).cast("string").alias("v"))
        return last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias(f"m{part}"))

    merged = M.overlay_maps(F.col("m0"), F.col("m1"))
    entries = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return side(0).join(side(1), "user_id", "full_outer").select("user_id", F.array_join(entries, ",").alias("merged"))


@query("SELECT l.doc_id, coalesce(n.quality, l.quality) AS quality, l.toxic FROM labels l LEFT JOIN (SELECT doc_id, 1 - quality AS quality FROM labels WHERE doc_id % 3 = 0) n USING (doc_id)")
def j13_upsert(t):
    labels = t("labels")
    return M.upsert(labels, labels.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality")), ["doc_id"]).select("doc_id", "quality", "toxic")


@query("""SELECT p_partkey, coalesce(x.k, 'url' || p_size) AS key, coalesce(nullif(p_brand, 'Brand#1'), 'made' || p_partkey) AS url
FROM part LEFT JOIN (SELECT l_partkey, max(l_returnflag) AS k FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey) x ON l_partkey = p_partkey""")
def j16_identifier_precedence(t):
    explicit = t("lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_returnflag").alias("k"))
    found = M.identifiers_of(F.col("k"), F.concat(F.lit("url"), F.col("p_size").cast("string")), F.nullif("p_brand", F.lit("Brand#1")), F.concat(F.lit("made"), F.col("p_partkey").cast("string")))
    return t("part").join(explicit, "p_partkey", "left").select("p_partkey", found["key"].alias("key"), found["url"].alias("url"))


@query("""SELECT source, min(doc_id) AS place, arg_max(lang, doc_id) AS lang, max(doc_id) AS value FROM documents GROUP BY source, lower(lang)""")
def a19_fold_case(t):
    docs = t("documents").select("source", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("spelled"), F.col("doc_id").alias("value"))
    return M.fold_case(docs, ["source"], "spelled", "value", "doc_id").select("source", "place", F.lower("spelled").alias("lang"), "value")


@query("SELECT source, lang, min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang")
def a17_first_name_wins(t):
    return M.first_by(t("documents"), ["source", "lang"], "doc_id", ["doc_id", "n_chars"])


@query("""SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS kinds
FROM (SELECT user_id, list(DISTINCT event_type) FILTER (event_id % 2 = 0) AS a, list(DISTINCT event_type) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY user_id)""")
def u01_set_union(t):
    sets = t("events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    return sets.select("user_id", F.array_join(F.array_sort(M.union_sets(F.col("a"), F.col("b"))), ",").alias("kinds"))


@query("""SELECT user_id, len(list_intersect(a, b)) > 0 AS overlaps FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 0), []) AS a, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 1), []) AS b FROM events GROUP BY user_id)""")
def u02_set_overlap(t):
    sets = t("events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    return sets.select("user_id", H.share_any(F.col("a"), F.col("b")).alias("overlaps"))


@query("""SELECT user_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, array_to_string(list_sort(list_intersect(a, b)), ',') AS kinds FROM (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 0), []) AS a, coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 1), []) AS b FROM events GROUP BY user_id)""")
def u03_set_intersection(t):
    sets = t("events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    both = F.array_intersect("a", "b")
    return sets.select("user_id", F.size(both).alias("shared"), F.array_join(F.array_sort(both), ",").alias("kinds"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def u07_ordered_distinct(t):
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    return turns.select("conv_id", F.array_join(H.distinct_in_order(F.transform("turns", lambda x: x["role"])), ",").alias("roles"))
