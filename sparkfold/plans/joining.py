"""Queries of lookups and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..operators import lookup as L
from ..operators import merge as M
from ..operators import online as O
from ..operators import records as R
from .registry import query


@query("SELECT l_orderkey, l_linenumber, CASE lower(l_returnflag) WHEN 'a' THEN 'Accepted' WHEN 'r' THEN 'Returned' END AS label FROM lineitem")
def j03_alias_lookup(t):
    lines = t("lineitem")
    dimension = lines.sparkSession.createDataFrame([("a", "Accepted"), ("r", "Returned")], "alias string, canonical string")
    return L.alias_lookup(lines, "l_returnflag", dimension, "label").select("l_orderkey", "l_linenumber", "label")


@query("SELECT page_id, CASE WHEN h LIKE '%.example.org' THEN 'isbn' WHEN h LIKE '%.example.net' THEN 'gtin' ELSE h END AS source FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)")
def j04_source_of_host(t):
    return t("pages").select("page_id", I.source_of_host(I.host_of(F.col("url")), (("example.org", "isbn"), ("example.net", "gtin"))).alias("source"))


@query("""WITH roles(a, c) AS (VALUES ('1-urgent', 'Writer'), ('1-urgent', 'Artist'), ('2-high', 'Artist'), ('3-medium', 'Inker'))
SELECT o_orderstatus AS person, string_agg(DISTINCT c, ',' ORDER BY c) AS roles FROM orders JOIN roles ON a = lower(o_orderpriority) GROUP BY o_orderstatus""")
def j05_role_expansion(t):
    orders = t("orders")
    dimension = orders.sparkSession.createDataFrame([("1-URGENT", "Writer"), ("1-URGENT", "Artist"), ("2-HIGH", "Artist"), ("3-MEDIUM", "Inker")], "alias string, canonical string")
    rows = L.expand(orders.select(F.col("o_orderstatus").alias("person"), "o_orderpriority"), "o_orderpriority", dimension, "role")
    return rows.groupBy("person").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query("SELECT e.event_id, e.ts > coalesce(o.old, TIMESTAMP '1970-01-01') AS fresh FROM events e LEFT JOIN (SELECT user_id, min(ts) AS old FROM events WHERE user_id % 3 > 0 GROUP BY user_id) o USING (user_id)")
def j06_old_time_default(t):
    events = t("events").select("event_id", F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("modified"))
    return R.fresh_paths(events, events.where("path % 3 > 0").groupBy("path").agg(F.min("modified").alias("old"))).select("event_id", "fresh")


@query("""WITH a AS (SELECT p_partkey FROM part WHERE p_size < 20), b AS (SELECT p_partkey FROM part WHERE p_size BETWEEN 15 AND 30)
SELECT p_partkey, 0 AS tier FROM a UNION ALL SELECT p_partkey, 1 AS tier FROM b WHERE p_partkey NOT IN (SELECT p_partkey FROM a)""")
def j07_union_without(t):
    part = t("part")
    return L.union_without(part.where("p_size < 20").select("p_partkey"), part.where("p_size BETWEEN 15 AND 30").select("p_partkey"), ["p_partkey"])


@query("""WITH f AS (SELECT *, lower(o_orderstatus) || '|' || year(o_orderdate) || '|' || lower(o_orderpriority) AS fp, o_orderkey % 5 AS number FROM orders), c AS (SELECT fp, arg_min(o_custkey % 10, o_orderkey) AS volume_id FROM f GROUP BY fp)
SELECT o_orderkey, volume_id, issue_id FROM f JOIN c USING (fp) JOIN (SELECT volume_id AS v, number, volume_id * 100 + number AS issue_id FROM (SELECT DISTINCT o_custkey % 10 AS volume_id FROM orders), (SELECT DISTINCT o_orderkey % 5 AS number FROM orders) WHERE number <> 3) k ON k.v = volume_id AND k.number = f.number""")
def j08_series_cache(t):
    orders = t("orders")
    people = orders.select("o_orderkey", O.series_fingerprint(F.col("o_orderstatus"), F.year("o_orderdate"), F.col("o_orderpriority")).alias("fingerprint"), (F.col("o_orderkey") % 5).alias("issue"), (F.col("o_custkey") % 10).alias("volume_id"))
    volumes, numbers = people.select("volume_id").distinct(), people.where("issue <> 3").select("issue").distinct()
    catalog = volumes.join(F.broadcast(numbers)).withColumn("issue_id", F.col("volume_id") * 100 + F.col("issue"))  # ten volumes of four issues
    cache = O.first_volumes(people, "fingerprint", "volume_id", "o_orderkey")
    return O.through_series_cache(people.drop("volume_id"), cache, catalog).select("o_orderkey", "volume_id", "issue_id")


@query("""SELECT l_orderkey, arg_min(CAST(l_suppkey AS BIGINT), (l_linenumber, l_suppkey)) AS id FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY l_orderkey""")
def j09_stored_identifier(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise(F.concat(F.lit("x"), "l_suppkey")).alias("text"), F.struct("l_linenumber", "l_suppkey").alias("rank"))
    return L.stored_identifier(rows, ["l_orderkey"], "text", "rank")


@query("""SELECT o_custkey, string_agg(series || ':' || language, ',' ORDER BY first) AS entries FROM (SELECT o_custkey, min(o_orderkey) AS first, CASE WHEN min(o_orderkey) % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS series,
coalesce(max(CASE WHEN o_orderkey % 3 = 0 THEN 'x' END), '') AS language FROM orders GROUP BY o_custkey, o_orderpriority) GROUP BY o_custkey""")
def j10_consolidation(t):
    """Entries that contradict each other in nothing but case, or lack what the other has, are one."""
    entry = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("series"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("x")).alias("language"))
    rows = t("orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", entry.alias("e")))).alias("m"))
    folded = L.consolidate(F.transform("m", lambda x: x["e"]), ["series", "language"])
    return rows.select("o_custkey", F.array_join(F.transform(folded, lambda e: F.concat_ws(":", e["series"], F.coalesce(e["language"], F.lit("")))), ",").alias("entries"))


@query("""SELECT change, count(*) AS n FROM (SELECT CASE WHEN toxic > quality THEN 'WIN' WHEN toxic < quality THEN 'REGRESS' ELSE 'NEUTRAL' END AS change FROM labels) GROUP BY change""")
def j11_compare_runs(t):
    labels = t("labels")
    changes = L.compare_runs(labels.select("doc_id", F.col("quality").alias("ok")), labels.select("doc_id", F.col("toxic").alias("ok")), ["doc_id"], "ok")
    return changes.groupBy("change").agg(F.count("*").alias("n"))


@query("""SELECT b.doc_id, CASE WHEN b.v IS NOT DISTINCT FROM a.v THEN 'same' WHEN a.v IS NULL THEN 'lost' WHEN b.v IS NULL THEN 'gained' ELSE 'changed' END AS change
FROM (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN quality END AS v FROM labels) b LEFT JOIN (SELECT doc_id, toxic AS v FROM labels WHERE doc_id % 5 > 0) a USING (doc_id)""")
def j12_outcome_difference(t):
    labels = t("labels")
    before = labels.select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("quality")).alias("v"))
    return L.outcome_difference(before, labels.where("doc_id % 5 > 0").select("doc_id", F.col("toxic").alias("v")), ["doc_id"], "v")


@query("""WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS n FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS n FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, CAST(u.i AS INTEGER) AS place, CAST(u.n AS INTEGER) AS question, CAST(a.n AS INTEGER) AS answer FROM u LEFT JOIN a USING (conv_id, i)""")
def j14_zip_outer(t):
    turns = t("conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", F.length("text").alias("n"))))).alias("u"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.length("text").alias("n"))))).alias("a"),
    )
    pairs = L.zip_outer(F.transform("u", lambda x: x["n"]), F.transform("a", lambda x: x["n"]))
    return turns.select("conv_id", F.posexplode(pairs).alias("place", "p")).select("conv_id", "place", F.col("p.name").alias("question"), F.col("p.number").alias("answer"))


@query("SELECT s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> n_regionkey")
def j15_disagreement(t):
    nation = L.small(t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"))
    return O.disagreements(t("supplier").withColumn("ours", F.col("s_suppkey") % 5), nation, "s_nationkey", "ours", "n_regionkey").select("s_suppkey", "n_regionkey")


@query("SELECT doc_id, 'miss' AS part FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT doc_id, 'todo' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j17_misses_and_todo(t):
    docs, labels = t("documents").select("doc_id"), t("labels")
    return O.misses(docs, labels, "doc_id", F.col("quality") == 0).withColumn("part", F.lit("miss")).unionByName(O.still_to_do(docs, labels, "doc_id").withColumn("part", F.lit("todo")))


@query("""SELECT o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b USING (o_custkey)
WHERE (b.o_orderdate > a.o_orderdate OR (b.o_orderdate = a.o_orderdate AND b.o_orderkey > a.o_orderkey)) AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY""")
def j18_overlapping_intervals(t):
    orders = t("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("end"))
    return L.overlapping(orders, ["o_custkey"], "o_orderkey", "start", "end", 30 * 86400.0)


@query("""SELECT d.doc_id, coalesce(l.quality, f.q) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT source, arg_min(quality, doc_id) AS q FROM documents JOIN labels USING (doc_id) GROUP BY source) f ON f.source = d.source""")
def j19_backfill(t):
    rows = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return L.backfill(rows, rows, "source", "quality", "doc_id").select("doc_id", "quality")


@query("SELECT event_id, coalesce(max(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS decided FROM events")
def w10_decided(t):
    return L.first_winner(t("events").withColumn("won", F.col("value") > 50), ["user_id"], "event_id", "won").select("event_id", "decided")


@query("SELECT user_id, count(*) AS asked FROM (SELECT user_id, coalesce(max(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM events) WHERE d = 0 GROUP BY user_id")
def p15_first_wins(t):
    rows = L.first_winner(t("events").withColumn("won", F.col("value") > 50), ["user_id"], "event_id", "won")
    return rows.where(~F.col("decided")).groupBy("user_id").agg(F.count("*").alias("asked"))


@query("SELECT o_custkey, min(o_orderkey) AS volume, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey")
def w08_first_writer_wins(t):
    return M.first_by(t("orders"), ["o_custkey"], "o_orderkey", ["o_orderkey", "o_orderpriority"]).select("o_custkey", F.col("o_orderkey").alias("volume"), F.col("o_orderpriority").alias("priority"))


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id + 5 FROM labels) UNION ALL SELECT doc_id + 5, 'right' FROM labels WHERE doc_id + 5 NOT IN (SELECT doc_id FROM documents)")
def u04_key_difference(t):
    return O.key_differences(t("documents"), t("labels").withColumn("doc_id", F.col("doc_id") + 5), "doc_id")


@query("WITH a AS (SELECT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id, event_type FROM events WHERE event_id % 3 = 0) SELECT * FROM a UNION SELECT * FROM b")
def u05_discovery_union(t):
    events = t("events").select("user_id", "event_type", "event_id")
    return L.union_without(events.where("event_id % 2 = 0").select("user_id", "event_type").distinct(), events.where("event_id % 3 = 0").select("user_id", "event_type").distinct(), ["user_id", "event_type"]).drop("tier")
