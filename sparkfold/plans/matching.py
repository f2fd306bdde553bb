"""Queries of entity resolution: parts matched with other parts of their type and brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import match as M
from .registry import query

_PAIRS = """pairs AS (SELECT a.p_partkey AS profile, b.p_partkey AS issue, a.p_size AS y1, b.p_size AS y2, a.p_name AS n1, b.p_name AS n2, a.p_retailprice AS g1, b.p_retailprice AS g2, a.p_brand AS b1, b.p_brand AS b2,
CASE WHEN b.p_partkey % 4 > 0 THEN b.p_partkey % 50 END AS volume FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 2 AND a.p_partkey <> b.p_partkey),
signals AS (SELECT *, CASE WHEN n1 = n2 THEN 1.0 ELSE 0.0 END AS s_series,
CASE WHEN y1 = y2 THEN 1.0 ELSE 0.0 END AS s_issue, CASE abs(y1 - y2) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END AS s_year, 1.0 AS s_publisher,
CASE WHEN g1 = g2 THEN 1.0 WHEN abs(g1 - g2) / g1 <= 0.10 THEN 0.7 WHEN abs(g1 - g2) / g1 <= 0.25 THEN 0.3 ELSE 0.0 END AS s_pages FROM pairs),
scored AS (SELECT *, round(CAST(0.30 * s_series + 0.25 * s_issue + 0.10 * s_year + 0.10 * s_publisher + 0.05 * s_pages AS DOUBLE) / 0.80, 9) AS metadata, CASE WHEN issue % 3 = 0 THEN CAST(issue % 100 AS DOUBLE) / 100 END AS cover FROM signals),
ranked AS (SELECT *, row_number() OVER w AS place, coalesce(round(metadata - lead(metadata) OVER w, 9), 1.0) AS gap, count(*) FILTER (metadata >= 0.5) OVER (PARTITION BY profile) AS viable FROM scored
WINDOW w AS (PARTITION BY profile ORDER BY metadata DESC, volume NULLS LAST, issue))"""



def _common(a: str, b: str) -> str:
    """SQL of the length of the longest common subsequence: a row of the usual table for each character of ``a``."""
    return f"""list_max(list_reduce(list_transform(string_split({a}, ''), lambda c: [ord(c)]), lambda row, c: list_transform(range(0, length({b}) + 1), lambda j: list_max(list_transform(range(0, j + 1),
lambda k: greatest(row[k + 1], CASE WHEN k > 0 AND ord({b}[k]) = c[1] THEN row[k] + 1 ELSE 0 END)))), list_transform(range(0, length({b}) + 1), lambda j: 0)))"""


def _pairs(t):
    part = t("part")
    profiles = part.select(F.col("p_partkey").alias("profile"), "p_type", "p_brand", "p_size", F.col("p_name").alias("n1"), F.col("p_retailprice").alias("g1"), T.normalize_publisher(F.col("p_brand")).alias("u1"))
    candidates = part.select(F.col("p_partkey").alias("issue"), "p_type", "p_brand", "p_size", F.col("p_name").alias("n2"), F.col("p_retailprice").alias("g2"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey") % 50).alias("volume"), T.issue_int(F.col("p_size").cast("string")).alias("i2"), T.normalize_publisher(F.col("p_brand")).alias("u2"))
    return M.block_pairs(profiles, candidates, ["p_type", "p_brand"], "p_size", 2).where("profile <> issue").withColumnsRenamed({"p_size": "y1", "c_p_size": "y2"})


def _scored(t):
    pairs = _pairs(t)
    issue = M.issue_signal(F.col("y1"), F.col("y1").cast("string"), F.col("y2").cast("string"), F.col("i2"))
    has = F.lit(True)
    signals = {
        "series": (has, F.when(F.col("n1") == F.col("n2"), 1.0).otherwise(0.0)),
        "issue": (has, issue),
        "year": (F.col("y1").isNotNull() | F.col("y2").isNotNull(), M.year_signal(F.col("y1"), F.col("y2"))),
        "publisher": (has, M.publisher_signal(F.col("p_brand"), F.col("p_brand"), (F.col("u1"), F.col("u2")))),
        "pages": (has, M.pages_signal(F.col("g1"), F.col("g2"))),
    }
    cover = F.when(F.col("issue") % 3 == 0, (F.col("issue") % 100).cast("double") / 100)
    return pairs.withColumn("metadata", F.round(M.metadata_score(signals), 9)).withColumn("cover", cover)


def _best(t):
    return M.best(_scored(t), "profile", "metadata", "volume", "issue", 0.5).withColumn("gap", F.round("gap", 9))


def _ranked(t):
    ranked = M.rank(_scored(t), "profile", "metadata", "volume", "issue").withColumn("gap", F.round("gap", 9))
    return M.viable(ranked, "profile", "metadata", 0.5)


@query(f"WITH {_PAIRS} SELECT profile, issue, y1, y2 FROM pairs")
def j02_blocked_candidates(t):
    return _pairs(t).select("profile", "issue", "y1", "y2")


@query(f"WITH {_PAIRS} SELECT profile, issue, CAST(s_issue AS DOUBLE) AS s_issue, CAST(s_year AS DOUBLE) AS s_year, CAST(s_pages AS DOUBLE) AS s_pages FROM signals")
def m03_m06_signals(t):
    p = _pairs(t)
    issue = M.issue_signal(F.col("y1"), F.col("y1").cast("string"), F.col("y2").cast("string"), F.col("i2"))
    return p.select("profile", "issue", issue.alias("s_issue"), M.year_signal(F.col("y1"), F.col("y2")).alias("s_year"), M.pages_signal(F.col("g1"), F.col("g2")).alias("s_pages"))


@query("""SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN 0.5 WHEN a IS NULL OR b IS NULL THEN 0.3 ELSE round(CAST(CASE abs(a - b) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE greatest(0.0, (7 - abs(a - b)) * 0.4 / 5) END AS DOUBLE), 9) END AS score
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN year(o_orderdate) END AS a, CASE WHEN o_orderkey % 4 > 0 THEN 1990 + o_orderkey % 15 END AS b FROM orders)""")
def m04_year_signal(t):
    a, b = F.when(F.col("o_custkey") % 5 > 0, F.year("o_orderdate")), F.when(F.col("o_orderkey") % 4 > 0, 1990 + F.col("o_orderkey") % 15)
    return t("orders").select("o_orderkey", F.round(M.year_signal(a, b), 9).alias("score"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN 0.5 WHEN lower(p_brand) = lower('Brand#' || p_size) THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score FROM part""")
def m05_publisher_signal(t):
    other = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("BRAND "), "p_size", F.lit(" Comics")))
    return t("part").select("p_partkey", M.publisher_signal(F.col("p_brand"), other).alias("score"))


@query(f"WITH {_PAIRS} SELECT profile, issue, metadata FROM scored")
def m07_metadata_score(t):
    return _scored(t).select("profile", "issue", "metadata")


@query(f"WITH {_PAIRS} SELECT profile, issue, round(CASE WHEN cover IS NULL THEN metadata ELSE 0.80 * metadata + 0.20 * cover END, 6) AS score FROM scored")
def m08_final_score(t):
    return _scored(t).select("profile", "issue", F.round(M.final_score(F.col("metadata"), F.col("cover")), 6).alias("score"))


@query(f"WITH {_PAIRS} SELECT profile, issue, CAST(place AS INTEGER) AS place FROM ranked")
def w01_candidate_order(t):
    return _ranked(t).select("profile", "issue", "place")


@query(f"WITH {_PAIRS} SELECT profile, issue, gap, viable, viable = 1 AS solo FROM ranked WHERE place = 1")
def w03_w04_gap_and_viable(t):
    return _best(t).select("profile", "issue", "gap", "viable", "solo")


@query(f"WITH {_PAIRS} SELECT profile, issue FROM (SELECT *, count(*) OVER (PARTITION BY profile) AS n FROM ranked) WHERE place <= least(15, greatest(5, n // 2))")
def w05_adaptive_top_k(t):
    from pyspark.sql import Window

    counted = _ranked(t).withColumn("n", F.count("*").over(Window.partitionBy("profile")))
    return counted.where(F.col("place") <= M.hash_count(F.col("n"))).select("profile", "issue")


@query(f"WITH {_PAIRS} SELECT profile, metadata >= 0.5 AND NOT (metadata >= 0.95 AND gap >= 0.1) AS hashes FROM ranked WHERE place = 1")
def m09_needs_hash(t):
    return _best(t).select("profile", M.needs_hash(F.col("metadata"), F.col("gap"), M.Policy()).alias("hashes"))


_CLEAR, _ALONE = "metadata >= 0.95 AND gap >= 0.1", "viable = 1 AND metadata >= 0.85"


@query(f"WITH {_PAIRS} SELECT profile, false AS ask, {_CLEAR} AS careful, ({_CLEAR}) OR ({_ALONE}) AS auto, metadata >= 0.95 OR ({_ALONE}) AS eager FROM ranked WHERE place = 1")
def m11_policies(t):
    top = _best(t)
    return top.select("profile", *[M.auto_writes(F.col("metadata"), F.col("gap"), F.col("solo"), M.Policy(mode=m)).alias(m) for m in ("ask", "careful", "auto", "eager")])


@query(f"WITH {_PAIRS} SELECT p_partkey AS profile, CASE WHEN coalesce(metadata, 0) < 0.5 THEN 'NO_MATCH' WHEN ({_CLEAR}) OR ({_ALONE}) THEN 'AUTO_WRITE' ELSE 'PROMPT' END AS resolution FROM part LEFT JOIN ranked ON profile = p_partkey AND place = 1")
def m12_resolution(t):
    top = _best(t).select("profile", "metadata", "gap", "solo")
    all_profiles = t("part").select(F.col("p_partkey").alias("profile"))
    return all_profiles.join(top, "profile", "left").select("profile", M.resolve(F.col("metadata"), F.col("gap"), F.col("solo"), M.Policy()).alias("resolution"))


@query(f"""WITH RECURSIVE {_PAIRS}, final AS (SELECT profile, issue, volume, metadata, cover, round(CASE WHEN cover IS NULL THEN metadata ELSE 0.80 * metadata + 0.20 * cover END, 9) AS score FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, volume NULLS LAST, issue) AS place FROM final),
walk AS (SELECT profile, issue, volume, place, 0 AS run, metadata AS m, score AS s, cover AS c FROM placed WHERE place = 1
UNION ALL SELECT profile, issue, volume, place, CASE WHEN joins THEN run ELSE run + 1 END, CASE WHEN joins THEN m ELSE metadata END, CASE WHEN joins THEN s ELSE score END, CASE WHEN joins THEN c ELSE cover END FROM (
SELECT p.*, run, m, s, c, metadata = m AND round(s - score, 9) <= 0.02 AND (c IS NULL OR cover IS NULL OR abs(c - cover) <= 0.03) AS joins FROM walk JOIN placed p ON p.profile = walk.profile AND p.place = walk.place + 1))
SELECT profile, issue, CAST(place AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY profile ORDER BY run, volume NULLS LAST, issue) AS INTEGER) AS final_place FROM walk""")
def w02_tie_break(t):
    scored = _scored(t).withColumn("score", F.round(M.final_score(F.col("metadata"), F.col("cover")), 9))
    return M.tie_break(M.rank(scored, "profile", "score", "volume", "issue"), "profile")


@query(f"SELECT a.p_type, a.a, b.b, CAST(200 AS DOUBLE) * {_common('a', 'b')} / (length(a) + length(b)) / 100 AS score FROM (SELECT DISTINCT p_type, p_name AS a FROM part) a JOIN (SELECT DISTINCT p_type, p_brand AS b FROM part) b ON a.p_type = b.p_type")
def x15_ratio(t):
    names = t("part").select("p_type", "p_name").distinct()
    pairs = names.select("p_type", F.col("p_name").alias("a")).join(t("part").select("p_type", F.col("p_brand").alias("b")).distinct(), "p_type")
    return S.with_similarity(pairs, "a", "b", "score", S.ratio_udf)


@query(f"""WITH {_PAIRS}, names AS (SELECT DISTINCT n1, n2, greatest(length(n1), length(n2)) / least(length(n1), length(n2)) AS longer, string_split(n1, ' ') AS t1, string_split(n2, ' ') AS t2 FROM pairs),
sets AS (SELECT *, array_to_string(list_sort(list_distinct(list_intersect(t1, t2))), ' ') AS shared, array_to_string(list_sort(list_distinct(list_filter(t1, lambda w: NOT list_contains(t2, w)))), ' ') AS only1,
array_to_string(list_sort(list_distinct(list_filter(t2, lambda w: NOT list_contains(t1, w)))), ' ') AS only2 FROM names),
texts AS (SELECT *, trim(shared || ' ' || only1) AS one, trim(shared || ' ' || only2) AS two, CASE WHEN longer < 1.5 THEN 1.0 WHEN longer < 8 THEN 0.9 ELSE 0.6 END AS scale FROM sets),
forms AS (SELECT n1, n2, n1 AS x, n2 AS y, false AS parts, 1.0 AS weight FROM texts UNION ALL SELECT n1, n2, n1, n2, true, scale FROM texts WHERE longer >= 1.5
UNION ALL SELECT n1, n2, array_to_string(list_sort(t1), ' '), array_to_string(list_sort(t2), ' '), longer >= 1.5, 0.95 * scale FROM texts UNION ALL SELECT n1, n2, one, two, longer >= 1.5, 0.95 * scale FROM texts
UNION ALL SELECT n1, n2, shared, one, longer >= 1.5, 0.95 * scale FROM texts WHERE shared <> '' UNION ALL SELECT n1, n2, shared, two, longer >= 1.5, 0.95 * scale FROM texts WHERE shared <> ''),
sides AS (SELECT *, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS short, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS long FROM forms),
windows AS (SELECT n1, n2, weight, x AS a, y AS b FROM sides WHERE NOT parts UNION ALL SELECT n1, n2, weight, short, substr(long, greatest(0, i) + 1, i + length(short) - greatest(0, i)) FROM (
SELECT *, unnest(range(1 - length(short), length(long))) AS i FROM sides WHERE parts)),
compared AS (SELECT a, b, 2.0 * {_common('a', 'b')} / (length(a) + length(b)) AS r FROM (SELECT DISTINCT a, b FROM windows)),
best AS (SELECT n1, n2, max(CAST(weight AS DOUBLE) * r) AS s FROM windows JOIN compared USING (a, b) GROUP BY n1, n2) SELECT profile, issue, round(s, 9) AS s_series FROM pairs JOIN best USING (n1, n2)""")
def m02_series_signal(t):
    """Weighted name similarity of each blocked pair, from distinct pairs of names."""
    return S.with_similarity(_pairs(t).select("profile", "issue", "n1", "n2"), "n1", "n2", "s_series").select("profile", "issue", F.round("s_series", 9).alias("s_series"))


@query(f"""WITH {_PAIRS}, names AS (SELECT DISTINCT n1, n2 FROM pairs), alike AS (SELECT n1, n2 FROM names WHERE 2.0 * {_common('n1', 'n2')} / (length(n1) + length(n2)) >= {M.NAME_FILTER["balanced"]})
SELECT profile, issue FROM pairs JOIN alike USING (n1, n2)""")
def p12_name_filter(t):
    scored = S.with_similarity(_pairs(t).select("profile", "issue", "n1", "n2"), "n1", "n2", "s", S.ratio_udf)
    return M.keep_by_name(scored, "s", "balanced", "n2").select("profile", "issue")


@query(f"WITH {_PAIRS}, tiers AS (SELECT profile, issue, CASE WHEN y1 = y2 THEN 0 ELSE 1 END AS tier FROM pairs) SELECT profile, issue, tier FROM (SELECT *, min(tier) OVER (PARTITION BY profile) AS least FROM tiers) WHERE tier = least")
def p14_year_cascade(t):
    tiers = _pairs(t).select("profile", "issue", F.when(F.col("y1") == F.col("y2"), 0).otherwise(1).alias("tier"))
    return M.least_tier(tiers, "profile", "tier")


@query(f"WITH {_PAIRS} SELECT profile, issue FROM pairs WHERE y2 BETWEEN y1 - 1 AND y1 + 1 UNION ALL SELECT profile, issue FROM pairs WHERE profile NOT IN (SELECT profile FROM pairs WHERE y2 BETWEEN y1 - 1 AND y1 + 1)")
def p13_date_window_retry(t):
    tiers = _pairs(t).select("profile", "issue", F.when(F.abs(F.col("y2") - F.col("y1")) <= 1, 0).otherwise(1).alias("tier"))
    return M.least_tier(tiers, "profile", "tier").drop("tier")


@query("SELECT o_custkey, CASE WHEN o_custkey % 7 > 0 AND ((o_custkey % 2 = 0 AND n >= 50) OR (o_custkey % 3 > 0 AND n >= 200)) THEN 'minimal' ELSE 'balanced' END AS effort FROM (SELECT o_custkey, count(*) * 10 AS n FROM orders GROUP BY o_custkey)")
def m19_effort(t):
    n = t("orders").groupBy("o_custkey").agg((F.count("*") * 10).alias("n"))
    k = F.col("o_custkey")
    return n.select("o_custkey", M.effort_for(F.col("n"), k % 2 == 0, k % 3 == 0, k % 7 == 0).alias("effort"))
