"""Queries of writers, projections, lists, catalogs, settings and extension points; small ones hold literal values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import config
from ..functions import similarity as S
from ..functions.shared import shared_folder
from ..operators import derive as R
from ..operators import match as M
from ..operators import merge as G
from ..operators import online as O
from ..operators import records as E
from ..operators import resolve as V
from ..operators import shape as H
from ..operators import validate as C
from ..operators.code_sources import CodeSource, search
from ..operators.fold import Merger, fold
from ..sources import documents as D
from ..sources import writers as W
from .registry import query


def _native(t):
    """A record for each part: series, issue, pages, a writer, tags, identifiers."""
    page = lambda k, kind: f"'{k}', named_struct('page_type', '{kind}', 'size', 5L)"
    body = F.struct(
        F.struct(F.col("p_name").alias("name")).alias("series"), F.struct(F.col("p_size").cast("string").alias("name")).alias("issue"), F.lit("T").alias("title"), F.lit("me").alias("tagger"), F.lit("scan").alias("scan_info"),
        F.expr(f"map({page(0, 'FrontCover')}, {page(11, 'Story')})").alias("pages"), F.create_map(F.lit("Ann"), F.struct(F.create_map(F.lit("Writer"), F.struct(F.lit(None).cast("string").alias("x"))).alias("roles"))).alias("credits"),
        F.create_map(F.col("p_type"), F.struct(F.lit(None).cast("string").alias("x"))).alias("tags"), F.create_map(F.lit("comicvine"), F.struct(F.col("p_partkey").cast("string").alias("key"))).alias("identifiers"),
        F.create_map(F.lit("US"), F.lit("1.50").cast("decimal(12,2)")).alias("prices"), F.struct(F.lit(3).alias("number"), F.lit(5).alias("number_to")).alias("volume"),
    )
    return t("part").select("p_partkey", D.native_json(F.to_json(F.struct(body.alias(D.NATIVE_ROOT)))).alias("record"))


# formats ------------------------------------------------------------------


@query("SELECT p_partkey, p_name AS series, p_size AS pages, contains(p_name, ' ') AS spaced FROM part")
def f03_yaml_documents(t):
    """YAML is read, written and read again."""
    payload = F.concat(F.lit(f"{D.NATIVE_ROOT}:\n  series:\n    name: "), "p_name", F.lit("\n  page_count: "), "p_size")
    r = t("part").select("p_partkey", D.native_yaml(payload).alias("r")).select("p_partkey", D.native_yaml(W.to_native_yaml(F.col("r"))).alias("r"))
    return r.select("p_partkey", F.col("r.series.name").alias("series"), F.col("r.page_count").alias("pages"), F.contains("r.series.name", F.lit(" ")).alias("spaced"))


@query("SELECT p_partkey, p_name AS series, p_type AS tag, true AS one_line FROM part")
def f04_e02_one_line_documents(t):
    """The one-line form is one line and reads as what was written."""
    text = _native(t).select("p_partkey", W.to_native_line(F.col("record")).alias("text"))
    r = text.select("p_partkey", D.READERS["native_line"](F.col("text")).alias("r"), (~F.contains("text", F.lit("\n"))).alias("one_line"))
    return r.select("p_partkey", F.col("r.series.name").alias("series"), F.get(F.map_keys("r.tags"), F.lit(0)).alias("tag"), "one_line")


@query("SELECT p_partkey, '00,11' AS keys FROM part")
def f10_page_keys(t):
    """Page numbers in JSON have the width of the greatest one, and stand in order."""
    text = _native(t).select("p_partkey", D.to_native_json(F.col("record")).alias("text"))
    return text.select("p_partkey", F.array_join(F.map_keys(F.from_json("text", f"{D.NATIVE_ROOT} struct<pages:map<string,string>>")[D.NATIVE_ROOT]["pages"]), ",").alias("keys"))


@query("SELECT * FROM (VALUES ('config', 1), ('archive_filename', 2), ('archive_comment', 3), ('archive_file', 4), ('import_file', 5), ('cli', 6), ('api', 7)) v(source, place)")
def f11_e05_sources_in_order(t):
    """Sources in order of precedence, from the ranks of one format."""
    rows = t("region").sparkSession.createDataFrame([(s,) for s in D.SOURCES if s not in ("archive_pdf", "metron_api", "comicvine_api", "archive_pages")], "source string")
    ranked = rows.select("source", D.merge_rank(F.col("source"), F.lit("comic_info")).alias("rank"))
    return ranked.select("source", F.size(F.filter(F.array(*[D.merge_rank(F.lit(s), F.lit("comic_info")) for s in D.SOURCES if s not in ("archive_pdf", "metron_api", "comicvine_api", "archive_pages")]), lambda r: r <= F.col("rank"))).alias("place"))


@query("SELECT p_partkey, f AS fmt, p_name AS series, CAST(p_partkey AS VARCHAR) AS key FROM part, (VALUES ('metron_info'), ('comic_info')) v(f)")
def x41_written_and_read_again(t):
    """MetronInfo and ComicInfo: the series and the identifier of the primary source survive."""
    out = None
    for fmt in ("metron_info", "comic_info"):
        again = _native(t).select("p_partkey", D.READERS[fmt](D.WRITERS[fmt](F.col("record"))).alias("r"))
        one = again.select("p_partkey", F.lit(fmt).alias("fmt"), F.col("r.series.name").alias("series"), F.col("r.identifiers")["comicvine"]["key"].alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey, f AS fmt, 'Ann' AS writers, p_type AS tags, 'me' AS tagger FROM part, (VALUES ('mupdf'), ('pdf_xml')) v(f)")
def x42_pdf_information(t):
    """Document information of PDFs, as JSON and as XMP: authors are writers, keywords are tags."""
    out = None
    for fmt in ("mupdf", "pdf_xml"):
        again = _native(t).select("p_partkey", D.READERS[fmt](D.WRITERS[fmt](F.col("record"))).alias("r"))
        one = again.select("p_partkey", F.lit(fmt).alias("fmt"), F.get(F.map_keys("r.credits"), F.lit(0)).alias("writers"), F.get(F.map_keys("r.tags"), F.lit(0)).alias("tags"), F.col("r.tagger").alias("tagger"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_partkey, CAST(2 AS INTEGER) AS pages, 'FrontCover' AS first, CAST(NULL AS INTEGER) AS bookmark FROM part")
def x40_page_attributes(t):
    r = _native(t)
    pages = H.page_attributes(F.col("record.pages"), D.PAGE_ATTRIBUTES)
    return r.select("p_partkey", F.size(pages).alias("pages"), F.get(pages, F.lit(0))["_Type"].alias("first"), H.bookmark(F.col("record.pages")).alias("bookmark"))


@query("SELECT p_partkey, p_name AS series, CASE WHEN p_size % 2 = 0 THEN '2' END AS volume, CAST(p_size AS VARCHAR) AS issue, p_name || CASE WHEN p_size % 2 = 0 THEN ' v2' ELSE '' END || ' #' || p_size AS text FROM part")
def x38_reprints(t):
    text = F.concat(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.lit(" v2")).otherwise(F.lit("")), F.lit(" #"), F.col("p_size"))
    found = H.reprint_from_text(text)
    return t("part").select("p_partkey", found["series"].alias("series"), found["volume"].alias("volume"), found["issue"].alias("issue"), H.reprint_text(found).alias("text"))


# projections, lists -----------------------------------------------------------


@query("SELECT o_orderkey, lower(o_orderstatus) AS status, o_orderpriority || '/' || lower(o_orderstatus) AS label, year(o_orderdate) AS year FROM orders")
def p01_p03_e01_projection(t):
    """Destination paths from source paths; a value of the scope is made first."""
    specs = {"o_orderkey": "o_orderkey", "out.status": "primary", "out.date.year": ("o_orderdate", F.year), "out.label": (("o_orderpriority", "primary"), lambda a, b: F.concat_ws("/", a, b))}
    rows = H.project(t("orders"), specs, {"primary": ("o_orderstatus", F.lower)})
    return rows.select("o_orderkey", "out.status", "out.label", F.col("out.date.year").cast("bigint").alias("year"))


@query("SELECT p_partkey, 'id,name' AS fields, p_name AS name FROM part")
def p05_p07_excluded_keys(t):
    """Keys that the schema lacks, and those that are excluded from it, are never parsed."""
    schema = H.exclude_keys(StructType.fromDDL("id bigint, name string, pages string, reprints string"), ("pages", "reprints"))
    text = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("x").alias("pages"), F.lit("y").alias("unknown")))
    r = t("part").select("p_partkey", F.from_json(text, schema).alias("r"))
    return r.select("p_partkey", F.lit(",".join(r.schema["r"].dataType.names)).alias("fields"), "r.name")


@query("SELECT p_partkey, 'b,z,a,c' AS fields FROM part")
def l02_sorted_keys(t):
    r = t("part").select("p_partkey", F.struct(F.lit(1).alias("c"), F.lit(1).alias("z"), F.lit(1).alias("a"), F.lit(1).alias("b")).alias("r"))
    out = r.select("p_partkey", H.sort_keys(F.col("r"), r.schema["r"].dataType, ("b", "z")).alias("r"))
    return out.select("p_partkey", F.array_join(F.regexp_extract_all(F.to_json("r"), F.lit('"(\\w)"'), 1), ",").alias("fields"))


@query("SELECT o_custkey, string_agg(k, ',' ORDER BY p, k) AS entries FROM (SELECT o_custkey, coalesce(p, '') AS p, coalesce(p, '') || ':' || min(o_orderkey) AS k FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS p FROM orders) GROUP BY 1, 2) GROUP BY o_custkey")
def a20_sorted_distinct_lists(t):
    """Entries sorted by a key, null as empty; of equal keys the first stays."""
    entry = F.struct(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("p"), "o_orderkey")
    lists = t("orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"]).alias("m"))
    kept = H.sorted_list(F.col("m"), ("p",))
    return lists.select("o_custkey", F.array_join(F.transform(kept, lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.lit(":"), x["o_orderkey"].cast("string"))), ",").alias("entries"))


@query("SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS number, 'S' AS suffix, p_partkey || '.5B' AS name FROM part")
def c07_c08_alternative_issues(t):
    """An alternative issue gets its parts from its name and its name from its parts."""
    empty = F.lit(None)
    whole = R.whole_issue(F.struct(F.concat(F.col("p_partkey").cast("string"), F.lit("S")).alias("name"), empty.cast("decimal(12,3)").alias("number"), empty.cast("string").alias("suffix")))
    named = R.whole_issue(F.struct(empty.cast("string").alias("name"), (F.col("p_partkey") + 0.5).cast("decimal(12,3)").alias("number"), F.lit("B").alias("suffix")))
    return t("part").select("p_partkey", whole["number"].cast("double").alias("number"), whole["suffix"].alias("suffix"), named["name"].alias("name"))


@query("SELECT user_id, event_type, CAST(coalesce(b, 0) + coalesce(a, 0) AS BIGINT) AS n FROM (SELECT user_id, event_type, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL)")
def e03_merger(t):
    """A merge rule of one's own, as an expression over two columns."""
    n = t("events").groupBy("user_id", "event_type").agg(F.count_if(F.col("event_id") % 2 == 0).alias("a"), F.count_if(F.col("event_id") % 2 == 1).alias("b"))
    merger = G.add_counters(F.create_map(F.lit("n"), F.col("a")), F.create_map(F.lit("n"), F.col("b")))
    return n.select("user_id", "event_type", merger["n"].alias("n"))


class FirstLarge(Merger):
    """The price of the first line of a large quantity, the lines up to it, and the last tax that is not zero."""

    def start(self):
        return {"n": 0, "price": None, "tax": None}

    def add(self, state, row):
        if state["price"] is None:
            state["n"] += 1
            state["price"] = row["l_extendedprice"] if row["l_quantity"] > 48 else None
        state["tax"] = row["l_tax"] if row["l_tax"] > 0 else state["tax"]
        return state

    def join(self, first, second):
        ended = first["price"] is not None
        return {"n": first["n"] + (0 if ended else second["n"]), "price": first["price"] if ended else second["price"], "tax": first["tax"] if second["tax"] is None else second["tax"]}

    def result(self, state):
        return {"lines": state["n"], "price": state["price"], "tax": state["tax"]}


@query("""WITH l AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS k, row_number() OVER (PARTITION BY CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax) AS i FROM lineitem),
f AS (SELECT k, min(i) FILTER (l_quantity > 48) AS first, count(*) AS n, arg_max(l_tax, i) FILTER (l_tax > 0) AS tax FROM l GROUP BY k)
SELECT f.k, CAST(coalesce(first, n) AS BIGINT) AS lines, l_extendedprice AS price, tax FROM f LEFT JOIN l ON l.k = f.k AND i = first""")
def e03_merger_of_ones_own(t):
    """A user's fold in an order, of lines by supplier; one key has a third of all lines."""
    rows = t("lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_suppkey")).alias("k"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    return fold(rows, ["k"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax"], FirstLarge(), "lines bigint, price double, tax double")


@query("SELECT p_partkey, 'ruled ' || p_name AS title FROM part")
def e04_rule_of_ones_own(t):
    """A rule is added behind the built-in ones, and taken out again."""
    rule = ("title", lambda rows, record: rows.withColumn(record, F.col(record).withField("title", F.concat(F.lit("ruled "), F.col(f"{record}.series.name")))))
    R.EXTRA_RULES.append(rule)
    try:
        return R.derive_all(_native(t)).select("p_partkey", F.col("record.title").alias("title"))
    finally:
        R.EXTRA_RULES.remove(rule)


# matching -----------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS series, CAST(p_size AS VARCHAR) AS issue, CAST(p_size AS BIGINT) AS issue_int, CAST(3 AS INTEGER) AS volume FROM part")
def m01_profiles(t):
    rows = _native(t).select(F.col("p_partkey").cast("string").alias("path"), "record")
    return V.profiles(rows).select("path", "series", "issue", "issue_int", "volume")


def _catalog(t):
    return t("part").select(F.col("p_partkey").alias("issue_id"), F.col("p_name").alias("series"), F.col("p_size").cast("string").alias("issue"), (F.col("p_size") + 1950).alias("year"), F.col("p_brand").alias("publisher"), F.lit(None).cast("int").alias("pages"), (F.col("p_partkey") % 9).alias("volume"), F.when(F.col("p_partkey") % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source"))


def _people(t):
    even = t("part").where("p_partkey % 7 = 0")
    year = F.col("p_size") + 1950
    return even.select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("series"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size").cast("string")).alias("issue"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).cast("bigint").alias("issue_int"), year.alias("year"), F.col("p_brand").alias("publisher"), F.lit(None).cast("int").alias("pages"), F.lit(None).cast("int").alias("volume"))


@query("""WITH c AS (SELECT *, p_size + 1950 AS y FROM part), pairs AS (SELECT a.p_partkey AS p, b.p_partkey AS i, abs(a.y - b.y) AS d FROM c a JOIN c b ON a.p_name = b.p_name AND (a.p_partkey % 3 = 0 OR a.p_size = b.p_size) WHERE a.p_partkey % 7 = 0),
tiers AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN d <= 1 THEN 1 WHEN d <= 2 THEN 2 ELSE 3 END AS tier FROM pairs)
SELECT CAST(p AS VARCHAR) AS path, count(*) AS n FROM (SELECT *, min(tier) OVER (PARTITION BY p) AS least FROM tiers) WHERE tier = least GROUP BY p""")
def s19_s20_p16_catalog_search(t):
    """Candidates of the same name: by their words and issue, or all issues where a profile knows none; then the best year."""
    found = V.candidates(_people(t), _catalog(t)).where("s_series = 1.0")
    return found.groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 5 = 0 THEN 'EXPLICIT' ELSE 'OTHER' END AS resolution, CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 1 END AS issue_id FROM part WHERE p_partkey % 7 = 0")
def m13_m18_resolution_run(t):
    """Explicit ids come first; each source has a policy of its own, one of which never writes."""
    people = _people(t)
    own = V.policies(M.Policy(), {"a": {"mode": "ask", "prompts": False}, "b": {"margin": None}})
    explicit = people.where("CAST(path AS bigint) % 5 = 0").select("path", (F.col("path").cast("bigint") + 1).alias("issue_id"))
    found = V.run(people, _catalog(t), own, M.Policy(), explicit=explicit)
    how = F.when(F.col("resolution") == "EXPLICIT", F.col("resolution")).when((F.col("source") == "a") & (F.col("resolution") == "AUTO_WRITE"), "WRONG").otherwise("OTHER")
    return found.select("path", how.alias("resolution"), F.when(F.col("resolution") == "EXPLICIT", F.col("issue_id")).alias("issue_id"))


@query("""SELECT profile, count(*) AS n, round(sum(CASE WHEN profile % 2 = 0 AND place <= least(15, greatest(5, c // 2)) THEN 0.8 * metadata + 0.2 * (o_orderkey % 8) / 8.0 ELSE metadata END)::DOUBLE, 6) AS score FROM (
SELECT o_orderkey, o_orderkey % 50 AS profile, CAST(0.5 + o_custkey % 40 / 100.0 AS DOUBLE) AS metadata, row_number() OVER (PARTITION BY o_orderkey % 50 ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderkey % 50) AS c FROM orders) GROUP BY profile""")
def m10_e09_covers_of_the_best(t):
    """Covers, different for each candidate, are compared for the best ones alone, and only where metadata does not decide; the others keep their metadata."""
    w = Window.partitionBy("profile").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    rows = t("orders").select((F.col("o_orderkey") % 50).alias("profile"), "o_orderkey", "o_totalprice", (0.5 + F.col("o_custkey") % 40 / 100).cast("double").alias("metadata")).withColumn("place", F.row_number().over(w))
    out = O.compare_covers(rows, "profile", lambda x: x.withColumn("cover", (F.col("o_orderkey") % 8) / 8), M.final_score, F.col("profile") % 2 == 0, M.hash_count)
    return out.groupBy("profile").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


class EveryIssue(CodeSource):
    """A catalog that is a rule: an issue n has n mod 3 entries."""

    name, fields = "rule", "issue_id bigint, series string"

    def search(self, profile):
        for k in range((profile["issue_int"] or 0) % 3):
            yield {"issue_id": profile["issue_int"] * 1000 + k, "series": profile["series"].upper()}


@query("SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(p_size * 1000 + k AS BIGINT) AS issue_id, upper(p_name) AS series, 'rule' AS source FROM part, (SELECT unnest([0, 1]) AS k) WHERE k < p_size % 3")
def e05_catalog_that_is_code(t):
    """A source of one's own as a table function over all profiles, against a join that follows its rule."""
    people = t("part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").alias("series"), F.col("p_size").cast("bigint").alias("issue_int"))
    return search(people, EveryIssue()).select("path", "issue_id", "series", "source")


@query("""WITH f AS (SELECT o_orderkey, lower(o_orderstatus) || '|' || year(o_orderdate) AS fingerprint, o_custkey % 10 AS volume_id FROM orders), d AS (SELECT fingerprint, min(volume_id) AS v FROM f GROUP BY fingerprint)
SELECT o_orderkey AS issue_id, fingerprint FROM f JOIN d USING (fingerprint) WHERE volume_id = v""")
def m18_e06_e07_deferred_decisions(t):
    """Open rows are put aside, a selector decides once for each fingerprint, the decisions are replayed."""
    orders = t("orders")
    rows = orders.select(F.concat_ws("|", F.lower("o_orderstatus"), F.year("o_orderdate")).alias("fingerprint"), F.lit("p").alias("path"), (F.col("o_custkey") % 10).alias("volume_id"), F.col("o_orderkey").alias("issue_id"), F.lit(0.5).alias("score"))
    decisions = O.Decisions(shared_folder(orders.sparkSession))
    decisions.defer(rows)
    waiting = orders.sparkSession.read.parquet(f"{decisions.folder}/open")
    decisions.select(waiting, lambda asked: asked.select("fingerprint", F.array_min(F.transform("candidates", lambda c: c["volume_id"])).alias("volume_id")))
    return decisions.replay(waiting).select("issue_id", "fingerprint")


@query("SELECT * FROM (VALUES (429, '', 'rate_limit', true, 7), (503, '', 'transient', true, 4), (404, '', 'permanent', false, 0), (NULL, 'Connection reset by peer', 'transient', true, 4), (NULL, 'Rate limit exceeded', 'rate_limit', true, 7), (200, '', NULL, false, 0)) v(status, text, kind, again, last)")
def m20_retries(t):
    """Kinds of failures, whether they are tried again, and the last try that is followed by another."""
    rows = t("region").sparkSession.createDataFrame([(429, ""), (503, ""), (404, ""), (None, "Connection reset by peer"), (None, "Rate limit exceeded"), (200, "")], "status int, text string")
    kind = O.failure_kind(F.col("status"), F.col("text"))
    tries = F.filter(F.sequence(F.lit(1), F.lit(10)), lambda i: O.may_retry(kind, i))
    return rows.select("status", "text", kind.alias("kind"), O.may_retry(kind, F.lit(1)).alias("again"), F.coalesce(F.array_max(tries), F.lit(0)).alias("last"))


_NAMES = [("this is a test", "this is a test!"), ("this is a test", "this is a new test!!!"), ("this is a word", "THIS IS A WORD"), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear"), ("", "a")]


@query("SELECT * FROM (VALUES ('this is a test', 'this is a test!', 0.965517, 0.965517), ('this is a test', 'this is a new test!!!', 0.8, 0.855), ('this is a word', 'THIS IS A WORD', 0.214286, 0.214286), ('fuzzy wuzzy was a bear', 'wuzzy fuzzy was a bear', 0.909091, 0.95), ('', 'a', 0.0, 0.0)) v(a, b, ratio, weighted)".replace("0.965517", "CAST(0.965517 AS DOUBLE)").replace("0.214286", "CAST(0.214286 AS DOUBLE)"))
def x15_x16_name_similarity(t):
    """Values of the public description of both ratios."""
    rows = t("region").sparkSession.createDataFrame(_NAMES, "a string, b string")
    scored = S.with_similarity(S.with_similarity(rows, "a", "b", "ratio", S.ratio_udf), "a", "b", "weighted")
    return scored.select("a", "b", F.round("ratio", 6).alias("ratio"), F.round("weighted", 6).alias("weighted"))


@query("SELECT a.p_type, a.p_partkey AS profile, b.p_partkey AS issue FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND a.p_name = b.p_name WHERE a.p_partkey < b.p_partkey")
def m02_p12_similar_names(t):
    """Names that are equal have a series signal of 1 and pass the filter of every effort."""
    part = t("part")
    a = part.select("p_type", "p_brand", F.col("p_partkey").alias("profile"), F.col("p_name").alias("n1"))
    b = part.select("p_type", "p_brand", F.col("p_partkey").alias("issue"), F.col("p_name").alias("n2"))
    block = ["p_type", "p_brand"]
    # the names of a block are compared, and only parts whose names are kept meet
    names = a.select(*block, "n1").distinct().join(b.select(*block, "n2").distinct(), block)
    scored = S.with_similarity(names, "n1", "n2", "s")
    kept = M.keep_by_name(M.keep_by_name(M.keep_by_name(scored, "s", "minimal", "n2"), "s", "balanced", "n2"), "s", "thorough", "n2").where("s = 1.0")
    return a.join(kept, [*block, "n1"]).join(b, [*block, "n2"]).where("profile < issue").select("p_type", "profile", "issue")


@query("SELECT * FROM (VALUES (1, 10, 2, 1), (1, 11, 1, 2), (1, 12, 3, 3), (1, 13, 4, 4), (2, 20, 1, 1), (2, 21, 2, 2)) v(profile, issue, place, final_place)")
def w02_tie_break_values(t):
    """A run is relative to its leader: 11 leads, 10 is in reach and has the lesser volume; 12 is in reach of 10 only; 13 has other metadata."""
    rows = [(1, 11, 0.9, 0.90, None, 7), (1, 10, 0.9, 0.89, None, 3), (1, 12, 0.9, 0.875, None, 1), (1, 13, 0.8, 0.87, None, 1), (2, 20, 0.9, 0.9, 0.9, 5), (2, 21, 0.9, 0.9, 0.99, 1)]
    frame = t("region").sparkSession.createDataFrame(rows, "profile int, issue int, metadata double, score double, cover double, volume int")
    ranked = frame.withColumn("place", F.row_number().over(Window.partitionBy("profile").orderBy(F.col("score").desc(), "issue")))
    return M.tie_break(ranked, "profile").select("profile", "issue", "place", "final_place")


# validation, settings, secrets --------------------------------------------------


@query("SELECT p_partkey, p_size % 14 BETWEEN 1 AND 12 AS json, p_size % 3 > 0 AS xml, p_size % 14 BETWEEN 1 AND 12 AS yaml FROM part")
def m21_m22_m23_e10_validators(t):
    """Typed checks of JSON, XML and YAML documents."""
    month = F.col("p_size") % 14
    as_json = F.concat(F.lit('{"month": '), month, F.lit("}"))
    as_xml = F.when(F.col("p_size") % 3 > 0, F.lit("<r><a>1</a></r>")).otherwise(F.lit("<other/>"))
    as_yaml = F.concat(F.lit("month: "), month)
    json = C.valid_json("month int", C.number_within("month", 1, 12))
    return t("part").select("p_partkey", json(as_json).alias("json"), C.valid_xml("r", "a string")(as_xml).alias("xml"), C.valid_yaml(json)(as_yaml).alias("yaml"))


@query("SELECT * FROM (VALUES ('read', 'comet,comic_info'), ('margin', '0.3'), ('match', 'ask'), ('threshold', '0.95'), ('ttl', '43200'), ('pages', '2:None'), ('deleted', 'a.b,c'), ('redacted', 'x?api_key=***&b=1 ***'), ('masked', 'ab***'), ('formats', 'comet')) v(name, value)")
def s26_p10_p18_u06_x43_x44_settings(t):
    """Layers: defaults, files, environment, arguments; parsed values and hidden secrets."""
    s = config.layered({"read": "comet, comic_info, comet", "margin": "0.2", "match": "eager"}, {"match": "careful"}, env={"SPARKFOLD_MARGIN": "0.3", "SPARKFOLD_UNKNOWN": "1"}, args={"match": "ask", "read": None})
    first, last = config.page_range("2:")
    rows = [
        ("read", ",".join(s.read)), ("margin", str(s.margin)), ("match", s.match), ("threshold", str(s.auto_threshold)), ("ttl", str(config.ttl_seconds("12h"))), ("pages", f"{first}:{last}"), ("deleted", ",".join(config.delete_keys("a.b, c", ["c"]))),
        ("redacted", config.redact("x?api_key=abc&b=1 secret", ["secret"])), ("masked", config.masked("abcdefghij")), ("formats", ",".join(config.formats_to_read(config.layered({"read_except": "comic_info"}, env={}), ["comic_info", "comet"]))),
    ]
    return t("region").sparkSession.createDataFrame(rows, "name string, value string")


# catalogs -----------------------------------------------------------------


@query("""SELECT p_partkey, p_name AS series, CAST(p_partkey AS VARCHAR) AS key, CASE p_size % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'IT' WHEN 2 THEN '' ELSE 'IT' END AS country, CASE WHEN p_size % 2 = 0 THEN 4.5 END::DOUBLE AS rating, 'Bar #5|Nick' AS reprints, 'Some text' AS summary FROM part""")
def s19_catalog_a_documents(t):
    """Entries of catalog A: currencies become countries, alternative names reprints; a count without an average is no rating."""
    money = F.element_at(F.array(*[F.lit(x) for x in ("USD", "EUR", "XYZ", "ITL")]), F.col("p_size") % 4 + 1)
    series = F.struct(F.lit(7).alias("id"), F.col("p_name").alias("name"), F.array(F.lit("Nick"), F.lit(" nick "), F.upper("p_name"), F.lit("")).alias("alt_names"), F.lit("").alias("language"))
    body = F.struct(F.col("p_partkey").alias("id"), F.lit("5").alias("number"), series.alias("series"), F.lit("4.99").alias("price"), money.alias("price_currency"), F.when(F.col("p_size") % 2 == 0, F.lit("4.5")).alias("average_rating"), F.lit(0).alias("rating_count"), F.array(F.struct(F.lit(1).alias("id"), F.lit("Bar #5").alias("issue"))).alias("reprints"), F.lit("<p>Some text</p>").alias("desc"))
    text = F.to_json(F.struct(body.alias("metron_api")))
    r = E.D.READERS["metron_api"](text)
    rows = t("part").select("p_partkey", r.alias("r")).where("r.language IS NULL")
    names = F.transform("r.reprints", lambda x: F.coalesce(x["series"], x["issue"]))
    return rows.select("p_partkey", F.col("r.series.name").alias("series"), F.col("r.identifiers")["metron"]["key"].alias("key"), F.get(F.map_keys("r.prices"), F.lit(0)).alias("country"), F.col("r.community_rating.average_rating").cast("double").alias("rating"), F.array_join(names, "|").alias("reprints"), F.col("r.summary").alias("summary"))


@query("SELECT p_partkey, p_name AS series, 'Inker,Penciler' AS roles, 'https://comicvine.gamespot.com/c/4050-7/' AS url, 'm' AS cover, 'Nick' AS reprints FROM part")
def s20_catalog_b_documents(t):
    """Entries of catalog B: a volume is a series, roles are one text, aliases are lines."""
    volume = F.struct(F.lit(7).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("Nick\r\n"), F.upper("p_name")).alias("aliases"))
    body = F.struct(F.col("p_partkey").alias("id"), F.lit("5").alias("number"), volume.alias("volume"), F.struct(F.lit("m").alias("medium_url"), F.lit("t").alias("thumbnail")).alias("image"), F.array(F.struct(F.lit(3).alias("id"), F.lit("Ann").alias("name"), F.lit("Penciler , Inker").alias("roles"))).alias("creators"))
    r = E.D.READERS["comicvine_api"](F.to_json(body))
    rows = t("part").select("p_partkey", r.alias("r"))
    roles = F.array_join(F.array_sort(F.map_keys(F.col("r.credits")["Ann"]["roles"])), ",")
    return rows.select("p_partkey", F.col("r.series.name").alias("series"), roles.alias("roles"), F.col("r.series.identifiers")["comicvine"]["url"].alias("url"), F.col("r.cover_image").alias("cover"), F.get("r.reprints", F.lit(0))["series"].alias("reprints"))

