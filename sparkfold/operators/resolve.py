"""Resolution of records against catalogs that are tables.

A catalog is any DataFrame with source, issue_id, series, issue, year, publisher, pages, volume and cover
hash, and maybe start_year and aliases (other names of the series); a remote one is copied to a table first.  Decisions that need a person are written as rows and joined
back when they have been made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import similarity as S
from ..functions import text as T
from ..functions.shared import shared_folder
from . import match as M
from . import names as A
from . import online as O
from .lookup import fresh


def profiles(records: DataFrame, key: str = "path", record: str = "record") -> DataFrame:
    """What is known of each record before it is resolved; a year-shaped volume is no volume."""
    r = F.col(record)
    volume = r["volume"]["number"]
    issue = T.strip_leading_zeros(r["issue"]["name"])
    return records.select(
        key, r["series"]["name"].alias("series"), issue.alias("issue"), T.issue_int(issue).alias("issue_int"), F.coalesce(r["date"]["year"], F.year(r["date"]["cover_date"])).alias("year"),
        r["publisher"]["name"].alias("publisher"), r["page_count"].alias("pages"), F.when(~volume.between(1900, 2100), volume).alias("volume"), r["identifiers"].alias("identifiers"),
    )


def _issue_key(text: Column) -> Column:
    return F.coalesce(T.issue_int(T.strip_leading_zeros(text)).cast("string"), F.lower(F.trim(text)))


def _filter_name(name: Column) -> Column:
    """A name as the search compares it: normalised, without a year in parentheses."""
    return T.normalize_series(T.strip_years(name))


def _offer_names(offers: DataFrame) -> Column:
    """The series of an offer and, where the catalog has a column ``aliases`` (array of text), its other names."""
    return F.array_compact(F.concat(F.array("c_series"), F.coalesce(F.col("c_aliases"), F.array()))) if "c_aliases" in offers.columns else F.array_compact(F.array("c_series"))


def name_pairs(seekers: DataFrame, offers: DataFrame, effort: str) -> DataFrame:
    """pn, cn: names of profiles and of offers that are similar enough for an effort.

    The thorough effort sets no threshold; it takes what the balanced one takes and names of which one holds all words of the other.
    """
    limit = M.NAME_FILTER[effort]
    if limit > 0:
        return A.ratio_join(seekers, offers, "pn", "cn", limit).select("pn", "cn")
    return A.ratio_join(seekers, offers, "pn", "cn", M.NAME_FILTER["balanced"]).select("pn", "cn").unionByName(A.contained_join(seekers, offers, "pn", "cn")).distinct()


def candidates(people: DataFrame, catalog: DataFrame, key: str = "path", effort: str = "balanced") -> DataFrame:
    """All offers with a name like that of a profile, and its issue, narrowed by year.

    Names are compared by a similarity join of the distinct ones (``name_pairs``), which loses none at or above the
    threshold of the effort; an offer is found by its series or any of its ``aliases``, and ``s_series`` is the best of
    them.  A profile meets the offers of its issue and those without one; without an issue of its own it meets all issues
    of such series.  A profile without a series meets the offers of its issue and year, of what it knows of them.  A volume
    that starts after the year is out.

    Profiles that are the same but for their key, and offers that are the same but for their id, are one kind each. Kinds
    are compared and narrowed; rows are paired at the end, where their kinds were kept.  Keys and ids are unique.
    """
    offers = catalog.select([F.col(c).alias(f"c_{c}") for c in catalog.columns])
    own = [c for c in ("c_source", "c_issue_id") if c in offers.columns]
    blank = lambda x: F.coalesce(x, F.lit(""))
    here, there = fresh("__s", people, offers), fresh("__o", people, offers)
    start = F.col("c_start_year") if "start_year" in catalog.columns else F.lit(None).cast("int")
    spellings = F.transform(_offer_names(offers), lambda n: T.normalize_series(n))
    facts = F.struct(spellings.alias("cs"), F.transform(_offer_names(offers), _filter_name).alias("cns"), _issue_key(F.col("c_issue")).alias("ci"), F.col("c_year").alias("cy"), start.alias("cstart"))
    offers = offers.where(" AND ".join(f"{c} IS NOT NULL" for c in own)).withColumn(there, F.to_json(facts))
    known = F.struct(T.normalize_series(F.col("series")).alias("p"), _filter_name(F.col("series")).alias("pn"), _issue_key(F.col("issue")).alias("i"), F.col("year").alias("y"))
    seekers = people.where("series IS NOT NULL OR issue IS NOT NULL OR year IS NOT NULL").where(F.col(key).isNotNull()).withColumn(here, F.to_json(known))
    kind = lambda rows, name, x: rows.select(F.col(name).alias(name[2]), x.alias("x")).dropDuplicates([name[2]]).select(name[2], "x.*")
    s, o = kind(seekers, here, known), kind(offers, there, facts)

    # an offer stands in the block of its issue (or of "?" without one), and in "*" for those who know no issue
    o_year = F.col("cy").cast("string")
    blocks = F.array(F.concat(F.lit("i"), F.nullif(F.col("ci"), F.lit(""))), F.lit("*"))
    named_offers = o.select("o", F.explode(F.array_distinct(F.col("cns"))).alias("cn"), F.transform(blocks, lambda x: F.coalesce(x, F.lit("?"))).alias("blocks")).where("cn <> ''")
    each = F.array(F.struct(F.col("ci").alias("i"), o_year.alias("y")), F.struct(F.col("ci").alias("i"), F.lit(None).cast("string").alias("y")), F.struct(F.lit(None).cast("string").alias("i"), o_year.alias("y")))
    by_facts = o.select("o", F.explode(F.array_distinct(F.transform(each, lambda k: F.concat_ws("|", F.lit("n"), blank(k["i"]), blank(k["y"]))))).alias("block")).where("block <> 'n||'")

    asked = F.when(blank(F.col("i")) != "", F.array(F.concat(F.lit("i"), F.col("i")), F.lit("?"))).otherwise(F.array(F.lit("*")))
    named = s.select("s", "pn", asked.alias("asked")).where("pn <> ''")
    pairs_of_names = name_pairs(named, named_offers, effort)
    wanted = named.join(pairs_of_names, "pn").select("s", "cn", F.explode("asked").alias("block"))
    by_name = wanted.join(named_offers.select("o", "cn", F.explode("blocks").alias("block")), ["cn", "block"]).select("s", "o")
    nameless = s.where(blank(F.col("pn")) == "").select("s", F.concat_ws("|", F.lit("n"), blank(F.col("i")), blank(F.col("y").cast("string"))).alias("block"))
    met = by_name.unionByName(nameless.join(by_facts, "block").select("s", "o")).distinct()
    pairs = s.join(met, "s").join(o, "o").where(F.coalesce(F.col("cstart") <= F.col("y") + 1, F.lit(True)))
    # The exact year, else one beside it, else any
    apart = F.abs(F.col("y") - F.col("cy"))
    tier = F.when(F.col("y").isNull() | F.col("cy").isNull() | (apart == 0), 0).when(apart <= 1, 1).when(apart <= 2, 2).otherwise(3)
    kept = _with_series_signal(M.least_tier(pairs.select("s", "o", "p", "cs", tier.alias("tier")), "s", "tier"))
    rows = seekers.join(kept.withColumnsRenamed({"s": here, "o": there}), here).join(offers, there)
    return rows.select(*people.columns, *[c for c in offers.columns if c != there], "tier", "s_series")


def _with_series_signal(pairs: DataFrame) -> DataFrame:
    """S, o, tier and ``s_series``, the best weighted ratio of the series ``p`` to the names ``cs`` of the offer; each pair of names is compared once."""
    names = pairs.select("p", "cs").distinct()
    best = S.with_similarity(names.select("p", "cs", F.explode("cs").alias("c")), "p", "c", "s_series").groupBy("p", "cs").agg(F.max("s_series").alias("s_series"))
    on = pairs["p"].eqNullSafe(best["p"]) & pairs["cs"].eqNullSafe(best["cs"])
    return pairs.join(best, on, "left").select(pairs["s"], pairs["o"], pairs["tier"], F.coalesce("s_series", F.lit(0.0)).alias("s_series"))


def score(pairs: DataFrame, cover: str | None = None) -> DataFrame:
    """Metadata, cover and final score of each pair."""
    has = lambda a, b: F.col(a).isNotNull() | F.col(b).isNotNull()
    signals = {
        "series": (has("series", "c_series"), F.col("s_series")), "issue": (has("issue", "c_issue"), M.issue_signal(F.col("issue_int"), F.col("issue"), F.col("c_issue"))), "year": (has("year", "c_year"), M.year_signal(F.col("year"), F.col("c_year"))),
        "publisher": (has("publisher", "c_publisher"), M.publisher_signal(F.col("publisher"), F.col("c_publisher"))), "pages": (has("pages", "c_pages"), M.pages_signal(F.col("pages"), F.col("c_pages"))),
    }
    known = pairs.withColumn("metadata", F.round(M.metadata_score(signals), 9))
    if cover:  # M10: hashes are there as columns; a missing one keeps the metadata score
        known = known.withColumn("cover", N.hash_score(N.hamming(F.col(cover), F.col("c_cover_hash"))))
    else:
        known = known.withColumn("cover", F.lit(None).cast("double"))
    return known.withColumn("score", F.round(M.final_score(F.col("metadata"), F.col("cover")), 9))


def resolutions(people: DataFrame, scored: DataFrame, key: str = "path", policy: M.Policy = M.Policy()) -> DataFrame:
    """Key, resolution, chosen issue_id, score and gap of every profile."""
    rows = scored.withColumnsRenamed({"c_volume": "volume_id"}) if "volume_id" not in scored.columns else scored
    rows = rows.withColumns({"volume": F.col("volume_id"), "issue_key": F.col("c_issue_id")}).drop("issue").withColumnRenamed("issue_key", "issue")
    ranked = M.rank(rows, key, "score", "volume", "issue")
    final = M.tie_break(ranked, key).select(key, "place", "final_place")
    placed = ranked.join(final, [key, "place"]).drop("gap")
    w = Window.partitionBy(key).orderBy("final_place")
    placed = placed.withColumn("gap", F.coalesce(F.round(F.col("score") - F.lead("score").over(w), 9), F.lit(1.0)))
    top = M.viable(placed, key, "score", policy.minimum).where("final_place = 1").select(key, F.col("issue").alias("issue_id"), "score", "gap", "solo")
    out = people.select(key).join(top, key, "left").withColumn("resolution", M.resolve(F.col("score"), F.col("gap"), F.col("solo"), policy))
    return out.withColumn("issue_id", F.when(F.col("resolution") == "AUTO_WRITE", F.col("issue_id"))).select(key, "resolution", "issue_id", "score", "gap")


def lookup_order(explicit: DataFrame, stored: DataFrame, cached: DataFrame, searched: DataFrame, key: str = "path") -> DataFrame:
    """For each key the first of explicit id, stored id, cached series and search; rows (key, issue_id)."""
    tiers = None
    for i, part in enumerate((explicit, stored, cached, searched)):
        rows = part.where("issue_id IS NOT NULL").select(key, "issue_id", F.lit(i).alias("tier"))
        tiers = rows if tiers is None else tiers.unionByName(rows)
    return tiers.groupBy(key).agg(F.min_by("issue_id", F.struct("tier", "issue_id")).alias("issue_id"), F.min("tier").alias("tier"))


def apply_decisions(open_rows: DataFrame, decisions: DataFrame, fingerprint: str = "fingerprint", volume: str = "volume_id") -> DataFrame:
    """Decisions made once per fingerprint, carried over to all open rows by their volume."""
    return open_rows.join(decisions.select(fingerprint, F.col(volume).alias("__v")), fingerprint, "left").withColumn("chosen", F.coalesce(F.col(volume) == F.col("__v"), F.lit(False))).drop("__v")


def policies(base: M.Policy, overrides: dict[str, dict]) -> dict[str, M.Policy]:
    """The policy of each source: its own parameters before the general ones."""
    from dataclasses import replace

    return {source: replace(base, **{k: v for k, v in own.items() if v is not None}) for source, own in overrides.items()}


def add_catalog_records(raw: DataFrame, resolved: DataFrame, documents: DataFrame, source: str, key: str = "path") -> DataFrame:
    """Raw documents with those of the chosen catalog entries (issue_id, fmt, payload) as a further source."""
    chosen = resolved.where("issue_id IS NOT NULL").select(key, "issue_id").join(documents, "issue_id")
    return raw.unionByName(chosen.select(key, F.lit(source).alias("source"), "fmt", F.lit(0).alias("ordinal"), "payload"))


def run(people: DataFrame, catalog: DataFrame, own: dict[str, M.Policy], policy: M.Policy, effort: str = "balanced", explicit: DataFrame | None = None, cache: DataFrame | None = None, decisions: DataFrame | None = None, covers: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Path, source, resolution, issue_id, score and gap of every profile against a catalog table.

    Each source decides by its policy; the first source that writes wins, the next ones count where it does not (P15).
    """
    offers = catalog if "source" in catalog.columns else catalog.withColumn("source", F.lit("catalog"))
    scored = score(candidates(people, offers, key, effort))
    if covers is not None:
        scored = _with_covers(scored.join(covers, key, "left"), key, policy)
    # each source and the decisions look at all pairs: they are made once
    folder = shared_folder(people.sparkSession)
    scored.write.parquet(folder)
    scored = people.sparkSession.read.schema(scored.schema).parquet(folder)
    names = list(own) or [r[0] for r in offers.select("source").distinct().orderBy("source").collect()]  # a handful of catalogs
    parts = None
    for i, name in enumerate(names):
        one = resolutions(people, scored.where(F.col("c_source") == name), key, own.get(name, policy)).withColumns({"source": F.lit(name), "turn": F.lit(i)})
        parts = one if parts is None else parts.unionByName(one)
    # what is written first, then what must be asked, then what is skipped; sources in turn
    worth = F.when(F.col("resolution") == "AUTO_WRITE", 0).when(F.col("resolution") == "PROMPT", 1).when(F.col("resolution") == "SKIP", 2).otherwise(3)
    fields = ["source", "resolution", "issue_id", "score", "gap"]
    found = parts.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(worth, "turn")).alias("x")).select(key, *[f"x.{f}" for f in fields])
    if decisions is not None:
        found = _decided(found, people, scored, decisions, key)
    return _in_order(found, people, offers, explicit, cache, key)


def _with_covers(scored: DataFrame, key: str, policy: M.Policy) -> DataFrame:
    """M09, M10 on the columns cover_hash and c_cover_hash."""
    ranked = M.rank(scored.withColumns({"volume": F.col("c_volume"), "number": F.col("c_issue_id")}), key, "metadata", "volume", "number")
    needs = M.needs_hash(F.col("metadata"), F.col("gap"), policy)

    def compare(rows: DataFrame) -> DataFrame:
        return rows.withColumn("cover", N.hash_score(N.hamming(F.col("cover_hash"), F.col("c_cover_hash"))))

    return O.compare_covers(ranked.drop("cover", "score"), key, compare, M.final_score, needs, M.hash_count).drop("place", "gap", "volume", "number", "cover_hash")


def _decided(found: DataFrame, people: DataFrame, scored: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Profiles that would be asked take the candidate of the volume that was chosen for their series."""
    prints = people.select(key, O.series_fingerprint(F.col("series"), F.col("year"), F.col("publisher")).alias("fingerprint"))
    choice = scored.join(prints.join(decisions, "fingerprint").select(key, F.col("volume_id").alias("c_volume")), [key, "c_volume"])
    best = choice.groupBy(key).agg(F.max_by("c_issue_id", F.struct("score", -F.col("c_issue_id"))).alias("chosen"))
    open_ = F.col("resolution") == "PROMPT"
    joined = found.join(best, key, "left")
    return joined.withColumns({"issue_id": F.when(open_ & F.col("chosen").isNotNull(), F.col("chosen")).otherwise(F.col("issue_id")), "resolution": F.when(open_ & F.col("chosen").isNotNull(), F.lit("DECIDED")).otherwise(F.col("resolution"))}).drop("chosen")


def _in_order(found: DataFrame, people: DataFrame, offers: DataFrame, explicit: DataFrame | None, cache: DataFrame | None, key: str) -> DataFrame:
    """Explicit, stored and cached ids before what the search has found."""
    none = found.sparkSession.createDataFrame([], f"{key} string, issue_id bigint")
    stored = people.select(key, F.explode_outer("identifiers").alias("source", "v")).select(key, "source", F.col("v.key").try_cast("bigint").alias("issue_id")) if dict(people.dtypes).get("identifiers", "").startswith("map") else None
    known = none if stored is None else stored.join(offers.select("source", "issue_id").distinct(), ["source", "issue_id"], "left_semi").groupBy(key).agg(F.min("issue_id").alias("issue_id"))
    cached = none
    if cache is not None:
        prints = people.select(key, O.series_fingerprint(F.col("series"), F.col("year"), F.col("publisher")).alias("fingerprint"), "issue")
        cached = O.through_series_cache(prints, cache, offers.select(F.col("volume").alias("volume_id"), "issue", "issue_id")).groupBy(key).agg(F.min("issue_id").alias("issue_id"))
    order = lookup_order(none if explicit is None else explicit.select(key, "issue_id"), known, cached, none, key)
    sure = found.join(order.withColumnsRenamed({"issue_id": "sure", "tier": "sure_tier"}), key, "left")
    how = F.when(F.col("sure_tier") == 0, "EXPLICIT").when(F.col("sure_tier") == 1, "STORED").when(F.col("sure_tier") == 2, "CACHED").otherwise(F.col("resolution"))
    return sure.withColumns({"resolution": how, "issue_id": F.coalesce("sure", "issue_id")}).drop("sure", "sure_tier")
