"""Derivation rules over merged records.

A rule reads the merged record and gives a delta, a struct of the fields that it sets; the deltas are merged in
the order of RULES, each with its own mode.  Rules read the same frozen record, apart from the issue rules,
whose parts later rules see.  Everything is one projection, which Spark collapses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..functions import identifiers as I
from ..functions import numbers as N
from ..functions import text as T
from .lookup import consolidate

# Patterns of notes.
TAGGER = r"(?i)Tagged\s(?:with|by)\s(\w+(?:\s(?:dev|test|[\d.]+\S+))?)"
UPDATED = r"(?i)\son\s([12]\d{3}-[01]\d-[0-3]\d[\sT](?:[012]\d:\d{2}:\d{2}\S*)?)"
ORIGIN = r"(?i)using info from (\w+)"
ISSUE_ID = r"(?i)\[Issue ID (\w+)\]"
FORMATS = ("Annual", "Anthology", "Box Set", "Digital", "Graphic Novel", "Hard Cover", "Magazine", "Manga", "One-Shot", "Omnibus", "Trade Paperback", "Web Comic")


def issue_from_name(name: Column) -> tuple[Column, Column]:
    """Number and suffix of an issue name."""
    return T.issue_number(name).try_cast("decimal(12,3)"), F.nullif(F.trim(T.issue_suffix(name)), F.lit(""))


def issue_from_parts(number: Column, suffix: Column) -> Column:
    """Name of an issue from number and suffix; whole numbers have no decimals."""
    text = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(number.isNotNull(), F.concat(text, F.coalesce(suffix, F.lit(""))))


def dates(cover: Column, year: Column, month: Column, day: Column) -> tuple[Column, Column, Column, Column]:
    """C11: cover date from its parts, or the parts from it; parts that are no date are null."""
    month = F.when(month.between(1, 12), month)
    day = F.when(day.between(1, 31), day)
    made = N.compose_date(year, month, day)
    whole = F.coalesce(cover, made)
    return whole, F.coalesce(year, F.year(whole)), F.coalesce(month, F.month(whole)), F.coalesce(day, F.dayofmonth(whole))


def notes_facts(notes: Column) -> tuple[Column, Column, Column]:
    """Tagger, time and release date in a note."""
    tagger = F.nullif(F.trim(F.regexp_extract(notes, TAGGER, 1)), F.lit(""))
    updated = F.try_to_timestamp(F.nullif(F.trim(F.regexp_extract(notes, UPDATED, 1)), F.lit("")))
    return tagger, updated, N.reldate(notes)


def notes_identifiers(notes: Column) -> Column:
    """Array of (source, type, key) in a note, in the order in which later ones replace earlier ones."""
    # any bracket first: the alternation of all sources is tried on these few words alone
    words = F.filter(F.regexp_extract_all(notes, F.lit(r"\[(\w[\w:-]+)\]"), 1), lambda x: x.rlike(rf"(?i)^(?:{'|'.join((*I.SOURCES, *I.ALIASES))}):?[\w:-]+$"))
    bracketed = F.transform(words, lambda x: I.parse_other(x))
    origin, key = F.regexp_extract(notes, ORIGIN, 1), F.regexp_extract(notes, ISSUE_ID, 1)
    tagged = F.filter(F.array(F.struct(I.source_of_alias(origin).alias("source"), F.lit(I.DEFAULT_TYPE).alias("type"), key.alias("key"))), lambda x: x["source"].isNotNull() & (x["key"] != ""))
    urns = F.filter(F.transform(F.regexp_extract_all(notes, F.lit(r"(urn:[^\s:]{2,}:[^\s]{2,})"), 1), lambda x: I.parse_urn(x)), lambda x: I.source_of_alias(x["source"]).isNotNull())
    return F.filter(F.concat(bracketed, tagged, urns), lambda x: x["source"].isNotNull())


def title_stories(title: Column, known: Column) -> Column:
    """Stories that a title names and that are not there yet."""
    return F.array_except(T.split_list(title, ";"), F.coalesce(known, F.array().cast("array<string>")))


def stories_title(stories: Column) -> Column:
    """The title that stories make, in order."""
    return F.nullif(F.array_join(stories, "; "), F.lit(""))


def format_from_scan(original: Column, scan: Column) -> Column:
    """The original format, or one that the scan information names."""
    found = F.lit(None).cast("string")
    for name in reversed(FORMATS):
        found = F.when(F.lower(scan).contains(name.lower()), F.lit(name)).otherwise(found)
    return F.coalesce(original, found)


def page_count(known: Column, counted: Column) -> Column:
    """The counted pages where they were counted."""
    return F.coalesce(counted, known)


def trim_pages(pages: Column, count: Column) -> Column:
    """The pages that the container has; the first one is typed as front cover if none is."""
    kept = F.map_filter(pages, lambda k, v: k < count)
    covers = F.size(F.filter(F.map_values(kept), lambda v: v["page_type"] == "FrontCover"))
    return F.transform_values(kept, lambda k, v: F.when((covers == 0) & (k == 0), v.withField("page_type", F.lit("FrontCover"))).otherwise(v))


def stamp(tagger: Column, now: Column, identifiers: Column) -> Column:
    """The note that a tagger leaves: name, time, the ComicVine issue and sorted URNs."""
    urns = F.array_sort(F.transform(F.map_entries(identifiers), lambda e: I.urn_of(e["key"], F.lit(I.DEFAULT_TYPE), e["value"]["key"])))
    issue = F.try_element_at(identifiers, F.lit("comicvine"))["key"]
    text = F.concat_ws(" ", F.concat(F.lit("Tagged with "), tagger, F.lit(" on "), N.iso_seconds(now)), F.concat(F.lit("[Issue ID "), issue, F.lit("]")), F.array_join(urns, " "))
    return F.trim(text)


def stamped(rows: DataFrame, tagger: str, now: Column | None = None, record: str = "record") -> DataFrame:
    """Records with tagger, time and note of who writes them."""
    r, at = F.col(record), F.current_timestamp() if now is None else now
    return rows.withColumn(record, F.when(r.isNotNull(), r.withField("tagger", F.lit(tagger)).withField("updated_at", at).withField("notes", stamp(F.lit(tagger), at, r["identifiers"]))))


def with_urls(identifiers: Column, kind: str) -> Column:
    """Identifiers with normalised keys and the URLs that were missing."""
    return F.transform_values(identifiers, lambda source, v: I.identifier(source, F.lit(kind), v["key"], v["url"]))


def tag_identifiers(tags: Column) -> Column:
    """Identifiers that tags spell, as an array of (source, type, key)."""
    names = "|".join((*I.SOURCES, *I.ALIASES))
    spelled = F.filter(tags, lambda x: x.rlike(rf"(?i)^(?:urn:)?(?:{names}):"))
    return F.transform(spelled, lambda x: F.when(x.startswith("urn:"), I.parse_urn(x)).otherwise(I.parse_other(x)))


#: Type of the identifiers of nested names, by field.
NESTED_TYPES = {"arcs": "arc", "characters": "character", "credits": "creator", "genres": "genre", "locations": "location", "stories": "story", "teams": "team", "universes": "universe"}


def whole_issue(issue: Column) -> Column:
    """An issue whose name gives the missing parts, or whose parts give the missing name."""
    number, suffix = issue_from_name(issue["name"])
    return F.when(issue.isNotNull(), F.struct(F.coalesce(issue["name"], issue_from_parts(issue["number"], issue["suffix"])).alias("name"), F.coalesce(issue["number"], number).alias("number"), F.coalesce(issue["suffix"], suffix).alias("suffix")))


def _nested_urls(named: Column, kind: str) -> Column:
    """C10 for a map of named things."""
    return F.transform_values(named, lambda k, v: F.when(v["identifiers"].isNotNull(), v.withField("identifiers", with_urls(v["identifiers"], kind))).otherwise(v))


def derive(rows: DataFrame, record: str = "record", drop: tuple[str, ...] = (), counted: str | None = None) -> DataFrame:
    """Applies the rules to a column of canonical records; ``drop`` (C16) names key paths to delete at the end.

    ``counted`` names a column with the number of pages that were found in the container, null where none was
    looked into; the pages (C02) are trimmed to it.
    """
    from ..sources import canonical as C

    # issue parts first: later rules see them
    stage = rows.withColumn("__r", F.col(record)).withColumn("__issue", whole_issue(F.col("__r.issue")))
    tagger, updated, released = notes_facts(F.col("__r.notes"))
    mined = F.concat(F.coalesce(tag_identifiers(F.concat(F.coalesce(F.map_keys(F.col("__r.tags")), F.array().cast("array<string>")), F.coalesce(F.map_keys(F.col("__r.genres")), F.array().cast("array<string>")))), F.array().cast("array<struct<source:string,type:string,key:string>>")), F.coalesce(notes_identifiers(F.col("__r.notes")), F.array().cast("array<struct<source:string,type:string,key:string>>")))
    stage = stage.withColumn("__mined", C.to_map(F.transform(mined, lambda m: F.struct(m["source"].alias("k"), I.identifier(m["source"], m["type"], m["key"]).alias("v"))), C.IDS)).withColumn("__released", released)
    d = F.col("__r.date")
    no_parts = F.coalesce(d["cover_date"].cast("string"), d["year"].cast("string"), d["month"].cast("string"), d["day"].cast("string")).isNull()
    whole, year, month, day = dates(F.coalesce(d["cover_date"], F.when(no_parts, F.col("__released"))), d["year"], d["month"], d["day"])
    date = F.when(d.isNotNull() | F.col("__released").isNotNull(), F.struct(whole.alias("cover_date"), d["store_date"].alias("store_date"), year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day")))
    explicit = with_urls(F.col("__r.identifiers"), I.DEFAULT_TYPE)
    ids = F.coalesce(F.map_zip_with(F.col("__mined"), explicit, lambda k, a, b: F.coalesce(b, a)), explicit, F.col("__mined"))
    named = C.named(title_stories(F.col("__r.title"), F.map_keys(F.col("__r.stories"))))
    stories = F.coalesce(F.map_zip_with(F.col("__r.stories"), named, lambda k, a, b: F.coalesce(a, b)), F.col("__r.stories"), named)
    stage = stage.withColumn("__stories", stories)
    title = F.coalesce(stories_title(F.map_keys(F.col("__stories"))), F.col("__r.title"))
    reprints = F.when(F.col("__r.reprints").isNotNull(), consolidate(F.col("__r.reprints"), ["language", "series", "volume", "issue"]))
    changed = {
        "issue": F.col("__issue"), "date": date, "identifiers": ids, "tagger": F.coalesce(F.col("__r.tagger"), tagger), "updated_at": F.coalesce(F.col("__r.updated_at"), updated),
        "stories": F.col("__stories"), "title": title, "reprints": reprints, "original_format": format_from_scan(F.col("__r.original_format"), F.col("__r.scan_info")),
        "alternative_issue": whole_issue(F.col("__r.alternative_issue")),
    }
    for field, kind in NESTED_TYPES.items():
        changed[field] = _nested_urls(changed.get(field, F.col(f"__r.{field}")), kind)
    for field in ("series", "publisher", "imprint"):
        one = F.col(f"__r.{field}")
        changed[field] = F.when(one["identifiers"].isNotNull(), one.withField("identifiers", with_urls(one["identifiers"], field))).otherwise(one)
    if counted:
        n, pages = F.col(counted), F.col("__r.pages")
        changed["page_count"], changed["pages"] = page_count(F.col("__r.page_count"), n), F.when(n.isNotNull() & pages.isNotNull(), trim_pages(pages, n)).otherwise(pages)
    values = {n: changed.get(n, F.col(f"__r.{n}")) for n in C.FIELDS}
    whole = F.struct(*[v.cast(C.FIELDS[n]).alias(n) for n, v in values.items()])
    out = stage.withColumn(record, F.when(F.col("__r").isNotNull(), whole)).drop("__r", "__issue", "__mined", "__released", "__stories")
    return delete_paths(out, record, drop)


def _without(entries: Column, key: str) -> Column:
    return F.map_filter(entries, lambda k, v: k != key)


def delete_paths(rows: DataFrame, record: str, paths: tuple[str, ...]) -> DataFrame:
    """Deletes key paths, in order; a path that is not there is ignored."""
    for path in sorted(paths):
        parent, _, leaf = path.rpartition(".")
        kind = rows.schema[record].dataType
        for name in filter(None, parent.split(".")):
            kind = kind[name].dataType if isinstance(kind, StructType) and name in kind.names else None
        if isinstance(kind, MapType):
            rows = rows.withColumn(record, F.col(record).withField(parent, _without(F.col(f"{record}.{parent}"), leaf)))
        elif isinstance(kind, StructType) and leaf in kind.names:
            rows = rows.withColumn(record, F.col(record).withField(path, F.lit(None).cast(kind[leaf].dataType)))
    return rows


Rule = Callable[[DataFrame, str], DataFrame]
#: Rules of one's own, (name, rule), applied after the built-in ones.
EXTRA_RULES: list[tuple[str, Rule]] = []


def derive_all(rows: DataFrame, record: str = "record", drop: tuple[str, ...] = (), counted: str | None = None) -> DataFrame:
    """Built-in rules, then EXTRA_RULES, then deletions."""
    out = derive(rows, record, counted=counted)
    for _, rule in EXTRA_RULES:
        out = rule(out, record)
    return delete_paths(out, record, drop)
