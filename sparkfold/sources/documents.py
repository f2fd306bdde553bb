"""Readers and writers of metadata documents (F01 to F11, P01 to P07): payload column -> canonical struct and back.

All of them are column expressions (``from_xml``, ``from_json`` with explicit schemas, so unknown keys are
never read and Spark prunes what is not used), apart from YAML, which has no built-in reader.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import identifiers as I
from ..functions import numbers as N
from ..functions import text as T
from ..functions.constants import look_up
from . import canonical as C

#: Name of the root of the native documents.
NATIVE_ROOT = "record"

# Tags of the formats by canonical field.
COMIC_INFO_ROLES = ("Colorist", "CoverArtist", "Editor", "Inker", "Letterer", "Penciller", "Translator", "Writer")
COMIC_INFO_TEXT = ("Title", "Series", "Number", "Count", "Volume", "AlternateSeries", "AlternateNumber", "AlternateCount", "Summary", "Notes", "Year", "Month", "Day", "Publisher", "Imprint", "Genre", "Tags", "Web", "PageCount", "LanguageISO", "Format", "BlackAndWhite", "Manga", "Characters", "Teams", "Locations", "ScanInformation", "StoryArc", "StoryArcNumber", "SeriesGroup", "AgeRating", "CommunityRating", "MainCharacterOrTeam", "Review", "GTIN", "Country")
COMET_ROLES = {"colorist": "Colorist", "coverDesigner": "Cover", "creator": "Creator", "editor": "Editor", "inker": "Inker", "letterer": "Letterer", "penciller": "Penciller", "writer": "Writer"}
COMET_TEXT = ("coverImage", "date", "description", "format", "isVersionOf", "issue", "language", "lastMark", "pages", "price", "publisher", "rating", "readingDirection", "rights", "series", "title", "volume", "identifier")
PAGE_ATTRIBUTES = {"Bookmark": "bookmark", "DoublePage": "double_page", "Key": "key", "ImageWidth": "width", "ImageHeight": "height", "ImageSize": "size", "Type": "page_type"}
METRON_NAMES = {"Characters": "Character", "Genres": "Genre", "Tags": "Tag", "Teams": "Team", "Locations": "Location", "Stories": "Story"}


def _text(x: Column, name: str) -> Column:
    return F.nullif(F.trim(x[name].cast("string")), F.lit(""))


def _with_role(people: Column, role: str) -> Column:
    """Array of structs (person, role)."""
    return F.transform(people, lambda p: F.struct(F.trim(p).alias("person"), F.lit(role).alias("role")))


def _int(x: Column, name: str, low: int | None = None, high: int | None = None) -> Column:
    return N.integer(x[name], low, high).cast("int")


def _issue(name: Column) -> Column:
    full = F.nullif(T.issue_name(name), F.lit(""))
    return F.when(full.isNotNull(), F.struct(full.alias("name"), F.lit(None).cast("decimal(12,3)").alias("number"), F.lit(None).cast("string").alias("suffix")))


def _name(value: Column, kind: str) -> Column:
    """struct(name, null, ...) of a canonical struct type."""
    parts = [p.split(":")[0] for p in ("name", *[x for x in ("sort_name", "start_year", "volume_count", "identifiers") if f"{x}:" in kind])]
    return F.when(value.isNotNull(), F.struct(*[value.alias(p) if p == "name" else F.lit(None).alias(p) for p in parts]).cast(kind))


def _series(name: Column, sort: Column | None = None, start: Column | None = None, volumes: Column | None = None) -> Column:
    none = F.lit(None)
    value = F.struct(name.alias("name"), (none if sort is None else sort).alias("sort_name"), (none if start is None else start).alias("start_year"), (none if volumes is None else volumes).alias("volume_count"), none.alias("identifiers"))
    return C.some(value.cast(C.FIELDS["series"]), name, *(x for x in (sort, start, volumes) if x is not None))


def _volume(number: Column, count: Column | None = None, to: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    count, to = none if count is None else count, none if to is None else to
    return C.some(F.struct(number.alias("number"), to.alias("number_to"), count.alias("issue_count")), number, count)


def _date(year: Column, month: Column, day: Column, cover: Column | None = None, store: Column | None = None) -> Column:
    none = F.lit(None).cast("date")
    cover, store = none if cover is None else cover, none if store is None else store
    return C.some(F.struct(cover.alias("cover_date"), store.alias("store_date"), year.alias("year"), month.alias("month"), day.alias("day")), cover, store, year, month, day)


def identifiers_from_text(values: Column, default_source: str | None = None) -> Column:
    """Identifier map of an array of URNs and other spellings; what names no source is of the default one, or goes."""

    def parts(v: Column) -> Column:
        urn, other = I.parse_urn(v), I.parse_other(v)
        source = F.coalesce(I.source_of_alias(urn["source"]), other["source"], F.lit(default_source))
        return F.struct(source.alias("s"), F.coalesce(urn["type"], other["type"]).alias("t"), F.coalesce(urn["key"], other["key"]).alias("n"))

    def entry(v: Column) -> Column:
        return C.let(parts(v), lambda p: F.struct(p["s"].alias("k"), I.identifier(p["s"], p["t"], p["n"]).alias("v")))

    return C.to_map(F.filter(F.transform(values, entry), lambda e: e["k"].isNotNull() & e["v"]["key"].isNotNull()), C.IDS)


def identifiers_from_urls(urls: Column) -> Column:
    """Identifier map of an array of URLs; an unknown host is its own source."""

    def entry(u: Column) -> Column:
        def keyed(source: Column) -> Column:
            known = I.url_type_and_key(source, F.try_parse_url(u, F.lit("PATH")))
            return F.struct(source.alias("k"), F.struct(F.coalesce(known["key"], I.unknown_key(u)).alias("key"), u.alias("url")).alias("v"))

        return C.let(I.host_of(u), lambda host: C.let(I.source_of_host(host), keyed))

    return C.to_map(F.filter(F.transform(urls, entry), lambda e: e["k"].isNotNull()), C.IDS)


def merged_identifiers(explicit: Column, from_urls: Column) -> Column:
    """The explicit key before that of the URL, the real URL before a made one."""

    def both(p: Column) -> Column:
        zipped = F.map_zip_with(p["a"], p["b"], lambda k, a, b: F.struct(F.coalesce(a["key"], b["key"]).alias("key"), F.coalesce(b["url"], a["url"]).alias("url")))
        return F.coalesce(zipped, p["a"], p["b"])

    return C.let(F.struct(explicit.alias("a"), from_urls.alias("b")), both)


def _xml(payload: Column, schema: str) -> Column:
    return F.from_xml(payload, schema, {"mode": "PERMISSIVE"})


def once(read):
    """Makes a reader of a parser and a projection: the document is parsed once, its parts are projected from there."""
    parse, project = read()

    def reader(payload: Column) -> Column:
        return C.let(parse(payload), project)

    reader.__name__, reader.__doc__ = read.__name__, read.__doc__
    return reader


@once
def comic_info():
    """ComicInfo.xml"""
    page = ",".join(f"_{a}:string" for a in ("Image", *PAGE_ATTRIBUTES))
    schema = ",".join([*(f"`{n}` string" for n in COMIC_INFO_TEXT), *(f"`{r}` string" for r in COMIC_INFO_ROLES), f"Pages struct<Page:array<struct<{page}>>>"])

    def project(x: Column) -> Column:
        names = lambda tag: C.named(T.split_list(x[tag]))
        pairs = F.concat(*[_with_role(T.split_list(x[r]), r) for r in COMIC_INFO_ROLES])
        numbers = F.transform(T.split_list(x["StoryArcNumber"]), lambda n: n.try_cast("int"))
        arcs = F.transform(T.split_list(x["StoryArc"]), lambda n, i: F.struct(n.alias("k"), F.struct(F.get(numbers, i).alias("number"), F.lit(None).cast(C.IDS).alias("identifiers")).alias("v")))
        kinds = {"double_page": "boolean", "width": "int", "height": "int", "size": "bigint"}
        pages = F.transform(x["Pages"]["Page"], lambda p: F.struct(p["_Image"].try_cast("int").alias("k"), F.struct(*[p[f"_{a}"].try_cast(kinds.get(f, "string")).alias(f) for a, f in PAGE_ATTRIBUTES.items()]).alias("v")))
        pages = F.filter(pages, lambda e: e["k"].isNotNull())
        ids = merged_identifiers(identifiers_from_text(T.split_list(x["GTIN"], r"[,;\s]")), identifiers_from_urls(T.split_list(x["Web"], r"[,;\s]+")))
        alternate = _text(x, "AlternateSeries")
        reprints = F.when(alternate.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("language"), alternate.alias("series"), F.lit(None).cast("string").alias("volume"), _text(x, "AlternateNumber").alias("issue"))))
        yes = F.lower(_text(x, "BlackAndWhite"))
        bookmark = F.get(F.filter(pages, lambda p: p["v"]["bookmark"].isNotNull()), F.lit(0))["k"]
        return C.record(
            age_rating=_text(x, "AgeRating"), monochrome=F.when(yes.isin("yes", "true", "1"), True).when(yes.isin("no", "false", "0"), False), country=_text(x, "Country"), language=_text(x, "LanguageISO"),
            community_rating=F.when(_text(x, "CommunityRating").isNotNull(), F.struct(N.clamp(N.decimal(x["CommunityRating"], 1), 0, 5).alias("average_rating"), F.lit(None).cast("int").alias("rating_count"))),
            date=_date(_int(x, "Year"), _int(x, "Month", 0, 12), _int(x, "Day", 0, 31)), original_format=_text(x, "Format"), imprint=_name(_text(x, "Imprint"), C.FIELDS["imprint"]), protagonist=_text(x, "MainCharacterOrTeam"),
            manga=_text(x, "Manga"), notes=_text(x, "Notes"), issue=_issue(x["Number"]), page_count=_int(x, "PageCount"), publisher=_name(_text(x, "Publisher"), C.FIELDS["publisher"]), review=_text(x, "Review"),
            scan_info=_text(x, "ScanInformation"), series=_series(_text(x, "Series")), summary=_text(x, "Summary"), title=_text(x, "Title"), volume=_volume(_int(x, "Volume"), _int(x, "Count")),
            characters=names("Characters"), genres=names("Genre"), locations=names("Locations"), tags=names("Tags"), teams=names("Teams"), series_groups=F.when(_text(x, "SeriesGroup").isNotNull(), T.split_list(x["SeriesGroup"])),
            credits=C.credits_of(pairs), arcs=C.to_map(arcs, C.FIELDS["arcs"]), pages=C.to_map(pages, C.FIELDS["pages"]), bookmark=bookmark, identifiers=ids, reprints=reprints,
        )

    return lambda payload: _xml(payload, schema), project


@once
def metron_info():
    """MetronInfo.xml"""
    item = "array<struct<_VALUE:string,_id:string>>"
    schema = ",".join([
        "AgeRating string,AlternativeNumber string,CollectionTitle string,CoverDate string,StoreDate string,Notes string,Number string,PageCount string,Summary string,LastModified string,MangaVolume string",
        *(f"{outer} struct<{inner}:{item}>" for outer, inner in METRON_NAMES.items()),
        "IDS struct<ID:array<struct<_VALUE:string,_source:string,_primary:string>>>", "Publisher struct<_id:string,Name:string,Imprint:struct<_VALUE:string,_id:string>>",
        "Series struct<_id:string,_lang:string,Name:string,SortName:string,Volume:string,IssueCount:string,VolumeCount:string,Format:string,StartYear:string>",
        "Prices struct<Price:array<struct<_VALUE:string,_country:string>>>", "Arcs struct<Arc:array<struct<_id:string,Name:string,Number:string>>>", "Universes struct<Universe:array<struct<_id:string,Name:string,Designation:string>>>",
        "GTIN struct<ISBN:string,UPC:string>", "URLs struct<URL:array<struct<_VALUE:string,_primary:string>>>", "CommunityRating struct<AverageRating:string,RatingCount:string>",
        "Credits struct<Credit:array<struct<Creator:struct<_VALUE:string,_id:string>,Roles:struct<Role:array<struct<_VALUE:string,_id:string>>>>>>",
    ])

    def project(x: Column) -> Column:
        # The primary source is found first; ids on nested elements are of that source
        by_name = {"comic vine": "comicvine", "grand comics database": "grandcomicsdatabase", "league of comic geeks": "leagueofcomicgeeks", "panel syndicate": "panelsyndicate", "amazon": "asin"}
        source_of = lambda s: F.coalesce(look_up(by_name, F.lower(s)), I.source_of_alias(s))
        ids = F.transform(x["IDS"]["ID"], lambda i: F.struct(source_of(i["_source"]).alias("source"), i["_VALUE"].alias("key"), (F.lower(i["_primary"]) == "true").alias("primary")))
        known = C.let(ids, lambda r: F.struct(r.alias("rows"), F.coalesce(F.get(F.filter(r, lambda i: i["primary"]), F.lit(0))["source"], F.get(r, F.lit(0))["source"], F.lit("metron")).alias("primary")))
        return C.let(known, lambda k: body(x, k["rows"], k["primary"]))

    def body(x: Column, rows: Column, primary: Column) -> Column:
        series, publisher, none = x["Series"], x["Publisher"], F.lit(None)
        one_id = lambda kind, key: F.when(key.isNotNull(), F.create_map(primary, I.identifier(primary, F.lit(kind), key))).cast(C.IDS)
        explicit = F.transform(rows, lambda r: F.struct(r["source"].alias("k"), I.identifier(r["source"], F.lit("issue"), r["key"]).alias("v")))
        gtin = F.filter(F.array(*[F.struct(F.lit(s).alias("k"), I.identifier(F.lit(s), F.lit("issue"), x["GTIN"][t]).alias("v")) for s, t in (("isbn", "ISBN"), ("upc", "UPC"))]), lambda e: e["v"]["key"].isNotNull())
        ids = C.to_map(F.filter(F.concat(F.coalesce(explicit, F.slice(gtin, 1, 0)), gtin), lambda e: e["k"].isNotNull()), C.IDS)
        urls = identifiers_from_urls(F.coalesce(F.transform(x["URLs"]["URL"], lambda u: u["_VALUE"]), F.array().cast("array<string>")))

        def with_ids(tag: str, kind: str) -> Column:
            inner = METRON_NAMES[tag]
            return C.to_map(F.transform(F.filter(x[tag][inner], lambda i: i["_VALUE"].isNotNull()), lambda i: F.struct(F.trim(i["_VALUE"]).alias("k"), F.struct(one_id(kind, i["_id"]).alias("identifiers")).alias("v"))), C.NAMED)

        pairs = F.flatten(F.transform(x["Credits"]["Credit"], lambda c: F.transform(c["Roles"]["Role"], lambda r: F.struct(F.trim(c["Creator"]["_VALUE"]).alias("person"), F.trim(r["_VALUE"]).alias("role")))))
        arcs = F.transform(x["Arcs"]["Arc"], lambda a: F.struct(a["Name"].alias("k"), F.struct(a["Number"].try_cast("int").alias("number"), one_id("arc", a["_id"]).alias("identifiers")).alias("v")))
        universes = F.transform(x["Universes"]["Universe"], lambda u: F.struct(u["Name"].alias("k"), F.struct(u["Designation"].alias("designation"), one_id("universe", u["_id"]).alias("identifiers")).alias("v")))
        prices = F.transform(x["Prices"]["Price"], lambda p: F.struct(F.coalesce(p["_country"], F.lit("")).alias("k"), N.decimal(p["_VALUE"], 2).alias("v")))
        span = F.split(x["MangaVolume"], "-")
        number = F.coalesce(F.get(span, F.lit(0)).try_cast("int"), series["Volume"].try_cast("int"))
        rating = x["CommunityRating"]
        cover, store = N.parse_date(x["CoverDate"]), N.parse_date(x["StoreDate"])
        return C.record(
            age_rating=_text(x, "AgeRating"), alternative_issue=_issue(x["AlternativeNumber"]), collection_title=_text(x, "CollectionTitle"), date=_date(none.cast("int"), none.cast("int"), none.cast("int"), cover, store),
            notes=_text(x, "Notes"), issue=_issue(x["Number"]), page_count=_int(x, "PageCount"), summary=_text(x, "Summary"), updated_at=F.try_to_timestamp(x["LastModified"]), language=series["_lang"], original_format=series["Format"],
            series=F.when(series["Name"].isNotNull(), F.struct(series["Name"].alias("name"), series["SortName"].alias("sort_name"), series["StartYear"].try_cast("int").alias("start_year"), series["VolumeCount"].try_cast("int").alias("volume_count"), one_id("series", series["_id"]).alias("identifiers"))),
            volume=_volume(number, series["IssueCount"].try_cast("int"), F.get(span, F.lit(1)).try_cast("int")), publisher=F.when(publisher["Name"].isNotNull(), F.struct(publisher["Name"].alias("name"), one_id("publisher", publisher["_id"]).alias("identifiers"))),
            imprint=F.when(publisher["Imprint"]["_VALUE"].isNotNull(), F.struct(publisher["Imprint"]["_VALUE"].alias("name"), one_id("imprint", publisher["Imprint"]["_id"]).alias("identifiers"))),
            community_rating=F.when(rating["AverageRating"].isNotNull(), F.struct(N.decimal(rating["AverageRating"], 1).alias("average_rating"), rating["RatingCount"].try_cast("int").alias("rating_count"))),
            credits=C.credits_of(pairs), arcs=C.to_map(arcs, C.FIELDS["arcs"]), universes=C.to_map(universes, C.FIELDS["universes"]), prices=C.to_map(prices, C.FIELDS["prices"]),
            identifiers=merged_identifiers(ids, urls), identifier_primary_source=F.when(F.size(rows) > 0, F.struct(primary.alias("source"), none.cast("string").alias("url"))),
            characters=with_ids("Characters", "character"), genres=with_ids("Genres", "genre"), tags=with_ids("Tags", "tag"), teams=with_ids("Teams", "team"), locations=with_ids("Locations", "location"), stories=with_ids("Stories", "story"),
        )

    return lambda payload: _xml(payload, schema), project


@once
def comic_book_info():
    """ComicBookInfo JSON"""
    body = "comments:string,country:string,genre:string,issue:string,language:string,numberOfIssues:string,numberOfVolumes:string,pages:string,publicationDay:string,publicationMonth:string,publicationYear:string,publisher:string,rating:double,series:string,tags:array<string>,title:string,volume:string,credits:array<struct<person:string,role:string,primary:boolean>>"

    def project(x: Column) -> Column:
        b = x["ComicBookInfo/1.0"]
        role = lambda r: F.when(F.lower(r).isin("penciler", "penciller"), F.lit("Penciller")).otherwise(F.initcap(r))
        primaries = F.filter(b["credits"], lambda c: F.coalesce(c["primary"], F.lit(False)))
        return C.record(
            tagger=_text(x, "appID"), updated_at=F.try_to_timestamp(x["lastModified"]), summary=_text(b, "comments"), country=_text(b, "country"), issue=_issue(b["issue"]), language=_text(b, "language"), page_count=_int(b, "pages"),
            date=_date(_int(b, "publicationYear"), _int(b, "publicationMonth", 0, 12), _int(b, "publicationDay", 0, 31)), publisher=_name(_text(b, "publisher"), C.FIELDS["publisher"]), series=_series(_text(b, "series"), volumes=_int(b, "numberOfVolumes")),
            title=_text(b, "title"), volume=_volume(_int(b, "volume"), _int(b, "numberOfIssues")), critical_rating=F.when(b["rating"].isNotNull(), N.canonical_rating(b["rating"])),
            genres=C.named(T.split_list(b["genre"])), tags=C.named(b["tags"]), credits=C.credits_of(F.transform(b["credits"], lambda c: F.struct(F.trim(c["person"]).alias("person"), role(c["role"]).alias("role")))),
            credit_primaries=C.to_map(F.transform(primaries, lambda c: F.struct(role(c["role"]).alias("k"), c["person"].alias("v"))), "map<string,string>"),
        )

    return lambda payload: F.from_json(payload, f"`appID` string,`lastModified` string,`ComicBookInfo/1.0` struct<{body}>"), project


@once
def comet():
    """CoMet XML"""
    schema = ",".join([*(f"`{n}` string" for n in COMET_TEXT), "character array<string>", "genre array<string>", *(f"`{r}` array<string>" for r in COMET_ROLES)])

    def project(x: Column) -> Column:
        none = F.array().cast("array<struct<person:string,role:string>>")
        pairs = F.concat(*[F.coalesce(_with_role(x[tag], role), none) for tag, role in COMET_ROLES.items()])
        original = _text(x, "isVersionOf")
        reprints = F.when(original.isNotNull(), F.transform(T.split_list(original), lambda v: F.struct(F.lit(None).cast("string").alias("language"), F.trim(F.regexp_extract(v, r"^(.*?)(?:\s*#\S+)?$", 1)).alias("series"), F.lit(None).cast("string").alias("volume"), F.nullif(F.regexp_extract(v, r"#(\S+)$", 1), F.lit("")).alias("issue"))))
        price = N.decimal(x["price"], 2)
        empty = F.lit(None).cast("int")
        return C.record(
            cover_image=_text(x, "coverImage"), date=_date(empty, empty, empty, N.parse_date(x["date"])), summary=_text(x, "description"), original_format=_text(x, "format"), issue=_issue(x["issue"]), language=_text(x, "language"),
            bookmark=_int(x, "lastMark"), page_count=_int(x, "pages"), publisher=_name(_text(x, "publisher"), C.FIELDS["publisher"]), age_rating=_text(x, "rating"), reading_direction=_text(x, "readingDirection"), rights=_text(x, "rights"),
            series=_series(_text(x, "series")), title=_text(x, "title"), volume=_volume(_int(x, "volume")), characters=C.named(x["character"]), genres=C.named(x["genre"]), credits=C.credits_of(pairs),
            identifiers=identifiers_from_text(T.split_list(x["identifier"]), "comicvine"), prices=F.when(price.isNotNull(), F.create_map(F.lit(""), price)), reprints=reprints,
        )

    return lambda payload: _xml(payload, schema), project


def pdf_xml(payload: Column) -> Column:
    """Document information of a PDF as XMP"""
    tags = ("pdf:Author", "pdf:Creator", "pdf:Keywords", "pdf:ModDate", "pdf:Producer", "pdf:Subject", "pdf:Title")
    body = ",".join(f"`{t}`:string" for t in tags)
    x = _xml(payload, f"`rdf:RDF` struct<`rdf:Description`:struct<{body}>>")["rdf:RDF"]["rdf:Description"]
    return C.let(x, lambda v: _pdf(v, *tags))


def mupdf(payload: Column) -> Column:
    """Document information of a PDF as JSON"""
    tags = ("author", "creator", "keywords", "modDate", "producer", "subject", "title")
    x = F.from_json(payload, "MuPDF struct<" + ",".join(f"{t}:string" for t in tags) + ">")["MuPDF"]
    return C.let(x, lambda v: _pdf(v, *tags))


def pdf_time(x: Column) -> Column:
    """A time such as D:YYYYMMDDHHMMSS, or ISO 8601; null if it is neither."""
    digits = F.regexp_extract(x, r"^D:(\d{14})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(F.when(~x.startswith("D:"), x)))


def _pdf(x: Column, author: str, creator: str, keywords: str, modified: str, producer: str, subject: str, title: str) -> Column:
    pairs = F.transform(T.split_list(x[author]), lambda p: F.struct(p.alias("person"), F.lit("Writer").alias("role")))
    return C.record(scan_info=_text(x, creator), tagger=_text(x, producer), updated_at=pdf_time(x[modified]), title=_text(x, title), tags=C.named(T.split_list(x[keywords])), genres=C.named(T.split_list(x[subject])), credits=C.credits_of(pairs))


def filename(payload: Column) -> Column:
    """series, issue, year, title, volume, format and scan information of a file name."""
    base = F.element_at(F.split(payload, r"[/\\]"), -1)
    ext = F.nullif(F.regexp_extract(base, r"\.([A-Za-z0-9]{2,4})$", 1), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[A-Za-z0-9]{2,4}$", ""), "_", " ")
    year = F.regexp_extract(stem, r"\((?:[A-Za-z]{3,9}\.?,?\s+)?(\d{4})\)", 1)
    volume = F.regexp_extract(stem, r"(?i)\b(?:v|vol\.?|volume)\s*(\d+)\b", 1)
    issue = F.regexp_extract(stem, r"#\s*([0-9]+(?:\.[0-9]+)?[A-Za-z½]*)", 1)
    bare = F.regexp_extract(stem, r"\s([0-9]{1,4}(?:\.[0-9]+)?)\s*(?:\(|$)", 1)
    issue = F.when(issue != "", issue).otherwise(bare)
    count = F.regexp_extract(stem, r"(?i)\(?of\s+(\d+)\)?", 1)
    kind = F.regexp_extract(stem, r"(?i)\b(annual|digital|tpb|one-shot|hardcover|omnibus|trade paperback)\b", 1)
    series = F.trim(F.regexp_extract(stem, r"(?i)^(.*?)(?:\s*(?:#\s*\d|\(|\bv(?:ol)?\.?\s*\d|\s\d{1,4}\s*(?:\(|$)).*|\s*)$", 1))
    tail = F.trim(F.regexp_extract(stem, r"\(\d{4}\)\s*([^()]*)", 1))
    title = F.trim(F.regexp_extract(tail, r"^(.*?)(?:\s+-\s+.*)?$", 1))
    rest = F.trim(F.regexp_extract(tail, r"\s-\s(.*)$", 1))
    groups = F.filter(F.regexp_extract_all(stem, F.lit(r"\(([^()]*)\)"), 1), lambda g: ~g.rlike(r"\d{4}$|(?i)^of\s"))
    scan = F.get(groups, F.greatest(F.size(groups) - 1, F.lit(0)))
    blank = lambda c: F.nullif(c, F.lit(""))
    empty = F.lit(None).cast("int")
    return C.record(
        ext=ext, issue=_issue(issue), series=_series(blank(series)), title=title, volume=_volume(blank(volume).try_cast("int"), blank(count).try_cast("int")), date=_date(blank(year).try_cast("int"), empty, empty),
        original_format=kind, scan_info=scan, remainders=F.when(rest != "", F.array(rest)),
    )


def native_json(payload: Column, root: str = NATIVE_ROOT) -> Column:
    """Native JSON: the canonical record below its root; bad fields become null."""
    # JSON has text keys only; those of the pages are numbers, zero-filled or not
    read = F.from_json(payload, f"`{root}` {C.DDL.replace('map<int,', 'map<string,')}", {"mode": "PERMISSIVE"})[root]

    def project(x: Column) -> Column:
        pages = F.map_filter(F.transform_keys(x["pages"], lambda k, v: F.coalesce(k.try_cast("int"), F.lit(-1))), lambda k, v: k >= 0)
        return F.when(x.isNotNull(), C.record(**{n: pages if n == "pages" else x[n] for n in C.FIELDS}))

    return C.let(read, project)


@F.pandas_udf(StringType())
def yaml_to_json(payloads: pd.Series) -> pd.Series:
    """a YAML document as JSON; null if it is none."""
    import json

    import yaml

    def one(text: str | None) -> str | None:
        try:
            value = yaml.safe_load(text) if text else None
        except yaml.YAMLError:
            return None
        return json.dumps(value, default=str) if isinstance(value, dict) else None

    return payloads.map(one)


def native_yaml(payload: Column, root: str = NATIVE_ROOT) -> Column:
    return native_json(yaml_to_json(payload), root)


def line_text(payload: Column, root: str = NATIVE_ROOT) -> Column:
    """One line of YAML in braces and below its root, whether it was given so or not."""
    braced = F.when(F.trim(payload).startswith("{"), payload).otherwise(F.concat(F.lit("{"), payload, F.lit("}")))
    return F.when(braced.rlike(rf"^\s*\{{\s*['\"]?{root}['\"]?\s*:"), braced).otherwise(F.concat(F.lit(f"{{{root}: "), braced, F.lit("}")))


def native_line(payload: Column, root: str = NATIVE_ROOT) -> Column:
    """One line of YAML, in braces or not, with its root or without."""
    return native_yaml(line_text(payload, root), root)


@once
def page_list():
    """The sizes of a container's pages, in order."""

    def project(x: Column) -> Column:
        kind = C.canonical_type()["pages"].dataType.valueType
        page = lambda n: F.struct(*[(F.when(n >= 0, n) if f.name == "size" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
        pages = F.transform(x["sizes"], lambda n, i: F.struct(i.alias("k"), page(n).alias("v")))
        return F.when(x["sizes"].isNotNull(), C.record(page_count=F.size(x["sizes"]), pages=C.to_map(pages, C.FIELDS["pages"])))

    return lambda payload: F.from_json(payload, "sizes array<bigint>"), project


Reader = Callable[[Column], Column]
#: Format -> reader, in order of precedence within one source (the first wins).  Add to it to plug a format in.
READERS: dict[str, Reader] = {
    "native_yaml": native_yaml, "native_json": native_json, "native_line": native_line, "metron_info": metron_info, "comic_info": comic_info, "comet": comet,
    "comic_book_info": comic_book_info, "mupdf": mupdf, "pdf_xml": pdf_xml, "filename": filename, "page_list": page_list,
}
# Order of precedence by source, the first wins.
PRIORITIES = {
    "archive_file": ("native_yaml", "native_json", "native_line", "metron_info", "comic_info", "comet", "comic_book_info"),
    "config": ("native_yaml", "metron_info", "comic_info", "comic_book_info", "comet", "mupdf", "filename"),
    "cli": ("native_line", "metron_info", "comic_info", "comic_book_info", "mupdf", "comet"),
    "api": ("native_line", "native_yaml", "native_json", "metron_info", "comic_info", "comic_book_info", "comet", "mupdf", "pdf_xml", "filename"),
}
#: Sources in order of precedence, the last wins.  What a container's pages say stands above all.
SOURCES = ("config", "archive_filename", "archive_comment", "archive_pdf", "archive_file", "import_file", "metron_api", "comicvine_api", "cli", "api", "archive_pages")
#: Text that a format is read from as YAML; all others have readers of their own.
YAML_TEXT: dict[str, Callable[[Column], Column]] = {"native_yaml": lambda payload: payload, "native_line": line_text}


def guess_format(name: Column) -> Column:
    """format by file name."""
    low = F.lower(name)
    return (
        F.when(low.contains("comicinfo"), "comic_info").when(low.contains("metroninfo"), "metron_info").when(low.contains("comic-book-info"), "comic_book_info")
        .when(low.contains("comet"), "comet").when(low.contains("mupdf"), "mupdf").when(low.contains("pdf") & low.endswith(".xml"), "pdf_xml")
        .when(low.endswith(".json"), "native_json").when(low.rlike(r"\.ya?ml$"), F.when(low.contains("cli"), "native_line").otherwise("native_yaml")).when(low.endswith(".txt"), "filename")
    )


def sniff_format(payload: Column) -> Column:
    """format by content, where nothing else tells it; comments and declarations before the root don't count."""
    head = F.regexp_replace(F.trim(payload), r"^(?s)(?:\s|<\?.*?\?>|<!--.*?-->|<![^>]*>)+", "")
    return (
        F.when(head.rlike(r"^<ComicInfo[\s>/]"), "comic_info").when(head.rlike(r"^<MetronInfo[\s>/]"), "metron_info").when(head.rlike(r"^<comet[\s>/]"), "comet").when(head.rlike(r"^<(?:x:xmpmeta|rdf:RDF)[\s>]"), "pdf_xml")
        .when(head.contains('"ComicBookInfo/1.0"'), "comic_book_info").when(head.contains('"MuPDF"'), "mupdf").when(head.rlike(rf'^\{{\s*"{NATIVE_ROOT}"'), "native_json").when(head.rlike(rf"^(?:#.*\n|\s)*{NATIVE_ROOT}:"), "native_yaml")
        .when(head.startswith("{"), "native_line").when(~T.looks_like_document(payload), "filename")
    )


_BUILT: dict[tuple, Column] = {}


def record_of(name: str, text: Column, column: str) -> Column:
    """The record that a format's reader makes of a named column; built once in a session, as a reader takes thousands of calls."""
    from pyspark import SparkContext

    key = id(SparkContext._active_spark_context), name, READERS[name], column
    if key not in _BUILT:
        _BUILT[key] = READERS[name](text)
    return _BUILT[key]


def merge_rank(source: Column, fmt: Column) -> Column:
    """place of a document in the merge, by source and then by format; later ones win."""
    rank = F.lit(0)
    for i, name in enumerate(SOURCES):
        order = PRIORITIES.get(name, tuple(READERS))
        table = {f: 1000 * (i + 1) + 100 - j for j, f in enumerate(order)}
        rank = F.when(source == name, F.coalesce(look_up(table, fmt), F.lit(0))).otherwise(rank)
    return rank


def normalize(raw: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Rows (path, source, fmt, ordinal, payload) with their canonical ``record`` and merge ``rank``.

    A format that is missing is guessed from the content.  All formats are read in one projection over one scan:
    each row by its own format's expression, YAML after one pass through its parser.  A payload that cannot be
    read gives a null record and an ``error``.
    """
    known = list(formats or READERS)
    rows = raw.withColumn("fmt", F.coalesce("fmt", sniff_format(F.col("payload")))).where(F.col("fmt").isin(*known))
    text, yaml = F.col("payload"), [f for f in known if f in YAML_TEXT]
    if yaml:
        as_yaml = F.lit(None).cast("string")
        for name in yaml:
            as_yaml = F.when(F.col("fmt") == name, YAML_TEXT[name](text)).otherwise(as_yaml)
        rows = rows.withColumn("yaml_as_json", yaml_to_json(as_yaml))
    record = F.lit(None).cast(C.DDL)
    for name in reversed(known):
        record = F.when(F.col("fmt") == name, record_of("native_json", F.col("yaml_as_json"), "yaml_as_json") if name in yaml else record_of(name, text, "payload")).otherwise(record)
    rows = rows.withColumn("record", record).drop("yaml_as_json").withColumn("rank", merge_rank(F.col("source"), F.col("fmt")))
    return rows.withColumn("error", F.when(F.col("record").isNull() & F.col("payload").isNotNull(), F.concat(F.lit("cannot read "), "fmt")))


def to_native_json(record: Column, root: str = NATIVE_ROOT) -> Column:
    """Native JSON without empty fields; page numbers have the width of the greatest one."""
    # as text, so that their order is that of the numbers
    width = F.length(F.array_max(F.map_keys(record["pages"])).cast("string"))
    pages = F.map_from_entries(F.transform(F.array_sort(F.map_entries(record["pages"])), lambda e: F.struct(F.lpad(e["key"].cast("string"), width, F.lit("0")).alias("key"), e["value"].alias("value"))))
    kept = [(F.when(F.size(record["pages"]) > 0, pages) if n == "pages" else record[n]).alias(n) for n in C.FIELDS]
    return F.to_json(F.struct(F.struct(*kept).alias(root)))


def _names(value: Column) -> Column:
    return F.nullif(F.array_join(F.array_sort(F.map_keys(value)), ","), F.lit(""))


def _people(record: Column, role: str) -> Column:
    folk = F.map_filter(record["credits"], lambda k, v: F.coalesce(F.exists(F.map_keys(v["roles"]), lambda r: F.lower(F.replace(r, F.lit(" "), F.lit(""))) == role.lower()), F.lit(False)))
    return _names(folk)


def to_comic_info(record: Column) -> Column:
    """ComicInfo.xml in the order of its schema."""
    r = record
    pages = F.transform(F.array_sort(F.map_entries(r["pages"])), lambda e: F.struct(e["key"].alias("_Image"), *[e["value"][f].alias(f"_{a}") for a, f in PAGE_ATTRIBUTES.items()]))
    arcs = F.map_entries(r["arcs"])
    gtin = F.array_join(F.array_sort(F.transform(F.map_entries(r["identifiers"]), lambda e: I.urn_of(e["key"], F.lit("issue"), e["value"]["key"]))), ",")
    web = F.array_join(F.array_sort(F.filter(F.transform(F.map_values(r["identifiers"]), lambda v: v["url"]), lambda u: u.isNotNull())), " ")
    blank = lambda c: F.nullif(c, F.lit(""))
    first = F.get(r["reprints"], F.lit(0))
    fields = [
        ("Title", r["title"]), ("Series", r["series"]["name"]), ("Number", r["issue"]["name"]), ("Count", r["volume"]["issue_count"]), ("Volume", r["volume"]["number"]), ("AlternateSeries", first["series"]), ("AlternateNumber", first["issue"]),
        ("Summary", r["summary"]), ("Notes", r["notes"]), ("Year", r["date"]["year"]), ("Month", r["date"]["month"]), ("Day", r["date"]["day"]), *[(x, _people(r, x)) for x in ("Writer", "Penciller", "Inker", "Colorist", "Letterer", "CoverArtist", "Editor", "Translator")],
        ("Publisher", r["publisher"]["name"]), ("Imprint", r["imprint"]["name"]), ("Genre", _names(r["genres"])), ("Tags", _names(r["tags"])), ("Web", blank(web)), ("PageCount", r["page_count"]), ("LanguageISO", r["language"]), ("Format", r["original_format"]),
        ("Manga", r["manga"]), ("Characters", _names(r["characters"])), ("Teams", _names(r["teams"])), ("Locations", _names(r["locations"])), ("ScanInformation", r["scan_info"]), ("StoryArc", blank(F.array_join(F.transform(arcs, lambda e: e["key"]), ","))),
        ("StoryArcNumber", blank(F.array_join(F.transform(arcs, lambda e: e["value"]["number"].cast("string")), ","))), ("AgeRating", r["age_rating"]), ("Pages", F.when(F.size(pages) > 0, F.struct(pages.alias("Page")))), ("CommunityRating", r["community_rating"]["average_rating"]),
        ("MainCharacterOrTeam", r["protagonist"]), ("Review", r["review"]), ("GTIN", blank(gtin)),
    ]
    return F.to_xml(F.struct(*[value.alias(tag) for tag, value in fields]), {"rowTag": "ComicInfo", "declaration": ""})


def to_comic_book_info(record: Column) -> Column:
    """ComicBookInfo JSON."""
    r = record
    rows = F.flatten(F.transform(F.array_sort(F.transform(F.map_entries(r["credits"]), lambda e: F.struct(e["key"].alias("person"), F.array_sort(F.map_keys(e["value"]["roles"])).alias("roles")))), lambda c: F.transform(c["roles"], lambda role: F.struct(c["person"].alias("person"), F.coalesce(F.element_at(r["credit_primaries"], role) == c["person"], F.lit(False)).alias("primary"), role.alias("role")))))
    body = F.struct(
        rows.alias("credits"), _names(r["genres"]).alias("genre"), r["issue"]["name"].try_cast("int").alias("issue"), r["language"].alias("language"), r["volume"]["issue_count"].alias("numberOfIssues"), r["series"]["volume_count"].alias("numberOfVolumes"), r["page_count"].alias("pages"), r["date"]["day"].alias("publicationDay"),
        r["date"]["month"].alias("publicationMonth"), r["date"]["year"].alias("publicationYear"), r["publisher"]["name"].alias("publisher"), N.rating_of_ten(r["critical_rating"]).alias("rating"), r["series"]["name"].alias("series"), F.array_sort(F.map_keys(r["tags"])).alias("tags"), r["title"].alias("title"), r["volume"]["number"].alias("volume"), r["summary"].alias("comments"), r["country"].alias("country"),
    )
    return F.to_json(F.struct(r["tagger"].alias("appID"), N.iso_seconds(r["updated_at"]).alias("lastModified"), body.alias("ComicBookInfo/1.0")))


def to_comet(record: Column) -> Column:
    """CoMet XML."""
    r = record
    folk = lambda role: F.array_sort(F.map_keys(F.map_filter(r["credits"], lambda k, v: F.coalesce(F.array_contains(F.map_keys(v["roles"]), role), F.lit(False)))))
    some = lambda a: F.when(F.size(a) > 0, a)
    fields = [("title", r["title"]), ("series", r["series"]["name"]), ("issue", r["issue"]["name"]), ("volume", r["volume"]["number"]), ("publisher", r["publisher"]["name"]), ("date", r["date"]["cover_date"]), ("genre", some(F.array_sort(F.map_keys(r["genres"])))), ("character", some(F.array_sort(F.map_keys(r["characters"])))), ("price", F.element_at(F.map_values(r["prices"]), 1)), ("format", r["original_format"]), ("language", r["language"]), ("rating", r["age_rating"]), ("rights", r["rights"]), ("pages", r["page_count"]), ("description", r["summary"]), ("coverImage", r["cover_image"]), ("lastMark", r["bookmark"]), ("readingDirection", r["reading_direction"]), *[(tag, some(folk(role))) for tag, role in COMET_ROLES.items()]]
    return F.to_xml(F.struct(*[value.alias(tag) for tag, value in fields]), {"rowTag": "comet", "declaration": ""})


WRITERS: dict[str, Callable[[Column], Column]] = {"native_json": to_native_json, "comic_info": to_comic_info, "comic_book_info": to_comic_book_info, "comet": to_comet}


def render(rows: DataFrame, formats: list[str], record: str = "record") -> DataFrame:
    """One text column for each format."""
    return rows.withColumns({f: WRITERS[f](F.col(record)) for f in formats})
