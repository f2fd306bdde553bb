"""Readers of the entries of two catalogs, as their interfaces give them in JSON.

Importing this module adds the formats ``metron_api`` and ``comicvine_api`` to ``documents.READERS``; a
catalog is a table of such documents, whatever has copied it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import enums as E
from ..functions import identifiers as I
from ..functions import numbers as N
from ..functions import text as T
from . import canonical as C
from . import documents as D

_NAMED = "array<struct<id:bigint,name:string>>"
# Cover images in order of preference.
COVERS = ("medium_url", "screen_url", "super_url", "original_url", "small_url", "thumbnail")


def _ids(source: str, kind: str, key: Column) -> Column:
    return F.when(key.isNotNull(), F.create_map(F.lit(source), I.identifier(F.lit(source), F.lit(kind), key.cast("string")))).cast(C.IDS)


def _with_ids(items: Column, source: str, kind: str, extra: str = "") -> Column:
    """Names with their ids; the first entry of a name counts, so the array is read from its end."""
    kept = F.filter(F.reverse(items), lambda i: F.coalesce(i["name"], F.lit("")) != "")
    value = (lambda i: F.struct(F.lit(None).cast("int").alias("number"), _ids(source, kind, i["id"]).alias("identifiers"))) if extra == "arcs" else (lambda i: F.struct(F.lit(None).cast("string").alias("designation"), _ids(source, kind, i["id"]).alias("identifiers"))) if extra == "universes" else (lambda i: F.struct(_ids(source, kind, i["id"]).alias("identifiers")))
    return C.to_map(F.transform(kept, lambda i: F.struct(i["name"].alias("k"), value(i).alias("v"))), C.FIELDS[extra] if extra else C.NAMED)


def alternative_names(names: Column, primary: Column) -> Column:
    """Stripped names without empty ones, without case duplicates and without the primary name, in order."""
    kept = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: (n != "") & ~F.coalesce(F.lower(n) == F.lower(F.trim(primary)), F.lit(False)))

    def distinct(k: Column) -> Column:
        low = F.transform(k, lambda n: F.lower(n))
        return F.filter(k, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)

    return C.let(kept, distinct)


def _reprints(first: Column, names: Column) -> Column:
    more = F.transform(names, lambda n: F.struct(F.lit(None).cast("string").alias("language"), n.alias("series"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("issue")))
    none = F.slice(more, 1, 0)
    both = F.concat(F.coalesce(first, none), F.coalesce(more, none)) if first is not None else more
    return C.let(both, lambda b: F.when(F.size(b) > 0, b)).cast(C.FIELDS["reprints"])


def _credits(people: Column, name: str, roles, source: str) -> Column:
    """Person -> roles and id; a person's roles are united, the first id stays."""
    rows = F.filter(F.transform(people, lambda c: F.struct(c[name].alias("person"), c["id"].alias("id"), roles(c).alias("roles"))), lambda c: F.coalesce(c["person"], F.lit("")) != "")

    def folded(p: Column) -> Column:
        def one(who: Column) -> Column:
            mine = F.filter(p, lambda x: x["person"] == who)
            ids = F.get(F.filter(F.transform(mine, lambda x: x["id"]), lambda i: i.isNotNull()), F.lit(0))
            named = C.named(F.array_distinct(F.flatten(F.transform(mine, lambda x: F.coalesce(x["roles"], F.array().cast("array<string>"))))))
            return F.struct(who.alias("k"), F.struct(named.alias("roles"), _ids(source, "creator", ids).alias("identifiers")).alias("v"))

        return C.to_map(F.transform(F.array_distinct(F.transform(p, lambda x: x["person"])), one), C.FIELDS["credits"])

    return C.let(rows, folded)


def _block(x: Column, kind: str) -> Column:
    return D._name(F.nullif(x["name"], F.lit("")), C.FIELDS[kind])


def _rooted(fields: dict[str, str], root: str):
    """Parses a document below its root or without it."""
    plain, nested = ",".join(f"`{n}` {t}" for n, t in fields.items()), ",".join(f"`{n}`:{t}" for n, t in fields.items())
    return lambda payload: F.coalesce(F.from_json(payload, f"`{root}` struct<{nested}>")[root], F.from_json(payload, plain))


@D.once
def metron_api():
    """An issue of catalog A"""
    fields = {
        "id": "bigint", "cv_id": "bigint", "gcd_id": "bigint", "isbn": "string", "upc": "string", "number": "string", "alt_number": "string", "cover_date": "string", "store_date": "string", "image": "string", "modified": "string",
        "page_count": "int", "collection_title": "string", "desc": "string", "rating": "struct<name:string>", "average_rating": "string", "rating_count": "int", "price": "string", "price_currency": "string", "story_titles": "array<string>",
        "publisher": "struct<id:bigint,name:string>", "imprint": "struct<id:bigint,name:string>", "characters": _NAMED, "teams": _NAMED, "arcs": _NAMED, "universes": _NAMED,
        "series": f"struct<id:bigint,name:string,sort_name:string,year_began:int,volume:int,language:string,alt_names:array<string>,genres:{_NAMED}>",
        "credits": f"array<struct<id:bigint,creator:string,role:{_NAMED}>>", "reprints": "array<struct<id:bigint,issue:string>>",
    }
    source = "metron"

    def project(x: Column) -> Column:
        series, empty, none = x["series"], F.lit(""), F.lit(None).cast("int")
        ids = F.filter(F.array(*[F.struct(F.lit(s).alias("k"), I.identifier(F.lit(s), F.lit("issue"), F.nullif(x[f].cast("string"), empty)).alias("v")) for s, f in (("metron", "id"), ("comicvine", "cv_id"), ("grandcomicsdatabase", "gcd_id"), ("isbn", "isbn"), ("upc", "upc"))]), lambda e: e["v"]["key"].isNotNull())
        money = N.decimal(x["price"], 2)
        average = N.decimal(x["average_rating"], 1)
        first = F.transform(F.filter(x["reprints"], lambda e: F.coalesce(e["issue"], empty) != ""), lambda e: F.struct(F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("series"), F.lit(None).cast("string").alias("volume"), e["issue"].alias("issue")))
        found = C.record(
            issue=D._issue(x["number"]), alternative_issue=D._issue(x["alt_number"]), date=D._date(none, none, none, N.parse_date(x["cover_date"]), N.parse_date(x["store_date"])), cover_image=x["image"], updated_at=F.try_to_timestamp(x["modified"]),
            page_count=x["page_count"], collection_title=x["collection_title"], summary=T.strip_html(x["desc"]), age_rating=x["rating"]["name"], language=series["language"], volume=D._volume(series["volume"]), publisher=_block(x["publisher"], "publisher"), imprint=_block(x["imprint"], "imprint"),
            community_rating=F.when(average.isNotNull(), F.struct(N.clamp(average, 0, 5).alias("average_rating"), F.when(x["rating_count"] > 0, x["rating_count"]).alias("rating_count"))),
            series=F.when(series["name"].isNotNull() | series["id"].isNotNull(), F.struct(F.nullif(series["name"], empty).alias("name"), F.nullif(series["sort_name"], empty).alias("sort_name"), series["year_began"].alias("start_year"), none.alias("volume_count"), _ids(source, "series", series["id"]).alias("identifiers"))),
            prices=F.when(money.isNotNull(), F.create_map(F.coalesce(E.country_of_currency(x["price_currency"]), empty), money)), stories=C.named(x["story_titles"]), characters=_with_ids(x["characters"], source, "character"), teams=_with_ids(x["teams"], source, "team"),
            arcs=_with_ids(x["arcs"], source, "arc", "arcs"), universes=_with_ids(x["universes"], source, "universe", "universes"), genres=C.named(F.transform(series["genres"], lambda g: g["name"])),
            credits=_credits(x["credits"], "creator", lambda c: F.transform(c["role"], lambda r: r["name"]), source), reprints=_reprints(first, alternative_names(series["alt_names"], series["name"])), identifiers=C.to_map(ids, C.IDS),
        )
        return F.when(x["id"].isNotNull() | x["number"].isNotNull() | series.isNotNull(), found)

    return _rooted(fields, "metron_api"), project


@D.once
def comicvine_api():
    """An issue of catalog B; its volume is a series"""
    fields = {
        "id": "bigint", "number": "string", "name": "string", "cover_date": "string", "store_date": "string", "image": "struct<" + ",".join(f"{c}:string" for c in COVERS) + ">", "date_last_updated": "string", "description": "string",
        "volume": "struct<id:bigint,name:string,aliases:string>", "publisher": "struct<id:bigint,name:string>", "characters": _NAMED, "teams": _NAMED, "story_arcs": _NAMED, "locations": _NAMED, "creators": "array<struct<id:bigint,name:string,roles:string>>",
    }
    source = "comicvine"

    def project(x: Column) -> Column:
        volume, empty, none = x["volume"], F.lit(""), F.lit(None).cast("int")
        found = C.record(
            issue=D._issue(x["number"]), title=x["name"], date=D._date(none, none, none, N.parse_date(x["cover_date"]), N.parse_date(x["store_date"])), cover_image=F.coalesce(*[F.nullif(x["image"][c], empty) for c in COVERS]),
            updated_at=F.try_to_timestamp(x["date_last_updated"]), summary=T.strip_html(x["description"]), publisher=_block(x["publisher"], "publisher"), characters=_with_ids(x["characters"], source, "character"), teams=_with_ids(x["teams"], source, "team"),
            series=F.when(volume["name"].isNotNull() | volume["id"].isNotNull(), F.struct(F.nullif(volume["name"], empty).alias("name"), F.lit(None).cast("string").alias("sort_name"), none.alias("start_year"), none.alias("volume_count"), _ids(source, "series", volume["id"]).alias("identifiers"))),
            arcs=_with_ids(x["story_arcs"], source, "arc", "arcs"), locations=_with_ids(x["locations"], source, "location"), credits=_credits(x["creators"], "name", lambda c: T.split_list(c["roles"], ","), source),
            reprints=_reprints(None, alternative_names(F.split(volume["aliases"], r"\r?\n"), volume["name"])), identifiers=C.to_map(F.filter(F.array(F.struct(F.lit(source).alias("k"), I.identifier(F.lit(source), F.lit("issue"), x["id"].cast("string")).alias("v"))), lambda e: e["v"]["key"].isNotNull()), C.IDS),
        )
        return F.when(x["id"].isNotNull() | x["number"].isNotNull() | volume.isNotNull(), found)

    return _rooted(fields, "comicvine_api"), project


D.READERS.update({"metron_api": metron_api, "comicvine_api": comicvine_api})
