"""The canonical record: one nested struct that every format is read into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: F401

IDS = "map<string,struct<key:string,url:string>>"
NAMED = f"map<string,struct<identifiers:{IDS}>>"
ISSUE = "struct<name:string,number:decimal(12,3),suffix:string>"

#: Field -> type, as a DDL string (fixed values: the names of the canonical fields).
FIELDS = {
    "age_rating": "string", "alternate_images": "array<string>", "alternative_issue": ISSUE, "arcs": f"map<string,struct<number:int,identifiers:{IDS}>>", "bookmark": "int",
    "characters": NAMED, "collection_title": "string", "community_rating": "struct<average_rating:decimal(2,1),rating_count:int>", "country": "string", "cover_image": "string",
    "credits": f"map<string,struct<roles:{NAMED},identifiers:{IDS}>>", "credit_primaries": "map<string,string>", "critical_rating": "decimal(2,1)",
    "date": "struct<cover_date:date,store_date:date,year:int,month:int,day:int>", "ext": "string", "genres": NAMED, "identifiers": IDS, "identifier_primary_source": "struct<source:string,url:string>",
    "imprint": f"struct<name:string,identifiers:{IDS}>", "issue": ISSUE, "language": "string", "locations": NAMED, "manga": "string", "monochrome": "boolean", "notes": "string",
    "original_format": "string", "page_count": "int", "pages": "map<int,struct<bookmark:string,double_page:boolean,key:string,width:int,height:int,size:bigint,page_type:string>>",
    "prices": "map<string,decimal(12,2)>", "protagonist": "string", "publisher": f"struct<name:string,identifiers:{IDS}>", "reading_direction": "string", "remainders": "array<string>",
    "reprints": "array<struct<language:string,series:string,volume:string,issue:string>>", "review": "string", "rights": "string", "scan_info": "string",
    "series": f"struct<name:string,sort_name:string,start_year:int,volume_count:int,identifiers:{IDS}>", "series_groups": "array<string>", "stories": NAMED, "summary": "string", "tagger": "string",
    "tags": NAMED, "teams": NAMED, "title": "string", "universes": f"map<string,struct<designation:string,identifiers:{IDS}>>", "updated_at": "timestamp", "volume": "struct<number:int,number_to:int,issue_count:int>",
}
DDL = "struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">"
#: Fields whose arrays are sets: merging keeps distinct values.
SETS = ("alternate_images", "series_groups")


def canonical_type() -> StructType:
    """The canonical struct as a type."""
    return StructType.fromDDL(",".join(f"`{n}` {t}" for n, t in FIELDS.items()))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def record(**values: Column) -> Column:
    """A canonical struct; fields that are not given are null.  Empty strings become null."""
    unknown = set(values) - set(FIELDS)
    if unknown:
        raise ValueError(f"no canonical fields: {sorted(unknown)}")
    out = []
    for name, kind in FIELDS.items():
        value = values.get(name)
        if value is None:
            value = F.lit(None)
        elif kind == "string":
            value = F.nullif(F.trim(value.cast("string")), F.lit(""))
        out.append(value.cast(kind).alias(name))
    return F.struct(*out)


def to_map(entries: Column, kind: str) -> Column:
    """Map of an array of structs (k, v); the last entry of a key wins; null if there is none."""

    def unique(e: Column) -> Column:
        keys = F.array_distinct(F.transform(e, lambda x: x["k"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(e, lambda x: x["k"] == k), -1)["v"].alias("v"))))

    return let(entries, lambda e: F.when(F.size(e) > 0, unique(e))).cast(kind)


def named(names: Column) -> Column:
    """Map of distinct names without identifiers."""
    return to_map(F.transform(F.filter(names, lambda n: n.isNotNull() & (n != "")), lambda n: F.struct(n.alias("k"), F.struct(F.lit(None).cast(IDS).alias("identifiers")).alias("v"))), NAMED)


def credits_of(pairs: Column) -> Column:
    """Map person -> roles of an array of structs (person, role)."""

    def people(p: Column) -> Column:
        def person(name: Column) -> Column:
            roles = named(F.transform(F.filter(p, lambda x: x["person"] == name), lambda x: x["role"]))
            return F.struct(name.alias("k"), F.struct(roles.alias("roles"), F.lit(None).cast(IDS).alias("identifiers")).alias("v"))

        return to_map(F.transform(F.array_distinct(F.transform(p, lambda x: x["person"])), person), FIELDS["credits"])

    return let(pairs, people)


def some(value: Column, *parts: Column) -> Column:
    """``value`` if any of its parts is there, else null."""
    return F.when(F.coalesce(*[p.cast("string") for p in parts]).isNotNull(), value)
