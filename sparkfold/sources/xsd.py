"""XML Schema documents of the XML formats, from a short notation, and their way to the executors.

An element is a kind or a dict of its children; ``?`` behind a kind says that it may be missing, ``*`` that it
may come any number of times.  Keys that begin with ``@`` are attributes, ``=`` is the kind of the text beside
attributes.  Children come in any order.  XML Schema 1.0 cannot say "any order, this one once" where another
child repeats; there ``once`` gives what is left to count.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import SparkSession

TYPES = {"text": "string", "count": "nonNegativeInteger", "positive": "positiveInteger", "int": "int", "long": "long", "date": "date", "time": "dateTime", "number": "decimal", "flag": "boolean", "year": "gYear", "language": "language"}
XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'


def _listed(inner: str) -> dict:
    """A list of named things that may have an id."""
    return {f"{inner}*": {"=": "text", "@id": "text?"}}


# Elements of the formats, their kinds and bounds.
COMIC_INFO = {
    **{f"{n}?": "text" for n in ("Title", "Series", "Number", "AlternateSeries", "AlternateNumber", "Summary", "Notes", "Writer", "Penciller", "Inker", "Colorist", "Letterer", "CoverArtist", "Editor", "Translator", "Publisher", "Imprint", "Genre", "Tags", "Web", "LanguageISO", "Format", "Characters", "Teams", "Locations", "ScanInformation", "StoryArc", "StoryArcNumber", "SeriesGroup", "MainCharacterOrTeam", "Review", "GTIN", "Country")},
    **{f"{n}?": "int" for n in ("Count", "Volume", "AlternateCount", "Year", "Month", "Day", "PageCount")},
    "AgeRating?": "Unknown|Adults Only 18+|Early Childhood|Everyone|Everyone 10+|G|Kids to Adults|M|MA15+|Mature 17+|PG|R18+|Rating Pending|Teen|X18+", "BlackAndWhite?": "Unknown|No|Yes", "Manga?": "Unknown|No|Yes|YesAndRightToLeft", "CommunityRating?": "number 0..5",
    "Pages?": {"Page*": {"@Image": "int", "@Type": "list FrontCover|InnerCover|Roundup|Story|Advertisement|Editorial|Letters|Preview|BackCover|Other|Deleted?", "@DoublePage": "flag?", "@ImageSize": "long?", "@Key": "text?", "@Bookmark": "text?", "@ImageWidth": "int?", "@ImageHeight": "int?"}},
}
METRON_INFO = {
    **{f"{n}?": "text" for n in ("MangaVolume", "CollectionTitle", "Number", "AlternativeNumber", "Summary", "Notes", "AgeRating")}, "CoverDate?": "date", "StoreDate?": "date", "PageCount?": "count", "LastModified?": "time",
    "IDS?": {"ID*": {"=": "text", "@source": "text", "@primary": "flag?"}}, "Publisher?": {"Name": "text", "Imprint?": {"=": "text", "@id": "text?"}, "@id": "text?"},
    "Series": {"Name": "text", "SortName?": "text", "Volume?": "count", "Format?": "text", "StartYear?": "year", "IssueCount?": "positive", "VolumeCount?": "positive", "AlternativeNames?": {"AlternativeName*": {"=": "text", "@id": "text?", "@lang": "text?"}}, "@lang": "text?", "@id": "text?"},
    "Prices?": {"Price*": {"=": "number", "@country": "text"}}, "Arcs?": {"Arc*": {"Name": "text", "Number?": "positive", "@id": "text?"}}, "Universes?": {"Universe*": {"Name": "text", "Designation?": "text", "@id": "text?"}},
    **{f"{outer}?": _listed(inner) for outer, inner in {"Stories": "Story", "Genres": "Genre", "Tags": "Tag", "Characters": "Character", "Teams": "Team", "Locations": "Location", "Reprints": "Reprint"}.items()},
    "GTIN?": {"ISBN?": "text", "UPC?": "text"}, "CommunityRating?": {"AverageRating": "number 0..5", "RatingCount?": "positive"}, "URLs?": {"URL*": {"=": "text", "@primary": "flag?"}},
    "Credits?": {"Credit*": {"Creator": {"=": "text", "@id": "text?"}, "Roles?": _listed("Role")}},
}
COMET = {
    "title": "text", **{f"{n}?": "text" for n in ("description", "series", "publisher", "isVersionOf", "format", "rating", "rights", "identifier", "coverDesigner")}, **{f"{n}?": "count" for n in ("issue", "volume", "pages", "lastMark")},
    "date?": "date", "price?": "number", "language?": "language", "readingDirection?": "ltr|rtl", **{f"{n}*": "text" for n in ("genre", "character", "creator", "writer", "penciller", "editor", "letterer", "inker", "colorist", "coverImage")},
}


def _simple(kind: str) -> str:
    """A type of its own for a choice of texts, a list of such, or a number within bounds; empty for a named type."""
    base, _, bounds = kind.partition(" ")
    if base == "list":
        return f"<xs:simpleType><xs:list>{_simple(bounds)}</xs:list></xs:simpleType>"
    if "|" in kind:
        return '<xs:simpleType><xs:restriction base="xs:string">' + "".join(f'<xs:enumeration value="{v}"/>' for v in kind.split("|")) + "</xs:restriction></xs:simpleType>"
    if bounds:
        low, high = bounds.split("..")
        return f'<xs:simpleType><xs:restriction base="xs:{TYPES[base]}"><xs:minInclusive value="{low}"/><xs:maxInclusive value="{high}"/></xs:restriction></xs:simpleType>'
    return ""


def _attribute(name: str, kind: str, required: bool) -> str:
    use, inner = ' use="required"' if required else "", _simple(kind)
    return f'<xs:attribute name="{name}"{use}>{inner}</xs:attribute>' if inner else f'<xs:attribute name="{name}"{use} type="xs:{TYPES[kind]}"/>'


def _element(name: str, content: str | dict, times: str = "") -> str:
    if isinstance(content, str):
        inner = _simple(content)
        return f'<xs:element name="{name}"{times}>{inner}</xs:element>' if inner else f'<xs:element name="{name}" type="xs:{TYPES[content]}"{times}/>'
    attributes = "".join(_attribute(k[1:], v.rstrip("?"), not v.endswith("?")) for k, v in content.items() if k.startswith("@"))
    if "=" in content:
        body = f'<xs:simpleContent><xs:extension base="xs:{TYPES[content["="]]}">{attributes}</xs:extension></xs:simpleContent>'
    else:
        children = {k: v for k, v in content.items() if not k.startswith("@")}
        repeats = any(k.endswith("*") for k in children)
        each = "".join(_element(k.rstrip("?*"), v, "" if repeats or not k.endswith("?") else ' minOccurs="0"') for k, v in children.items())
        group = f'<xs:choice minOccurs="0" maxOccurs="unbounded">{each}</xs:choice>' if repeats else f"<xs:all>{each}</xs:all>"
        body = (group if children else "") + attributes
    return f'<xs:element name="{name}"{times}><xs:complexType>{body}</xs:complexType></xs:element>'


def schema_text(root: str, content: dict) -> str:
    """The XSD of a format."""
    return f'<?xml version="1.0" encoding="UTF-8"?><xs:schema {XS}>{_element(root, content)}</xs:schema>'


def once(content: dict) -> tuple[list[str], list[str]]:
    """Children that must come, and that may come once, of a root whose other children repeat."""
    if not any(k.endswith("*") for k in content):
        return [], []
    return [k for k in content if k[-1] not in "?*"], [k[:-1] for k in content if k.endswith("?")]


def shipped(text: str, spark: SparkSession | None = None) -> str:
    """The name under which every executor has the schema: it is added to the files of the application, once.

    The driver hands the file out itself, so no shared folder is needed.
    """
    spark = spark or SparkSession.active()
    name = f"schema-{hashlib.sha256(text.encode()).hexdigest()[:20]}.xsd"
    if not any(f.endswith(name) for f in spark.sparkContext.listFiles):
        path = os.path.join(tempfile.mkdtemp(), name)
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
        spark.sparkContext.addFile(path)
    return name
