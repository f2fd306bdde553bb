"""Validation of documents (M21 to M24, E10): each validator gives a boolean column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, IntegralType, MapType, NumericType, StructType

from ..sources import canonical as C
from ..sources import documents as D
from ..sources import xsd as X
from .json_schema import JsonSchema


def valid_json(schema: str, *rules: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The document fits the schema (a bad field of a PERMISSIVE read is null) and all rules."""

    def check(payload: Column) -> Column:
        parsed = F.from_json(payload, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        ok = parsed.isNotNull() & parsed["_corrupt"].isNull()
        for rule in rules:
            ok = ok & F.coalesce(rule(parsed), F.lit(True))
        return F.coalesce(ok, F.lit(False))

    return check


def valid_xml(root: str, schema: str, *rules: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A well-formed document with the root and all rules on its fields."""

    def check(payload: Column) -> Column:
        parsed = F.from_xml(payload, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        ok = payload.rlike(rf"<{root}[\s>/]") & parsed.isNotNull() & parsed["_corrupt"].isNull()
        for rule in rules:
            ok = ok & F.coalesce(rule(parsed), F.lit(True))
        return F.coalesce(ok, F.lit(False))

    return check


def fits_xsd(root: str, content: dict) -> Callable[[Column], Column]:
    """The document is valid under an XML Schema, in the notation of ``sources.xsd``.

    The parser of each row validates it (``rowValidationXSDPath``); a document that does not fit is a corrupt one.  What
    XML Schema 1.0 cannot count is counted in the parsed arrays.
    """
    text = X.schema_text(root, content)
    must, may = X.once(content)
    counted = ", ".join(f"`{c}` array<string>" for c in (*must, *may))

    def check(payload: Column) -> Column:
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "rowValidationXSDPath": X.shipped(text)}
        parsed = F.from_xml(payload, f"{counted or '_none string'}, _corrupt string", options)

        def judge(p: Column) -> Column:
            ok = p.isNotNull() & p["_corrupt"].isNull()
            for c in must:
                ok = ok & (F.size(p[c]) == 1)
            for c in may:
                ok = ok & (p[c].isNull() | (F.size(p[c]) == 1))
            return ok

        return F.coalesce(C.let(parsed, judge), F.lit(False))

    return check


def fits_json(schema: dict | bool | str, documents: dict[str, dict] | None = None) -> Callable[[Column], Column]:
    """The document is valid under a JSON Schema."""
    return JsonSchema(schema, documents).check


def valid_yaml(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """YAML that is a mapping, checked as JSON."""
    return lambda payload: check(D.yaml_to_json(payload))


def number_within(field: str, low: int, high: int) -> Callable[[Column], Column]:
    return lambda x: x[field].try_cast("int").between(low, high)


def schema_of_type(kind: DataType) -> dict:
    """The JSON Schema of what is written for a Spark type; every value may be null, and numbers may stand in quotes."""
    if isinstance(kind, StructType):
        return {"type": ["object", "null"], "properties": {f.name: schema_of_type(f.dataType) for f in kind.fields}}
    if isinstance(kind, MapType):
        return {"type": ["object", "null"], "additionalProperties": schema_of_type(kind.valueType)}
    if isinstance(kind, ArrayType):
        return {"type": ["array", "null"], "items": schema_of_type(kind.elementType)}
    if isinstance(kind, BooleanType):
        return {"type": ["boolean", "null"]}
    if isinstance(kind, DateType):
        return {"type": ["string", "null"], "format": "date"}
    if isinstance(kind, NumericType):
        whole = isinstance(kind, IntegralType)
        return {"type": ["integer" if whole else "number", "string", "null"], "pattern": r"^\s*-?\d+\s*$" if whole else r"^\s*-?\d+(\.\d+)?\s*$"}
    return {"type": ["string", "number", "null"]}


# Fields of the format with their kinds and bounds.
_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}
COMIC_BOOK_INFO = {
    "type": "object",
    "properties": {
        "appID": _TEXT, "lastModified": _TEXT,
        "ComicBookInfo/1.0": {
            "type": "object",
            "properties": {
                **{n: _TEXT for n in ("comments", "country", "genre", "language", "publisher", "series", "title")}, **{n: _WHOLE for n in ("issue", "publicationYear", "rating")}, **{n: {**_WHOLE, "minimum": 1} for n in ("numberOfIssues", "numberOfVolumes")},
                "volume": {**_WHOLE, "minimum": 0}, "publicationMonth": {**_WHOLE, "minimum": 1, "maximum": 12}, "tags": {"type": "array", "items": _TEXT},
                "credits": {"type": "array", "items": {"type": "object", "properties": {"person": _TEXT, "role": _TEXT, "primary": {"type": "boolean"}}}},
            },
        },
    },
}


def fits_native(payload: Column) -> Column:
    """The native document: its root holds the fields of the canonical record."""
    record = {**schema_of_type(C.canonical_type()), "type": "object"}
    return fits_json({"type": "object", "required": [D.NATIVE_ROOT], "properties": {D.NATIVE_ROOT: record}})(payload)


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "comic_info": fits_xsd("ComicInfo", X.COMIC_INFO), "metron_info": fits_xsd("MetronInfo", X.METRON_INFO), "comet": fits_xsd("comet", X.COMET),
    "comic_book_info": fits_json(COMIC_BOOK_INFO), "native_json": fits_native, "native_yaml": valid_yaml(fits_native), "native_line": lambda payload: valid_yaml(fits_native)(D.line_text(payload)),
}


def validate(raw: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """Path and whether all its documents are valid; a format without a schema (names, page lists, PDF) passes."""
    return verdicts(raw, formats).groupBy("path").agg(F.bool_and("valid").alias("valid"))


def verdicts(raw: DataFrame, formats: list[str] | None = None) -> DataFrame:
    """``raw`` with ``valid``, whether the document fits the schema of its format.

    Only ``formats`` (all that have a schema) are checked; naming the few that are there makes a smaller plan.
    """
    chosen = [f for f in VALIDATORS if formats is None or f in formats]
    # YAML becomes JSON first, so that the native formats share one predicate
    native, payload = [f for f in chosen if f == "native_json" or f in D.YAML_TEXT], F.col("payload")
    ok = F.lit(True)
    if native:
        yaml, text = [f for f in native if f in D.YAML_TEXT], F.lit(None).cast("string")
        for fmt in yaml:
            text = F.when(F.col("fmt") == fmt, D.YAML_TEXT[fmt](payload)).otherwise(text)
        json = F.when(F.col("fmt").isin(yaml), D.yaml_to_json(text)).otherwise(payload) if yaml else payload
        ok = F.when(F.col("fmt").isin(native), fits_native(json)).otherwise(ok)
    for fmt in chosen:
        if fmt not in native:
            ok = F.when(F.col("fmt") == fmt, VALIDATORS[fmt](payload)).otherwise(ok)
    return raw.withColumn("valid", ok)
