"""JSON Schema (draft 2020-12) as Column predicates over VARIANT.

A schema document is compiled once, on the driver, to one boolean expression: the text is parsed to a variant,
properties are paths of it, items and further properties are arrays and maps of variants in higher-order
functions.  So documents are checked in the JVM, row by row, and Spark sees an ordinary predicate.

Keywords: type, enum, const; multipleOf, maximum, exclusiveMaximum, minimum, exclusiveMinimum; maxLength,
minLength, pattern, format; maxItems, minItems, uniqueItems, prefixItems, items, contains, maxContains,
minContains; maxProperties, minProperties, required, dependentRequired, dependentSchemas, properties,
patternProperties, additionalProperties, propertyNames; allOf, anyOf, oneOf, not, if, then, else; $ref to
``#``, to a JSON pointer, to an $anchor, or to another document by its $id; $defs.  Formats: date, date-time,
time, email, uri, uuid, ipv4; others are annotations.  ``unevaluated...`` and dynamic references are
refused.  A reference that leads back to itself is followed ``nesting`` times; what lies deeper passes.

Defined results: null, and what is no JSON document (or has a key twice), does not fit; numbers are compared
as doubles; an integer is a number without a fraction, 1.0 among them; lengths count code points; patterns
are searched for, as Java regular expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Check = Callable[[Column], Column]

MARK = "end of the document"
REFUSED = ("unevaluatedProperties", "unevaluatedItems", "$dynamicRef", "$recursiveRef")
FORMATS = {
    "date": lambda s: s.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(s, "yyyy-MM-dd").isNotNull(),
    "date-time": lambda s: s.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$") & F.try_to_timestamp(F.substring(F.translate(F.upper(s), "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(),
    "time": lambda s: s.rlike(r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"),
    "email": lambda s: s.rlike(r"^[^@\s]+@[^@\s]+$"),
    "uri": lambda s: s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$"),
    "uuid": lambda s: s.rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
    "ipv4": lambda s: s.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$"),
}


def _all(checks: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, checks, F.lit(True))


def _unless(check: Column, other: Column) -> Column:
    """The check, which passes where it is null or where the value is of another kind; that is looked at only if it fails."""
    return F.coalesce(check, F.lit(True)) | other


def _if(condition: Column, check: Column) -> Column:
    """The check where the condition holds; what it does not concern passes."""
    return F.when(condition, check).otherwise(True)


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is of a kind.  Objects and arrays are told by their parts, as describing them would walk through all they hold."""
    if kind == "object":
        return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    if kind == "array":
        return F.try_variant_get(v, "$", "array<variant>").isNotNull()
    name, x = F.schema_of_variant(v), F.try_variant_get(v, "$", "double")
    number = x.isNotNull() & name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")  # text that reads like a number is none
    if kind == "integer":
        return number & (x == F.rint(x))
    return {"string": name == "STRING", "boolean": name == "BOOLEAN", "null": F.is_variant_null(v), "number": number}[kind]


def _equals(v: Column, value: object) -> Column:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _is(v, "number") & (F.try_variant_get(v, "$", "double") == float(value))
    # the keys of a variant are sorted, so equal values have equal texts
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _path(name: str) -> str | None:
    """The path of a property, or null where the path language cannot quote its name."""
    return f'$["{name}"]' if name and not set(name) & set('"\\') else None


class JsonSchema:
    """A schema document; ``documents`` holds others by their $id."""

    def __init__(self, schema: dict | bool | str, documents: dict[str, dict] | None = None, nesting: int = 3) -> None:
        self.schema = json.loads(schema) if isinstance(schema, str) else schema
        self.documents, self.nesting = documents or {}, nesting

    def check(self, payload: Column) -> Column:
        """Whether a JSON text fits the schema; never null."""
        # the parser ignores what follows a value; inside an array before a mark nothing can follow unseen
        both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), payload, F.lit(f',"{MARK}"]'))), "$", "array<variant>")
        whole = lambda a: (F.size(a) == 2) & F.coalesce(F.try_variant_get(F.get(a, F.lit(1)), "$", "string") == MARK, F.lit(False))
        value = F.transform(F.array(both), lambda a: F.when(whole(a), F.get(a, F.lit(0))))  # parsed once
        return F.coalesce(F.get(F.transform(value, lambda v: v.isNotNull() & self._check(self.schema, v, self.schema, ())), F.lit(0)), F.lit(False))

    def _resolve(self, ref: str, root: dict | bool) -> tuple[dict | bool, dict | bool]:
        """The schema that a reference names, and the document it stands in."""
        place, _, pointer = ref.partition("#")
        if place:
            own = root.get("$id", "") if isinstance(root, dict) else ""
            if place != own:
                name = next((k for k in (place, own.rsplit("/", 1)[0] + "/" + place) if k in self.documents), None)
                if name is None:
                    raise ValueError(f"no document {place}")
                root = self.documents[name]
        if pointer and not pointer.startswith("/"):
            found = _anchored(root, pointer)
            if found is None:
                raise ValueError(f"no anchor {pointer}")
            return found, root
        out = root
        for step in pointer.split("/")[1:]:
            step = step.replace("~1", "/").replace("~0", "~")
            out = out[int(step)] if isinstance(out, list) else out[step]
        return out, root

    def _check(self, s: dict | bool, v: Column, root: dict | bool, trail: tuple[str, ...]) -> Column:
        if isinstance(s, bool):
            return F.lit(s)
        if bad := [k for k in REFUSED if k in s]:
            raise ValueError(f"not supported: {', '.join(bad)}")
        sub = lambda x, w: self._check(x, w, root, trail)
        out: list[Column] = []
        if "$ref" in s:
            target, document = self._resolve(s["$ref"], root)
            mark = f"{id(document)}{s['$ref']}"
            if trail.count(mark) < self.nesting:
                out.append(self._check(target, v, document, (*trail, mark)))
        if "type" in s:
            kinds = [s["type"]] if isinstance(s["type"], str) else s["type"]
            out.append(reduce(lambda a, b: a | b, (_is(v, k) for k in kinds)))
        if "const" in s:
            out.append(_equals(v, s["const"]))
        if "enum" in s:
            out.append(reduce(lambda a, b: a | b, (_equals(v, x) for x in s["enum"]), F.lit(False)))
        out += self._numbers(s, v) + self._texts(s, v) + self._arrays(s, v, sub) + self._objects(s, v, sub)
        out += [sub(x, v) for x in s.get("allOf", [])]
        if "anyOf" in s:
            out.append(reduce(lambda a, b: a | b, (sub(x, v) for x in s["anyOf"])))
        if "oneOf" in s:
            out.append(sum((sub(x, v).cast("int") for x in s["oneOf"]), F.lit(0)) == 1)
        if "not" in s:
            out.append(~sub(s["not"], v))
        if "if" in s and ("then" in s or "else" in s):
            out.append(F.when(sub(s["if"], v), sub(s.get("then", True), v)).otherwise(sub(s.get("else", True), v)))
        return _all(out)

    def _numbers(self, s: dict, v: Column) -> list[Column]:
        x = F.try_variant_get(v, "$", "double")
        bounds = {"maximum": lambda b: x <= b, "exclusiveMaximum": lambda b: x < b, "minimum": lambda b: x >= b, "exclusiveMinimum": lambda b: x > b}
        checks = [bounds[k](F.lit(float(s[k]))) for k in bounds if k in s]
        if "multipleOf" in s:
            share = x / F.lit(float(s["multipleOf"]))
            checks.append(F.abs(share - F.round(share)) <= 1e-9 * F.greatest(F.abs(share), F.lit(1.0)))
        return [_unless(_all(checks), ~_is(v, "number"))] if checks else []

    def _texts(self, s: dict, v: Column) -> list[Column]:
        text = F.try_variant_get(v, "$", "string")
        checks = []
        if "maxLength" in s:
            checks.append(F.length(text) <= int(s["maxLength"]))
        if "minLength" in s:
            checks.append(F.length(text) >= int(s["minLength"]))
        if "pattern" in s:
            checks.append(text.rlike(s["pattern"]))
        if s.get("format") in FORMATS:
            checks.append(F.coalesce(FORMATS[s["format"]](text), F.lit(False)))
        return [_unless(_all(checks), ~_is(v, "string"))] if checks else []

    def _arrays(self, s: dict, v: Column, sub) -> list[Column]:
        items = F.try_variant_get(v, "$", "array<variant>")
        n = F.size(items)
        checks = []
        if "maxItems" in s:
            checks.append(n <= int(s["maxItems"]))
        if "minItems" in s:
            checks.append(n >= int(s["minItems"]))
        if s.get("uniqueItems"):
            checks.append(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) == n)
        first = s.get("prefixItems", [])
        checks += [_if(n > i, sub(x, F.get(items, F.lit(i)))) for i, x in enumerate(first)]
        if "items" in s and s["items"] is not True:
            rest = F.slice(items, F.lit(len(first) + 1), F.greatest(n, F.lit(0))) if first else items
            checks.append(F.forall(rest, lambda x: sub(s["items"], x)))
        if "contains" in s:
            hits = F.size(F.filter(items, lambda x: sub(s["contains"], x)))
            checks.append(hits >= int(s.get("minContains", 1)))
            if "maxContains" in s:
                checks.append(hits <= int(s["maxContains"]))
        return [_unless(_all(checks), F.lit(False))] if checks else []

    def _objects(self, s: dict, v: Column, sub) -> list[Column]:
        everything = F.try_variant_get(v, "$", "map<string,variant>")

        def value(name: str) -> Column:
            path = _path(name)
            return F.try_variant_get(v, path, "variant") if path else F.try_element_at(everything, F.lit(name))

        n, keys = F.cardinality(everything), F.map_keys(everything)
        # a path of what is no object is null, and so are its map and its keys
        must = [value(k).isNotNull() for k in s.get("required", [])]
        checks = [_unless(_all(must), ~_is(v, "object"))] if must else []
        if "maxProperties" in s:
            checks.append(n <= int(s["maxProperties"]))
        if "minProperties" in s:
            checks.append(n >= int(s["minProperties"]))
        for k, others in s.get("dependentRequired", {}).items():
            checks.append(_if(value(k).isNotNull(), _all(value(o).isNotNull() for o in others)))
        for k, x in s.get("dependentSchemas", {}).items():
            checks.append(_if(value(k).isNotNull(), sub(x, v)))
        named, patterns = s.get("properties", {}), s.get("patternProperties", {})
        checks += [_if(value(k).isNotNull(), sub(x, value(k))) for k, x in named.items() if x is not True]
        checks += [_of_pattern(everything, p, x, sub) for p, x in patterns.items()]
        if "propertyNames" in s:
            checks.append(F.forall(keys, lambda k: sub(s["propertyNames"], k.cast("variant"))))
        more = s.get("additionalProperties", True)
        if more is not True:
            other = F.map_filter(everything, lambda k, _: ~reduce(lambda a, b: a | b, (k.rlike(p) for p in patterns), k.isin(list(named)) if named else F.lit(False)))
            checks.append(F.cardinality(other) == 0 if more is False else F.forall(F.map_values(other), lambda x: sub(more, x)))
        return [_unless(c, F.lit(False)) for c in checks]


def _of_pattern(everything: Column, pattern: str, schema: dict | bool, sub) -> Column:
    """The schema for all properties whose name matches."""
    return F.forall(F.map_values(F.map_filter(everything, lambda k, _: k.rlike(pattern))), lambda x: sub(schema, x))


def _anchored(s: object, name: str) -> dict | None:
    """The subschema with an $anchor."""
    if isinstance(s, dict):
        if s.get("$anchor") == name:
            return s
        return next((x for v in s.values() if (x := _anchored(v, name)) is not None), None)
    if isinstance(s, list):
        return next((x for v in s if (x := _anchored(v, name)) is not None), None)
    return None
