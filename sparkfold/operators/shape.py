"""Shapes of values: projections by key paths, coalescing, credits, lists, volumes, reprints, pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a field is made of: one or more source paths and a function of their columns.
Spec = tuple[str | tuple[str, ...], Callable[..., Column] | None]


def nonempty(x: Column) -> Column:
    """A text, null if it is empty."""
    return F.nullif(x, F.lit(""))


def first_nonempty(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[nonempty(v) for v in values])


def project(rows: DataFrame, specs: dict[str, Spec | str], scope: dict[str, Spec] | None = None) -> DataFrame:
    """Columns by destination path from source paths; nested destinations make structs.

    ``specs``: destination ``a.b`` -> source path, or (path or paths, function).  ``scope``: values that are made
    first and that functions may name as columns, such as a primary source.
    """
    scoped = rows.withColumns({name: _made(spec) for name, spec in (scope or {}).items()})
    tree: dict = {}
    for path, spec in specs.items():
        *parents, leaf = path.split(".")
        node = tree
        for p in parents:
            node = node.setdefault(p, {})
        node[leaf] = _made(spec)

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return scoped.select(*build(tree))


def _made(spec: Spec | str) -> Column:
    if isinstance(spec, str):
        return F.col(spec)
    paths, f = spec
    columns = [F.col(p) for p in ((paths,) if isinstance(paths, str) else paths)]
    return f(*columns) if f else columns[0]


def exclude_keys(schema: StructType, keys: tuple[str, ...]) -> StructType:
    """A document schema without some top keys; what a schema lacks is never parsed."""
    return StructType([f for f in schema.fields if f.name not in keys])


def sort_keys(value: Column, kind: StructType, order: tuple[str, ...] = ()) -> Column:
    """A struct with its fields in the given order, then by name."""
    known = [n for n in order if n in kind.names]
    return F.struct(*[value[n].alias(n) for n in [*known, *sorted(n for n in kind.names if n not in known)]])


def predates(start_year: Column, year: Column) -> Column:
    """Whether a volume can hold an issue of a year: it starts a year later at most, or either is unknown."""
    return F.coalesce(start_year <= year + 1, F.lit(True))


def real_volume(volume: Column) -> Column:
    """A volume number that is no year."""
    return F.when(~volume.between(1900, 2100), volume)


def credits(rows: DataFrame, person: str, role: str) -> DataFrame:
    """Person and the sorted roles of each; the other spelling of a penciller is unified."""
    name = F.when(F.lower(role) == "penciler", F.lit("Penciller")).otherwise(F.col(role))
    return rows.groupBy(F.col(person).alias("person")).agg(F.array_sort(F.collect_set(name)).alias("roles"))


def credit_rows(credits_: DataFrame) -> DataFrame:
    """A row for each person and role."""
    return credits_.select("person", F.explode("roles").alias("role"))


def sorted_list(values: Column, keys: tuple[str, ...], distinct: bool = True) -> Column:
    """An array of structs sorted by keys, null as the empty text; of equal keys the first entry stays."""
    marked = F.transform(values, lambda v, i: F.struct(F.struct(*[F.coalesce(v[k].cast("string"), F.lit("")).alias(k) for k in keys]).alias("k"), i.alias("i"), v.alias("v")))
    # equal keys follow each other in the order of their places
    ordered = F.array_sort(marked, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(a["i"] - b["i"]))
    if not distinct:
        return F.transform(ordered, lambda x: x["v"])
    # each entry beside the one before it, the first one beside itself; the last place has no entry
    beside = F.zip_with(ordered, F.concat(F.slice(ordered, 1, 1), ordered), lambda x, y: F.struct(x.alias("x"), y["k"].alias("k"), y["i"].alias("i")))
    kept = F.filter(beside, lambda p: p["x"].isNotNull() & ((p["x"]["i"] == p["i"]) | (p["x"]["k"] != p["k"])))
    return F.transform(kept, lambda p: p["x"]["v"])


def share_any(a: Column, b: Column) -> Column:
    """Whether two sets have an element in common."""
    return F.arrays_overlap(a, b)


def distinct_in_order(values: Column) -> Column:
    """Distinct values in the order of their first occurrence."""
    return F.array_distinct(values)


def volume_range(text: Column) -> tuple[Column, Column]:
    """Number and last number of a volume such as 3 or 3-5."""
    parts = F.split(text, "-")
    return F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")


def volume_text(number: Column, to: Column) -> Column:
    """The text of a volume range; a missing end is left out."""
    return F.concat_ws("-", number, to)


def reprint_from_text(text: Column) -> Column:
    """Language, series, volume and issue of a reprint's display name such as ``Series v2 #5``."""
    series = F.trim(F.regexp_extract(text, r"(?i)^(.*?)(?:\s+v(?:ol)?\.?\s*\d+)?(?:\s*#\S+)?$", 1))
    volume, issue = F.regexp_extract(text, r"(?i)\bv(?:ol)?\.?\s*(\d+)", 1), F.regexp_extract(text, r"#(\S+)$", 1)
    return F.struct(F.lit(None).cast("string").alias("language"), nonempty(series).alias("series"), nonempty(volume).alias("volume"), nonempty(issue).alias("issue"))


def reprint_text(reprint: Column) -> Column:
    """The display name of a reprint."""
    return F.concat_ws(" ", reprint["series"], F.concat(F.lit("v"), reprint["volume"]), F.concat(F.lit("#"), reprint["issue"]))


def page_attributes(pages: Column, names: dict[str, str]) -> Column:
    """A map of pages as an array of structs of attributes, in order; ``names``: attribute -> field."""
    return F.transform(F.array_sort(F.map_keys(pages)), lambda k: F.struct(k.alias("_Image"), *[pages[k][f].alias(f"_{a}") for a, f in names.items()]))


def bookmark(pages: Column) -> Column:
    """The first page with a bookmark."""
    return F.array_min(F.map_keys(F.map_filter(pages, lambda k, v: v["bookmark"].isNotNull())))
