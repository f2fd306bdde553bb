"""Merging of records: precedence folds, overlays of maps and rows, set unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

ADDITIVE, REPLACE, UPDATE = "additive", "replace", "update"


def fold_last(rows: DataFrame, keys: list[str], value: str, order: list[str], out: str | None = None) -> DataFrame:
    """The last non-empty value of each key, by the given order; combined before the shuffle."""
    kept = rows.where(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    return kept.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(out or value))


def overlay_maps(base: Column, patch: Column) -> Column:
    """Union of two maps of scalars; the patch wins."""
    return F.map_zip_with(F.coalesce(base, F.create_map().cast("map<string,string>")), F.coalesce(patch, F.create_map().cast("map<string,string>")), lambda k, a, b: F.coalesce(b, a))


def add_counters(a: Column, b: Column) -> Column:
    """Sum of two maps of counts by key."""
    none = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def merge_values(base: Column, patch: Column, kind, mode: str = REPLACE) -> Column:
    """Merges two columns of the same type field by field.

    Structs and maps recurse.  Arrays are joined under ADDITIVE and replaced under REPLACE, like scalars.
    Null is absence.
    """
    if isinstance(kind, StructType):
        fields = [merge_values(base[f.name], patch[f.name], f.dataType, mode).alias(f.name) for f in kind.fields]
        return F.when(base.isNull(), patch).when(patch.isNull(), base).otherwise(F.struct(*fields))
    if isinstance(kind, MapType):
        merged = F.map_zip_with(base, patch, lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge_values(a, b, kind.valueType, mode)))
        return F.when(base.isNull(), patch).when(patch.isNull(), base).otherwise(merged)
    if isinstance(kind, ArrayType) and mode == ADDITIVE:
        return F.when(base.isNull(), patch).when(patch.isNull(), base).otherwise(F.concat(base, patch))
    return F.coalesce(patch, base)


def merge_records(base: DataFrame, patch: DataFrame, keys: list[str], mode: str = REPLACE) -> DataFrame:
    """Rows of both sides by key, merged column by column.

    UPDATE replaces whole top-level columns and leaves rows without a base out; the other modes keep all keys.
    """
    shared = [f for f in base.schema.fields if f.name not in keys and f.name in patch.columns]
    only = [c for c in base.columns if c not in keys and c not in patch.columns]
    left, right = base.alias("l"), patch.alias("r")
    joined = left.join(right, keys, "left" if mode == UPDATE else "full_outer")
    merged = [(F.coalesce(F.col(f"r.{f.name}"), F.col(f"l.{f.name}")) if mode == UPDATE else merge_values(F.col(f"l.{f.name}"), F.col(f"r.{f.name}"), f.dataType, mode)).alias(f.name) for f in shared]
    extra = [F.col(f"r.{c}") for c in patch.columns if c not in keys and c not in base.columns and mode != UPDATE]
    return joined.select(*keys, *[F.col(f"l.{c}") for c in only], *merged, *extra)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; a null in a new row does not erase."""
    return merge_records(old, new, keys, REPLACE)


def union_sets(*arrays: Column) -> Column:
    """Distinct elements of all arrays in order of first occurrence."""
    out = arrays[0]
    for x in arrays[1:]:
        out = F.array_union(F.coalesce(out, F.array()), F.coalesce(x, F.array()))
    return F.array_distinct(out)


def fold_case(rows: DataFrame, group: list[str], key: str, value: str, order: str) -> DataFrame:
    """One row per key without regard to case: place of the first, spelling and value of the last."""
    found = rows.groupBy(*group, F.lower(key).alias("folded")).agg(F.min(order).alias("place"), F.max_by(F.struct(F.col(key), F.col(value)), order).alias("last"))
    return found.select(*group, "place", F.col(f"last.{key}").alias(key), F.col(f"last.{value}").alias(value))


def first_by(rows: DataFrame, keys: list[str], order: Column | str, columns: list[str]) -> DataFrame:
    """The columns of the first row of each key; combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("first")).select(*keys, *[F.col(f"first.{c}").alias(c) for c in columns])


def identifiers_of(explicit_key: Column, url_key: Column, explicit_url: Column, made_url: Column) -> Column:
    """The explicit key before that of the URL, a real URL before a made one."""
    return F.struct(F.coalesce(explicit_key, url_key).alias("key"), F.coalesce(explicit_url, made_url).alias("url"))
