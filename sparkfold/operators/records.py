"""From raw documents to one record per path: read, fold by precedence, derive, render (the whole life of a record)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..sources import canonical as C
from ..sources import catalogs, writers  # noqa: F401  they add their formats
from ..sources import documents as D
from . import derive
from .merge import ADDITIVE, REPLACE, UPDATE, merge_values


def merge_documents(normalized: DataFrame, keys: tuple[str, ...] = ("path",), mode: str = ADDITIVE, errors: bool = False) -> DataFrame:
    """One record per key, the documents folded field by field in rank order (later ones win).

    Scalars and structs of scalars are kept by a last-value aggregation, which Spark combines before the
    shuffle.  Maps and arrays of one key are folded in rank order; a key has one document per format and source
    at most, so these groups are small.  ``counted_pages`` is the number of pages that a list of pages gave.  With
    ``errors`` keys without a readable document stay, with a null record, and ``error`` is the first one of a key.
    """
    rank = F.struct("rank", F.coalesce("ordinal", F.lit(0)))
    aggregates, finish = [], {}
    for field in C.canonical_type().fields:
        name, column = field.name, F.col(f"record.{field.name}")
        if isinstance(field.dataType, StructType):
            for part in field.dataType.fields:
                value = F.col(f"record.{name}.{part.name}")
                aggregates.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(f"{name}__{part.name}"))
        elif isinstance(field.dataType, MapType) or (mode == ADDITIVE and field.dataType.typeName() == "array"):
            aggregates.append(F.collect_list(F.when(column.isNotNull(), F.struct(F.col("rank").alias("rank"), column.alias("v")))).alias(name))
        else:
            aggregates.append(F.max_by(column, F.when(column.isNotNull(), rank)).alias(name))
    if "fmt" in normalized.columns:  # C01: what a container's own pages say, null where they were not counted
        aggregates.append(F.max(F.when(F.col("fmt") == "page_list", F.col("record.page_count"))).alias("counted_pages"))
    else:
        aggregates.append(F.lit(None).cast("int").alias("counted_pages"))
    # a container whose only document is its list of pages has a record as well
    if errors:
        aggregates += [F.min("error").alias("error"), F.count("record").alias("readable")]
        folded = normalized.groupBy(*keys).agg(*aggregates)
    else:
        folded = normalized.where("record IS NOT NULL").groupBy(*keys).agg(*aggregates)
    for field in C.canonical_type().fields:
        name, kind = field.name, field.dataType
        if isinstance(kind, StructType):
            parts = [F.col(f"{name}__{p.name}") for p in kind.fields]
            there = F.coalesce(*[p.cast("string") for p in parts]).isNotNull()
            finish[name] = F.when(there, F.struct(*[c.alias(p.name) for c, p in zip(parts, kind.fields, strict=True)]))
        elif isinstance(kind, MapType):
            finish[name] = _fold_maps(name, kind)
        elif mode == ADDITIVE and kind.typeName() == "array":
            joined = F.flatten(F.transform(_by_rank(name), lambda x: x["v"]))
            finish[name] = F.when(F.size(name) > 0, F.array_distinct(joined) if name in C.SETS else joined)
        else:
            finish[name] = F.col(name)
    record = F.struct(*[v.cast(C.FIELDS[n]).alias(n) for n, v in finish.items()])
    if errors:
        return folded.select(*keys, F.when(F.col("readable") > 0, record).alias("record"), "counted_pages", "error")
    return folded.select(*keys, record.alias("record"), "counted_pages")


def _by_rank(name: str):
    """The collected values in rank order; ranks are sorted as numbers beside their position, as maps have no order."""
    order = F.array_sort(F.transform(F.col(name), lambda x, i: F.struct(x["rank"].alias("rank"), i.alias("i"))))
    return F.transform(order, lambda o: F.get(F.col(name), o["i"]))


def _fold_maps(name: str, kind: MapType):
    """Union of maps in rank order; entries of one key are merged field by field, the later one wins."""
    if isinstance(kind.valueType, StructType):

        def both(k, a, b):
            fields = []
            for f in kind.valueType.fields:
                x, y = a[f.name], b[f.name]
                merged = F.map_zip_with(x, y, lambda k2, p, q: F.coalesce(q, p)) if isinstance(f.dataType, MapType) else F.lit(None).cast(f.dataType)
                fields.append(F.coalesce(merged, y, x).alias(f.name))
            return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(*fields))
    else:

        def both(k, a, b):
            return F.coalesce(b, a)

    start = F.create_map().cast(kind)
    folded = F.aggregate(_by_rank(name), start, lambda acc, x: F.map_zip_with(acc, x["v"], both))
    return F.when(F.size(name) > 0, folded)


def read_records(raw: DataFrame, mode: str = ADDITIVE, drop: tuple[str, ...] = (), formats: list[str] | None = None) -> DataFrame:
    """Rows (path, source, fmt, ordinal, payload) to (path, record): normalize, merge, derive.

    ``formats`` (P10) limits the formats that are read; fewer formats also make a smaller plan.
    """
    return derive.derive_all(merge_documents(D.normalize(raw, formats), ("path",), mode), "record", drop, "counted_pages").drop("counted_pages")


def fresh_paths(times: DataFrame, old: DataFrame) -> DataFrame:
    """``times`` (path, modified) with ``fresh``: newer than ``old`` (path, old), or not known there."""
    return times.join(old, "path", "left").withColumn("fresh", F.col("modified") > F.coalesce("old", F.lit("1970-01-01").cast("timestamp"))).drop("old")


def read_gated(raw: DataFrame, mode: str = ADDITIVE, drop: tuple[str, ...] = (), formats: list[str] | None = None) -> DataFrame:
    """One row per path: modified, fresh, record (null: skipped or unreadable) and error.

    ``raw`` has the columns modified, fresh and failed of its container beside each document (``archives.gated_documents``).
    """
    merged = merge_documents(D.normalize(raw, formats), ("path", "modified", "fresh", "failed"), mode, errors=True)
    records = derive.derive_all(merged, "record", drop, "counted_pages")
    return records.select("path", "modified", "fresh", "record", F.coalesce("failed", "error").alias("error"))


def read_or_skip(raw: DataFrame, times: DataFrame, old: DataFrame, mode: str = ADDITIVE, drop: tuple[str, ...] = (), formats: list[str] | None = None) -> DataFrame:
    """S22, S23 for documents that are in no container: ``times`` has path and modified, ``old`` path and old.

    One row per path of ``times``; documents that are not newer are not parsed.
    """
    gate = fresh_paths(times, old).select("path", "modified", "fresh", F.lit(None).cast("string").alias("failed"))
    kept = gate.join(raw, "path", "left").withColumns({"fmt": F.when(F.col("fresh"), F.col("fmt")), "payload": F.when(F.col("fresh"), F.col("payload"))})
    # of a path that is skipped an empty document stays
    marked = kept.withColumn("fmt", F.when(F.col("payload").isNull(), F.lit("page_list")).otherwise(F.col("fmt")))
    return read_gated(marked, mode, drop, None if formats is None else [*formats, "page_list"])


def patch_records(base: DataFrame, patch: DataFrame, mode: str = ADDITIVE) -> DataFrame:
    """Records (path, record, ...) with the record of a patch laid over them.

    ADDITIVE joins lists and unites maps, REPLACE replaces lists, UPDATE replaces whole top-level fields.
    """
    left, right = F.col("record"), F.col("patch")
    if mode == UPDATE:
        whole = F.struct(*[F.coalesce(right[n], left[n]).alias(n) for n in C.FIELDS])
        merged = F.when(right.isNull(), left).when(left.isNull(), right).otherwise(whole)
    else:
        merged = merge_values(left, right, C.canonical_type(), mode)
    return base.join(patch.select("path", F.col("record").alias("patch")), "path", "left").withColumn("record", merged.cast(C.DDL)).drop("patch")


__all__ = ["ADDITIVE", "REPLACE", "UPDATE", "fresh_paths", "merge_documents", "patch_records", "read_gated", "read_or_skip", "read_records"]
