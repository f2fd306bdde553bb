"""Lookups and joins: dimensions, anti-join unions, run comparison, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows and characters of a dimension that may be broadcast; beyond that Spark chooses by size.
SMALL, SMALL_TEXT = 10_000, 8 << 20


def small(dimension: DataFrame) -> DataFrame:
    """Broadcast hint for a dimension, given only after its rows and their size as text have been checked.

    The check is a job of its own that runs while the plan is built; it reads one row more than the bound at most.
    """
    length = sum((F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in dimension.columns), F.lit(0))
    n, size = dimension.limit(SMALL + 1).agg(F.count("*"), F.coalesce(F.sum(length.cast("long")), F.lit(0))).first()
    return F.broadcast(dimension) if n <= SMALL and size <= SMALL_TEXT else dimension


def fresh(wanted: str, *frames: DataFrame) -> str:
    """``wanted``, with underscores behind it until no frame has a column of that name (whatever its case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def longest_suffix(rows: DataFrame, host: str, table: DataFrame, out: str) -> DataFrame:
    """``rows`` with the value of the longest host of ``table`` (host, value) that ends ``host`` in whole labels, or null.

    Every distinct host is spread to its suffixes, at most as many as it has labels, which meet the table by
    equality; the longest one that is there wins.  So neither side needs to be small, and a host that a third of all
    rows have is looked up once.  Case, and dots at either end, do not count.  A host that the table has several
    times has its least value.
    """
    clean = lambda c: F.lower(F.btrim(c, F.lit(".")))
    own, key = fresh("__host", rows, table), fresh("__value", rows, table)
    keyed = rows.withColumn(own, clean(F.col(host)))
    known = table.groupBy(clean(F.col("host")).alias("suffix")).agg(F.min("value").alias(key))
    labels = F.split("h", r"\.")
    spread = keyed.select(F.col(own).alias("h")).where("h <> ''").distinct().select("h", F.posexplode(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("at", "suffix"))
    best = spread.join(known, "suffix").groupBy("h").agg(F.min_by(key, "at").alias(key))
    return keyed.join(best, keyed[own] == best["h"], "left").select(*[keyed[c] for c in rows.columns if c != out], F.col(key).alias(out))


def alias_lookup(rows: DataFrame, value: str, dimension: DataFrame, out: str) -> DataFrame:
    """``dimension`` (alias, canonical) applied to a column without regard to case; null if unknown."""
    key = fresh("__key", rows)
    keyed = dimension.select(F.lower("alias").alias(key), F.col("canonical").alias(out)).dropDuplicates([key])
    return rows.withColumn(key, F.lower(value)).join(small(keyed), key, "left").drop(key)


def expand(rows: DataFrame, value: str, dimension: DataFrame, out: str) -> DataFrame:
    """One row per canonical value of each alias (many to many)."""
    key = fresh("__key", rows)
    keyed = dimension.select(F.lower("alias").alias(key), F.col("canonical").alias(out)).distinct()
    return rows.withColumn(key, F.lower(value)).join(small(keyed), key).drop(key)


def union_without(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The first rows, then the second ones whose keys are new; ``tier`` is 0 or 1."""
    return first.withColumn("tier", F.lit(0)).unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti").withColumn("tier", F.lit(1)))


def stored_identifier(rows: DataFrame, keys: list[str], text: str, rank: str) -> DataFrame:
    """The first identifier by rank that is an integer."""
    parsed = rows.withColumn("__id", F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text)).try_cast("bigint")).where("__id IS NOT NULL")
    return parsed.groupBy(*keys).agg(F.min_by("__id", rank).alias("id"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two values do not contradict each other: either is missing, or equal without regard to case."""
    return a.isNull() | b.isNull() | (F.lower(a) == F.lower(b))


def consolidate(entries: Column, fields: list[str]) -> Column:
    """Folds an array of structs of strings; an entry joins the first one that it does not contradict.

    The array belongs to one record, so the fold stays within a row.
    """

    def same(x: Column, y: Column) -> Column:
        ok = F.lit(True)
        for f in fields:
            ok = ok & compatible(x[f], y[f])
        return ok

    def merged(x: Column, y: Column) -> Column:
        return F.struct(*[F.coalesce(x[f], y[f]).alias(f) for f in fields])

    def step(done: Column, entry: Column) -> Column:
        at = F.array_position(F.transform(done, lambda d: same(d, entry)), True)
        joined = F.transform(done, lambda d, i: F.when(i == at - 1, merged(d, entry)).otherwise(d))
        return F.when(at > 0, joined).otherwise(F.concat(done, F.array(F.struct(*[entry[f].alias(f) for f in fields]))))

    return F.aggregate(entries, F.slice(F.transform(entries, lambda e: F.struct(*[e[f].alias(f) for f in fields])), 1, 0), step)


def compare_runs(before: DataFrame, after: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """WIN, REGRESS or NEUTRAL for each key of both runs."""
    both = before.select(*keys, F.col(flag).alias("__b")).join(after.select(*keys, F.col(flag).alias("__a")), keys)
    return both.select(*keys, F.when((F.col("__a") > F.col("__b")), "WIN").when(F.col("__a") < F.col("__b"), "REGRESS").otherwise("NEUTRAL").alias("change"))


def outcome_difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Same, changed, lost or gained, null-safe."""
    both = before.select(*keys, F.col(value).alias("__b")).join(after.select(*keys, F.col(value).alias("__a")), keys, "left")
    b, a = F.col("__b"), F.col("__a")
    return both.select(*keys, F.when(b.eqNullSafe(a), "same").when(a.isNull(), "lost").when(b.isNull(), "gained").otherwise("changed").alias("change"))


def zip_outer(names: Column, numbers: Column) -> Column:
    """Names with numbers by position; numbers beyond the names go, missing ones are null."""
    return F.transform(names, lambda n, i: F.struct(n.alias("name"), F.get(numbers, i).alias("number")))


def overlapping(intervals: DataFrame, keys: list[str], ident: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs of half-open intervals of a key that overlap, the earlier start (then lesser id) first.

    Intervals meet through buckets of ``width`` (seconds) of their start: each is copied to the buckets that it
    covers, so the join is an equality join even where one key has very many intervals.
    """
    bucket = F.floor(F.col(start).cast("timestamp").cast("double") / width)
    last = F.floor((F.col(end).cast("timestamp").cast("double") - 1e-6) / width)
    a = intervals.select(*keys, F.col(ident).alias("a"), F.col(start).alias("a_start"), F.col(end).alias("a_end"), F.explode(F.sequence(bucket, last)).alias("__bucket"))
    b = intervals.select(*keys, F.col(ident).alias("b"), F.col(start).alias("b_start"), F.col(end).alias("b_end"), bucket.alias("__bucket"))
    after = (F.col("b_start") > F.col("a_start")) | ((F.col("b_start") == F.col("a_start")) & (F.col("b") > F.col("a")))
    return a.join(b, [*keys, "__bucket"]).where(after & (F.col("b_start") < F.col("a_end"))).select(*keys, "a", "b")


def backfill(rows: DataFrame, reference: DataFrame, cross: str, value: str, order: str) -> DataFrame:
    """Fills a missing value by the first hit of a cross reference; never overwrites."""
    first = reference.where(F.col(value).isNotNull()).groupBy(cross).agg(F.min_by(value, order).alias("__v"))
    return rows.join(first, cross, "left").withColumn(value, F.coalesce(value, "__v")).drop("__v")


def first_winner(rows: DataFrame, keys: list[str], rank: str, won: str) -> DataFrame:
    """Marks each row with whether an earlier one of its key has won, and keeps rows up to the first winner."""
    w = Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("decided", F.coalesce(F.max(F.col(won).cast("int")).over(w), F.lit(0)) > 0)
