"""Counting, reports, estimates, sampling and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import shared_folder
from .lookup import fresh, small

# Score bands of a report, limits of requests.
BANDS = ((0.95, ">=0.95"), (0.85, "0.85-0.95"), (0.70, "0.70-0.85"), (0.50, "0.50-0.70"))
RATE_TOLERANCE = 1.05
CAP_FULL, CAP_MINIMAL = 20, 5


def band(score: Column) -> Column:
    """The band of a score."""
    out = F.lit("<0.50")
    for low, name in reversed(BANDS):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return F.when(score.isNull(), F.lit("none")).otherwise(out)


def outcome_counts(rows: DataFrame, source: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts by source and kind as columns, with a line for the total (source null)."""
    counts = [F.count_if(F.col(kind) == k).alias(k) for k in kinds]
    return rows.rollup(source).agg(*counts, F.count("*").alias("total"))


def accuracy_report(rows: DataFrame, source: str, score: str, correct: str) -> DataFrame:
    """Correct, wrong and accuracy by source and band."""
    found = rows.groupBy(source, band(F.col(score)).alias("band")).agg(F.count_if(F.col(correct)).alias("correct"), F.count_if(~F.col(correct)).alias("wrong"))
    return found.withColumn("accuracy", F.round(F.col("correct") / (F.col("correct") + F.col("wrong")), 6))


def sum_calls(rows: DataFrame, keys: list[str], calls: Column) -> DataFrame:
    """A10: sums of a map column by its keys."""
    return rows.select(*keys, F.explode(calls).alias("method", "n")).groupBy(*keys, "method").agg(F.sum("n").cast("bigint").alias("calls"))


def added_counts(before: Column, after: Column) -> Column:
    """What a counter map gained, positive entries only."""
    return F.map_filter(F.map_zip_with(before, after, lambda k, a, b: F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0))), lambda k, v: v > 0)


def run_estimate(rates: DataFrame, files: int, merge: bool) -> DataFrame:
    """Requests and seconds of a run: summed over sources that are merged, the largest one otherwise."""
    cost = rates.select((F.col("per_file") * files).alias("requests"), F.ceil(F.col("per_file") * files * 60 / F.col("per_minute")).alias("seconds"))
    f = F.sum if merge else F.max
    return cost.agg(f("requests").cast("bigint").alias("requests"), f("seconds").cast("bigint").alias("seconds"))


def rate_failures(rows: DataFrame, source: str, time: str, cap: int, width: str = "minute") -> DataFrame:
    """Minutes (or hours) in which a source had more requests than the cap allows, with a tolerance."""
    counted = rows.groupBy(source, F.date_trunc(width, time).alias(width)).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > cap * RATE_TOLERANCE)


def global_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """``place`` (from 1) of each row in a global order, without a window over all rows.

    Rows are dealt out by ranges and sorted there, and stored, so that they are counted and numbered in one
    arrangement; the rows before a partition are a running sum over one count for each partition.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    mark, part, before = (fresh(c, rows) for c in ("m", "part", "before"))  # a row's own columns stay as they are
    of = F.shiftright(mark, 33)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()).write.parquet(folder)
    marked = spark.read.parquet(folder)
    # as many rows as there are partitions: a window and a broadcast of these alone
    counts = marked.groupBy(of.alias(part)).agg(F.count("*").alias("n"))
    sums = counts.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    placed = marked.withColumn(part, of).join(small(sums), part)
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns if c != "place"], (F.col(mark).bitwiseAND((1 << 33) - 1) + F.col(before) + 1).alias("place"))


def keep_cap(rows: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key; a constant cap lets Spark cut groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def stratified(rows: DataFrame, bucket: list[str], ident: str, n: int, seed: int = 42) -> DataFrame:
    """A round-robin sample over buckets in a seeded order: all first members, then all second ones, up to n."""
    w = Window.partitionBy(*bucket).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(ident).cast("string"))), ident)
    # no bucket can give more than n rows, so the constant limit cuts each bucket before its shuffle
    turn = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return turn.orderBy("turn", *bucket).limit(n)


def rolling_mean(rows: DataFrame, keys: list[str], order: list[str], value: str, last: int = 20) -> DataFrame:
    """Mean of the last values up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - last, 0)
    return rows.withColumn("mean", F.avg(value).over(w))


def shallowest(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The member of each key with the fewest separators, ties to the first name; combined before the shuffle."""
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return rows.groupBy(*keys).agg(F.min(F.struct(depth.alias("depth"), F.lower(path).alias("folded"), F.col(path).alias(path))).alias("m")).select(*keys, f"m.{path}")


def page_slice(pages: Column, first: int, last: int | None) -> Column:
    """Zero-based slice with an inclusive end; no end means until the last page."""
    n = F.size(pages) if last is None else F.lit(last - first + 1)
    return F.slice(pages, first + 1, F.greatest(n, F.lit(0)))


def is_page(name: Column) -> Column:
    """Image members that are no dot files and no resource forks."""
    base = F.element_at(F.split(name, "/"), -1)
    return name.rlike(r"(?i)\.(jpe?g|jxl|webp|png|gif|bmp|tiff?|avif|svg)$") & ~base.startswith(".") & ~name.rlike(r"(^|/)__MACOSX(/|$)")


def cover_candidates(pages: Column, cover_image: Column) -> Column:
    """Distinct covers in order: pages typed as front cover, the named cover if it is a page, the first page."""
    fronts = F.transform(F.filter(pages, lambda p: p["type"] == "FrontCover"), lambda p: p["name"])
    names = F.transform(pages, lambda p: p["name"])
    named = F.filter(F.array(cover_image), lambda c: c.isNotNull() & F.array_contains(names, c))
    return F.array_distinct(F.concat(fronts, named, F.slice(names, 1, 1)))
