"""The parts of a resolution run that keep and reuse what has been found: caches, fingerprints, decisions, estimates.

(S24, S25, J08, J15, J17, L05, M10, M13, M15, M16, M18, M20, A06, A08, A13, A14, A18, A24, U04.)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Responses that are tried again, with the number of tries.
TRANSIENT_STATUS, RATE_STATUS = (500, 502, 503, 504), (420, 429)
TRANSIENT_TRIES, RATE_TRIES = 5, 8


def cached_responses(responses: DataFrame, now: Column, ttl_seconds: int, mode: str = "on", time: str = "fetched_at") -> DataFrame:
    """Responses that may be used: with ``on`` those younger than the time to live, with ``off`` and ``refresh`` none."""
    if mode not in ("on", "off", "refresh"):
        raise ValueError(f"{mode!r} is none of on, off and refresh")
    return responses.where((F.col(time) > now - F.make_dt_interval(secs=F.lit(ttl_seconds))) if mode == "on" else F.lit(False))


def keyed_upsert(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The latest values of each key; combined before the shuffle."""
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last"))
    return found.select(*keys, *[F.col(f"last.{v}").alias(v) for v in values])


def series_fingerprint(series: Column, year: Column, publisher: Column) -> Column:
    """Series, year and publisher in lower case; a missing one is empty."""
    return F.concat_ws("|", *[F.coalesce(F.lower(x.cast("string")), F.lit("")) for x in (series, year, publisher)])


def prompt_fingerprints(candidates: DataFrame, keys: list[str], volume: str, issue: str) -> DataFrame:
    """The sorted distinct volumes of the candidates of a key, its issues where no volume is known."""
    sets = candidates.groupBy(*keys).agg(F.collect_set(F.col(volume).cast("string")).alias("v"), F.collect_set(F.col(issue).cast("string")).alias("i"))
    return sets.select(*keys, F.array_join(F.sort_array(F.when(F.size("v") > 0, F.col("v")).otherwise(F.col("i"))), ",").alias("fingerprint"))


def through_series_cache(people: DataFrame, cache: DataFrame, catalog: DataFrame, fingerprint: str = "fingerprint", number: str = "issue") -> DataFrame:
    """Profiles whose series is in the cache (fingerprint, volume_id) with the catalog's issue of that volume and number."""
    known = people.join(cache.select(fingerprint, "volume_id"), fingerprint)
    return known.join(catalog.select("volume_id", number, "issue_id"), ["volume_id", number])


def first_volumes(rows: DataFrame, fingerprint: str, volume: str, order: str) -> DataFrame:
    """A series cache of what was resolved first."""
    return rows.groupBy(fingerprint).agg(F.min_by(volume, order).alias("volume_id"))


def disagreements(found: DataFrame, reference: DataFrame, key: str, ours: str, theirs: str) -> DataFrame:
    """Rows whose id is another one than that of the reference."""
    return found.join(reference, key).where(F.col(ours) != F.col(theirs))


def misses(rows: DataFrame, results: DataFrame, key: str, missed: Column) -> DataFrame:
    """The rows that missed last time."""
    return rows.join(results.where(missed).select(key), key, "left_semi")


def still_to_do(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The rows without a result."""
    return rows.join(results.select(key), key, "left_anti")


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def latest_times(rows: DataFrame, key: str, time: str, fallback: Column, uses_fallback: Column) -> DataFrame:
    """The latest time of each key; rows that have no time of their own count with that of their file."""
    return rows.groupBy(key).agg(F.max(F.when(uses_fallback, fallback).otherwise(F.col(time))).alias("modified"))


def batch_totals(rows: DataFrame, parsed: Column, failed: Column) -> DataFrame:
    """Parsed, short-circuited, errored and all rows of a batch; the first three make the last."""
    return rows.agg(F.count_if(parsed).alias("parsed"), F.count_if(~parsed & ~failed).alias("short_circuited"), F.count_if(~parsed & failed).alias("errored"), F.count("*").alias("total"))


def first_of_prefix(rows: DataFrame, text: str, pattern: str, ident: str) -> DataFrame:
    """The least id of each prefix of a text."""
    return rows.groupBy(F.regexp_extract(text, pattern, 1).alias("prefix")).agg(F.min(ident).alias(ident))


def bucket_counts(rows: DataFrame, *buckets: Column) -> DataFrame:
    """Rows by bucket."""
    return rows.groupBy(*buckets).agg(F.count("*").alias("n"))


def decade(date: Column) -> Column:
    """A date's decade, such as 1990s."""
    return F.concat((F.floor(F.year(date) / 10) * 10).cast("string"), F.lit("s"))


def alternative_names(rows: DataFrame, keys: list[str], name: str, primary: Column, order: str) -> DataFrame:
    """Distinct names without regard to case, other than the primary one, with the order of their first row."""
    return rows.where(F.lower(name) != F.lower(primary)).groupBy(*keys, F.lower(name).alias("name")).agg(F.min(order).alias(order))


def log_counters(lines: DataFrame, line: str, retries: str, warnings: str, allowed: str, errors: str) -> DataFrame:
    """Lines that look like retries, like warnings without an allowed text, like errors, and all lines."""
    x = F.col(line)
    return lines.agg(F.count_if(x.rlike(retries)).alias("retries"), F.count_if(x.rlike(warnings) & ~x.contains(allowed)).alias("warnings"), F.count_if(x.rlike(errors)).alias("errors"), F.count("*").alias("lines"))


def cluster_order(series: Column, year: Column, ident: Column) -> Column:
    """Rows sorted by series and year; those without a series come last."""
    return F.struct(F.when(F.coalesce(series, F.lit("")) == "", F.lit("~")).otherwise(F.concat_ws("|", F.lower(series), year)).alias("k"), ident.alias("id"))


def compare_covers(ranked: DataFrame, key: str, cover_score: Callable[[DataFrame], DataFrame], blend: Callable[[Column, Column], Column], needs: Column, how_many: Callable[[Column], Column]) -> DataFrame:
    """Covers of the best candidates of the profiles that need them are compared and their scores blended.

    ``ranked`` has place and metadata; ``cover_score`` adds ``cover`` to the rows that it gets (null where a cover is
    missing), so only those few are looked at.  All other rows keep their metadata score.
    """
    w = Window.partitionBy(key)
    marked = ranked.withColumn("n", F.count("*").over(w)).withColumn("wants", F.coalesce(F.max(F.when(F.col("place") == 1, needs)).over(w), F.lit(False)) & (F.col("place") <= how_many(F.col("n"))))
    hashed = cover_score(marked.where("wants")).withColumn("score", F.round(blend(F.col("metadata"), F.col("cover")), 9))
    rest = marked.where(~F.col("wants")).withColumns({"cover": F.lit(None).cast("double"), "score": F.round(F.col("metadata"), 9)})
    return hashed.unionByName(rest).drop("n", "wants")


def failure_kind(status: Column, text: Column) -> Column:
    """rate_limit, transient or permanent, by status or else by what the message says; null without a failure."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(status.isin(*RATE_STATUS) | low.contains("rate limit"), "rate_limit").when(status.isin(*TRANSIENT_STATUS) | low.rlike("timed? ?out|connection (?:reset|refused|aborted)"), "transient")
        .when((status >= 400) | (low != ""), "permanent")
    )


def may_retry(kind: Column, attempt: Column) -> Column:
    """Whether another try is left after so many."""
    return F.when(kind == "rate_limit", attempt < RATE_TRIES).when(kind == "transient", attempt < TRANSIENT_TRIES).otherwise(False)


@dataclass(frozen=True)
class Decisions:
    """Rows that wait for a person, and what persons have decided, as tables in a folder.

    ``defer`` appends open rows (fingerprint, path, volume_id, issue_id, score); a selector, a program or a person,
    appends rows (fingerprint, volume_id) with ``decide``; ``replay`` gives the open rows that are decided now.
    """

    folder: str

    def defer(self, rows: DataFrame) -> None:
        rows.select("fingerprint", "path", "volume_id", "issue_id", "score").write.mode("append").parquet(f"{self.folder}/open")

    def decide(self, rows: DataFrame) -> None:
        rows.select("fingerprint", "volume_id").write.mode("append").parquet(f"{self.folder}/decided")

    def select(self, rows: DataFrame, selector: Callable[[DataFrame], DataFrame]) -> None:
        """A selector gets one row per fingerprint, with its candidates in an array, and returns (fingerprint, volume_id)."""
        asked = rows.groupBy("fingerprint").agg(F.collect_set(F.struct("volume_id", "score")).alias("candidates"))
        self.decide(selector(asked))

    def replay(self, rows: DataFrame) -> DataFrame:
        """Open rows whose fingerprint has a decision and whose volume it is."""
        decided = rows.sparkSession.read.schema("fingerprint string, volume_id bigint").parquet(f"{self.folder}/decided")
        # of several decisions for one fingerprint the least volume counts, so that reruns agree
        return rows.join(decided.groupBy("fingerprint").agg(F.min("volume_id").alias("volume_id")), ["fingerprint", "volume_id"])
