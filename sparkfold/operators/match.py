"""Entity resolution: candidates by blocking, signals, scores, ranking, tie-breaks and decisions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from .lookup import fresh

# Weights of the signals and of the blend, credit by year difference, margins.
WEIGHTS = {"series": 0.30, "issue": 0.25, "year": 0.10, "publisher": 0.10, "pages": 0.05}
METADATA_WEIGHT, COVER_WEIGHT = 0.80, 0.20
SCORE_MARGIN, COVER_MARGIN = 0.02, 0.03
NAME_FILTER = {"minimal": 0.7, "balanced": 0.4, "thorough": 0.0}
NO_VOLUME = 1 << 31


@dataclass(frozen=True)
class Policy:
    """Parameters of a decision; a source may override each."""

    mode: str = "auto"  # ask, careful, auto or eager
    threshold: float = 0.95
    minimum: float = 0.50
    margin: float = 0.10
    solo: float = 0.85
    prompts: bool = True


def issue_signal(p_int: Column, p_issue: Column, c_issue: Column, c_int: Column | None = None) -> Column:
    """Equality as integers, else as text without regard to case; 0.5 if either is missing.

    ``c_int`` is the integer of ``c_issue`` where it was made once for each candidate, not for each pair.
    """
    c_int = T.issue_int(c_issue) if c_int is None else c_int
    same = F.lower(F.trim(p_issue)) == F.lower(F.trim(c_issue))
    missing = p_issue.isNull() | c_issue.isNull() | (p_issue == "") | (c_issue == "")
    return F.when(p_int.isNotNull() & c_int.isNotNull(), F.when(p_int == c_int, 1.0).otherwise(0.0)).when(missing, 0.5).otherwise(F.when(same, 1.0).otherwise(0.0))


def year_signal(p: Column, c: Column) -> Column:
    """1, 0.7 and 0.4 for a difference of 0, 1 and 2 years, then falling to 0 at 7."""
    d = F.abs(p - c)
    return F.when(p.isNull() & c.isNull(), 0.5).when(p.isNull() | c.isNull(), 0.3).when(d == 0, 1.0).when(d == 1, 0.7).otherwise(F.greatest(F.lit(0.0), (7 - d) * 0.4 / 5))


def publisher_signal(p: Column, c: Column, keys: tuple[Column, Column] | None = None) -> Column:
    """Equality after normalisation; 0.5 if either is missing.  ``keys`` are the normalised names where they were made once for each row, not for each pair."""
    missing = p.isNull() | c.isNull() | (p == "") | (c == "")
    own, other = keys or (T.normalize_publisher(p), T.normalize_publisher(c))
    return F.when(missing, 0.5).when(own == other, 1.0).otherwise(0.0)


def pages_signal(p: Column, c: Column) -> Column:
    """1 if equal, 0.7 within 10 %, 0.3 within 25 %, else 0; 0.6 if either is missing."""
    share = F.abs(p - c) / F.nullif(p, F.lit(0))
    return F.when(p.isNull() | c.isNull(), 0.6).when(p == c, 1.0).when(p == 0, 0.0).when(share <= 0.10, 0.7).when(share <= 0.25, 0.3).otherwise(0.0)


def metadata_score(signals: dict[str, tuple[Column, Column]]) -> Column:
    """Weighted mean over the signals that have data on either side; name -> (has data, value)."""
    total = sum((F.when(has, WEIGHTS[n] * value).otherwise(0.0) for n, (has, value) in signals.items()), F.lit(0.0))
    weight = sum((F.when(has, WEIGHTS[n]).otherwise(0.0) for n, (has, _) in signals.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight).otherwise(0.0)


def final_score(metadata: Column, cover: Column) -> Column:
    """The blend where a cover was compared, else the metadata alone."""
    return F.when(cover.isNotNull(), METADATA_WEIGHT * metadata + COVER_WEIGHT * cover).otherwise(metadata)


def block_pairs(profiles: DataFrame, candidates: DataFrame, equal: list[str], near: str, reach: int) -> DataFrame:
    """Pairs with equal blocking columns whose integer ``near`` differs by at most ``reach``.

    A profile is copied to each value in reach, so the join is an equality join on all blocking columns.
    Columns of profiles and candidates must differ, apart from the blocking columns.
    """
    spread = profiles.withColumn("__near", F.explode(F.sequence(F.col(near) - reach, F.col(near) + reach)))
    return spread.join(candidates.withColumnRenamed(near, "__near"), [*equal, "__near"]).withColumnRenamed("__near", f"c_{near}")


def rank(pairs: DataFrame, profile: str, score: str, volume: str, issue: str) -> DataFrame:
    """Place by score, then volume (missing last), then issue; gap to the next; number of viable ones."""
    w = Window.partitionBy(profile).orderBy(F.col(score).desc(), F.col(volume).asc_nulls_last(), issue)
    return pairs.withColumn("place", F.row_number().over(w)).withColumn("gap", F.coalesce(F.col(score) - F.lead(score).over(w), F.lit(1.0)))


def best(pairs: DataFrame, profile: str, score: str, volume: str, issue: str, minimum: float) -> DataFrame:
    """W01, W03, W04 for the first candidate alone: profile, issue, score, gap, viable and solo as ``rank`` and ``viable`` give them at place 1.

    Candidates of one score are counted before anything is sorted, so pairs are neither sorted nor kept as rows.
    """
    first = F.struct(F.col(volume).isNull().alias("none"), F.col(volume).alias("volume"), F.col(issue).alias("issue"))
    same = pairs.groupBy(profile, F.col(score).alias("__score")).agg(F.count("*").alias("__n"), F.min(first).alias("__first"))
    w = Window.partitionBy(profile).orderBy(F.col("__score").desc())
    # a second candidate of the same score has no distance
    gap = F.coalesce(F.when(F.col("__n") > 1, F.col("__score") - F.col("__score")).otherwise(F.col("__score") - F.lead("__score").over(w)), F.lit(1.0))
    viable_ = F.coalesce(F.sum(F.when(F.col("__score") >= minimum, F.col("__n"))).over(Window.partitionBy(profile)), F.lit(0))
    top = same.withColumn("gap", gap).withColumn("viable", viable_).withColumn("__place", F.row_number().over(w)).where("__place = 1")
    return top.select(profile, F.col("__first.issue").alias(issue), F.col("__score").alias(score), "gap", "viable", (F.col("viable") == 1).alias("solo"))


def viable(pairs: DataFrame, profile: str, score: str, minimum: float) -> DataFrame:
    """Number of candidates at the minimum or above, and whether it is one."""
    n = F.count_if(F.col(score) >= minimum).over(Window.partitionBy(profile))
    return pairs.withColumn("viable", n).withColumn("solo", n == 1)


def hash_count(n: Column) -> Column:
    """How many of n candidates get their cover compared."""
    return F.least(F.lit(15), F.greatest(F.lit(5), F.floor(n / 2).cast("int")))


def needs_hash(top: Column, gap: Column, policy: Policy) -> Column:
    """Whether covers must decide: the top is viable but not both confident and apart."""
    return (top >= policy.minimum) & ~((top >= policy.threshold) & (gap >= policy.margin))


def auto_writes(top: Column, gap: Column, solo: Column, policy: Policy) -> Column:
    """Whether a policy writes without asking."""
    clear = (top >= policy.threshold) & (gap >= policy.margin)
    alone = solo & (top >= policy.solo)
    return {"ask": F.lit(False), "careful": clear, "auto": clear | alone, "eager": (top >= policy.threshold) | alone}[policy.mode]


def resolve(top: Column, gap: Column, solo: Column, policy: Policy) -> Column:
    """NO_MATCH, AUTO_WRITE, PROMPT or SKIP for a profile's best candidate."""
    return F.when(F.coalesce(top, F.lit(0.0)) < policy.minimum, "NO_MATCH").when(auto_writes(top, gap, solo, policy), "AUTO_WRITE").otherwise("PROMPT" if policy.prompts else "SKIP")


def tie_break(pairs: DataFrame, profile: str) -> DataFrame:
    """Within runs of equal metadata, the order by volume and issue.

    A run holds the candidates behind its leader with the leader's metadata score, a score at most 0.02 below
    and a cover score that differs by at most 0.03 (or is missing on either side).  A run ends at the latest where
    the metadata score changes or the score falls by more than 0.02 from one candidate to the next; windows find these
    stretches, which are then scanned in order, each as a whole and any number of them by one task; the scan holds one leader.
    ``pairs`` has place, metadata, score, cover, volume and issue; the result has ``final_place``.
    """
    in_order = Window.partitionBy(profile).orderBy("place")
    # scores are rounded so that a difference of exactly the margin counts as within it
    goes_on = F.lag("metadata").over(in_order).eqNullSafe(F.col("metadata")) & (F.round(F.lag("score").over(in_order) - F.col("score"), 9) <= SCORE_MARGIN)
    marked = pairs.select(profile, "place", "metadata", "score", "cover", "volume", "issue", F.when(goes_on, 0).otherwise(1).alias("__new"))
    rows = marked.withColumn("__stretch", F.sum("__new").over(in_order)).select(profile, "__stretch", "place", "volume", "issue", F.col("score").cast("double"), F.col("cover").cast("double"), "__new")
    schema = StructType([*rows.schema.fields[:5], StructField("__run", LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the runs of sorted stretches; what is kept from row to row is the leader alone."""
        score = cover = None
        run = 0
        for batch in batches:
            runs = []
            for s, c, new in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                if new or round(score - s, 9) > SCORE_MARGIN or not (cover is None or c is None or abs(cover - c) <= COVER_MARGIN):
                    score, cover, run = s, c, 0 if new else run + 1
                runs.append(run)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(runs, pa.int64())], names=schema.names)

    sorted_ = rows.repartition(profile, "__stretch").sortWithinPartitions(profile, "__stretch", "place")
    final = Window.partitionBy(profile).orderBy("__stretch", "__run", F.coalesce("volume", F.lit(NO_VOLUME)), "issue", "place")
    return sorted_.mapInArrow(scan, schema).select(profile, "issue", "place", F.row_number().over(final).alias("final_place"))


def keep_by_name(pairs: DataFrame, similarity: str, effort: str, name: str, other: str | None = None) -> DataFrame:
    """Candidates whose name is similar enough for the effort; a name that is missing on either side keeps."""
    missing = F.col(name).isNull() | (F.col(other).isNull() if other else F.lit(False))
    return pairs.where(missing | (F.col(similarity) >= NAME_FILTER[effort]))


def least_tier(pairs: DataFrame, profile: str, tier: str) -> DataFrame:
    """Candidates of the first tier that has any."""
    least = fresh("__least", pairs)
    return pairs.withColumn(least, F.min(tier).over(Window.partitionBy(profile))).where(F.col(tier) == F.col(least)).drop(least)


def effort_for(batch: Column, unattended: Column, terminal: Column, pinned: Column) -> Column:
    """Minimal effort for large batches: 50 without anyone there, 200 without a terminal, unless it is pinned."""
    large = (unattended & (batch >= 50)) | (~terminal & (batch >= 200))
    return F.when(~pinned & large, "minimal").otherwise("balanced")
