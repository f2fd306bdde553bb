"""Similarity join of names (S19, S20, P12): all pairs whose insert/delete ratio reaches a threshold.

The ratio ``2 * LCS / (len a + len b)`` is at least t only if the longest common subsequence, and so the
number of common characters, is at least ``t * (len a + len b) / 2``.  A name becomes a set of tokens: each
character with the number of its occurrence (anna: a1 n1 n2 a2), so common characters are common tokens.
From this bound follow four filters, none of which loses a pair:

* prefix: with tokens in order of rarity, two names share one of the first ``len - needed + 1``, where
  ``needed`` belongs to the shortest partner that is possible; only these are join keys;
* length: the bound must not exceed the shorter name;
* position: no more tokens can be common than are left behind the first common one;
* count: the common tokens are counted.

A pair is kept at its first common token alone, so nothing needs to be made distinct.  What is left is
verified by a bit-parallel scan.  The join is an equality join on tokens, whose frequent keys Spark splits.
The lower the threshold, the less the bounds exclude: at 0.4 a large part of all pairs of English names is
truly that similar, and the result itself is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from .lookup import small

#: Room for rounding in the bounds; they only ever let more through.
SLACK = 1e-9


def tokens(chars: Column) -> Column:
    """Each character with the number of its occurrence so far."""
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def needed(n: Column, m: Column, threshold: float) -> Column:
    """Characters that names of these lengths must have in common."""
    return F.ceil(threshold * (n + m) / 2 - SLACK)


def _signed(names: DataFrame, ranks: DataFrame, threshold: float) -> DataFrame:
    """name, n, ranked (its tokens as numbers, the rarest first)."""
    spread = names.select("name", F.explode("tokens").alias("token")).join(small(ranks), "token")
    ranked = spread.groupBy("name").agg(F.sort_array(F.collect_list("rank")).alias("ranked"))  # a name is short
    return ranked.withColumn("n", F.size("ranked"))


def _keys(signed: DataFrame, threshold: float) -> DataFrame:
    """One row per token of the prefix: token, at (its place), name, n, ranked."""
    shortest = F.ceil(threshold * F.col("n") / (2 - threshold) - SLACK)
    prefix = F.col("n") - needed(F.col("n"), shortest, threshold) + 1
    return signed.select("name", "n", "ranked", F.posexplode(F.slice("ranked", F.lit(1), F.greatest(prefix, F.lit(1)).cast("int"))).alias("at", "token"))


def ratio_join(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float, out: str = "ratio") -> DataFrame:
    """a, b, out: all pairs of distinct values of ``left.a`` and ``right.b`` with a ratio (0 to 1) of at least ``threshold``.

    Null and empty names are in no pair.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    names = [f.select(F.col(c).alias("name")).where("name <> ''").distinct().withColumn("chars", F.split("name", "")) for f, c in ((left, a), (right, b))]
    # splitting between characters leaves an empty string behind the last one in some versions
    names = [f.select("name", F.filter("chars", lambda c: c != "").alias("chars")).select("name", tokens(F.col("chars")).alias("tokens")) for f in names]
    counts = names[0].unionByName(names[1]).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("often"))
    # as many rows as the alphabet has characters, times the longest name
    ranks = counts.select("token", F.row_number().over(Window.orderBy("often", "token")).alias("rank"))
    x, y = (_keys(_signed(f, ranks, threshold), threshold) for f in names)
    x, y = x.withColumnsRenamed({c: f"x_{c}" for c in ("name", "n", "ranked", "at")}), y.withColumnsRenamed({c: f"y_{c}" for c in ("name", "n", "ranked", "at")})
    bound = needed(F.col("x_n"), F.col("y_n"), threshold)
    left_over = 1 + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) - 1
    met = x.join(y, "token").where((F.least("x_n", "y_n") >= bound) & (left_over >= bound))
    common = F.array_intersect("x_ranked", "y_ranked")
    met = met.select("token", "x_name", "y_name", bound.alias("bound"), common.alias("common")).where((F.array_min("common") == F.col("token")) & (F.size("common") >= F.col("bound")))
    scored = met.select(F.col("x_name").alias(a), F.col("y_name").alias(b), (S.ratio_udf("x_name", "y_name") / 100).alias(out))
    return scored.where(F.col(out) >= threshold - SLACK)


def contained_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """a, b: all pairs of distinct values where the words of one are all among the words of the other.

    The smaller set of words is found by its rarest word, so a frequent word is a key of names that consist of such words alone.
    """
    sides = [f.select(F.col(c).alias("name")).where("name <> ''").distinct().select("name", F.array_distinct(F.split("name", " ")).alias("words")) for f, c in ((left, a), (right, b))]
    often = sides[0].unionByName(sides[1]).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("often"))
    spread = [f.select("name", "words", F.explode("words").alias("word")) for f in sides]
    rarest = [f.join(often, "word").groupBy("name").agg(F.first("words").alias("words"), F.min_by("word", F.struct("often", "word")).alias("word")) for f in spread]

    def within(small_side: DataFrame, large_side: DataFrame, names: tuple[str, str]) -> DataFrame:
        inner, outer = small_side.withColumnsRenamed({"name": names[0], "words": "inner"}), large_side.withColumnsRenamed({"name": names[1], "words": "outer"})
        return inner.join(outer, "word").where(F.size(F.array_except("inner", "outer")) == 0).select(a, b)

    both = within(rarest[0], spread[1], (a, b)).unionByName(within(rarest[1], spread[0], (b, a)))
    return both.distinct()
