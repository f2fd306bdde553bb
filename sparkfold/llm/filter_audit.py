"""Filter interaction audit: what every filter removes in every order of the filters, in DataFrame operations only.

A text is reduced to a mask of the filters that it fails.  Documents of the same part, mask and marks
(good, toxic) form a cell with their number, so what follows does not grow with the documents.  The cells
are unpivoted against the steps of all orders; a running bit-or over the earlier steps of an order tells
which failures come too late, conditional sums give the metrics of a step, and a window over a filter's
steps in all orders gives its total.

The filter on repeated texts compares SHA-256 digests.  Copies are counted before they are shuffled by
digest, so a group of copies of any size is a few rows; a null doc_id is dealt out by its text.

Defined results: a null text is an empty one (no words, no characters; a copy of other empty texts), a null
part is the empty string; a text is a repeat if its doc_id is greater than another that has the same text,
so rows of one doc_id don't repeat each other, and a null doc_id neither is nor has a repeat, nor a label;
a document is good or toxic if any of its label rows says so; an empty table has no part and gives no row.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Filters that one audit takes at most: n filters have n! orders.
MOST = 7


def words(text: Column) -> Column:
    """Maximal runs of characters that are no ASCII white space."""
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")  # a single character needs no regular expression


def text_conditions(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text that is not null, and of its ``words``."""
    n = F.size(words).cast("long")
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, marks: DataFrame, conditions: dict[str, Column], doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, the columns of ``marks`` but for its first, and n (documents) of each cell.

    ``conditions`` are failure conditions over the columns ``text``, ``words`` and ``part``, none of them
    ever null; bit i of the mask stands for the i-th, the bit above for a repeat of a smaller doc_id's text.
    ``marks`` has a key and boolean columns.
    """
    key, *names = marks.columns
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("text"), words(body).alias("words"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    known = F.col("id").isNotNull()
    rows = rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"), known.alias("known"), F.when(known, F.col("id")).otherwise(F.xxhash64("text")).alias("at"))
    marked = marks.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("long").alias("at")).agg(*[F.max(F.coalesce(F.col(f"`{c}`"), F.lit(False))).alias(c) for c in names])
    joined = rows.join(marked.withColumn("known", F.lit(True)), ["at", "known"], "left").select("id", "part", "mask", "digest", "at", "known", *[F.coalesce(c, F.lit(False)).alias(c) for c in names])
    # rows of one doc_id and text count as one; the join has brought them together
    counted = joined.groupBy("at", "known", "id", "digest", "part", "mask", *names).agg(F.count("*").alias("n"))
    copies = counted.groupBy("digest", "part", "mask", *names).agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("least_n"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("n"))), F.lit(0)).alias("loose"))
    first = F.min("least").over(Window.partitionBy("digest"))
    kept = F.col("loose") + F.when(F.col("least") == first, F.col("least_n")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), (F.col("n") - kept).alias("n")))
    cells = copies.select("part", *names, split.alias("both")).select("part", *names, F.explode("both").alias("cell")).where("cell.n > 0")
    return cells.groupBy("part", F.col("cell.mask").alias("mask"), *names).agg(F.sum("cell.n").alias("n"))


def interactions(cells: DataFrame, filters: str, losses: dict[str, str]) -> DataFrame:
    """One row per part, order of the filters and step, from the cells of ``mask_cells``.

    ``filters`` has a letter for each bit of the mask, the lowest first; ``losses`` names, for a mark, the
    column that counts the marked documents that a step removes.
    """
    if not 0 < len(set(filters)) == len(filters) <= MOST:
        raise ValueError(f"an audit takes 1 to {MOST} different filters")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(sorted(filters))])
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    steps = steps.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("failed", F.col("mask").bitwiseAND(F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)")))
    before = Window.partitionBy("part", "mask", *losses, "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, late = F.col("failed") != 0, F.col("earlier") != 0

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    metrics = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~late).alias("kept"), total(fails & ~late).alias("removed"), total(fails & late).alias("redundant"), total(fails & (F.col("mask") == F.col("failed"))).alias("unique_fails"),
        *[total(fails & ~late & F.col(mark)).alias(name) for mark, name in losses.items()],
    )
    return metrics.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def op11_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E in all 120 orders, per language."""
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    cells = mask_cells(docs, marks, text_conditions(F.col("text"), F.col("words")))
    return interactions(cells, "ABCDE", {"good": "good_lost", "bad": "toxic_lost"}).drop("filter")


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), masks AS (
  SELECT part,
         (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad
  FROM texts
), cells AS (
  SELECT part, mask, good, bad, count(*) AS n FROM masks GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, s.step, substr(filter_order, s.step, 1) AS f, 1 << (strpos('ABCDE', substr(filter_order, s.step, 1)) - 1)::INT AS bit,
         coalesce(list_sum(list_transform(range(1, s.step), lambda j: 1 << (strpos('ABCDE', substr(filter_order, j, 1)) - 1)::INT)), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step) s
), metrics AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND bad THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM metrics
"""
