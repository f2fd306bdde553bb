"""URL filter: host and path rules first, then a character language-model ratio.

Two smoothed variable-order Markov models (orders 0 to 3, each interpolated with the next shorter one by
the Witten-Bell rule) are trained on the URLs that the rules accept and on those that they reject.  A URL
without a rule is judged by its mean log-likelihood difference per character against a threshold, which is
calibrated on labelled URLs that the models have not seen.

Counts and the score histogram of the calibration come from all labelled URLs, counted on the executors
and summed by Spark.  Characters are folded to 48 symbols, so a model has 48^4 contexts with a symbol at
most: what is collected and broadcast is bounded (one table of 21 MB), however many URLs there are.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; an empty URL
scores 0; where one of the two classes has no URL the difference is 0 everywhere; a score that equals the
threshold is allowed; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernels as K
from .session import bounded, fresh_name, stored

#: (host, path, accept): a rule fits its host and all subdomains where the path starts with its path.
RULES = [("org", "/", True), ("example.org", "/es/", False), ("example.org", "/en/1", False), ("com", "/fr/", True), ("com", "/de/", False)]
SYMBOLS = 48
_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789/.-?=&#_%:"  # symbols 1 to 46; 47 is any other, 0 stands before a URL
#: Labelled URLs with this hash remainder calibrate, the others train.
CALIBRATION = 5
#: The histogram of scores: bins of 0.01 between -10 and 10.
BINS, REACH = 2000, 10.0


def _fold() -> np.ndarray:
    table = np.full(256, 47, np.int64)
    for i, c in enumerate(_CHARACTERS):
        table[ord(c)] = table[ord(c.upper())] = i + 1
    return table


def symbol_grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each character with the three before it as one number, and the offsets of the texts."""
    data, offsets = K.text_buffers(column)
    wide = np.concatenate([np.zeros(3, np.int64), _fold()[data]])
    n, base = len(data), SYMBOLS
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    out = wide[3:].copy()
    for k in (1, 2, 3):
        out += np.where(place >= k, wide[3 - k : n + 3 - k], 0) * base**k
    return out, offsets


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """ln P(symbol | three before it) for all SYMBOLS^4 cases, from their counts."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(4):
        here = counts.reshape(-1, SYMBOLS**order, SYMBOLS).sum(axis=0)  # counts behind the last ``order`` symbols
        kinds = (here > 0).sum(axis=1, keepdims=True)
        total = here.sum(axis=1, keepdims=True)
        shorter = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order else 1, 1)) if order else p[None, :]
        p = np.where(total > 0, (here + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
    return np.log(p).ravel()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, bool]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and whether it accepts."""
    name, accept = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for h, p, ok in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, accept = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(ok)).otherwise(accept)
    return name, accept


def _scored(rows: DataFrame, table, text: str, out: str) -> DataFrame:
    at = rows.columns.index(text)
    schema = StructType([*rows.schema.fields, StructField(out, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        for batch in batches:
            keys, offsets = symbol_grams(batch.column(at))
            total = np.concatenate([[0], np.cumsum(ratio[keys], dtype=np.float64)])
            length = np.diff(offsets)
            score = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(length, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def fit(labelled: DataFrame) -> tuple[np.ndarray, float]:
    """Log-likelihood difference of every case, and the calibrated threshold, from rows (url, accept)."""
    spark = labelled.sparkSession
    bounded(spark)
    calibrates = F.pmod(F.xxhash64("url"), F.lit(CALIBRATION)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one table of SYMBOLS^4 counts for each side that occurs
        held: dict[bool, np.ndarray] = {}
        for batch in batches:
            accept = batch.column(1).to_numpy(zero_copy_only=False)
            for side in (True, False):
                keys, _ = symbol_grams(batch.column(0).filter(pa.array(accept == side)))
                keys, times = np.unique(keys, return_counts=True)
                held.setdefault(side, np.zeros(SYMBOLS**4, np.int64))[keys] += times
        for side, counts in held.items():
            keys = np.flatnonzero(counts)
            n = counts[keys]
            yield pa.RecordBatch.from_arrays([pa.array([side] * len(keys), pa.bool_()), pa.array(keys), pa.array(n)], names=["accept", "gram", "n"])

    summed = labelled.where(~calibrates).select("url", "accept").mapInArrow(count, "accept boolean, gram long, n long").groupBy("accept", "gram").agg(F.sum("n").alias("n")).toArrow()
    side, gram, n = (summed[c].to_numpy() for c in ("accept", "gram", "n"))
    ratio = np.zeros(SYMBOLS**4, np.float32)
    if side.any() and not side.all():
        for accept, sign in ((True, 1), (False, -1)):
            counts = np.zeros(SYMBOLS**4)
            counts[gram[side == accept]] = n[side == accept]
            ratio += (sign * log_probabilities(counts)).astype(np.float32)
    scored = _scored(labelled.where(calibrates).select("url", "accept"), spark.sparkContext.broadcast(ratio), "url", "score")
    bin_of = F.least(F.greatest(F.floor((F.col("score") + REACH) * (BINS / 2 / REACH)), F.lit(0)), F.lit(BINS - 1)).cast("int")
    histogram = np.zeros((2, BINS))
    for r in scored.groupBy("accept", bin_of.alias("bin")).agg(F.count("*").alias("n")).collect():
        histogram[int(r.accept), r.bin] = r.n
    if not histogram.sum(axis=1).all():
        return ratio, 0.0
    share = histogram / histogram.sum(axis=1, keepdims=True)
    # allowed are scores at or above the threshold: wrongly blocked below it, wrongly allowed from it on
    errors = np.concatenate([[0], np.cumsum(share[1])]) + 1 - np.concatenate([[0], np.cumsum(share[0])])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return ratio, float(best[len(best) // 2]) * 2 * REACH / BINS - REACH


def judge(pages: DataFrame, rules: list[tuple[str, str, bool]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score (mean log-likelihood difference per character) and verdict."""
    host, path = split_url(F.col(f"`{url}`"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "score", "verdict")]
    label = fresh_name("accept", [*own, "host", "path", "rule", "score", "verdict"])
    parts = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    name, accept = rule_for(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", name.alias("rule"), accept.alias(label))
    labelled = stored(ruled.where(F.col(label).isNotNull()).select(F.col(f"`{url}`").alias("url"), F.col(label).alias("accept")))
    ratio, threshold = fit(labelled)
    scored = _scored(ruled, pages.sparkSession.sparkContext.broadcast(ratio), url, "score")
    verdict = F.when(F.coalesce(label, F.col("score") >= threshold), F.lit("allow")).otherwise(F.lit("block"))
    return scored.withColumn("verdict", verdict).drop(label)


def op6_url_filter(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
