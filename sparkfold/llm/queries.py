"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filter_audit, fingerprint, language_id, line_dedup, matroska, near_dup, packing, periodic, quality, sharding, token_count, url_filter
from .session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), token_count.tokenizer_path(), capacity=1024, closing_id=0)


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op2_sharding(_table(spark, sf_dir, "documents"), shared_dir(spark))


ORACLES["op2_sharding"] = sharding.ORACLE


@_query
def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.op3_media(_table(spark, sf_dir, "documents"))


@_query
def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8)


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op5_language_id(_table(spark, sf_dir, "documents"))


@_query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op6_url_filter(_table(spark, sf_dir, "pages"))


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op7_line_dedup(_table(spark, sf_dir, "documents"))


ORACLES["op7_line_dedup"] = line_dedup.ORACLE


@_query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.op10_token_counts(_table(spark, sf_dir, "documents"), token_count.tokenizer_path(), limit=1024)


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op11_filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = filter_audit.ORACLE


@_query
def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.op12_fingerprint(_table(spark, sf_dir, "documents"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.op13_periodic_runs(_table(spark, sf_dir, "documents"))
