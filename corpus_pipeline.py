"""The corpus pipeline: stages that each read what their predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``documents``; the last one
returns the packed pieces.  Extra columns pass through the stages, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfold.llm import decontaminate, line_dedup, near_dup, packing, quality, token_count
from sparkfold.llm.session import fresh_name, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality classifier rejects (score below 0.7) go.

    Null and empty texts have the score of a text without tokens; repeated rows have one fate.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~quality.held_out())
    score = fresh_name("score", docs.columns)
    return quality.score(docs, model, out=score).where(F.col(score) >= quality.ACCEPT).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: lines in later occurrences of three-line windows go; n_chars follows the text.

    Null texts stay null; a document that loses all its lines stays as an empty text.
    """
    kept = line_dedup.deduplicate_lines(docs)
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of each group of near duplicates the document of the least doc_id stays.

    A null doc_id is greater than all others; null and empty texts are one group; of repeated rows one stays.
    """
    return near_dup.keep_first(docs, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents that hold a benchmark item go; null texts and null items match nothing."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: packs all that is left into sequences of 1024 tokens; one row per piece, null texts are the closing id alone."""
    return packing.pack(docs, token_count.tokenizer_path(), capacity=1024, closing_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The models and the similarity search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    docs, base = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
