"""From raw documents to packed training sequences, in five stages that each apply one operator of ``hubflow.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hubflow.llm import packing, pii, vptree, weak_labels, winnow
from hubflow.llm.common import written
from hubflow.llm.queries import table, vocabulary


#: Rows that a Python worker gets at once. Stages share workers, which keep what they once took, and texts are long.
BATCH_ROWS = 1000


def _in_small_batches(spark: SparkSession) -> None:
    """Batches of few rows hold for what a stage runs, and stay set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained quality scorer passes."""
    _in_small_batches(spark)
    return weak_labels.without_low_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: three-word shingles, at most three differing bits."""
    _in_small_batches(spark)
    return vptree.without_near_duplicates(docs, words_per_shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with a benchmark item."""
    _in_small_batches(spark)
    return winnow.decontaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    _in_small_batches(spark)
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 tokens at the sources' shares."""
    _in_small_batches(spark)
    return packing.pack(docs, vocabulary(), queue="source", window=1024, closing_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Learned stages, fingerprints and tokens cannot be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what a stage returns is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
