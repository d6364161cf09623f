"""Documents to token digests in five stages. Counted as part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrolith.llm import byte_bpe, mixing, ngram_join, quality_mil, stream_dedup
from corrolith.llm.common import new_path, table
from corrolith.llm.queries import GOOD, RANKS, quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. An empty table stays empty."""
    return quality_mil.good_rows(docs, quality_model(docs, table(spark, sf_dir, "labels")), GOOD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    return stream_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id stays."""
    return ngram_join.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document that is left."""
    return byte_bpe.encode_digests(docs, RANKS)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_duplicates", near), ("mix", mix), ("byte_bpe", encode)]

#: The learned classifier and the tokenizer are beyond SQL. The stages after the first are tested one by one; a brute-force test of run() is open.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
