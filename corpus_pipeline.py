"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Quality classifier, MinHash near-dedup, suffix-array dedup, mixing sources,
best-fit packing. Every stage takes (spark, docs, sf_dir) and works on all rows
its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwise.llm import minhash_dedup, mixing, packing, quality, suffix_dedup
from driftwise.llm.shared import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, trained on these documents' labels, scores under its threshold."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of every group of near copies."""
    return minhash_dedup.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur in an earlier document; documents stay, if need be with an empty text."""
    return suffix_dedup.strip_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to source, language and topic targets."""
    return mixing.sample_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens: one row per piece with its place."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
