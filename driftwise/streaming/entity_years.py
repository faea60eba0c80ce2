"""Entity-year sums kept up to date from a stream of embedded documents.

The sums are mergeable, so each micro-batch is aggregated on its own and merged
with the sums so far; a batch that is replayed replaces its own version and is
not counted twice. Every version is complete, and the last one is read with
``current``.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.readers import exists

KEYS = ("stkcd", "p_year")


def sums(docs: DataFrame) -> DataFrame:
    """Count and vector sum of documents with text per entity and year."""
    total = docs.where("not text_is_empty and embedding is not null").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(array_to_vector(V.as_doubles(F.col("embedding")))).alias("m"))
    return total.select(*KEYS, "n", V.scaled(vector_to_array("m"), F.col("n").cast("double")).alias("s"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), Summarizer.mean(array_to_vector("s")).alias("m"))
    return both.select(*KEYS, "n", V.scaled(vector_to_array("m"), F.col("k").cast("double")).alias("s"))


def _version(folder: str, number: int) -> str:
    return f"{folder}/v={number}"


def update(folder: str):
    """For ``foreachBatch``: version n + 1 holds version n and the batch n."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _version(folder, number)
        now = sums(batch)
        if number and exists(spark, before):
            now = merged(spark.read.parquet(before), now)
        now.write.mode("overwrite").parquet(_version(folder, number + 1))

    return run


def current(spark: SparkSession, folder: str, version: int) -> DataFrame:
    rows = spark.read.parquet(_version(folder, version))
    return rows.select(*KEYS, F.col("n").alias("n_texts_used"), V.divided(F.col("s"), F.col("n")).alias("embedding"))


def start(stream: DataFrame, folder: str, checkpoint: str, **trigger):
    """A running query over a stream with the columns stkcd, p_year, text_is_empty and embedding."""
    return stream.writeStream.foreachBatch(update(folder)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
