"""Document vectors to one vector per entity and year, plain and weighted by citations."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def entity_years(docs: DataFrame, include_empty: bool = False, entity: str = "stkcd", year: str = "p_year") -> DataFrame:
    """One row per entity and year: counts, citations, embedding and embedding_citw.

    The plain mean takes documents with text, or all where none has any (or with
    ``include_empty``). The weighted mean takes all, and is the plain one where
    citations sum to nothing. Vector sums are mergeable JVM aggregates, so rows
    shrink to one per group before they are shuffled.
    """
    e = V.as_doubles(F.col("embedding"))
    full = (~F.col("text_is_empty")).cast("double")
    total = lambda v: Summarizer.mean(array_to_vector(v))
    sums = docs.where(F.col("embedding").isNotNull()).groupBy(entity, year).agg(
        F.count(F.lit(1)).alias("n_patents"),
        F.count_if(~F.col("text_is_empty")).alias("n_full"),
        F.sum("p_cite").alias("total_citations"),
        total(e).alias("every"),
        total(V.scaled(e, full)).alias("texts"),
        total(V.scaled(e, F.col("p_cite"))).alias("cited"),
    )
    n = F.col("n_patents")
    summed = lambda c: V.scaled(vector_to_array(F.col(c)), n.cast("double"))
    everything = F.lit(include_empty) | (F.col("n_full") == 0)
    used = F.when(everything, n).otherwise(F.col("n_full"))
    simple = F.when(everything, V.divided(summed("every"), used)).otherwise(V.divided(summed("texts"), used))
    rows = sums.withColumns({"n_texts_used": used, "embedding": simple})
    weighted = F.when(F.col("total_citations") > V.TOLERANCE, V.divided(summed("cited"), F.col("total_citations"))).otherwise(F.col("embedding"))
    return rows.select(
        entity, year, F.concat_ws("_", entity, year).alias("stkcd_year"), "n_patents", "n_texts_used", "total_citations",
        F.try_divide("total_citations", n).alias("mean_citations"), "embedding", weighted.alias("embedding_citw"),
    )


def vector_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Smallest, largest, mean and population deviation of all components, and the mean norm."""
    norms = df.select(V.as_doubles(F.col(vector)).alias("v")).withColumn("norm", V.norm(F.col("v")))
    total = norms.select(F.size("v").alias("k"), F.array_min("v").alias("lo"), F.array_max("v").alias("hi"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("s"), V.dot(F.col("v"), F.col("v")).alias("ss"), "norm")
    sums = total.agg(F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("k").alias("k"), F.avg("norm").alias("mean_norm"))
    mean = F.col("s") / F.col("k")
    return sums.select("min", "max", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("k") - mean * mean, F.lit(0.0))).alias("std"), "mean_norm")
