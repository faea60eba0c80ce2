"""Breaks in an entity's course: years far from the year before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_DOCS, THRESHOLD, MIN_YEARS = 5, 0.5, 4
KEYS = ("stkcd", "p_year")


def compared(years: DataFrame, min_docs: int = MIN_DOCS, measure: str = "cos_sim_lag1") -> DataFrame:
    """Rows with a similarity and enough documents, and how far it fell from 1."""
    return years.where(F.col(measure).isNotNull() & ~F.isnan(measure) & (F.col("n_patents") >= min_docs)).withColumn("sim_drop", 1 - F.col(measure))


def breaks(years: DataFrame, min_docs: int = MIN_DOCS, threshold: float = THRESHOLD, measure: str = "cos_sim_lag1") -> DataFrame:
    return compared(years, min_docs, measure).where(F.col(measure) < threshold)


def ranked(found: DataFrame, measure: str = "cos_sim_lag1") -> DataFrame:
    """Breaks from the lowest similarity up, ties by entity and year."""
    return found.orderBy(measure, *KEYS)


def common_breaks(a: DataFrame, b: DataFrame, names=("minilm", "distiluse"), **options) -> DataFrame:
    """Breaks that both models see, with both similarities: one join of two filtered tables."""
    one = breaks(a, **options).select(*KEYS, "n_patents", F.col("cos_sim_lag1").alias(f"{names[0]}_sim"))
    two = breaks(b, **options).select(*KEYS, F.col("cos_sim_lag1").alias(f"{names[1]}_sim"))
    return one.join(two, list(KEYS)).withColumnRenamed("p_year", "year")


def first_breaks(common: DataFrame, n: int = 20) -> DataFrame:
    return common.orderBy("stkcd", "year").limit(n)


def model_stats(years: DataFrame, min_docs: int = MIN_DOCS, threshold: float = THRESHOLD, measure: str = "cos_sim_lag1") -> DataFrame:
    rows = compared(years, min_docs, measure)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(measure).alias("mean"), F.median(measure).alias("median"), F.stddev_samp(measure).alias("sd"), F.count_if(F.col(measure) < threshold).alias("n_breaks"))


def trajectories(years: DataFrame, entities: int | None = None, min_years: int = MIN_YEARS, min_docs: int = MIN_DOCS, threshold: float = THRESHOLD, measure: str = "cos_sim_lag1") -> DataFrame:
    """Entities with enough compared years and at least one break: their years, similarities (rounded to thousandths) and counts in order.

    ``entities`` limits the search to the first so many codes, where that is wanted.
    """
    rows = compared(years, min_docs, measure)
    if entities is not None:
        rows = rows.join(rows.select("stkcd").distinct().orderBy("stkcd").limit(entities), "stkcd", "left_semi")
    course = rows.groupBy("stkcd").agg(F.array_sort(F.collect_list(F.struct("p_year", F.col(measure).alias("sim"), "n_patents"))).alias("course"))
    low = F.filter("course", lambda x: x["sim"] < threshold)
    return course.where((F.size("course") >= min_years) & (F.size(low) > 0)).select(
        "stkcd", F.col("course.p_year").alias("years"), F.transform("course.sim", lambda x: F.round(x, 3)).alias("similarities"), F.col("course.n_patents").alias("patents"), low.alias("low_sim_years")
    )


def two_model_course(a: DataFrame, b: DataFrame, names=("minilm", "distiluse")) -> DataFrame:
    """All columns of the first model and the second one's similarity, of entity-years in both."""
    one = a.withColumnRenamed("cos_sim_lag1", f"cos_sim_lag1_{names[0]}")
    return one.join(b.select(*KEYS, F.col("cos_sim_lag1").alias(f"cos_sim_lag1_{names[1]}")), list(KEYS))


def one_course(years: DataFrame, min_years: int = 5) -> DataFrame:
    """The course of the first entity, by code, with at least so many years."""
    long = years.groupBy("stkcd").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_years).orderBy("stkcd").limit(1)
    return years.join(long.select("stkcd"), "stkcd", "left_semi")
