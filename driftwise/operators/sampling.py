"""Small samples that cover long and short histories, and counts for inspecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def year_spans(years: DataFrame) -> DataFrame:
    """Rows per entity and the span of its years as text."""
    return years.groupBy("stkcd").agg(F.count(F.lit(1)).alias("n_years"), F.concat_ws("-", F.min("p_year").cast("string"), F.max("p_year").cast("string")).alias("year_range"))


def strata(years: DataFrame) -> DataFrame:
    """The first entity of each length of history: many (20 and up), medium (5 to 10), few (2 or 3), single."""
    n = F.col("n_years")
    name = F.when(n >= 20, "many").when(n.between(5, 10), "medium").when(n.between(2, 3), "few").when(n == 1, "single")
    ranked = year_spans(years).withColumn("stratum", name).where("stratum is not null")
    first = Window.partitionBy("stratum").orderBy(F.desc("n_years"), "stkcd")
    return ranked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def edge_cases(years: DataFrame) -> DataFrame:
    """The first entity with exactly one, two and three rows."""
    first = Window.partitionBy("n_years").orderBy("stkcd")
    return year_spans(years).where("n_years <= 3").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def of_entities(df: DataFrame, chosen: DataFrame) -> DataFrame:
    return df.join(chosen.select("stkcd"), "stkcd", "left_semi")


def company_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("stkcd").agg(F.count(F.lit(1)).alias("n_patents"), F.min("p_year").alias("first_year"), F.max("p_year").alias("last_year"), F.countDistinct("p_year").alias("n_years"))


def firm_year_stats(docs: DataFrame) -> DataFrame:
    cites = F.sum("p_cite") if "p_cite" in docs.columns else F.lit(0.0)
    return docs.groupBy("stkcd", "p_year").agg(F.count("text").alias("n_texts"), F.count_if("text_is_empty").alias("n_empty"), cites.alias("total_citations"), F.avg(F.char_length("text")).alias("mean_chars"))


def firm_year_summary(docs: DataFrame) -> DataFrame:
    return docs.groupBy("stkcd", "p_year").agg(F.count("p_tt").alias("n_patents"), F.count("p_cite").alias("n_with_citations"), F.sum("p_cite").alias("total_citations"))


def overview(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct("stkcd").alias("n_firms"), F.countDistinct("stkcd", "p_year").alias("n_firm_years"), F.countDistinct("p_year").alias("n_years"), F.count_if("text_is_empty").alias("n_empty"))
