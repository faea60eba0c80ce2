"""How close each entity-year is to the entity's own past."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from ..functions import vectors as V
from ..sources.scratch import scratch

NAMES = ("cos_sim_lag1", "cos_sim_lag3", "cos_sim_cumulative")


def require_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    kind = df.schema[vector].dataType if vector in df.columns else None
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, NumericType)):
        raise ValueError(f"{vector} must be an array of numbers")
    return df


def similarities(years: DataFrame, vectors: dict[str, str], calendar: bool = False, entity: str = "stkcd", year: str = "p_year") -> DataFrame:
    """Cosine to the row before, to the mean of the three before, and to the mean of all before.

    ``vectors`` gives the suffix of the measures of each vector column. Rows, not
    calendar years, are counted, unless ``calendar`` is set; then the first two
    are null where one of the years they need is missing. All measures of all
    vectors read one window, so the table is dealt out and sorted once. An entity
    has as many rows as years, which bounds what its frames hold.
    """
    by = Window.partitionBy(entity).orderBy(year)
    added = {"_y1": F.lag(year, 1).over(by), "_y3": F.lag(year, 3).over(by)}
    rows = years
    for k, vector in enumerate(vectors):
        require_vectors(years, vector)
        rows = rows.withColumn(f"_v{k}", V.as_doubles(F.col(vector)))
        added |= {
            f"_one{k}": F.lag(f"_v{k}", 1).over(by),
            f"_three{k}": F.collect_list(f"_v{k}").over(by.rowsBetween(-3, -1)),
            f"_all{k}": F.collect_list(f"_v{k}").over(by.rowsBetween(Window.unboundedPreceding, -1)),
        }
    near = (F.col("_y1") == F.col(year) - 1) if calendar else F.lit(True)
    three = (F.col("_y3") == F.col(year) - 3) if calendar else F.lit(True)
    measures = []
    for k, suffix in enumerate(vectors.values()):
        own = F.col(f"_v{k}")
        values = (
            F.when(near, V.safe_cosine(own, F.col(f"_one{k}"))),
            F.when((F.size(f"_three{k}") == 3) & three, V.safe_cosine(own, V.mean_of(F.col(f"_three{k}")))),
            V.safe_cosine(own, V.mean_of(F.col(f"_all{k}"))),
        )
        measures += [x.alias(n + suffix) for x, n in zip(values, NAMES, strict=True)]
    kept = [c for c in ("n_patents", "n_texts_used") if c in years.columns]
    return rows.withColumns(added).select(entity, year, *kept, *measures)


def similarity(years: DataFrame, vector: str = "embedding", suffix: str = "", calendar: bool = False, entity: str = "stkcd", year: str = "p_year") -> DataFrame:
    """``similarities`` of one vector column."""
    return similarities(years, {vector: suffix}, calendar, entity, year)


def both(years: DataFrame, **options) -> DataFrame:
    """The measures of the plain and of the weighted vectors, where one table has both: no join is needed."""
    return similarities(years, {"embedding": "", "embedding_citw": "_citw"}, **options)


def merged(simple: DataFrame, weighted: DataFrame | None, entity: str = "stkcd", year: str = "p_year") -> DataFrame:
    """All entity-years of both tables; counts come from the plain one. Without a weighted table, the plain one."""
    if weighted is None:
        return simple
    return simple.join(weighted.select(entity, year, *(n + "_citw" for n in NAMES)), [entity, year], "full")


def summary(df: DataFrame, columns=None) -> DataFrame:
    """measure, n, mean, median, sd, min, max of similarity columns; null and NaN don't count. One scan.

    Different values are counted and dealt out by order, so the exact median is
    found in one part, and no task holds all values. The counts are written to
    ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    columns = columns or [c for c in df.columns if c.startswith(("cos_sim", "sim_"))]
    value = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns))))
    counts = df.select(value.alias("x")).select("x.*").where("v is not null and not isnan(v)").groupBy("k", "v").agg(F.count(F.lit(1)).alias("c"))
    path = scratch(spark)
    counts.repartitionByRange("k", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    counts = spark.read.schema("k int, v double, c long, part int").parquet(path)

    totals = counts.groupBy("k").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    off = F.sum(F.col("c") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")))
    spread = counts.join(F.broadcast(totals), "k").groupBy("k").agg(F.when(F.max("n") > 1, F.sqrt(off / F.greatest(F.max("n") - 1, F.lit(1)))).alias("sd"))
    # the places of the one or two middle values, from 0, and the parts that have them
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    parts = counts.groupBy("k", "part").agg(F.sum("c").alias("m")).withColumn("before", F.sum("m").over(Window.partitionBy("k").orderBy("part")) - F.col("m"))
    parts = parts.join(F.broadcast(totals.select("k", "n")), "k").where((F.col("before") <= high) & (low < F.col("before") + F.col("m")))
    end = F.col("before") + F.sum("c").over(Window.partitionBy("k", "part").orderBy("v"))
    middle = counts.join(F.broadcast(parts), ["k", "part"]).withColumn("end", end).where((F.col("end") - F.col("c") <= high) & (low < F.col("end")))
    median = middle.groupBy("k").agg((F.min("v") / 2 + F.max("v") / 2).alias("median"))
    named = spark.createDataFrame(list(enumerate(columns)), "k int, measure string")
    every = named.join(totals, "k", "left").join(spread, "k", "left").join(median, "k", "left")
    return every.select("measure", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean", "median", "sd", "min", "max")


def agreement(a: DataFrame, b: DataFrame, measure: str = "cos_sim_lag1", epsilon: float = 0.1, keys=("stkcd", "p_year")) -> DataFrame:
    """How far two models agree: rows compared, share within epsilon, correlation."""
    both = a.select(*keys, F.col(measure).alias("a")).join(b.select(*keys, F.col(measure).alias("b")), list(keys)).where("a is not null and b is not null")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.abs(F.col("a") - F.col("b")) < epsilon, 1.0).otherwise(0.0)).alias("consistency"), F.corr("a", "b").alias("correlation"))


def weighting_delta(both: DataFrame, entity: str = "stkcd", year: str = "p_year") -> DataFrame:
    return both.select(entity, year, *((F.col(n) - F.col(n + "_citw")).alias(n.replace("cos_sim", "delta")) for n in NAMES))


def share_above(df: DataFrame, measure: str = "cos_sim_lag1", bound: float = 0.5) -> DataFrame:
    return df.where(F.col(measure).isNotNull()).agg(F.avg((F.col(measure) > bound).cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))
