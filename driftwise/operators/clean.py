"""Cleaning and preparing a table of dated documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import scalars as S

#: Source column, short name.
RENAMES = {
    "股票代码": "stkcd",
    "newipzlid": "p_id",
    "年份": "p_year",
    "标题": "p_tt",
    "摘要": "p_abs",
    "申请日": "p_date",
    "专利类型": "p_type",
    "IPC": "p_ipc",
    "被引证次数": "p_cite",
}
#: Document types and first characters of codes that are kept.
TYPES = ("发明申请", "发明授权", "实用新型")
PREFIXES = ("0", "3", "6")
REQUIRED = ("stkcd", "p_year", "p_tt", "p_abs")


def require_columns(df: DataFrame, required=REQUIRED) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def pruned(df: DataFrame, wanted) -> DataFrame:
    """The wanted columns that are there, in the wanted order."""
    return df.select(*(c for c in wanted if c in df.columns))


def renamed(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in (names or RENAMES).items() if k in df.columns})


def has_prefix(df: DataFrame, code: str = "stkcd", prefixes=PREFIXES) -> Column:
    """By the first character; numeric codes are padded first, text codes are not."""
    c = F.col(code)
    shown = S.code_of_number(c) if isinstance(df.schema[code].dataType, NumericType) else c
    return F.substring(shown, 1, 1).isin(*prefixes)


def cleaned(df: DataFrame, types=TYPES, prefixes=PREFIXES) -> DataFrame:
    """Rows of the kept types and code prefixes, missing citations as 0."""
    kept = df.where(F.col("p_type").isin(*types) & has_prefix(df, "stkcd", prefixes))
    return kept.withColumn("p_cite", F.coalesce(F.col("p_cite").cast("double"), F.lit(0.0)))


def prepared(df: DataFrame, code: str = "stkcd", year: str = "p_year") -> DataFrame:
    """Text, emptiness flag, key and citations; rows without code or a whole year go."""
    require_columns(df)
    rows = df.dropna(subset=[code, year]).withColumn(year, S.year_of(F.col(year).cast("string"))).where(F.col(year).isNotNull())
    rows = rows.withColumn(code, S.strip(F.col(code).cast("string")))
    text = S.normalised_text(F.col("p_tt"), F.col("p_abs"))
    added = {"text": text, "text_is_empty": F.length(text) == 0, "stkcd_year": F.concat_ws("_", code, year)}
    added["p_cite"] = S.count_or_zero(F.col("p_cite").cast("string")) if "p_cite" in df.columns else F.lit(0.0)
    if "p_date" in df.columns:
        added["p_date"] = S.date_of(F.col("p_date").cast("string"))
    return rows.withColumns(added)


def sorted_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*(F.asc_nulls_last(k) for k in keys if k in df.columns))


def missing_profile(df: DataFrame) -> DataFrame:
    """variable, n_missing, n_total of every column, in one scan."""
    counts = df.agg(F.count(F.lit(1)).alias("n_total"), *(F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)))
    pairs = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").alias("n_missing")) for i, c in enumerate(df.columns)))
    return counts.select("n_total", F.explode(pairs).alias("p")).select("p.variable", "p.n_missing", "n_total")


def tabulated(df: DataFrame, column: str) -> DataFrame:
    """Frequencies with missing values as a row, and shares of all rows, in one scan."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
    # one row per value stands in the window, which has no more of them than the report
    return counts.select(column, "freq", (F.col("freq") / F.sum("freq").over(Window.partitionBy(F.lit(1)))).alias("share"))


def invalid_counts(df: DataFrame, column: str = "p_cite") -> DataFrame:
    """n_rows, n_invalid: how many values are there and are no number (they count as 0)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(S.is_invalid_count(F.col(column).cast("string"))).alias("n_invalid"))


def order_breaks(df: DataFrame, ordinal: str, entity: str = "stkcd", year: str = "p_year") -> DataFrame:
    """n_rows, n_breaks: entity's rows, taken by ``ordinal``, whose year is before the one of the row before.

    Operators here state the order they need and never rely on that of a file; this tells whether a file had it.
    """
    before = F.lag(year).over(Window.partitionBy(entity).orderBy(ordinal))
    return df.select((F.col(year) < before).alias("b")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("b").alias("n_breaks"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """copies, observations, surplus: how many rows stand in groups of each size."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return sizes.groupBy("copies").agg((F.count(F.lit(1)) * F.col("copies")).alias("observations"), (F.count(F.lit(1)) * (F.col("copies") - 1)).alias("surplus"))


def period(year: Column, exact: int | None = None, start: int | None = None, end: int | None = None) -> Column:
    """An exact year before a range, a range before one bound, and no bound is every year."""
    if exact is not None:
        return year == exact
    bounds = ([year >= start] if start is not None else []) + ([year <= end] if end is not None else [])
    return reduce(lambda a, b: a & b, bounds, F.lit(True))
