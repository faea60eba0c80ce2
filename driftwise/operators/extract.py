"""Documents of chosen entities and years, and reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .clean import period


def extracted(docs: DataFrame, codes, year: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of the codes (however padded) in the period, by code, year and date."""
    wanted = docs.sparkSession.createDataFrame([(str(c),) for c in ([codes] if isinstance(codes, str) else codes)], "_c string")
    wanted = wanted.select(S.canonical_code(F.col("_c")).alias("_c")).distinct()
    rows = docs.where(period(F.col("p_year"), year, start, end))
    found = rows.join(F.broadcast(wanted), S.canonical_code(F.col("stkcd")) == F.col("_c"), "left_semi")
    return found.orderBy("stkcd", "p_year", *([F.asc_nulls_last("p_date")] if "p_date" in docs.columns else []))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("stkcd").agg(F.count(F.lit(1)).alias("n"), F.min("p_year").alias("first_year"), F.max("p_year").alias("last_year"))


def previewed(df: DataFrame, n: int = 5, width: int = 200) -> DataFrame:
    shown = [S.preview(F.col(f.name), width).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema.fields]
    return df.limit(n).select(*shown)


#: The parts of a report.
HEAD = "# 公司 %s 专利文本提取报告\n\n**提取范围**: %s  \n**专利总数**: %d 件  \n**数据日期**: %s\n\n---\n"
YEAR = "## %d年 (%d件专利)\n"
BLOCK = "### 专利 %s\n\n- **申请日**: %s  \n- **专利类型**: %s  \n- **被引证次数**: %s  \n- **IPC分类**: %s\n\n**标题**: %s\n\n**摘要**: %s\n\n---\n"


def report(found: DataFrame, code: str, span: str, today=None) -> DataFrame:
    """Markdown (ord, value): a heading, a section per year with its count, a block per document."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if c in found.columns else F.lit("N/A")
    day = F.coalesce(F.lit(today).cast("date"), F.current_date()).cast("string")
    head = found.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(-1).alias("p_year"), F.lit(0).alias("k"),
        F.format_string(HEAD, F.lit(code), F.lit(span), "n", day).alias("value"),
    )
    years = found.groupBy("p_year").agg(F.count(F.lit(1)).alias("n")).select("p_year", F.lit(0).alias("k"), F.format_string(YEAR, "p_year", "n").alias("value"))
    place = Window.partitionBy("p_year").orderBy(*(F.asc_nulls_last(c) for c in ("p_date", "p_id") if c in found.columns), "p_year")
    blocks = found.select(
        "p_year", F.row_number().over(place).alias("k"),
        F.format_string(
            BLOCK,
            text("p_id"), text("p_date"), text("p_type"), text("p_cite"), text("p_ipc"), text("p_tt"), text("p_abs"),
        ).alias("value"),
    )
    return head.unionByName(years).unionByName(blocks).orderBy("p_year", "k")
