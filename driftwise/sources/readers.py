"""Reading tables: Parquet, CSV with a stated schema, Stata files, vectors saved by numpy."""

from __future__ import annotations

import io
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def resolve(spark: SparkSession, path: str | None, *candidates: str, folder_file: str | None = None) -> str:
    """The first path there is; a folder stands for ``folder_file`` in it."""
    for p in [x for x in (path, *candidates) if x]:
        inner = f"{p.rstrip('/')}/{folder_file}" if folder_file else None
        if inner and exists(spark, inner):
            return inner
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of these exists: {[path, *candidates]}")


def optional(spark: SparkSession, path: str, read=None) -> DataFrame | None:
    """The table at a path, or None if there is no such path."""
    return (read or spark.read.parquet)(path) if exists(spark, path) else None


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Columns as stated; codes keep their zeros, a byte order mark is no part of the header, and a quoted empty cell is an empty text, a bare one null."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', nullValue="\x00")


def read_wide_vectors(spark: SparkSession, path: str, keys: str, pattern: str = r"^emb_\d+$") -> DataFrame:
    """A CSV with one column per component, as one ``embedding`` column; empty cells are NaN."""
    header = spark.read.csv(path, header=True).columns
    parts = sorted((c for c in header if re.match(pattern, c)), key=lambda c: int(re.sub(r"\D", "", c)))
    if not parts:
        raise ValueError(f"no column matches {pattern}")
    known = {f.name: f for f in T._parse_datatype_string(keys).fields}
    schema = T.StructType([known.get(c) or T.StructField(c, T.DoubleType() if c in parts else T.StringType()) for c in header])
    df = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')
    return df.select(*(c for c in header if c not in parts), F.array(*(F.coalesce(F.col(c), F.lit(float("nan"))) for c in parts)).alias("embedding"))


def read_stata(spark: SparkSession, path: str, columns: list[str] | None = None, chunk: int = 100_000, categoricals: bool = False) -> DataFrame:
    """A Stata file, in row ranges of ``chunk`` that tasks read for themselves (several ranges each beyond 1,000 tasks)."""
    from .stata import StataSource

    spark.dataSource.register(StataSource)
    options = {"chunk": str(chunk), "convertCategoricals": str(categoricals).lower(), **({"columns": ",".join(columns)} if columns else {})}
    return spark.read.format("stata").options(**options).load(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, embedding) of a matrix saved by numpy."""

    def rows(batches):
        import numpy as np
        import pandas as pd

        for files in batches:
            for raw in files["content"]:
                m = np.load(io.BytesIO(raw))
                for k in range(0, len(m), 4096):
                    yield pd.DataFrame({"row": np.arange(k, min(len(m), k + 4096)), "embedding": list(m[k : k + 4096].astype("float32"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "row long, embedding array<float>")
