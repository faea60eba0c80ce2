"""Writing results: Parquet by default; CSV in the layouts other tools expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import short_model_name
from . import stata_sink


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def wide(df: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """The vector as columns emb_0 .. emb_{width - 1}, after the other columns."""
    return df.select(*(c for c in df.columns if c != vector), *(F.get(vector, F.lit(i)).alias(f"emb_{i}") for i in range(width)))


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite").option("escape", '"')
    (writer.partitionBy(by) if by else writer).csv(path, header=True)


def bundle_name(prefix: str, model: str) -> str:
    return f"{prefix}_{short_model_name(model)}_embeddings"


def write_bundle(years: DataFrame, folder: str, model: str, width: int, formats=("parquet", "csv")) -> list[str]:
    """The plain and the weighted table of an entity-year result, under the model's names, empty or not.

    The result is computed once: the first table is written with both vectors and the others are read from it.
    """
    made = []
    whole = f"{folder}/.{bundle_name('firm_year', model)}.whole"
    schema = years.schema
    write_parquet(years, whole)
    years = years.sparkSession.read.schema(schema).parquet(whole)
    meta = [c for c in years.columns if c not in ("embedding", "embedding_citw")]
    for prefix, vector in (("firm_year", "embedding"), ("firm_year_citweighted", "embedding_citw")):
        df = years.select(*meta, F.col(vector).alias("embedding"))
        for kind in formats:
            path = f"{folder}/{bundle_name(prefix, model)}.{kind}"
            write_parquet(df, path) if kind == "parquet" else write_csv(wide(df, width), path)
            made.append(path)
    delete(years.sparkSession, whole)
    return made


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def write_one_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a byte order mark, rows in the frame's order, on any file system that Spark reaches.

    Tasks write their parts as CSV; the driver only joins the parts' bytes.
    """
    parts = f"{path}.parts"
    df.write.mode("overwrite").option("escape", '"').csv(parts, header=False)
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in df.columns)
    join_parts(df.sparkSession, parts, path, ("\ufeff" + head + "\n").encode())


def join_parts(spark: SparkSession, parts: str, path: str, head: bytes = b"") -> None:
    """The files of a folder, by name, as one file behind ``head``; the folder goes."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    names = sorted(str(f.getPath().toString()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))
    out = fs.create(target, True)
    try:
        out.write(bytearray(head))
        for name in names:
            part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(folder, True)


def write_npy(df: DataFrame, path: str, keys: list[str], vector: str = "embedding") -> None:
    """A local matrix file and its keys as ``<path>_meta.csv``, both in key order, filled row by row on disk."""
    import csv

    import numpy as np

    n = df.count()
    width = (df.select(F.max(F.size(vector))).first()[0] or 0) if n else 0
    m = np.lib.format.open_memmap(path, "w+", np.float32, (n, width))
    with open(f"{path.removesuffix('.npy')}_meta.csv", "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f)
        out.writerow(keys)
        for k, row in enumerate(df.select(*keys, vector).orderBy(*keys).toLocalIterator()):
            out.writerow(row[: len(keys)])
            m[k] = row[len(keys)]
    m.flush()


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file of the column ``value``, in order."""
    parts = f"{path}.parts"
    lines.select("value").write.mode("overwrite").text(parts)
    join_parts(lines.sparkSession, parts, path)


def write_stata(df: DataFrame, path: str) -> None:
    """One Stata file at a path that the driver and all executors can open; tasks write the rows."""
    stata_sink.write(df, path)
