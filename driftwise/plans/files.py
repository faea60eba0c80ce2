"""Registered queries that write files, read them back and go on from there; each with the SQL of the same without files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cli
from ..functions import scalars as S
from ..operators import clean, extract, similarity
from ..sources import readers, sinks
from ..sources.scratch import scratch
from . import catalogue as C
from . import pseudo as P

MODEL, WIDTH = "paraphrase-multilingual-MiniLM-L12-v2", 64
DOCS = "stkcd string, p_year int, p_id long, p_date date, p_tt string, p_cite double"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documents(spark, sf_dir).select("stkcd", "p_year", "p_id", "p_date", "p_tt", "p_cite")


def csv_files(spark, sf_dir) -> DataFrame:
    """A table as CSV and back: codes keep their zeros, empty texts stay empty and missing numbers missing."""
    path = scratch(spark) + ".csv"
    sinks.write_csv(_docs(spark, sf_dir), path)
    return readers.read_csv(spark, path, DOCS)


def one_csv_file(spark, sf_dir) -> DataFrame:
    """One file with a byte order mark, in order, and back."""
    path = scratch(spark) + ".csv"
    sinks.write_one_csv(clean.sorted_rows(_docs(spark, sf_dir), "stkcd", "p_year", "p_id"), path)
    return readers.read_csv(spark, path, DOCS)


def csv_by_entity(spark, sf_dir) -> DataFrame:
    """A folder per entity, of which one is read."""
    path = scratch(spark)
    sinks.write_csv(_docs(spark, sf_dir), path, by="stkcd")
    return readers.read_csv(spark, f"{path}/stkcd=000007", "p_year int, p_id long, p_date date, p_tt string, p_cite double")


def stata_file(spark, sf_dir) -> DataFrame:
    """A Stata file, of which a projection is read in many row ranges."""
    path = scratch(spark) + ".dta"
    sinks.write_stata(_docs(spark, sf_dir).withColumn("p_date", F.col("p_date").cast("timestamp")).withColumn("p_id", F.col("p_id").cast("int")), path)
    rows = readers.read_stata(spark, path, ["stkcd", "p_id", "p_year", "p_date", "p_cite"], chunk=700)
    return rows.select("stkcd", F.col("p_id").cast("long").alias("p_id"), F.col("p_year").cast("int").alias("p_year"), F.col("p_date").cast("date").alias("p_date"), "p_cite")


def _bundle(spark, sf_dir, formats) -> str:
    folder = scratch(spark)
    sinks.write_bundle(C._years(spark, sf_dir), folder, MODEL, WIDTH, formats)
    return folder


def wide_vector_files(spark, sf_dir) -> DataFrame:
    """Both bundles as wide CSV, found by folder and file name, with columns by pattern, and as long rows."""
    folder = _bundle(spark, sf_dir, ("csv",))
    out = None
    for kind, prefix in (("plain", "firm_year"), ("weighted", "firm_year_citweighted")):
        path = readers.resolve(spark, f"{folder}/no such file", folder, folder_file=f"{sinks.bundle_name(prefix, MODEL)}.csv")
        vectors = readers.read_wide_vectors(spark, path, "stkcd string, p_year int")
        rows = C._longs(vectors, "embedding").withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def npy_file(spark, sf_dir) -> DataFrame:
    """The matrix in numpy's format and its keys, joined again by row."""
    path = scratch(spark).removeprefix("file://")
    sinks.write_npy(C._years(spark, sf_dir), path + ".npy", ["stkcd", "p_year"])
    keys = readers.read_csv(spark, path + "_meta.csv", "stkcd string, p_year int").coalesce(1)
    keys = keys.select("stkcd", "p_year", (F.row_number().over(C.Window.orderBy("stkcd", "p_year")) - 1).cast("long").alias("row"))
    rows = readers.read_npy(spark, path + ".npy").join(keys, "row")
    return C._longs(rows, "embedding").withColumn("v", F.round(F.col("v").cast("double"), 4) + F.lit(0.0))


def similarity_from_files(spark, sf_dir) -> DataFrame:
    """Similarities of the written bundles, the weighted one taken because it is there."""
    folder = _bundle(spark, sf_dir, ("parquet",))
    plain = spark.read.parquet(readers.resolve(spark, folder, folder_file=f"{sinks.bundle_name('firm_year', MODEL)}.parquet"))
    weighted = readers.optional(spark, f"{folder}/{sinks.bundle_name('firm_year_citweighted', MODEL)}.parquet")
    return C.rounded(similarity.merged(similarity.similarity(plain), similarity.similarity(weighted, suffix="_citw")))


def similarity_without_weights(spark, sf_dir) -> DataFrame:
    """The same where no weighted bundle is there."""
    folder = _bundle(spark, sf_dir, ("parquet",))
    plain = spark.read.parquet(f"{folder}/{sinks.bundle_name('firm_year', MODEL)}.parquet")
    return C.rounded(similarity.merged(similarity.similarity(plain), readers.optional(spark, f"{folder}/none.parquet")))


def empty_bundle(spark, sf_dir) -> DataFrame:
    """Columns of the files of a result without rows."""
    folder = scratch(spark)
    made = sinks.write_bundle(C._years(spark, sf_dir).limit(0), folder, MODEL, 2, ("parquet", "csv"))
    counts = [(p.rsplit("/", 1)[1], spark.read.parquet(p).count() if p.endswith("parquet") else 0) for p in made]
    return spark.createDataFrame(counts, "name string, n_rows long")


def report_file(spark, sf_dir) -> DataFrame:
    """A report as one text file, read back: how often each line stands in it."""
    path = scratch(spark) + ".md"
    sinks.write_lines(C._report(spark, sf_dir).orderBy("p_year", "k"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def _command(spark, *arguments: str) -> int:
    return cli.run(cli.parser().parse_args(list(arguments)), spark)


def cli_similarity(spark, sf_dir) -> DataFrame:
    """The command on the plain bundle."""
    folder, out = _bundle(spark, sf_dir, ("parquet",)), scratch(spark)
    _command(spark, "similarity", "--input", f"{folder}/{sinks.bundle_name('firm_year', MODEL)}.parquet", "--weighted", f"{folder}/{sinks.bundle_name('firm_year_citweighted', MODEL)}.parquet", "--output", out)
    return C.rounded(spark.read.parquet(out))


def cli_events(spark, sf_dir) -> DataFrame:
    """The command on two models' similarities."""
    one, two, out = scratch(spark), scratch(spark), scratch(spark)
    sinks.write_parquet(C._simple(spark, sf_dir), one)
    sinks.write_parquet(C._simple(spark, sf_dir, "b"), two)
    _command(spark, "events", "--input", one, "--other", two, "--output", out, "--courses", "1")
    return C.rounded(spark.read.parquet(out))


def cli_course_file(spark, sf_dir) -> DataFrame:
    """The course that the command writes beside its output."""
    one, two, out = scratch(spark), scratch(spark), scratch(spark)
    sinks.write_parquet(C._simple(spark, sf_dir), one)
    sinks.write_parquet(C._simple(spark, sf_dir, "b"), two)
    _command(spark, "events", "--input", one, "--other", two, "--output", out, "--courses", "1")
    schema = "stkcd string, p_year int, n_patents long, n_texts_used long, cos_sim_lag1_minilm double, cos_sim_lag3 double, cos_sim_cumulative double, cos_sim_lag1_distiluse double"
    return C.rounded(readers.read_csv(spark, out + ".company_*_trajectory.csv", schema))


def _raw(spark, sf_dir) -> str:
    path = scratch(spark)
    sinks.write_parquet(P.documents(spark, sf_dir).select("stkcd", "p_year", "p_id", "p_date", "p_tt", "p_abs", "p_type", "p_cite"), path)
    return path


def cli_extract(spark, sf_dir) -> DataFrame:
    """One entity's documents of a period as one CSV file."""
    out = scratch(spark) + ".csv"
    _command(spark, "extract", "--input", _raw(spark, sf_dir), "--stkcd", "7", "--start-year", "1996", "--end-year", "1998", "--output", out)
    return readers.read_csv(spark, out, "stkcd string, p_year int, p_id long, p_date date, p_tt string, p_abs string, p_type string, p_cite double").select("stkcd", "p_year", "p_id", "p_date", "p_tt", "p_type", "p_cite")


def cli_batch(spark, sf_dir) -> DataFrame:
    """Several entities' documents, a folder each."""
    out = scratch(spark)
    _command(spark, "batch", "--input", _raw(spark, sf_dir), "--companies", "7, 000012,33", "--year", "1997", "--output", out)
    rows = spark.read.csv(out, header=True, schema="p_year int, p_id long, p_date date, p_tt string, p_abs string, p_type string, p_cite double, stkcd string", multiLine=True, escape='"')
    return rows.select("stkcd", "p_year", "p_id", "p_type")


def cli_sample(spark, sf_dir) -> DataFrame:
    """The documents of named entities."""
    out = scratch(spark)
    _command(spark, "sample", "--input", _raw(spark, sf_dir), "--companies", "3,000021", "--output", out)
    return spark.read.parquet(out).select("stkcd", "p_year", "p_id")


def cli_inspect(spark, sf_dir) -> DataFrame:
    """Counts of one entity."""
    out = scratch(spark)
    _command(spark, "inspect", "--input", _raw(spark, sf_dir), "--company", "000007", "--step", "load", "--output", out)
    return C.rounded(spark.read.parquet(out))


def cli_preview(spark, sf_dir) -> DataFrame:
    """How many rows the preview's file has."""
    out = scratch(spark) + ".csv"
    _command(spark, "preview", "--input", _raw(spark, sf_dir), "-n", "7", "--output", out)
    return readers.read_csv(spark, out, "stkcd string").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_files, one_csv_file, csv_by_entity, stata_file, wide_vector_files, npy_file, similarity_from_files, similarity_without_weights, empty_bundle, report_file,
        cli_similarity, cli_events, cli_course_file, cli_extract, cli_batch, cli_sample, cli_inspect, cli_preview,
    )
}

_DOCS_SQL = f"with {P.TEXTS_SQL} select {{}} from texts"
_ALL = "stkcd, p_year, p_id, p_date, p_tt, p_cite"
_REPORT_LINE = "unnest(string_split(value || chr(10), chr(10)))"
ORACLES = {
    "csv_files": _DOCS_SQL.format(_ALL),
    "one_csv_file": _DOCS_SQL.format(_ALL),
    "csv_by_entity": _DOCS_SQL.format("p_year, p_id, p_date, p_tt, p_cite") + " where stkcd = '000007'",
    "stata_file": f"with {P.DOCS_SQL} select stkcd, p_id, p_year, p_date, p_cite from docs",
    "wide_vector_files": f"{C._A} select 'plain' as kind, stkcd, p_year, cast(i as int) as i, {C._R('v')} from fy_a union all select 'weighted', stkcd, p_year, cast(i as int), round(w, 6) + 0.0 from fy_a",
    "npy_file": f"{C._A} select stkcd, p_year, cast(i as int) as i, round(cast(cast(v as float) as double), 4) + 0.0 as v from fy_a",
    "similarity_from_files": C.ORACLES["similarity_merged"],
    "similarity_without_weights": f"{C._SIM} select stkcd, p_year, n_patents, n_texts_used, {', '.join(C._R(n) for n in C.NAMES)} from sim_a",
    "empty_bundle": "select unnest(['firm_year_minilm_embeddings.parquet', 'firm_year_minilm_embeddings.csv', 'firm_year_citweighted_minilm_embeddings.parquet', 'firm_year_citweighted_minilm_embeddings.csv']) as name, 0::bigint as n_rows",
    "report_file": f"with lines as (select unnest(string_split(value, chr(10))) as line from ({C.REPORT_SQL})) select line, count(*) as n from lines group by line",
    "cli_similarity": C.ORACLES["similarity_merged"],
    "cli_events": C.ORACLES["events_both_models"],
    "cli_course_file": C.ORACLES["trajectory_two_model"] + f" where a.stkcd = (select min(stkcd) from ({C._COMMON}))",
    "cli_extract": _DOCS_SQL.format("stkcd, p_year, p_id, p_date, p_tt, p_type, p_cite") + " where stkcd = '000007' and p_year between 1996 and 1998",
    "cli_batch": _DOCS_SQL.format("stkcd, p_year, p_id, p_type") + " where stkcd in ('000007', '000012', '000033') and p_year = 1997",
    "cli_sample": C.ORACLES["sample_semi_join"],
    "cli_inspect": C.ORACLES["firm_year_stats"].replace("from prepared", "from prepared where stkcd = '000007'"),
    "cli_preview": "select 7::bigint as n",
}
