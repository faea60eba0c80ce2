"""A view of the test tables as dated, embedded documents of entities, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V

#: (factor of the entity, step of the regime, years a regime lasts, first year, shift) of the two models
MODELS = {"a": (7, 3, 3, 1995, 0), "b": (5, 2, 2, 1996, 11)}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """Rows of orders as documents, without vectors; ``texts`` brings title and abstract."""
    o = read(spark, sf_dir, "orders")
    date = F.col("o_orderdate").cast("date")
    f = F.col("o_custkey") % 40
    rows = o.select(
        F.lpad(f.cast("string"), 6, "0").alias("stkcd"), F.year(date).alias("p_year"), F.col("o_orderkey").alias("p_id"), date.alias("p_date"), f.cast("int").alias("f"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 13).cast("double")).alias("p_cite"), (F.col("o_orderkey") % 17 == 0).alias("blank"),
    )
    if not texts:
        return rows
    part, docs = read(spark, sf_dir, "part"), read(spark, sf_dir, "documents")
    sizes = part.agg(F.count(F.lit(1)).alias("np")).join(F.broadcast(docs.agg(F.count(F.lit(1)).alias("nd"))))
    keyed = rows.join(F.broadcast(sizes)).withColumns({"_p": F.col("p_id") % F.col("np"), "_d": F.col("p_id") % F.col("nd")})
    full = keyed.join(part.select(F.col("p_partkey").alias("_p"), "p_name", "p_type"), "_p", "left").join(docs.select(F.col("doc_id").alias("_d"), "text"), "_d", "left")
    blank = lambda c: F.when(F.col("blank"), F.lit("")).otherwise(F.col(c))
    return full.select("stkcd", "p_year", "p_id", "p_date", "p_cite", "p_type", "f", "blank", blank("p_name").alias("p_tt"), blank("text").alias("p_abs"))


def embedded(spark: SparkSession, sf_dir: str, *models: str) -> DataFrame:
    """Documents with one vector per model (e_a, e_b), coerced citations and the emptiness flag."""
    emb = read(spark, sf_dir, "embeddings").select("vec_id", V.as_doubles(F.col("embedding")).alias("v"))
    n = emb.agg(F.count(F.lit(1)).alias("ne"))
    narrow = documents(spark, sf_dir, texts=False).join(F.broadcast(n)).withColumn("_e", F.col("p_id") % F.col("ne"))
    rows = narrow.join(emb.select(F.col("vec_id").alias("_e"), F.col("v").alias("own")), "_e")
    for m in models:
        factor, step, lasts, first, shift = MODELS[m]
        at = (factor * F.col("f") + step * F.floor((F.col("p_year") - first) / lasts) + shift) % F.col("ne")
        rows = rows.withColumn("_b", F.pmod(at, F.col("ne")))
        # one per entity and regime, so rows with their own vectors need not be dealt out again
        bases = emb.select(F.col("vec_id").alias("_b"), F.col("v").alias("base")).join(F.broadcast(narrow.select(F.pmod(at, F.col("ne")).alias("_b")).distinct()), "_b")
        rows = rows.join(F.broadcast(bases), "_b")
        rows = rows.withColumn(f"e_{m}", F.zip_with("base", "own", lambda x, y: x + 0.5 * y)).drop("base", "_b")
    cites: Column = S.count_or_zero(F.col("p_cite").cast("string"))
    return rows.select("stkcd", "p_year", "p_id", "p_date", cites.alias("p_cite"), F.col("blank").alias("text_is_empty"), *(f"e_{m}" for m in models))


# The same in SQL. Vectors are long rows (i, v), since sums per component are then plain aggregates.
DOCS_SQL = """docs as (
  select lpad(cast(o_custkey % 40 as varchar), 6, '0') as stkcd, cast(year(cast(o_orderdate as date)) as int) as p_year, o_orderkey as p_id, cast(o_orderdate as date) as p_date,
    cast(o_custkey % 40 as int) as f, case when o_orderkey % 11 <> 0 then cast(o_orderkey % 13 as double) end as p_cite, o_orderkey % 17 = 0 as blank
  from orders)"""
TEXTS_SQL = DOCS_SQL + """, texts as (
  select d.*, p.p_type, case when blank then '' else p.p_name end as p_tt, case when blank then '' else t.text end as p_abs
  from docs d left join part p on p.p_partkey = d.p_id % (select count(*) from part) left join documents t on t.doc_id = d.p_id % (select count(*) from documents))"""
EMPTY = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x0B]+"
PREPARED_SQL = TEXTS_SQL + f""", prepared as (
  select *, trim(regexp_replace(coalesce(p_tt, '') || ' ' || coalesce(p_abs, ''), '{EMPTY}', ' ', 'g')) as text from texts)"""


def long_sql(model: str) -> str:
    factor, step, lasts, first, shift = MODELS[model]
    return f"""emb as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
ne as (select count(*) as ne from embeddings),
long_{model} as (
  select d.stkcd, d.p_year, d.p_id, d.blank, coalesce(d.p_cite, 0) as c, own.i, base.v + 0.5 * own.v as v
  from docs d cross join ne join emb own on own.vec_id = d.p_id % ne
  join emb base on base.i = own.i and base.vec_id = ((({factor} * d.f + {step} * cast(floor((d.p_year - {first}) / {lasts}.0) as bigint) + {shift}) % ne) + ne) % ne)"""


def years_sql(model: str) -> str:
    """fy_<model>: per entity, year and component the plain mean v, the weighted mean w, and the counts."""
    return f"""{long_sql(model)},
fy_{model} as (
  select stkcd, p_year, i, count(*) as n, count(*) filter (not blank) as n_full, sum(c) as total,
    case when count(*) filter (not blank) = 0 then sum(v) / count(*) else sum(case when blank then 0 else v end) / count(*) filter (not blank) end as v,
    case when sum(c) > 1e-12 then sum(c * v) / sum(c) when count(*) filter (not blank) = 0 then sum(v) / count(*) else sum(case when blank then 0 else v end) / count(*) filter (not blank) end as w
  from long_{model} group by all)"""


def similarity_sql(model: str, vector: str, name: str, suffix: str = "") -> str:
    """<name>: n_patents, n_texts_used and the three similarities per entity-year."""
    cos = lambda x: f"case when sqrt(sum(v * v)) > 1e-12 and sqrt(sum({x} * {x})) > 1e-12 then sum(v * {x}) / (sqrt(sum(v * v)) * sqrt(sum({x} * {x}))) end"
    return f"""{name}_w as (
  select stkcd, p_year, i, n, n_full, {vector} as v, lag({vector}) over one as l1,
    case when count(*) over three = 3 then avg({vector}) over three end as l3, avg({vector}) over every as la
  from fy_{model} window one as (partition by stkcd, i order by p_year), three as (partition by stkcd, i order by p_year rows between 3 preceding and 1 preceding),
    every as (partition by stkcd, i order by p_year rows between unbounded preceding and 1 preceding)),
{name} as (
  select stkcd, p_year, max(n) as n_patents, max(case when n_full = 0 then n else n_full end) as n_texts_used,
    {cos("l1")} as cos_sim_lag1{suffix}, {cos("l3")} as cos_sim_lag3{suffix}, {cos("la")} as cos_sim_cumulative{suffix}
  from {name}_w group by all)"""
