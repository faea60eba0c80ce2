"""Registered queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import clean, embed, entity_year, events, extract, history, sampling, similarity
from . import pseudo as P

NAMES = similarity.NAMES
#: kept kinds of part, standing in for document types
KINDS = ("ECONOMY", "PROMO", "STANDARD")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, and no negative zero."""
    return df.select(*((F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def _years(spark: SparkSession, sf_dir: str, model: str = "a") -> DataFrame:
    return entity_year.entity_years(P.embedded(spark, sf_dir, model).withColumnRenamed(f"e_{model}", "embedding"))


def _simple(spark, sf_dir, model="a") -> DataFrame:
    return similarity.similarity(_years(spark, sf_dir, model))


def _weighted(spark, sf_dir) -> DataFrame:
    return similarity.similarity(_years(spark, sf_dir), "embedding_citw", "_citw")


def _merged(spark, sf_dir) -> DataFrame:
    return similarity.both(_years(spark, sf_dir))


def similarity_outer_join(spark, sf_dir) -> DataFrame:
    """The full join of two tables that lack a year each."""
    simple = _simple(spark, sf_dir).where("p_year <> 1997")
    return rounded(similarity.merged(simple, _weighted(spark, sf_dir).where("p_year <> 1998").drop("n_patents", "n_texts_used")))


def _prepared(spark, sf_dir) -> DataFrame:
    return clean.prepared(P.documents(spark, sf_dir))


def _longs(df: DataFrame, vector: str) -> DataFrame:
    return rounded(df.select("stkcd", "p_year", F.posexplode(vector).alias("i", "v")).withColumn("i", F.col("i") + 1))


def _codes(spark, sf_dir) -> DataFrame:
    o = P.read(spark, sf_dir, "orders")
    part = P.read(spark, sf_dir, "part")
    number = (F.col("o_custkey") * 7919) % 1_000_000
    n = part.agg(F.count(F.lit(1)).alias("np"))
    keyed = o.join(F.broadcast(n)).select(F.col("o_orderkey").alias("p_id"), number.cast("bigint").alias("stkcd"), (F.col("o_orderkey") % F.col("np")).alias("p_partkey"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 13).cast("double")).alias("p_cite"))
    return keyed.join(part.select("p_partkey", "p_type"), "p_partkey")


def clean_type_prefix_filter(spark, sf_dir) -> DataFrame:
    rows = _codes(spark, sf_dir)
    types = [r for r in KINDS]
    numbers = clean.cleaned(rows, types).withColumn("stkcd", S.code_of_number(F.col("stkcd"))).withColumn("kind", F.lit("number"))
    texts = clean.cleaned(rows.withColumn("stkcd", F.col("stkcd").cast("string")), types).withColumn("kind", F.lit("text"))
    return numbers.unionByName(texts).select("kind", "stkcd", "p_id", "p_type", "p_cite")


_CODES_SQL = "codes as (select o_orderkey as p_id, cast((o_custkey * 7919) % 1000000 as bigint) as stkcd, p_type, case when o_orderkey % 11 <> 0 then cast(o_orderkey % 13 as double) end as p_cite from orders join part on p_partkey = o_orderkey % (select count(*) from part))"
_KIND_LIST = ", ".join(f"'{k}'" for k in KINDS)
CLEAN_SQL = f"""with {_CODES_SQL}
select 'number' as kind, lpad(cast(stkcd as varchar), 6, '0') as stkcd, p_id, p_type, coalesce(p_cite, 0) as p_cite from codes where p_type in ({_KIND_LIST}) and substr(lpad(cast(stkcd as varchar), 6, '0'), 1, 1) in ('0', '3', '6')
union all select 'text', cast(stkcd as varchar), p_id, p_type, coalesce(p_cite, 0) from codes where p_type in ({_KIND_LIST}) and substr(cast(stkcd as varchar), 1, 1) in ('0', '3', '6')"""


def text_normalize(spark, sf_dir) -> DataFrame:
    return _prepared(spark, sf_dir).select("p_id", F.length("text").cast("long").alias("n_chars"), "text_is_empty", F.md5("text").alias("text_md5"), "stkcd_year")


def sentence_split(spark, sf_dir) -> DataFrame:
    docs = P.read(spark, sf_dir, "documents")
    return docs.select("doc_id", S.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", " ")).alias("joined_md5"))


def citations_coerce(spark, sf_dir) -> DataFrame:
    o = P.read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    raw = F.when(k % 7 == 0, "abc").when(k % 7 == 1, "-3").when(k % 7 == 2, " 7 ").when(k % 7 == 3, "NaN").when(k % 7 == 4, k.cast("string"))
    return o.select(k.alias("p_id"), S.count_or_zero(raw).alias("p_cite"))


def _span(spark, sf_dir) -> DataFrame:
    return P.documents(spark, sf_dir, texts=False).select("stkcd", "p_year", "p_id", "p_cite")


def _events_sql(tail: str, models: str = "ab") -> str:
    parts = [P.DOCS_SQL]
    seen = ""
    for m in models:
        sql = P.years_sql(m)
        if seen:  # the vectors' long form is there already
            sql = sql[sql.index("long_" + m) :]
        parts += [sql, P.similarity_sql(m, "v", f"sim_{m}")]
        seen += m
    return "with " + ",\n".join(parts) + "\n" + tail


_R = lambda c: f"round({c}, 6) + 0.0 as {c}"
_BREAK = "{m}.cos_sim_lag1 is not null and {m}.n_patents >= 5 and {m}.cos_sim_lag1 < 0.5"


def events_single_model(spark, sf_dir) -> DataFrame:
    return rounded(events.breaks(_simple(spark, sf_dir)).select("stkcd", "p_year", "n_patents", "cos_sim_lag1", "sim_drop"))


def events_both_models(spark, sf_dir) -> DataFrame:
    return rounded(events.common_breaks(_simple(spark, sf_dir), _simple(spark, sf_dir, "b")))


def trajectories(spark, sf_dir) -> DataFrame:
    out = events.trajectories(_simple(spark, sf_dir))
    shown = lambda c, f: F.concat_ws(";", F.transform(c, f))
    low = shown("low_sim_years", lambda x: F.concat_ws(":", x["p_year"].cast("string"), F.format_string("%.3f", F.round(x["sim"], 3)), x["n_patents"].cast("string")))
    return out.select(
        "stkcd", F.size("years").cast("long").alias("n_years"), shown("years", lambda x: x.cast("string")).alias("years"), shown("similarities", lambda x: F.format_string("%.3f", x)).alias("similarities"),
        shown("patents", lambda x: x.cast("string")).alias("patents"), low.alias("low"),
    )


def breaks_in_order(spark, sf_dir) -> DataFrame:
    """Breaks with their place from the lowest similarity up."""
    found = events.ranked(events.breaks(_simple(spark, sf_dir)))
    return found.select("stkcd", "p_year", F.row_number().over(Window.orderBy(F.round("cos_sim_lag1", 9), "stkcd", "p_year")).alias("place"))


def order_check(spark, sf_dir) -> DataFrame:
    return clean.order_breaks(P.documents(spark, sf_dir, texts=False), "p_id")


def invalid_citations(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 7 == 0, "abc").when(k % 7 == 1, "-3").when(k % 7 == 2, " 7 ").when(k % 7 == 3, "NaN").when(k % 7 == 4, k.cast("string"))
    return clean.invalid_counts(P.read(spark, sf_dir, "orders").select(raw.alias("p_cite")))


def names_of_files(spark, sf_dir) -> DataFrame:
    name = F.concat_ws("-", F.initcap("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit("MiniLM-L12")))
    return P.read(spark, sf_dir, "part").select("p_partkey", S.file_name(F.col("p_name")).alias("file_name"), S.short_model_name_of(name).alias("short_name"), S.is_small_model(name).alias("small"))


def missing_dropped(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    cells = F.array(F.when(k % 3 != 0, (k % 10).cast("double")), F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.lit(2.0)), F.lit(None).cast("double"))
    left = V.without_missing(cells)
    return P.read(spark, sf_dir, "orders").select(k.alias("p_id"), F.size(left).cast("long").alias("n"), F.aggregate(left, F.lit(0.0), lambda s, x: s + x).alias("total"))


def entity_year_fallbacks(spark, sf_dir) -> DataFrame:
    """Entity-years where some have only empty texts and some no citations, by a rule on their keys."""
    docs = P.embedded(spark, sf_dir, "a").withColumnRenamed("e_a", "embedding")
    f = F.col("stkcd").cast("int")
    docs = docs.withColumn("text_is_empty", F.col("text_is_empty") | (f % 4 == 1)).withColumn("p_cite", F.when(f % 3 == 0, 0.0).otherwise(F.col("p_cite")))
    years = entity_year.entity_years(docs)
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rounded(years.select("stkcd", "p_year", "n_patents", "n_texts_used", "total_citations", "mean_citations", sums("embedding").alias("plain"), sums("embedding_citw").alias("weighted")))


def dates(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, "no date").when(k % 5 == 1, "2001-02-30").when(k % 5 == 2, F.col("o_orderdate").cast("date").cast("string"))
    date = S.date_of(raw)
    return P.read(spark, sf_dir, "orders").select(k.alias("p_id"), date.alias("p_date"), F.datediff(date, F.make_date(F.year(date), F.lit(1), F.lit(1))).alias("days"))


def _self_docs(spark, sf_dir) -> DataFrame:
    docs = P.embedded(spark, sf_dir, "a")
    return docs.select("stkcd", "p_year", "p_id", F.make_date("p_year", F.lit(1), F.lit(1)).alias("date"), F.col("e_a").alias("embedding"))


_SELF_SQL = f"""with {P.DOCS_SQL}, {P.long_sql("a")},
unit as (select stkcd, p_year, p_id, list(v / nrm order by i) as u from (select *, sqrt(sum(v * v) over (partition by p_id)) as nrm from long_a) group by all),
rk as (select *, make_date(p_year, 1, 1) as date, row_number() over (partition by stkcd order by p_year, p_id) as rk from unit),
pairs as (select a.stkcd, a.p_id, list_inner_product(a.u, b.u) as s, datediff('day', b.date, a.date) as days, b.rk from rk a join rk b on a.stkcd = b.stkcd and b.rk < a.rk),
best as (select stkcd, p_id, max(s) as m, avg(s) as av, arg_max(days, (round(s, 12), -rk)) as days from pairs group by all)"""


def self_similarity(spark, sf_dir) -> DataFrame:
    return rounded(history.self_similarity(_self_docs(spark, sf_dir)))


def _extract(spark, sf_dir) -> DataFrame:
    return extract.extracted(P.documents(spark, sf_dir), ["7", "000012", "33"], start=1996, end=1998)


def embed_hash(spark, sf_dir) -> DataFrame:
    docs = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_id"), S.normalised_text(F.col("text")).alias("text"))
    return embed.embedded(docs, limit=256).select("p_id", "n_chunks", "n_tokens", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 4).alias("weight"))


def chunk_text(spark, sf_dir) -> DataFrame:
    docs = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_id"), "text")
    return embed.chunked(docs, limit=128, strategy="sentences").select("p_id", "chunk_no", "n_tokens", F.length("chunk").alias("n_chars"))


def chunk_windows(spark, sf_dir) -> DataFrame:
    docs = P.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_id"), "text")
    return embed.chunked(docs, limit=128).select("p_id", "chunk_no", "n_tokens", F.md5("chunk").alias("chunk_md5"))


def _report(spark, sf_dir) -> DataFrame:
    return extract.report(_extract(spark, sf_dir), "7", "1996-1998", "2024-01-01")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "similarity_merged": lambda s, d: rounded(_merged(s, d)),
    "similarity_outer_join": similarity_outer_join,
    "clean_type_prefix_filter": clean_type_prefix_filter,
    "profile_missing": lambda s, d: clean.missing_profile(P.documents(s, d).select("stkcd", "p_year", "p_id", "p_date", "p_tt", "p_abs", "p_cite", "p_type")),
    "profile_tabulate": lambda s, d: rounded(clean.tabulated(P.documents(s, d), "p_type")),
    "profile_duplicates": lambda s, d: clean.duplicates(P.documents(s, d, texts=False), "stkcd", "p_date"),
    "text_normalize": text_normalize,
    "sentence_split": sentence_split,
    "citations_coerce": citations_coerce,
    "firm_year_mean": lambda s, d: _longs(_years(s, d), "embedding"),
    "firm_year_citweighted": lambda s, d: _longs(_years(s, d), "embedding_citw"),
    "firm_year_meta": lambda s, d: rounded(_years(s, d).select("stkcd", "p_year", "stkcd_year", "n_patents", "n_texts_used", "total_citations", "mean_citations")),
    "similarity_lag1": lambda s, d: rounded(_simple(s, d).select("stkcd", "p_year", "n_patents", "n_texts_used", "cos_sim_lag1")),
    "similarity_lag3": lambda s, d: rounded(_simple(s, d).select("stkcd", "p_year", "cos_sim_lag3")),
    "similarity_cumulative": lambda s, d: rounded(_simple(s, d).select("stkcd", "p_year", "cos_sim_cumulative")),
    "similarity_citweighted": lambda s, d: rounded(_weighted(s, d)),
    "similarity_summary": lambda s, d: rounded(similarity.summary(_merged(s, d))),
    "self_similarity": self_similarity,
    "self_similarity_summary": lambda s, d: rounded(similarity.summary(history.self_similarity(_self_docs(s, d)), ["sim_max", "sim_ave"])),
    "events_single_model": events_single_model,
    "events_both_models": events_both_models,
    "events_top20": lambda s, d: events.first_breaks(events_both_models(s, d)),
    "trajectories": trajectories,
    "trajectory_two_model": lambda s, d: rounded(events.two_model_course(_simple(s, d), _simple(s, d, "b"))),
    "model_stats": lambda s, d: rounded(events.model_stats(_simple(s, d))),
    "model_agreement": lambda s, d: rounded(similarity.agreement(_simple(s, d), _simple(s, d, "b"))),
    "weighting_delta": lambda s, d: rounded(similarity.weighting_delta(_merged(s, d))),
    "share_above": lambda s, d: rounded(similarity.share_above(_simple(s, d))),
    "sample_strata": lambda s, d: sampling.strata(_span(s, d).where("not (stkcd < '000010' and p_year > 1995 + cast(stkcd as int))").select("stkcd", "p_year").distinct()),
    "sample_edge_cases": lambda s, d: sampling.edge_cases(_span(s, d).where("not (stkcd < '000010' and p_year > 1995 + cast(stkcd as int))").select("stkcd", "p_year").distinct()),
    "sample_semi_join": lambda s, d: sampling.of_entities(_span(s, d).drop("p_cite"), s.createDataFrame([("000003",), ("000021",)], "stkcd string")),
    "company_stats": lambda s, d: sampling.company_stats(_span(s, d)),
    "firm_year_stats": lambda s, d: rounded(sampling.firm_year_stats(_prepared(s, d))),
    "firm_year_summary": lambda s, d: sampling.firm_year_summary(P.documents(s, d)),
    "year_span": lambda s, d: sampling.year_spans(_span(s, d).select("stkcd", "p_year").distinct()),
    "overview": lambda s, d: sampling.overview(_prepared(s, d)),
    "extract_firm_years": lambda s, d: _extract(s, d).select("stkcd", "p_year", "p_date", "p_id", "p_tt"),
    "batch_extract_counts": lambda s, d: extract.counts(_extract(s, d)),
    "preview_truncated": lambda s, d: P.read(s, d, "documents").select("doc_id", S.preview(F.col("text"), 200).alias("shown")),
    "vector_stats": lambda s, d: rounded(entity_year.vector_stats(_years(s, d))),
    "embed_hash": embed_hash,
    "chunk_text": chunk_text,
    "chunk_windows": chunk_windows,
    "breaks_in_order": breaks_in_order,
    "order_check": order_check,
    "invalid_citations": invalid_citations,
    "names_of_files": names_of_files,
    "missing_dropped": missing_dropped,
    "entity_year_fallbacks": entity_year_fallbacks,
    "dates": dates,
    "one_course": lambda s, d: rounded(events.one_course(_simple(s, d))),
    "chunk_stats": lambda s, d: embed.chunk_stats(embed.chunked(P.read(s, d, "documents").select(F.col("doc_id").alias("p_id"), "text"), limit=128)),
    "report_markdown": lambda s, d: _report(s, d).select("p_year", "k", "value"),
}

_A = f"with {P.DOCS_SQL}, {P.years_sql('a')}"
_SIM = f"{_A}, {P.similarity_sql('a', 'v', 'sim_a')}"
_CIT = f"{P.similarity_sql('a', 'w', 'sim_w', '_citw')}"
_BOTH = f"""{_SIM}, {_CIT},
both_w as (select coalesce(s.stkcd, w.stkcd) as stkcd, coalesce(s.p_year, w.p_year) as p_year, s.n_patents, s.n_texts_used, {", ".join(NAMES)}, {", ".join(n + "_citw" for n in NAMES)}
  from sim_a s full join sim_w w on s.stkcd = w.stkcd and s.p_year = w.p_year)"""


def _summary_sql(source: str, measures) -> str:
    return "\nunion all ".join(f"select '{m}' as measure, count({m}) as n, round(avg({m}), 6) + 0.0 as mean, round(median({m}), 6) + 0.0 as median, round(stddev_samp({m}), 6) + 0.0 as sd, round(min({m}), 6) + 0.0 as min, round(max({m}), 6) + 0.0 as max from {source}" for m in measures)


_COMMON = f"select a.stkcd, a.p_year as year, a.n_patents, {{}} from sim_a a join sim_b b on a.stkcd = b.stkcd and a.p_year = b.p_year where {_BREAK.format(m='a')} and {_BREAK.format(m='b')}".format("round(a.cos_sim_lag1, 6) + 0.0 as minilm_sim, round(b.cos_sim_lag1, 6) + 0.0 as distiluse_sim")
_SHORT = "spans as (select distinct stkcd, p_year from docs where not (stkcd < '000010' and p_year > 1995 + cast(stkcd as int))), n as (select stkcd, count(*) as n_years, min(p_year) || '-' || max(p_year) as year_range from spans group by all)"
_EXTRACT = "p_year between 1996 and 1998 and stkcd in ('000007', '000012', '000033')"
_BLOCKS = """blocks as (select p_year, row_number() over (partition by p_year order by p_date, p_id) as k, '### 专利 ' || p_id || chr(10) || chr(10) || '- **申请日**: ' || p_date || '  ' || chr(10) || '- **专利类型**: ' || p_type || '  ' || chr(10)
  || '- **被引证次数**: ' || coalesce(p_cite::varchar, 'N/A') || '  ' || chr(10) || '- **IPC分类**: N/A' || chr(10) || chr(10) || '**标题**: ' || p_tt || chr(10) || chr(10) || '**摘要**: ' || p_abs || chr(10) || chr(10) || '---' || chr(10) as value from found)"""
REPORT_SQL = f"""with {P.TEXTS_SQL}, found as (select * from texts where {_EXTRACT}), {_BLOCKS}
select -1 as p_year, 0 as k, '# 公司 7 专利文本提取报告' || chr(10) || chr(10) || '**提取范围**: 1996-1998  ' || chr(10) || '**专利总数**: ' || count(*) || ' 件  ' || chr(10) || '**数据日期**: 2024-01-01' || chr(10) || chr(10) || '---' || chr(10) as value from found
union all select p_year, 0, '## ' || p_year || '年 (' || count(*) || '件专利)' || chr(10) from found group by p_year union all select p_year, k, value from blocks"""
_SENTENCES = f"""list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([。；;!?！？.])\\s+', '\\1' || chr(1), 'g'), '[\\x01\\n]+'), lambda x: regexp_replace(x, '^{P.EMPTY}|{P.EMPTY}$', '', 'g')), lambda x: x <> '')"""
#: Words and single marks of a text, in order.
_TOKENS = "regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')"
_WINDOWS = f"w as (select doc_id as p_id, {_TOKENS} as t from documents), parts as (select p_id, unnest(range(greatest(1, cast(ceil(len(t) / 128.0) as int)))) as c, t from w), cut as (select p_id, c as chunk_no, t[128 * c + 1:128 * c + 128] as t from parts)"
_PROFILE = ("stkcd", "p_year", "p_id", "p_date", "p_tt", "p_abs", "p_cite", "p_type")

ORACLES: dict[str, str] = {
    "similarity_merged": f"{_BOTH} select stkcd, p_year, n_patents, n_texts_used, {', '.join(_R(n) for n in (*NAMES, *(n + '_citw' for n in NAMES)))} from both_w",
    "similarity_outer_join": f"{_BOTH.replace('from sim_a s full join sim_w w', 'from (select * from sim_a where p_year <> 1997) s full join (select * from sim_w where p_year <> 1998) w')} select stkcd, p_year, n_patents, n_texts_used, {', '.join(_R(n) for n in (*NAMES, *(n + '_citw' for n in NAMES)))} from both_w",
    "clean_type_prefix_filter": CLEAN_SQL,
    "profile_missing": f"with {P.TEXTS_SQL} " + "\nunion all ".join(f"select '{c}' as variable, count(*) filter ({c} is null) as n_missing, count(*) as n_total from texts" for c in _PROFILE),
    "profile_tabulate": f"with {P.TEXTS_SQL} select p_type, count(*) as freq, round(count(*) / sum(count(*)) over (), 6) + 0.0 as share from texts group by p_type",
    "profile_duplicates": f"with {P.DOCS_SQL}, g as (select count(*) as copies from docs group by stkcd, p_date) select copies, cast(count(*) * copies as bigint) as observations, cast(count(*) * (copies - 1) as bigint) as surplus from g group by copies",
    "text_normalize": f"with {P.PREPARED_SQL} select p_id, length(text) as n_chars, length(text) = 0 as text_is_empty, md5(text) as text_md5, stkcd || '_' || p_year as stkcd_year from prepared",
    "citations_coerce": "select o_orderkey as p_id, case o_orderkey % 7 when 2 then 7.0::double when 4 then o_orderkey::double else 0.0::double end as p_cite from orders",
    "firm_year_mean": f"{_A} select stkcd, p_year, cast(i as int) as i, {_R('v')} from fy_a",
    "firm_year_citweighted": f"{_A} select stkcd, p_year, cast(i as int) as i, round(w, 6) + 0.0 as v from fy_a",
    "firm_year_meta": f"{_A} select stkcd, p_year, stkcd || '_' || p_year as stkcd_year, max(n) as n_patents, max(case when n_full = 0 then n else n_full end) as n_texts_used, round(max(total), 6) + 0.0 as total_citations, round(max(total) / max(n), 6) + 0.0 as mean_citations from fy_a group by stkcd, p_year",
    "similarity_lag1": f"{_SIM} select stkcd, p_year, n_patents, n_texts_used, {_R('cos_sim_lag1')} from sim_a",
    "similarity_lag3": f"{_SIM} select stkcd, p_year, {_R('cos_sim_lag3')} from sim_a",
    "similarity_cumulative": f"{_SIM} select stkcd, p_year, {_R('cos_sim_cumulative')} from sim_a",
    "similarity_citweighted": f"{_A}, {_CIT} select stkcd, p_year, n_patents, n_texts_used, {', '.join(_R(n + '_citw') for n in NAMES)} from sim_w",
    "similarity_summary": f"{_BOTH} {_summary_sql('both_w', (*NAMES, *(n + '_citw' for n in NAMES)))}",
    "self_similarity": f"{_SELF_SQL} select r.stkcd, r.p_year, r.p_id, r.date, round(m, 6) + 0.0 as sim_max, cast(days as int) as sim_max_d, round(av, 6) + 0.0 as sim_ave from rk r left join best using (stkcd, p_id)",
    "self_similarity_summary": f"{_SELF_SQL}, z as (select m as sim_max, av as sim_ave from rk r left join best using (stkcd, p_id)) " + _summary_sql("z", ("sim_max", "sim_ave")),
    "events_single_model": _events_sql(f"select stkcd, p_year, n_patents, {_R('cos_sim_lag1')}, round(1 - cos_sim_lag1, 6) + 0.0 as sim_drop from sim_a where {_BREAK.format(m='sim_a')}", "a"),
    "events_both_models": _events_sql(_COMMON),
    "events_top20": _events_sql(_COMMON + " order by 1, 2 limit 20"),
    "trajectories": _events_sql("""select stkcd, count(*) as n_years, string_agg(p_year::varchar, ';' order by p_year) as years, string_agg(format('{:.3f}', round(cos_sim_lag1, 3) + 0.0), ';' order by p_year) as similarities, string_agg(n_patents::varchar, ';' order by p_year) as patents,
  string_agg(p_year::varchar || ':' || format('{:.3f}', round(cos_sim_lag1, 3) + 0.0) || ':' || n_patents::varchar, ';' order by p_year) filter (cos_sim_lag1 < 0.5) as low
from sim_a where cos_sim_lag1 is not null and n_patents >= 5 group by stkcd having count(*) >= 4 and count(*) filter (cos_sim_lag1 < 0.5) > 0""", "a"),
    "trajectory_two_model": _events_sql("select a.stkcd, a.p_year, a.n_patents, a.n_texts_used, round(a.cos_sim_lag1, 6) + 0.0 as cos_sim_lag1_minilm, round(a.cos_sim_lag3, 6) + 0.0 as cos_sim_lag3, round(a.cos_sim_cumulative, 6) + 0.0 as cos_sim_cumulative, round(b.cos_sim_lag1, 6) + 0.0 as cos_sim_lag1_distiluse from sim_a a join sim_b b on a.stkcd = b.stkcd and a.p_year = b.p_year"),
    "model_stats": _events_sql("select count(*) as n, round(avg(cos_sim_lag1), 6) + 0.0 as mean, round(median(cos_sim_lag1), 6) + 0.0 as median, round(stddev_samp(cos_sim_lag1), 6) + 0.0 as sd, count(*) filter (cos_sim_lag1 < 0.5) as n_breaks from sim_a where cos_sim_lag1 is not null and n_patents >= 5", "a"),
    "model_agreement": _events_sql("select count(*) as n, round(avg(case when abs(a.cos_sim_lag1 - b.cos_sim_lag1) < 0.1 then 1.0::double else 0.0::double end), 6) + 0.0 as consistency, round(corr(a.cos_sim_lag1, b.cos_sim_lag1), 6) + 0.0 as correlation from sim_a a join sim_b b on a.stkcd = b.stkcd and a.p_year = b.p_year where a.cos_sim_lag1 is not null and b.cos_sim_lag1 is not null"),
    "weighting_delta": f"{_BOTH} select stkcd, p_year, {', '.join(f'round({n} - {n}_citw, 6) + 0.0 as ' + n.replace('cos_sim', 'delta') for n in NAMES)} from both_w",
    "share_above": f"{_SIM} select round(avg(cast(cos_sim_lag1 > 0.5 as int)), 6) + 0.0 as share, count(*) as n from sim_a where cos_sim_lag1 is not null",
    "sample_strata": f"""with {P.DOCS_SQL}, {_SHORT}, s as (select *, case when n_years >= 20 then 'many' when n_years between 5 and 10 then 'medium' when n_years in (2, 3) then 'few' when n_years = 1 then 'single' end as stratum from n)
select * from s where stratum is not null qualify row_number() over (partition by stratum order by n_years desc, stkcd) = 1""",
    "sample_edge_cases": f"with {P.DOCS_SQL}, {_SHORT} select * from n where n_years <= 3 qualify row_number() over (partition by n_years order by stkcd) = 1",
    "sample_semi_join": f"with {P.DOCS_SQL} select stkcd, p_year, p_id from docs where stkcd in ('000003', '000021')",
    "company_stats": f"with {P.DOCS_SQL} select stkcd, count(*) as n_patents, min(p_year) as first_year, max(p_year) as last_year, count(distinct p_year) as n_years from docs group by stkcd",
    "firm_year_stats": f"with {P.PREPARED_SQL} select stkcd, p_year, count(text) as n_texts, count(*) filter (length(text) = 0) as n_empty, round(sum(coalesce(p_cite, 0)), 6) + 0.0 as total_citations, round(avg(length(text)), 6) + 0.0 as mean_chars from prepared group by all",
    "firm_year_summary": f"with {P.TEXTS_SQL} select stkcd, p_year, count(p_tt) as n_patents, count(p_cite) as n_with_citations, sum(p_cite) as total_citations from texts group by all",
    "year_span": f"with {P.DOCS_SQL} select stkcd, count(distinct p_year) as n_years, min(p_year) || '-' || max(p_year) as year_range from docs group by stkcd",
    "overview": f"with {P.PREPARED_SQL} select count(*) as n_docs, count(distinct stkcd) as n_firms, count(distinct stkcd || '_' || p_year) as n_firm_years, count(distinct p_year) as n_years, count(*) filter (length(text) = 0) as n_empty from prepared",
    "extract_firm_years": f"with {P.TEXTS_SQL} select stkcd, p_year, p_date, p_id, p_tt from texts where {_EXTRACT}",
    "batch_extract_counts": f"with {P.DOCS_SQL} select stkcd, count(*) as n, min(p_year) as first_year, max(p_year) as last_year from docs where {_EXTRACT} group by stkcd",
    "preview_truncated": "select doc_id, case when length(text) > 200 then left(text, 200) || '...' else text end as shown from documents",
    "sentence_split": f"with s as (select doc_id, {_SENTENCES} as s from documents) select doc_id, cast(len(s) as int) as n_sentences, md5(array_to_string(s, ' ')) as joined_md5 from s",
    "chunk_windows": f"with {_WINDOWS} select p_id, cast(chunk_no as int) as chunk_no, cast(len(t) as int) as n_tokens, md5(array_to_string(t, ' ')) as chunk_md5 from cut",
    "chunk_stats": f"with {_WINDOWS} select count(distinct p_id) as n_texts, count(*) as n_chunks, cast(sum(len(t)) as bigint) as n_tokens, count(*) / count(distinct p_id) as chunks_per_text, sum(len(t)) / count(*) as tokens_per_chunk from cut",
    "report_markdown": REPORT_SQL,
    "breaks_in_order": _events_sql(f"select stkcd, p_year, cast(row_number() over (order by round(cos_sim_lag1, 9), stkcd, p_year) as int) as place from sim_a where {_BREAK.format(m='sim_a')}", "a"),
    "order_check": f"with {P.DOCS_SQL}, b as (select p_year < lag(p_year) over (partition by stkcd order by p_id) as b from docs) select count(*) as n_rows, count(*) filter (b) as n_breaks from b",
    "invalid_citations": "select count(*) as n_rows, count(*) filter (o_orderkey % 7 in (0, 3)) as n_invalid from orders",
    "names_of_files": "select p_partkey, replace(p_name, ' ', '_') as file_name, lower(string_split(p_name || case when p_partkey % 2 = 0 then '-MiniLM-L12' else '' end, '-')[1]) as short_name, p_partkey % 2 = 0 as small from part",
    "missing_dropped": "select o_orderkey as p_id, cast(o_orderkey % 3 <> 0 as bigint) + cast(o_orderkey % 5 <> 0 as bigint) as n, case when o_orderkey % 3 <> 0 then cast(o_orderkey % 10 as double) else 0 end + case when o_orderkey % 5 <> 0 then 2.0::double else 0.0::double end as total from orders",
    "entity_year_fallbacks": f"""with {P.DOCS_SQL}, {P.years_sql('a').replace("own.i, base.v", "own.i, base.v").replace('d.blank, coalesce(d.p_cite, 0) as c', 'd.blank or d.f % 4 = 1 as blank, case when d.f % 3 = 0 then 0 else coalesce(d.p_cite, 0) end as c')}
select stkcd, p_year, max(n) as n_patents, max(case when n_full = 0 then n else n_full end) as n_texts_used, round(max(total), 6) + 0.0 as total_citations, round(max(total) / max(n), 6) + 0.0 as mean_citations, round(sum(v), 6) + 0.0 as plain, round(sum(w), 6) + 0.0 as weighted from fy_a group by stkcd, p_year""",
    "dates": "select o_orderkey as p_id, case when o_orderkey % 5 = 2 then cast(o_orderdate as date) end as p_date, cast(case when o_orderkey % 5 = 2 then datediff('day', make_date(year(o_orderdate), 1, 1), cast(o_orderdate as date)) end as int) as days from orders",
    "one_course": f"{_SIM} select stkcd, p_year, n_patents, n_texts_used, {', '.join(_R(n) for n in NAMES)} from sim_a where stkcd = (select min(stkcd) from (select stkcd from sim_a group by stkcd having count(*) >= 5))",
    "vector_stats": f"{_A} select round(min(v), 6) + 0.0 as min, round(max(v), 6) + 0.0 as max, round(avg(v), 6) + 0.0 as mean, round(stddev_pop(v), 6) + 0.0 as std, round((select avg(nrm) from (select sqrt(sum(v * v)) as nrm from fy_a group by stkcd, p_year)), 6) + 0.0 as mean_norm from fy_a",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import files

    return QUERIES | files.QUERIES


def oracle_sql() -> dict[str, str]:
    from . import files

    return ORACLES | files.ORACLES
