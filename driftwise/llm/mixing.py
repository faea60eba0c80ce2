"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of (source, language, topic); raking scales the
cells' token weights to one marginal after another until all agree with the
targets. A document's probability is its cell's weight over a cut, 1 at most; it
is taken when a hash of its id falls below that. The cut is the largest weight,
where that leaves at least ``SHARE`` of the tokens to be expected. Else it is the
one that leaves just that many, and cells with larger weights, which would need
repeating, are taken whole; so a tiny cell does not shrink all others, and what
is taken grows with what there is.

Only DataFrame functions are used. The cells are partially aggregated before
they are dealt out, so a source with a third of all rows costs one row per task
and cell; cells and factors are written to the shared folder. Whether the cells
are broadcast to the documents is left to Spark, which checks their size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Stored, table

ROUNDS, TEMPERATURE, SHARE = 8, 0.7, 0.5
DIMS = ("source", "lang", "topic")
#: Where no column names a document's topic, the first of these does of which its text holds a string, else the last one.
TOPICS = (
    ("table", ("|",)),
    ("legal", ("icense", "icence", "opyright", "ights reserved")),
    ("contact", ("@",)),
    ("question", ("?",)),
    ("prose", ()),
)


def cells_of(docs: DataFrame, dims=DIMS, tokens: str = "tokens") -> DataFrame:
    return docs.groupBy(*dims).agg(F.sum(tokens).cast("double").alias("n"))


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, dims=DIMS, rounds: int = ROUNDS, temperature: float = TEMPERATURE, tolerance: float = 0.0) -> DataFrame:
    """``cells`` (dims, n) with a column w: the factor on each cell's tokens.

    That factor is a product of one per value of each dim. Only these are kept
    from step to step, in tables of a marginal's size; the cells are written once
    and read by each step, whose plan stays the same. At most ``rounds`` rounds;
    fewer, if no step from a round's first marginals is further than
    ``tolerance`` from 1.

    ``targets`` gives shares per dimension and value; a value it lacks has the
    share 0. A dimension it lacks aims at shares in proportion to tokens **
    ``temperature``. Marginals without tokens keep their weights.
    """
    spark = cells.sparkSession
    base = Stored(cells.select(*dims, "n"), cells=F.count(F.lit(1)), total=F.sum("n"))
    n_cells, total = base.seen.get("cells", 0), base.seen.get("total")
    states, wholes = {}, {}
    for d in dims:
        by = base.df.groupBy(d).agg(F.sum("n").alias("t"))
        if targets and d in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], "v string, part double")
            part = by.join(given, F.col(d) == F.col("v"), "left").select(d, F.coalesce("part", F.lit(0.0)).alias("part"))
        else:
            part = by.select(d, F.pow("t", F.lit(temperature)).alias("part"))
        states[d] = Stored(part.withColumn("f", F.lit(1.0)), n_cells, whole=F.sum("part"))
        wholes[d] = states[d].seen.get("whole")

    def weighed(by) -> DataFrame:
        """The cells with the product of these dims' factors as w."""
        df = base.df.withColumn("w", F.lit(1.0))
        for d in by:
            df = df.join(states[d].df.select(d, "f"), d).select(*dims, "n", (F.col("w") * F.col("f")).alias("w"))
        return df

    def stepped(d: str) -> Stored:
        """The factors of ``d`` under which its marginals are the goals, and how far from 1 any of them moved its marginal."""
        have = weighed(o for o in dims if o != d).groupBy(d).agg(F.sum(F.col("n") * F.col("w")).alias("have"))
        goal = F.col("part") * F.lit(total / wholes[d] if wholes[d] else 0.0)
        rows = states[d].df.select(d, "part", F.col("f").alias("f0")).join(have, d)
        now = rows.select(d, "part", "f0", F.when(F.col("have") > 0, goal / F.col("have")).otherwise(F.col("f0")).alias("f"))
        return Stored(now, n_cells, moved=F.max(F.abs(F.try_divide("f", "f0") - 1)))

    for k in range(rounds):
        for d in dims:
            then = stepped(d)
            settled = k and tolerance and d == dims[0] and (then.seen.get("moved") or 0.0) <= tolerance
            states[d].drop()
            states[d] = then
            if settled:
                break
        if settled:
            break
    out = Stored(weighed(dims), n_cells)
    for each in (base, *states.values()):
        each.drop()
    return out.df


def cut_of(cells: DataFrame, share: float) -> float | None:
    """The weight from which on cells are taken whole; None without tokens.

    With it, sum(n * min(1, w / cut)) is ``share`` of the tokens of cells that have
    a weight, or more if the largest weight as the cut gives more. Every round
    lowers the cut by what the cells found whole so far leave to the others.
    """
    cells = cells.where("n > 0 and w > 0")
    top, total = cells.agg(F.max("w"), F.sum("n")).first()
    cut = top
    while cut is not None:
        whole, rest = cells.agg(*(F.coalesce(F.sum(F.when(c, v)), F.lit(0.0)) for c, v in ((F.col("w") >= cut, F.col("n")), (F.col("w") < cut, F.col("n") * F.col("w"))))).first()
        if not rest or whole + rest / cut >= share * total * (1 - 1e-9):
            break
        cut = rest / (share * total - whole)
    return cut


def uniform(id_: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(16.0**13)


def helper_prefix(docs: DataFrame) -> str:
    """As many underscores as no column of ``docs`` starts with."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def named(c: Column) -> Column:
    """A text for every value, null included, and no two values with the same."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def value_of(name: Column) -> Column:
    return F.when(name != "", F.substring(name, 2, 1 << 30))


def topic_of(text: Column) -> Column:
    out = None
    for topic, strings in TOPICS[:-1]:
        hit = reduce(Column.__or__, (F.contains(F.coalesce(text, F.lit("")), F.lit(x)) for x in strings))
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out.otherwise(TOPICS[-1][0])


def mixed(
    docs: DataFrame, targets: dict[str, dict[str | None, float]] | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    topic: str | None = None, share: float | None = SHARE, tokens: str | None = None, rounds: int = ROUNDS, tolerance: float = 0.0, prefix: str | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` and, behind ``prefix``, source, lang, topic, tokens, weight, probability and sampled.

    ``prefix`` is one underscore, or more if columns of ``docs`` start so. The
    three dims are named by ``named``, so a null source, language or topic is a
    value of its own; ``targets`` has it under None. Tokens are those of the
    column ``tokens``, else a quarter of the text's bytes, rounded up; null and
    empty texts have none. Without a column ``topic``, the text's topic is the
    first of ``TOPICS``. Rows that repeat an id share its fate; an empty table
    stays empty, and if no document has tokens every one is taken. ``share`` is
    the part of the tokens to expect at least; with None the cut is the largest
    weight.
    """
    p = prefix or helper_prefix(docs)
    size = F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)
    dims = tuple(p + d for d in DIMS)
    values = (F.col(source), F.col(lang), F.col(topic) if topic else topic_of(F.col(text)))
    rows = docs.withColumns({d: named(v) for d, v in zip(dims, values, strict=True)} | {p + "tokens": F.coalesce(tokens, F.lit(0)) if tokens else size})
    renamed = {p + d: {"" if k is None else f"={k}": v for k, v in goal.items()} for d, goal in (targets or {}).items()}
    cells = raked(cells_of(rows, dims, p + "tokens"), renamed, dims, rounds, tolerance=tolerance)
    cut = cells.where("n > 0").agg(F.max("w")).first()[0] if share is None else cut_of(cells, share)
    probability = F.least(F.lit(1.0), F.col("w") / F.lit(cut)) if cut else F.lit(1.0)
    calibrated = cells.select(*dims, F.col("w").alias(p + "weight"), probability.alias(p + "probability"))
    sampled = uniform(F.col(id_col)) < F.col(p + "probability")
    return rows.join(calibrated, list(dims)).withColumn(p + "sampled", sampled).select(*docs.columns, *(p + c for c in (*DIMS, "tokens", "weight", "probability", "sampled")))


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``, with its own columns as they were."""
    p = helper_prefix(docs)
    return mixed(docs, prefix=p, **options).where(f"{p}sampled").select(*docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its cell, tokens, calibrated weight and probability, and whether it is sampled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixed(docs).select(
        "doc_id", value_of(F.col("_source")).alias("source"), value_of(F.col("_lang")).alias("lang"), value_of(F.col("_topic")).alias("topic"), F.col("_tokens").cast("long").alias("tokens"),
        F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"),
    )


def raking_sql(docs_sql: str) -> str:
    """Common table expressions ending in ``mixed``: the rows of ``docs_sql`` with _topic, _tokens, _weight, _probability, _sampled."""
    topic = "case " + " ".join(f"when {' or '.join(f"contains(coalesce(text, ''), '{x}')" for x in strings)} then '={t}'" for t, strings in TOPICS[:-1]) + f" else '={TOPICS[-1][0]}' end"
    ctes = [
        f"r as materialized (select *, coalesce('=' || source, '') as _source, coalesce('=' || lang, '') as _lang, {topic} as _topic, cast(ceil(coalesce(strlen(text), 0) / 4.0) as bigint) as _tokens from ({docs_sql}))",
        "c0 as materialized (select _source, _lang, _topic, cast(sum(_tokens) as double) as n, 1.0::double as w from r group by all)",
    ]
    for d in DIMS:
        ctes.append(f"g_{d} as materialized (select _{d}, (select sum(n) from c0) * part / (select sum(part) from (select pow(sum(n), {TEMPERATURE}) as part from c0 group by _{d})) as goal from (select _{d}, pow(sum(n), {TEMPERATURE}) as part from c0 group by _{d}))")
    last = "c0"
    for k in range(ROUNDS):
        for d in DIMS:
            new = f"c{k + 1}_{d}"
            ctes.append(f"{new} as materialized (select c.* replace (c.w * f.f as w) from {last} c join (select h._{d}, case when have > 0 then goal / have else 1 end as f from (select _{d}, sum(n * w) as have from {last} group by _{d}) h join g_{d} using (_{d})) f using (_{d}))")
            last = new
    # the cut, of those that take the k largest different weights whole, that lies between the last of these and the next
    ctes.append(f"""by_w as (select w, sum(n) as n, sum(n * w) as nw from {last} where n > 0 and w > 0 group by w),
steps as (select w, lead(w) over (order by w desc) as next, sum(n) over (order by w desc) as whole, sum(nw) over (order by w desc rows between 1 following and unbounded following) as rest, sum(n) over () as total from by_w),
cut as materialized (select case when sum(nw) >= max(w) * {SHARE} * sum(n) * (1 - 1e-9) then max(w) else (select max(rest / ({SHARE} * total - whole)) from steps where {SHARE} * total > whole and rest / ({SHARE} * total - whole) between next * (1 - 1e-9) and w * (1 + 1e-9)) end as top from by_w)""")
    ctes.append(f"mixed as materialized (select r.*, c.w as _weight, case when t.top > 0 then least(1.0, c.w / t.top) else 1.0 end as _probability, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / {16.0**13!r} < _probability as _sampled from r join {last} c using (_source, _lang, _topic) cross join cut t)")
    return ",\n".join(ctes)


ORACLE_SQL = (
    "with " + raking_sql("select doc_id, text, source, lang from documents") + "\nselect doc_id, " + ", ".join(f"nullif(_{d}, '')[2:] as {d}" for d in DIMS) + ", _tokens as tokens, "
    "round(_weight, 6) as weight, round(_probability, 6) as probability, _sampled as sampled from mixed"
)
