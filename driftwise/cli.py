"""Command line: prepare, embed, similarity, events, self-similarity, extract, batch, preview, sample, inspect."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import short_model_name
from .operators import clean, embed, entity_year, events, extract, history, models, sampling, similarity
from .sources import readers, sinks


def load(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Stata, CSV or Parquet table by its ending; CSV columns are text until they are prepared."""
    if path.endswith(".dta"):
        return readers.read_stata(spark, path, columns)
    if path.endswith(".csv"):
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        df = spark.read.parquet(path)
    return clean.pruned(df, columns) if columns else df


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftwise", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=help_)
        c.add_argument("--input", required=True)
        c.add_argument("--output")
        return c

    command("prepare", "clean raw rows and build their text")
    c = command("embed", "document vectors, and one vector per entity and year")
    c.add_argument("--model-name", help="names the files; the model's folder by default")
    c.add_argument("--model", help="folder of an encoder (model.onnx, tokenizer.json) that all executors can open; without it, words are hashed")
    c.add_argument("--device", choices=("auto", "cpu", "cuda"), default="auto")
    c.add_argument("--width", type=int, default=64, help="of hashed vectors")
    c.add_argument("--batch-size", type=int)
    c.add_argument("--embed-backend", choices=("overflow", "sentences"), default="overflow")
    c.add_argument("--max-seq-length", type=int, help="512, or less if the model says so")
    c.add_argument("--row-chunk-size", type=int, default=100_000, help="rows that --max-chunks counts by")
    c.add_argument("--max-chunks", type=int, help="take only the first so many chunks, by code, date and id")
    c.add_argument("--device-memory", type=float, help="GB of the device's memory, by which the batch size is chosen; without it, a CPU's")
    c.add_argument("--include-empty-in-agg", action="store_true")
    c.add_argument("--save-npy", action="store_true")
    c.add_argument("--save-document-level", action=argparse.BooleanOptionalAction, default=True)
    c = command("similarity", "similarity of each entity-year to its past")
    c.add_argument("--weighted", help="table of weighted vectors, if there is one")
    c.add_argument("--calendar", action="store_true")
    c = command("events", "breaks that two models agree on")
    c.add_argument("--other", required=True, help="similarity table of the second model")
    c.add_argument("--min-docs", type=int, default=events.MIN_DOCS)
    c.add_argument("--threshold", type=float, default=events.THRESHOLD)
    c.add_argument("--courses", type=int, default=5, help="entities whose course is written beside the output")
    command("self-similarity", "every document against its entity's earlier ones")
    for name in ("extract", "batch"):
        c = command(name, "documents of entities in a period")
        c.add_argument("--stkcd" if name == "extract" else "--companies", required=True, dest="codes")
        c.add_argument("--year", type=int)
        c.add_argument("--start-year", type=int)
        c.add_argument("--end-year", type=int)
        c.add_argument("--format", choices=("csv", "markdown"), default="csv")
        c.add_argument("--combine", action="store_true")
    c = command("preview", "the first rows, long text cut")
    c.add_argument("-n", "--rows", type=int, default=5)
    c = command("sample", "entities with long and short histories")
    c.add_argument("--companies", help="take these codes instead")
    c = command("inspect", "counts per entity and year")
    c.add_argument("--step", choices=("load", "embed", "aggregate", "all"), default="all")
    c.add_argument("--company")
    return p


def prepared(df: DataFrame) -> DataFrame:
    return df if "text" in df.columns else clean.prepared(df)


def _show(df: DataFrame, n: int = 20) -> None:
    df.show(n, truncate=200)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    df = load(spark, args.input)
    if args.command == "prepare":
        out = clean.prepared(clean.cleaned(clean.renamed(df)))
        _show(clean.missing_profile(out))
        _show(clean.tabulated(out, "p_type"))
        _show(clean.duplicates(out, "stkcd", "p_id"))
    elif args.command == "embed":
        docs = prepared(df)
        if args.max_chunks:
            docs = clean.sorted_rows(docs, "stkcd", "p_date", "p_year", "p_id").limit(args.max_chunks * args.row_chunk_size)
        # equal documents without an id have one vector, which is the right one for each
        docs = docs.withColumn("_key", F.md5("text"))
        width = args.width
        name = args.model_name or (args.model.rstrip("/").rsplit("/", 1)[-1] if args.model else "hashing")
        if args.model:
            encoder, tokenizer, most = models.loaders(args.model, args.device, args.max_seq_length)
        else:
            encoder, tokenizer, most = (lambda: embed.HashingEncoder(width)), embed.WordTokenizer, args.max_seq_length or models.MOST_TOKENS
        # a model's special tokens need room in every window
        limit = embed.token_budget(most) if args.model or args.embed_backend == "sentences" else most
        batch = args.batch_size or embed.batch_size(args.device_memory, "minilm" in name.lower())
        vectors = embed.embedded(docs.select("_key", "text").distinct(), "_key", "text", encoder, batch, limit=limit, strategy=args.embed_backend, tokenizer=tokenizer)
        full = docs.join(vectors.select("_key", "embedding"), "_key").drop("_key")
        out = entity_year.entity_years(full, args.include_empty_in_agg)
        if args.output:
            width = models.vector_width(args.model) if args.model else width
            sinks.write_bundle(out, args.output, name, width)
            if args.save_document_level:
                sinks.write_parquet(full, f"{args.output}/document_level_{short_model_name(name)}.parquet")
            if args.save_npy:
                sinks.write_npy(out, f"{args.output}/{sinks.bundle_name('firm_year', name)}.npy", ["stkcd", "p_year"])
            return 0
    elif args.command == "similarity":
        first = similarity.similarity(df, calendar=args.calendar)
        other = readers.optional(spark, args.weighted) if args.weighted else (df.drop("embedding").withColumnRenamed("embedding_citw", "embedding") if "embedding_citw" in df.columns else None)
        out = similarity.merged(first, similarity.similarity(other, suffix="_citw", calendar=args.calendar) if other is not None else None)
        _show(similarity.summary(out))
    elif args.command == "events":
        other = load(spark, args.other)
        out = events.common_breaks(df, other, min_docs=args.min_docs, threshold=args.threshold)
        for model in (df, other):
            _show(events.model_stats(model, args.min_docs, args.threshold))
        _show(events.first_breaks(out))
        if args.output:
            # the courses of the first entities whose breaks both models see, a file each, as both models tell them
            some = [r[0] for r in out.select("stkcd").distinct().orderBy("stkcd").limit(args.courses).collect()]
            for code in some:
                one = events.two_model_course(df.where(F.col("stkcd") == code), other.where(F.col("stkcd") == code))
                sinks.write_one_csv(one.orderBy("p_year"), f"{args.output}.company_{code}_trajectory.csv")
    elif args.command == "self-similarity":
        dated = df if "date" in df.columns else df.withColumn("date", F.make_date("p_year", F.lit(1), F.lit(1)))
        out = history.self_similarity(dated)
        _show(similarity.summary(out, ["sim_max", "sim_ave"]))
    elif args.command in ("extract", "batch"):
        codes = [c.strip() for c in args.codes.split(",")]
        # counted, looked at and written: kept as the few rows it is
        out = extract.extracted(df, codes, args.year, args.start_year, args.end_year).persist()
        _show(extract.counts(out))
        if out.isEmpty():
            return 1
        if args.output and args.format == "markdown":
            span = str(args.year) if args.year else f"{args.start_year or ''}-{args.end_year or ''}"
            sinks.write_lines(extract.report(out, args.codes, span), args.output)
            return 0
        if args.output and args.command == "batch" and not args.combine:
            sinks.write_csv(out, args.output, by="stkcd")
            return 0
        if args.output:
            sinks.write_one_csv(out, args.output)
            return 0
    elif args.command == "preview":
        out = extract.previewed(df, args.rows)
        if args.output:
            sinks.write_one_csv(df.limit(args.rows), args.output)
            return 0
    elif args.command == "sample":
        if args.companies:
            out = extract.extracted(df, [c.strip() for c in args.companies.split(",")])
        else:
            chosen = sampling.strata(df.select("stkcd", "p_year").distinct())
            out = sampling.of_entities(df, chosen)
            _show(chosen)
    else:
        docs = prepared(df)
        docs = docs.where(F.col("stkcd") == args.company) if args.company else docs
        out = sampling.firm_year_stats(docs)
        if args.step in ("load", "all"):
            _show(sampling.overview(docs))
            _show(sampling.company_stats(docs))
        if args.step in ("embed", "aggregate", "all"):
            out = embed.embedded(docs.select(F.col("p_id"), "text").distinct())
            if args.step != "embed":
                full = docs.join(out.select("p_id", "embedding"), "p_id")
                out = entity_year.entity_years(full)
                _show(entity_year.vector_stats(out))
            if args.output:
                sinks.write_csv(sinks.wide(out.drop("embedding_citw"), 64), args.output)
                return 0
    if args.output:
        sinks.write_parquet(out, args.output)
    else:
        _show(out)
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("driftwise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return run(args, spark)


if __name__ == "__main__":
    sys.exit(main())
