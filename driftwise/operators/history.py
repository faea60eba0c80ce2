"""Every document against the entity's earlier documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions import vectors as V
from ..sources.scratch import scratch
from ..sources.sinks import delete

#: Bytes of vectors in one block, similarities held at once, and first documents of vectors that are looked up by a broadcast of their keys.
BLOCK_BYTES, CELLS, KEYS = 32 << 20, 1 << 21, 1_000_000
#: A vector of an entity: its width and two fingerprints.
_VECTOR = ["e", "w", "h1", "h2"]


def _order(d: pa.ChunkedArray, i: pa.ChunkedArray) -> np.ndarray:
    """The place of each row by (d, i); equal pairs share one."""
    rows = pa.table({"d": d, "i": i})
    at = pc.sort_indices(rows, [("d", "ascending"), ("i", "ascending")]).to_numpy()
    new = np.zeros(len(at), bool)
    for c in ("d", "i"):
        v = rows.column(c).take(pa.array(at)).combine_chunks()
        if len(v) > 1:
            new[1:] |= np.array(pc.not_equal(v[1:], v[:-1]))
    place = np.empty(len(at), np.int64)
    place[at] = np.cumsum(new)
    return place


def _units(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    u = pa.concat_arrays(vectors.chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return u / np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]


def _compared(group: pa.Table) -> pa.Table:
    """Of a block of later vectors and a block of earlier ones (or one that is both): each later one's nearest."""
    u = _units(group.column("u"), group.column("w")[0].as_py())
    place, side = _order(group.column("d"), group.column("i")), group.column("side").to_numpy()
    later, earlier = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
    earlier = earlier[np.argsort(place[earlier], kind="stable")]
    # the earlier ones of a later one are the first so many
    count = np.searchsorted(place[earlier], place[later], "left")
    later, count = later[at := np.argsort(count, kind="stable")], count[at]
    later, count = later[count > 0], count[count > 0]
    against, step = np.ascontiguousarray(u[earlier].T), max(1, CELLS // max(1, len(earlier)))
    best, score = np.zeros(len(later), np.int64), np.zeros(len(later))
    for start in range(0, len(later), step):
        rows, n = slice(start, start + step), int(count[start : start + step].max())
        s = u[later[rows]] @ against[:, :n]
        low = int(count[start])
        s[:, low:][np.arange(low, n)[None, :] >= count[rows][:, None]] = -np.inf
        # of values that differ by rounding alone the first counts, as of equal ones
        near = s >= (s.max(axis=1) - 2e-12)[:, None]
        found = near.argmax(axis=1)
        for r in np.flatnonzero(near.sum(axis=1) > 1):
            found[r] = np.round(s[r], 12).argmax()
        best[rows], score[rows] = earlier[found], s[np.arange(len(found)), found]
    one, two = group.take(pa.array(later)), group.take(pa.array(best))
    return pa.table({**{c: one.column(c) for c in _VECTOR}, "s": pa.array(score, pa.float64()), "q": two.column("d"), "j": two.column("i"), "g": two.column("g")})


def _part_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part the sum of unit vectors and their number, over one task's vectors with their counts."""
    sums: dict = {}
    kind = None
    for b in batches:
        kind = kind or b.schema.field("e").type
        if not b.num_rows:
            continue
        for w in pc.unique(b.column("w")).to_pylist():
            t = pa.Table.from_batches([b]).filter(pc.equal(b.column("w"), w))
            u, n = _units(t.column("u"), w), t.column("n").to_numpy()
            keys: dict = {}
            at = np.array([keys.setdefault(k, len(keys)) for k in zip(t.column("e").to_pylist(), t.column("part").to_pylist(), strict=True)])
            total = np.zeros((len(keys), w))
            np.add.at(total, at, u * n[:, None])
            for (e, p), k in keys.items():
                old = sums.get((e, w, p), (0.0, 0))
                sums[e, w, p] = (old[0] + total[k], old[1] + int(n[at == k].sum()))
    if sums:
        e, w, p = zip(*sums, strict=True)
        yield pa.RecordBatch.from_pydict({"e": pa.array(e, kind), "w": pa.array(w, pa.int32()), "part": pa.array(p, pa.int32()), "u": pa.array([v.tolist() for v, _ in sums.values()], pa.list_(pa.float64())), "n": pa.array([n for _, n in sums.values()], pa.int64())})


def _sums_before(group: pa.Table) -> pa.Table:
    """Of an entity: per part, the sum and the number of all vectors of the parts before."""
    w = group.column("w")[0].as_py()
    part, n = group.column("part").to_numpy(), group.column("n").to_numpy()
    parts, at = np.unique(part, return_inverse=True)
    total, counts = np.zeros((len(parts) + 1, w)), np.zeros(len(parts) + 1, np.int64)
    np.add.at(total, at + 1, pa.concat_arrays(group.column("u").chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, w))
    np.add.at(counts, at + 1, n)
    first = group.take(pa.array(np.zeros(len(parts), np.int64)))
    return pa.table({"e": first.column("e"), "w": first.column("w"), "part": pa.array(parts, pa.int32()), "u": pa.array(list(np.cumsum(total, axis=0)[:-1]), pa.list_(pa.float64())), "n": pa.array(np.cumsum(counts)[:-1], pa.int64())})


def _judged(group: pa.Table) -> pa.Table:
    """Of a part: its documents (kind 0) with the nearest of their vectors (kind 1) and the mean over all earlier ones (kind 2: those of the parts before)."""
    w = group.column("w")[0].as_py()
    kind = group.column("kind").to_numpy()
    docs, vectors, before = (group.take(pa.array(np.flatnonzero(kind == k))) for k in range(3))
    u = _units(vectors.column("u"), w)
    row = {k: r for r, k in enumerate(zip(vectors.column("h1").to_pylist(), vectors.column("h2").to_pylist(), strict=True))}
    at = np.array([row[k] for k in zip(docs.column("h1").to_pylist(), docs.column("h2").to_pylist(), strict=True)], np.int64)
    place = _order(docs.column("d"), docs.column("i"))
    order = np.argsort(place, kind="stable")
    x = u[at[order]]
    sums = np.empty((len(x), w))
    sums[0] = np.array(before.column("u")[0].as_py())
    np.add(np.cumsum(x[:-1], axis=0), sums[0], out=sums[1:])
    left = np.searchsorted(place[order], place[order], "left")
    number = before.column("n")[0].as_py() + left
    mean, total = np.empty(len(x)), np.einsum("ij,ij->i", x, sums[left])
    mean[order] = np.divide(total, number, out=np.full(len(x), np.nan), where=number > 0)
    # a vector's first document has what was found; to all later ones the first is as near as can be, unless a parallel one is earlier
    mine = vectors.take(pa.array(at))
    same = [pc.equal(docs.column(c).combine_chunks(), mine.column(c).combine_chunks()).to_numpy(zero_copy_only=False).astype(bool) for c in ("d", "i")]
    found = mine.column("s").to_numpy().astype(np.float64)
    as_found = (same[0] & same[1]) | (np.round(found, 12) >= 1)
    s = np.where(as_found, found, np.einsum("ij,ij->i", u, u)[at])
    nearest = pc.if_else(pa.array(as_found), mine.column("m").combine_chunks(), mine.column("g").combine_chunks())
    return pa.table({**{c: docs.column(c) for c in docs.column_names if c in ("e", "y", "i", "g")}, "sim_max": pa.array(s, from_pandas=True), "m": nearest, "sim_ave": pa.array(mean, from_pandas=True)})


def self_similarity(docs: DataFrame, block: int | None = None, entity: str = "stkcd", date: str = "date", id_col: str = "p_id") -> DataFrame:
    """sim_max, days back to that earlier document (the earliest of ties), and sim_ave.

    Earlier is by (date, id); an id is unique within its entity and date. Vectors
    of different widths are not compared; documents without usable vectors, an
    entity or an id have null results.

    The mean over earlier documents is a product with the sum of their unit
    vectors: documents are dealt to parts by order, and a part needs only the sum
    over those before it. Only different vectors of an entity are compared, each
    as of its first document, since a later document's nearest is the first with
    its vector or one parallel to it. They are dealt to blocks of consecutive ones;
    a block meets itself and every earlier one as a matrix product that is reduced
    in place. So no pair is ever a row, no task holds more than two blocks, a
    vector is copied once per block and not per document, and an entity with very
    many documents is spread over tasks. A block and a part have about ``block``
    rows, by default as many vectors as ``BLOCK_BYTES`` hold. Intermediate tables
    are written to ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    v = F.col("embedding") if docs.schema["embedding"].dataType == ArrayType(DoubleType()) else V.as_doubles(F.col("embedding"))
    day = F.coalesce(F.col(date), F.lit("9999-12-31").cast("date"))
    years = [c for c in ("p_year",) if c in docs.columns]
    named = docs.select(F.col(entity).alias("e"), *(F.col(c).alias("y") for c in years), F.col(id_col).alias("i"), F.col(date).alias("g"), day.alias("d"), v.alias("u"))
    usable = F.col("e").isNotNull() & F.col("i").isNotNull() & (F.size("u") > 0) & ~F.exists("u", lambda x: ~V.is_finite(x)) & (V.norm(F.col("u")) > V.TOLERANCE)

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("w", F.when(usable, F.size("u"))).withColumn("h1", F.when(F.col("w").isNotNull(), F.xxhash64("u"))).withColumn("h2", F.when(F.col("w").isNotNull(), F.xxhash64(F.lit(1), "u")))

    made = []

    def kept(df: DataFrame) -> DataFrame:
        made.append(scratch(spark))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    rows = kept(marked(named).drop("u"))
    total, width = rows.agg(F.count("w"), F.max("w")).first()
    block = block or max(1, BLOCK_BYTES // (8 * (width or 1)))
    dealt = kept(rows.repartitionByRange(-(-total // block) or 1, "e", "w", "d", "i").withColumn("part", F.spark_partition_id()))
    delete(spark, made[0])
    good, bad = dealt.where("w is not null"), dealt.where("w is null")

    uses = good.groupBy(*_VECTOR, "part").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "i", "g", "part")).alias("f"))
    uses = kept(uses.withColumn("f", F.min("f").over(Window.partitionBy(*_VECTOR))))
    firsts = uses.where("part = f.part").select(*_VECTOR, "part", "f.d", "f.i", "f.g")
    number = firsts.count()
    wanted = named
    if number <= KEYS:  # else most vectors are wanted, or the keys would fill a broadcast
        wanted = named.join(F.broadcast(firsts.select(F.xxhash64("e", "d", "i").alias("k"))), F.xxhash64("e", "d", "i") == F.col("k"), "left_semi")
    wanted = marked(wanted).where("w is not null").select(*_VECTOR, "d", "i", "u")
    vectors = kept(wanted.join(firsts, [*_VECTOR, "d", "i"]))
    if vectors.count() > number:  # a document that is there twice
        vectors = vectors.dropDuplicates(_VECTOR)

    ahead = Window.partitionBy("e", "w").orderBy("part")
    blocks = firsts.groupBy("e", "w", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.floor((F.sum("n").over(ahead) - F.col("n")) / block))
    blocks = blocks.withColumn("last", F.max("own").over(Window.partitionBy("e", "w"))).drop("n")
    dealt_vectors = vectors.join(blocks, ["e", "w", "part"])
    columns = [*_VECTOR, "d", "i", "g", "u"]
    as_later = dealt_vectors.select(*columns, F.col("own").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("y"), F.lit(1).alias("side"))
    as_earlier = dealt_vectors.where("own < last").select(*columns, F.explode(F.sequence(F.col("own") + 1, "last")).alias("x"), F.col("own").alias("y"), F.lit(2).alias("side"))
    sides = as_later.withColumn("side", F.when(F.col("x") == F.col("y"), 0).otherwise(F.col("side"))).unionByName(as_earlier)
    keys = ["e", "w", "x", "y"]
    # few bytes make much work here, so the session's number of partitions holds, not one by bytes
    sides = sides.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)

    kind = {f.name: f.dataType for f in dealt.schema.fields}
    shape = lambda **of: StructType([StructField(c, t) for c, t in of.items()])
    vector = {c: kind[c] for c in _VECTOR}
    sims = sides.groupBy(*keys).applyInArrow(_compared, shape(**vector, s=DoubleType(), q=kind["d"], j=kind["i"], g=kind["g"]))
    best = sims.groupBy(*_VECTOR).agg(F.min(F.struct(-F.round("s", 12), "q", "j", "s", "g")).alias("m"))
    vectors = kept(vectors.join(best, _VECTOR, "left").select(*columns, F.col("m.s").alias("s"), F.col("m.g").alias("m")))

    spread = uses.select(*_VECTOR, "part", "n").join(vectors, _VECTOR)
    sums = shape(e=kind["e"], w=kind["w"], part=kind["part"], u=ArrayType(DoubleType()), n=LongType())
    before = spread.select("e", "w", "part", "n", "u").mapInArrow(_part_sums, sums).groupBy("e", "w").applyInArrow(_sums_before, sums)
    every = good.withColumn("kind", F.lit(0)).unionByName(spread.drop("n").withColumn("kind", F.lit(1)), True).unionByName(before.withColumn("kind", F.lit(2)), True)
    out = {c: kind[c] for c in ("e", "y", "i", "g") if c in kind} | {"sim_max": DoubleType(), "m": kind["g"], "sim_ave": DoubleType()}
    judged = every.groupBy("e", "w", "part").applyInArrow(_judged, shape(**out))
    return judged.unionByName(bad.select([c for c in out if c in kind]), True).select(
        F.col("e").alias(entity), *(F.col("y").alias(c) for c in years), F.col("i").alias(id_col), F.col("g").alias(date), "sim_max", F.datediff("g", "m").alias("sim_max_d"), "sim_ave"
    )
