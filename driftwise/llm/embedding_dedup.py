"""Embedding near-dedup by lattice hashing.

Unit vectors are projected by random Gaussian matrices to ``BLOCKS`` x 8
dimensions in each of ``TABLES`` tables. Each 8-dimensional block is decoded to
the nearest point of the E8 lattice; the points of a table's blocks name a cell.
Every vector is stored under its own cell and looks up, besides that cell, the
neighbouring cells whose lattice points come next nearest. Vectors that meet are
verified by cosine in double precision, so no reported link is wrong; at a
cosine of 0.98 a link is missed with a probability measured below 0.001.

Exact copies are collapsed before hashing. Where few vectors meet, pairs are
formed and their vectors fetched once. A cell where many meet many is crowded:
its vectors are compared as blocks of a matrix, and what leaves a block is a
number of links and one edge to a representative per vector, so a group of n
mutually linked vectors makes rows in proportion to n, not to its square. A pair
that meets in several crowded cells is counted in the one with the least name,
and one that meets in any of them is not counted as a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, sliced, stored, table

TABLES, BLOCKS, PROBES, SCALE, SEED = 4, 2, 24, 0.68, 2011
#: Pairs for each vector that meets others in a cell, beyond which the cell is crowded, and vectors in one side of a block.
PAIRS, SIDE = 2, 1024


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice points to the rows of ``x`` (n, 8), doubled so that they are integers."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
        gap = y[odd] - r[odd]
        worst = np.abs(gap).argmax(axis=1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
        return r

    whole, half = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], half, whole)).astype(np.int64)


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([1 if bits >> k & 1 else -1 for k in range(8)], np.int64)
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = e8_roots()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _name(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name of each row of integers."""
    h = np.full(len(points), np.uint64(0x243F6A8885A308D3 ^ salt), np.uint64)
    for k in range(points.shape[1]):
        h = _mix(h + points[:, k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)))
    return h


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Own cell names (n, tables) and the names of neighbouring cells to look up (n, tables, probes)."""
    n, d = unit.shape
    own = np.empty((n, tables), np.uint64)
    near = np.empty((n, tables, probes), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng(SEED + 7919 * t)
        x = (unit @ rng.standard_normal((d, 8 * BLOCKS))) * scale
        points = [e8_nearest(x[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)]
        names = [_name(p, b + 1) for b, p in enumerate(points)]
        # moving one block by a root r changes its squared distance by |r|^2 - 2 r.(x - c), |r|^2 = 2
        roots, cost = [], []
        for b in range(BLOCKS):
            gap = x[:, 8 * b : 8 * b + 8] - points[b] / 2.0
            by = 2.0 - gap @ ROOTS.T
            k = min(probes, 240)
            at = np.argpartition(by, k - 1, axis=1)[:, :k]
            c = np.take_along_axis(by, at, axis=1)
            order = np.argsort(c, axis=1)
            at, c = np.take_along_axis(at, order, axis=1), np.take_along_axis(c, order, axis=1)
            moved = (points[b][:, None, :] + ROOTS[at]).reshape(-1, 8)
            roots.append(_name(moved, b + 1).reshape(n, k))
            cost.append(c)
        join = lambda a, b: _mix(a * np.uint64(0xD6E8FEB86659FD93) + b + np.uint64(t))
        own[:, t] = join(names[0], names[1])
        both = 6  # of each block's best moves, also made together
        offers = np.concatenate(
            [join(roots[0], names[1][:, None]), join(names[0][:, None], roots[1])]
            + [join(roots[0][:, :both, None], roots[1][:, None, :both]).reshape(n, -1)],
            axis=1,
        )
        price = np.concatenate([cost[0], cost[1], (cost[0][:, :both, None] + cost[1][:, None, :both]).reshape(n, -1)], axis=1)
        best = np.argpartition(price, probes - 1, axis=1)[:, :probes]
        near[:, t] = np.take_along_axis(offers, best, axis=1)
    return own, near


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: str = "embedding", label: str | None = "label") -> F.Column:
    """Not null, not zero, and every component there and finite."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0)
    good = good & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = good & F.exists(v, lambda x: x != 0)
    return good & F.col(label).isNotNull() if label else good


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        widths = np.array(batch.column("width"))
        for width in np.unique(widths):
            part = batch.filter(pa.array(widths == width))
            x = sized(_matrix(part.column("v")))
            own, near = cells(x / np.linalg.norm(x, axis=1)[:, None])
            n, p = len(x), near.shape[2] + 1
            every = np.concatenate([own[:, :, None], near], axis=2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(part.column("label")), TABLES * p)),
                    pa.array(every.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(np.array(part.column("id")), TABLES * p)),
                    pa.array(np.tile(np.arange(p) == 0, n * TABLES)),
                ],
                names=["label", "cell", "id", "own"],
            )


def sized(x: np.ndarray) -> np.ndarray:
    """Rows whose squares would vanish or overflow, times a power of two, which leaves every cosine as it is."""
    large = np.abs(x).max(axis=1, initial=0.0)
    odd = (large > 0) & ((large < 1e-100) | (large > 1e100))
    if odd.any():
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(large[odd])[1][:, None])
    return x


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of ``a`` with those of ``b``, one by one."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.repeat(np.arange(len(column)), np.array(column.value_lengths().fill_null(0))), np.array(column.flatten())


def _shared(own: pa.Array, visited: pa.Array, n: int) -> np.ndarray:
    """Whether a row's lists have a value in common."""
    (ro, vo), (rv, vv) = _lists(own), _lists(visited)
    both = np.unique(np.c_[np.r_[ro, rv], np.r_[vo, vv], np.r_[np.zeros(len(ro), np.int64), np.ones(len(rv), np.int64)]], axis=0)
    same = (both[1:, :2] == both[:-1, :2]).all(axis=1)
    out = np.zeros(n, bool)
    out[both[1:, 0][same]] = True
    return out


def _close(threshold: float):
    """Links among pairs that meet in no crowded cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            part = batch.filter(pa.array(np.array(batch.column("wa")) == np.array(batch.column("wb"))))
            if len(part):
                crowded = _shared(part.column("oa"), part.column("cb"), len(part)) | _shared(part.column("ob"), part.column("ca"), len(part))
                part = part.filter(pa.array(~crowded))
            cos = np.zeros(len(part))
            widths = np.array(part.column("wa"))
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                cos[at] = _cosines(*(sized(_matrix(part.column(c).take(pa.array(at)))) for c in ("va", "vb")))
            keep = pa.array(cos >= threshold)
            yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(cos).filter(keep)], names=["a", "b", "cosine"])

    return run


def _block(threshold: float):
    """Of one block of a crowded cell: every linked vector's number of links counted here, and the least id it reaches."""

    def run(group: pa.Table) -> pa.Table:
        i, j, cell = (group.column(c)[0].as_py() for c in ("i", "j", "cell"))
        side = np.array(group.column("side"))
        one, two = np.flatnonzero(side == i), np.flatnonzero(side == j)
        ids, copies, own = (np.array(group.column(c)) for c in ("id", "copies", "own"))
        v = sized(_matrix(group.column("v")))
        unit = v / np.linalg.norm(v, axis=1)[:, None]
        cos = unit[one] @ unit[two].T
        link = cos >= threshold
        # by the stated measure where rounding could tell otherwise
        r, c = np.nonzero(np.abs(cos - threshold) < 1e-9)
        link[r, c] = _cosines(v[one[r]], v[two[c]]) >= threshold
        link &= own[one][:, None] | own[two][None, :]
        link &= ids[one][:, None] != ids[two][None, :]
        counted = link & ~_met_before(group, one, two, cell) if link.any() else link
        n = np.zeros(len(ids), np.int64)
        n[one] += counted @ copies[two]
        if i != j:
            n[two] += counted.T @ copies[one]
        # the least id reachable within the block
        least, none = ids.copy(), np.iinfo(np.int64).max
        while len(one) and len(two):
            now = least.copy()
            now[one] = np.minimum(now[one], np.where(link, least[two][None, :], none).min(axis=1))
            now[two] = np.minimum(now[two], np.where(link, now[one][:, None], none).min(axis=0))
            if (now == least).all():
                break
            least = now
        out = np.flatnonzero((n > 0) | (least != ids))
        return pa.table({"id": pa.array(ids[out]), "n": pa.array(n[out]), "to": pa.array(least[out])})

    return run


def _met_before(group: pa.Table, one: np.ndarray, two: np.ndarray, cell: int) -> np.ndarray:
    """Which pairs meet in a crowded cell of a lesser name: one of them owns it and the other looks it up."""
    (ro, vo), (rv, vv) = (_lists(group.column(c)) for c in ("owned", "crowded"))
    names = np.unique(vo[vo < cell])
    met = np.zeros((len(one), len(two)), bool)
    for start in range(0, len(names), 1024):
        some = names[start : start + 1024]

        def table(row: np.ndarray, value: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(some, value), len(some) - 1)  # noqa: B023
            hit = some[at] == value  # noqa: B023
            out = np.zeros((len(group), len(some)), np.float32)  # noqa: B023
            out[row[hit], at[hit]] = 1
            return out

        owns, sees = table(ro, vo), table(rv, vv)
        met |= (owns[one] @ sees[two].T + sees[one] @ owns[two].T) > 0
    return met


def near_copies(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of equally labelled vectors with cosine >= ``threshold``, counted.

    Returns (classes, counts, edges). classes: id, rep (smallest id with the very
    same label and vector), copies. counts: id of a representative, and the
    number of rows of other vectors that it is linked with. edges: pairs of
    linked, or over links reachable, representatives that connect what links
    connect. Rows whose label is null or whose vector is null, empty, zero or
    holds null or non-finite components are in none. Vectors of different widths
    never link. Other columns of ``vectors`` are not read.
    """
    good = vectors.where(usable(vector, label)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    keyed = good.withColumn("h", F.xxhash64("v"))
    sums = keyed.groupBy("label", "h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = stored(sums.select(F.col("rep").alias("id"), "label", "h", "v", "copies", F.size("v").alias("width")))
    classes = keyed.join(reps.select("label", "h", "v", F.col("id").alias("rep"), "copies"), ["label", "h", "v"]).select("id", "rep", "copies")
    found = reps.where("id is not null").select("id", "label", "v", "width").mapInArrow(_cells_of, "label string, cell long, id long, own boolean")
    owners, visitors = F.count_if("own"), F.count(F.lit(1))
    sizes = found.groupBy("label", "cell").agg(owners.alias("owners"), visitors.alias("visitors")).where("owners > 0 and visitors > 1")
    sizes = sizes.select("label", "cell", F.expr(f"owners * visitors > {PAIRS} * (owners + visitors)").alias("crowd"), F.ceil(F.col("visitors") / SIDE).cast("int").alias("parts"))
    meet = stored(found.join(sizes, ["label", "cell"]))
    # at most as many entries as a vector has cells
    crowds = meet.where("crowd").groupBy("id").agg(F.collect_list("cell").alias("crowded"), F.collect_list(F.when(F.col("own"), F.col("cell"))).alias("owned"))
    v = stored(reps.select("id", "v", "width", "copies").join(crowds, "id", "left"))
    few = meet.where("not crowd")
    pairs = few.where("own").select("label", "cell", F.col("id").alias("o")).join(few.select("label", "cell", F.col("id").alias("p")), ["label", "cell"])
    pairs = pairs.where("o <> p").select(F.least("o", "p").alias("a"), F.greatest("o", "p").alias("b")).distinct()
    end = lambda x: v.select(F.col("id").alias(x), *(F.col(c).alias(n + x) for c, n in (("v", "v"), ("width", "w"), ("crowded", "c"), ("owned", "o"))))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    links = stored(both.mapInArrow(_close(threshold), "a long, b long, cosine double"))
    dense = meet.where("crowd").select("label", "cell", "id", "own", "parts").join(v, "id").withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dense.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("side", "x"), "j": F.greatest("side", "x")})
    blocks = dealt.select("label", "cell", "width", "i", "j", "side", "id", "own", "v", "copies", "crowded", "owned").groupBy("label", "cell", "width", "i", "j")
    counted = stored(blocks.applyInArrow(_block(threshold), "id long, n long, to long"))
    ends = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    single = ends.join(v.select(F.col("id").alias("y"), "copies"), "y").select(F.col("x").alias("id"), F.col("copies").alias("n"))
    counts = single.unionByName(counted.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
    edges = links.select("a", "b").unionByName(counted.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")).distinct())
    return classes, counts, edges


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Nulls, zero vectors and unlabelled rows link with nothing and are kept, each
    its own component; a null vec_id gives null component_id and kept. An empty
    table gives an empty result. If ids repeat, links and copies count rows.
    """
    vectors = table(spark, sf_dir, "embeddings")
    classes, counts, edges = near_copies(vectors)
    component = connected_components(edges)
    per_rep = counts.join(component, "id", "full").select(F.col("id").alias("rep"), F.coalesce("n", F.lit(0)).alias("others"), "component")
    per_id = classes.join(per_rep, "rep", "left").groupBy("id").agg(
        F.max(F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.min(F.coalesce("component", "rep")).alias("c")
    )
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    return every.join(per_id, every.vec_id == per_id.id, "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("c", "vec_id")).alias("kept"),
    )


#: The same by brute force, for small tables: all pairs of equally labelled vectors.
ORACLE_SQL = """with recursive v as materialized (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join link l on l.a = r.b),
least as (select a, min(b) as c from reach group by a),
links as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0) as n_links, c as component_id, vec_id = c as kept from embeddings join least on least.a = vec_id left join links on links.a = vec_id"""
