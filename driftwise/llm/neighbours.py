"""Approximate nearest neighbours by a forest of random-projection trees.

Every tree halves the vectors level by level at the median of a random
projection, down to leaves of about ``LEAF`` rows, however many rows there are.
Directions come from the seed; medians are fitted on a bounded sample
(``SAMPLE`` rows) as deep as it goes and are 0 below, so what is sent to the
tasks doesn't grow with the table; every row is indexed. A query walks all trees
with one shared priority queue: it holds branches of every tree, keyed by the
sum of squared distances to the cutting planes that were crossed, and yields
leaves, nearest first, until they hold the stated share of the rows. The
candidates of these leaves are then reranked by exact cosine in double precision.

Unless a share is given, it is fitted on the sample: the one at which a forest
over the sample finds ``RECALL`` of the true neighbours of ``TRIED`` of its rows.
So vectors with structure are searched in few leaves, while vectors without any
need most of them for such a recall.

Vectors with very many exact copies can't be split, so a vector is indexed once
with its smallest ``k + 1`` ids, which is all that a list of k can need. Rows are
dealt out by the first bits of their leaf, ``GROUP_BITS`` or as many as leave
about ``HELD`` rows; a query is sent where it has leaves to look into, is held
against these leaves only, and gets at most k rows back from each task. Groups
that hold more rows or more queries than a task takes are cut into parts, every
part of the one meeting every part of the other.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .embedding_dedup import _matrix, sized, usable
from .shared import Stored, sliced, stored, table

TREES, LEAF, SAMPLE, SEED = 4, 128, 20_000, 4242
#: Share of true neighbours to be found, and rows of the sample that are tried, when the share of rows to look among is fitted.
RECALL, TRIED = 0.97, 200
#: Most index rows and most queries that one task holds at once.
HELD, ASKED, BLOCK = 20_000, 5_000, 256
GROUP_BITS = 6
#: Rows of a table of oversized groups that are broadcast at most.
SMALL = 50_000


class Forest:
    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int | None = None, seed: int = SEED):
        self.width = sample.shape[1]
        self.trees, self.seed = trees, seed
        self.depth = max(0, math.ceil(math.log2(max(1, rows / (leaf or LEAF)))))
        # levels whose medians the sample can tell; below, a cut is at 0
        self.fitted = min(self.depth, max(0, math.ceil(math.log2(max(1, len(sample) / 8)))))
        self.cuts = []
        for t in range(trees):
            d, at, cuts = self.directions(t), np.zeros(len(sample), np.int64), np.zeros(2**self.fitted)
            p = sample @ d.T
            for level in range(self.fitted):
                first = 2**level
                for node in range(first):
                    own = p[at == node, level]
                    cuts[first + node] = np.median(own) if len(own) else 0.0
                at = 2 * at + (p[:, level] > cuts[first + at])
            self.cuts.append(cuts)

    def directions(self, t: int) -> np.ndarray:
        """One unit direction per level of tree ``t``."""
        d = np.random.default_rng([self.seed, t]).standard_normal((max(1, self.depth), self.width))
        return d / np.linalg.norm(d, axis=1)[:, None]

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros((len(unit), self.trees), np.int64)
        for t in range(self.trees):
            p = unit @ self.directions(t).T
            for level in range(self.depth):
                cut = self.cuts[t][2**level + out[:, t]] if level < self.fitted else 0.0
                out[:, t] = 2 * out[:, t] + (p[:, level] > cut)
        return out

    def search(self, unit: np.ndarray, share: float) -> Iterator[tuple[int, int, int]]:
        """(query, tree, leaf) of the leaves that a shared queue yields first."""
        p = [unit @ self.directions(t).T for t in range(self.trees)]
        wanted = max(self.trees, math.ceil(share * 2**self.depth))
        for q in range(len(unit)):
            queue = [(0.0, t, 0, 0) for t in range(self.trees)]
            got = 0
            while queue and got < wanted:
                cost, t, level, node = heapq.heappop(queue)
                while level < self.depth:
                    gap = p[t][q, level] - (self.cuts[t][2**level + node] if level < self.fitted else 0.0)
                    side = int(gap > 0)
                    heapq.heappush(queue, (cost + gap * gap, t, level + 1, 2 * node + 1 - side))
                    level, node = level + 1, 2 * node + side
                got += 1
                yield q, t, node


def fitted_share(sample: np.ndarray, k: int, recall: float = RECALL, tried: int = TRIED) -> float:
    """The share of the rows among which a forest over ``sample`` (unit vectors, no two equal) finds ``recall`` of the true k nearest."""
    forest = Forest(sample, len(sample))
    leaves = forest.leaves(sample)
    asked = np.linspace(0, len(sample) - 1, min(tried, len(sample))).astype(int)
    needed = []
    for q in asked:
        cos = sample @ sample[q]
        cos[q] = -np.inf
        true = np.argsort(-cos)[: min(k, len(sample) - 1)]
        first = {(t, leaf): n for n, (_, t, leaf) in enumerate(forest.search(sample[q : q + 1], forest.trees), 1)}
        needed += [min(first[t, leaves[i, t]] for t in range(forest.trees)) for i in true]
    return float(np.quantile(needed, recall, method="higher")) / 2**forest.depth if needed else float(forest.trees)


FOUND = ["tree", "grp", "leaf", "ids", "v", "salt"]
FOUND_SCHEMA = "tree int, grp long, leaf long, ids array<long>, v array<double>, salt long"
ASK = ["tree", "grp", "leaves", "q", "salt"]
ASK_SCHEMA = "tree int, grp long, leaves array<long>, q long, salt long"


def _index(forest: Forest, bits: int):
    """The indexed vectors under tree and group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            batch = batch.filter(pa.array(np.array(batch.column("width")) == forest.width))
            if not len(batch):
                continue
            x = sized(_matrix(batch.column("v")))
            leaf = forest.leaves(x / np.linalg.norm(x, axis=1)[:, None]).reshape(-1)
            at = pa.array(np.repeat(np.arange(len(x)), forest.trees))
            trees = pa.array(np.tile(np.arange(forest.trees, dtype=np.int32), len(x)))
            yield pa.RecordBatch.from_arrays([trees, pa.array(leaf >> (forest.depth - bits)), pa.array(leaf), *(batch.column(c).take(at) for c in ("ids", "v", "salt"))], names=FOUND)

    return run


def _ask(forest: Forest, share: float, bits: int):
    """The queries under every tree and group in which they have leaves to look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            batch = batch.filter(pa.array(np.array(batch.column("width")) == forest.width))
            if not len(batch):
                continue
            x = sized(_matrix(batch.column("v")))
            q, t, leaf = (np.array(c) for c in zip(*forest.search(x / np.linalg.norm(x, axis=1)[:, None], share), strict=True))
            grp = leaf >> (forest.depth - bits)
            order = np.lexsort((leaf, grp, t, q))
            q, t, leaf, grp = q[order], t[order], leaf[order], grp[order]
            first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (t[1:] != t[:-1]) | (grp[1:] != grp[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(leaf)].astype(np.int32)), pa.array(leaf.astype(np.int64)))
            rows = pa.array(q[first])
            yield pa.RecordBatch.from_arrays([pa.array(t[first].astype(np.int32)), pa.array(grp[first].astype(np.int64)), lists, batch.column("id").take(rows), batch.column("salt").take(rows)], names=ASK)

    return run


def _top(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of every query, ties to the smaller id."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    keep = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < k
    return q[keep], v[keep], s[keep]


def _nearest_in(q: np.ndarray, w: np.ndarray, v: np.ndarray, flat: np.ndarray, offsets: np.ndarray, k: int):
    """For queries ``q`` with vectors ``w``: the k nearest ids of the vectors ``v``, whose ids are flat[offsets[i] : offsets[i + 1]]."""
    vv, ww = np.einsum("ij,ij->i", v, v), np.einsum("ij,ij->i", w, w)
    most = min(len(v), k + 1)
    for start in range(0, len(w), BLOCK):
        own = slice(start, start + BLOCK)
        cos = (w[own] @ v.T) / np.sqrt(ww[own][:, None] * vv)
        # all within rounding of the (k + 1)-th best, since one of those may be the query itself
        low = np.partition(cos, len(v) - most, axis=1)[:, len(v) - most] - 1e-9
        row, col = np.nonzero(cos >= low[:, None])
        exact = np.einsum("ij,ij->i", w[own][row], v[col]) / np.sqrt(ww[own][row] * vv[col])
        count = offsets[col + 1] - offsets[col]
        at = np.repeat(offsets[col] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        q_, v_, s_ = np.repeat(q[own][row], count), flat[at], np.repeat(exact, count)
        other = q_ != v_
        yield _top(q_[other], v_[other], s_[other], k)


def _rerank(k: int):
    def run(group: pa.Table) -> pa.Table:
        is_query = np.array(group.column("q").is_valid())
        index, asks = group.filter(pa.array(~is_query)).combine_chunks(), group.filter(pa.array(is_query)).combine_chunks()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(index) and len(asks):
            index = index.take(pa.array(np.argsort(np.array(index.column("leaf")), kind="stable"))).combine_chunks()
            v, w, leaf, q = sized(_matrix(index.column("v"))), sized(_matrix(asks.column("v"))), np.array(index.column("leaf")), np.array(asks.column("q"))
            ids = index.column("ids").combine_chunks()
            flat, offsets = np.array(ids.flatten()), np.r_[0, np.cumsum(np.array(ids.value_lengths()))]
            wanted = asks.column("leaves").combine_chunks()
            wants, who = np.array(wanted.flatten()), np.repeat(np.arange(len(q)), np.array(wanted.value_lengths()))
            order = np.argsort(wants, kind="stable")
            wants, who = wants[order], who[order]
            for one in np.unique(leaf):
                a, b = np.searchsorted(leaf, [one, one + 1])
                some = who[slice(*np.searchsorted(wants, [one, one + 1]))]
                if len(some):
                    found += _nearest_in(q[some], w[some], v[a:b], flat, offsets[a : b + 1], k)
        q_, v_, s_ = _top(*(np.concatenate(c) for c in zip(*found, strict=True)), k) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(q_, pa.int64()), "vec_id": pa.array(v_, pa.int64()), "score": pa.array(s_, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, share: float | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row for which ``is_query`` holds.

    ``share`` is the part of the rows, counted in every tree, among which a query
    looks; as many as there are trees is an exact search, and None fits it on the
    sample. Rows with a null id or an unusable vector take no part; vectors of
    different widths are searched apart from one another. Rows that repeat an id
    with the same vector count once. Fewer candidates than k give fewer rows,
    and an empty table gives none. Other columns are not read.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(vector, None) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"), is_query.alias("ask")
    )
    # the row_number limit is applied in each task before the rows are dealt out, so copies of one vector stay few
    copies = Window.partitionBy("v").orderBy("id")
    first = good.select("id", "v").withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    salt = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    rows = stored(first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids", "v", F.size("v").alias("width"), salt.alias("salt")))
    queries = good.where("ask").select("id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt"))
    parts = [_of_width(rows, queries, int(r["width"]), r["n"], k, share) for r in rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy("width").collect()]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = reduce(DataFrame.unionByName, parts)
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _of_width(rows: DataFrame, queries: DataFrame, width: int, n: int, k: int, share: float | None) -> DataFrame:
    """query_id, vec_id, score: at most k rows a query and task, among the ``n`` different vectors of one width."""
    rows, queries = rows.where(F.col("width") == width), queries.where(F.col("width") == width)
    sample = rows.select("v").orderBy("salt", "v").limit(SAMPLE).toArrow()
    x = sized(_matrix(sample.column("v"))).copy()
    x /= np.linalg.norm(x, axis=1)[:, None]
    forest = Forest(x, n)
    share = fitted_share(x, k) if share is None else share
    bits = min(forest.depth, max(GROUP_BITS, math.ceil(math.log2(max(1, n / HELD)))))
    index = rows.mapInArrow(_index(forest, bits), FOUND_SCHEMA)
    asks = stored(queries.mapInArrow(_ask(forest, share, bits), ASK_SCHEMA))
    # groups of more rows or queries than a task takes
    held = index.groupBy("tree", "grp").agg(F.ceil(F.count(F.lit(1)) / HELD).alias("parts"), F.lit(1).cast("long").alias("turns"))
    asked = asks.groupBy("tree", "grp").agg(F.lit(1).cast("long").alias("parts"), F.ceil(F.count(F.lit(1)) / ASKED).alias("turns"))
    sizes = held.unionByName(asked).groupBy("tree", "grp").agg(F.max("parts").alias("parts"), F.max("turns").alias("turns")).where("parts > 1 or turns > 1")
    large = Stored(sizes, n=F.count(F.lit(1)))
    if large.seen["n"]:
        wide = F.broadcast(large.df) if large.seen["n"] <= SMALL else large.df
        cut = lambda df, own, other, a, b: (
            df.join(wide, ["tree", "grp"], "left").withColumns({a: F.pmod("salt", F.coalesce(own, F.lit(1))), b: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))})
        )
        index, asks = cut(index, "parts", "turns", "part", "turn"), cut(asks, "turns", "parts", "turn", "part")
    else:
        zero = {"part": F.lit(0).cast("long"), "turn": F.lit(0).cast("long")}
        index, asks = index.withColumns(zero), asks.withColumns(zero)
    keys = ["tree", "grp", "part", "turn"]
    asks = asks.select(*keys, "leaves", "q").join(queries.select(F.col("id").alias("q"), "v").dropDuplicates(["q", "v"]), "q")
    both = index.select(*keys, "leaf", "ids", "v").unionByName(asks.select(*keys, "leaves", "q", "v"), allowMissingColumns=True)
    return both.groupBy(*keys).applyInArrow(_rerank(k), "query_id long, vec_id long, score double")


def op4_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every vector whose vec_id is divisible by 50, against all other rows."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
