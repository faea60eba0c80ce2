"""MinHash near-dedup with circulant permutations (C-MinHash).

Two permutations of a universe of 2**20 slots serve all coordinates: the first
places a shingle, and coordinate k is the least value of the second one shifted
circularly by k. Since shifts of one array are contiguous windows of it, a
signature is the elementwise minimum of as many windows as there are shingles.
Rows of the signature are cut into bands; documents that share a band are
candidates, and candidates are confirmed on their full shingle sets.

Copies with equal sets are one class and only its first document goes on. The
members of a bucket of any size are compared with its first document only, and
components of the confirmed links are formed; pairs within one component need no
further look, since only components are asked for. Documents that share buckets
across components are then compared by an exact prefix filter: tokens are
ordered from the rarest, and a pair can only reach the threshold if it has a
token in common early enough in both orders. So an edited copy whose own
shingles alone rule out a link costs no comparison, no bucket is expanded into
all its pairs, no cap is set, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytes_of import mix, shingles
from .shared import Stored, connected_components, release, sliced, stored, table

SLOTS, BANDS, ROWS, SEED, SIZE = 1 << 20, 24, 6, 77, 5
#: Least similarity of a link in percent, unless a caller states another.
PERCENT = 80
#: Documents of one token that a task joins with as many others.
SQUARE = 256


class Circulant:
    """The two permutations, and signatures made with them."""

    made: dict = {}

    def __init__(self, slots: int = SLOTS, bands: int = BANDS, rows: int = ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.slots, self.bands, self.rows = slots, bands, rows
        self.place = rng.permutation(slots).astype(np.int64)
        values = rng.permutation(slots).astype(np.uint32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.r_[values, values[: bands * rows]], bands * rows)

    @classmethod
    def get(cls) -> Circulant:
        if "one" not in cls.made:
            cls.made["one"] = cls()
        return cls.made["one"]

    def signature(self, prints: np.ndarray) -> np.ndarray:
        at = self.place[(prints & np.uint64(self.slots - 1)).astype(np.int64)]
        sig = np.full(self.bands * self.rows, np.iinfo(np.uint32).max, np.uint32)
        for start in range(0, len(at), 1024):
            np.minimum(sig, self.shifted[at[start : start + 1024]].min(axis=0), out=sig)
        return sig

    def bucket_names(self, sigs: np.ndarray) -> np.ndarray:
        """(n, bands) names; the band is part of the name."""
        parts = sigs.reshape(len(sigs), self.bands, self.rows).astype(np.uint64)
        h = np.arange(self.bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(self.rows):
            h = mix(h + parts[:, :, k])
        return h


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    circulant = Circulant.get()
    for batch in sliced(batches):
        n = len(batch)
        sizes, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        sigs = np.zeros((n, circulant.bands * circulant.rows), np.uint32)
        for row, prints in shingles(batch.column("text"), SIZE):
            sizes[row] = len(prints)
            if len(prints):
                one[row], two[row] = prints.sum(), mix(prints).sum()
                sigs[row] = circulant.signature(prints)
        names = circulant.bucket_names(sigs).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * circulant.bands), pa.array(names.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("print"), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["id", "print", "n", "s1", "s2", "buckets"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of rows whose text is the one that was signed for the class."""
    for batch in sliced(batches):
        want = [np.array(batch.column(c)) for c in ("n", "s1", "s2")]
        rows, found = [], []
        for row, prints in shingles(batch.column("text"), SIZE):
            sums = np.array([prints.sum(), mix(prints).sum()], np.uint64).view(np.int64)
            if len(prints) == want[0][row] and sums[0] == want[1][row] and sums[1] == want[2][row]:
                rows.append(row)
                found.append(prints)
        offsets = np.r_[0, np.cumsum([len(p) for p in found])].astype(np.int32)
        flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "prints"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            a, b = batch.column("pa"), batch.column("pb")
            fa, fb = (np.array(c.flatten()) for c in (a, b))
            oa, ob = (np.r_[0, np.cumsum(np.array(c.value_lengths()))].astype(int) for c in (a, b))
            keep = np.zeros(len(batch), bool)
            for row in range(len(batch)):
                x, y = fa[oa[row] : oa[row + 1]], fb[ob[row] : ob[row + 1]]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[row] = 100 * common >= percent * (len(both) - common)
            chosen = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([chosen.column("a"), chosen.column("b")], names=["a", "b"])

    return run


def prefix_pairs(docs: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b of different components that an exact prefix filter can't rule out, of (id, c, prints).

    A link needs an overlap of at least percent / (100 + percent) of both sizes
    together. With both sets in one order, it is at most what follows the first
    common token in either set, that token included; so pairs meet on tokens
    among the first that leave enough behind, and on tokens alone of which more
    than one document has any. Of each token, the commonest component is left
    out on one side, so a large component is never joined with itself. A token
    of more than ``SQUARE`` documents is joined in squares of about so many by
    so many, each a key of its own, so that no task gets all of them.
    """
    tokens = docs.select("id", "c", F.explode("prints").alias("t"))
    often = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(often, "t").groupBy("id", "c").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("all"))
    n = F.size("all")
    # the shortest partner allowed needs the least overlap: percent % of the own size
    reach = n - F.ceil(n * percent / 100) + 1
    early = ranked.select("id", "c", n.cast("long").alias("n"), F.posexplode(F.slice("all", 1, reach.cast("int"))).alias("p", "x")).select("id", "c", "n", "p", "x.t", "x.df").where("df > 1").drop("df")
    early = stored(early)
    shares = early.groupBy("t", "c").agg(F.count(F.lit(1)).alias("k"))
    most = stored(shares.groupBy("t").agg(F.max_by("c", "k").alias("most"), F.count(F.lit(1)).alias("comps"), F.ceil(F.sum("k") / SQUARE).cast("int").alias("parts")).where("comps > 1").select("t", "most", "parts"))
    dealt = stored(early.join(most, "t").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    squares = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = dealt.where("c <> most").select("t", F.col("own").alias("i"), squares.alias("j"), F.col("id").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.col("p").alias("px"))
    two = dealt.select("t", squares.alias("i"), F.col("own").alias("j"), F.col("id").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ny"), F.col("p").alias("py"))
    enough = F.expr(f"(100 + {percent}) * least(nx - px, ny - py) >= {percent} * (nx + ny) and cx <> cy")
    return one.join(two, ["t", "i", "j"]).where(enough).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


SIGNED = "id long, print long, n long, s1 long, s2 long, buckets array<long>"


def near_groups(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, print (a hash of the text), n_shingles, component, group of every row.

    Texts are linked when 100 * |A and B| >= ``percent`` * |A or B| on their sets
    of distinct 5-word shingles. component is the smallest id of a row whose text
    can be reached by links, the row's own included; group is a name that two
    groups never share, even if they share that id. Every row is judged by its
    own text: rows that repeat an id are rows each, and their texts need not be
    in one group. Null, empty and blank texts have empty sets and link with
    nothing. Rows without an id link with nothing and have a null component.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    signed = stored(texts.withColumn("print", F.xxhash64("text")).mapInArrow(_signed, SIGNED))
    full = signed.where("id is not null and n > 0")
    sums = ["n", "s1", "s2"]
    # one row per different set; where ids repeat, sets with the same smallest id get names of their own
    first = full.groupBy(*sums).agg(F.min("id").alias("rep"), F.first("buckets").alias("buckets"))
    turn = F.row_number().over(Window.partitionBy("rep").orderBy(*sums))
    other = F.lit(-(1 << 62)) - F.pmod(F.xxhash64(*sums), F.lit(1 << 62))
    classes = stored(first.withColumn("key", F.when(turn == 1, F.col("rep")).otherwise(other)))
    reps = classes.select(F.col("key").alias("id"), F.explode("buckets").alias("bucket"))
    met = reps.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    in_buckets = stored(reps.join(met, "bucket").select("bucket", "id"))
    wanted = classes.join(in_buckets.select(F.col("id").alias("key")).distinct(), "key").select("key", F.col("rep").alias("id"), *sums)
    sets = Stored(texts.join(wanted, "id").select("key", *sums, "text").mapInArrow(_sets, "id long, prints array<long>").dropDuplicates(["id"]))
    release(spark)

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(sets.df.select(F.col("id").alias("a"), F.col("prints").alias("pa")), "a")
        with_b = with_a.join(sets.df.select(F.col("id").alias("b"), F.col("prints").alias("pb")), "b")
        return with_b.select("a", "b", "pa", "pb").mapInArrow(_confirm(percent), "a long, b long")

    first_of = in_buckets.groupBy("bucket").agg(F.min("id").alias("a"))
    pairs = in_buckets.select("bucket", F.col("id").alias("b")).join(first_of, "bucket").where("a <> b").select("a", "b").distinct()
    links = stored(confirmed(pairs))
    component = connected_components(links)
    # documents in buckets that hold more than one component still
    state = in_buckets.select("bucket", "id").join(component, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    mixed = state.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    left = stored(state.join(mixed, "bucket").select("id", "c").distinct())
    more = stored(confirmed(prefix_pairs(left.join(sets.df, "id"), percent)))
    if not more.isEmpty():
        links = links.unionByName(more)
        component = connected_components(links)
    sets.drop()
    release(spark)
    root = classes.select(*sums, "rep", "key").join(component.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("component", "key"))
    least = root.groupBy("root").agg(F.min("rep").alias("least"))
    named = root.join(least, "root").select(*sums, "least", "root")
    rows = signed.select("id", "print", *sums).join(named, sums, "left")
    own = F.col("id").isNotNull()
    return rows.select("id", "print", F.col("n").alias("n_shingles"), F.when(own, F.coalesce("least", "id")).alias("component"), F.when(own, F.col("root")).alias("group"))


def keep_one(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of every group: with the smallest id, and of several texts of that id the one with the smallest hash.

    Of rows that repeat that id and text, one stays. A text that no other reaches
    stays whatever else its id has; rows without an id and with a blank text stay.
    """
    groups = stored(near_groups(docs, percent, id_col, text).where("id is not null and n_shingles > 0"))
    at = groups.groupBy("id", "print", "group").agg(F.count(F.lit(1)).alias("rows"))
    chosen = at.groupBy("group").agg(F.min(F.struct("id", "print")).alias("first"))
    judged = stored(at.join(chosen, "group").select(F.col("id").alias("_id"), F.col("print").alias("_print"), "rows", F.expr("first.id = id and first.print = print").alias("stays")))
    same = lambda t: (docs[id_col].cast("long") == t["_id"]) & (F.xxhash64(docs[text]) == t["_print"])
    gone, several = judged.where("not stays"), judged.where("stays and rows > 1")
    kept = docs.join(gone, same(gone), "left_anti")
    if several.isEmpty():
        return kept
    one = docs.join(several, same(several)).dropDuplicates(["_id", "_print"]).select(*docs.columns)
    return kept.join(several, same(several), "left_anti").unionByName(one)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; both last are null without an id."""
    groups = near_groups(table(spark, sf_dir, "documents"), percent=85)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


#: The same by brute force, for small tables: all pairs of documents that share a shingle.
ORACLE_SQL = r"""with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as materialized (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
size as materialized (select doc_id, count(s) as n from w left join sh using (doc_id) group by doc_id),
link as materialized (select a.doc_id as a, b.doc_id as b from sh a join sh b using (s) join size x on x.doc_id = a.doc_id join size y on y.doc_id = b.doc_id
  where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join link l on l.a = r.b),
least as (select a, min(b) as c from reach group by a)
select doc_id, n as n_shingles, c as component_id, doc_id = c as kept from size join least on a = doc_id"""
