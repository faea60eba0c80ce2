"""Removal of repeated passages with longest-previous-factor arrays over suffixes.

A byte goes if it lies in a ``LENGTH``-byte string that also starts in a
document with a smaller id. Only suffixes that can match are ever sorted:

1. Every window of ``LENGTH`` bytes is named after the least fingerprint among
   its ``GRAM``-byte substrings (its anchor). Equal windows have equal anchors,
   and consecutive windows mostly share theirs, so a document has an anchor
   about every 16 bytes. Anchors found in one document only are dropped after a
   partially aggregated minimum and maximum of ids per anchor.
2. A stretch is the run of a document's windows with one anchor. Stretches equal
   to one of an earlier document are repeats as a whole (a second partially
   aggregated minimum). Of each different stretch the first copy remains;
   what is found in it holds for the copies in its own document, too.
3. The remaining stretches of an anchor differ. Their bytes are fetched and
   dealt out by anchor, where suffixes at the windows' starts are sorted.
   Suffixes that share their first bytes with none (by fingerprint) are left out.
   With adjacent longest common prefixes, the nearest suffixes before and after
   in that order with a smaller document id give each suffix its longest previous factor;
   it is a repeat where that reaches ``LENGTH``. Anchors with more than ``CROWD``
   different stretches are left to an exact aggregation by whole window instead,
   which spreads over all tasks.

Nothing is capped; matches never cross documents; strings are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_of import POWERS, _M, chunks, mix, prefix
from .shared import Stored, release, sliced, table

LENGTH, GRAM, CROWD, DEALT = 50, 20, 4_000, 20_000
SPAN = LENGTH - GRAM + 1
#: Bytes worked on at once; longer documents are cut into pieces that overlap by LENGTH - 1 bytes.
PIECE = 1 << 18
_LOW = np.uint64((1 << 24) - 1)


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before the piece, bytes, offsets): whole documents, or a piece of a long one."""
    for first, end, data, offsets in chunks(texts, PIECE):
        if end - first == 1 and len(data) > 4 * PIECE:
            for start in range(0, len(data) - LENGTH + 1, 4 * PIECE):
                part = data[start : start + 4 * PIECE + LENGTH - 1]
                yield first, start, part, np.array([0, len(part)])
        else:
            yield first, 0, data, offsets


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, windows, anchor, print) of every run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = prefix(data)
    h = mix((p[GRAM:] - p[:-GRAM]) * POWERS.down[: len(p) - GRAM])
    k = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    two = np.minimum(k[:-1], k[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    sixteen = np.minimum(eight[:-8], eight[8:])
    least = (np.minimum(sixteen[: len(k) - SPAN + 1], sixteen[SPAN - 16 : len(k) - SPAN + 1 + SPAN - 16]) & _LOW).astype(np.int64)
    # windows that start less than LENGTH before their document's end don't fit it
    size = np.diff(offsets)
    fits = np.ones(len(data) + 1, bool)
    fits[_ranges(np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), np.minimum(size, LENGTH - 1))] = False
    fits = fits[: len(least)]
    new = fits.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~fits[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    document = np.searchsorted(offsets, start, "right") - 1
    count = np.minimum(np.r_[start[1:], len(data)], offsets[document + 1] - LENGTH + 1) - start
    return document, start, count, h[least[start]], prints(p, start, count + LENGTH - 1)


def prints(p: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix((p[start + size] - p[start]) * POWERS.down[start] + size.astype(np.uint64) * _M)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        ids = np.array(batch.column("id"))
        for first, _, data, offsets in _pieces(batch.column("text")):
            document, _, _, anchor, _ = stretches(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[first + document])], names=["anchor", "id"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        ids = np.array(batch.column("id"))
        for first, before, data, offsets in _pieces(batch.column("text")):
            document, start, count, anchor, own = stretches(data, offsets)
            at = (start - offsets[document] + before) * 64 + count
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[first + document]), pa.array(at), pa.array(own.view(np.int64))], names=["anchor", "id", "at", "own"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary or string column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of [start, start + size) for each pair, in turn."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _binary(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat[_ranges(start, size)].tobytes())])


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        flat, offsets = _flat(batch.column("text").fill_null(""))
        runs = batch.column("runs")
        row = np.repeat(np.arange(len(batch)), np.array(runs.value_lengths().fill_null(0)))
        at = np.array(runs.flatten().field("at"))
        start, size = at // 64 + offsets[row], at % 64 + LENGTH - 1
        fits = pa.array(start + size <= offsets[row + 1])
        keep = np.array(fits)
        found = runs.flatten().filter(fits)
        yield pa.RecordBatch.from_arrays(
            [found.field("anchor"), batch.column("id").take(pa.array(row[keep])), found.field("at"), found.field("crowd"), _binary(flat, start[keep], size[keep])],
            names=["anchor", "id", "at", "crowd", "raw"],
        )


def suffix_order(flat: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The suffixes of ``flat`` at ``starts`` in the order of their first ``length`` bytes."""
    wide = -(-length // 8) * 8
    padded = np.r_[flat, np.zeros(wide, np.uint8)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[starts].copy()
    rows[:, length:] = 0
    keys = np.ascontiguousarray(rows).view(">u8")
    return np.lexsort(tuple(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)))


def adjacent_lcp(flat: np.ndarray, sorted_starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Longest common prefix (up to ``length``) of each suffix with the one before it; 0 for the first."""
    out = np.zeros(len(sorted_starts), np.int64)
    padded = np.r_[flat, np.zeros(length, np.uint8)]
    view = np.lib.stride_tricks.sliding_window_view(padded, length)
    for a in range(1, len(sorted_starts), 1 << 15):
        b = min(len(sorted_starts), a + (1 << 15))
        differ = view[sorted_starts[a:b]] != view[sorted_starts[a - 1 : b - 1]]
        out[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    return out


def longest_previous_factor(lcp: np.ndarray, rank: np.ndarray, least: int = 1) -> np.ndarray:
    """For suffixes in order: their longest common prefix with any suffix of strictly smaller rank, 0 if under ``least``.

    That is reached by the nearest such suffix before or after in the order.
    Both are found for all suffixes at once by jumping pointers: a suffix points
    to the one beside it, and as long as that has no smaller rank, to where that
    one points, while the least common prefix on the way is kept.
    """
    best = np.zeros(len(rank), np.int64)
    if not len(rank):
        return best
    for way in (1, -1):
        r = rank[::way]
        # common prefix with the suffix passed just before, in this direction
        common = np.r_[0, lcp[1:]] if way == 1 else np.r_[0, lcp[:0:-1]]
        to = np.arange(len(r)) - 1
        live = np.flatnonzero(common >= least)
        live = live[r[to[live]] >= r[live]]
        while len(live):
            at = to[live]
            common[live], to[live] = np.minimum(common[live], common[at]), to[at]
            live = live[common[live] >= least]
            live = live[r[to[live]] >= r[live]]
        best = np.maximum(best, np.where(common >= least, common, 0)[::way])
    return best


def repeats(flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of the stretches flat[offsets[k] : offsets[k + 1]]: its stretch, its start in ``flat``, and whether it occurs under a smaller id."""
    count = np.maximum(0, np.diff(offsets) - length + 1)
    of = np.repeat(np.arange(len(count)), count)
    starts = _ranges(offsets[:-1], count)
    # suffixes whose first ``length`` bytes have a fingerprint of their own have no match and need no place in the order
    own = prints(prefix(flat), starts, np.full(len(starts), length))
    by = np.argsort(own)
    same = own[by[1:]] == own[by[:-1]]
    near = np.sort(by[np.r_[same, False] | np.r_[False, same]]) if len(by) else by
    near = near[suffix_order(flat, starts[near], length)]
    lpf = longest_previous_factor(adjacent_lcp(flat, starts[near], length), ids[of[near]], length)
    hit = np.zeros(len(starts), bool)
    hit[near] = lpf >= length
    return of, starts, hit


def _lpf(group: pa.Table) -> pa.Table:
    anchor, ids, at = (np.array(group.column(c)) for c in ("anchor", "id", "at"))
    flat, offsets = _flat(group.column("raw"))
    of, starts, hit = repeats(flat, offsets, ids)
    of, starts = of[hit], starts[hit]
    # runs of consecutive windows of one stretch
    new = np.r_[True, (np.diff(starts) != 1) | (np.diff(of) != 0)] if len(of) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(of)]) + LENGTH - 1
    k, begin = of[first], starts[first]
    own = prints(prefix(flat), begin, size).view(np.int64)
    return pa.table({"anchor": pa.array(anchor[k]), "id": pa.array(ids[k]), "at": pa.array(at[k]), "start": pa.array(at[k] // 64 + begin - offsets[k]), "size": pa.array(size.astype(np.int64)), "own": pa.array(own)})


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for a in range(0, len(batch), 4096):
            some = batch.slice(a, 4096)
            anchor, ids, at = (np.array(some.column(c)) for c in ("anchor", "id", "at"))
            flat, offsets = _flat(some.column("raw"))
            count = np.maximum(0, np.diff(offsets) - LENGTH + 1)
            of, starts = np.repeat(np.arange(len(count)), count), _ranges(offsets[:-1], count)
            size = np.full(len(starts), LENGTH)
            own = prints(prefix(flat), starts, size).view(np.int64)
            columns = [_binary(flat, starts, size), pa.array(anchor[of]), pa.array(ids[of]), pa.array(at[of]), pa.array(at[of] // 64 + starts - offsets[of]), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, names=["w", "anchor", "id", "at", "start", "own"])


def _covered(text: bytes, found: pa.Scalar) -> np.ndarray:
    """Which bytes of a text lie in the spans found that hold what they were found with."""
    gone = np.zeros(len(text) + 1, np.int32)
    if found.is_valid and len(found.values):
        s, n, own = (np.array(found.values.field(c)) for c in ("start", "size", "own"))
        inside = s + n <= len(text)
        s, n, own = s[inside], n[inside], own[inside]
        true = prints(prefix(np.frombuffer(text, np.uint8)), s, n).view(np.int64) == own
        np.add.at(gone, s[true], 1)
        np.add.at(gone, (s + n)[true], -1)
    return np.cumsum(gone)[:-1] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = batch.column("text").cast(pa.large_binary())
        out: list[tuple] = []
        for row in range(len(batch)):
            text = texts[row].as_py() or b""
            covered = _covered(text, batch.column("spans")[row])
            edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
            kept = np.frombuffer(text, np.uint8)[~covered].tobytes() if len(edges) else text
            out.append((len(text), int(covered.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept, edges.tolist()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "edges"])


def _stripped(names: list[str], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(names[at]).cast(pa.large_binary())
            spans = batch.column("_spans")
            out = []
            for row in range(len(batch)):
                text = texts[row].as_py()
                if text is not None and spans[row].is_valid:
                    text = np.frombuffer(text, np.uint8)[~_covered(text, spans[row])].tobytes()
                out.append(text.decode("utf-8", "ignore") if text is not None else None)
            columns = [pa.array(out, pa.string()) if k == at else batch.column(n) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(id, start, size, own) of stretches to remove, of a table (id, text) without null ids."""
    anchors = texts.mapInArrow(_anchors, "anchor long, id long")
    both = anchors.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared = Stored(both.where("lo < hi").select("anchor"))
    release(texts.sparkSession)
    runs = texts.mapInArrow(_runs, "anchor long, id long, at long, own long")
    hits = Stored(runs.join(shared.df, "anchor"))
    shared.drop()
    release(texts.sparkSession)
    firsts = Stored(hits.df.groupBy("anchor", "own").agg(F.min(F.struct("id", "at")).alias("f")))
    first = firsts.df.select("anchor", "own", F.col("f.id").alias("lo"), F.col("f.at").alias("first"))
    # repeats of an earlier document's stretch; with anchor and first place, those of a stretch of the same document
    copies = hits.df.join(first, ["anchor", "own"]).where("id > lo or at <> first")
    copies = Stored(copies.select("id", "at", "own", F.expr("case when id = lo then anchor end as anchor"), F.expr("case when id = lo then first end as first")).distinct())
    hits.drop()
    many = firsts.df.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    left = firsts.df.join(many, "anchor").select("anchor", F.col("f.id").alias("id"), F.struct(F.col("f.at").alias("at"), "anchor", (F.col("m") > CROWD).alias("crowd")).alias("run"))
    per = left.groupBy("id").agg(F.collect_list("run").alias("runs"))
    pieces = Stored(texts.join(per, "id").select("id", "text", "runs").mapInArrow(_bytes, "anchor long, id long, at long, crowd boolean, raw binary"))
    firsts.drop()
    release(texts.sparkSession)
    n = pieces.df.count()
    buckets = max(1, -(-n // DEALT))
    dealt = pieces.df.where("not crowd").select(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"), "anchor", "id", "at", "raw")
    parts = dealt.groupBy("bucket").applyInArrow(_lpf, "anchor long, id long, at long, start long, size long, own long")
    windows = pieces.df.where("crowd").select("anchor", "id", "at", "raw").mapInArrow(_windows, "w binary, anchor long, id long, at long, start long, own long")
    lows = windows.groupBy("w").agg(F.min("id").alias("lo"))
    crowded = windows.join(lows, "w").where("id > lo").select("anchor", "id", "at", "start", F.lit(LENGTH).cast("long").alias("size"), "own")
    found = Stored(parts.unionByName(crowded))
    pieces.drop()
    release(texts.sparkSession)
    again = copies.df.where("anchor is not null").select("anchor", "id", F.col("first").alias("at"), F.expr("at div 64 - first div 64").alias("shift")).distinct()
    moved = found.df.join(again, ["anchor", "id", "at"]).select("id", (F.col("start") + F.col("shift")).alias("start"), "size", "own")
    whole = copies.df.where("anchor is null").select("id", F.expr("at div 64").alias("start"), F.expr(f"at % 64 + {LENGTH - 1}").alias("size"), "own")
    return whole.unionByName(found.df.select("id", "start", "size", "own")).unionByName(moved)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes), edges.

    edges: start and end of each removed run, in turn. A null text counts as
    empty; texts under ``LENGTH`` bytes lose nothing; rows without an id lose
    nothing and are no source. Rows that share an id never match one another,
    and each is judged by its own text. Other columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    spans = repeated_spans(texts.where("id is not null"))
    per = spans.groupBy("id").agg(F.collect_set(F.struct("start", "size", "own")).alias("spans"))
    return texts.join(per, "id", "left").select("id", "text", "spans").mapInArrow(
        _cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, edges array<long>"
    )


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from its texts; a character that loses a byte goes whole.

    All rows and columns stay, n_chars (if there) is counted anew, and a null
    text stays null.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    per = repeated_spans(source).groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("start", "size", "own")).alias("_spans"))
    joined = docs.join(per, docs[id_col].cast("long") == per["_id"], "left").select(*docs.columns, "_spans")
    out = joined.mapInArrow(_stripped(docs.columns, docs.columns.index(text)), docs.schema)
    return out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = cut_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same by brute force, for small tables: every 50-byte string of every document, as text in hexadecimal digits.
ORACLE_SQL = f"""with b as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
w as materialized (select doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) as s from (select doc_id, h, unnest(range(n - {LENGTH - 1})) as i from b)),
hit as (select w.doc_id, w.i from w join (select s, min(doc_id) as lo from w group by s) using (s) where lo < w.doc_id),
run as (select doc_id, i, sum(new) over (partition by doc_id order by i) as r from (select *, case when i - lag(i) over (partition by doc_id order by i) <= {LENGTH} then 0 else 1 end as new from hit)),
span as (select doc_id, min(i) as a, max(i) + {LENGTH} as z from run group by doc_id, r),
kept as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as y from span),
cut as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' order by a) || max(substr(h, 2 * last + 1)) as rest
  from (select k.*, b.h, max(z) over (partition by doc_id) as last from kept k join b using (doc_id)) group by doc_id)
select b.doc_id, b.n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256 from b left join cut using (doc_id)"""
