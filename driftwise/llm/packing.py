"""Best-fit packing of tokenised documents, improved by swaps between underfull bins.

Tokenising: texts are split at white space, where the tokenizer's own pattern
always splits too, and each different piece is encoded once per task and kept in
a bounded store, so a frequent word costs one look-up. Pieces with anything
unusual in them go through the tokenizer itself; plain ones through the same
merges in a byte-pair encoder. A document is its ids and then id 0; it is cut
only if longer than a sequence.

Packing: pieces are dealt to groups of about ``GROUP`` by a hash, so the work
spreads and no task holds more than a group. Within a group, pieces first go,
longest first, to the fullest bin that still takes them. Then the local search:
bins that are not full exchange one document for one, two for one, or move one,
whenever that raises the sum of squared fills, which empties the least filled
bins; the search ends when no such exchange is found in a full pass.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sliced, table

CAPACITY, GROUP, END = 2048, 3_000, 0
#: Different pieces kept per task at most.
KEPT = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids(dict):
    """White-space-free piece of text -> its ids as little-endian 32-bit words."""

    PLAIN = regex.compile(r"[\x21-\x7e¡-ɏ‐-…]+")
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast, self.name = self._merges(path)

    @staticmethod
    def _merges(path: str):
        """The tokenizer's merges as ranks of byte strings, with one byte for its end-of-word mark.

        Byte 255 never occurs in UTF-8 and stands for that mark; joining it to
        the last byte of a word comes before every merge.
        """
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
        end = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            last = token.endswith(end)
            return bytes(byte_of[c] for c in (token[: -len(end)] if last else token)) + b"\xff" * last

        ranks = {bytes([b, 255]): b for b in range(256)} | {bytes([b]): 256 + b for b in range(256)}
        name = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        for token, number in model["vocab"].items():
            if all(c in byte_of for c in token.removesuffix(end)) and raw(token) in ranks:
                name[ranks[raw(token)]] = number
        names = [int(name[k]).to_bytes(4, "little") if k in name else None for k in range(max(ranks.values()) + 1)]
        return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe, names

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        raw = self[piece] = self._encoded(piece)
        return raw

    def _encoded(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            low = piece.lower()
            if low != piece:
                return self[low]
            words = [low]
        elif self.PLAIN.fullmatch(piece) and "<|" not in piece:
            words = self.SPLIT.findall(piece.lower())
            if words != [piece]:
                return b"".join([self[w] for w in words])
        else:
            return np.array(self.whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) < 2000:
            name = self.name
            found = [name[i] for i in self.fast.encode_single_piece(piece.encode() + b"\xff")]
            if None not in found:
                return b"".join(found)
        return np.array(self.whole.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    #: Split off by str.split() but not by the tokenizer's pattern.
    ODD = regex.compile("[\x1c-\x1f]")

    def of(self, text: str) -> bytes:
        if self.ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        end = np.array([END], "<u4").tobytes()
        width = 4 * capacity
        for batch in sliced(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                raw = ids.of(text or "") + end
                for n, at in enumerate(range(0, len(raw), width)):
                    part = raw[at : at + width]
                    row.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    bins: list[list[int]] = []
    for i in order:
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            bins[b].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([i])
        if left - lengths[i]:
            insort(room, (left - lengths[i], b))
    return bins


class Partners:
    """Which bins a bin can exchange documents with, by tables of the sums that bins can give back.

    ``below[v, b]`` is the greatest sum under v of none, one or two documents of
    bin b, ``single[v, b]`` that of one document. A document of length a fits in
    place of what sums to s if a - room <= s < a, so one row of a table answers
    for all bins at once.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths = bins, lengths
        self.below = np.full((capacity + 1, len(bins)), -capacity - 1, np.int32)
        self.single = self.below.copy()
        for b in range(len(bins)):
            self.put(b)

    def put(self, b: int) -> None:
        """Takes note of what is in bin b."""
        top = len(self.below)
        own = np.array([self.lengths[i] for i in self.bins[b]], np.int64)
        different, times = np.unique(own, return_counts=True)
        at, to = np.triu_indices(len(different))
        two = (different[at] + different[to])[(at != to) | (times[at] > 1)]
        for table, sums in ((self.single, different), (self.below, np.r_[0, different, two])):
            reached = np.full(top, -top, np.int32)
            sums = sums[sums < top - 1]
            reached[sums + 1] = sums
            table[:, b] = np.maximum.accumulate(reached)

    def of(self, low: int, others: np.ndarray, room: np.ndarray) -> np.ndarray:
        """For each of ``others``, with so much room: whether some exchange with bin ``low`` fills it further."""
        own = np.array([self.lengths[i] for i in self.bins[low]], np.int64)
        different, times = np.unique(own, return_counts=True)
        at, to = np.triu_indices(len(different))
        two = np.unique((different[at] + different[to])[(at != to) | (times[at] > 1)])
        fits = np.zeros(len(others), bool)
        for a in different:
            fits |= a - self.below[a, others] <= room
        for a in two:
            fits |= a - self.single[a, others] <= room
        return fits


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves and swaps between underfull bins, each raising the sum of squared fills.

    The least filled bin gives: each of its documents moves to the fullest bin
    that takes it, or takes the place of one or two shorter documents there (which
    come back), so the other bin fills up and this one empties. An exchange
    raises the squares because the fuller bin gains what the emptier loses. It
    ends when a pass finds none, or when no packing can have fewer bins.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    fewest = -(-sum(lengths) // capacity)
    used = sum(f > 0 for f in fill)
    if used <= fewest:
        return [b for b in bins if b]
    full = [b for b, f in zip(bins, fill, strict=True) if f >= capacity]
    bins = [b for b, f in zip(bins, fill, strict=True) if 0 < f < capacity]
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    used = len(full) + len(bins)
    partners = Partners(bins, lengths, capacity)
    changed = True
    while changed and used > fewest:
        changed = False
        open_ = np.flatnonzero((fill > 0) & (fill < capacity))
        open_ = open_[np.argsort(fill[open_], kind="stable")]
        for k, low in enumerate(open_.tolist()):
            others = open_[k + 1 :][::-1]
            while len(others) and fill[low]:
                room = capacity - fill[others]
                able = np.flatnonzero(partners.of(low, others, room) & (room > 0) & (fill[others] >= fill[low]))
                if not len(able):
                    break
                other = int(others[able[0]])
                others = others[able[0] + 1 :]
                give, take = _exchange(_few(bins[low], lengths), _few(bins[other], lengths), lengths, int(capacity - fill[other]))
                gain = sum(lengths[i] for i in give) - sum(lengths[i] for i in take)
                for i in give:
                    bins[low].remove(i)
                for i in take:
                    bins[other].remove(i)
                bins[low] += take
                bins[other] += give
                fill[low] -= gain
                fill[other] += gain
                partners.put(low)
                partners.put(other)
                used -= int(fill[low] == 0)
                changed = True
    return full + [b for b in bins if b]


def _few(members: list[int], lengths: list[int]) -> list[int]:
    """At most two documents of each length: an exchange takes no more of one bin."""
    seen: dict[int, int] = {}
    out = []
    for i in members:
        seen[lengths[i]] = seen.get(lengths[i], 0) + 1
        if seen[lengths[i]] <= 2:
            out.append(i)
    return out


def _exchange(low: list[int], high: list[int], lengths: list[int], room: int):
    """The documents to give and to take back that fill ``room`` best: one for none, one for one, one for two or two for one."""
    top, best = 0, None
    back = sorted((lengths[j], j) for j in high)
    sizes = [s for s, _ in back]
    for x, i in enumerate(low):
        a = lengths[i]
        if top < a <= room:
            top, best = a, ([i], [])
        # one for one: the shortest that makes a fit leave the most
        at = bisect_left(sizes, a - room)
        if at < len(sizes) and a - sizes[at] > top:
            top, best = a - sizes[at], ([i], [back[at][1]])
        for m in range(len(back) - 1):
            at = bisect_left(sizes, a - room - sizes[m], m + 1)
            if at < len(sizes) and a - sizes[m] - sizes[at] > top:
                top, best = a - sizes[m] - sizes[at], ([i], [back[m][1], back[at][1]])
        for j in low[x + 1 :]:
            both = a + lengths[j]
            at = bisect_left(sizes, both - room)
            if at < len(sizes) and both - sizes[at] > top:
                top, best = both - sizes[at], ([i, j], [back[at][1]])
        if top == room:
            break
    return best


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    full = [[i] for i, n in enumerate(lengths) if n >= capacity]
    rest = [i for i, n in enumerate(lengths) if n < capacity]
    own = [lengths[i] for i in rest]
    return full + [[rest[i] for i in b] for b in improve(best_fit(own, capacity), own, capacity)]


def _packed(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        keys = [("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        group = group.sort_by(keys)
        lengths = group.column("length").to_pylist()
        name = group.column("bucket")[0].as_py() << 32
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = name + n, at
                at += lengths[i]
        return group.drop_columns(["bucket"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is the single id 0. Rows that repeat an id are packed
    each, equal ones too; a null id stays null. All pieces of a long document but
    the last are full. ``capacity`` and the tokenizer's path are
    parameters. An empty table gives no piece.
    """
    path = tokenizer or default_tokenizer()
    buckets = max(1, math.ceil(docs.count() / group))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long"
    pieces = texts.mapInArrow(_pieces(path, capacity), schema)
    # equal pieces (of equal rows) are counted and numbered, so that they are dealt to different buckets
    every = pieces.groupBy("id", "piece", "start", "length", "ids_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    dealt = every.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "copy"), F.lit(buckets))).drop("copies", "copy")
    return dealt.groupBy("bucket").applyInArrow(_packed(capacity), schema + ", sequence_id long, offset long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
