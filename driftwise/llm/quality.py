"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are shares of its bytes and words, of
its own and of the lines beside it; the field adds weights for two
lines in a row being both good or both bad. Forward and backward messages of a
two-state chain are log-odds, so a batch of documents is one vector per step.
The marginals, weighted by the lines' lengths, give a document's quality, and a
logistic map fitted on the training documents turns it into the score.

Labels are known of documents only. Every line of a good one counts as good; a
bad one may hold good lines, so its lines' labels are latent. They are found in
turns: a model without links between lines first tells which lines of bad
documents look good, at most ``BOUND`` of a document's bytes (the least likely
ones stay bad); the chain is fitted on these labels, and tells again. So chains
change label where documents do, and a clean line beside junk stays good.

The model is fitted on the driver by full-batch gradient ascent from at most
``SAMPLE`` labelled documents of the training folds, all lines of each (a
document of very many lines as several chains); scoring reads every line of every document.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_of import chunks, word_prints, words
from .shared import sliced, table

SAMPLE, ROUNDS, RATE, L2 = 3_000, 150, 0.15, 1e-3
#: Turns of labelling and fitting, greatest share of good bytes in a bad document, and lines of one chain in training.
TURNS, BOUND, CHAIN = 2, 0.5, 256
FOLDS, THRESHOLD = 5, 0.3

_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(192, 256)]] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_BAR = np.zeros(256, np.uint8)
_BAR[124] = 1
_SHOUT = np.zeros(256, np.uint8)
_SHOUT[[33, 63]] = 1
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126]] = 1
_STOP = np.zeros(256, np.uint8)
_STOP[[44, 46, 58, 59]] = 1
NAMES = ("bytes", "words", "word length", "upper", "digits", "bars", "shouts", "symbols", "stops", "repeats", "some bars", "some shouts", "some symbols", "some repeats", "mostly upper")


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its bytes, each row's first line (rows + 1)); an empty text is one empty line."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # lines start at each text's start and after each line break within a text (its own end makes no empty line)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    breaks = breaks[breaks + 1 < offsets[owner + 1]] if len(breaks) else breaks
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    row_of = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    row_of = row_of[np.argsort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")]
    ends = np.r_[starts[1:], len(data)] if len(starts) else starts
    first = np.searchsorted(row_of, np.arange(n + 1))
    size = ends - starts

    def count(kind: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(kind[data], dtype=np.int64)]
        return total[ends] - total[starts]

    begin, finish, _ = words(data, offsets)
    prints = word_prints(data, begin, finish)
    line = np.searchsorted(starts, begin, "right") - 1
    nwords = np.bincount(line, minlength=len(starts)).astype(float)
    same = np.r_[False, (prints[1:] == prints[:-1]) & (line[1:] == line[:-1])] if len(prints) else np.zeros(0, bool)
    repeats = np.bincount(line[same], minlength=len(starts)) / np.maximum(1, nwords)
    letters = np.maximum(1, count(_LETTER))
    bytes_ = np.maximum(1, size)
    upper, digits = count(_UPPER) / letters, count(_DIGIT) / bytes_
    bars, shouts, symbols = (count(k) / np.maximum(1, nwords) for k in (_BAR, _SHOUT, _SYMBOL))
    columns = [
        np.log1p(size) / 8, np.log1p(nwords) / 6, np.minimum(size / np.maximum(1, nwords), 40) / 10, upper, digits,
        np.minimum(bars, 2), np.minimum(shouts, 3), np.minimum(symbols, 4), np.minimum(count(_STOP) / np.maximum(1, nwords), 2), repeats,
        bars > 0.1, shouts > 0.2, symbols > 0.25, repeats > 0.15, upper > 0.6,
    ]
    x = np.stack(columns, axis=1).astype(float) if len(starts) else np.zeros((0, len(NAMES)))
    return x, size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A constant, own features, and those of the lines before and after (zeros at a document's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    has = np.diff(first) > 0
    before[first[:-1][has]] = 0
    after[first[1:][has] - 1] = 0
    return np.concatenate([np.ones((len(x), 1)), x, before, after], axis=1)


def _soft(a: np.ndarray, b) -> np.ndarray:
    return np.logaddexp(a, b)


def messages(e: np.ndarray, first: np.ndarray, good: float, bad: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (emission included) and backward log-odds of every line; all documents step together."""
    f, b = e.copy(), np.zeros_like(e)
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    for t in range(1, int(n[0]) if len(n) else 0):
        now = start[: np.searchsorted(-n, -t, "left")] + t
        x = f[now - 1]
        f[now] += _soft(good + x, 0) - _soft(x, bad)
    for t in range(1, int(n[0]) if len(n) else 0):
        live = np.searchsorted(-n, -t, "left")
        now = start[:live] + n[:live] - 1 - t
        x = e[now + 1] + b[now + 1]
        b[now] = _soft(good + x, 0) - _soft(x, bad)
    return f, b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Model:
    w: np.ndarray
    good: float
    bad: float
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of every line to be good."""
        f, b = messages(with_neighbours(x, first) @ self.w, first, self.good, self.bad)
        return _sigmoid(f + b)

    def quality(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals, as log-odds."""
        p = self.marginals(x, first)
        weight = size + 1.0
        total = np.add.reduceat(np.r_[p * weight, 0], first[:-1]) / np.add.reduceat(np.r_[weight, 0], first[:-1])
        total = np.clip(total, 1e-6, 1 - 1e-6)
        return np.log(total / (1 - total))

    def score(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.quality(x, size, first) + self.shift)


def line_labels(p: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, bound: float = BOUND) -> np.ndarray:
    """1 for every line of a good document and for lines of a bad one that are likely good, up to ``bound`` of its bytes."""
    n = np.diff(first)
    of = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((p, of))
    weight = size[order] + 1.0
    upto = np.cumsum(weight)
    start = np.r_[0, upto][first[:-1]]
    total = np.r_[0, upto][first[1:]] - start
    # the least likely lines stay bad until they hold the rest of the bytes
    forced = np.empty(len(p), bool)
    forced[order] = upto - weight - start[of] < (1 - bound) * total[of] - 1e-9
    return np.where(label[of] == 1, 1.0, ((p > 0.5) & ~forced).astype(float))


def _ascend(v: np.ndarray, first: np.ndarray, y: np.ndarray, c: np.ndarray, chain: bool, rounds: int, rate: float) -> Model:
    """Maximises the conditional likelihood of the lines' labels ``y``, each weighted by ``c``."""
    inner = np.ones(len(y), bool)
    inner[first[1:] - 1] = False
    left = np.flatnonzero(inner)
    p = np.zeros(v.shape[1] + 2)
    m, s = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, rounds + 1):
        w, good, bad = p[:-2], p[-2], p[-1]
        e = v @ w
        g = np.zeros_like(p)
        f, b = messages(e, first, good, bad) if chain else (e, np.zeros_like(e))
        g[:-2] = v.T @ (c * (y - _sigmoid(f + b))) - L2 * w
        if chain:
            x_, z_ = f[left], e[left + 1] + b[left + 1]
            pair = np.stack([np.full(len(left), bad), z_, x_, x_ + z_ + good])
            pair = np.exp(pair - pair.max(axis=0))
            pair /= pair.sum(axis=0)
            one, two = y[left], y[left + 1]
            g[-2] = (c[left] * (one * two - pair[3])).sum() - L2 * good
            g[-1] = (c[left] * ((1 - one) * (1 - two) - pair[0])).sum() - L2 * bad
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        p = p + rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return Model(p[:-2], float(p[-2]), float(p[-1]))


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The chain from documents' labels, both counting alike, by turns of labelling lines and fitting; then the score's map."""
    v = with_neighbours(x, first)
    n = np.diff(first)
    doc = 1.0 / np.where(label == 1, max(1, (label == 1).sum()), max(1, (label == 0).sum())) / np.maximum(1, n)
    c = np.repeat(doc, n)
    # long documents step as several chains
    cuts = np.unique(np.concatenate([first, *(np.arange(a, b, CHAIN) for a, b in zip(first[:-1], first[1:], strict=True) if b - a > CHAIN)]))
    y = np.repeat(label.astype(float), n)
    model = _ascend(v, cuts, y, c, False, rounds, rate)
    for _ in range(TURNS):
        y = line_labels(model.marginals(x, first), size, first, label)
        model = _ascend(v, cuts, y, c, True, rounds, rate)
    q = model.quality(x, size, first)
    weight = doc * np.maximum(1, n)
    a, d = 1.0, 0.0
    for _ in range(300):
        r = weight * (label - _sigmoid(a * q + d))
        a += 0.3 * ((r * q).sum() / max(1.0, float(np.abs(q).max())) - 1e-3 * (a - 1))
        d += 0.5 * r.sum()
    model.slope, model.shift = float(max(a, 0.05)), float(d)
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for a, b, data, offsets in chunks(batch.column("text")):
            x, size, first = line_features(data, offsets)
            rows = [x[first[r] : first[r + 1]].reshape(-1).tolist() for r in range(b - a)]
            sizes = [size[first[r] : first[r + 1]].tolist() for r in range(b - a)]
            own = [batch.column(c).slice(a, b - a) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(rows, pa.list_(pa.float64())), pa.array(sizes, pa.list_(pa.int64()))], names=["id", "label", "x", "size"])


def _scored(model: Model, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = np.zeros(len(batch))
            for a, b, data, offsets in chunks(batch.column("text")):
                out[a:b] = model.score(*line_features(data, offsets))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(out)], names=[*extra, "score"])

    return run


def fold(id_: F.Column, folds: int = FOLDS) -> F.Column:
    return F.pmod(F.crc32(id_.cast("string")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """The model, from labelled documents outside fold 0; None if they don't have both labels.

    Null ids and labels other than 0 and 1 count for nothing; of labels that
    repeat an id the smallest holds, and rows that repeat an id are documents each.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label).cast("long").alias("label"))
    # the same number of each label, in an order that depends on nothing but the id
    half = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for k in (0, 1)]
    chosen = half[0].unionByName(half[1])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # rows in one order whatever the partitions, since sums depend on it
    rows = texts.select("id", "label", "text").mapInArrow(_featured, "id long, label long, x array<double>, size array<long>").toPandas()
    if rows["label"].nunique() < 2:
        warnings.warn("no documents of both labels to learn from: every document scores 1", stacklevel=2)
        return None
    rows = rows.assign(k=[str(list(x[: len(NAMES)])) for x in rows["x"]]).sort_values(["id", "k"], kind="stable")
    width = len(NAMES)
    x = np.concatenate([np.asarray(v, float).reshape(-1, width) for v in rows["x"]])
    size = np.concatenate([np.asarray(v, np.int64) for v in rows["size"]])
    first = np.r_[0, np.cumsum([len(v) for v in rows["size"]])]
    return fit(x, size, first, rows["label"].to_numpy())


def scored(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the score of every row.

    A null text counts as empty, and an empty text as one empty line. Without a
    model (no label of one kind) every score is 1.
    """
    if model is None:
        return docs.select(*keep, F.lit(1.0).alias("score"))
    from pyspark.sql.types import DoubleType, StructField, StructType

    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    names = [f"k{i}" for i in range(len(keep))]
    schema = StructType([*(f for f in rows.schema.fields if f.name in names), StructField("score", DoubleType())])
    out = rows.mapInArrow(_scored(model, names), schema)
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def accepted(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose score is at least ``threshold``."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = np.zeros(len(batch), bool)
            for a, b, data, offsets in chunks(batch.column(text)):
                keep[a:b] = model.score(*line_features(data, offsets)) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; a null doc_id is in no fold (null) and was not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
