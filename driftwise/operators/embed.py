"""Splitting texts into token windows and turning them into vectors.

An encoder is anything with ``encode(list of texts) -> float matrix``; it is
built once per Python worker. ``HashingEncoder`` needs no model file and is
deterministic. Splitting follows one of two strategies: ``overflow`` cuts the
token sequence into windows, ``sentences`` packs whole sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import SENTENCE_END

_SENTENCES = re.compile(SENTENCE_END)


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class Tokenizer(Protocol):
    def tokens(self, text: str) -> list[str]: ...

    def text(self, tokens: list[str]) -> str: ...


class WordTokenizer:
    """Words and single marks; enough for tests and for counting."""

    _word = re.compile(r"\w+|[^\w\s]")

    def tokens(self, text: str) -> list[str]:
        return self._word.findall(text)

    def text(self, tokens: list[str]) -> str:
        return " ".join(tokens)


class HashingEncoder:
    """Signed feature hashing of words, of unit length (all zeros for a text without words)."""

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", (text or "").lower()):
                h = zlib.crc32(word.encode())
                out[row, h % self.width] += 1.0 if h >> 31 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def batch_size(memory_gb: float | None, small_model: bool = True) -> int:
    """How many texts to encode at once on a device with so much memory; None is a CPU. The steps are fixed values."""
    if memory_gb is None:
        return 64
    sizes = (1024, 512, 256, 128) if small_model else (512, 256, 128, 64)
    for bound, size in zip((24, 16, 8), sizes, strict=False):
        if memory_gb >= bound:
            return size
    return sizes[-1]


def token_budget(max_tokens: int = 512, reserved: int = 16) -> int:
    return max(32, max_tokens - reserved)


def windows(tokens: list[str], limit: int, tokenizer: Tokenizer) -> list[tuple[str, int]]:
    """Consecutive windows of at most ``limit`` tokens; one empty window for no tokens."""
    cut = [(tokenizer.text(tokens[k : k + limit]).strip(), len(tokens[k : k + limit])) for k in range(0, len(tokens), limit)]
    return [w for w in cut if w[0]] or [("", 0)]


def split_text(text: str | None, limit: int, tokenizer: Tokenizer, long_factor: int = 8, most_sentences: int = 256) -> list[tuple[str, int]]:
    """(chunk, tokens): whole if it fits, else sentences packed up to the limit.

    A text beyond ``long_factor`` limits, with one sentence or with more than
    ``most_sentences``, is cut into plain windows, and so is a sentence longer
    than the limit. Joining a sentence to a chunk counts as one token.
    """
    text = text or ""
    tokens = tokenizer.tokens(text)
    if len(tokens) <= limit:
        return [(text, len(tokens))]
    parts = [s.strip() for s in _SENTENCES.split(text) if s.strip()]
    if len(tokens) > limit * long_factor or not 1 < len(parts) <= most_sentences:
        return windows(tokens, limit, tokenizer)
    out: list[tuple[str, int]] = []
    held: list[str] = []
    count = 0

    def close() -> None:
        nonlocal held, count
        if held:
            out.append((" ".join(held), count))
        held, count = [], 0

    for part in parts:
        own = tokenizer.tokens(part)
        if len(own) > limit:
            close()
            out.extend(windows(own, limit, tokenizer))
        elif held and count + 1 + len(own) > limit:
            close()
            held, count = [part], len(own)
        else:
            count += len(own) + bool(held)
            held.append(part)
    close()
    return out or windows(tokens, limit, tokenizer)


def chunks(text: Column, limit: int = 496, strategy: str = "overflow", tokenizer: Callable[[], Tokenizer] = WordTokenizer) -> Column:
    """ARRAY<STRUCT<chunk, n_tokens>> of a text, Arrow batch by batch."""

    @F.pandas_udf("array<struct<chunk:string,n_tokens:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = tokenizer()
        cut = (lambda t: windows(own.tokens(t or ""), limit, own)) if strategy == "overflow" else (lambda t: split_text(t, limit, own))
        for texts in batches:
            yield texts.map(lambda t: [{"chunk": c, "n_tokens": n} for c, n in cut(t if isinstance(t, str) else "")])

    return run(text)


def chunked(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """One row per chunk: the columns of ``docs``, chunk_no, chunk, n_tokens."""
    return docs.select(*docs.columns, F.posexplode(chunks(F.col(text), **options)).alias("chunk_no", "_c")).select(*docs.columns, "chunk_no", "_c.chunk", "_c.n_tokens")


def encoded(text: Column, encoder: Callable[[], Encoder] = HashingEncoder, batch: int = 64) -> Column:
    """ARRAY<FLOAT> of a text; null counts as empty. The encoder is made once per worker."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder()
        for texts in batches:
            values = texts.fillna("").tolist()
            made = [row for k in range(0, len(values), batch) for row in own.encode(values[k : k + batch])]
            yield pd.Series(made)

    return run(text)


def embedded(docs: DataFrame, key: str = "p_id", text: str = "text", encoder: Callable[[], Encoder] = HashingEncoder, batch: int = 64, **options) -> DataFrame:
    """key, embedding (mean over the document's chunks, each counting alike), n_chunks, n_tokens."""
    parts = chunked(docs.select(key, text), text, **options)
    vectors = parts.select(key, "n_tokens", encoded(F.col("chunk"), encoder, batch).alias("v"))
    means = vectors.groupBy(key).agg(
        Summarizer.mean(array_to_vector(F.transform("v", lambda x: x.cast("double")))).alias("m"), F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")
    )
    return means.select(key, F.transform(vector_to_array("m"), lambda x: x.cast("float")).alias("embedding"), "n_chunks", "n_tokens")


def chunk_stats(parts: DataFrame, key: str = "p_id") -> DataFrame:
    """Texts, chunks and tokens, and their means per text and chunk."""
    per = parts.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("n_texts"), F.sum("k").alias("n_chunks"), F.sum("t").alias("n_tokens"), F.avg("k").alias("chunks_per_text"), F.try_divide(F.sum("t"), F.sum("k")).alias("tokens_per_chunk"))
