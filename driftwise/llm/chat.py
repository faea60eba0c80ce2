"""Chat formatting by columnar byte assembly.

A turn is written as ``<|role|>`` NEWLINE content ``<|end|>`` NEWLINE. Control
strings inside roles and contents, of this template and of common others, are
broken by a backslash after their first character, and a backslash already there
is doubled, so reading back drops each backslash and keeps what follows it.

A batch of turns is assembled at once: segment lengths (headers, contents, ends)
give cumulative offsets, numpy turns these into scatter indices, and all bytes
land in one preallocated buffer that becomes an Arrow string column. Turns are
sorted within tasks; a conversation is one or more consecutive rows of the
output, in parts of at most ``PART`` turns, so its length is not bounded by a
task's memory. Loss spans are byte ranges of each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sliced, table

#: Turns of a part, and bytes unless a turn alone has more (scattering takes about 24 times as much memory).
PART, PART_BYTES = 1024, 1 << 22
OPEN, CLOSE, END = b"<|", b"|>\n", b"<|end|>\n"
#: Strings that steer a model in this or another template; none may stand in a text unbroken.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<pad>", "<unk>", "<start_of_turn>", "<end_of_turn>", "[BOS]", "[EOS]", "[CLS]", "[SEP]")
TRAINED = "assistant"


def escape(texts: pa.Array) -> pa.Array:
    out = pc.replace_substring(texts, "\\", "\\\\")
    for s in CONTROL:
        out = pc.replace_substring(out, s, s[0] + "\\" + s[1:])
    return out


def unescape(raw: bytes) -> bytes:
    if b"\\" not in raw:
        return raw
    data = np.frombuffer(raw, np.uint8)
    slash = np.flatnonzero(data == 92)
    # of a run of backslashes, every other one is a mark, the first of the run included
    start = np.r_[True, np.diff(slash) != 1]
    place = np.arange(len(slash)) - np.maximum.accumulate(np.where(start, np.arange(len(slash)), 0))
    return np.delete(data, slash[place % 2 == 0]).tobytes()


def assemble(roles: pa.Array, texts: pa.Array, conversation: np.ndarray) -> tuple[pa.Array, list[list[int]], np.ndarray]:
    """One string per run of equal values of ``conversation``, its loss spans, and each run's first turn."""
    n = len(texts)
    columns = [escape(c.cast(pa.large_string()).fill_null("")) for c in (roles, texts)]

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)

    fixed = np.frombuffer(OPEN + CLOSE + END, np.uint8)
    marks = (np.array([0, len(OPEN)]), np.array([len(OPEN), len(OPEN + CLOSE)]), np.array([len(OPEN + CLOSE), len(fixed)]))
    (role_at, role_data), (text_at, text_data) = map(flat, columns)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(OPEN), len(CLOSE), len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.reshape(-1)).reshape(n, 5)
    starts = ends - lengths
    buffer = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)

    def scatter(to: np.ndarray, size: np.ndarray, data: np.ndarray, start: np.ndarray) -> None:
        """Copies data[start : start + size] to buffer[to : to + size], for all segments at once."""
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        buffer[np.repeat(to, size) + within] = data[np.repeat(start, size) + within]

    for k, mark in zip((0, 2, 4), marks, strict=True):
        scatter(starts[:, k], lengths[:, k], fixed, np.full(n, mark[0]))
    scatter(starts[:, 1], lengths[:, 1], role_data, role_at[:-1])
    scatter(starts[:, 3], lengths[:, 3], text_data, text_at[:-1])
    first = np.flatnonzero(np.r_[True, conversation[1:] != conversation[:-1]]) if n else np.zeros(0, np.int64)
    bounds = np.r_[starts[first, 0], len(buffer)].astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.tobytes()), pa.py_buffer(buffer))
    trained = np.array(pc.equal(roles.cast(pa.large_string()).fill_null(""), TRAINED))
    run = np.searchsorted(first, np.arange(n), "right") - 1
    spans: list[list[int]] = [[] for _ in first]
    for i in np.flatnonzero(trained):
        base = bounds[run[i]]
        spans[run[i]] += [int(starts[i, 3] - base), int(ends[i, 3] - base)]
    return strings, spans, first


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations in order; a conversation goes on in the next part if a batch ends within it."""
    last, part = None, 0
    for some in sliced(batches, PART, PART_BYTES):
        ids = some.column("id")
        known, names = np.array(ids.is_valid()), np.array(ids.fill_null(0))
        new = np.r_[True, (names[1:] != names[:-1]) | (known[1:] != known[:-1])]
        strings, spans, first = assemble(some.column("role"), some.column("text"), np.cumsum(new))
        parts = []
        for k in first:
            own = (bool(known[k]), int(names[k]))
            part = part + 1 if own == last else 0
            last = own
            parts.append(part)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(parts, pa.int64()), strings, pa.array(spans, pa.list_(pa.int64()))], names=["id", "part", "formatted", "loss"])


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted part."""
    out = []
    for turn in formatted.encode().split(END)[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition(CLOSE)
        out.append((unescape(role).decode(), unescape(text).decode()))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, state = None, None  # the conversation being read (its id may be null), and what is known of it

    def closed() -> pa.RecordBatch:
        n, turns, chars, loss, size = state
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, n, turns.hexdigest(), chars, loss.hexdigest(), size), kinds, strict=True)], names=names)

    done: list[pa.RecordBatch] = []
    for batch in sliced(batches):
        for row in range(len(batch)):
            id_, formatted, loss = batch.column("id")[row].as_py(), batch.column("formatted")[row].as_py(), batch.column("loss")[row].as_py()
            if state is None or id_ != now:
                if state:
                    done.append(closed())
                now, state = id_, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_back(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            raw = formatted.encode()
            for a, b in zip(loss[::2], loss[1::2], strict=True):
                text = unescape(raw[a:b])
                state[2] += len(text.decode())
                state[3].update(text)
            state[4] += len(formatted)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    if state:
        yield closed()


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """id, part, formatted, loss: conversations in sorted tasks, parts in order within their task.

    Turns go by ``turn_col``, ties by role and text, repeated rows each count;
    null turns come first. A null role or text is empty, and rows without a
    conversation id are one conversation, whose id is null. Other columns are
    not read; an empty table gives no part.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    dealt = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return dealt.mapInArrow(_format, "id long, part long, formatted string, loss array<long>")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, read back from the formatted output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    digests = format_chats(turns.unionByName(probe)).mapInArrow(_digest, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return digests.withColumnRenamed("id", "conv_id")


def _escaped_sql(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


_FIXED = len((OPEN + CLOSE + END).decode())
ORACLE_SQL = f"""with c as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t, role, text from conversations
  union all select -1, k, role, text, role, text from (values (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) p(k, role, text))
select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, role nulls first, text nulls first)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (r = '{TRAINED}'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(t, '' order by turn nulls first, text nulls first) filter (r = '{TRAINED}'), '')) as loss_sha256,
  cast(sum({_FIXED} + length({_escaped_sql("r")}) + length({_escaped_sql("t")})) as bigint) as formatted_chars
from c group by conv_id"""
