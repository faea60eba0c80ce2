"""Writing one Stata file from all tasks: rows have a fixed width, so every task writes its rows where they belong."""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Longer strings are kept apart from the rows.
LONGEST = 2045
#: What Stata's numbers of a kind may be, and what stands for a missing one.
_RANGES = {"i1": (-127, 100), "i2": (-32767, 32740), "i4": (-2147483647, 2147483620)}
_MISSING = {"f4": np.frombuffer(b"\x00\x00\x00\x7f", "<f4")[0], "f8": np.frombuffer(b"\x00\x00\x00\x00\x00\x00\xe0\x7f", "<f8")[0]}
_LARGEST = {"f4": np.frombuffer(b"\xff\xff\xff\x7e", "<f4")[0], "f8": np.frombuffer(b"\xff\xff\xff\xff\xff\xff\xdf\x7f", "<f8")[0]}
#: Milliseconds from 1960 to 1970.
_EPOCH = 315_619_200_000


def _is_text(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_large_string(kind)


def _measured(column: pa.Array) -> dict:
    """What the layout needs to know of a column; such facts of two batches add up or take the larger one."""
    kind, found = column.type, {"nulls": column.null_count}
    if _is_text(kind):
        size = pc.binary_length(column)
        found |= {"max": pc.max(size).as_py() or 0, "bytes": pc.sum(size).as_py() or 0, "full": pc.sum(pc.greater(size, 0)).as_py() or 0}
    elif pa.types.is_boolean(kind):
        found |= {"max": 1, "low": 0}
    elif pa.types.is_integer(kind) and column.null_count < len(column):
        found |= {"max": pc.max(column).as_py(), "low": -pc.min(column).as_py()}
    elif pa.types.is_floating(kind):
        size = np.abs(column.to_numpy(zero_copy_only=False))
        found |= {"max": float(np.max(size[~np.isnan(size)], initial=0.0))}
    return found


def _together(one: dict, two: dict) -> dict:
    add = ("nulls", "bytes", "full")
    return {k: one.get(k, 0) + two.get(k, 0) if k in add else max(x[k] for x in (one, two) if k in x) for k in {*one, *two}}


def _form(name: str, kind: pa.DataType, found: dict) -> str:
    """A column's form in a row: the kinds that pandas takes for such values."""
    if _is_text(kind):
        return f"S{max(1, found.get('max', 0))}" if found.get("max", 0) <= LONGEST else "strL"
    if pa.types.is_timestamp(kind):
        return "tc"
    if pa.types.is_boolean(kind) or pa.types.is_integer(kind):
        if found.get("nulls"):
            return "f8"
        least = 1 if pa.types.is_boolean(kind) else min(4, kind.bit_width // 8)
        return next((k for k, (a, b) in _RANGES.items() if int(k[1]) >= least and -found.get("low", 0) >= a and found.get("max", 0) <= b), "f8")
    if pa.types.is_floating(kind):
        form = next((k for k in ("f4", "f8") if int(k[1]) * 8 >= kind.bit_width and found.get("max", 0.0) <= _LARGEST[k]), None)
        if form:
            return form
        raise ValueError(f"column {name} has infinite or too large numbers")
    raise ValueError(f"column {name}: Stata has no type for {kind}")


def _frame_of(names: list[str], forms: list[str], n: int, apart: int) -> tuple[bytes, bytes]:
    """What stands before and behind the rows of a file of n rows and so many bytes of long strings, as pandas writes it for one row."""
    import pandas as pd

    values = {"i1": np.int8(0), "i2": np.int16(0), "i4": np.int32(0), "f4": np.float32(0), "f8": 0.0, "tc": pd.Timestamp("1960-01-01"), "strL": ""}
    one = pd.DataFrame({k: pd.Series(["x" * int(f[1:])] if f[0] == "S" else [values[f]]) for k, f in enumerate(forms)})
    one.columns = names
    out = BytesIO()
    one.to_stata(out, write_index=False, version=118, byteorder="little", convert_strl=[c for c, f in zip(names, forms, strict=True) if f == "strL"])
    raw, width = out.getvalue(), _row(forms).itemsize
    start = raw.index(b"<data>") + len(b"<data>")
    head, tail = bytearray(raw[:start]), raw[start + width :]
    if not tail.startswith(b"</data><strls></strls>"):
        raise ValueError("pandas lays out rows in another way")
    at = head.index(b"<N>") + 3
    head[at : at + 8] = struct.pack("<Q", n)
    at = head.index(b"<map>") + 5
    places = list(struct.unpack("<14q", head[at : at + 112]))
    for k in range(10, 14):
        places[k] += (n - 1) * width + (apart if k > 10 else 0)
    head[at : at + 112] = struct.pack("<14q", *places)
    return bytes(head), tail


def _row(forms: list[str]) -> np.dtype:
    kind = lambda f: "<f8" if f == "tc" else "<u8" if f == "strL" else f if f[0] == "S" else "<" + f
    return np.dtype([(str(k), kind(f)) for k, f in enumerate(forms)])


def _texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _encoded(batch: pa.RecordBatch, forms: list[str], first: int) -> tuple[bytes, bytes]:
    """A batch's rows, the first of which is the file's row ``first``, and its long strings."""
    rows = np.zeros(batch.num_rows, _row(forms))
    apart = []
    for k, form in enumerate(forms):
        c = batch.column(k)
        if form[0] == "S":
            rows[str(k)] = np.array(_texts(c), form)
        elif form == "strL":
            keys = rows[str(k)]
            for r, text in enumerate(_texts(c)):
                if text:
                    keys[r] = (k + 1) + ((first + r + 1) << 16)
                    apart.append((first + r, k, b"GSO" + struct.pack("<IQBI", k + 1, first + r + 1, 130, len(text) + 1) + text + b"\0"))
        elif form == "tc":
            wall = pc.local_timestamp(c) if c.type.tz else c
            ms = wall.cast(pa.timestamp("us")).cast(pa.int64())
            values = ms.fill_null(0).to_numpy() // 1000 + _EPOCH
            rows[str(k)] = np.where(c.is_null().to_numpy(zero_copy_only=False), _MISSING["f8"], values)
        elif form in _MISSING:
            values = c.cast(pa.int8()) if pa.types.is_boolean(c.type) else c
            values = values.to_numpy(zero_copy_only=False).astype(form)
            rows[str(k)] = np.where(np.isnan(values), _MISSING[form], values)
        else:
            rows[str(k)] = c.to_numpy(zero_copy_only=False)
    return rows.tobytes(), b"".join(x for *_, x in sorted(apart))


def write(df: DataFrame, path: str) -> None:
    """The frame's rows, in its order, as one file that the driver and all executors can open.

    Tasks first keep their rows beside the file, and the driver learns from each
    only their number and the extent of their values. That fixes the layout, so
    then tasks write into the file by seek and no row passes through the driver.
    """
    path = path.removeprefix("file://")
    folder, names = f"{path}.parts", df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        name, n, found, out = f"{folder}/{uuid.uuid4().hex}", 0, None, None
        for b in batches:
            if b.num_rows:
                out = out or pa.ipc.new_file(name, b.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                out.write_batch(b)
                n += b.num_rows
                now = [_measured(c) for c in b.columns]
                found = [_together(x, y) for x, y in zip(found, now, strict=True)] if found else now
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"k": [TaskContext.get().partitionId()], "name": [name], "n": [n], "found": [json.dumps(found)]}, pa.schema([("k", pa.int32()), ("name", pa.string()), ("n", pa.int64()), ("found", pa.string())]))

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(df.schema)]
    os.makedirs(folder, exist_ok=True)
    try:
        kept = sorted((tuple(r) for r in df.mapInArrow(keep, "k int, name string, n long, found string").collect()), key=lambda r: r[0])
        parts = [(name, n, json.loads(found)) for _, name, n, found in kept]
        whole = [{} for _ in names]
        for *_, found in parts:
            whole = [_together(x, y) for x, y in zip(whole, found, strict=True)]
        forms = [_form(c, t, x) for c, t, x in zip(names, kinds, whole, strict=True)]
        width = _row(forms).itemsize
        long = [k for k, f in enumerate(forms) if f == "strL"]
        size = lambda found: sum(found[k]["bytes"] + 21 * found[k]["full"] for k in long)
        n, apart = sum(p[1] for p in parts), sum(size(p[2]) for p in parts)
        head, tail = _frame_of(names, forms, n, apart)
        rows_at, mark = len(head), len(b"</data><strls>")
        texts_at = rows_at + n * width + mark
        places, row, text = [], 0, texts_at
        for name, m, found in parts:
            places.append((name, row, text))
            row, text = row + m, text + size(found)
        made = f"{folder}/file"
        with open(made, "wb") as f:
            f.write(head)
            f.seek(rows_at + n * width)
            f.write(tail[:mark])
            f.seek(texts_at + apart)
            f.write(tail[mark:])

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    name, row, text = places[k]
                    with open(made, "r+b") as f, pa.OSFile(name) as source:
                        part = pa.ipc.open_file(source)
                        for r in range(part.num_record_batches):
                            batch = part.get_batch(r)
                            rows, texts = _encoded(batch, forms, row)
                            f.seek(rows_at + row * width)
                            f.write(rows)
                            f.seek(text)
                            f.write(texts)
                            row, text = row + batch.num_rows, text + len(texts)
                yield b

        if parts:
            df.sparkSession.range(0, len(parts), 1, len(parts)).mapInArrow(fill, "id long").count()
        os.replace(made, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
