"""A Spark data source for Stata files, read in parallel by row range.

Rows have a fixed width, so a task goes straight to the first row of its range.
Types come from the file's header. The path must be one that all executors
can open as a file.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, FloatType, IntegerType, ShortType, StringType, StructField, StructType, TimestampType

#: Each task opens the file anew, so beyond so many tasks each takes several ranges of ``chunk`` rows.
TASKS = 1000
_KINDS = {"int8": ShortType(), "int16": ShortType(), "int32": IntegerType(), "float32": FloatType(), "float64": DoubleType()}


class Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class StataSource(DataSource):
    """``spark.read.format("stata").load(path)``; options: columns, chunk, convertCategoricals."""

    @classmethod
    def name(cls) -> str:
        return "stata"

    @property
    def columns(self) -> list[str] | None:
        named = self.options.get("columns")
        return named.split(",") if named else None

    @property
    def labelled(self) -> bool:
        return self.options.get("convertCategoricals", "false") == "true"

    def open(self):
        import pandas as pd

        return pd.read_stata(self.options["path"].removeprefix("file://"), iterator=True, columns=self.columns, convert_categoricals=self.labelled)

    def schema(self) -> StructType:
        with self.open() as f:
            f.data_label  # opens the file
            kinds = {name: self._kind(t, form, label) for name, t, form, label in zip(f._varlist, f._dtyplist, f._fmtlist, f._lbllist, strict=True)}
        return StructType([StructField(c, kinds[c]) for c in self.columns or kinds])

    def _kind(self, t, form: str, label: str):
        if form.startswith(("%t", "%d", "%-t", "%-d")):
            return TimestampType()
        if (label and self.labelled) or isinstance(t, (int, str)):
            return StringType()
        return _KINDS.get(np.dtype(t).name, StringType())

    def reader(self, schema: StructType) -> DataSourceReader:
        return StataReader(self, schema)


class StataReader(DataSourceReader):
    def __init__(self, source: StataSource, schema: StructType):
        self.source, self.schema = source, schema

    def partitions(self) -> list[InputPartition]:
        chunk = int(self.source.options.get("chunk", "100000"))
        with self.source.open() as f:
            f.data_label
            total = f._nobs
        chunk *= max(1, -(-total // (chunk * TASKS)))
        return [Rows(k, min(total, k + chunk)) for k in range(0, total, chunk)] or [Rows(0, 0)]

    def read(self, part: Rows):
        import pyarrow as pa

        if part.end <= part.start:
            return
        kinds = to_arrow_schema(self.schema)
        with self.source.open() as f:
            f.data_label
            f._lines_read = part.start  # pandas seeks from here to the row
            for start in range(part.start, part.end, 20_000):
                rows = f.read(min(20_000, part.end - start))
                yield pa.RecordBatch.from_arrays([self._column(rows[k.name], k.type) for k in kinds], schema=kinds)

    @staticmethod
    def _column(values, kind):
        import pyarrow as pa

        if pa.types.is_string(kind):
            return pa.array([None if v is None or v != v else str(v) for v in values], kind)
        if pa.types.is_timestamp(kind):
            return pa.array(values.astype("datetime64[us]"), pa.timestamp("us"), from_pandas=True).cast(kind)
        return pa.array(values, from_pandas=True).cast(kind)
