"""Helpers the operators of this subpackage share: tables, cut lineage, components."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What a Python worker works on at once at most: rows, and bytes unless a row alone has more.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 24
#: Temporary folders of local sessions.
_OWN: dict[SparkSession, str] = {}
#: Rows of ids that one task writes without trouble.
ROWS_A_FILE = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows and about so many bytes, whatever the session's settings; a row is never cut."""
    for batch in batches:
        step = max(1, min(rows, len(batch) * size // max(1, batch.nbytes)))
        for start in range(0, len(batch), step):
            yield batch.slice(start, step)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session (one machine, as in tests) may go without: it gets a
    temporary folder. A cluster's session without the setting is an error, since
    executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark not in _OWN:
        own = tempfile.mkdtemp(prefix="driftwise-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[spark] = "file://" + own
    return _OWN[spark]


class Stored:
    """A DataFrame written to the shared folder and read back, so its lineage ends there.

    ``seen`` are aggregates taken while writing. A frame whose number of rows is
    about known (``rows``) is written by as few tasks as that asks for.
    """

    def __init__(self, df: DataFrame, rows: int | None = None, **aggregates):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/driftwise/{uuid.uuid4().hex}"
        watch = Observation() if aggregates else None
        out = df.observe(watch, *(c.alias(n) for n, c in aggregates.items())) if watch else df
        if rows is not None:
            out = out.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        out.write.parquet(self.path)
        self.seen = watch.get if watch else {}
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    return Stored(df, rows).df


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables; results not yet read or written need theirs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/driftwise")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect garbage, so that shuffle files of finished steps can go.

    The listener bus holds on to an execution until its events are handled, so
    the collection is asked for again a moment later.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.4)
        spark._jvm.System.gc()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (columns a, b, both long): the smallest id reachable.

    Alternating large-star and small-star steps. Every step is a partially
    aggregated minimum and a join on the centre, which AQE can split where a
    centre has very many neighbours; nothing is gathered per key. The edges
    shrink to one star per component within a number of rounds logarithmic in
    the component's size. Each round is written to the shared folder.
    """
    def centred(sym: DataFrame, centre: DataFrame) -> DataFrame:
        return sym.join(centre, "u")

    # stars have reached their final form when a round leaves count and checksum of the edges as they were
    mark = {"n": F.count(F.lit(1)), "check": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    ends_of = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = Stored(ends_of, **mark)
    while now.seen["n"]:
        e = now.df
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = centred(sym, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = (
            centred(large, small_least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        then = Stored(star, now.seen["n"], **mark)
        now.drop()
        settled = then.seen == now.seen
        now = then
        if settled:
            break
    ends = now.df
    return ends.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        ends.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
