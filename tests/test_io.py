"""Sources, sinks, the stream and the command line."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftwise import cli
from driftwise.operators import entity_year
from driftwise.sources import readers, sinks
from driftwise.streaming import entity_years as stream

YEARS = "stkcd string, p_year int, n_patents long, embedding array<double>, embedding_citw array<double>"


@pytest.fixture
def years(spark):
    rows = [("000002", 2001, 3, [1.0, 2.0], [0.5, 0.25]), ("000002", 2002, 4, [2.0, 2.0], [1.0, 0.0]), ("600808", 2001, 1, [0.0, 1.0], [0.0, 1.0])]
    return spark.createDataFrame(rows, YEARS)


def test_bundle_round_trip(spark, tmp_path, years):
    paths = sinks.write_bundle(years, str(tmp_path), "Some-model", 2)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["firm_year_some_embeddings.parquet", "firm_year_some_embeddings.csv", "firm_year_citweighted_some_embeddings.parquet", "firm_year_citweighted_some_embeddings.csv"]
    back = readers.read_wide_vectors(spark, paths[1], "stkcd string, p_year int, n_patents long")
    assert sorted(tuple(r) for r in back.collect()) == sorted((r.stkcd, r.p_year, r.n_patents, r.embedding) for r in years.collect())
    empty = sinks.write_bundle(years.limit(0), str(tmp_path / "none"), "Some-model", 2)
    assert spark.read.parquet(empty[0]).columns == ["stkcd", "p_year", "n_patents", "embedding"]


def test_single_files(spark, tmp_path, years):
    path = str(tmp_path / "x.csv")
    sinks.write_one_csv(years.select("stkcd", "p_year").orderBy("stkcd", "p_year"), path)
    assert open(path, "rb").read(3) == b"\xef\xbb\xbf"
    assert readers.read_csv(spark, path, "stkcd string, p_year int").first().stkcd == "000002"
    sinks.write_npy(years, str(tmp_path / "m.npy"), ["stkcd", "p_year"])
    assert np.load(tmp_path / "m.npy").tolist() == [[1, 2], [2, 2], [0, 1]]
    assert [r.embedding for r in readers.read_npy(spark, str(tmp_path / "m.npy")).orderBy("row").collect()] == [[1, 2], [2, 2], [0, 1]]


def test_stata(spark, tmp_path):
    path = str(tmp_path / "d.dta")
    pd.DataFrame({"stkcd": ["000002", "", "600808"], "p_year": np.array([2001, 2002, 2003], np.int32), "p_cite": [1.5, np.nan, 3.0]}).to_stata(path, write_index=False, version=118)
    df = readers.read_stata(spark, path, chunk=2)
    assert [tuple(r) for r in df.orderBy("p_year").collect()] == [("000002", 2001, 1.5), ("", 2002, None), ("600808", 2003, 3.0)]
    assert readers.read_stata(spark, path, ["p_year"]).columns == ["p_year"]


def test_paths(spark, tmp_path, years):
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, str(tmp_path / "no"), str(tmp_path / "none"))
    assert readers.resolve(spark, None, str(tmp_path)) == str(tmp_path)
    assert readers.optional(spark, str(tmp_path / "no")) is None


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"{k % 3}", 2000 + k % 2, k % 5 == 0, [float(k), 1.0], 0.0) for k in range(30)]
    schema = "stkcd string, p_year int, text_is_empty boolean, embedding array<double>, p_cite double"
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], schema).coalesce(1).write.mode("append").parquet(source)
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = stream.start(df, str(tmp_path / "sums"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {(r.stkcd, r.p_year): (r.n_texts_used, r.embedding) for r in stream.current(spark, str(tmp_path / "sums"), 3).collect()}
    want = {(r.stkcd, r.p_year): (r.n_texts_used, r.embedding) for r in entity_year.entity_years(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == set(want)
    for k, (n, v) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(v)


def test_command_line(spark, tmp_path, years):
    raw = spark.createDataFrame([("2", 2001, "p1", "one two", "three.", "x", 3.0), ("2", 2002, "p2", "one", "four", "x", 1.0)], "stkcd string, p_year int, p_id string, p_tt string, p_abs string, p_type string, p_cite double")
    raw.write.parquet(str(tmp_path / "raw"))
    run = lambda *a: cli.run(cli.parser().parse_args(list(a)), spark)
    assert run("embed", "--input", str(tmp_path / "raw"), "--output", str(tmp_path / "e"), "--width", "8") == 0
    assert run("similarity", "--input", str(tmp_path / "e/firm_year_hashing_embeddings.parquet"), "--output", str(tmp_path / "s")) == 0
    assert spark.read.parquet(str(tmp_path / "s")).where(F.col("cos_sim_lag1").isNotNull()).count() == 1
    assert run("extract", "--input", str(tmp_path / "raw"), "--stkcd", "9") == 1
    assert run("extract", "--input", str(tmp_path / "raw"), "--stkcd", "000002", "--format", "markdown", "--output", str(tmp_path / "r.md")) == 0
    assert "p2" in open(tmp_path / "r.md").read()
    assert run("batch", "--input", str(tmp_path / "raw"), "--companies", "2, 3", "--output", str(tmp_path / "b")) == 0
    assert run("preview", "--input", str(tmp_path / "raw"), "-n", "1") == 0
    assert run("inspect", "--input", str(tmp_path / "raw")) == 0
    assert run("sample", "--input", str(tmp_path / "e/firm_year_hashing_embeddings.parquet")) == 0


def test_stata_file_is_written_by_tasks(spark, tmp_path, monkeypatch):
    schema = "name string, b boolean, small byte, k int, big long, huge long, gap int, f float, x double, at timestamp, notes string, none string"
    at = lambda k: dt.datetime(1955, 1, 1, 12) + dt.timedelta(days=97 * k, milliseconds=k)
    rows = [
        (f"é{k}" * (k % 4) if k % 7 else None, k % 2 == 0, k % 120, -k, 10**6 + k, 2**40 + k, None if k % 5 == 0 else k, k / 4 if k % 3 else float("nan"), None if k % 4 == 0 else k / 7, None if k % 11 == 0 else at(k), "" if k % 2 else "ü" * (k * 30), None)
        for k in range(200)
    ]
    df = spark.createDataFrame(rows, schema).repartitionByRange(7, "huge").sortWithinPartitions("huge")
    want = df.toPandas().assign(none="")
    monkeypatch.setattr(type(df), "toPandas", lambda *_: pytest.fail("rows pass through the driver"))
    path = str(tmp_path / "d.dta")
    sinks.write_stata(df, "file://" + path)
    assert [p.name for p in tmp_path.iterdir()] == ["d.dta"]
    got = pd.read_stata(path)
    want.to_stata(str(tmp_path / "want.dta"), write_index=False, version=118)
    pd.testing.assert_frame_equal(got, pd.read_stata(str(tmp_path / "want.dta")))
    back = readers.read_stata(spark, path, ["big", "x"], chunk=9).orderBy("big").collect()
    assert [tuple(r) for r in back] == [(r[4], r[8]) for r in rows]


def test_empty_and_impossible_stata_files(spark, tmp_path):
    path = str(tmp_path / "d.dta")
    sinks.write_stata(spark.createDataFrame([], "a string, k int, x double"), path)
    assert readers.read_stata(spark, path).collect() == [] and pd.read_stata(path).columns.tolist() == ["a", "k", "x"]
    with pytest.raises(ValueError, match="infinite"):
        sinks.write_stata(spark.createDataFrame([(float("inf"),)], "x double"), path)
    with pytest.raises(ValueError, match="no type"):
        sinks.write_stata(spark.createDataFrame([([1],)], "x array<int>"), path)


def test_small_ranges_do_not_open_a_large_file_for_each(spark, tmp_path):
    path = str(tmp_path / "d.dta")
    n = 30_001
    pd.DataFrame({"k": np.arange(n, dtype=np.int32)}).to_stata(path, write_index=False, version=118)
    df = readers.read_stata(spark, path, chunk=7)
    assert df.rdd.getNumPartitions() <= 1000
    assert sorted(r.k for r in df.collect()) == list(range(n))
    assert readers.read_stata(spark, path, chunk=7000).rdd.getNumPartitions() == 5
