"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from driftwise.functions import scalars as S
from driftwise.functions import vectors as V
from driftwise.operators import clean, embed, entity_year, events, extract, history, sampling, similarity

NAN = float("nan")


def similar(spark, rows, **options):
    df = spark.createDataFrame([("000010", y, v) for y, v in rows], "stkcd string, p_year int, embedding array<double>")
    return [tuple(r)[2:] for r in similarity.similarity(df, **options).orderBy("p_year").collect()]


def near(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            assert (a is None) == (b is None), (g, w)
            assert a is None or a == pytest.approx(b, abs=1e-8), (g, w)


def test_lags_count_rows(spark):
    rows = [(2001, [1.0, 0.0]), (2002, [0.0, 1.0]), (2004, [1.0, 1.0]), (2005, [3.0, 4.0])]
    near(similar(spark, rows), [(None, None, None), (0, None, 0), (0.70710678, None, 1), (0.98994949, 0.98994949, 0.98994949)])
    near(similar(spark, rows, calendar=True), [(None, None, None), (0, None, 0), (None, None, 1), (0.98994949, None, 0.98994949)])


def test_zero_and_nan_vectors(spark):
    rows = [(2001, [1.0, 0.0]), (2002, [0.0, 0.0]), (2003, [1.0, 0.0]), (2004, [NAN, 0.0]), (2005, [1.0, 0.0]), (2006, [1.0, 0.0])]
    near(similar(spark, rows), [(None,) * 3, (None,) * 3, (None, None, 1), (None,) * 3, (None,) * 3, (1, None, None)])


def test_short_histories(spark):
    near(similar(spark, [(2001, [2.0, 1.0])]), [(None,) * 3])
    near(similar(spark, [(2001, [2.0, 1.0]), (2002, [1.0, 2.0])]), [(None,) * 3, (0.8, None, 0.8)])


@pytest.mark.parametrize(
    "docs, options, want",
    [
        ([([1, 0], 12, False), ([0, 1], 7, False), ([1, 1], 9, False)], {}, (3, 3, 28, 28 / 3, [2 / 3, 2 / 3], [0.75, 16 / 28])),
        ([([1, 0], 12, False), ([0, 1], 7, False), ([1, 1], 9, False), ([5, 5], 2, True)], {}, (4, 3, 30, 7.5, [2 / 3, 2 / 3], [31 / 30, 26 / 30])),
        ([([1, 0], 12, False), ([0, 1], 7, False), ([1, 1], 9, False), ([5, 5], 2, True)], {"include_empty": True}, (4, 4, 30, 7.5, [1.75, 1.75], [31 / 30, 26 / 30])),
        ([([1, 0], 1, True), ([0, 1], 3, True)], {}, (2, 2, 4, 2, [0.5, 0.5], [0.25, 0.75])),
        ([([1, 0], 0, False), ([0, 1], 0, False)], {}, (2, 2, 0, 0, [0.5, 0.5], [0.5, 0.5])),
    ],
)
def test_entity_year(spark, docs, options, want):
    rows = [("1", 2000, [float(x) for x in v], float(c), e) for v, c, e in docs]
    df = spark.createDataFrame(rows, "stkcd string, p_year int, embedding array<double>, p_cite double, text_is_empty boolean").repartition(3)
    r = entity_year.entity_years(df, **options).first()
    assert (r.n_patents, r.n_texts_used, r.total_citations) == want[:3]
    assert r.mean_citations == pytest.approx(want[3])
    assert r.embedding == pytest.approx(want[4])
    assert r.embedding_citw == pytest.approx(want[5])


def test_self_similarity(spark):
    rows = [("1", "a", "2002-01-01", [1.0, 0.0]), ("1", "b", "2002-01-01", [1.0, 0.0]), ("1", "c", "2004-01-01", [1.0, 1.0]), ("1", "d", "2005-01-01", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "stkcd string, p_id string, d string, embedding array<double>").withColumn("date", F.to_date("d"))
    got = {r.p_id: (r.sim_max, r.sim_max_d, r.sim_ave) for r in history.self_similarity(df, block=2).collect()}
    near([got[k] for k in "abcd"], [(None, None, None), (1, 0, 1), (0.70710678, 730, 0.70710678), (None, None, None)])


def test_text_and_numbers(spark):
    df = spark.createDataFrame([(" A b　　c ", None), ("　", "")], "a string, b string")
    assert [r[0] for r in df.select(S.normalised_text(F.col("a"), F.col("b"))).collect()] == ["A b c", ""]
    raw = spark.createDataFrame([("abc",), (None,), ("-3",), ("NaN",), (" 7 ",)], "c string")
    assert [r[0] for r in raw.select(S.count_or_zero(F.col("c"))).collect()] == [0, 0, 0, 0, 7]
    codes = spark.createDataFrame([("2",), ("000002",), (" 600808 ",), ("0",), ("1234567",), ("ab",)], "c string")
    assert [r[0] for r in codes.select(S.canonical_code(F.col("c"))).collect()] == ["000002", "000002", "600808", "000000", "1234567", "ab"]
    text = spark.createDataFrame([("One. Two!  Three\nfour。Five",)], "t string")
    assert text.select(S.sentences(F.col("t"))).first()[0] == ["One.", "Two!", "Three", "four。Five"]
    assert S.short_model_name("Some-Model-v1") == "some"


def test_prefix_filter(spark):
    text = spark.createDataFrame([("2",), ("600808",), ("830001",)], "stkcd string")
    number = spark.createDataFrame([(2,), (830001,)], "stkcd long")
    assert [r[0] for r in text.where(clean.has_prefix(text)).collect()] == ["600808"]
    assert [r[0] for r in number.where(clean.has_prefix(number)).collect()] == [2]


def test_prepared_drops_what_has_no_year(spark):
    df = spark.createDataFrame([("1", "2001", "t", None), ("1", "x", "t", "a"), (None, "2001", "t", "a"), ("2", "2001.5", "t", "a")], "stkcd string, p_year string, p_tt string, p_abs string")
    assert [(r.stkcd, r.p_year, r.text, r.p_cite) for r in clean.prepared(df).collect()] == [("1", 2001, "t", 0.0)]
    with pytest.raises(ValueError, match="p_abs"):
        clean.prepared(df.drop("p_abs"))


def test_period(spark):
    years = spark.range(2000, 2006).select(F.col("id").cast("int").alias("y"))
    pick = lambda **k: [r[0] for r in years.where(clean.period(F.col("y"), **k)).orderBy("y").collect()]
    assert pick(exact=2003, start=2000) == [2003]
    assert pick(start=2001, end=2002) == [2001, 2002]
    assert pick(start=2004) == [2004, 2005]
    assert pick(end=2000) == [2000]
    assert len(pick()) == 6


def test_cosine_guards(spark):
    df = spark.createDataFrame([([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([1.0, NAN], [1.0, 1.0]), ([1.0, float("inf")], [1.0, 1.0]), (None, [1.0]), ([2.0, 0.0], [-3.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.safe_cosine(F.col("a"), F.col("b"))).collect()] == [None] * 6 + [-1.0]
    assert all(math.isnan(x) for x in df.limit(7).where("size(a) = 2").select(V.divided(F.col("a"), F.lit(0.0))).first()[0])


def test_chunks():
    t = embed.WordTokenizer()
    assert embed.split_text("a b c", 3, t) == [("a b c", 3)]
    assert embed.split_text("", 3, t) == [("", 0)]
    assert embed.split_text("a b. c d. e f.", 5, t) == [("a b.", 3), ("c d.", 3), ("e f.", 3)]
    assert embed.split_text("a b. c d. e f.", 7, t) == [("a b. c d.", 7), ("e f.", 3)]
    assert [n for _, n in embed.split_text("w " * 100, 10, t)] == [10] * 10
    assert [n for _, n in embed.split_text("a. " + "w " * 12 + ". b.", 5, t)] == [2, 5, 5, 3, 2]
    assert embed.batch_size(None) == 64 and embed.batch_size(30) == 1024 and embed.batch_size(10, False) == 128 and embed.batch_size(4) == 128
    assert embed.token_budget(40) == 32


def test_events_and_courses(spark):
    rows = [("1", y, 6, s) for y, s in ((2000, None), (2001, 0.9), (2002, 0.4), (2003, 0.8), (2004, 0.7))] + [("2", 2001, 4, 0.1), ("3", 2001, 9, 0.2)]
    df = spark.createDataFrame(rows, "stkcd string, p_year int, n_patents long, cos_sim_lag1 double")
    assert [(r.stkcd, r.p_year) for r in events.breaks(df).orderBy("stkcd").collect()] == [("1", 2002), ("3", 2001)]
    other = df.withColumn("cos_sim_lag1", F.when(F.col("stkcd") == "3", 0.9).otherwise(F.col("cos_sim_lag1")))
    assert [tuple(r) for r in events.common_breaks(df, other).collect()] == [("1", 2002, 6, 0.4, 0.4)]
    t = events.trajectories(df, entities=100).collect()
    assert len(t) == 1 and t[0].years == [2001, 2002, 2003, 2004] and [x.p_year for x in t[0].low_sim_years] == [2002]


def test_samples_and_reports(spark):
    years = spark.createDataFrame([(c, y) for c, n in (("a", 22), ("b", 6), ("c", 6), ("d", 2), ("e", 1)) for y in range(2000, 2000 + n)], "stkcd string, p_year int")
    assert {(r.stratum, r.stkcd, r.year_range) for r in sampling.strata(years).collect()} == {("many", "a", "2000-2021"), ("medium", "b", "2000-2005"), ("few", "d", "2000-2001"), ("single", "e", "2000-2000")}
    docs = spark.createDataFrame([("000002", 2001, "p1", "t1"), ("2", 2002, "p2", None)], "stkcd string, p_year int, p_id string, p_tt string").withColumn("p_date", F.lit(None).cast("date"))
    found = extract.extracted(docs, "2")
    assert found.count() == 2
    lines = "\n".join(r.value for r in extract.report(found, "2", "all", "2024-01-02").collect())
    assert "**专利总数**: 2 件" in lines and "## 2001年 (1件专利)" in lines and "**标题**: N/A" in lines and "2024-01-02" in lines
