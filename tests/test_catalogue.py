"""Every query of the library against its SQL in DuckDB, and the others for their shape."""

from datetime import date

import numpy as np
import pytest
from conftest import compare

from driftwise.plans import catalogue

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert duck.execute(f"select count(*) from ({ORACLES[name]})").fetchone()[0] > 0
    compare(catalogue.queries()[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_self_similarity_takes_all_documents(spark, tmp_path):
    rng = np.random.default_rng(2)
    keys = [*range(1, 60), *range(14_980, 15_080), 10**7]
    orders = [(k, k % 3, date(1995 + k % 4, 1, 1 + k % 28)) for k in keys]
    vectors = rng.normal(size=(50, 8))
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    factor, step, lasts, first, shift = catalogue.P.MODELS["a"]
    units = {}
    for k, f, d in orders:
        v = vectors[(factor * f + step * ((d.year - first) // lasts) + shift) % 50] + 0.5 * vectors[k % 50]
        units[k] = (f, d.year, v / np.linalg.norm(v))
    want = {}
    for k, (f, year, u) in units.items():
        sims = [u @ w for j, (g, y, w) in units.items() if g == f and (y, j) < (year, k)]
        want[k] = (max(sims), sum(sims) / len(sims)) if sims else (None, None)
    got = {r.p_id: (r.sim_max, r.sim_ave) for r in catalogue.queries()["self_similarity"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert got[k] == (pytest.approx(pair[0], abs=2e-6), pytest.approx(pair[1], abs=2e-6)) if pair[0] is not None else got[k] == pair, k


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 278
    assert set(entry.oracle_sql()) <= set(entry.queries())
