"""Self-similarity against brute force, and how much of a table it deals out."""

from datetime import date, timedelta

import numpy as np
import pytest

from driftwise.operators import history, similarity

SCHEMA = "stkcd string, p_year int, p_id long, date date, embedding array<double>"


def shuffled(spark, since=0):
    """Rows that all stages of the session have dealt out."""
    context = spark._jsparkSession.sparkContext()
    context.listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size())) - since


def brute(rows):
    """Per (entity, id) the three results, each document against all earlier ones."""
    unit = [None if v is None or not np.isfinite(v).all() or np.linalg.norm(v) <= 1e-12 else np.array(v) / np.linalg.norm(v) for *_, v in rows]
    want = {}
    for (e, _, i, d, _), u in zip(rows, unit, strict=True):
        earlier = sorted(((g or date.max, j), w) for (f, _, j, g, _), w in zip(rows, unit, strict=True) if f == e and w is not None and u is not None and len(w) == len(u) and (g or date.max, j) < (d or date.max, i)) if e is not None else []
        sims = [float(u @ w) for _, w in earlier]
        if not sims:
            want[e, i] = (None, None, None)
            continue
        best = int(np.round(sims, 12).argmax())
        there = earlier[best][0][0]
        want[e, i] = (sims[best], None if d is None or there == date.max else (d - there).days, sum(sims) / len(sims))
    return want


@pytest.mark.parametrize("block", [7, None])
def test_self_similarity_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    pool = rng.normal(size=(60, 6))
    pool[30:40] = 3 * pool[:10]  # parallel to others
    rows = []
    for k in range(500):
        v = pool[rng.integers(60)].tolist() if k % 3 else rng.normal(size=6).tolist()
        v = {11: None, 12: [0.0] * 6, 13: [float("nan")] * 6, 14: v[:4]}.get(k % 40, v)
        rows.append(("big" if k % 5 else f"small {k % 25}", 2000, k * 7919 % 1000, None if k % 90 == 1 else date(2000, 1, 1) + timedelta(int(rng.integers(60))), v))
    rows.append((None, 2000, 5000, date(2001, 1, 1), [1.0] * 6))
    got = history.self_similarity(spark.createDataFrame(rows, SCHEMA).repartition(5), **({"block": block} if block else {})).collect()
    want = brute(rows)
    assert len(got) == len(rows) and {(r.stkcd, r.p_id) for r in got} == want.keys()
    for r in got:
        m, days, mean = want[r.stkcd, r.p_id]
        assert (r.sim_max, r.sim_max_d, r.sim_ave) == (pytest.approx(m, abs=1e-11), days, pytest.approx(mean, abs=1e-11)) if m is not None else (r.sim_max, r.sim_max_d, r.sim_ave) == (None, None, None), r


def test_copies_are_not_dealt_to_every_block(spark):
    rng = np.random.default_rng(6)
    pool, n = rng.normal(size=(20, 4)), 3000
    rows = [("1", 2000, k, date(2000, 1, 1) + timedelta(k // 50), pool[k % 20].tolist()) for k in range(n)]
    since = shuffled(spark)
    got = history.self_similarity(spark.createDataFrame(rows, SCHEMA), block=50).collect()
    assert sum(r.sim_max is not None for r in got) == n - 1
    assert shuffled(spark, since) < 10 * n


def test_summary_is_exact_and_holds_no_column_in_one_task(spark):
    rng = np.random.default_rng(7)
    n = 2000
    values = {"a": rng.normal(size=n), "b": np.where(rng.random(n) < 0.9, 1.0, rng.random(n)), "c": np.round(rng.random(n), 2), "d": np.full(n, np.nan), "e": np.where(np.arange(n) == 7, 0.25, np.nan)}
    rows = [tuple(None if c in "be" and k % 9 == 1 else float(x[k]) for c, x in values.items()) for k in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    out = similarity.summary(df, list(values))
    got = {r.measure: r for r in out.collect()}
    assert list(got) and out.columns == ["measure", "n", "mean", "median", "sd", "min", "max"]
    for k, c in enumerate(values):
        x = np.array([r[k] for r in rows if r[k] is not None and r[k] == r[k]])
        want = (x.mean(), np.median(x), x.std(ddof=1) if len(x) > 1 else None, x.min(), x.max()) if len(x) else (None,) * 5
        r = got[c]
        assert r.n == len(x) and (r.mean, r.median, r.sd, r.min, r.max) == tuple(w if w is None else pytest.approx(w, abs=1e-12) for w in want), c
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
