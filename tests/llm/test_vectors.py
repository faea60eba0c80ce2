"""Embedding near-dedup and nearest neighbours against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwise.llm import embedding_dedup as E
from driftwise.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, id string, cell long"


def vectors(seed=0, n=300, d=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for k in range(n // 2, n):
        x[k] = x[k % 20] + 0.1 * rng.standard_normal(d)
    x[10] = x[5]
    x[11] = x[5]
    rows = [(k, x[k].astype(np.float32).tolist(), k % 3 if k not in (10, 11) else 2, "i", 1) for k in range(n)]
    odd = [(n, None, 1), (n + 1, [0.0] * d, 1), (n + 2, [float("nan")] + [1.0] * (d - 1), 1), (n + 3, [None] + [1.0] * (d - 1), 1), (n + 4, rows[3][1], None), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [float("inf")] + [1.0] * (d - 1), 0)]
    return rows + [(a, b, c, "i", 1) for a, b, c in odd]


def brute_links(rows, threshold=0.98):
    good = [(i, np.array(v, float), c) for i, v, c, *_ in rows if v and c is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, *_ in rows}
    for a, x, p in good:
        for b, y, q in good:
            if a != b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    component = {}
    for i in sorted(links):
        if i not in component:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in component:
                    component[k] = i
                    stack += links[k]
    return {i: (len(links[i]), component[i]) for i in links}


@pytest.fixture
def tables(spark, tmp_path):
    def make(rows):
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
        return str(tmp_path)

    return make


def test_links_equal_brute_force(spark, tables):
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.op1_embedding_near_dedup(spark, tables(rows)).collect()}
    assert got == brute_links(rows)


@pytest.mark.parametrize("pairs, side", [(2, 1024), (0, 7), (10**9, 9)])
def test_dense_groups_equal_brute_force(spark, tables, monkeypatch, pairs, side):
    """Groups of vectors that nearly all link, as blocks of any size and as pairs."""
    monkeypatch.setattr(E, "PAIRS", pairs)
    monkeypatch.setattr(E, "SIDE", side)
    rng = np.random.default_rng(7)
    x = np.concatenate([c + s * rng.standard_normal((n, 16)) for c, s, n in ((rng.standard_normal(16), 0.02, 60), (rng.standard_normal(16), 0.11, 60), (rng.standard_normal(16), 0.16, 40))])
    rows = [(k, v.tolist(), k % 2, "i", 1) for k, v in enumerate(x)]
    rows += [(300 + k, rows[2 * k][1], rows[2 * k][2], "i", 1) for k in range(20)] + [(400, [1e-200] * 16, 1, "i", 1), (401, [2e-200] * 16, 1, "i", 1)]
    schema = SCHEMA.replace("array<float>", "array<double>")
    spark.createDataFrame(rows, schema).repartition(3).write.parquet((folder := tables(rows[:1])) + "/d/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.op1_embedding_near_dedup(spark, folder + "/d").collect()}
    want = brute_links([r for r in rows if r[0] < 400])
    assert {k: got[k] for k in want} == want and got[400] == got[401] == (1, 400)


def test_dense_groups_make_few_rows(spark, tables):
    """What leaves the operator's blocks and pairs grows with the vectors of a group, not with its square."""
    rng = np.random.default_rng(8)
    made = []
    for n in (100, 400):
        x = rng.standard_normal(16) + 0.02 * rng.standard_normal((n, 16))
        _, counts, edges = E.near_copies(spark.read.parquet(f"{tables([(k, v.tolist(), 1, 'i', 1) for k, v in enumerate(x)])}/embeddings.parquet"))
        assert [r.n for r in counts.collect()] == [n - 1] * n
        made.append(edges.count())
    assert made[1] <= 8 * made[0]


def test_repeated_and_null_ids(spark, tables):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1, "i", 1), (5, v, 1, "i", 1), (3, v, 1, "i", 1), (None, v, 1, "i", 1), (9, [3.0, -1.0, 0.5], 1, "i", 1)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), str(r.kept)) for r in E.op1_embedding_near_dedup(spark, tables(rows)).collect())
    assert got == [("3", 3, "3", "True"), ("5", 3, "3", "False"), ("5", 3, "3", "False"), ("9", 0, "9", "True"), ("None", 0, "None", "None")]


def test_no_vectors(spark, tables):
    folder = tables(vectors()[:0])
    assert E.op1_embedding_near_dedup(spark, folder).count() == 0
    assert neighbours.op4_approximate_nearest_neighbours(spark, folder).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=8, max_size=8))
def test_lattice_point_is_nearest(x):
    x = np.array([x])
    c = E.e8_nearest(x)
    own = ((x - c / 2) ** 2).sum()
    assert c.sum() % 4 == 0 and (len(set(c[0] % 2)) == 1)
    assert own <= ((x - (c + E.ROOTS) / 2) ** 2).sum(axis=1).min() + 1e-9 and own <= 1 + 1e-9


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = rng.standard_normal((3000, 64))
    z -= (z * a).sum(axis=1)[:, None] * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1)[:, None]
    (oa, na), (ob, nb) = E.cells(a), E.cells(b)
    hit = (oa == ob) | (na == ob[:, :, None]).any(2) | (nb == oa[:, :, None]).any(2)
    assert hit.any(axis=1).mean() > 0.999


def brute_nearest(rows, k=5):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 50 == 0:
            out[q] = sorted((-(x @ y) / np.sqrt((x @ x) * (y @ y)), i) for i, y in good if i != q and len(x) == len(y))[:k]
    return out


def test_neighbours(spark, tables):
    rows = vectors(2, 500)
    rows += [(1000 + k, rows[0][1], 1, "i", 1) for k in range(12)]
    want = brute_nearest(rows)
    got = {}
    for r in neighbours.op4_approximate_nearest_neighbours(spark, tables(rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert set(got) == set(want)
    assert [i for _, i in got[0]] == [1000, 1001, 1002, 1003, 1004]
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))
    true = {(q, i): s for q in want for s, i in brute_nearest(rows, len(rows))[q]}
    assert all(s == pytest.approx(true[q, i], abs=1e-12) for q in got for s, i in got[q])


def test_fewer_candidates_than_asked(spark, tables):
    rows = [(0, [1.0, 0.0], 1, "i", 1), (50, [0.0, 1.0], 1, "i", 1), (3, [1.0, 1.0], 1, "i", 1)]
    got = neighbours.op4_approximate_nearest_neighbours(spark, tables(rows)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]


def clustered(n=6000, d=16, seed=4):
    """Vectors in tight clusters of about twenty."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 20, d))
    x = centres[np.arange(n) % (n // 20)] + 0.05 * rng.standard_normal((n, d))
    return [(k, x[k].astype(np.float32).tolist(), 1, "i", 1) for k in range(n)]


def test_structure_is_searched_in_few_leaves(spark, tables):
    rows = clustered()
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert neighbours.fitted_share(x, 5) < 0.4 < 0.8 < neighbours.fitted_share(np.random.default_rng(0).standard_normal((3000, 64)) / 8, 5)
    got = {}
    for r in neighbours.op4_approximate_nearest_neighbours(spark, tables(rows)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    right = 0
    for q in range(0, len(rows), 50):
        cos = x @ x[q]
        cos[q] = -2
        right += len(got[q] & set(np.argsort(-cos)[:5].tolist()))
    assert right >= 0.9 * 5 * len(got)


def test_a_share_of_all_trees_is_exact_whatever_the_depth(spark, tables, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 4)
    monkeypatch.setattr(neighbours, "SAMPLE", 40)
    rows = vectors(5, 400) + [(2000 + k, rows_[:7], 1, "i", 1) for k, rows_ in ((k, r[1]) for k, r in enumerate(vectors(6, 60)[:60]))]
    df = spark.read.parquet(f"{tables(rows)}/embeddings.parquet")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, share=4.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    good = [(i, np.array(v, float)) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    for q, a in good:
        if q % 50 == 0:
            want = sorted((-round(a @ b / np.sqrt((a @ a) * (b @ b)), 12), i) for i, b in good if i != q and len(a) == len(b))[:5]
            assert got[q] == [i for _, i in want], q


def test_parts_of_leaves_change_nothing(spark, tables, monkeypatch):
    rows = vectors(3, 400)
    folder = tables(rows)
    key = lambda df: sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())
    whole = key(neighbours.op4_approximate_nearest_neighbours(spark, folder))
    monkeypatch.setattr(neighbours, "HELD", 3)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    assert key(neighbours.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 50 == 0)) == whole
