"""Every stage of the pipeline against a brute-force version on its own input."""

import pytest
from test_text_dedup import brute_cut, brute_groups

import corpus_pipeline
from driftwise.llm import mixing, quality
from driftwise.llm.shared import stored, table


@pytest.fixture(scope="module")
def steps(spark):
    folder = "/root/testdata/sf0.001"
    frames = [table(spark, folder, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], folder)))
    return folder, frames


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(steps):
    _, frames = steps
    assert all(f.columns == frames[0].columns for f in frames[1:-1])


def test_quality_stage(spark, steps):
    folder, (docs, kept, *_) = steps
    labels = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    left = {i for i, _ in texts(kept)}
    known = [i for i, _ in texts(docs) if i in labels]
    assert sum((i in left) == labels[i] for i in known) >= 0.95 * len(known)
    model = quality.train(docs, table(spark, folder, "labels"))
    assert left == {r.doc_id for r in quality.scored(docs, model, ["doc_id"]).where(f"score >= {quality.THRESHOLD}").collect()}


def test_near_dedup_stage(steps):
    _, frames = steps
    groups = brute_groups(texts(frames[1]))
    assert {i for i, _ in texts(frames[2])} == {i for i, (_, c) in groups.items() if c == i}


def test_suffix_stage(steps):
    _, frames = steps
    cut = brute_cut(texts(frames[2]))
    for r in frames[3].collect():
        n, gone, spans, _ = cut[r.doc_id]
        assert n - gone - 6 * spans <= len(r.text.encode()) <= n - gone
        assert r.n_chars == len(r.text)


def test_mixing_stage(steps):
    _, frames = steps
    assert {r.doc_id for r in mixing.mixed(frames[3]).where("_sampled").collect()} == {i for i, _ in texts(frames[4])}


def test_packing_stage(steps):
    _, frames = steps
    rows = frames[5].collect()
    assert {r.doc_id for r in rows} == {i for i, _ in texts(frames[4])}
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= sum(fill.values()) / 2048 + 2


def test_stages_take_nulls_repeats_and_clashing_names(spark, tmp_path):
    long = "word after word goes on and on without an end in sight " * 4000
    rows = [(k, t, l, s, 3, "mine", 1, "b", True) for k, (t, l, s) in enumerate([("a few words that nobody else has", "en", "s"), (None, None, None), ("", "", ""), (long, "en", None), (long, None, "s"), ("| a | b |", "fr", "s")])]
    rows += [rows[0], (None, "text without an id of its own", "en", "s", 1, "x", 1, "b", False), (1, "another text of id one", "en", "s", 1, "x", 1, "b", False)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _source string, n long, bucket string, __sampled boolean"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = spark.createDataFrame(rows, schema)
    counts = []
    for given in (df, df.where("false")):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == given.columns, name
            counts.append(docs.count())
    assert counts[0] == 9 and counts[1] == 7 and counts[2] == 7 and 0 < counts[3] <= 7 and counts[5:] == [0] * 5


def test_run_is_the_stages_in_turn(spark, steps):
    folder, frames = steps
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(frames[-1])
