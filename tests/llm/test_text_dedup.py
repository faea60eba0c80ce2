"""MinHash and suffix-array dedup against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwise.llm import bytes_of, minhash_dedup, suffix_dedup
from driftwise.llm.shared import connected_components

SCHEMA = "doc_id long, text string, n long, bucket string, id string"


def docs_of(spark, texts):
    """Documents with further columns by names that the operators use inside."""
    return spark.createDataFrame([(i, t, 7, "b", "x") for i, t in texts], SCHEMA).repartition(3)


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_groups(texts, percent=80):
    sets = {i: shingle_set(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_cut(texts, length=50):
    first = {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        for q in range(len(b) - length + 1):
            first.setdefault(b[q : q + length], i)
    out = {}
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - length + 1):
            if first[b[q : q + length]] < i:
                gone[q : q + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Ünïcode", "É", "x　y"]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 120))] for _ in range(12)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for k in range(90):
        w = list(base[k % 12])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        t = " ".join(w)
        if k % 4 == 0:
            t = t[: len(t) // 2] + "\n" + passage + " " + t[len(t) // 2 :]
        texts.append((k, t.upper() if k % 17 == 0 else t))
    return texts + [(100, None), (101, ""), (102, " \t\n "), (103, "one two"), (104, "ONE\x0btwo"), (105, "one"), (106, "a " * 30_000), (107, "a " * 29_000)]


def test_near_groups_equal_brute_force(spark):
    texts = corpus()
    got = {r.id: (r.n_shingles, r.component) for r in minhash_dedup.near_groups(docs_of(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_many_near_copies_take_several_rounds(spark):
    rng = random.Random(5)
    base = [f"v{k}" for k in range(150)]
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(150)] = f"u{rng.randrange(10**6)}"
        texts.append((k, " ".join(w)))
    got = {r.id: (r.n_shingles, r.component) for r in minhash_dedup.near_groups(docs_of(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (3, "")]
    df = docs_of(spark, rows)
    got = sorted((str(r.id), str(r.component), r.n_shingles) for r in minhash_dedup.near_groups(df).collect())
    assert got == [("1", "1", 2), ("1", "1", 2), ("2", "1", 2), ("3", "3", 0), ("3", "3", 0), ("None", "None", 2)]
    kept = minhash_dedup.keep_one(df)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "3", "None"] and kept.columns == df.columns


def test_texts_that_share_an_id_are_judged_each(spark):
    a, b, c = ("the first text has these very words", "quite unrelated words stand in the other text here", "and a third one of its own goes last")
    rows = [(1, a), (2, a), (2, b), (3, c), (7, a), (7, c), (7, b), (2, c)]
    df = docs_of(spark, rows)
    got = {(r.id, r.print): r.component for r in minhash_dedup.near_groups(df).collect()}
    assert sorted(got.values()) == [1, 1, 1, 2, 2, 2, 2, 2] and len(got) == 8
    assert sorted((r.doc_id, r.text) for r in minhash_dedup.keep_one(df).collect()) == [(1, a), (2, c), (2, b)]


def template_texts(v, seed=9):
    """Sixty common words with three slots of ``v`` words each: close to the threshold, but not over it at 85 %."""
    rng = random.Random(seed)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(v**3):
        w = list(common)
        for slot, x in ((10, k % v), (30, k // v % v), (50, k // v // v)):
            w.insert(slot, f"s{slot}v{x}")
        rows.append((k, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("square", [256, 7])
def test_template_texts(spark, monkeypatch, square):
    monkeypatch.setattr(minhash_dedup, "SQUARE", square)
    texts = template_texts(4)
    for percent in (80, 85):
        got = {r.id: (r.n_shingles, r.component) for r in minhash_dedup.near_groups(docs_of(spark, texts), percent).collect()}
        assert got == brute_groups(texts, percent), percent


def test_op3_equals_brute_force(spark, tmp_path):
    texts = corpus(11)
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.op3_minhash_near_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute_groups(texts, 85).items()}


def test_empty_tables(spark):
    df = docs_of(spark, [(1, "a")]).where("false")
    assert minhash_dedup.near_groups(df).count() == 0
    assert suffix_dedup.cut_repeats(df).count() == 0
    assert suffix_dedup.strip_repeats(df).count() == 0


@pytest.mark.parametrize("crowd", [4000, 2])
def test_cut_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    texts = corpus(4)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(docs_of(spark, texts)).collect()}
    assert got == brute_cut(texts)


@pytest.mark.parametrize("crowd", [4000, 1])
def test_cut_all_copies_within_a_document(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    texts = []
    for k, size in enumerate([52, 60, 150]):
        p, x, y = some(size), some(40), some(40)
        texts += [(10 * k + 3, y + p), (10 * k + 5, (x + p) * 20), (10 * k + 6, some(9) + x + p + some(9)), (10 * k + 7, x + p + y + p + x + p)]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(docs_of(spark, texts)).collect()}
    assert got == brute_cut(texts)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6))
def test_op8_equals_brute_force(spark, tmp_path_factory, seed):
    """Documents made of few passages, whole or in part, many times over within one and across."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdefgé \n") for _ in range(n))
    passages = [some(rng.randint(30, 200)) for _ in range(12)]

    def piece():
        p = rng.choice(passages)
        a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
        return rng.choice([p, p, p[a:], p[a:b], some(rng.randint(0, 30))])

    texts = [(k, "".join(piece() for _ in range(rng.choice([0, 1, 3, 12])))) for k in rng.sample(range(1000), 120)]
    folder = str(tmp_path_factory.mktemp("op8"))
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(folder + "/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op8_suffix_array_dedup(spark, folder).collect()}
    assert got == brute_cut(texts)


def test_cut_rows_that_share_an_id(spark):
    a, b = "x" * 30 + "0123456789" * 8, "y" * 30 + "0123456789" * 8
    rows = [(1, a), (1, b), (1, a), (2, "z" * 10 + b), (None, b)]
    got = sorted((str(r.id), r.n_removed) for r in suffix_dedup.cut_repeats(docs_of(spark, rows)).collect())
    assert got == [("1", 0), ("1", 0), ("1", 0), ("2", len(b)), ("None", 0)]


def test_strip_keeps_rows_and_whole_characters(spark):
    long = "é" * 60
    out = {r.doc_id: r for r in suffix_dedup.strip_repeats(docs_of(spark, [(1, long), (2, "ab" + long + "z"), (3, None), (4, "cd" + long + "ü")])).collect()}
    # the first byte of ü is that of é, and goes with the passage
    assert out[1].text == long and out[2].text == "abz" and out[4].text == "cd" and out[3].text is None and out[2].bucket == "b"


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    texts = [(1, body), (2, body[1000:3000] + "#" + body[4000:4049] + "#" + body[5000:5050]), (3, "q" + body)]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.cut_repeats(docs_of(spark, texts)).collect()}
    assert got == brute_cut(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.data())
def test_longest_previous_factor(lcp, data):
    lcp = np.array([0, *lcp[1:]])
    rank = np.array(data.draw(st.lists(st.integers(0, 5), min_size=len(lcp), max_size=len(lcp))))
    want = [max([0, *(min(lcp[min(i, j) + 1 : max(i, j) + 1]) for j in range(len(lcp)) if rank[j] < rank[i])]) for i in range(len(lcp))]
    assert suffix_dedup.longest_previous_factor(lcp, rank).tolist() == want
    assert suffix_dedup.longest_previous_factor(lcp, rank, 3).tolist() == [x if x >= 3 else 0 for x in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB \n\t\x0b\x1cÉ　", max_size=30)), max_size=6))
def test_shingles_are_those_of_the_words(texts):
    got = {row: len(p) for row, p in bytes_of.shingles(pa.array(texts, pa.string()))}
    assert got == {k: len(shingle_set(t)) for k, t in enumerate(texts)}


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    c = minhash_dedup.Circulant.get()
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    b = np.r_[a[:920], rng.integers(0, 2**63, 80, dtype=np.uint64)]
    assert abs((c.signature(a) == c.signature(b)).mean() - 920 / 1080) < 0.1


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(200 + k, 200) for k in range(1, 80)] + [(1, 5), (5, 9), (9, 1), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = defaultdict(int) | {k: 100 for k in range(100, 161)} | {k: 200 for k in range(200, 280)} | {1: 1, 5: 1, 9: 1}
    assert got == dict(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
