"""URL filters, packing, quality, chat formatting, HTML extraction and mixing."""

import hashlib
import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwise.llm import chat, html_text, mixing, packing, quality, url_filter


# --- URL filters

URLS = [
    ("http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("https://a.www.example.com/en/?q=1", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://x.net/es/1#t", "x.net", "/es/1", "net/es/", "block"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, None),
    ("http://example.com/de/", "example.com", "/de/", "com/", "allow"),
    ("http://x.internet/es/", "x.internet", "/es/", None, None),
    ("x://É.NET?/es/", "É.net", "", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(u, "old", 1) for u, *_ in URLS], "url string, host string, page_id long")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()}
    for url, host, path, rule, verdict in URLS:
        assert got[url][:3] == (host, path, rule), url
        assert got[url][3] in ("allow", "block") and (verdict is None or got[url][3] == verdict)
    assert url_filter.filter_urls(df.where("false")).count() == 0


def test_url_model_separates_the_labelled_table():
    w = url_filter.train()
    held = [("cheap-pills.shop.example.org", "/x", 1), ("www.casino-bonus.example.net", "/", 1), ("city-library.example.org", "/books", 0), ("weather.example.net", "/de/3", 0)]
    for host, path, label in held:
        assert (url_filter.score(host, path, w) >= 0.5) == bool(label), host


def test_op2_equals_a_plain_version(spark, tmp_path):
    """Rules by hand, and the model's score n-gram by n-gram."""
    urls = [u for u, *_ in URLS] + [u for u, _ in url_filter.LABELLED[:300:7]] + ["http://free-bets.example.org/" + "x" * 20_000, "http://xyz.org/a b?c", "http://xyz.org/a b?c"]
    spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id long, url string, _rule string").write.parquet(str(tmp_path / "pages.parquet"))
    w, rules = url_filter.train(), [(h + p, h, p, v) for h, p, v in url_filter.RULES]
    rows = {r.page_id: r for r in url_filter.op2_url_filters(spark, str(tmp_path)).collect()}
    assert len(rows) == len(urls)
    for k, u in enumerate(urls):
        r = rows[k]
        host, path = url_filter.split(u or "") if u and "://" in u else ("", "")
        assert (r.host, r.path) == (host, path)
        fits = [x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])]
        best = max(fits, key=lambda x: len(x[0]), default=None)
        if best:
            assert (r.rule, r.verdict, r.block_score) == (best[0], best[3], None)
            continue
        found = {s for salt, text in ((1, host), (2, path)) for s in url_filter.grams([text], salt)[1].tolist()}
        score = 1 / (1 + np.exp(-(sum(w[s] for s in found) / np.sqrt(max(1, len(found))) + w[-1])))
        assert r.rule is None and r.block_score == pytest.approx(score) and r.verdict == ("block" if score >= 0.5 else "allow")
    assert url_filter.filter_urls(spark.read.parquet(str(tmp_path / "pages.parquet"))).columns == ["page_id", "url", "_rule", "host", "path", "rule", "verdict", "block_score"]


def test_url_model_on_sites_it_has_not_seen():
    """Trained without a fifth of the sites, the model tells their urls apart."""
    site = lambda u: url_filter.split(u)[0].removeprefix("www.").removeprefix("blog.").removeprefix("m.").split(".")[0]
    sites = sorted({site(u) for u, _ in url_filter.LABELLED})
    held = set(sites[::5])
    w = url_filter.train(tuple(x for x in url_filter.LABELLED if site(x[0]) not in held))
    rest = [(u, label) for u, label in url_filter.LABELLED if site(u) in held]
    hosts, paths = zip(*(url_filter.split(u) for u, _ in rest), strict=True)
    right = (url_filter.scores(list(hosts), list(paths), w) >= 0.5) == np.array([label == 1 for _, label in rest])
    assert len(rest) > 150 and right.mean() >= 0.85, right.mean()


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aB'st \n.,!<|>éÀ12\x1c")), max_size=60))
def test_ids_are_the_tokenizers(tokenizer, text):
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.ids_of(packing.default_tokenizer()).of(text), "<u4").tolist() == want


def test_ids_of_odd_texts(tokenizer):
    ids = packing.ids_of(packing.default_tokenizer())
    for t in ["I'll we've <|endoftext|>x", "x\x1cy", "ΑΣ İ ﬁ", "a" * 5000, "!!! ... ***%%%", "e\u0301 \u0301e", "日本語 テスト"]:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_pack_is_whole_and_good(lengths):
    bins = packing.pack(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= max(1, len(packing.best_fit(lengths, 100)))


def test_swaps_empty_bins():
    # best fit by itself leaves 50+45, 50+45, 5+5: moving and swapping fills the first two
    lengths = [50, 45, 50, 45, 5, 5]
    assert len(packing.improve([[0, 1], [2, 3], [4, 5]], lengths, 100)) == 2
    # one for two: 60 in place of 30 + 25
    assert len(packing.improve([[0], [1, 2, 3]], [60, 30, 25, 40], 100)) == 2
    give, take = packing._exchange([0], [1, 2, 3], [60, 30, 25, 40], 5)
    assert give == [0] and sorted(take) == [1, 2]


def test_search_ends_only_when_no_exchange_is_left():
    rng = random.Random(6)
    lengths = [rng.randint(450, 800) for _ in range(900)]
    bins = packing.pack(lengths)
    assert sorted(i for b in bins for i in b) == list(range(900)) and len(bins) < len(packing.best_fit(lengths, 2048))
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert max(fill) <= 2048
    by = sorted((b for b in range(len(bins)) if fill[b] < 2048), key=lambda b: fill[b])
    assert not any(packing._exchange(bins[x], bins[y], lengths, 2048 - fill[y]) for k, x in enumerate(by) for y in by[k + 1 :])


def test_packed_documents(spark, tokenizer):
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.choice([3, 40, 300, 5000])))) for k in range(60)] + [(60, None), (61, ""), (62, "x"), (62, "x"), (None, "y")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, piece int").repartition(3)
    rows = packing.pack_documents(df, group=20).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in by.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in texts[:62]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.id == i)
        import zlib

        want = [(n, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 2048))]
        assert own == want
    assert len([r for r in rows if r.id == 62]) == 2
    same = spark.createDataFrame([(None, "x y")] * 400, "doc_id long, text string")
    equal = packing.pack_documents(same, group=20)
    assert equal.count() == 400 and equal.select(F.shiftright("sequence_id", 32)).distinct().count() >= 15
    assert packing.pack_documents(df.where("false")).count() == 0


# --- quality


def labelled(spark, n=300):
    rng = random.Random(4)
    words = "the river rose slowly over many days and old bridge held until morning when people came".split()
    clean = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(8, 20))) + "."
    junk = [lambda: clean().upper().replace(" ", "!! "), lambda: clean().replace(" ", "*** "), lambda: " | ".join(clean().split()), lambda: " ".join([rng.choice(words)] * 15)]
    rows = []
    for k in range(n):
        bad = k % 4 == 0
        lines = [(junk[k // 4 % 4]() if bad and (j or k % 3) else clean()) for j in range(rng.randint(2, 6))]
        rows.append((k, "\n".join(lines), int(not bad), "z"))
    docs = spark.createDataFrame([(k, t, s) for k, t, _, s in rows], "doc_id long, text string, label string")
    return docs, spark.createDataFrame([(k, q, 0) for k, _, q, _ in rows], "doc_id long, quality int, toxic int"), {k: q for k, _, q, _ in rows}


def test_quality_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.scored(docs.repartition(5), model, ["doc_id", "label"]).collect()}
    held = [r.doc_id for r in docs.where(quality.fold(F.col("doc_id")) == 0).collect()]
    assert len(held) > 30
    assert np.mean([(got[k] >= quality.THRESHOLD) == truth[k] for k in held]) >= 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n\n\n"), (4, "word " * 100_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.scored(odd, model, ["doc_id"]).collect())
    assert quality.accepted(docs.where("false"), model).count() == 0
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert quality.scored(odd, None, ["doc_id"]).first().score == 1


def test_lines_and_messages():
    data = np.frombuffer(b"one\ntwo two\n" + b"" + b"x", np.uint8)
    x, size, first = quality.line_features(data, np.array([0, 12, 12, 13]))
    assert size.tolist() == [4, 8, 0, 1] and first.tolist() == [0, 2, 3, 4]
    rng = np.random.default_rng(0)
    e, good, bad = rng.normal(size=5), 0.7, 0.4
    f, b = quality.messages(e, np.array([0, 5]), good, bad)
    weight = {}
    for bits in range(32):
        y = [bits >> k & 1 for k in range(5)]
        weight[tuple(y)] = np.exp(sum(e[k] for k in range(5) if y[k]) + sum(good * (p and q) + bad * (not p and not q) for p, q in zip(y, y[1:], strict=False)))
    z = sum(weight.values())
    for k in range(5):
        assert 1 / (1 + np.exp(-(f + b)[k])) == pytest.approx(sum(w for y, w in weight.items() if y[k]) / z)


def test_lines_of_mixed_documents_keep_their_own_labels(spark):
    """Bad documents of clean and junk lines: clean lines stay good beside junk, and documents are told apart."""
    rng = random.Random(12)
    words = "the river rose slowly over many days and old bridge held until morning when people came".split()
    clean = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(8, 20))) + "."
    junk = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(8, 20)))

    def made(k):
        if k % 3:
            return [(clean(), 1) for _ in range(rng.randint(3, 9))], 1
        n = rng.randint(2, 4)
        lines = [(clean(), 1) for _ in range(n)] + [(junk(), 0) for _ in range(n + 1)]
        return (lines if k % 2 else lines[::-1]), 0

    docs = {k: made(k) for k in range(600)}
    df = spark.createDataFrame([(k, "\n".join(t for t, _ in lines)) for k, (lines, _) in docs.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(k, q) for k, (_, q) in docs.items()], "doc_id long, quality int")
    model = quality.train(df, labels)
    held = [r.doc_id for r in df.where(quality.fold(F.col("doc_id")) == 0).collect()]
    right = []
    for k in held:
        data = np.frombuffer("\n".join(t for t, _ in docs[k][0]).encode(), np.uint8)
        x, size, first = quality.line_features(data, np.array([0, len(data)]))
        right += [(p > 0.5) == bool(y) for p, (_, y) in zip(model.marginals(x, first), docs[k][0], strict=True)]
    assert np.mean(right) >= 0.95
    got = {r.doc_id: r.score for r in quality.scored(df, model, ["doc_id"]).collect()}
    assert np.mean([(got[k] >= quality.THRESHOLD) == docs[k][1] for k in held]) >= 0.95


def test_bad_documents_keep_bad_lines():
    p = np.array([0.9, 0.8, 0.7, 0.95, 0.9, 0.1])
    first, size = np.array([0, 3, 4, 6]), np.full(6, 9)
    assert quality.line_labels(p, size, first, np.array([0, 1, 0])).tolist() == [1, 0, 0, 1, 1, 0]


def test_op7_learns_from_training_folds_only(spark, tmp_path):
    docs, labels, truth = labelled(spark)
    odd = spark.createDataFrame([(None, "x"), (900, None), (901, ""), (902, "a b\n" * 3000)], "doc_id long, text string")
    held = quality.fold(F.col("doc_id")) == 0
    scores = []
    for k, wrong in enumerate((F.col("quality"), F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))):
        folder = str(tmp_path / str(k))
        docs.select("doc_id", "text").unionByName(odd).write.parquet(folder + "/documents.parquet")
        labels.withColumn("quality", wrong).write.parquet(folder + "/labels.parquet")
        rows = quality.op7_quality_classifier(spark, folder).collect()
        assert len(rows) == len(truth) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
        scores.append(sorted((str(r.doc_id), r.held_out, r.score) for r in rows))
    assert scores[0] == scores[1]
    known = {r.doc_id: r for r in rows if r.doc_id in truth}
    assert np.mean([(known[k].predicted == truth[k]) for k in truth if known[k].held_out]) >= 0.95


# --- chat

PIECES = st.sampled_from(["\\", "<|", "|>", "</s>", "[INST]", "[/INST]", "<|end|>\n", "<\\|", "a", "é", "\n", "<<SYS>>", "<", "|"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(PIECES, max_size=4).map("".join), st.lists(PIECES, max_size=8).map("".join)), min_size=1, max_size=5))
def test_chat_round_trip(turns):
    roles, texts = ([x[k] for x in turns] for k in (0, 1))
    strings, spans, _ = chat.assemble(pa.array(roles, pa.string()), pa.array(texts, pa.string()), np.zeros(len(turns), int))
    out = strings[0].as_py()
    assert chat.read_back(out) == turns
    inside = [chat.unescape(out.encode()[a:b]).decode() for a, b in zip(spans[0][::2], spans[0][1::2], strict=True)]
    assert inside == [t for r, t in turns if r == chat.TRAINED]
    for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert c not in out


def test_chats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "PART", 7)
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "x</s>\\", "é" * 3]), "p") for c in range(6) for t in range(30 if c == 3 else 3)]
    rows += [rows[0], (1, None, "user", "late", "p"), (1, 0, "assistant", "tie", "p"), (None, 0, "user", "whose", "p"), (None, 1, "assistant", "mine " * 50_000, "p"), (0, 9, "assistant", "é" * 100_000, "p")]
    spark.createDataFrame([(c, t, r, x, p) for c, t, r, x, p in rows], "conv_id long, turn long, role string, text string, part string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op9_chat_formatting(spark, str(tmp_path)).collect()}
    rows += [(-1, k, r, "</s>[INST] ok [/INST]", "") for k, r in enumerate(("user", "assistant"))]
    want = {}
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(own), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)), len(loss), sha(loss))
    assert got == want


# --- HTML

PAGE = """<html><head><title>T</title><script>x("<p>no</p>")</script></head><body><nav><a href=/>home</a></nav><div class="ad">buy</div>
<article><h1>The&nbsp;title &amp; more</h1><p>First  paragraph<br>goes
on with words enough to count.</p><aside>see also</aside><form><label>mail</label></form><p>Second &lt;one&gt; <a href="x">with a link</a>.<div class="comments"><p>A reader wrote this.</p></div></article><footer>&copy; nobody</footer>"""


def test_html():
    assert html_text.extract(PAGE) == "The title & more\nFirst paragraph goes on with words enough to count.\nSecond <one> with a link."
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<div><script>a</script></div>") == ""
    assert html_text.extract("a < b &am c") == "a < b &am c"
    assert html_text.extract("<p>unclosed <b>bold<p>next<") == "unclosed bold\nnext<"


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("<>/ap \"'=!-&;x\n"), max_size=80))
def test_any_markup_is_read(page):
    html_text.extract(page)


@given(st.lists(st.integers(-3, 3).map(float), max_size=20))
def test_best_region(scores):
    a, b = html_text.best_region(scores)
    best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert sum(scores[a:b]) == best


AROUND = "<article><p>First paragraph with words enough to count here.</p>%s<p>Second paragraph with words enough to count here.</p></article>"


@pytest.mark.parametrize("amid", [
    "<svg class='icon'/>", "<object data='x'/>", "<svg><svg></svg>no</svg>", "<script src=x />", "<svg>", "<template><template>a</template>b</template>", "<object><object>a</object>b",
    "<SVG><path d='M0'/></SVG>", "<script>a < b</script >", "<style>p{}</style\n>", "<canvas/><math/>", "<!-- <p>no</p> -->",
])
def test_raw_elements_take_no_text_with_them(amid):
    want = "First paragraph with words enough to count here.\nSecond paragraph with words enough to count here."
    got = html_text.extract(AROUND % amid)
    assert got.split("\n")[0] + "\n" + got.split("\n")[-1] == want


def test_inline_elements_add_no_space():
    assert html_text.extract(AROUND % "<p>foo<img>bar <b>b</b>old</p>").split("\n")[1] == "foobar bold"


@pytest.mark.parametrize("piece", ["<span>x ", "<div class=a>x ", "<li><ul>x ", "<svg>", "<svg/>", "</x>", '<a b=">', "<script/>"])
def test_pages_of_any_depth_are_read_in_linear_time(piece):
    start = time.time()
    html_text.extract("<p><td>" + piece * 100_000 + "<hr>" * 20_000)
    assert time.time() - start < 5


def test_the_region_of_whole_pages_is_the_best_of_all(spark, sf_dir):
    """Every region of a page is tried, and the query's text is that of the best one."""
    w = html_text.weights()
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(40).collect()
    got = {r.page_id: r.text for r in html_text.op10_html_extraction(spark, sf_dir).collect()}
    for row in rows:
        parts = w.tokens(row.html)
        scores = np.array([len(v.split()) * w.likely(place) if kind == "text" else w.cost(v) for kind, v, place, _ in parts])
        sums = np.r_[0, np.cumsum(scores)]
        best = max(float((sums[i:] - sums[i]).max()) for i in range(len(sums)))
        a, b = html_text.best_region(scores.tolist())
        assert sums[b] - sums[a] == pytest.approx(best, abs=1e-9)
        blocks = [[]]
        for kind, value, place, edge in parts[a:b]:
            if kind == "text" and w.likely(place) >= 0.5:
                blocks[-1].append(value)
            elif edge:
                blocks.append([])
            elif kind == "tag" and value[0].strip("/") in ("br", "td", "th"):
                blocks[-1].append(" ")
        assert got[row.page_id] == "\n".join(x for x in (" ".join("".join(y).split()) for y in blocks) if x)


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.n_chars == len(r.text)) for r in html_text.extract_pages(df).collect())
    assert got == [("1", True), ("1", True), ("None", True)]
    assert html_text.extract_pages(df.where("false")).count() == 0


# --- mixing


def test_mixing_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    cursor = con.execute(mixing.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    got = mixing.op6_source_mixing(spark, sf_dir).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(cursor.fetchall())


def test_raking_meets_targets(spark):
    rows = [(k, "x" * (4 + k % 9), ["a", "b", None][k % 3], ["en", "fr"][k % 5 == 0], 3) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long")
    goal = {"source": {"a": 0.5, "b": 0.3, None: 0.2}, "lang": {"en": 0.5, "fr": 0.5}}
    out = mixing.mixed(df, goal, share=None)
    sums = {(r[0] or "=(null)")[1:]: r[1] for d in ("_source", "_lang") for r in out.groupBy(d).agg(F.sum(F.col("_tokens") * F.col("_weight"))).collect()}
    total = sums["en"] + sums["fr"]
    for d in goal.values():
        for k, share in d.items():
            assert sums[k or "(null)"] / total == pytest.approx(share, abs=1e-4)
    assert out.where("_probability > 1 or _probability < 0").count() == 0 and out.agg(F.max("_probability")).first()[0] == 1
    assert mixing.sample_mix(df).columns == df.columns


def test_a_stray_row_does_not_empty_the_mix(spark):
    rows = [(k, "x" * (400 + k % 9), "ab"[k % 3 == 0], ["en", "fr"][k % 5 == 0]) for k in range(3000)]
    kept = []
    for stray in ([], [(9000, "x" * 12, None, "en")], [(9000, "x" * 12, None, None)]):
        out = mixing.mixed(spark.createDataFrame(rows + stray, "doc_id long, text string, source string, lang string"))
        expected, total = out.agg(F.sum(F.col("_tokens") * F.col("_probability")), F.sum("_tokens")).first()
        assert expected >= (mixing.SHARE - 1e-6) * total
        kept.append(out.where("_sampled").count() / 3000)
    assert min(kept) >= 0.45, kept


def test_cut_leaves_the_share_asked_for(spark):
    rng = random.Random(3)
    cells = [(float(rng.randint(0, 1000)), rng.choice([0.0, 0.2, 1.0, 3.0, 900.0]) * rng.random()) for _ in range(60)]
    df = spark.createDataFrame(cells, "n double, w double")
    for share in (0.01, 0.3, 0.5, 0.9, 1.0):
        cut = mixing.cut_of(df, share)
        total, top = sum(n for n, w in cells if w > 0), max(w for n, w in cells if n)
        left = lambda c: sum(n * min(1, w / c) for n, w in cells)
        assert left(cut) == pytest.approx(max(share * total, left(top)), rel=1e-6) and cut <= top


def test_mixing_keeps_columns_by_its_own_names(spark):
    rows = [(k, "x" * 40, s, "en", "mine", 1, True) for k in range(40) for s in ("a", "(null)", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _source string, _tokens int, __sampled boolean")
    out = mixing.sample_mix(df, share=1.0)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(rows, key=str)
    full = mixing.mixed(df)
    assert full.columns[: len(df.columns)] == df.columns and full.select("___source").distinct().count() == 4


def test_mixing_with_given_tokens_and_until_it_agrees(spark):
    rows = [(k, "x" * (1 + k % 7), "abc"[k % 3], "uv"[k % 5 > 1], 10 + k % 4) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n long")
    goal = {"source": {"a": 0.6, "b": 0.3, "c": 0.1}, "lang": {"u": 0.9, "v": 0.1}}
    out = mixing.mixed(df, goal, tokens="n", rounds=40, tolerance=1e-7)
    assert out.agg(F.sum("_tokens")).first()[0] == sum(r[4] for r in rows)
    sums = {r[0]: r[1] for r in out.groupBy("_source").agg(F.sum(F.col("_tokens") * F.col("_weight"))).collect()}
    assert sums["=a"] / sum(sums.values()) == pytest.approx(0.6, abs=1e-6)


def test_what_is_sampled_grows_with_the_corpus(spark):
    taken = []
    for n in (2000, 8000):
        rows = [(k, "y" * (100 + k % 50), f"s{min(k % 13, k % 7)}", "en" if k % 3 else "fr") for k in range(n)] + [(-1, "z", "rare", None), (-2, None, None, "rare")]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
        taken.append(mixing.sample_mix(df).count())
    assert 3.4 * taken[0] < taken[1] < 4.6 * taken[0]


def test_mixing_without_tokens(spark):
    df = spark.createDataFrame([(1, None, None, None), (None, "", "s", "en"), (1, None, None, None)], "doc_id long, text string, source string, lang string")
    assert mixing.mixed(df).count() == 3
    assert mixing.sample_mix(df.where("false")).count() == 0
