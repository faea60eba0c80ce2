"""HTML extraction by the maximum-scoring subsequence of a page's tokens.

A page becomes a sequence of tags and words. Words score positive, the more the
likelier their place in the page (the elements around them, with their class,
id and role names) is to hold an article; tags score negative, the more the
rarer they stand inside articles. Both weights come from the labelled pages
built below. One linear scan finds the contiguous region with the highest sum.
Text of that region is written out block by block, without what stands inside
elements whose words the same weights call unlikely (a form or a reader comment
amid the article).
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sliced, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup and no text of the page.
RAW = frozenset("script style noscript template iframe svg math object canvas".split())
#: Of these, those whose content is text, so that none stands in another of its name and a slash at the end of the tag closes nothing.
TEXT_ONLY = frozenset("script style noscript iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody tfoot thead title tr ul".split()
)
#: An opening tag of the key ends an open element of the values.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"body", "head", "html", "title", "option", "optgroup", "caption", "tbody", "tfoot", "thead", "tr", "legend"}
#: Where the search for an element to end stops.
WALLS = frozenset("table ul ol dl article section div main body td th blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|$)|(?P<text>(?:[^<]+|<(?![a-zA-Z/!?]))++)",
    re.S,
)
_ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Place:
    """Where a token stands: an open element, the one around it, and the evidence of the marks of both.

    ``z`` is the sum over the path's different marks of the weights of ``Weights``, so it is found once per element.
    """

    __slots__ = ("around", "name", "marks", "z", "p")

    def __init__(self, around: Place | None, name: str, marks: tuple[str, ...], z: float):
        self.around, self.name, self.marks, self.z, self.p = around, name, marks, z, None

    def path(self) -> tuple[str, ...]:
        """The marks of all open elements, outermost first."""
        own: list[tuple[str, ...]] = []
        at: Place | None = self
        while at is not None:
            own.append(at.marks)
            at = at.around
        return tuple(m for marks in reversed(own) for m in marks)


class Open:
    """The open elements. Every step costs the same at any depth: positions by name and of walls are kept."""

    def __init__(self, weight: dict[str, float] | None = None, bias: float = 0.0):
        self.weight = weight or {}
        self.stack: list[Place] = [Place(None, "", (), bias)]
        self.at: dict[str, list[int]] = {}
        self.walls: list[int] = []
        self.held: dict[str, int] = {}

    def push(self, name: str, marks: tuple[str, ...]) -> None:
        top, z = self.stack[-1], self.stack[-1].z
        for m in marks:
            k = self.held.get(m, 0)
            if not k:
                z += self.weight.get(m, 0.0)
            self.held[m] = k + 1
        self.at.setdefault(name, []).append(len(self.stack))
        if name in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append(Place(top, name, marks, z))

    def cut(self, position: int) -> None:
        """Ends the element at a position and all within it."""
        while len(self.stack) > position:
            gone = self.stack.pop()
            self.at[gone.name].pop()
            if gone.name in WALLS:
                self.walls.pop()
            for m in gone.marks:
                self.held[m] -= 1

    def last(self, names) -> int:
        """The innermost position of an open element of these names, 0 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)


class Raw:
    """Where the content of ``RAW`` elements of a page ends."""

    def __init__(self, page: str):
        self.page, self.last_end = page, {}

    def end(self, at: int, name: str, closed: bool) -> int:
        """For an element that opens before ``at``; ``closed``: its tag ends in a slash."""
        if closed and name not in TEXT_ONLY:
            return at
        if name not in self.last_end:
            self.last_end[name] = max((m.start() for m in re.finditer(rf"</{name}[\s/>]", self.page, re.I)), default=-1)
        if self.last_end[name] < at:
            # a text runs to the end of the page; of others the tag alone is left out, so no text is lost
            return len(self.page) if name in TEXT_ONLY and not closed else at
        if name in TEXT_ONLY:
            return _tag_end(self.page, re.compile(rf"</{name}[\s/>]", re.I).search(self.page, at).end())
        depth, first = 1, at
        for tag in re.compile(rf"<(/?){name}(?=[\s/>])(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>", re.I).finditer(self.page, at):
            if tag[1]:
                depth -= 1
                first = tag.end() if first == at else first
                if not depth:
                    return tag.end()
            elif not tag[0].endswith("/>"):
                depth += 1
        return first  # out of balance: up to the first end tag


def _tag_end(page: str, at: int) -> int:
    """Behind the ``>`` that ends an end tag whose name and one character more are read."""
    if page[at - 1] == ">":
        return at
    end = page.find(">", at)
    return len(page) if end < 0 else end + 1


def tokens(page: str, weight: dict[str, float] | None = None, bias: float = 0.0) -> Iterator[tuple[str, object, Place, bool]]:
    """(kind, value, place, block edge): kind is 'tag' (value: its marks) or 'text' (value: decoded text).

    A mark is a tag's name, or a word of its class, id or role after a dot.
    """
    now, raw = Open(weight, bias), Raw(page)
    at = 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m["text"] is not None:
            yield "text", entities.unescape(m["text"]), now.stack[-1], False
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if now.at.get(name):
                now.cut(now.at[name][-1])
            yield "tag", ("/" + name,), now.stack[-1], name in BLOCK
            continue
        if name in RAW:
            at = raw.end(at, name, m["attrs"].endswith("/"))
            yield "tag", (name,), now.stack[-1], False
            continue
        ends = ENDS.get(name, set()) | ({"p"} if name in CLOSES_P else set())
        inner = now.last(ends)
        if inner and inner >= (now.walls[-1] if now.walls else 0):
            now.cut(inner)
        marks = [name]
        if m["attrs"]:
            for values in _ATTR.findall(m["attrs"]):
                marks += ["." + w for w in _NAME.findall("".join(values).lower())]
        if name not in VOID and not m["attrs"].endswith("/"):
            now.push(name, tuple(marks))
        yield "tag", tuple(marks), now.stack[-1], name in BLOCK


# Labelled pages: parts of pages, those of the article marked, laid out in several ways.
_PROSE = "the river rose slowly over many days and the old bridge held until the morning when people came to look at the water below"
_SMALL = "read more here now"
_OUTSIDE = (
    "<header class='site-header'><a href='/'>{s}</a></header>", "<nav><ul><li><a href='/a'>{s}</a></li><li><a href='/b'>{s}</a></li></ul></nav>",
    "<div class='menu' id='menu'><a href='/x'>{s}</a> <a href='/y'>{s}</a></div>", "<div class='navbar' role='navigation'><ul><li>{s}</li></ul></div>",
    "<div class='breadcrumbs'><a href='/'>{s}</a></div>", "<div class='ad'>{p}</div>", "<div class='advert banner sponsored ads advertisement promo'>{p}</div>",
    "<div class='cookie notice consent banner' role='alert'><p>{p}</p><button>{s}</button></div>", "<div class='popup modal alert warning'><p>{p}</p></div>",
)
_AFTER = (
    "<aside class='sidebar'><h3>{s}</h3><ul><li><a href='/z'>{s}</a></li></ul><p>{p}</p></aside>", "<div id='sidebar' class='widget related recommended'><p>{p}</p></div>",
    "<section class='comments' id='comments'><h2>{s}</h2><div class='comment'><p>{p}</p></div><div class='comment reply discussion'><p>{p}</p></div></section>",
    "<form action='/s'><label>{s}</label><input name='q'><select><option>{s}</option></select><textarea>{s}</textarea><button>{s}</button></form>",
    "<div class='newsletter signup subscribe'><p>{p}</p></div>", "<div class='share social'><a href='/t'>{s}</a></div>",
    "<footer>&copy; {s} &middot; {p}</footer>", "<div class='footer copyright legal' id='footer' role='contentinfo'><p>{p}</p></div>",
)
#: Names of what is no article, each also met alone amid one.
_NAMES = (
    "ad ads advert advertisement banner promo sponsored sponsor menu nav navbar navigation breadcrumb breadcrumbs sidebar widget related recommended comment comments reply discussion "
    "respond disqus cookie cookies consent notice alert warning popup modal overlay newsletter signup subscribe share sharing social footer copyright legal disclaimer login search toolbar pagination pager"
).split()
_ALONE = tuple(f"<div class='{n}'><p>{{p}}</p></div>" for n in _NAMES) + tuple(f"<{t}><p>{{p}}</p></{t}>" for t in ("aside", "nav", "footer", "form", "dialog"))
_BODY = "<h1>{p}</h1><p><b>{s}<br><p>{p} <a href='/l'>{p}</a> {p}</p><h2>{s}</h2><p>{p} <em>{s}</em> {p}</p><ul><li>{p}</li><li>{p}</li></ul><blockquote><p>{p}</p></blockquote><table><tr><td>{s}</td></tr></table><figure><figcaption>{p}</figcaption></figure><pre>{p}</pre><p>{p}</p><h3>{s}</h3><div>{p}</div>"
_HOLDERS = (
    "<article>{}</article>", "<main>{}</main>", "<main><article class='post entry'>{}</article></main>", "<div class='content' id='content'>{}</div>", "<div id='main' role='main'>{}</div>",
    "<section class='article body story text'>{}</section>", "<section>{}</section>", "<div class='post'>{}</div>", "<div class='entry'>{}</div>", "<div class='post-body'>{}</div>", "<div class='page'><div>{}</div></div>", "<div>{}</div>", "{}", "<div class='wrapper page container'><div class='article content post'>{}</div></div>", "<article itemprop='articleBody'><header><h1>{{p}}</h1></header>{}</article>",
)


def labelled_pages() -> list[list[tuple[str, bool]]]:
    """Every holder of an article between all that may stand before and after it, as (html, is article) parts."""
    fill = lambda x: x.replace("{p}", _PROSE).replace("{s}", _SMALL)
    pages = []
    for holder in _HOLDERS:
        opening, closing = holder.replace("{{", "{").replace("}}", "}").split("{}")
        head = f"<!DOCTYPE html><html><head><title>{_SMALL}</title></head><body>"
        pages.append([(head + fill("".join(_OUTSIDE)), False), (fill(opening + _BODY + closing), True), (fill("".join(_AFTER)) + "</body></html>", False)])
        # what doesn't belong to it may also stand inside its holder
        pages.append([(head + fill("".join(_OUTSIDE) + opening), False), (fill(_BODY), True), (fill("".join(_ALONE) + _AFTER[0] + _AFTER[2] + _AFTER[3] + _AFTER[4]), False), (fill(_BODY + closing), True), (fill("".join(_AFTER)) + "</body></html>", False)])
    return pages


class Weights:
    def __init__(self, pages: list[list[tuple[str, bool]]] | None = None, rounds: int = 1500, rate: float = 0.5):
        rows: list[tuple[tuple[str, ...], int, bool]] = []
        # pages in which a mark stands inside an article, and in which it stands at all
        inside, seen = defaultdict(set), defaultdict(set)
        for number, page in enumerate(pages if pages is not None else labelled_pages()):
            # each part is marked by an attribute-free pair of characters that no part holds
            text = "".join(f"\x02{int(own)}{part}" for part, own in page)
            own = False
            for kind, value, place, _ in tokens(text):
                if kind == "text":
                    for k, piece in enumerate(re.split("\x02([01])", value)):
                        if k % 2:
                            own = piece == "1"
                        elif piece.split():
                            rows.append((tuple(dict.fromkeys(place.path())), len(piece.split()), own))
                else:
                    for mark in value:
                        seen[mark].add(number)
                        if own:
                            inside[mark].add(number)
        names = {m: i for i, m in enumerate(sorted({m for places, _, _ in rows for m in places}))}
        at = np.array([names[m] for places, _, _ in rows for m in places])
        of = np.repeat(np.arange(len(rows)), [len(places) for places, _, _ in rows])
        n = np.array([w for _, w, _ in rows], float)
        y = np.array([o for _, _, o in rows], float)
        n = np.where(y == 1, n / n[y == 1].sum(), n / n[y == 0].sum())
        share = {m: len(inside[m]) / len(seen[m]) for m in seen}
        # marks that articles hold wherever they occur are no evidence against one
        plain = np.array([share.get(m, 0) == 1 for m in names])
        w, bias = np.zeros(len(names)), 0.0
        for _ in range(rounds):
            z = np.bincount(of, w[at], len(rows)) + bias
            g = n * (1 / (1 + np.exp(-z)) - y)
            w -= rate * 4 * (np.bincount(at, g[of], len(names)) + 2e-4 * w)
            w[plain] = np.maximum(w[plain], 0)
            bias -= rate * g.sum()
        self.place = {m: float(w[i]) for m, i in names.items()}
        self.bias = float(bias)
        #: cost of a tag: more for tags that stand outside articles
        self.tag = {m: -(0.01 + 0.2 * (1 - share[m]) ** 2) for m in seen}

    def tokens(self, page: str) -> list[tuple[str, object, Place, bool]]:
        return list(tokens(page, self.place, self.bias))

    @staticmethod
    def likely(place: Place) -> float:
        """Probability that words at this place belong to an article."""
        if place.p is None:
            place.p = 1 / (1 + math.exp(-max(-30.0, min(30.0, place.z))))
        return place.p

    def cost(self, marks: tuple[str, ...]) -> float:
        return min((self.tag.get(m, -0.05) for m in marks), default=-0.05)


@lru_cache(maxsize=1)
def weights() -> Weights:
    return Weights()


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest sum; of equal ones the longest that ends first."""
    best, low, start, at = 0.0, 0.0, 0, (0, 0)
    total = 0.0
    for i, s in enumerate(scores):
        total += s
        if total - low > best:
            best, at = total - low, (start, i + 1)
        if total < low:
            low, start = total, i + 1
    return at


def extract(page: str | None, w: Weights | None = None) -> str:
    w = w or weights()
    if not page:
        return ""
    parts = w.tokens(page)
    scores = [len(v.split()) * w.likely(place) if kind == "text" else w.cost(v) for kind, v, place, _ in parts]
    start, end = best_region(scores)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    for kind, value, place, edge in parts[start:end]:
        if kind == "text":
            if w.likely(place) >= 0.5:
                line.append(value)
        elif edge:
            flush()
        elif value[0] in ("br", "td", "th", "/td", "/th"):
            line.append(" ")
    flush()
    return "\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = weights()
    for batch in sliced(batches):
        texts = [extract(h, w) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.large_string()).cast(pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row; null or empty html, and pages without words, give an empty text.

    Repeated rows and null ids pass through; other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return extract_pages(table(spark, sf_dir, "pages"))
