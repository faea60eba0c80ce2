"""URL filters: stated rules first, then logistic regression on hashed character n-grams.

Rules and the splitting of urls are built-in expressions. The method's model is
trained on the driver from the small labelled table ``LABELLED`` (its size is
fixed in the code) by full-batch gradient descent on L2-regularised logistic
loss over n-grams of 3 to 5 characters of host and path, hashed to ``2**BITS``
weights. Its weights travel as one array of that fixed size.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytes_of import POWERS, mix, prefix
from .shared import table

BITS, GRAMS = 18, (3, 4, 5)
#: (host, path, verdict); the longest fitting rule wins.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Words of sites to block and of sites to allow; sites are single words and pairs of them.
_BAD_WORDS = (
    "casino poker bets betting slots jackpot lottery win winner cash bonus free prizes deals cheap pills pharmacy viagra loans payday credit adult porn sexy cams xxx escort "
    "spam farm clicks tracker track tracking ads adserver popunder crack serials warez keygen replica watches miracle diet crypto doubler"
).split()
_GOOD_WORDS = (
    "library news university recipes museum research wiki garden weather history science docs council journal school theatre music travel mountain river bridge street market kitchen "
    "letters physics forest harbour village energy railway hospital society archive open data north south blue stone paper"
).split()


def _sites(words: list[str]) -> list[str]:
    n = len(words)
    return words + [f"{w}-{words[(k * 7 + 3) % n]}" for k, w in enumerate(words)] + [w + words[(k * 11 + 5) % n] for k, w in enumerate(words)]


def _names(n: int = 600) -> list[str]:
    """Made-up names, which say nothing: to allow."""
    parts = "al an ar be ca co de el en er es fi ga ha in is ka la le lo ma me mi na ne no on or ou pa ra re ri ro sa se sh st ta te th ti to un ur va ve vi wo".split()
    rng = random.Random(17)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(n)]


_BAD, _GOOD = _sites(_BAD_WORDS), _sites(_GOOD_WORDS) + _names()
_PATHS_BAD = ("/en/1", "/buy/pills", "/win/bonus", "/xxx/free.html", "/promo/click-here", "/de/77", "/es/9/")
_PATHS_GOOD = ("/en/1", "/articles/2024/spring", "/wiki/river", "/fr/12.html", "/about", "/de/77", "/es/9/")

#: The labelled table: (url, 1 to block, 0 to allow). Sites are crossed with paths and prefixes in a fixed order.
LABELLED = tuple(
    (f"http{'s' * (k % 2)}://{prefix}{site}.example.{tld}{path.split('?')[0]}", label)
    for label, sites, paths in ((1, _BAD, _PATHS_BAD), (0, _GOOD, _PATHS_GOOD))
    for k, site in enumerate(sites)
    for prefix in (("", "www."), ("blog.", "m."))[k % 2]
    for tld, path in zip(("com", "org", "net"), (paths[k % 7], paths[(k + 2) % 7], paths[(k + 5) % 7]), strict=True)
)


def host_of(url: F.Column) -> F.Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(None)
    after = F.substr(url, F.length(rest) + F.lit(4))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1)).otherwise(None)
    after = F.substr(url, F.length(rest) + F.lit(4))
    return F.coalesce(F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for site, start, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        hit = F.struct(F.lit(site + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram of every text, marked at both ends; all texts are hashed as one array of bytes."""
    raw = [f"^{t}$".encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw], np.int64)
    start = np.cumsum(size) - size
    p = prefix(data)
    rows, slots_ = [], []
    for n in GRAMS:
        count = np.maximum(0, size - n + 1)
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
        rows.append(np.repeat(np.arange(len(raw)), count))
        slots_.append(mix((p[at + n] - p[at]) * POWERS.down[at] + np.uint64(salt * 8 + n)) & np.uint64((1 << BITS) - 1))
    return np.concatenate(rows), np.concatenate(slots_).astype(np.int64)


def slots(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct hashed n-grams of every row; those of host and path never share a name before hashing."""
    (a, x), (b, y) = grams(hosts, 1), grams(paths, 2)
    both = np.unique(np.r_[a, b] << BITS | np.r_[x, y])
    return both >> BITS, both & ((1 << BITS) - 1)


def split(url: str) -> tuple[str, str]:
    """Host and path, as ``host_of`` and ``path_of`` have them."""
    found = re.match(r"[^/?#]*", rest := url.partition("://")[2])[0]
    return "".join(c.lower() if c.isascii() else c for c in found), re.split(r"[?#]", rest[len(found) :])[0]


@lru_cache(maxsize=4)
def train(labelled: tuple = LABELLED, rounds: int = 1000, rate: float = 6.0, l2: float = 1e-4) -> np.ndarray:
    """Weights, the last one the bias."""
    where, at = slots(*map(list, zip(*(split(url) for url, _ in labelled), strict=True)))
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(where, minlength=len(labelled))))
    # slots that no labelled url has keep a weight of 0
    names, at = np.unique(at, return_inverse=True)
    w, bias = np.zeros(len(names)), 0.0
    y = np.array([label for _, label in labelled], float)
    share = np.where(y == 1, 0.4 / max(1, y.sum()), 0.6 / max(1, (1 - y).sum()))
    for _ in range(rounds):
        z = np.bincount(where, w[at], len(y)) * scale + bias
        g = (1 / (1 + np.exp(-z)) - y) * share
        w -= rate * (np.bincount(at, (g * scale)[where], len(names)) + l2 * w)
        bias -= rate * g.sum()
    out = np.zeros((1 << BITS) + 1)
    out[names], out[-1] = w, bias
    return out


def scores(hosts: list[str], paths: list[str], w: np.ndarray) -> np.ndarray:
    """The probability of every row to be one to block."""
    where, at = slots(hosts, paths)
    n = len(hosts)
    z = np.bincount(where, w[at], n) / np.sqrt(np.maximum(1, np.bincount(where, minlength=n))) + w[-1]
    return 1 / (1 + np.exp(-z))


def score(host: str, path: str, w: np.ndarray) -> float:
    return float(scores([host], [path], w)[0])


def _scores(w: np.ndarray):
    """Scores a batch at once; rows without a host to judge (null) have none."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out = np.full(len(hosts), np.nan)
            for start in range(0, len(hosts), 4096):
                own = np.flatnonzero(hosts[start : start + 4096].notna()) + start
                if len(own):
                    out[own] = scores(hosts.iloc[own].tolist(), paths.iloc[own].tolist(), w)
            yield pd.Series(out).where(hosts.notna().to_numpy(), None)

    return F.pandas_udf(run, "double")


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict and block_score to the rows of ``pages``.

    Rules come first; the method judges, and gives a block_score to, the rows
    that none decides. A null url, or one without ``://``, has empty host and
    path and is left to the method, which sees no n-gram of a site in it.
    Repeated rows stay; an empty table stays empty. Columns of ``pages`` by the
    names of the added ones are replaced.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    rule = "_rule"
    while rule in own:
        rule += "_"
    parts = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = parts.withColumn(rule, rule_of(F.col("host"), F.col("path"), rules))
    open_host = F.when(F.col(rule).isNull(), F.col("host"))
    scored = ruled.withColumn("block_score", _scores(train())(open_host, F.col("path")))
    method = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select(*own, "host", "path", F.col(f"{rule}.rule").alias("rule"), F.coalesce(f"{rule}.verdict", method).alias("verdict"), "block_score")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
