"""URL filter: gradient-boosted trees on lexical features of the URL alone.

Statistics of a host's suffix are counted over all URLs (how often it occurs)
and all labelled ones (how many of them are bad), and joined to the URLs. Trees
are grown by level on binned features with the logistic loss, in NumPy on the
driver, over a bounded number of labelled URLs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import written

#: Labelled URLs that training uses at most.
LABELLED, TREES, DEPTH, RATE, BINS, LEAF, RIDGE, HELD, REJECT, SMOOTH = 20_000, 60, 4, 0.15, 32, 20, 1.0, 5, 0.5, 20.0
NAMES = ("length", "host_length", "path_depth", "host_depth", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "fragment", "hyphens", "secure", "longest_number", "suffix_rate", "suffix_count", "file_suffix")
_PARTS = re.compile(r"^(?:([a-z][a-z0-9+.-]*)://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.I | re.S)
_SUFFIX, _COUNT = NAMES.index("suffix_rate"), NAMES.index("suffix_count")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffix(host: str) -> str:
    """The last two labels of a host."""
    return ".".join(host.rsplit(".", 2)[-2:])


def lexical(url: str | None) -> tuple[list[float], str]:
    """Values of NAMES, those of the suffix yet zero, and the suffix; a null URL counts as an empty one."""
    u = (url or "").strip()
    scheme, host, path, query, fragment = _PARTS.match(u).groups()
    host = (host or "").rsplit("@", 1)[-1].split(":", 1)[0].lower()
    digits = sum(map(str.isdigit, u))
    name = path.rsplit("/", 1)[-1]
    row = [
        len(u), len(host), sum(1 for x in path.split("/") if x), host.count(".") + bool(host), digits / max(1, len(u)), sum(map(str.isdigit, host)) / max(1, len(host)),
        entropy(u), entropy(host), sum(1 for x in (query or "").split("&") if x), float(bool(fragment)), u.count("-"), float((scheme or "").lower() == "https"),
        max((len(x) for x in re.findall(r"\d+", u)), default=0), 0.0, 0.0, float("." in name),
    ]
    return [float(x) for x in row], suffix(host)


@dataclass(frozen=True)
class Trees:
    """Boosted trees: per tree and inner node (breadth first) the feature and the limit, per leaf the value; `auc` on held-out rows."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float
    auc: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x))) if len(x) else np.zeros(0)


def matrix(urls: list, rates: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of NAMES for each URL, with its suffix's share of bad URLs and number of URLs."""
    x = np.array([lexical(u)[0] for u in urls], float).reshape(-1, len(NAMES))
    x[:, _SUFFIX], x[:, _COUNT] = rates, np.log1p(counts)
    return x


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(features, limits, leaves, base) of trees fitted to the gradients of the logistic loss."""
    rate = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    base, inner = math.log(rate / (1 - rate)), 2**DEPTH - 1
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), base)
    features, limits, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, count = 2**depth - 1, 2**depth
            at = node - first
            best_gain, best_f, best_b = np.full(count, 1e-6), np.zeros(count, np.int64), np.full(count, -1)
            for f, cut in enumerate(cuts):
                width = len(cut) + 1
                if width < 2:
                    continue
                key = at * width + binned[:, f]
                sums = [np.bincount(key, w, count * width).reshape(count, width).cumsum(axis=1) for w in (g, h, np.ones(len(y)))]
                gl, hl, nl = (s[:, :-1] for s in sums)
                gt, ht, nt = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAF) | (nt - nl < LEAF)] = 0
                b = gain.argmax(axis=1)
                top = gain[np.arange(count), b]
                better = top > best_gain
                best_gain[better], best_f[better], best_b[better] = top[better], f, b[better]
            for k in np.flatnonzero(best_b >= 0):
                features[t, first + k], limits[t, first + k] = best_f[k], cuts[best_f[k]][best_b[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), features[t, node]] > limits[t, node])
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaves[t] = RATE * gs / (hs + RIDGE)
        raw += leaves[t, at]
    return features, limits, leaves, base


def auc(score: np.ndarray, y: np.ndarray) -> float | None:
    """Area under the ROC curve, ties counting half; None without both kinds."""
    values, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (counts.cumsum() - (counts - 1) / 2)[inverse]
    pos, neg = y.sum(), (1 - y).sum()
    return float((rank[y > 0].sum() - pos * (pos + 1) / 2) / (pos * neg)) if pos and neg else None


def train(x: np.ndarray, bad: list) -> Trees:
    """Trees from labelled rows; `auc` is that of trees fitted without every HELD-th row, on those rows. One kind of label alone gives its share as constant."""
    y = np.array(bad, float)
    if not len(y) or y.min() == y.max():
        rate = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        empty = np.zeros((0, 2**DEPTH - 1))
        return Trees(empty.astype(int), empty, np.zeros((0, 2**DEPTH)), math.log(rate / (1 - rate)))
    held, score = np.arange(len(y)) % HELD == 0, None
    if 0 < y[~held].mean() < 1:
        score = auc(Trees(*boost(x[~held], y[~held])).probability(x[held]), y[held])
    return Trees(*boost(x, y), score)


def junk_page(html: str = "html") -> Column:
    """1 for a page whose visible words carry runs of signs or are shouted: the label where no list of URLs is given."""
    text = F.regexp_replace(F.col(html), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = F.size(F.split(F.trim(text), r"\s+"))
    # Null for a null page; without a branch for it, Spark makes the text once for both uses.
    return (F.regexp_count(text, F.lit(r"[*%$#&]{3}|!!")) > 0.05 * words).cast("int")


@F.arrow_udf(T.StringType())
def _suffix(url: pa.Array) -> pa.Array:
    return pa.array([lexical(u)[1] for u in url.to_pylist()], pa.string())


def with_suffixes(urls: DataFrame, pages: DataFrame, labelled: DataFrame) -> tuple[DataFrame, float]:
    """`urls` with what its suffix has: __tw_n URLs in `pages`, __tw_l labelled ones, __tw_b of them bad; and the share of bad URLs.

    Counts are over all rows. The table of suffixes is joined by the planner's
    choice, as its size is unknown; partial sums come before the shuffle, so a
    suffix that most URLs share is one row by then.
    """
    known = labelled.where("bad is not null").select(_suffix("url").alias("__tw_s"), F.col("bad").cast("int").alias("bad")).groupBy("__tw_s").agg(F.count("*").alias("__tw_l"), F.sum("bad").alias("__tw_b"))
    seen = pages.select(_suffix("url").alias("__tw_s")).groupBy("__tw_s").agg(F.count("*").alias("__tw_n"))
    stats = written(seen.join(known, "__tw_s", "full").na.fill(0, ["__tw_n", "__tw_l", "__tw_b"]), "suffixes")
    total = stats.agg(F.coalesce(F.try_divide(F.sum("__tw_b"), F.sum("__tw_l")), F.lit(0.0)).alias("p")).first()["p"]
    return urls.withColumn("__tw_s", _suffix("url")).join(stats, "__tw_s", "left").drop("__tw_s").na.fill(0, ["__tw_n", "__tw_l", "__tw_b"]), float(total)


def _rate(bad, labelled, prior: float):
    """The share of bad URLs, drawn towards that of all by SMOOTH rows."""
    return (bad + SMOOTH * prior) / (labelled + SMOOTH)


def fit(labelled: DataFrame, pages: DataFrame | None = None, rows: int = LABELLED) -> Trees:
    """Trees from `labelled` (url, bad); at most `rows` of them, those of the smallest hashes. Null labels are skipped.

    Suffixes are counted over all of `pages` (by default the labelled URLs) and
    all labels; a training row's share of bad URLs doesn't count its own label.
    An empty table gives one score for all; a row that repeats counts again.
    """
    chosen = labelled.where("bad is not null").select("url", F.col("bad").cast("int").alias("bad"), F.xxhash64("url").alias("h")).orderBy("h", "url", "bad").limit(rows)
    with_stats, prior = with_suffixes(chosen, labelled if pages is None else pages, labelled)
    got = with_stats.orderBy("h", "url", "bad").toArrow()
    y, n, lab, bad = (np.asarray(got[c], float) for c in ("bad", "__tw_n", "__tw_l", "__tw_b"))
    return train(matrix(got["url"].to_pylist(), _rate(bad - y, lab - 1, prior), n), y)


def url_scores(pages: DataFrame, labelled: DataFrame, reject: float = REJECT, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, score, reject): the probability that a URL is bad, and whether it is above `reject`.

    Every row is scored by its URL and the statistics of its suffix. A null or
    empty URL has zero features and is scored like any other; null and repeated
    ids are reported as they come, ids are of any type. Without labels of both
    kinds all get one score. An empty table gives no rows.
    """
    # Labels may be costly to make, and are read four times.
    labelled = written(labelled.select("url", F.col("bad").cast("int").alias("bad")), "labelled")
    model = pages.sparkSession.sparkContext.broadcast(trees or fit(labelled, pages))
    rows, prior = with_suffixes(pages.select("page_id", "url"), pages, labelled)

    @F.arrow_udf(T.DoubleType())
    def score(url: pa.Array, n: pa.Array, labelled: pa.Array, bad: pa.Array) -> pa.Array:
        n, lab, b = (np.asarray(c, float) for c in (n, labelled, bad))
        return pa.array(model.value.probability(matrix(url.to_pylist(), _rate(b, lab, prior), n)))

    return rows.select("page_id", "url", F.round(score("url", "__tw_n", "__tw_l", "__tw_b"), 6).alias("score")).withColumn("reject", F.col("score") > reject)
