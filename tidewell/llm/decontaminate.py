"""Benchmark decontamination by winnowing.

Texts become word hashes; every run of GRAM words is hashed, and in each window
of WINDOW consecutive run hashes the rightmost smallest is kept as a
fingerprint. Two texts that share GRAM + WINDOW - 1 words in a row therefore
share a fingerprint. Equal fingerprints are extended word by word to the
longest shared span, and spans of at least MIN_WORDS words are reported.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewell.llm.words import batches, grams, word_hashes
from tidewell.session import plan_bytes

GRAM, WINDOW = 8, 6
MIN_WORDS = GRAM + WINDOW - 1
BROADCAST_BYTES = 16 << 20

_NAMES = ("doc_start", "item_start", "n_words")
_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in _NAMES])
_PRINT = T.StructType([T.StructField("print", T.LongType()), T.StructField("at", T.LongType())])
_SPAN_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in _NAMES]))
_PRINT_ARROW = pa.list_(pa.struct([("print", pa.int64()), ("at", pa.int64())]))


def winnow(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the rightmost smallest hash of each window; a shorter text is one window."""
    n = len(g)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(g[::-1]))])
    best, at = g[window - 1 :].copy(), np.full(n - window + 1, window - 1)
    for back in range(window - 2, -1, -1):
        other = g[back : n - window + 1 + back]
        less = other < best
        best[less] = other[less]
        at[less] = back
    return np.unique(at + np.arange(n - window + 1))


def extend(doc: np.ndarray, item: np.ndarray, hits: list[tuple[int, int]], least: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """Longest shared spans (doc start, item start, words) through hits (doc position, item position), each once."""
    out, covered = [], {}
    for p, q in sorted(set(hits)):
        if covered.get(p - q, -1) > p:
            continue
        back = min(p, q)
        same = doc[p - back : p] == item[q - back : q]
        left = int(np.argmin(same[::-1])) if not same.all() else back
        ahead = min(len(doc) - p, len(item) - q)
        same = doc[p : p + ahead] == item[q : q + ahead]
        right = int(np.argmin(same)) if not same.all() else ahead
        covered[p - q] = p + right
        if left + right >= least:
            out.append((p - left, q - left, left + right))
    return out


class Index:
    """Fingerprints and word hashes of the benchmark's items, for the broadcast join."""

    def __init__(self, ids: list, texts: list):
        h, at = word_hashes(texts)
        self.ids = ids
        self.items = [h[a:b] for a, b in pairwise(at)]
        found = [(i, w, grams(x, GRAM)[w]) for i, x in enumerate(self.items) if len(w := winnow(grams(x, GRAM)))]
        prints = np.concatenate([p for _, _, p in found]) if found else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(w), i) for i, w, _ in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([w for _, w, _ in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(prints, kind="stable")
        self.prints, self.owner, self.place = prints[order], owner[order], place[order]

    def spans(self, doc: np.ndarray) -> list[dict]:
        g = grams(doc, GRAM)
        at = winnow(g)
        lo = np.searchsorted(self.prints, g[at], "left")
        hi = np.searchsorted(self.prints, g[at], "right")
        by_item: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(hi > lo):
            for j in range(lo[k], hi[k]):
                by_item.setdefault(int(self.owner[j]), []).append((int(at[k]), int(self.place[j])))
        return [dict(zip(("item", *_NAMES), (self.ids[i], *s), strict=True)) for i, hits in sorted(by_item.items()) for s in extend(doc, self.items[i], hits)]


def _each(texts: list, f) -> list:
    out = []
    for _, run in batches(texts):
        h, at = word_hashes(run)
        out += [f(h[a:b]) for a, b in pairwise(at)]
    return out


def _index(items: DataFrame) -> Broadcast:
    rows = items.collect()
    return items.sparkSession.sparkContext.broadcast(Index([r["i"] for r in rows], [r["t"] for r in rows]))


def _spans_udf(index: Broadcast, id_type: T.DataType):
    arrow = pa.list_(pa.struct([("item", to_arrow_type(id_type)), *_SPAN_ARROW.value_type]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("item", id_type), *_SPAN])))
    def spans(text: pa.Array) -> pa.Array:
        return pa.array(_each(text.to_pylist(), index.value.spans), arrow)

    return spans


def _prints(doc: np.ndarray) -> list[dict]:
    g = grams(doc, GRAM)
    at = winnow(g)
    return [{"print": p, "at": a} for p, a in zip(g[at].view(np.int64).tolist(), at.tolist(), strict=True)]


@F.arrow_udf(T.ArrayType(_PRINT))
def _prints_udf(text: pa.Array) -> pa.Array:
    return pa.array(_each(text.to_pylist(), _prints), _PRINT_ARROW)


@F.arrow_udf(T.ArrayType(_SPAN))
def _extend_udf(doc: pa.Array, item: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for d, i, found in zip(doc.to_pylist(), item.to_pylist(), hits.to_pylist(), strict=True):
        (h, at) = word_hashes([d, i])
        spans = extend(h[: at[1]], h[at[1] :], [(x["p"], x["q"]) for x in found])
        out.append([dict(zip(_NAMES, s, strict=True)) for s in spans])
    return pa.array(out, _SPAN_ARROW)


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words): spans shared by a document and a benchmark item.

    Starts count words. Every shared run of at least MIN_WORDS words is found.
    A benchmark of at most `broadcast_bytes` goes to every executor as one
    index, and documents are read once without a shuffle; a larger one is joined
    by fingerprint. Both ways give the same rows.

    Null and empty texts share nothing. A null id is reported as null. Items or
    documents that repeat an id are compared row by row. Texts of less than
    MIN_WORDS words can't reach the limit. An empty table on either side gives
    no rows.
    """
    d = docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t")).where("t is not null")
    b = benchmark.select(F.col("item_id").alias("i"), F.col("text").alias("t")).where("t is not null")
    result = ("d as doc_id", "i as item_id", "s.doc_start", "s.item_start", "s.n_words")
    if plan_bytes(b) <= broadcast_bytes:
        found = d.select("d", F.explode(_spans_udf(_index(b), b.schema["i"].dataType)("t")).alias("s"))
        return found.select("d", F.col("s.item").alias("i"), "s").selectExpr(*result)
    # Rows get a key of their own, so that repeated ids stay apart; the key is a function of the row.
    d = d.withColumn("dk", F.xxhash64("d", "t"))
    b = b.withColumn("bk", F.xxhash64("i", "t"))
    at = lambda x, *keys: x.select(*keys, F.explode(_prints_udf("t")).alias("f")).select(*keys, "f.print", "f.at")
    met = at(d, "dk").withColumnRenamed("at", "p").join(at(b, "bk").withColumnRenamed("at", "q").distinct(), "print")
    hits = met.groupBy("dk", "bk").agg(F.collect_set(F.struct("p", "q")).alias("hits"))
    both = hits.join(b.withColumnRenamed("t", "bt"), "bk").join(d, "dk")
    return both.select("d", "i", F.explode(_extend_udf("t", "bt", "hits")).alias("s")).selectExpr(*result)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `docs` that share no span of MIN_WORDS words with the benchmark; all columns stay.

    The decision is each row's own: null ids, repeated ids, null and empty texts are no special case.
    """
    b = benchmark.select(F.xxhash64("text").alias("i"), F.col("text").alias("t")).where("t is not null")
    if plan_bytes(b) <= broadcast_bytes:
        kept = docs.withColumn("__tw_spans", F.size(_spans_udf(_index(b), b.schema["i"].dataType)("text"))).where("__tw_spans = 0")
    else:
        keyed = docs.withColumn("__tw_key", F.xxhash64("text"))
        bad = contaminated(keyed.select(F.col("__tw_key").alias("doc_id"), "text"), b.select(F.col("i").alias("item_id"), F.col("t").alias("text")), broadcast_bytes)
        kept = keyed.join(bad.select(F.col("doc_id").alias("__tw_key")), "__tw_key", "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


#: Shared runs of MIN_WORDS words, put together where they overlap; the two sides' words are those of `words.WORD`.
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark WHERE text IS NOT NULL),
dg AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + {MIN_WORDS}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(greatest(0, len(ws) - {MIN_WORDS - 1}))) AS i FROM d)),
bg AS (SELECT item_id, j, array_to_string(ws[j + 1 : j + {MIN_WORDS}], ' ') AS g FROM (SELECT item_id, ws, unnest(range(greatest(0, len(ws) - {MIN_WORDS - 1}))) AS j FROM b)),
met AS (SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM dg JOIN bg USING (g))
SELECT doc_id, item_id, min(i) AS doc_start, min(j) AS item_start, count(*) + {MIN_WORDS - 1} AS n_words FROM met GROUP BY doc_id, item_id, i - j, run
"""
