"""Re-ranking of candidate lists (query_id, query, doc_id, text, score)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators import keyword


def finalize(df: DataFrame) -> DataFrame:
    """`df` with `rerank_rank` from 1 by rerank_score, then score, then id."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 9)), F.desc(F.round("score", 9)), "doc_id")
    return df.withColumn("rerank_rank", F.row_number().over(order).cast("long"))


def unit(score: str, by: str = "query_id") -> Column:
    """Min-max of a score over its list; 1 where all are equal."""
    w = W.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(1.0)


def sparse(candidates: DataFrame) -> DataFrame:
    """BM25 with the statistics of each query's own candidates; one without a score keeps its old one."""
    docs = candidates.select(F.col("query_id").alias("list"), "doc_id", "text")
    asked = candidates.select("query_id", "query").distinct()
    found = keyword.bm25(asked, docs, by="list", own=True).select("query_id", "doc_id", F.col("score").alias("found"))
    rows = candidates.join(found, ["query_id", "doc_id"], "left")
    return finalize(rows.withColumn("rerank_score", F.coalesce("found", "score")).drop("found"))


def _ascii_words(text: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))


def mark(candidates: DataFrame, relevant: DataFrame) -> DataFrame:
    """`candidates` with `relevant`: whether `relevant` (doc_id, and query_id if it has one) holds the row; samples for experiments."""
    keys = [c for c in ("query_id", "doc_id") if c in relevant.columns]
    known = relevant.select(*keys).where(F.col("doc_id").isNotNull()).distinct().withColumn("__tw_hit", F.lit(True))
    return candidates.join(known, keys, "left").select(*(F.col(f"`{c}`") for c in candidates.columns), F.coalesce("__tw_hit", F.lit(False)).alias("relevant"))


def ltr_features(candidates: DataFrame) -> DataFrame:
    """`candidates` with coarse score, share of the query's distinct words in the text, and 1 / (1 + words)."""
    q, d = _ascii_words("query"), _ascii_words("text")
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q)).otherwise(0.0)
    length = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return candidates.withColumns({"f_score": F.col("score"), "f_overlap": overlap, "f_length": 1.0 / (1.0 + length)})


def fit_ltr(x: np.ndarray, y: np.ndarray, rate: float = 0.5, epochs: int = 200, ridge: float = 0.0) -> np.ndarray:
    """Batch-gradient logistic regression; weights, then the constant."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(epochs if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        w -= rate * (x.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0))
    return w


#: Labelled candidates that weights are fitted on at most.
LTR_ROWS = 100_000


def fit_sample(rows: DataFrame, most: int = LTR_ROWS) -> np.ndarray | None:
    """Weights from labelled features (f_score, f_overlap, f_length, y): at most `most` rows, those of the smallest hashes of query and document; None without any."""
    some = rows.orderBy(F.xxhash64("query_id", "doc_id"), "query_id", "doc_id").limit(most).select("f_score", "f_overlap", "f_length", F.col("y").cast("double")).toArrow()
    if not some.num_rows:
        return None
    x = np.stack([np.asarray(c, float) for c in some.columns], axis=1)
    return fit_ltr(x[:, :3], x[:, 3])


def ltr(candidates: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """Sigmoid of the weighted features; without weights the coarse score."""
    rows = ltr_features(candidates)
    if weights is None:
        return finalize(rows.withColumn("rerank_score", F.col("score")))
    z = reduce(lambda a, b: a + b, (F.col(c) * float(v) for c, v in zip(("f_score", "f_overlap", "f_length"), weights, strict=False))) + float(weights[-1])
    return finalize(rows.withColumn("rerank_score", 1 / (1 + F.exp(-z))))


class AdaptiveLtr:
    """Refits on the first labelled rows and all feedback whenever enough feedback has come in."""

    def __init__(self, x: np.ndarray, y: np.ndarray, every: int = 100):
        self.x, self.y, self.every, self.pending = x, y, every, 0
        self.weights = fit_ltr(x, y)

    def record(self, features: np.ndarray, label: float) -> None:
        self.x, self.y, self.pending = np.vstack((self.x, features)), np.append(self.y, label), self.pending + 1
        if self.pending >= self.every:
            self.weights, self.pending = fit_ltr(self.x, self.y), 0


def ensemble(lists: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """(query_id, doc_id, rerank_score): reciprocal ranks of each list's rerank_score, or the weighted mean of unit scores."""
    if weights is None:
        return keyword.fuse_rrf([x.select("query_id", "doc_id", F.round("rerank_score", 9).alias("score")) for x in lists]).withColumnRenamed("score", "rerank_score")
    parts = [x.select("query_id", "doc_id", (unit("rerank_score") * w).alias("s")) for x, w in zip(lists, weights, strict=True)]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg((F.sum("s") / sum(weights)).alias("rerank_score"))


def judged(candidates: DataFrame, judge: Callable[[list[tuple[str, str]]], list[float]], first: int | None = None) -> DataFrame:
    """Scores of a callable on (query, text) pairs, of the `first` of each list only; the rest keep their coarse score."""
    rows = candidates.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")))
    schema = "query_id long, doc_id long, found double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, d, query, text = (c.to_pylist() for c in b.columns)
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(d, pa.int64()), pa.array(judge(list(zip(query, text, strict=True))), pa.float64())], names=["query_id", "doc_id", "found"])

    todo = rows if first is None else rows.where(F.col("n") <= first)
    found = todo.select(F.col("query_id").cast("long"), F.col("doc_id").cast("long"), "query", "text").mapInArrow(run, schema)
    return finalize(rows.drop("n").join(found, ["query_id", "doc_id"], "left").withColumn("rerank_score", F.coalesce("found", "score")).drop("found"))
