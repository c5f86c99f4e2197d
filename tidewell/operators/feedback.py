"""Relevance feedback, review queue and active learning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.operators.search import mean_vectors

ALPHA, BETA, GAMMA = 1.0, 0.5, 0.3


def rocchio_vector(query: DataFrame, relevant: DataFrame, irrelevant: DataFrame, weights: tuple[float, float, float] = (ALPHA, BETA, GAMMA)) -> DataFrame:
    """One row (vector): the weighted query plus the relevant mean minus the irrelevant mean, scaled to norm 1. `query` is (pos, mean)."""
    sides = ((query, weights[0]), (mean_vectors(relevant), weights[1]), (mean_vectors(irrelevant), -weights[2]))
    parts = [df.select("pos", (F.col("mean") * w).alias("x")) for df, w in sides]
    sums = reduce(DataFrame.unionByName, parts).groupBy("pos").agg(F.sum("x").alias("x"))
    rows = sums.agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return rows.select(F.transform("v", lambda e: F.when(F.col("n") > 0, e.x / F.col("n")).otherwise(e.x)).alias("vector"))


def rocchio_terms(query: DataFrame, relevant: DataFrame, irrelevant: DataFrame, top: int = 12, weights: tuple[float, float, float] = (ALPHA, BETA, GAMMA)) -> DataFrame:
    """The `top` (term, weight) of each query after feedback.

    All three are (query_id, doc_id, term, tf), the query's own with one
    document; a side's weight of a term is its mean over the side's documents.
    Weights below 0 are cut to 0, and 0 is left out.
    """

    def side(df: DataFrame, w: float) -> DataFrame:
        n = df.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n"))
        return df.groupBy("query_id", "term").agg(F.sum("tf").alias("tf")).join(n, "query_id").select("query_id", "term", (F.col("tf") * w / F.col("n")).alias("x"))

    parts = [side(df, w) for df, w in ((query, weights[0]), (relevant, weights[1]), (irrelevant, -weights[2]))]
    sums = reduce(DataFrame.unionByName, parts).groupBy("query_id", "term").agg(F.sum("x").alias("weight")).where("weight > 1e-12")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("weight", 9)), "term")
    return sums.withColumn("n", F.row_number().over(order)).where(F.col("n") <= top).select("query_id", "term", "weight")


def boost_relevant(results: DataFrame, relevant: DataFrame, key: str = "doc_id") -> DataFrame:
    """`results` (query_id, key, rank) with relevant ones first, each part in its old order: new column `boosted`."""
    marks = relevant.select(F.col("query_id"), key).distinct().withColumn("__tw_is", F.lit(1))
    rows = results.join(marks, ["query_id", key], "left")
    order = W.partitionBy("query_id").orderBy(F.col("__tw_is").isNull(), "rank")
    return rows.withColumn("boosted", F.row_number().over(order).cast("long")).drop("__tw_is")


def uncertainty(scores: DataFrame, by: str, score: str = "score") -> DataFrame:
    """`scores` with 1 - minmax(score) of each group; 0 where all are equal."""
    w = W.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scores.withColumn("uncertainty", F.when(high > low, 1 - (F.col(score) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.0))


def margin(scores: DataFrame, by: str, score: str = "score") -> DataFrame:
    """(by, margin): the best score minus the second, or the only one."""
    top = scores.groupBy(by).agg(F.max(score).alias("a"), F.max_by(F.lit(1), score).alias("one"), F.slice(F.sort_array(F.collect_list(score), asc=False), 2, 1).alias("b"))
    return top.select(by, (F.col("a") - F.coalesce(F.get("b", F.lit(0)), F.lit(0.0))).alias("margin"))


def active_select(uncertain: DataFrame, reviewed: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """The `size` most uncertain rows whose key wasn't reviewed."""
    return uncertain.join(reviewed.select(key).distinct(), key, "left_anti").orderBy(F.desc(F.round("uncertainty", 9)), key).limit(size)
