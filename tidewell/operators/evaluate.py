"""Retrieval metrics, answer checks, comparison of runs, and the two-sample test."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import content_words, sentences


def retrieval_metrics(run: DataFrame, qrels: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """(query_id, precision, recall, mrr, ndcg) at k of every query of `run`.

    `run` is (query_id, doc_id, rank), ranks from 1; `qrels` is (query_id,
    doc_id, grade), relevant above 0. A document that is retrieved twice counts
    twice for precision and once for recall. Gains are 2 ** grade - 1. Precision
    divides by k even where fewer are retrieved. `sizes` (query_id, relevant,
    ideal) may give what is otherwise counted from `qrels`.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    if sizes is None:
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
        judged = qrels.where("grade > 0").withColumn("place", place)
        sizes = judged.groupBy("query_id").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("place") <= k, gain / F.log2(F.col("place") + 1))).alias("ideal"))
    hits = run.join(qrels, ["query_id", "doc_id"], "left").fillna(0, ["grade"])
    first = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy("rank")) == 1
    hits = hits.withColumn("first", first)
    good = F.col("grade") > 0
    near = F.col("rank") <= k
    sums = hits.groupBy("query_id").agg(
        (F.count_if(good & near) / k).alias("precision"),
        F.count_if(good & near & F.col("first")).alias("found"),
        F.coalesce(1 / F.min(F.when(good, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(near & F.col("first") & good, gain / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
    )
    out = sums.join(sizes, "query_id", "left")
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select("query_id", "precision", over("found", "relevant").alias("recall"), "mrr", over("dcg", "ideal").alias("ndcg"))


def report(metrics: DataFrame) -> DataFrame:
    """(metric, value): means over the queries."""
    names = [c for c in metrics.columns if c != "query_id"]
    means = metrics.agg(*(F.avg(c).alias(c) for c in names))
    return means.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names))).alias("x")).select("x.*")


def compare(old: DataFrame, new: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(metric, old, new, delta, verdict) of two reports."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "metric", "full")
    delta = F.col("new") - F.col("old")
    verdict = F.when(delta < -tolerance, "regression").when(delta > tolerance, "improvement").otherwise("same")
    return both.withColumn("delta", delta).withColumn("verdict", verdict)


def linear_ndcg(grades: Column, k: int) -> Column:
    """NDCG with linear gains of an array of grades in ranked order."""
    total = lambda a: F.aggregate(F.transform(F.slice(a, 1, k), lambda g, i: F.greatest(g, F.lit(0.0)) / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    ideal = total(F.sort_array(grades, asc=False))
    return F.when(ideal > 0, total(grades) / F.when(ideal > 0, ideal)).otherwise(0.0)


def erf(x: Column) -> Column:
    """A polynomial for the error function, right to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = reduce(lambda acc, c: (acc + c) * t, (-1.453152027, 1.421413741, -0.284496736, 0.254829592), F.lit(1.061405429) * t)
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def welch(samples: DataFrame, a: str, b: str) -> DataFrame:
    """One row (mean_a, mean_b, win_rate, t, p, significant) of paired samples, by Welch's statistic with population variances and a normal p."""
    s = samples.agg(
        F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.avg((F.col(a) > F.col(b)).cast("double")).alias("win_rate"),
        F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"),
    )
    se = F.col("va") / F.nullif("na", F.lit(0)) + F.col("vb") / F.nullif("nb", F.lit(0))
    flat = F.when(F.col("mean_a") == F.col("mean_b"), 0.0).when(F.col("mean_a") < F.col("mean_b"), -1e6).otherwise(1e6)
    s = s.withColumn("t", F.when(se > 0, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(F.when(se > 0, se))).otherwise(flat))
    p = F.least(F.greatest(2 * (1 - 0.5 * (1 + erf(F.abs("t") / F.lit(2.0**0.5)))), F.lit(0.0)), F.lit(1.0))
    p = F.when(se > 0, p).otherwise(F.when(F.col("t") == 0, 1.0).otherwise(0.0))
    return s.withColumn("p", p).withColumn("significant", F.col("p") < 0.05).drop("va", "vb", "na", "nb")


def _share(part: Column, of: Column) -> Column:
    return F.when(F.size(of) > 0, F.size(F.array_intersect(of, part)) / F.size(of)).otherwise(0.0)


@F.arrow_udf(T.IntegerType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """How many words two lists have in common, repetitions counted; each list is counted once."""
    return pa.array([None if x is None or y is None else (Counter(x) & Counter(y)).total() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())


def token_f1(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of two word lists, repetitions counted."""
    common = _common(a, b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * common / (F.size(a) + F.size(b))).otherwise(0.0)


def overlap_judge(question: str, answer: str, context: str, reference: str) -> Column:
    """(faithfulness, relevance, correctness) of an answer by shared content words of two bytes or more."""
    q, a, c = (F.array_distinct(content_words(x, 2)) for x in (question, answer, context))
    return F.struct(_share(c, a).alias("faithfulness"), _share(a, q).alias("relevance"), token_f1(content_words(answer, 2), content_words(reference, 2)).alias("correctness"))


def claims(answers: DataFrame, sources: DataFrame, threshold: float = 0.5, key: str = "answer_id") -> DataFrame:
    """(key, claim_no, words, found, supported) of each sentence with content words: `found` of its words occur in some source.

    The sources' distinct words are joined to the distinct words of the claims,
    so repeated words aren't shuffled again and again.
    """
    spread = answers.select(key, F.posexplode(sentences("text")).alias("claim_no", "claim")).select(key, "claim_no", content_words("claim").alias("ws")).where(F.size("ws") > 0)
    known = sources.select(F.explode(F.array_distinct(content_words("text"))).alias("w")).distinct().withColumn("known", F.lit(1))
    words = spread.select(key, "claim_no", F.explode("ws").alias("w")).join(known, "w", "left")
    sums = words.groupBy(key, "claim_no").agg(F.count("*").alias("words"), F.count("known").alias("found"))
    return sums.withColumn("supported", F.col("found") / F.col("words") >= threshold)
