"""Keyword search: an inverted index as tables, BM25 for all queries at once, and score fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import terms
from tidewell.operators.ranks import spread_rank
from tidewell.session import written

K1, B, RRF_K = 1.2, 0.75, 60


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, terms, dl): indexed terms of each document and their number, without a shuffle."""
    t = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), terms(text_col).alias("terms"))
    return t.withColumn("dl", F.size("terms").cast("long"))


def postings(indexed: DataFrame) -> DataFrame:
    """(term, doc_id, tf)."""
    return indexed.select("doc_id", F.explode("terms").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def remove(indexed: DataFrame, gone: DataFrame) -> DataFrame:
    """An index without the documents of `gone` (doc_id)."""
    return indexed.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def add(indexed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An index with new documents; one that it has already is replaced, a null text takes it out."""
    return remove(indexed, docs.select(F.col(id_col).alias("doc_id"))).unionByName(index(docs, id_col, text_col))


def corpus_statistics(indexed: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl)."""
    return indexed.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def bm25(queries: DataFrame, docs: DataFrame, query_id: str = "query_id", query_text: str = "query", by: str | None = None, own: bool = False) -> DataFrame:
    """(query_id, doc_id, score) of all documents with a score above 0, for every query.

    Texts are taken apart once. Only terms that occur in a query are counted:
    they meet the exploded terms in a join before the count by document, so the
    full inverted index is never shuffled; an empty term, which no text has,
    stands for each document itself and carries its length. A repeated query
    term counts again. With `by`, a column of `docs`, statistics are those of
    each group and scores stay inside it; with `own`, the group is the one
    query that searches it (a candidate list).
    """
    group = [by] if by else []
    indexed = docs.where("text is not null").select(F.col("doc_id"), *group, terms("text").alias("terms"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(terms(query_text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    wanted = asked.select("term").union(queries.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    each = indexed.select("doc_id", *group, F.size("terms").cast("long").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    found = written(each.join(wanted, "term").groupBy(*group, "term", "doc_id", "dl").agg(F.count("*").alias("tf")), "postings")
    tf = found.where("term <> ''")
    stats = found.where("term = ''").groupBy(*group).agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    df = tf.groupBy(*group, "term").agg(F.count("*").alias("df"))
    idf = df.join(stats, group) if by else df.crossJoin(stats)
    idf = idf.select(*group, "term", F.log((F.col("n_docs") + 1) / (F.col("df") + 1) + 1).alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(idf, [*group, "term"]).select(*group, "term", "doc_id", part.alias("part"))
    out = scored.join(asked.withColumn(by, F.col("query_id")), ["term", by]) if own else scored.join(asked, "term")
    out = out.groupBy("query_id", *group, "doc_id").agg(F.sum(F.col("part") * F.col("qn")).alias("score"))
    return out.where("score > 0")


def fuse_weighted(lists: list[DataFrame], alpha: float, keys: tuple[str, ...] = ("query_id", "doc_id")) -> DataFrame:
    """Weighted sum of score lists: `alpha` for the first, the rest shared evenly by the others; sums above 0. One list passes through."""
    if len(lists) == 1:
        return lists[0].select(*keys, "score")
    rest = (1 - alpha) / (len(lists) - 1)
    parts = [x.select(*keys, (F.col("score") * (rest if i else alpha)).alias("score")) for i, x in enumerate(lists)]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("score").alias("score")).where("score > 0")


def fuse_rrf(lists: list[DataFrame], k: int = RRF_K, keys: tuple[str, ...] = ("query_id", "doc_id")) -> DataFrame:
    """Sum of 1 / (k + rank) over the lists, ranks from 1 by score, then id.

    Every row has a rank, so a list isn't cut; it is numbered by buckets of the
    score, that a query which most documents match is no task's alone.
    """
    order = [F.desc("score"), keys[-1]]
    parts = [spread_rank(x.select(*keys, "score"), F.floor(-F.col("score") * 4), order, keys[:-1]).select(*keys, (1.0 / (k + F.col("rank"))).alias("score")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum("score").alias("score"))


def hybrid(vector: DataFrame, keyword: DataFrame, weight: float, min_score: float = 0.0, keys: tuple[str, ...] = ("query_id", "doc_id")) -> DataFrame:
    """(keys, vector_score, keyword_score, score): full outer join of both lists, (1 - weight) * v + weight * b, above 0 and at least `min_score`."""
    v = vector.select(*keys, F.col("score").alias("vector_score"))
    b = keyword.select(*keys, F.col("score").alias("keyword_score"))
    both = v.join(b, list(keys), "full").fillna(0.0, ["vector_score", "keyword_score"])
    both = both.withColumn("score", (1 - weight) * F.col("vector_score") + weight * F.col("keyword_score"))
    return both.where((F.col("score") > 0) & (F.col("score") >= min_score))
