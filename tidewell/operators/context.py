"""Contexts for answers: budgets, citations, summaries, prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions.text import content_words, first_sentence, sentences, token_estimate

SUMMARY_SENTENCES, CHUNK_TOKENS = 3, 512


def pack_budget(ranked: DataFrame, budget: int, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """`ranked` (by, doc, rank, tokens) with `kept`: in order of rank, what still fits the budget; later and smaller ones are still tried."""
    schema = f"{by} long, {doc} long, rank long, tokens long, kept boolean"

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rank", "ascending"), (doc, "ascending")])
        left, kept = budget, []
        for n in rows["tokens"].to_pylist():
            fits = n <= left
            left -= n if fits else 0
            kept.append(fits)
        return rows.append_column("kept", pa.array(kept))

    thin = ranked.select(F.col(by).cast("long"), F.col(doc).cast("long"), F.col("rank").cast("long"), F.col("tokens").cast("long"))
    return thin.groupBy(by).applyInArrow(fold, schema)


def context_text(kept: DataFrame, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(by, context): numbered chunks in order of rank, between rulers."""
    n = F.row_number().over(W.partitionBy(by).orderBy("rank"))
    part = F.format_string("[Chunk %d] (ID: %s)\n%s", n, F.col(doc).cast("string"), F.col("text"))
    rows = kept.select(by, n.alias("n"), part.alias("part"))
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("n", "part"))).alias("x")).select(by, F.array_join(F.col("x.part"), "\n\n---\n\n").alias("context"))


def citations(ranked: DataFrame, by: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(by, number, doc, score, snippet): the first sentence of each kept chunk."""
    n = F.row_number().over(W.partitionBy(by).orderBy("rank")).cast("long")
    return ranked.select(by, n.alias("number"), doc, "score", first_sentence("text").alias("snippet"))


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SUMMARY_SENTENCES) -> DataFrame:
    """(id, summary): the sentences of highest score in their old order.

    A sentence scores the sum of 1 / (number of the text's sentences that hold
    the word) over its content words, plus 0.1 for the first falling to 0.
    Everything is computed inside a row; nothing is shuffled.
    """
    s = docs.select(F.col(id_col).alias("id"), sentences(text_col).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [summary(s, w, most) for s, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=["id", "summary"])

    rows = s.where("s is not null").select("id", "s", F.transform("s", lambda x: content_words(x)).alias("w"))
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, summary string").withColumnRenamed("id", id_col)


def summary(found: list[str], words: list[list[str]], most: int) -> str:
    count: dict[str, int] = {}
    for ws in words:
        for w in set(ws):
            count[w] = count.get(w, 0) + 1
    n = len(found)
    score = [round(sum(1 / count[w] for w in ws) + 0.1 * (n - i) / n, 9) for i, ws in enumerate(words)]
    best = sorted(sorted(range(n), key=lambda i: (-score[i], i))[:most])
    return " ".join(found[i] for i in best)


def compress(docs: DataFrame, most_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """`docs` (doc_id, text): texts above `most_tokens` are replaced by their summary."""
    long = docs.where(token_estimate("text") > most_tokens)
    return docs.where((token_estimate("text") <= most_tokens) | F.col("text").isNull()).select("doc_id", "text").unionByName(summarize(long).withColumnRenamed("summary", "text"))


def render(template: str, **values: str | Column) -> Column:
    """A template with each {{.Key}} replaced."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{." + k + "}}"), F.col(v) if isinstance(v, str) else v)
    return out
