"""Queries of this subpackage, each over its whole intended table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import audio, decontaminate, line_dedup, near_dedup, packing, quality, sharding, token_counts, toxicity, url_filter
from tidewell.session import table, texts


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(texts(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds recordings: the bytes of each document's whole text are read as one, in raw 8-bit PCM."""
    docs = texts(spark, sf_dir, "documents")
    return audio.audio_features(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(texts(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table labels URLs: a page's URL is labelled by whether the page's visible text is junk."""
    pages = texts(spark, sf_dir, "pages")
    return url_filter.url_scores(pages, pages.select("url", url_filter.junk_page().alias("bad")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(texts(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir, "documents"), vocabulary=token_counts.VOCABULARY)


_QUERIES = (
    op1_line_dedup,
    op2_quality,
    op3_audio_features,
    op4_decontaminate,
    op5_minhash_near_dedup,
    op6_url_filter,
    op7_sharding,
    op8_token_counts,
    op9_toxicity,
    op10_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op4_decontaminate": decontaminate.SQL, "op7_sharding": sharding.SQL}
