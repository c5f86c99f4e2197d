"""A chunk store on Parquet: append-only rows by namespace, tombstones, and search over what is live."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.operators import chunking, filters, keyword, search

CHUNK = "chunk_id string, doc_id long, chunk_index long, content string, embedding array<float>, metadata map<string,string>, version long, namespace string"
_GONE = "chunk_id string, doc_id long, version long, namespace string"


class Store:
    """Chunks below `path`; every method is a plan over its tables, so that reads prune by namespace."""

    def __init__(self, spark: SparkSession, path: str, embed=None):
        self.spark, self.path, self.embed = spark, path.rstrip("/"), embed

    def _read(self, name: str, schema: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def upload(self, docs: DataFrame, namespace: str = "default", chunker: Callable[[str], list] = chunking.fixed, metadata: Column | None = None) -> None:
        """Chunks, embeds and appends documents (doc_id, text); rows of the same chunk id replace older ones."""
        rows = chunking.chunked(docs, chunker)
        if metadata is not None:
            rows = rows.join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), metadata.alias("metadata")), "doc_id")
        else:
            rows = rows.withColumn("metadata", F.lit(None).cast("map<string,string>"))
        vector = self.embed("content") if self.embed else F.lit(None)
        rows = rows.withColumns({"embedding": vector.cast("array<float>"), "version": F.lit(time.time_ns()), "namespace": F.lit(namespace)})
        rows.select("chunk_id", "doc_id", "chunk_index", "content", "embedding", "metadata", "version", "namespace").write.mode("append").partitionBy("namespace").parquet(f"{self.path}/chunks")

    def _bury(self, rows: DataFrame) -> None:
        rows.withColumn("version", F.lit(time.time_ns())).select("chunk_id", "doc_id", "version", "namespace").write.mode("append").partitionBy("namespace").parquet(f"{self.path}/gone")

    def delete_document(self, doc_id: int) -> None:
        self._bury(self.chunks().where(F.col("doc_id") == doc_id))

    def delete_chunk(self, chunk_id: str) -> None:
        self._bury(self.chunks().where(F.col("chunk_id") == chunk_id))

    def chunks(self, namespaces: list[str] | None = None) -> DataFrame:
        """The latest row of each chunk of the namespaces, without those deleted since; an empty list of namespaces gives none."""
        rows, gone = self._read("chunks", CHUNK), self._read("gone", _GONE)
        if namespaces is not None:
            rows, gone = (x.where(F.col("namespace").isin(*namespaces) if namespaces else F.lit(False)) for x in (rows, gone))
        latest = W.partitionBy("namespace", "chunk_id").orderBy(F.desc("version"))
        rows = rows.withColumn("__tw_n", F.row_number().over(latest)).where("__tw_n = 1").drop("__tw_n")
        last = gone.groupBy(F.col("namespace").alias("__tw_ns"), F.col("chunk_id").alias("__tw_c")).agg(F.max("version").alias("__tw_v"))
        on = (F.col("namespace") == F.col("__tw_ns")) & (F.col("chunk_id") == F.col("__tw_c")) & (F.col("version") <= F.col("__tw_v"))
        return rows.join(last, on, "left_anti")

    def count(self, namespaces: list[str] | None = None) -> int:
        return self.chunks(namespaces).count()

    def namespaces(self) -> list[str]:
        return sorted(r["namespace"] for r in self.chunks().select("namespace").distinct().collect())

    def get(self, chunk_id: str):
        return self.chunks().where(F.col("chunk_id") == chunk_id).first()

    def _filtered(self, where: list | None, namespaces: list[str] | None) -> DataFrame:
        return self.chunks(namespaces).where(filters.all_of(where or [], filters.from_map()))

    def search(self, vector: list[float], k: int = 10, where: list | None = None, namespaces: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
        """The k chunks of highest cosine, filters first."""
        query = F.array(*(F.lit(float(x)) for x in vector))
        rows = self._filtered(where, namespaces).where("embedding is not null").withColumn("score", F.round(V.cosine("embedding", query), 9))
        return search.top_k(rows.where(F.col("score") >= min_score), k, tie="chunk_id").select("chunk_id", "doc_id", "content", "score")

    def search_keywords(self, text: str, k: int = 10, where: list | None = None, namespaces: list[str] | None = None) -> DataFrame:
        """The k chunks of highest BM25 score over the live chunks that pass the filters."""
        rows = self._filtered(where, namespaces).select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
        q = self.spark.createDataFrame([(0, text)], "query_id long, query string")
        scored = keyword.bm25(q, rows).withColumn("score", F.round("score", 9))
        return search.top_k(scored, k, tie="doc_id").select(F.col("doc_id").alias("chunk_id"), "score")

    def search_hybrid(self, text: str, vector: list[float], weight: float, k: int = 10, where: list | None = None, namespaces: list[str] | None = None, min_score: float = 0.0) -> DataFrame:
        """Cosine and BM25 joined: (1 - weight) * cosine + weight * BM25."""
        key = ("query_id", "chunk_id")
        v = self.search(vector, k, where, namespaces).select(F.lit(0).alias("query_id"), "chunk_id", "score")
        rows = self._filtered(where, namespaces).select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
        q = self.spark.createDataFrame([(0, text)], "query_id long, query string")
        b = keyword.bm25(q, rows).withColumnRenamed("doc_id", "chunk_id")
        both = keyword.hybrid(v, b, weight, min_score, key).withColumn("score", F.round("score", 9))
        return search.top_k(both, k, tie="chunk_id").select("chunk_id", "vector_score", "keyword_score", "score")

    def integrity(self) -> DataFrame:
        """(problem, n): chunks without content, vectors of a length that isn't the usual one."""
        live = self.chunks()
        usual = live.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
        empty = live.where("content is null or content = ''").agg(F.count("*").alias("n")).select(F.lit("empty content").alias("problem"), "n")
        odd = live.where("embedding is not null").join(usual, F.size("embedding") == F.col("d"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("odd dimension").alias("problem"), "n")
        return empty.union(odd)
