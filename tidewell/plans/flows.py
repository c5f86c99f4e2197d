"""Queries that run loaders, chunkers and streams over whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tidewell.functions.embed import mock_vectors
from tidewell.operators import chunking
from tidewell.plans.base import query
from tidewell.session import shared_dir
from tidewell.sources.files import load_csv, load_json, split_markdown
from tidewell.sources.files import load_text as load_text_files
from tidewell.sources.html import html_text
from tidewell.streaming import streams


@query()
def html_extract(t):
    return t.texts("pages").select("page_id", html_text()("html").alias("x")).select("page_id", "x.title", "x.content")


def _folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/tidewell-{name}-{uuid.uuid4().hex}"


@query("SELECT source AS folder, CAST(count(*) AS BIGINT) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT source, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line FROM documents WHERE text <> '') GROUP BY source")
def load_text(t):
    """All texts, written as text files in a folder for each source, and loaded from there."""
    at = _folder(t, "texts")
    t.documents.where("text <> ''").select("source", F.regexp_replace("text", "\r", "").alias("value")).write.partitionBy("source").text(at)
    rows = load_text_files(t.spark, at).withColumn("folder", F.regexp_extract("source", "/source=([^/]*)/", 1))
    # A file of several texts ends each with a line end, the last one too.
    lines = rows.select("folder", F.split(F.regexp_replace("content", "\n$", ""), "\n").alias("x"))
    size = F.aggregate(F.transform("x", lambda v: F.char_length(v).cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    return lines.groupBy("folder").agg(F.sum(F.size("x").cast("long")).alias("lines"), F.sum(size).alias("chars"))


@query("SELECT concat_ws(' | ', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment) AS content, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer")
def load_csv_row_docs(t):
    """All customers, written as CSV and loaded as a document each."""
    at = _folder(t, "csv")
    t.customer.select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(at)
    rows = load_csv(t.spark, at, id_col="c_custkey")
    return rows.select("content", "id", F.col("metadata")["c_name"].alias("name"))


#: Events in a JSON file.
_FILE = 20_000


@query("SELECT 'e' || event_id AS id, json_extract_string(props, '$.k') AS content, event_type AS kind FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_props_docs(t):
    """All events, written as JSON objects and loaded by dotted paths."""
    at = _folder(t, "json")
    one = F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("key"), F.col("event_type").alias("kind"), F.from_json("props", "k bigint").alias("p")))
    # A file is an array, which its reader holds whole: more events make more files, not longer ones.
    files = max(64, -(-t.events.count() // _FILE))
    rows = t.events.groupBy(F.pmod("event_id", F.lit(files)).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    rows.write.partitionBy("part").text(at)
    return load_json(t.spark, at, "p.k", "key").select("id", "content", F.col("metadata")["kind"].alias("kind"))


@query()
def load_markdown(t):
    docs = t.documents.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content"))
    return split_markdown(docs).select("id", "title", "source", "content")


@query()
def chunk_fixed(t):
    return chunking.chunked(t.texts("documents"), chunking.fixed)


@query()
def chunk_recursive(t):
    return chunking.chunked(t.texts("documents"), chunking.recursive)


@query()
def chunk_adaptive(t):
    return chunking.chunked(t.texts("documents"), chunking.adaptive)


@query()
def chunk_document_aware(t):
    """Lines as sections, and fixed chunks inside them."""
    return chunking.chunked(t.texts("documents"), lambda text: chunking.by_sections(text, lambda part: chunking.fixed(part, least=1), "\n"))


@query()
def chunk_semantic(t):
    return chunking.chunked(t.texts("documents"), lambda text: chunking.semantic(text, lambda s: mock_vectors(s, 64)))


def _stream(t, name: str):
    return streams.stream(t.spark, os.path.join(t.sf_dir, f"{name}.parquet"))


@query()
def stream_chunk(t):
    return streams.drained(streams.chunk_stream(_stream(t, "documents"), chunking.recursive))


@query("SELECT event_id, user_id, ts FROM events")
def stream_dedup(t):
    """Every event comes twice, and is kept once."""
    twice = _stream(t, "events").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return streams.drained(streams.dedup_stream(twice, ["event_id"], "ts", "1 hour").select("event_id", "user_id", "ts"))


@query("SELECT user_id, CAST(least(count(*), 100) AS BIGINT) AS held, CAST(epoch_us(max(ts)) AS BIGINT) AS newest, count(*) AS total FROM events GROUP BY user_id")
def stream_query_log(t):
    """The state after the last batch of each user."""
    rows = streams.drained(streams.bounded_log(_stream(t, "events").select("user_id", "ts")))
    return rows.groupBy("user_id").agg(F.max_by("held", "total").alias("held"), F.max("newest").alias("newest"), F.max("total").alias("total"))


@query("WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events, m GROUP BY 1, 2, mark HAVING time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= mark")
def stream_windows(t):
    rows = streams.drained(streams.windowed(_stream(t, "events"), "ts", "1 hour", "10 minutes", "event_type", "value"))
    return rows.withColumn("mean", F.round("mean", 6))
