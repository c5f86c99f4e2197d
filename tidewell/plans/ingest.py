"""Queries of scans, ingest, chunking, filters and store operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import chunking, filters, ingest
from tidewell.plans.base import query, sql_list


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def fn_slug(t):
    return t.part.select("p_partkey", X.slug("p_name").alias("slug"))


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS content FROM documents""")
def fn_normalize_ws(t):
    return t.documents.select("doc_id", X.normalize_ws("text").alias("content"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def html_title(t):
    return t.pages.select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", ingest.content_hash().alias("hash"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS hash FROM documents GROUP BY text")
def dedup_exact(t):
    return ingest.dedup_exact(t.documents).select("doc_id", ingest.content_hash().alias("hash"))


#: The stored state of an earlier run: hashes of the labelled documents as they were with outer blanks removed.
_STATE = "(SELECT DISTINCT d.doc_id AS id, sha256(trim(d.text)) AS hash FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _state(t):
    return t.documents.join(t.labels.select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.sha2(F.trim("text"), 256).alias("hash"))


@query(f"SELECT d.doc_id, sha256(d.text) AS hash FROM documents d LEFT JOIN {_STATE} s ON s.id = d.doc_id WHERE sha256(d.text) IS DISTINCT FROM s.hash")
def incremental_delta(t):
    return ingest.incremental_delta(t.documents.select("doc_id", "text"), _state(t)).select("doc_id", "hash")


_RULES = {"least": 200, "most": 20_000, "required": ("lang",), "source": "source", "prefixes": ("src1", "src0", "web")}
_PROBLEMS = """list_filter([CASE WHEN strlen(text) < 200 THEN 'too_short' END, CASE WHEN strlen(text) > 20000 THEN 'too_long' END,
 CASE WHEN trim(coalesce(lang, '')) = '' THEN 'missing_lang' END,
 CASE WHEN NOT coalesce(starts_with(source, 'src1') OR starts_with(source, 'src0') OR starts_with(source, 'web'), false) THEN 'source_not_allowed' END], lambda x: x IS NOT NULL)"""


@query(f"SELECT doc_id, array_to_string({_PROBLEMS}, ',') AS problems FROM documents WHERE len({_PROBLEMS}) > 0")
def validate_documents(t):
    found = t.documents.select("doc_id", ingest.problems(**_RULES).alias("p")).where(F.size("p") > 0)
    return found.select("doc_id", F.array_join("p", ",").alias("problems"))


@query(f"""WITH r AS (SELECT d.*, sha256(d.text) AS hash, (s.id IS NOT NULL AND sha256(d.text) IS NOT DISTINCT FROM s.hash) AS same FROM documents d LEFT JOIN {_STATE} s ON s.id = d.doc_id),
n AS (SELECT *, row_number() OVER (PARTITION BY hash, same ORDER BY doc_id) AS n FROM r)
SELECT CASE WHEN same THEN 'unchanged' WHEN n > 1 THEN 'duplicate' WHEN len({_PROBLEMS}) > 0 THEN 'invalid' ELSE 'uploaded' END AS status, count(*) AS n FROM n GROUP BY 1""")
def ingest_summary(t):
    return ingest.run(t.documents, _state(t), ingest.problems(**_RULES)).groupBy("status").agg(F.count("*").alias("n"))


_PARTS = "list_filter(list_transform(string_split(text, {sep}), lambda x: trim(x)), lambda x: x <> '')"


def _parts_sql(sep: str, columns: str) -> str:
    return f"""WITH p AS (SELECT doc_id, {_PARTS.format(sep=sep)} AS parts FROM documents),
e AS (SELECT doc_id, len(parts) AS chunk_count, unnest(range(len(parts))) AS chunk_index, unnest(parts) AS content FROM p)
SELECT {columns} FROM e"""


@query(_parts_sql("chr(10)", "doc_id || '::chunk-' || chunk_index AS chunk_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, content"))
def chunk_split_paragraphs(t):
    return chunking.split_parts(t.documents, "\n").drop("chunk_count")


@query(_parts_sql("chr(10) || '---' || chr(10)", "doc_id || '::chunk-' || chunk_index AS chunk_id, doc_id, CAST(chunk_index AS BIGINT) AS section_index, CAST(chunk_count AS BIGINT) AS section_count, content"))
def chunk_sections(t):
    return chunking.split_parts(t.documents, "\n---\n").withColumnsRenamed({"chunk_index": "section_index", "chunk_count": "section_count"})


_SENTENCES = "list_filter(list_transform(regexp_extract_all({c}, '[^.!?\\n]*[.!?\\n]?'), lambda x: trim(translate(x, chr(10) || chr(9) || chr(13), '   '))), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, {_SENTENCES.format(c="text")} AS s FROM documents),
e AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN 0 ELSE list_sum(list_transform(s, lambda x: length(x))) // len(s) END AS mean FROM d)
SELECT doc_id, CAST(least(greatest(mean * 6 // 4, 64), 512) AS BIGINT) AS tokens FROM e""")
def adaptive_target_tokens(t):
    return t.documents.select("doc_id", chunking.adaptive_tokens("text").alias("tokens"))


@query(f"SELECT doc_id, CAST(len({_SENTENCES.format(c='text')}) AS BIGINT) AS n_sentences FROM documents")
def sentence_counts(t):
    return t.documents.select("doc_id", F.size(X.sentences("text")).cast("long").alias("n_sentences"))


@query(f"SELECT doc_id, coalesce({_SENTENCES.format(c='text')}[1], '') AS snippet FROM documents")
def first_sentence(t):
    return t.documents.select("doc_id", X.first_sentence("text").alias("snippet"))


@query("SELECT doc_id, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM documents")
def fn_tokens(t):
    return t.documents.select("doc_id", X.token_estimate("text").alias("tokens"))


_SCRIPT_SQL = [(k, f"length(regexp_replace(text, '[^{v}]', '', 'g'))") for k, v in X.SCRIPTS.items()]
_SCRIPT_SQL = sorted([*_SCRIPT_SQL, ("en", f"length(regexp_replace(regexp_replace(text, '[{''.join(X.SCRIPTS.values())}]', '', 'g'), '[^\\p{{L}}]', '', 'g'))")])


@query(f"WITH c AS (SELECT doc_id, {', '.join(f'{q} AS {k}_n' for k, q in _SCRIPT_SQL)} FROM documents), m AS (SELECT *, greatest({', '.join(f'{k}_n' for k, _ in _SCRIPT_SQL)}) AS most FROM c) SELECT doc_id, CASE WHEN most = 0 THEN 'unknown' {' '.join(f'WHEN {k}_n = most THEN {chr(39)}{k}{chr(39)}' for k, _ in _SCRIPT_SQL)} END AS language FROM m")
def detect_script_language(t):
    return t.documents.select("doc_id", X.script_language("text").alias("language"))


@query(f"""WITH p AS (SELECT doc_id, {_SENTENCES.format(c="text")} AS children, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS parents FROM documents),
a AS (SELECT doc_id, parents, unnest(range(len(children))) AS child_index, unnest(children) AS content FROM p),
b AS (SELECT doc_id, child_index, trim(substr(content, 1, 64)) AS anchor, trim(substr(content, 1, 16)) AS short, parents FROM a)
SELECT doc_id, CAST(child_index AS BIGINT) AS child_index, CAST(coalesce(nullif(list_position(list_transform(parents, lambda x: contains(x, anchor)), true), 0), nullif(list_position(list_transform(parents, lambda x: contains(x, short)), true), 0)) - 1 AS BIGINT) AS parent_index FROM b""")
def parent_child(t):
    """Sentences as children of lines."""
    children = t.documents.select("doc_id", F.posexplode(X.sentences("text")).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))
    return chunking.parents_of(children, chunking.split_parts(t.documents, "\n"))


_F = filters


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12'")
def filter_term(t):
    return t.part.where(_F.Term("p_brand", "Brand#12").column()).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#12', 'Brand#23', 'Brand#45')")
def filter_in(t):
    return t.part.where(_F.TermIn("p_brand", ("Brand#12", "Brand#23", "Brand#45")).column()).select("p_partkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 30")
def filter_range(t):
    return t.part.where(_F.Range("p_size", 10, 30, high_open=True).column()).select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1996-12-31'")
def filter_date_range(t):
    return t.orders.where(_F.DateRange("o_orderdate", "1995-01-01", "1996-12-31").column()).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) > 1996 AND year(o_orderdate) <> 1998")
def filter_year(t):
    return t.orders.where(filters.all_of([filters.Year("o_orderdate", 1996, "gt"), filters.Year("o_orderdate", 1998, "ne")])).select("o_orderkey")


_ALL = [filters.TermIn("p_brand", ("Brand#12", "Brand#23", "Brand#34")), None, filters.Range("p_size", 5, 40), filters.Range("p_retailprice", 930.0)]


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#12', 'Brand#23', 'Brand#34') AND p_size BETWEEN 5 AND 40 AND p_retailprice >= 930")
def filter_all(t):
    return t.part.where(filters.all_of(_ALL)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#12', 'Brand#23') INTERSECT SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 40")
def metadata_candidates(t):
    """Postings of two keys, intersected, from a map column."""
    get = filters.from_map()
    rows = t.part.select("p_partkey", F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("metadata"))
    return rows.where(_F.TermIn("brand", ("Brand#12", "Brand#23")).column(get)).select("p_partkey").intersect(rows.where(_F.Range("size", 5, 40).column(get)).select("p_partkey"))


@query("SELECT DISTINCT p_brand AS value FROM part")
def metadata_values(t):
    return t.part.select(F.col("p_brand").alias("value")).distinct()


@query("SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src3', 'src7')")
def namespace_scope(t):
    return t.documents.where(F.col("source").isin("src0", "src3", "src7")).select("doc_id", "source")


@query("SELECT coalesce(source, 'default') AS namespace, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def store_counts(t):
    return t.documents.groupBy(F.coalesce("source", F.lit("default")).alias("namespace")).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def delete_document(t):
    return ingest.delete(t.documents.select("doc_id", "source"), t.labels.where("quality = 0"), "doc_id")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_type, event_id, value FROM e WHERE n = 1""")
def upsert_latest(t):
    e = t.events.withColumn("key", F.struct("user_id", "event_type")).withColumn("version", F.struct("ts", "event_id"))
    return ingest.upsert(e.where("value is null or value < 50"), e.where("value >= 50"), "key", "version").select("user_id", "event_type", "event_id", "value")


@query("SELECT 'label without document' AS problem, count(*) AS n FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) UNION ALL SELECT 'document without text', count(*) FROM documents WHERE text IS NULL OR text = '' UNION ALL SELECT 'line without order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def integrity_orphans(t):
    one = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("problem"), "n")
    labels = t.labels.join(t.documents, "doc_id", "left_anti")
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")
    return one(labels, "label without document").union(one(t.documents.where("text is null or text = ''"), "document without text")).union(one(lines, "line without order"))


@query("SELECT d.doc_id, e.label, len(e.embedding) AS dim FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def join_chunk_embedding(t):
    return t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id")).select("doc_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("SELECT d.doc_id, e.label, e.vec_id IS NOT NULL AS embedded FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def left_join_embedding(t):
    return t.documents.join(t.embeddings, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "label", F.col("vec_id").isNotNull().alias("embedded"))


_SOURCES = {
    "pricing": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "segment_orders": "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment, o_orderpriority",
    "nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name",
    "running_total": "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders",
    "forecast": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
}


def _source(name: str, sql: str) -> None:
    def run(t):
        from tidewell.sources.connectors import sql_documents

        return sql_documents(t.spark, sql, {n: getattr(t, n) for n in ("lineitem", "orders", "customer", "supplier", "nation", "part", "region")})

    query(sql, f"sql_source_{name}")(run)


for _name, _sql in _SOURCES.items():
    _source(_name, _sql)

STOP_SQL = sql_list(X.STOP)
FILLER_SQL = sql_list(X.FILLER)
