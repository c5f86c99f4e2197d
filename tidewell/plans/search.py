"""Queries of vector search, quantisation, keyword search and fusion."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.operators import keyword, search
from tidewell.plans.base import query
from tidewell.plans.ingest import STOP_SQL

_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(t):
    b = t.embeddings.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(b, F.col("vec_id") + 1 == F.col("right_id")).select(F.col("vec_id").alias("left_id"), "right_id", F.round(V.cosine("embedding", "other"), 6).alias("cosine"))


@query(f"WITH l AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) SELECT vec_id, label, round({_COS.format(a='embedding', b='prev')}, 6) AS similarity FROM l WHERE prev IS NOT NULL")
def neighbour_similarity(t):
    rows = t.embeddings.withColumn("prev", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).where("prev is not null")
    return rows.select("vec_id", "label", F.round(V.cosine("embedding", "prev"), 6).alias("similarity"))


_POS = "SELECT {k}generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"


@query(f"SELECT label, CAST(pos AS BIGINT) AS pos, round(avg(x), 6) AS mean FROM ({_POS.format(k='label, ')}) GROUP BY label, pos")
def centroid_by_label(t):
    return search.mean_vectors(t.embeddings, "label").select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


_CENTRE = f"c AS (SELECT list(m ORDER BY pos) AS centre FROM (SELECT pos, avg(x) AS m FROM ({_POS.format(k='')}) GROUP BY pos))"
_NEAR = _COS.format(a="embedding", b="centre")


def _centre(t):
    return search.mean_vectors(t.embeddings).agg(F.sort_array(F.collect_list(F.struct("pos", "mean"))).alias("m")).select(F.col("m.mean").alias("centre"))


@query(f"WITH {_CENTRE} SELECT vec_id, round({_NEAR}, 6) AS score FROM embeddings, c WHERE {_NEAR} >= 0 ORDER BY round({_NEAR}, 9) DESC, vec_id LIMIT 10")
def vector_topk(t):
    """The ten vectors nearest to the mean of all."""
    scored = t.embeddings.crossJoin(_centre(t)).select("vec_id", F.round(V.cosine("embedding", "centre"), 9).alias("score")).where("score >= 0")
    return search.top_k(scored, 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM p WHERE s >= 0)
SELECT query_id, vec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 10""")
def vector_topk_batch(t):
    """The ten nearest of every vector."""
    return search.batch_top_k(t.embeddings, t.embeddings, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_CENTRE}, s AS (SELECT label, vec_id, {_NEAR} AS s FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s WHERE s >= 0) SELECT label, vec_id, round(s, 6) AS score, rank FROM r WHERE rank <= 5")
def vector_topk_namespaces(t):
    scored = t.embeddings.crossJoin(_centre(t)).select("label", "vec_id", F.round(V.cosine("embedding", "centre"), 9).alias("score")).where("score >= 0")
    return search.top_k_by(scored, ["label"], 5).select("label", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_CENTRE}, s AS (SELECT vec_id, CASE WHEN label < 5 THEN 'text' ELSE 'image' END AS modality, {_NEAR} AS s FROM embeddings, c) SELECT vec_id, modality, round(s, 6) AS score FROM s WHERE s >= 0 ORDER BY round(s, 9) DESC, vec_id LIMIT 10")
def multimodal_topk(t):
    scored = t.embeddings.crossJoin(_centre(t)).select("vec_id", F.when(F.col("label") < 5, "text").otherwise("image").alias("modality"), F.round(V.cosine("embedding", "centre"), 9).alias("score"))
    return search.top_k(scored.where("score >= 0"), 10).withColumn("score", F.round("score", 6))


_BOUNDS = f"b AS (SELECT list(lo ORDER BY pos) AS lows, list(hi ORDER BY pos) AS highs FROM (SELECT pos, min(x) AS lo, max(x) AS hi FROM ({_POS.format(k='')}) GROUP BY pos))"
_CODES = f"""WITH {_BOUNDS},
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CAST(CASE WHEN highs[i] > lows[i] THEN least(greatest(floor((x - lows[i]) / (highs[i] - lows[i]) * 255 + 0.5), 0), 255) ELSE 0 END AS INTEGER)) AS codes, lows, highs FROM embeddings, b),
d AS (SELECT vec_id, e, codes, list_transform(codes, lambda c, i: lows[i] + c / 255.0::DOUBLE * (highs[i] - lows[i])) AS decoded FROM v)"""


def _coded(t):
    return t.embeddings.crossJoin(search.sq8_bounds(t.embeddings)).withColumn("codes", search.sq8_encode(F.col("embedding"), F.col("lows"), F.col("highs")))


@query(f"{_CODES} SELECT vec_id, codes FROM d")
def sq8_codes(t):
    return _coded(t).select("vec_id", "codes")


@query(f"{_CODES} SELECT round(avg(list_sum(list_transform(list_zip(e, decoded), lambda p: abs(p[1] - p[2]))) / len(e)), 6) AS mae, CAST(sum(len(codes)) AS BIGINT) AS memory_bytes FROM d")
def sq8_mae(t):
    decoded = search.sq8_decode(F.col("codes"), F.col("lows"), F.col("highs"))
    error = F.aggregate(F.zip_with(V.double("embedding"), decoded, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x) / F.size("codes")
    return _coded(t).agg(F.round(F.avg(error), 6).alias("mae"), F.sum(F.size("codes")).alias("memory_bytes"))


@query(f"{_CODES}, {_CENTRE} SELECT vec_id, round(list_cosine_similarity(decoded, centre), 6) AS score FROM d, c ORDER BY round(list_cosine_similarity(decoded, centre), 9) DESC, vec_id LIMIT 10")
def sq8_topk(t):
    decoded = search.sq8_decode(F.col("codes"), F.col("lows"), F.col("highs"))
    scored = _coded(t).crossJoin(_centre(t)).select("vec_id", F.round(V.cosine(decoded, "centre"), 9).alias("score"))
    return search.top_k(scored, 10).withColumn("score", F.round("score", 6))


_ITEMS = f"""WITH p AS (SELECT q.vec_id AS query_id, CAST(e.label AS BIGINT) AS item, {_COS.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q, embeddings e)
SELECT query_id, item, round({{how}}, 6) AS score FROM p GROUP BY query_id, item"""


def _items(t, what: str):
    return search.item_scores(t.embeddings, t.embeddings, "label").select("query_id", "item", F.round(what, 6).alias("score"))


@query(_ITEMS.format(how="max(s)"))
def multivector_maxsim(t):
    return _items(t, "maxsim")


@query(_ITEMS.format(how="avg(s)"))
def multivector_mean(t):
    return _items(t, "mean")


@query(_ITEMS.format(how="list_avg(list_slice(list(s ORDER BY s DESC), 1, 3))"))
def multivector_topmean(t):
    return _items(t, "topmean")


@query("SELECT count(*) AS n_pairs, round(avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS mean_l2 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def embedding_diversity(t):
    return search.mean_distance(t.embeddings).select("n_pairs", F.round("mean_l2", 6).alias("mean_l2"))


@query()
def ann_ivf_topk(t):
    return search.ivf_top_k(t.embeddings, t.embeddings, 10).withColumn("score", F.round("score", 6))


@query()
def pq_encode(t):
    return search.pq_encode(t.embeddings, search.Product(search.training_sample(t.embeddings, 20_000)))


@query()
def pq_topk(t):
    model = search.Product(search.training_sample(t.embeddings, 20_000))
    return search.pq_search(t.embeddings, t.embeddings, model, 10).withColumn("score", F.round("score", 6))


TERMS = "list_filter(regexp_extract_all(lower(COL), '[\\p{L}\\p{Nd}]+'), lambda w: w NOT IN (" + STOP_SQL + "))"
_INDEX = f"""ix AS (SELECT doc_id, {TERMS.replace("COL", "text")} AS terms FROM documents WHERE text IS NOT NULL),
dl AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS dl FROM ix),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
po AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM ix) GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term)"""
_BM25 = f"""{_INDEX},
qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest({TERMS.replace("COL", "text")}) AS term FROM benchmark) GROUP BY query_id, term),
kw AS (SELECT query_id, doc_id, sum(qn * ln((n_docs + 1)::DOUBLE / (df + 1) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM qt JOIN po USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY query_id, doc_id HAVING score > 0)"""


@query(f"WITH {_INDEX} SELECT doc_id, dl AS n_terms FROM dl")
def tokenize_counts(t):
    return keyword.index(t.texts("documents")).select("doc_id", F.col("dl").alias("n_terms"))


@query(f"WITH {_INDEX} SELECT (SELECT count(*) FROM df) AS n_terms, n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM po) AS n_postings FROM st")
def bm25_index_stats(t):
    ix = keyword.index(t.texts("documents"))
    counts = ix.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_postings"))
    return counts.crossJoin(keyword.corpus_statistics(ix)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {_INDEX} SELECT term, df FROM df")
def term_df(t):
    return keyword.index(t.texts("documents")).select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def queries_of(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def keyword_scores(t):
    return keyword.bm25(queries_of(t), t.texts("documents"))


def vector_scores(t, k: int = 10, least: float = 0.0):
    """The k best cosines, from `least`, of the benchmark items' vectors (those of the same number) with the documents' vectors."""
    q = t.embeddings.join(t.benchmark.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    rows = search.batch_top_k(q, t.embeddings, k, same=True, min_score=least)
    return rows.select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


def best(df, k: int = 10):
    rows = search.top_k_by(df.withColumn("score", F.round("score", 9)), ["query_id"], k, tie="doc_id")
    return rows.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _best_sql(source: str, k: int = 10) -> str:
    return f"SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


KW_SQL = _BM25
VEC_SQL = f"""va AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {_COS.format(a='q.embedding', b='e.embedding')} AS score FROM embeddings q, embeddings e WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM va WHERE score >= 0),
vk AS (SELECT query_id, doc_id, round(score, 9) AS score FROM vr WHERE rank <= 10)"""


@query(f"WITH {KW_SQL} {_best_sql('kw')}")
def bm25_search(t):
    """BM25 of every benchmark item against all documents: the ten best."""
    return best(keyword_scores(t))


@query(f"WITH {KW_SQL}, {VEC_SQL}, fu AS (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT query_id, doc_id, 0.7 * score AS s FROM vk UNION ALL SELECT query_id, doc_id, 0.3 * score FROM kw) GROUP BY query_id, doc_id HAVING sum(s) > 0) {_best_sql('fu')}")
def fuse_weighted(t):
    return best(keyword.fuse_weighted([vector_scores(t), keyword_scores(t)], 0.7))


@query(f"""WITH {KW_SQL}, {VEC_SQL}, kr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM kw),
fu AS (SELECT query_id, doc_id, sum(s) AS score FROM (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM vr WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + r) FROM kr) GROUP BY query_id, doc_id) {_best_sql('fu')}""")
def fuse_rrf(t):
    return best(keyword.fuse_rrf([vector_scores(t), keyword_scores(t).withColumn("score", F.round("score", 9))]))


_HYBRID = "hy AS (SELECT query_id, doc_id, coalesce(v.score, 0) AS v, coalesce(k.score, 0) AS b, 0.5 * coalesce(v.score, 0) + 0.5 * coalesce(k.score, 0) AS score FROM {v} v FULL JOIN {k} k USING (query_id, doc_id)), hp AS (SELECT * FROM hy WHERE score > 0)"


@query(f"WITH {KW_SQL}, {VEC_SQL}, {_HYBRID.format(v='vk', k='kw')} {_best_sql('hp')}")
def hybrid_search(t):
    return best(keyword.hybrid(vector_scores(t), keyword_scores(t), 0.5))


@query(f"WITH {KW_SQL}, {VEC_SQL}, {_HYBRID.format(v='vk', k='kw')} SELECT query_id, doc_id, round(v, 6) AS vector_score, round(b, 6) AS keyword_score, round(score, 6) AS score FROM hp")
def hybrid_full_outer(t):
    h = keyword.hybrid(vector_scores(t), keyword_scores(t), 0.5)
    return h.select("query_id", "doc_id", *(F.round(c, 6).alias(c) for c in ("vector_score", "keyword_score", "score")))


@query(f"WITH {KW_SQL}, {VEC_SQL}, kt AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM kw) WHERE r <= 10), {_HYBRID.format(v='va', k='kt')} {_best_sql('hp')}")
def hybrid_search_allvec(t):
    """The ten best by keywords get their vectors' scores; of the others, only the best by vector can be among the final ten."""
    top = search.top_k_by(keyword_scores(t).withColumn("score", F.round("score", 9)), ["query_id"], 10, tie="doc_id").select("query_id", "doc_id", "score")
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("own"))
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("ask"))
    theirs = top.join(e, "doc_id").join(asked, "query_id").select("query_id", "doc_id", F.round(V.cosine("own", "ask"), 9).alias("score"))
    near = vector_scores(t, 20, -2.0).select("query_id", "doc_id", "score")
    return best(keyword.hybrid(near.union(theirs).distinct(), top, 0.5))


@query(f"WITH ix0 AS (SELECT doc_id, {TERMS.replace('COL', 'text')} AS terms FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id FROM labels WHERE quality = 0), n AS (SELECT doc_id, {TERMS.replace('COL', 'lang')} AS terms FROM documents WHERE doc_id % 10 = 0 AND lang IS NOT NULL), f AS (SELECT * FROM ix0 WHERE doc_id NOT IN (SELECT doc_id FROM g) AND doc_id % 10 <> 0 UNION ALL SELECT * FROM n) SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms FROM f")
def index_update(t):
    """The index without documents of bad quality; every tenth document is added again with its language as text."""
    ix = keyword.remove(keyword.index(t.texts("documents")), t.labels.where("quality = 0"))
    new = t.documents.where("doc_id % 10 = 0").select("doc_id", F.col("lang").alias("text"))
    return keyword.add(ix, new).select("doc_id", F.col("dl").alias("n_terms"))


@query()
def mock_embed(t):
    from tidewell.functions.embed import mock_embedding

    return t.documents.select("doc_id", mock_embedding(64)("text").alias("embedding"))
