"""Queries of re-ranking, query understanding, contexts, evaluation, feedback, analytics and the cluster."""

from __future__ import annotations


from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import analytics, cluster, context, evaluate, feedback, keyword, rerank, search
from tidewell.plans import search as S
from tidewell.plans.base import query, sql_list
from tidewell.plans.ingest import _SENTENCES, FILLER_SQL
from tidewell.session import written

_KW = S.KW_SQL
_CAND = f"{_KW}, ca AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM kw) WHERE rank <= 20), cd AS (SELECT ca.*, b.text AS query, d.text FROM ca JOIN benchmark b ON b.item_id = ca.query_id JOIN documents d USING (doc_id))"


def candidates(t):
    """The twenty best documents of every benchmark item by BM25, with both texts."""
    top = search.top_k_by(S.keyword_scores(t).withColumn("s9", F.round("score", 9)), ["query_id"], 20, score="s9", tie="doc_id").drop("s9")
    rows = top.join(t.documents.select("doc_id", "text"), "doc_id").join(S.queries_of(t), "query_id")
    return written(rows.select("query_id", "query", "doc_id", "text", "score", "rank"), "candidates")


@query(f"WITH {_CAND} SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END, 6) AS unit FROM ca WINDOW w AS (PARTITION BY query_id)")
def minmax_norm(t):
    return candidates(t).select("query_id", "doc_id", F.round(rerank.unit("score"), 6).alias("unit"))


_T = S.TERMS
_SPARSE = f"""{_CAND}, ct AS (SELECT query_id, doc_id, {_T.replace('COL', 'text')} AS terms FROM cd), cl AS (SELECT query_id, doc_id, len(terms) AS dl FROM ct),
cs AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM cl GROUP BY query_id), cp AS (SELECT query_id, doc_id, term, count(*) AS tf FROM (SELECT query_id, doc_id, unnest(terms) AS term FROM ct) GROUP BY ALL),
cf AS (SELECT query_id, term, count(*) AS df FROM cp GROUP BY ALL),
sp AS (SELECT query_id, doc_id, sum(qn * ln((n + 1)::DOUBLE / (df + 1) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS found FROM qt JOIN cp USING (query_id, term) JOIN cf USING (query_id, term) JOIN cl USING (query_id, doc_id) JOIN cs USING (query_id) GROUP BY ALL),
sr AS (SELECT query_id, doc_id, coalesce(found, score) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(found, score), 9) DESC, round(score, 9) DESC, doc_id) AS rerank_rank FROM ca LEFT JOIN sp USING (query_id, doc_id))"""


@query(f"WITH {_SPARSE} SELECT query_id, doc_id, round(rerank_score, 6) AS rerank_score, rerank_rank FROM sr")
def rerank_sparse(t):
    return rerank.sparse(candidates(t)).select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


_WORDS = "list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"
_FEATURES = f"""{_CAND}, fe AS (SELECT query_id, doc_id, score AS f_score, CASE WHEN len({_WORDS.format(c='query')}) > 0 THEN len(list_intersect({_WORDS.format(c='query')}, {_WORDS.format(c='text')}))::DOUBLE / len({_WORDS.format(c='query')}) ELSE 0 END AS f_overlap,
 1.0::DOUBLE / (1 + len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS f_length FROM cd)"""


@query(f"WITH {_FEATURES} SELECT query_id, doc_id, round(f_score, 6) AS f_score, round(f_overlap, 6) AS f_overlap, round(f_length, 6) AS f_length FROM fe")
def ltr_features(t):
    rows = rerank.ltr_features(candidates(t))
    return rows.select("query_id", "doc_id", *(F.round(c, 6).alias(c) for c in ("f_score", "f_overlap", "f_length")))


@query()
def ltr_rerank(t):
    """Weights from candidates whose document is labelled: good quality is relevant."""
    cand = candidates(t)
    rows = rerank.ltr_features(cand).join(t.labels.groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id")
    out = rerank.ltr(cand, rerank.fit_sample(rows))
    return out.select("query_id", "doc_id", F.round("rerank_score", 6).alias("rerank_score"), "rerank_rank")


@query(f"""WITH {_SPARSE}, {'fe AS' + _FEATURES.split(', fe AS', 1)[1]},
r1 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, doc_id) AS r FROM sr), r2 AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(f_overlap, 9) DESC, doc_id) AS r FROM fe)
SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS rerank_score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY query_id, doc_id""")
def rerank_ensemble(t):
    cand = candidates(t)
    overlap = rerank.ltr_features(cand).withColumn("rerank_score", F.col("f_overlap"))
    return rerank.ensemble([rerank.sparse(cand), overlap]).withColumn("rerank_score", F.round("rerank_score", 6))


@query("SELECT conv_id, turn, least(greatest(coalesce(TRY_CAST(nullif(regexp_extract(text, '(-?\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE), 0) / 10, 0), 1) AS score FROM conversations")
def parse_score(t):
    return t.conversations.select("conv_id", "turn", X.parse_score("text").alias("score"))


# --- query understanding: every user turn is a query

_USER = "SELECT conv_id, turn, text AS q, lower(text) AS l FROM conversations WHERE role = 'user'"


def _has(words, c="l"):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_INTENT = f"""CASE WHEN {_has(X.TEMPORAL)} THEN 'temporal' WHEN {_has(X.CAUSAL)} THEN 'causal' WHEN {_has(X.COMPARATIVE)} THEN 'comparative' WHEN {_has(X.PROCEDURAL)} THEN 'procedural'
 WHEN {' OR '.join(f"starts_with(l, '{w} ')" for w in X.EXISTENTIAL)} OR starts_with(l, 'is there') OR starts_with(l, 'are there') THEN 'existential' WHEN {_has([' vs ', ' versus ', ' compare ', ' and '])} THEN 'comparative' ELSE 'factual' END"""
_ENTS = f"list_filter(list_transform(string_split(trim(regexp_replace(q, '\\s+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^[.,;:!?\"''()\\[\\]{{}}]+|[.,;:!?\"''()\\[\\]{{}}]+$', '', 'g')), lambda w: strlen(w) >= 2 AND lower(w) NOT IN ({sql_list(X._QUERY_STOP)}) AND regexp_matches(w, '^[A-Z]'))"


def _user(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))


@query(f"SELECT conv_id, turn, {_INTENT} AS intent FROM ({_USER})")
def query_intent(t):
    return _user(t).select("conv_id", "turn", X.intent("q").alias("intent"))


@query(f"SELECT conv_id, turn, {_INTENT} AS intent, array_to_string({_ENTS}, '|') AS entities, round(0.5 + CASE WHEN len({_ENTS}) > 0 THEN 0.2 ELSE 0 END + 0.1, 6) AS confidence FROM ({_USER})")
def query_parse(t):
    ents = X.query_entities("q")
    confidence = F.round(0.5 + F.when(F.size(ents) > 0, 0.2).otherwise(0.0) + 0.1, 6)
    return _user(t).select("conv_id", "turn", X.intent("q").alias("intent"), F.array_join(ents, "|").alias("entities"), confidence.alias("confidence"))


_ASKED = "list_distinct(list_filter(list_transform(list_zip(string_split(q, '?'), range(len(string_split(q, '?')))), lambda p: CASE WHEN trim(p[1]) = '' THEN '' ELSE trim(p[1]) || CASE WHEN p[2] < len(string_split(q, '?')) - 1 THEN '?' ELSE '' END END), lambda p: p <> ''))"


def _splits() -> str:
    out = ""
    for sep in [" and ", " or ", "; ", " what about ", " also "]:
        at = f"instr(l, '{sep}')"
        a, b = f"trim(substr(q, 1, {at} - 1))", f"trim(substr(q, {at} + {len(sep)}))"
        out += f" WHEN {at} > 1 AND {a} <> '' AND {b} <> '' THEN CASE WHEN {a} = {b} THEN [{a}] ELSE [{a}, {b}] END"
    return out


@query(f"SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n, list_aggregate(list_sort(p), 'string_agg', chr(1)) AS parts FROM (SELECT conv_id, turn, CASE WHEN length(q) - length(replace(q, '?', '')) >= 2 AND len({_ASKED}) > 1 THEN {_ASKED}[1:5] WHEN length(q) - length(replace(q, '?', '')) >= 2 THEN [q] {_splits()} ELSE [q] END AS p FROM ({_USER}))")
def query_decompose(t):
    p = X.decompose("q")
    return _user(t).select("conv_id", "turn", F.size(p).cast("long").alias("n"), F.array_join(F.array_sort(p), "\x01").alias("parts"))


@query(f"""WITH e AS (SELECT conv_id, turn, list_distinct(list_transform({_ENTS}, lambda w: lower(w))) AS es FROM ({_USER})), x AS (SELECT conv_id, turn, unnest(es) AS entity FROM e),
pr AS (SELECT lower(p[1]) AS a, lower(p[2]) AS b, count(*) AS n FROM (SELECT unnest(list_zip(es[1:len(es) - 1], es[2:])) AS p FROM (SELECT list_sort(es) AS es FROM e) WHERE len(es) > 1) GROUP BY 1, 2),
rk AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pr)
SELECT conv_id, turn, entity, b AS expansion, round(0.7 * 0.7 * 0.5 * n / sum(n) OVER (PARTITION BY conv_id, turn, entity), 6) AS confidence FROM x JOIN rk ON rk.a = x.entity WHERE r <= 5""")
def query_expand(t):
    """Entities of each query with at most five neighbours from the graph of entities that are named together."""
    es = F.array_distinct(F.transform(X.query_entities("q"), lambda w: F.lower(w)))
    rows = _user(t).select("conv_id", "turn", es.alias("es"))
    s = F.array_sort("es")
    many = F.greatest(F.size(s) - 1, F.lit(0))
    pairs = rows.select(F.explode(F.zip_with(F.slice(s, 1, many), F.slice(s, 2, many), lambda a, b: F.struct(a.alias("entity"), b.alias("expansion")))).alias("p")).select("p.*")
    graph = pairs.groupBy("entity", "expansion").agg(F.count("*").alias("n"))
    near = graph.withColumn("r", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("n"), "expansion"))).where("r <= 5")
    asked = rows.select("conv_id", "turn", F.explode("es").alias("entity"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("conv_id", "turn", "entity"))
    return asked.join(near, "entity").select("conv_id", "turn", "entity", "expansion", F.round(0.7 * 0.7 * 0.5 * share, 6).alias("confidence"))


@query()
def adaptive_search(t):
    """Search of every benchmark item with k by intent; lists that are too short are asked again, up to three times, with k * 1.5."""
    q = S.queries_of(t).withColumn("k", F.when(X.intent("query") == "comparative", 15).when(X.intent("query") == "factual", 5).otherwise(10))
    scored = written(S.keyword_scores(t), "scored")
    # No try asks for more than the last does with the largest k: only those rows are ranked, kept and read again.
    top = search.top_k_by(scored.withColumn("s9", F.round("score", 9)), ["query_id"], int(15 * 1.5**2), score="s9", tie="doc_id").drop("s9")
    most = scored.groupBy("query_id").agg(F.max("score").alias("most"))
    ranked = top.withColumn("rank", F.col("rank").cast("int")).join(q.select("query_id", "k"), "query_id").join(most, "query_id")
    ranked = written(ranked.withColumn("share", F.col("score") / F.col("most")).drop("most"), "ranked")
    tries = [ranked.where((F.col("rank") <= F.col("k") * 1.5**n) & (F.col("share") >= least)).withColumn("attempt", F.lit(n + 1)) for n, least in enumerate((0.3, 0.2, 0.1))]
    both = tries[0].union(tries[1]).union(tries[2])
    enough = both.groupBy("query_id", "attempt").agg(F.count("*").alias("n")).where("n >= 3 or attempt = 3").groupBy("query_id").agg(F.min("attempt").alias("attempt"))
    return both.join(enough, ["query_id", "attempt"]).select("query_id", "attempt", "doc_id", F.round("score", 6).alias("score"), "rank")


# --- contexts


@query("SELECT doc_id, replace(replace('Use {{.Source}} to answer: {{.Text}}', '{{.Source}}', source), '{{.Text}}', text) AS prompt FROM documents")
def render_prompt(t):
    return t.documents.select("doc_id", context.render("Use {{.Source}} to answer: {{.Text}}", Source="source", Text="text").alias("prompt"))


def _content(c: str, least: int = 3) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= {least} AND w NOT IN ({FILLER_SQL}))"


@query(f"""WITH s AS (SELECT doc_id, {_SENTENCES.format(c='text')} AS ss FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, len(ss) AS n, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM s), w AS (SELECT doc_id, i, unnest({_content('s')}) AS w FROM e),
f AS (SELECT doc_id, w, count(DISTINCT i) AS f FROM w GROUP BY ALL), sc AS (SELECT doc_id, i, sum(1.0::DOUBLE / f) AS s FROM w JOIN f USING (doc_id, w) GROUP BY ALL),
r AS (SELECT e.doc_id, e.i, e.s, row_number() OVER (PARTITION BY e.doc_id ORDER BY round(coalesce(sc.s, 0) + 0.1::DOUBLE * (n - e.i) / n, 9) DESC, e.i) AS r FROM e LEFT JOIN sc USING (doc_id, i))
SELECT d.doc_id, coalesce(x.summary, '') AS summary FROM s d LEFT JOIN (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS summary FROM r WHERE r <= 3 GROUP BY doc_id) x USING (doc_id)""")
def extractive_summary(t):
    return context.summarize(t.texts("documents"))


@query(f"WITH {_CAND} SELECT query_id, rank AS number, doc_id, round(score, 6) AS score, coalesce({_SENTENCES.format(c='text')}[1], '') AS snippet FROM cd")
def citation_rows(t):
    return context.citations(candidates(t)).withColumn("score", F.round("score", 6))


@query(f"""WITH k AS (SELECT DISTINCT unnest({_content('text')}) AS w FROM documents), a AS (SELECT conv_id, turn, {_SENTENCES.format(c='text')} AS ss FROM conversations WHERE role = 'assistant'), e AS (SELECT conv_id, turn, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM a),
w AS (SELECT conv_id, turn, i, unnest({_content('s')}) AS w FROM e), c AS (SELECT conv_id, turn, i, count(*) AS n, count(k.w) AS found FROM w LEFT JOIN k ON k.w = w.w GROUP BY ALL)
SELECT conv_id, turn, count(*) AS n_claims, round(avg(CASE WHEN found::DOUBLE / n >= 0.5 THEN 0.0::DOUBLE ELSE 1 END), 6) AS rate FROM c GROUP BY conv_id, turn""")
def hallucination_rate(t):
    """Every assistant turn against the words of all documents."""
    answers = t.conversations.where("role = 'assistant'").select(F.struct("conv_id", "turn").alias("answer_id"), "text")
    c = evaluate.claims(answers, t.texts("documents"))
    return c.groupBy("answer_id").agg(F.count("*").alias("n_claims"), F.round(F.avg(1.0 - F.col("supported").cast("double")), 6).alias("rate")).select("answer_id.conv_id", "answer_id.turn", "n_claims", "rate")


def _sized(t):
    return candidates(t).withColumn("tokens", X.token_estimate("text"))


def _packed_sql(ranked: str, budget: int) -> str:
    """The tables sz and pk: rows in order of their rank, with what room is left after each."""
    return f"""sz AS ({ranked}), pk AS (SELECT DISTINCT query_id, 0::BIGINT AS rank, {budget}::BIGINT AS room, NULL::BIGINT AS doc_id, NULL::BIGINT AS tokens, false AS kept FROM sz
 UNION ALL SELECT s.query_id, s.rank, room - CASE WHEN s.tokens <= room THEN s.tokens ELSE 0 END, s.doc_id, s.tokens, s.tokens <= room FROM pk JOIN sz s ON s.query_id = pk.query_id AND s.rank = pk.rank + 1)"""


_BY_SCORE = "SELECT query_id, doc_id, rank, CAST(strlen(text) // 4 AS BIGINT) AS tokens FROM cd"


@query(f"WITH RECURSIVE {_CAND}, {_packed_sql(_BY_SCORE, 4096)} SELECT query_id, doc_id, rank, tokens, kept FROM pk WHERE rank > 0")
def context_window(t):
    return context.pack_budget(_sized(t), 4096)


@query(f"WITH RECURSIVE {_CAND}, {_packed_sql(_BY_SCORE, 2048)} SELECT query_id, doc_id, rank, tokens, kept FROM pk WHERE rank > 0")
def context_smart(t):
    rows = _sized(t)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return context.pack_budget(rows.withColumn("rank", F.row_number().over(order)), 2048)


_BY_SPARSE = "SELECT sr.query_id, sr.doc_id, rerank_rank AS rank, CAST(strlen(text) // 4 AS BIGINT) AS tokens, text FROM sr JOIN cd USING (query_id, doc_id)"


@query(f"WITH RECURSIVE {_SPARSE}, {_packed_sql(_BY_SPARSE, 4096)}, ke AS (SELECT query_id, doc_id, sz.text, row_number() OVER (PARTITION BY query_id ORDER BY pk.rank) AS n FROM pk JOIN sz USING (query_id, doc_id) WHERE kept) SELECT query_id, string_agg('[Chunk ' || n || '] (ID: ' || doc_id || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context FROM ke GROUP BY query_id")
def rag_context(t):
    """Candidates, re-ranked, packed into a budget, and rendered with their numbers."""
    cand = candidates(t)
    ranked = rerank.sparse(cand).select("query_id", "doc_id", F.col("rerank_rank").alias("rank"), "text").withColumn("tokens", X.token_estimate("text"))
    kept = context.pack_budget(ranked, 4096).where("kept").select("query_id", "doc_id", "rank").join(ranked.select("query_id", "doc_id", "text"), ["query_id", "doc_id"])
    return context.context_text(kept)


# --- evaluation: retrieved are each vector's ten nearest, relevant those of its label

_RUN = f"""WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, q.label = e.label AS good, {S._COS.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM p WHERE s >= 0), t AS (SELECT * FROM r WHERE rank <= 10),
z AS (SELECT a.vec_id AS query_id, count(*) - 1 AS relevant FROM embeddings a JOIN embeddings b USING (label) GROUP BY 1),
m AS (SELECT query_id, count(*) FILTER (good) / 10.0::DOUBLE AS precision, CASE WHEN any_value(relevant) > 0 THEN count(*) FILTER (good)::DOUBLE / any_value(relevant) ELSE 0 END AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (good), 0) AS mrr,
 CASE WHEN any_value(relevant) > 0 THEN coalesce(sum(1 / log2(rank + 1)) FILTER (good), 0) / list_sum(list_transform(range(CAST(least(any_value(relevant), 10) AS BIGINT)), lambda i: 1 / log2(i + 2))) ELSE 0 END AS ndcg FROM t JOIN z USING (query_id) GROUP BY query_id)"""


def _run(t):
    """The ten nearest of every vector, written: all pairs are multiplied once, however often the run is read."""
    return written(search.batch_top_k(t.embeddings, t.embeddings, 10).withColumnRenamed("vec_id", "doc_id"), "run")


def _metrics(t, run=None, reverse: bool = False):
    run = run or _run(t)
    if reverse:
        run = run.withColumn("rank", F.count("*").over(W.partitionBy("query_id")) + 1 - F.col("rank"))
    label = t.embeddings.select(F.col("vec_id"), "label")
    # Grades of what was retrieved alone; how many are relevant comes from the labels' counts.
    a = run.join(label.withColumnsRenamed({"vec_id": "query_id", "label": "la"}), "query_id").join(label.withColumnsRenamed({"vec_id": "doc_id", "label": "lb"}), "doc_id")
    qrels = a.where("la = lb").select("query_id", "doc_id", F.lit(1).alias("grade"))
    counts = t.embeddings.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0.0), lambda s, i: s + F.when(i <= F.col("relevant"), 1 / F.log2(i + 1.0)).otherwise(0.0))
    sizes = label.join(counts, "label").select(F.col("vec_id").alias("query_id"), "relevant", ideal.alias("ideal"))
    return evaluate.retrieval_metrics(run, qrels, 10, sizes)


def _metric(name: str) -> None:
    query(f"{_RUN} SELECT query_id, round({name}, 6) AS {name} FROM m", f"eval_{name}")(lambda t: _metrics(t).select("query_id", F.round(name, 6).alias(name)))


for _name in ("precision", "recall", "mrr", "ndcg"):
    _metric(_name)


@query(f"{_RUN.replace('rank <= 10)', 'rank <= 10), u AS (SELECT *, count(*) OVER (PARTITION BY query_id) + 1 - rank AS back FROM t)', 1)}, b AS (SELECT query_id, coalesce(1.0::DOUBLE / min(back) FILTER (good), 0) AS mrr FROM u GROUP BY query_id), d AS (SELECT avg(m.mrr) AS old, (SELECT avg(mrr) FROM b) AS new FROM m) SELECT 'mrr' AS metric, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS delta, CASE WHEN new - old < -0.01 THEN 'regression' WHEN new - old > 0.01 THEN 'improvement' ELSE 'same' END AS verdict FROM d")
def eval_compare(t):
    """The run against itself in reverse order, by its reciprocal rank."""
    run = _run(t)
    old, new = (evaluate.report(_metrics(t, run, r).select("query_id", "mrr")) for r in (False, True))
    return evaluate.compare(old, new).select("metric", *(F.round(c, 6).alias(c) for c in ("old", "new", "delta")), "verdict")


@query(_RUN + " " + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}), 6) AS value FROM m" for c in ("precision", "recall", "mrr", "ndcg")))
def eval_report(t):
    return evaluate.report(_metrics(t)).withColumn("value", F.round("value", 6))


@query(f"""{_RUN}, g AS (SELECT query_id, list(CASE WHEN good THEN 1.0::DOUBLE ELSE 0 END ORDER BY rank) AS g FROM t GROUP BY query_id),
n AS (SELECT query_id, list_sum(list_transform(list_zip(g, range(len(g))), lambda p: p[1] / log2(p[2] + 2))) AS a, list_sum(list_transform(list_zip(list_reverse(g), range(len(g))), lambda p: p[1] / log2(p[2] + 2))) AS b, list_sum(list_transform(list_zip(list_reverse_sort(g), range(len(g))), lambda p: p[1] / log2(p[2] + 2))) AS i FROM g),
s AS (SELECT CASE WHEN i > 0 THEN a / i ELSE 0 END AS a, CASE WHEN i > 0 THEN b / i ELSE 0 END AS b FROM n), w AS (SELECT avg(a) AS mean_a, avg(b) AS mean_b, avg(CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, var_pop(a) / count(*) + var_pop(b) / count(*) AS se FROM s)
SELECT round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(win_rate, 6) AS win_rate, round((mean_a - mean_b) / sqrt(se), 4) AS t FROM w""")
def ab_test(t):
    """Linear NDCG of each list (A) against the same list reversed (B)."""
    run = search.batch_top_k(t.embeddings, t.embeddings, 10)
    label = t.embeddings.select("vec_id", "label")
    a = run.join(label.withColumnRenamed("label", "lb"), "vec_id").join(label.withColumnsRenamed({"vec_id": "query_id", "label": "la"}), "query_id")
    g = a.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", (F.col("la") == F.col("lb")).cast("double").alias("g")))).alias("x")).select(F.col("x.g").alias("g"))
    s = g.select(evaluate.linear_ndcg(F.col("g"), 10).alias("a"), evaluate.linear_ndcg(F.reverse("g"), 10).alias("b"))
    return evaluate.welch(s, "a", "b").select(*(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "win_rate")), F.round("t", 4).alias("t"))


_J = "list_distinct({})"
_QW, _AW, _CW = (_J.format(_content(c, 2)) for c in ("question", "answer", "ctx"))


@query(f"""WITH p AS (SELECT conv_id, turn, role, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations), x AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS ctx FROM conversations WHERE role <> 'assistant' GROUP BY conv_id),
j AS (SELECT p.*, coalesce(x.ctx, '') AS ctx FROM p LEFT JOIN x USING (conv_id) WHERE role = 'assistant' AND question IS NOT NULL), w AS (SELECT *, {_QW} AS qw, {_AW} AS aw, {_CW} AS cw, {_content('answer', 2)} AS al, {_content('question', 2)} AS ql FROM j)
SELECT conv_id, turn, round(CASE WHEN len(aw) > 0 THEN len(list_intersect(aw, cw))::DOUBLE / len(aw) ELSE 0 END, 6) AS faithfulness, round(CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, aw))::DOUBLE / len(qw) ELSE 0 END, 6) AS relevance,
 round(CASE WHEN len(al) > 0 AND len(ql) > 0 THEN 2.0::DOUBLE * coalesce(list_sum(list_transform(aw, lambda v: least(len(list_filter(al, lambda z: z = v)), len(list_filter(ql, lambda z: z = v))))), 0) / (len(al) + len(ql)) ELSE 0 END, 6) AS correctness FROM w""")
def overlap_judge(t):
    """Assistant turns as answers to the turn before, in the context of the other turns of their conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    ctx = t.conversations.where("role <> 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x")).select("conv_id", F.array_join("x.text", "\n").alias("ctx"))
    rows = t.conversations.withColumn("question", F.lag("text").over(w)).where("role = 'assistant' and question is not null").join(ctx, "conv_id", "left").fillna("", ["ctx"])
    j = rows.select("conv_id", "turn", evaluate.overlap_judge("question", "text", "ctx", "question").alias("j"))
    return j.select("conv_id", "turn", *(F.round(f"j.{c}", 6).alias(c) for c in ("faithfulness", "relevance", "correctness")))


# --- feedback and review: labels are judgements of documents, vectors of the same number belong to them

_POS = "SELECT generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
_ROCCHIO = f"""rv AS (SELECT pos, sum(w * m) AS x FROM (SELECT pos, avg(x) AS m, 1.0::DOUBLE AS w FROM ({_POS}) GROUP BY pos UNION ALL SELECT pos, avg(x), 0.5 FROM ({_POS} WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)) GROUP BY pos
 UNION ALL SELECT pos, avg(x), -0.3 FROM ({_POS} WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY pos) GROUP BY pos), ro AS (SELECT list(x / n ORDER BY pos) AS v FROM rv, (SELECT sqrt(sum(x * x)) AS n FROM rv))"""


def _rocchio(t):
    e = t.embeddings.select("embedding", F.col("vec_id").alias("doc_id"))
    good, bad = (e.join(t.labels.where(c).select("doc_id").distinct(), "doc_id", "left_semi") for c in ("quality = 1", "toxic = 1"))
    return feedback.rocchio_vector(search.mean_vectors(t.embeddings), good, bad)


@query(f"WITH {_ROCCHIO} SELECT CAST(unnest(range(len(v))) AS BIGINT) AS pos, round(unnest(v), 6) AS x FROM ro")
def rocchio_vector(t):
    return _rocchio(t).select(F.posexplode("vector").alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {_ROCCHIO}, s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS s FROM embeddings, ro), k AS (SELECT vec_id, s, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s), b AS (SELECT k.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = vec_id AND quality = 1) AS good FROM k WHERE rank <= 20) SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY good DESC, rank) AS boosted FROM b")
def feedback_search(t):
    from tidewell.functions import vectors as V

    scored = t.embeddings.crossJoin(_rocchio(t)).select("vec_id", F.round(V.cosine("embedding", "vector"), 9).alias("score"))
    top = search.top_k(scored, 20).withColumn("query_id", F.lit(0))
    top = top.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    good = t.labels.where("quality = 1").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("vec_id"))
    return feedback.boost_relevant(top, good, "vec_id").select("vec_id", F.round("score", 6).alias("score"), "boosted")


_TF = "SELECT query_id, doc_id, term, tf FROM ca JOIN po USING (doc_id)"


@query(f"""WITH {_CAND}, tf AS ({_TF}), g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), pt AS (SELECT query_id, term, qn::DOUBLE AS x FROM qt
 UNION ALL SELECT query_id, term, 0.5 * sum(tf) / any_value(n) FROM (SELECT tf.*, count(DISTINCT doc_id) OVER (PARTITION BY query_id) AS n FROM tf WHERE doc_id IN (SELECT doc_id FROM g)) GROUP BY query_id, term
 UNION ALL SELECT query_id, term, -0.3 * sum(tf) / any_value(n) FROM (SELECT tf.*, count(DISTINCT doc_id) OVER (PARTITION BY query_id) AS n FROM tf WHERE doc_id IN (SELECT doc_id FROM b)) GROUP BY query_id, term),
s AS (SELECT query_id, term, sum(x) AS weight FROM pt GROUP BY ALL HAVING sum(x) > 1e-12), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 9) DESC, term) AS n FROM s) SELECT query_id, term, round(weight, 6) AS weight FROM r WHERE n <= 12""")
def rocchio_terms(t):
    """Terms of every benchmark item after feedback from the labelled ones of its candidates."""
    tf = lambda df: keyword.postings(keyword.index(df))
    cand = candidates(t)
    docs = cand.select("doc_id", "text").distinct()
    found = written(cand.select("query_id", "doc_id").join(tf(docs), "doc_id").select("query_id", "doc_id", "term", "tf"), "terms")
    side = lambda v: found.join(t.labels.where(f"quality = {v}").select("doc_id").distinct(), "doc_id", "left_semi").select("query_id", "doc_id", "term", "tf")
    q = tf(t.benchmark.select("item_id", "text").withColumnRenamed("item_id", "doc_id"))
    asked = q.select(F.col("doc_id").alias("query_id"), "doc_id", "term", "tf")
    return feedback.rocchio_terms(asked, side(1), side(0)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_CAND} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 0 ELSE 1 END, rank) AS boosted FROM ca")
def boost_relevant(t):
    cand = candidates(t)
    good = cand.select("query_id", "doc_id").join(t.labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return feedback.boost_relevant(cand.select("query_id", "doc_id", "rank"), good).select("query_id", "doc_id", "boosted")


@query("SELECT doc_id, 'quality' AS reason FROM labels WHERE quality = 1 UNION SELECT doc_id, 'clean' FROM labels WHERE toxic = 0")
def feedback_union(t):
    one = lambda c, why: t.labels.where(c).select("doc_id", F.lit(why).alias("reason"))
    return one("quality = 1", "quality").union(one("toxic = 0", "clean")).distinct()


_UNC = f"{_CAND}, un AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN 1 - (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS uncertainty FROM ca WINDOW w AS (PARTITION BY query_id))"


@query(f"WITH {_UNC} SELECT query_id, doc_id, round(uncertainty, 6) AS uncertainty FROM un")
def uncertainty_scores(t):
    return feedback.uncertainty(candidates(t), "query_id").select("query_id", "doc_id", F.round("uncertainty", 6).alias("uncertainty"))


@query(f"WITH {_CAND} SELECT query_id, round(max(score) FILTER (rank = 1) - coalesce(max(score) FILTER (rank = 2), 0), 6) AS margin FROM ca GROUP BY query_id")
def score_margin(t):
    return feedback.margin(candidates(t), "query_id").withColumn("margin", F.round("margin", 6))


@query(f"WITH {_UNC}, mx AS (SELECT doc_id, max(uncertainty) AS uncertainty FROM un GROUP BY doc_id) SELECT doc_id, round(uncertainty, 6) AS uncertainty FROM mx WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY round(uncertainty, 9) DESC, doc_id LIMIT 25")
def active_learning_select(t):
    u = feedback.uncertainty(candidates(t), "query_id").groupBy("doc_id").agg(F.max("uncertainty").alias("uncertainty"))
    return feedback.active_select(u, t.labels, 25).select("doc_id", F.round("uncertainty", 6).alias("uncertainty"))


@query("SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) AS place FROM events WHERE event_type = 'error'")
def review_queue(t):
    """Error events as pending items of each user's queue: the highest value first, then the oldest."""
    order = W.partitionBy("user_id").orderBy(F.desc("value"), "ts", "event_id")
    return t.events.where("event_type = 'error'").select("event_id", "user_id", "value", F.row_number().over(order).cast("long").alias("place"))


_LATEST = "la AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)"


@query(f"WITH {_LATEST} SELECT event_type AS status, count(*) AS n FROM la WHERE n = 1 GROUP BY event_type")
def review_status_counts(t):
    return analytics.latest(t.events, ["user_id"], "ts", "event_id").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {_LATEST} SELECT user_id, event_id, value FROM la WHERE n = 1")
def latest_annotation(t):
    return analytics.latest(t.events, ["user_id"], "ts", "event_id").select("user_id", "event_id", "value")


# --- analytics on events: type as query, value as latency


@query("SELECT lower(trim(event_type)) AS query, count(*) AS n, CAST(floor(avg(value)) AS BIGINT) AS avg_latency, max(ts) AS last_seen FROM events GROUP BY 1 ORDER BY n DESC, query LIMIT 10")
def popular_queries(t):
    return analytics.popular(t.events, "event_type", "value", "ts")


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS avg_score FROM events WHERE event_type = 'error' OR value < 1 GROUP BY user_id")
def drop_off(t):
    return analytics.drop_off(t.events, "user_id", (F.col("event_type") == "error") | (F.col("value") < 1), "value").withColumn("avg_score", F.round("avg_score", 6))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def query_log_since(t):
    return t.events.where(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).select("event_id", "ts")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1024")
def query_log_last_n(t):
    return analytics.last_n(t.events, 1024, "ts", "event_id").select("event_id", "event_type")


_BOUNDS = (0.1, 0.5, 1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query("SELECT event_type, le, n FROM (" + " UNION ALL ".join([f"SELECT event_type, '{b}' AS le, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY event_type" for b in _BOUNDS] + ["SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type"]) + ")")
def histogram_buckets(t):
    return analytics.histogram(t.events, "value", ("event_type",), _BOUNDS)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(t):
    return analytics.percentiles(t.events, "value", "event_type")


@query("SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_rate, round(avg(CASE WHEN event_type IN ('click', 'purchase') THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_ratio FROM events GROUP BY user_id")
def error_rate(t):
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return t.events.groupBy("user_id").agg(share(F.col("event_type") == "error").alias("error_rate"), share(F.col("event_type").isin("click", "purchase")).alias("hit_ratio"))


@query()
def prometheus_text(t):
    counts = analytics.histogram(t.events, "value", (), _BOUNDS)
    total = t.events.agg(F.round(F.sum("value"), 2).alias("sum"), F.count("value").alias("count"))
    return analytics.prometheus(counts, "query_latency", "Latency of queries.", total)


@query("SELECT lower(trim(event_type)) AS query, max(value) AS top FROM events GROUP BY 1")
def max_top_score(t):
    return analytics.top_scores(t.events, "event_type", "value")


@query("SELECT user_id, round(sum(value), 6) AS value_total, arg_max(value, {'t': ts, 'v': value}) AS value_last FROM events GROUP BY user_id")
def metric_snapshot(t):
    return analytics.snapshot(t.events, "value", "value", "ts", ("user_id",)).withColumn("value_total", F.round("value_total", 6))


@query(f"WITH {_CAND} SELECT query_id, doc_id, rank, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS relevant FROM ca")
def mark_relevant(t):
    good = t.labels.where("quality = 1").select(F.col("doc_id"))
    return rerank.mark(candidates(t).select("query_id", "doc_id", "rank"), good)


_STATS = _SENTENCES.format(c="content")


@query("""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS content FROM documents)
SELECT doc_id, count(*) AS n, min(length(content)) AS min_size, max(length(content)) AS max_size, round(avg(length(content)), 6) AS mean_size, CAST(sum(strlen(content) // 4) AS BIGINT) AS tokens, round(var_pop(length(content)), 4) AS variance, round(stddev_pop(length(content)), 4) AS stddev FROM p GROUP BY doc_id""")
def chunk_stats(t):
    from tidewell.operators.chunking import split_parts

    size = F.char_length("content").cast("long")
    rows = split_parts(t.documents, "\n").groupBy("doc_id")
    return rows.agg(F.count("*").alias("n"), F.min(size).alias("min_size"), F.max(size).alias("max_size"), F.round(F.avg(size), 6).alias("mean_size"), F.sum(X.token_estimate("content")).alias("tokens"), F.round(F.var_pop(size), 4).alias("variance"), F.round(F.stddev_pop(size), 4).alias("stddev"))


# --- cluster: nations are nodes

_NODES = "SELECT 'node-' || n_nationkey AS node FROM nation"


def _nodes(t):
    return t.nation.select(F.concat(F.lit("node-"), F.col("n_nationkey").cast("string")).alias("node"), F.when(F.col("n_regionkey") == 0, "offline").otherwise("online").alias("status"))


_HASH = "CAST(('0x' || substr(md5({c}), 1, 16)) AS UBIGINT)"


@query(f"""WITH r AS (SELECT {_HASH.format(c="node || '#' || v")} AS spot, node FROM ({_NODES}) n, (SELECT unnest(range(150)) AS v)), k AS (SELECT 'doc-' || doc_id AS key, {_HASH.format(c="'doc-' || doc_id")} AS h FROM documents),
f AS (SELECT key, h, min(r.spot) AS spot FROM k LEFT JOIN r ON r.spot >= k.h GROUP BY key, h) SELECT f.key, r.node FROM f JOIN r ON r.spot = coalesce(f.spot, (SELECT min(spot) FROM r))""")
def ring_assignment(t):
    return cluster.owners(t.documents.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("key")), _nodes(t).select("node"))


_RING = f"""r AS (SELECT {_HASH.format(c="node || '#' || v")} AS spot, node FROM ({_NODES}) n, (SELECT unnest(range(150)) AS v)), k AS (SELECT 'user-' || user_id AS key, {_HASH.format(c="'user-' || user_id")} AS h FROM (SELECT DISTINCT user_id FROM events)),
o AS (SELECT key, node, min(CASE WHEN spot >= h THEN 0 ELSE 1 END) AS turn, min(CASE WHEN spot >= h THEN spot END) AS a, min(spot) AS b FROM k, r GROUP BY key, node), n AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY turn, CASE WHEN turn = 0 THEN a ELSE b END) AS place FROM o)"""


def _users(t):
    return t.events.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key")).distinct()


@query(f"WITH {_RING} SELECT key, string_agg(node, ',' ORDER BY place) AS nodes FROM n WHERE place <= 3 GROUP BY key")
def ring_replicas(t):
    """Three replicas of every user's log."""
    return cluster.replicas(_users(t), _nodes(t).select("node"), 3).select("key", F.array_join("nodes", ",").alias("nodes"))


@query(f"WITH {_RING}, p AS (SELECT n.*, node = 'node-7' AS gone FROM n), w AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY place) AS place FROM p WHERE NOT gone), f AS (SELECT key, arg_min(node, place) AS source FROM p WHERE place <= 3 AND NOT gone GROUP BY key) SELECT w.key, f.source, w.node AS target FROM w JOIN f USING (key) WHERE w.place <= 3 AND NOT EXISTS (SELECT 1 FROM p WHERE p.key = w.key AND p.node = w.node AND p.place <= 3)")
def ring_rebalance(t):
    """Copies that are due when node-7 leaves."""
    nodes = _nodes(t).select("node")
    return cluster.rebalance(_users(t), nodes, nodes.where("node <> 'node-7'"), 3)


@query("SELECT substr(sha256(text), 1, 8) AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_distribution(t):
    return t.documents.groupBy(cluster.shard_of(F.sha2("text", 256)).alias("shard")).agg(F.count("*").alias("n"))


@query(f"WITH {_KW} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM kw) WHERE rank <= 10")
def scatter_gather_topk(t):
    """BM25 lists by the documents' source as shard, merged."""
    scored = S.keyword_scores(t).withColumn("score", F.round("score", 9)).join(t.documents.select("doc_id", "source"), "doc_id")
    return cluster.scatter_gather(scored, "source", 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("WITH n AS (SELECT 'node-' || n_nationkey AS node, n_regionkey <> 0 AS up FROM nation) SELECT count(*) AS total, count(*) FILTER (up) AS online, min(node) FILTER (up) AS leader, count(*) FILTER (up) >= count(*) // 2 + 1 AS healthy FROM n")
def cluster_health(t):
    return cluster.health(_nodes(t))


