"""Queries of the knowledge graph: the star schema as entities and relations, and graph text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import vectors as V
from tidewell.operators import graph as G
from tidewell.plans.base import query
from tidewell.session import spread

_ENTITIES = """en AS (SELECT 'region:' || r_regionkey AS id, r_name AS label, 'location' AS type FROM region UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'location' FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, c_name, 'person' FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'organization' FROM supplier)"""
_RELATIONS = """re AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'part_of' AS type, 0.9::DOUBLE AS weight FROM nation
 UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 0.8::DOUBLE FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 0.7::DOUBLE FROM supplier
 UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', 0.4::DOUBLE FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))"""
_GRAPH = f"{_ENTITIES}, {_RELATIONS}"
_BOTH = "nb AS (SELECT src AS id, dst AS neighbor FROM re WHERE src <> dst UNION SELECT dst, src FROM re WHERE src <> dst)"


def entities(t):
    one = lambda df, kind, key, label, type_: df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.col(label).alias("label"), F.lit(type_).alias("type"))
    rows = one(t.region, "region", "r_regionkey", "r_name", "location").union(one(t.nation, "nation", "n_nationkey", "n_name", "location"))
    return rows.union(one(t.customer, "customer", "c_custkey", "c_name", "person")).union(one(t.supplier, "supplier", "s_suppkey", "s_name", "organization"))


def relations(t):
    def one(df, a, ak, b, bk, kind, weight):
        return df.select(F.concat(F.lit(f"{a}:"), F.col(ak).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), F.col(bk).cast("string")).alias("dst"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))

    rows = one(t.nation, "nation", "n_nationkey", "region", "n_regionkey", "part_of", 0.9)
    rows = rows.union(one(t.customer, "customer", "c_custkey", "nation", "c_nationkey", "located_in", 0.8))
    rows = rows.union(one(t.supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "located_in", 0.7))
    return rows.union(one(spread(t.lineitem.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct(), "supplier", "l_suppkey", "part", "l_partkey", "supplies", 0.4))


@query(f"WITH {_GRAPH} SELECT src, dst, type FROM re WHERE src IN (SELECT id FROM en) AND dst IN (SELECT id FROM en)")
def valid_relations(t):
    return G.valid_relations(relations(t), entities(t)).select("src", "dst", "type")


@query(f"WITH {_GRAPH} SELECT src, dst, type FROM re WHERE src NOT IN (SELECT id FROM en WHERE type = 'person') AND dst NOT IN (SELECT id FROM en WHERE type = 'person')")
def remove_entity(t):
    return G.remove_entities(relations(t), entities(t).where("type = 'person'")).select("src", "dst", "type")


@query(f"WITH {_GRAPH}, {_BOTH} SELECT id, neighbor FROM nb")
def graph_neighbors(t):
    return G.neighbors(relations(t))


@query(f"WITH {_ENTITIES} SELECT id, label FROM en WHERE contains(lower(label), 'nation_1')")
def entities_by_label(t):
    return entities(t).where(F.lower("label").contains("nation_1")).select("id", "label")


#: Entities that are asked about: those whose key is divisible by 50.
_ASKED = "CAST(split_part({c}, ':', 2) AS BIGINT) % 50 = 0"


def _asked(t):
    return entities(t).where(F.split_part("id", F.lit(":"), F.lit(2)).cast("long") % 50 == 0)


@query(f"WITH {_GRAPH}, {_BOTH} SELECT x.id AS a, y.id AS b, count(*) AS n FROM nb x JOIN nb y ON x.neighbor = y.neighbor AND x.id <> y.id WHERE x.id IN (SELECT id FROM en) AND {_ASKED.format(c='x.id')} AND y.id IN (SELECT id FROM en) GROUP BY 1, 2")
def graph_common_neighbors(t):
    """Every entity whose key is divisible by 50 against all entities, over all relations."""
    return G.common_neighbors(relations(t), _asked(t), entities(t))


@query(f"WITH {_GRAPH} SELECT c.src AS start, s.src AS goal, c.src || '>' || c.dst || '>' || s.src AS path, round(c.weight * s.weight, 6) AS confidence FROM re c JOIN re s ON s.dst = c.dst WHERE c.type = 'located_in' AND s.type = 'located_in' AND c.src LIKE 'customer:%' AND s.src LIKE 'supplier:%' AND {_ASKED.format(c='c.src')}")
def explore_paths(t):
    """Paths of at most three steps from the customers that are asked about to all suppliers."""
    starts, goals = _asked(t).where("type = 'person'"), entities(t).where("type = 'organization'")
    rows = G.explore(relations(t), starts, goals)
    return rows.select("start", "goal", F.array_join("path", ">").alias("path"), F.round(F.aggregate("weights", F.lit(1.0), lambda x, y: x * y), 6).alias("confidence"))


@query(f"WITH {_GRAPH}, q AS (SELECT c.src AS source, n.dst AS target, c.weight * n.weight AS w, c.src || '>' || c.dst || '>' || n.dst AS path FROM re c JOIN re n ON n.src = c.dst AND n.type = 'part_of' WHERE c.src LIKE 'customer:%' AND c.type = 'located_in' AND {_ASKED.format(c='c.src')}) SELECT source || '?' || target AS query_id, source, target, path, round(w, 6) AS confidence FROM q WHERE target <> 'region:4'")
def reason_questions(t):
    """Questions whether a customer is near a region, for each customer that is asked about and each region of one word."""
    c, r = _asked(t).where("type = 'person'").select(F.col("id").alias("c"), F.col("label").alias("x")), t.region.select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("r"), F.col("r_name").alias("y"))
    asked = c.crossJoin(r).select(F.concat("c", F.lit("?"), "r").alias("query_id"), F.concat(F.lit("Is "), "x", F.lit(" anywhere near "), "y", F.lit("?")).alias("query"))
    rows = G.reason(asked, entities(t), relations(t))
    return rows.select("query_id", "source", "target", F.array_join("path", ">").alias("path"), F.round("confidence", 6).alias("confidence"))


_DIST = f"{_GRAPH}, {_BOTH}, di AS (SELECT 'region:0' AS id, 0 AS depth UNION SELECT neighbor, depth + 1 FROM di JOIN nb USING (id) WHERE depth < 8), ds AS (SELECT id, min(depth) AS depth FROM di GROUP BY id)"


def _reached(t):
    return G.distances(relations(t), entities(t).where("id = 'region:0'"))


@query(f"WITH RECURSIVE {_DIST} SELECT id, CAST(depth AS INTEGER) AS depth FROM ds")
def graph_bfs_distance(t):
    return _reached(t).select("id", "depth")


@query(f"WITH RECURSIVE {_DIST} SELECT id FROM ds")
def graph_reachable(t):
    return _reached(t).select("id")


@query(f"""WITH RECURSIVE {_DIST}, pa AS (SELECT a.id, a.depth, min(b.id) AS parent FROM ds a LEFT JOIN (nb JOIN ds b ON b.id = nb.neighbor) ON nb.id = a.id AND b.depth = a.depth - 1 GROUP BY a.id, a.depth),
pt AS (SELECT id, depth, id AS path FROM pa WHERE depth = 0 UNION ALL SELECT pa.id, pa.depth, pt.path || '>' || pa.id FROM pt JOIN pa ON pa.parent = pt.id AND pa.depth = pt.depth + 1)
SELECT id, CAST(depth AS INTEGER) AS depth, path FROM pt""")
def graph_shortest_path(t):
    return G.shortest_paths(_reached(t)).select("id", "depth", F.array_join("path", ">").alias("path"))


_COMPOSE = "SELECT DISTINCT a.src, b.dst, a.type || '_via_' || b.type AS type, round(a.weight * b.weight, 6) AS weight FROM re a JOIN re b ON a.dst = b.src WHERE a.src <> b.dst AND a.weight * b.weight >= 0.5"


@query(f"WITH {_GRAPH} {_COMPOSE}")
def compose_relations(t):
    return G.compose(relations(t), 0.5).withColumn("weight", F.round("weight", 6))


_CLOSURE = f"{_GRAPH}, hi AS (SELECT DISTINCT src, dst FROM re WHERE type IN ('part_of', 'located_in')), cl AS (SELECT src, dst, 1 AS depth FROM hi UNION SELECT cl.src, hi.dst, depth + 1 FROM cl JOIN hi ON hi.src = cl.dst WHERE depth < 20)"


@query(f"WITH RECURSIVE {_CLOSURE} SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM cl WHERE src <> dst GROUP BY src, dst")
def hierarchy_closure(t):
    return G.ancestors(relations(t), ("part_of", "located_in"))


@query(f"WITH RECURSIVE {_CLOSURE} SELECT c.src, c.dst, 'inferred' AS type, 0.8::DOUBLE AS weight FROM (SELECT DISTINCT src, dst FROM cl WHERE src <> dst) c WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.src = c.src AND hi.dst = c.dst)")
def hierarchy_closure_new(t):
    up = G.ancestors(relations(t), ("part_of", "located_in")).select("src", "dst")
    hierarchy = relations(t).where(F.col("type").isin("part_of", "located_in"))
    new = up.join(hierarchy.select("src", "dst"), ["src", "dst"], "left_anti")
    return new.select("src", "dst", F.lit("inferred").alias("type"), F.lit(0.8).alias("weight"))


@query(f"""WITH {_GRAPH}, ru AS (SELECT dst AS src, src AS dst, type || '_reverse' AS type, weight * 0.8 AS weight, 'reverse' AS rule, 0 AS n FROM re WHERE weight >= 0.5
 UNION ALL SELECT src, dst, type, weight, 'transitive', 1 FROM re WHERE weight >= 0.5), rk AS (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY n, weight DESC) AS k FROM ru WHERE weight >= 0.3)
SELECT src, dst, type, round(weight, 6) AS weight, rule FROM rk WHERE k = 1""")
def infer_relations(t):
    return G.infer(relations(t)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_GRAPH} SELECT dst AS src, src AS dst, CASE type WHEN 'part_of' THEN 'has_part' ELSE type || '_reverse' END AS type, round(weight * 0.9, 6) AS weight FROM re")
def infer_inverse(t):
    return G.infer_inverse(relations(t)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_GRAPH} SELECT dst AS target, count(DISTINCT src) AS n FROM re GROUP BY dst HAVING count(DISTINCT src) >= 2")
def common_interests(t):
    return G.common_interests(relations(t))


_WEIGHTS = "pw AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_quantity / 50 AS a, 1 - l_discount AS b, 1 - l_tax AS c FROM lineitem)"


@query(f"WITH {_WEIGHTS} SELECT id, round(a * b * c * 0.9 * 0.9, 6) AS product, round(least(least(a, b) * 0.9, c) * 0.9, 6) AS minimum, round((a + b + c) / 3 * 0.9, 6) AS average FROM pw")
def path_confidence(t):
    """Three weights of every line item as a path. Halves are rounded as SQL does it, by the scaled double, not by its decimals."""
    rows = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.array(F.col("l_quantity") / 50, 1 - F.col("l_discount"), 1 - F.col("l_tax")).alias("w"))
    return rows.select("id", *((F.round(v * 1e6) / 1e6).alias(k) for k, v in G.path_confidence("w").items()))


@query(f"WITH {_GRAPH} SELECT DISTINCT a.src, a.dst, 'not_located_in' AS type, a.weight * 0.5 AS weight FROM (SELECT * FROM re UNION ALL SELECT dst, src, type, weight FROM re WHERE src LIKE 'supplier:%' AND type = 'located_in') a JOIN (SELECT src, dst FROM re WHERE src LIKE 'supplier:%' AND type = 'located_in') b ON (a.src = b.src AND a.dst = b.dst) OR (a.src = b.dst AND a.dst = b.src) WHERE a.type = 'located_in'")
def infer_one_way(t):
    """The anti-symmetric rule, where suppliers' places are told both ways."""
    rel = relations(t)
    back = rel.where("type = 'located_in' and src like 'supplier:%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "weight")
    return G.one_way(rel.union(back), ("located_in",)).distinct()


@query(f"""WITH {_GRAPH}, st AS (SELECT a.src AS src, b.dst AS dst, a.weight * b.weight AS w FROM re a JOIN re b ON a.dst = b.src WHERE a.type = 'located_in' AND b.type = 'part_of')
SELECT s.label AS source, d.label AS target, round(w, 6) AS confidence FROM st JOIN en s ON s.id = st.src JOIN en d ON d.id = st.dst WHERE w >= 0.1""")
def reason_pairs(t):
    """Two-step answers from every located entity to its region: the product of the path's weights."""
    rel = relations(t)
    a = rel.where("type = 'located_in'").select("src", F.col("dst").alias("mid"), F.col("weight").alias("w1"))
    b = rel.where("type = 'part_of'").select(F.col("src").alias("mid"), "dst", F.col("weight").alias("w2"))
    en = entities(t)
    paths = a.join(b, "mid").withColumn("confidence", F.aggregate(F.array("w1", "w2"), F.lit(1.0), lambda x, y: x * y)).where("confidence >= 0.1")
    named = paths.join(en.select(F.col("id").alias("src"), F.col("label").alias("source")), "src").join(en.select(F.col("id").alias("dst"), F.col("label").alias("target")), "dst")
    return named.select("source", "target", F.round("confidence", 6).alias("confidence"))


_TRIPLES = """tr AS (SELECT h.vec_id AS head, q.vec_id AS tail, sqrt(list_sum(list_transform(list_zip(CAST(h.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: (p[1] + p[2] - p[3]) * (p[1] + p[2] - p[3])))) AS d
 FROM embeddings h JOIN embeddings q ON q.vec_id = h.vec_id + 1 JOIN (SELECT label, min_by(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) r ON r.label = h.label)"""


def _triples(t):
    """Every vector as head, the next as tail, the first vector of its label as relation."""
    r = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("r"))
    tail = t.embeddings.select(F.col("vec_id").alias("tail"), F.col("embedding").alias("t"))
    rows = t.embeddings.join(tail, F.col("vec_id") + 1 == F.col("tail")).join(r, "label")
    moved = F.zip_with(V.double("embedding"), V.double("r"), lambda x, y: x + y)
    return rows.select(F.col("vec_id").alias("head"), "tail", V.l2(moved, "t").alias("d"))


@query(f"WITH {_TRIPLES} SELECT head, tail, round(-d, 6) AS score FROM tr")
def score_triples(t):
    return _triples(t).select("head", "tail", F.round(-F.col("d"), 6).alias("score"))


_LINKS = """re AS (SELECT label, min_by(embedding, vec_id) AS r FROM embeddings GROUP BY label),
aq AS (SELECT h.vec_id AS query_id, CAST(h.embedding AS DOUBLE[]) AS h, CAST(r.r AS DOUBLE[]) AS r FROM embeddings h JOIN re r USING (label) WHERE h.vec_id % 50 = 0),
di AS (SELECT query_id, e.vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(h, r, CAST(e.embedding AS DOUBLE[])), lambda p: (p[1] + p[2] - p[3]) * (p[1] + p[2] - p[3])))), 9) AS d FROM aq, embeddings e)"""


def _links(t):
    """Vectors whose number is divisible by 50 as heads, the first vector of their label as relation, the next vector as true tail."""
    r = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("relation"))
    tail = t.embeddings.select((F.col("vec_id") - 1).alias("query_id"), F.col("embedding").alias("truth"))
    rows = t.embeddings.where("vec_id % 50 = 0").join(r, "label").select(F.col("vec_id").alias("query_id"), V.double("embedding").alias("known"), V.double("relation").alias("relation"))
    return rows.join(tail.withColumn("truth", V.double("truth")), "query_id", "left")


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"WITH {_LINKS}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM di) SELECT query_id, id, round(-d, 6) AS score, rank FROM rk WHERE rank <= 10")
def predict_tails(t):
    """The ten likeliest tails among all vectors."""
    return G.predict(_links(t), _vectors(t)).withColumn("score", F.round("score", 6))


_HEADS = _LINKS.replace("(p[1] + p[2] - p[3]) * (p[1] + p[2] - p[3])", "(p[1] - p[2] - p[3]) * (p[1] - p[2] - p[3])")


@query(f"WITH {_HEADS}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM di) SELECT query_id, id, round(-d, 6) AS score, rank FROM rk WHERE rank <= 10")
def predict_heads(t):
    """The ten likeliest heads among all vectors, the known ones taken as tails."""
    return G.predict(_links(t), _vectors(t), tails=False).withColumn("score", F.round("score", 6))


@query(f"WITH {_LINKS}, tr AS (SELECT query_id, d AS far FROM di WHERE id = query_id + 1), rk AS (SELECT query_id, count(*) FILTER (d < far) + 1 AS rank FROM di JOIN tr USING (query_id) GROUP BY query_id) SELECT round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hits, round(avg(rank), 6) AS mean_rank FROM rk")
def link_metrics(t):
    """Ranks of the true tails among all vectors."""
    m = G.link_metrics(G.link_ranks(_links(t).where("truth is not null"), _vectors(t)))
    return m.select(*(F.round(c, 6).alias(c) for c in m.columns))


_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, lower(unnest(regexp_extract_all(text, '{p}', 1))) AS src, lower(unnest(regexp_extract_all(text, '{p}', 2))) AS dst, '{k}' AS type FROM documents" for k, p in sorted(G.PATTERNS.items())
)


@query(f"SELECT DISTINCT doc_id, src, dst, type, 0.8::DOUBLE AS weight FROM ({_MATCHES})")
def extract_relations(t):
    return G.extract_relations(t.texts("documents"))


@query(f"WITH x AS (SELECT DISTINCT doc_id, src, dst FROM ({_MATCHES})), e AS (SELECT doc_id, src AS id FROM x UNION SELECT doc_id, dst FROM x) SELECT id, count(*) AS n FROM e GROUP BY id")
def pattern_entities(t):
    return G.pattern_entities(G.extract_relations(t.texts("documents")))


@query("""WITH w AS (SELECT list_filter(string_split_regex(regexp_replace(text, '[^A-Za-z\\s]', '', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT unnest(list_zip(ws[1:len(ws) - 1], ws[2:])) AS p FROM w WHERE len(ws) > 1), h AS (SELECT p[1] AS a, p[2] AS b FROM p)
SELECT lower(a) AS src, lower(b) AS dst, 'related_to' AS type, 0.5::DOUBLE AS weight, count(*) AS n FROM h WHERE regexp_matches(a, '^[A-Z]') AND regexp_matches(b, '^[A-Z]') AND lower(a) <> lower(b) GROUP BY 1, 2""")
def adjacent_cap_relations(t):
    return G.adjacent_capitalised(t.texts("documents"))


@query()
def extract_entities(t):
    return G.extract_entities(t.texts("documents"))


@query()
def transe_train(t):
    """Vectors of all entities and relation types of the whole graph."""
    return G.transe(relations(t))
