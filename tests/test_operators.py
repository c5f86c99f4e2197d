"""Small fixtures with known results, edge cases, and brute force for what SQL can't say."""

import io
import math
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidewell.functions import embed, vectors
from tidewell.functions import text as X
from tidewell.operators import analytics, chunking, cluster, components, context, evaluate, filters, graph, ingest, keyword, ranks, rerank, search
from tidewell.sources import connectors, files, html


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, X.slug("t"), t="--Hello, Wörld 2!") == "hello-w-rld-2"
    assert one(spark, X.terms("t"), t="The quick café's 42 FOX") == ["quick", "café", "s", "42", "fox"]
    assert one(spark, X.sentences("t"), t="A b. C!d\n\ne") == ["A b.", "C!", "d", "e"]
    assert one(spark, X.script_language("t"), t="Привет abc") == "ru"
    assert one(spark, X.script_language("t"), t="123 !") == "unknown"
    assert one(spark, X.year_filter("t"), t="Population in Paris 12 of 2020") == "2020"
    assert one(spark, X.decompose("t"), t="What is A? What is B?") == ["What is A?", "What is B?"]
    assert one(spark, X.decompose("t"), t="cats and dogs") == ["cats", "dogs"]
    assert [one(spark, X.parse_score("t"), t=t) for t in ("8", "score: 7.5/10", "none", "15")] == [0.8, 0.75, 0.0, 1.0]


@pytest.mark.parametrize(("q", "want"), [("What language is it", "temporal"), ("because of X", "causal"), ("compare A", "comparative"), ("show me", "procedural"), ("Does X exist", "existential"), ("X of Y", "factual"), ("cats and dogs", "comparative")])
def test_intent(spark, q, want):
    assert one(spark, X.intent("q"), q=q) == want


def test_vectors(spark):
    assert one(spark, vectors.cosine("a", "b"), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vectors.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert one(spark, vectors.cosine("a", "b"), a=[1.0], b=[1.0, 1.0]) == 0
    assert one(spark, vectors.l2("a", "b"), a=[0.0, 3.0], b=[4.0, 0.0, 9.0]) == 5


def test_filters(spark):
    rows = [({"year": "2020", "d": "2024-05-01T10:00:00Z"},), ({"year": "x", "d": "2024-06-01"},), ({},)]
    df = spark.createDataFrame(rows, "metadata map<string,string>")
    get = filters.from_map()
    count = lambda *f: df.where(filters.all_of(list(f), get)).count()
    assert count(filters.Term("year", "2020")) == 1 and count(filters.Term("year", "")) == 1
    assert count(filters.Range("year", 2020)) == 1 and count(filters.Range("year", 2020, low_open=True)) == 0
    assert count(filters.DateRange("d", "2024-05-15")) == 1 and count(None) == 3


def test_ingest_run(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, ""), (4, "old"), (None, "new")], "doc_id long, text string")
    state = spark.createDataFrame([(4, "x")], "id long, hash string").withColumn("hash", F.sha2(F.lit("old"), 256))
    got = {(r["doc_id"], r["status"]) for r in ingest.run(docs, state, ingest.problems()).collect()}
    assert got == {(1, "uploaded"), (2, "duplicate"), (3, "invalid"), (4, "unchanged"), (None, "uploaded")}


def test_chunkers():
    text = "\n\n".join(["word " * 60] * 12)
    chunks = chunking.fixed(text, tokens=100, overlap=0)
    assert all(len(c) <= 400 for c in chunks) and "".join(chunks).count("word") == 720
    assert chunking.fixed("short") == [] and chunking.fixed("a" * 3000, tokens=100, overlap=0) == ["a" * 400] * 7 + ["a" * 200]
    pieces = chunking.recursive("x" * 5000 + ". " + "y" * 100, tokens=100)
    assert all(len(p) <= 400 for _, p in pieces)
    assert chunking.strict_sentences("A 1.5 b. C d!  E") == ["A 1.5 b.", "C d!", "E"]
    assert chunking.semantic("", None) == []


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "quick brown fox"), (2, "lazy dog"), (3, None), (4, "quick quick")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "Quick fox")], "query_id long, query string")
    got = {r["doc_id"]: r["score"] for r in keyword.bm25(q, docs).collect()}
    idf = lambda df: math.log(4 / (df + 1) + 1)
    part = lambda tf, dl, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (7 / 3)))
    assert got == {1: pytest.approx(part(1, 3, 2) + part(1, 3, 1)), 4: pytest.approx(part(2, 2, 2))}


def test_fusion(spark):
    a = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5)], "query_id long, doc_id long, score double")
    b = spark.createDataFrame([(0, 2, 0.8), (0, 3, 0.8)], "query_id long, doc_id long, score double")
    rows = lambda df: {r["doc_id"]: round(r["score"], 9) for r in df.collect()}
    assert rows(keyword.fuse_weighted([a, b], 0.5)) == {1: 0.45, 2: 0.65, 3: 0.4}
    assert rows(keyword.fuse_rrf([a, b])) == {1: round(1 / 61, 9), 2: round(1 / 62 + 1 / 61, 9), 3: round(1 / 62, 9)}
    assert rows(keyword.fuse_weighted([a], 0.5)) == {1: 0.9, 2: 0.5}


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet")


def exact(vecs, k):
    rows = vecs.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {i: set(ids[np.argsort(-v)[:k]]) for i, v in zip(ids, s, strict=True)}


def share_found(df, want):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return np.mean([len(got.get(q, set()) & w) / len(w) for q, w in want.items()])


def test_approximate_search_recall(spark, vecs):
    want = exact(vecs, 10)
    assert share_found(search.ivf_top_k(vecs, vecs, 10), want) >= 0.9
    model = search.Product(search.training_sample(vecs, 20_000))
    assert share_found(search.pq_search(vecs, vecs, model, 10), want) >= 0.9


def test_cells_of_clustered_vectors(spark):
    """Eight clusters of sixty points: a few cells hold nearly all neighbours."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(8, 16)), 60, axis=0) + rng.normal(0, 0.15, (480, 16))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(480), "embedding": list(x)}))
    assert share_found(search.ivf_top_k(df, df, 10), exact(df, 10)) >= 0.9
    assert share_found(search.ivf_top_k(df, df, 10, probes=6), exact(df, 10)) >= 0.8
    assert search.ivf_top_k(df.limit(0), df, 10).count() == 0


@pytest.mark.parametrize("n", [20_000, 50_000])
def test_product_search_is_exact_at_any_size(spark, n):
    """Vectors without clusters, which codes tell apart badly."""
    x = np.random.default_rng(5).normal(size=(n, 64))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x[:50] @ x.T
    s[np.arange(50), np.arange(50)] = -2
    want = {i: set(np.argsort(-v)[:10]) for i, v in enumerate(s)}
    model = search.Product(search.training_sample(df, 1_000))
    assert share_found(search.pq_search(df.where("vec_id < 50"), df, model, 10), want) == 1


def test_batch_top_k_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, []), (5, None), (None, [1.0, 1.0]), (6, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in search.batch_top_k(df, df, 3).collect()}
    assert {(1, 2), (2, 1)} <= got and not any(q in (4, 5) for q, _ in got)
    assert search.batch_top_k(df.limit(0), df, 3).count() == 0


def test_components_and_ranks(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (3, 9), (9, 1)], "a long, b long")
    assert {tuple(r) for r in components.components(edges).collect()} == {(2, 1), (3, 1), (9, 1), (5, 4)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["root"] for r in components.components(chain).collect()} == {0}
    df = spark.createDataFrame([(i * 7 % 100, "ab"[i % 2] if i % 5 else None) for i in range(100)], "x long, g string")
    rows = ranks.spread_rank(df, F.floor(F.col("x") / 10), ["x"], ("g",)).collect()
    for g in ("a", "b", None):
        own = sorted((r["x"], r["rank"]) for r in rows if r["g"] == g)
        assert [k for _, k in own] == list(range(1, len(own) + 1))


def test_graph(spark):
    rel = spark.createDataFrame([("a", "b", "knows", 0.9), ("b", "c", "knows", 0.5), ("d", "c", "part_of", 0.4), ("x", "y", "part_of", 1.0)], "src string, dst string, type string, weight double")
    start = spark.createDataFrame([("a",)], "id string")
    paths = {r["id"]: (r["depth"], r["path"]) for r in graph.shortest_paths(graph.distances(rel, start)).collect()}
    assert paths == {"a": (0, ["a"]), "b": (1, ["a", "b"]), "c": (2, ["a", "b", "c"]), "d": (3, ["a", "b", "c", "d"])}
    got = {(r["src"], r["dst"], r["type"], r["rule"]) for r in graph.infer(rel).collect()}
    assert ("b", "a", "knows_reverse", "reverse") in got and ("b", "a", "knows", "symmetric") in got and ("c", "d", "part_of_reverse", "reverse") not in got
    docs = spark.createDataFrame([(1, "Alice works at Acme. Paris is located in France."), (2, None)], "doc_id long, text string")
    assert {(r["src"], r["dst"], r["type"]) for r in graph.extract_relations(docs).collect()} == {("alice", "acme", "works_at"), ("paris", "france", "located_in")}
    assert graph.named_entities("Ada Lovelace met The Analytical Society Members here") == [("ada", "Ada"), ("lovelace", "Lovelace"), ("the analytical society members", "The Analytical Society Members")]


def test_path_confidence_rounds_as_sql(spark):
    """Products that lie on a half of the sixth digit, where a power of the decay, or decimals, round the other way."""
    from types import SimpleNamespace

    import duckdb

    from tidewell.plans import graph as plans
    from tidewell.plans import registry

    rows = [(0, 15.0, 0.03, 0.05), (1, 28.0, 0.03, 0.05), (2, 11.0, 0.05, 0.05), (3, 35.0, 0.03, 0.05), (4, 17.0, 0.02, 0.07), (5, 40.0, 0.06, 0.0)]
    lineitem = spark.createDataFrame([(k, 1, *r) for k, *r in rows], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE)")
    con.executemany("INSERT INTO lineitem VALUES (?, 1, ?, ?, ?)", rows)
    want = sorted(con.execute(registry.oracle_sql()["path_confidence"]).fetchall())
    assert sorted(map(tuple, plans.path_confidence(SimpleNamespace(lineitem=lineitem)).collect())) == want


def test_translation_embeddings(spark):
    """Trained in three parts, the true tail of each head is among the first; predictions and ranks agree with NumPy."""
    triples = [(f"a{i}", "r", f"b{i}", 1.0) for i in range(20)]
    rel = spark.createDataFrame([*triples, triples[0], (None, "r", "b1", 1.0)], "src string, dst0 string, dst string, weight double").withColumnRenamed("dst0", "type")
    v = {(r["kind"], r["id"]): np.array(r["vector"]) for r in graph.transe(rel, dim=16, rounds=10, epochs=20, rate=0.05, part_triples=7).collect()}
    assert {k for k in v if k[0] == "relation"} == {("relation", "r")} and len(v) == 41
    ids = sorted(i for k, i in v if k == "entity")
    e = np.stack([v["entity", i] for i in ids])
    far = {h: np.sqrt(((v["entity", h] + v["relation", "r"] - e) ** 2).sum(axis=1)) for h, *_ in triples}
    ranks_ = {h: int((far[h] < far[h][ids.index(t)]).sum()) + 1 for h, _, t, _ in triples}
    assert np.mean(list(ranks_.values())) < 10
    lists = lambda x: [float(a) for a in x]
    entities = spark.createDataFrame([(i, lists(v["entity", i])) for i in ids], "id string, vector array<double>")
    asked = spark.createDataFrame([(h, lists(v["entity", h]), lists(v["relation", "r"]), lists(v["entity", t])) for h, _, t, _ in triples], "query_id string, known array<double>, relation array<double>, truth array<double>")
    assert {r["query_id"]: r["rank"] for r in graph.link_ranks(asked, entities).collect()} == ranks_
    got = {(r["query_id"], r["rank"]): r["id"] for r in graph.predict(asked, entities, 3).collect()}
    assert all(got[h, n + 1] == ids[k] for h in far for n, k in enumerate(np.argsort(far[h], kind="stable")[:3]))


def test_paths_and_questions(spark):
    rel = spark.createDataFrame([("a", "b", "knows", 0.9), ("c", "b", "knows", 0.5), ("b", "c", "likes", 0.6), ("c", "d", "part_of", 0.4), ("d", "e", "part_of", 0.4)], "src string, dst string, type string, weight double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {(r["start"], r["goal"]): (r["path"], r["weights"]) for r in graph.explore(rel, ids("a", "e"), ids("a", "c", "d", "e")).collect()}
    assert got == {("a", "c"): (["a", "b", "c"], [0.9, 0.6]), ("a", "d"): (["a", "b", "c", "d"], [0.9, 0.6, 0.4]), ("e", "d"): (["e", "d"], [0.4]), ("e", "c"): (["e", "d", "c"], [0.4, 0.4])}
    entities = spark.createDataFrame([("a", "Alice"), ("c", "Carol"), ("e", "Eve")], "id string, label string")
    asked = spark.createDataFrame([(1, "Does Alice know Carol?"), (2, "Is Alice near Eve?"), (3, "Who is Bob?"), (4, None)], "query_id long, query string")
    rows = graph.reason(asked, entities, rel).collect()
    assert [(r["query_id"], r["source"], r["target"], round(r["confidence"], 6)) for r in rows] == [(1, "a", "c", 0.54)]
    both = rel.union(spark.createDataFrame([("p", "q", "parent_of", 1.0), ("q", "p", "parent_of", 0.5), ("p", "x", "parent_of", 1.0)], rel.schema))
    assert {tuple(r) for r in graph.one_way(both).collect()} == {("p", "q", "not_parent_of", 0.5), ("q", "p", "not_parent_of", 0.25)}
    assert {r["rule"] for r in graph.infer(both, rules={"one_way": graph.one_way}, least=0.0).collect()} == {"one_way"}
    ring = spark.createDataFrame([("a", "b", "in", 1.0), ("b", "c", "in", 1.0), ("c", "a", "in", 1.0)], rel.schema)
    assert {(r["src"], r["dst"], r["depth"]) for r in graph.ancestors(ring, ("in",)).collect()} == {("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "c", 2), ("b", "a", 2), ("c", "b", 2)}
    long = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "t", 1.0) for i in range(60)], rel.schema)
    assert max(r["depth"] for r in graph.distances(long, ids("n000")).collect()) == 60


def test_metrics_anchors(spark):
    run = spark.createDataFrame([(1, i + 1, i + 1) for i in range(3)], "query_id long, doc_id long, rank long")
    qrels = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id long, grade int")
    m = evaluate.retrieval_metrics(run, qrels([(1, 1, 1), (1, 3, 1)]), 3).first()
    assert m["precision"] == pytest.approx(2 / 3) and m["recall"] == 1 and m["mrr"] == 1 and m["ndcg"] == pytest.approx(0.9197, abs=1e-4)
    assert evaluate.retrieval_metrics(run, qrels([(1, 1, 1), (1, 3, 1)]), 10).first()["precision"] == pytest.approx(0.2)
    assert evaluate.retrieval_metrics(run, qrels([(1, 1, 1), (1, 2, 2), (1, 3, 3)]), 3).first()["ndcg"] == pytest.approx(0.6806, abs=1e-4)
    assert one(spark, evaluate.erf(F.col("x")), x=1.0) == pytest.approx(math.erf(1), abs=1.5e-7)
    w = evaluate.welch(spark.createDataFrame([(1.0, 0.0), (0.9, 0.1), (1.0, 0.2)], "a double, b double"), "a", "b").first()
    assert w["significant"] and w["win_rate"] == 1


def test_context(spark):
    ranked = spark.createDataFrame([(1, 1, 1, 60), (1, 2, 2, 50), (1, 3, 3, 40)], "query_id long, doc_id long, rank long, tokens long")
    assert {(r["doc_id"], r["kept"]) for r in context.pack_budget(ranked, 100).collect()} == {(1, True), (2, False), (3, True)}
    assert context.summary(["a", "b"], [["x"], ["x", "y"]], 1) == "b"
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "One two three. Four five six!")], "doc_id long, text string")
    assert {tuple(r) for r in context.summarize(docs).collect()} == {(1, ""), (3, "One two three. Four five six!")}
    assert one(spark, context.render("Hi {{.Name}}", Name="n"), n="Bo") == "Hi Bo"


def test_rerank_learns():
    x = np.array([[0.1, 0.0, 0.1], [0.2, 0.1, 0.1], [0.9, 0.8, 0.1], [0.8, 0.9, 0.1]])
    w = rerank.fit_ltr(x, np.array([0, 0, 1, 1.0]))
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert p[:2].max() < 0.5 < p[2:].min()
    a = rerank.AdaptiveLtr(x, np.array([0, 0, 1, 1.0]), every=2)
    before = a.weights.copy()
    a.record(x[0], 1)
    assert (a.weights == before).all()
    a.record(x[1], 1)
    assert not (a.weights == before).all()


def test_cluster_and_metrics(spark):
    nodes = spark.createDataFrame([("n1",), ("n2",)], "node string")
    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    placed = {r["key"]: r["node"] for r in cluster.owners(keys, nodes).collect()}
    more = {r["key"]: r["node"] for r in cluster.owners(keys, nodes.union(spark.createDataFrame([("n3",)], "node string"))).collect()}
    assert len(placed) == 50 and all(more[k] in (placed[k], "n3") for k in placed)
    three = {r["key"]: r["nodes"] for r in cluster.replicas(keys, spark.createDataFrame([(f"n{i}",) for i in range(5)], "node string"), 3).collect()}
    four = {r["key"]: r["nodes"] for r in cluster.replicas(keys, spark.createDataFrame([(f"n{i}",) for i in range(4)], "node string"), 3).collect()}
    assert all(len(set(v)) == 3 for v in three.values()) and all([x for x in v if x != "n4"] == four[k][: len([x for x in v if x != "n4"])] for k, v in three.items())
    moved = cluster.rebalance(keys, spark.createDataFrame([(f"n{i}",) for i in range(5)], "node string"), spark.createDataFrame([(f"n{i}",) for i in range(4)], "node string"), 3).collect()
    assert {r["key"] for r in moved} == {k for k, v in three.items() if "n4" in v} and all(r["target"] in four[r["key"]] and r["source"] in three[r["key"]] for r in moved)
    assert {tuple(r["nodes"]) for r in cluster.replicas(keys, nodes.limit(0)).collect()} == {()}
    h = analytics.histogram(spark.createDataFrame([(0.2,), (3.0,), (None,)], "v double"), "v", (), (1.0, 5.0)).collect()
    assert [tuple(r) for r in h] == [("1.0", 1), ("5.0", 2), ("+Inf", 2)]


def test_embeddings():
    v = embed.mock_vectors(["abc", "", None, "abd"], 32)
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and (v[1] == v[2]).all() and not np.allclose(v[0], v[3])
    h = 0
    for c in "abc":
        h = (h * 31 + ord(c)) % 2**32
    raw = []
    for i in range(32):
        h = (h * 31 + i) % 2**32
        raw.append((h >> 16) / 32768)
    assert np.allclose(v[0], np.array(raw) / np.linalg.norm(raw), atol=1e-6)
    vocab = {"[PAD]": 0, "[CLS]": 1, "[SEP]": 2, "[UNK]": 3, "play": 4, "##ing": 5}
    assert embed.wordpiece("Playing xyz", vocab, 6) == ([1, 4, 5, 3, 2, 0], [1, 1, 1, 1, 1, 0])


def test_html():
    page = "<html><head><title>A &amp; B</title><script>x</script></head><body><nav>menu</nav><p>Hello <b>big</b>\n world</p><div>x</div><footer>f</footer></body>"
    assert html.extract(page) == ("A & B", "Hello big world\nx")
    assert "menu" in html.extract(page, True)[1] and html.extract(None) == ("", "")


def test_loaders(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# One\ntext\n## Two\nmore\n## Two\nagain\n# Empty\n")
    (tmp_path / "b.csv").write_text("id,t\n1,x\n2,y\n")
    (tmp_path / "c.json").write_text('[{"content": "hi", "n": 1, "deep": {"x": 2}}, {"content": "yo"}]')
    (tmp_path / "d.html").write_text("<title>T</title><p>body</p>")
    (tmp_path / "e.txt").write_text("plain")
    md = {r["id"].split("#")[-1]: r["metadata"] for r in files.load_markdown(spark, str(tmp_path / "a.md")).collect()}
    assert set(md) == {"section", "one", "two", "two-2"} and md["two"]["section_path"] == "One > Two"
    assert [r["content"] for r in files.load_csv(spark, str(tmp_path / "b.csv")).orderBy("id").collect()] == ["1 | x", "2 | y"]
    js = files.load_json(spark, str(tmp_path / "c.json")).orderBy("id").collect()
    assert [r["content"] for r in js] == ["hi", "yo"] and js[0]["metadata"]["n"] == "1" and "deep" not in js[0]["metadata"]
    assert files.load(spark, str(tmp_path / "d.html")).first()["content"] == "body"
    assert files.load_directory(spark, str(tmp_path)).count() == 4 + 2 + 2 + 1 + 1
    with pytest.raises(ValueError):
        files.load(spark, "x.zip")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>")
    assert files.docx_text(buf.getvalue()) == "a\tb\nc"


def test_sql_connector(spark):
    views = {"v": spark.createDataFrame([(1, "A", " "), (2, "B", "text")], "ID long, Title string, Body string")}
    rows = connectors.sql_documents(spark, "select * from v", views, id_col="id", content_col="body", title_col="TITLE").collect()
    assert [(r["id"], r["title"], r["content"]) for r in rows] == [("2", "B", "text")]
    with pytest.raises(ValueError):
        connectors.fetch("file:///etc/passwd")
