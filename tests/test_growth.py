"""Work that grows no faster than the input: how often a text is read, how many rows meet, how much a task holds; with brute force on small tables."""

import random
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from tidewell.functions import text as X
from tidewell.operators import graph, search
from tidewell.plans import flows


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scripts_are_counted_once(spark):
    texts = ["abc", "", None, "1 2", "Привет abc", "abc при", "при абc de", "漢字かな", "かな字", "αβγ אבג", "é𝔘ß 𠀀", "한국 ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", X.script_language("text").alias("x"))
    want = ["en", "unknown", "unknown", "unknown", "ru", "en", "ru", "ja", "ja", "el", "en", "en"]
    assert [r["x"] for r in df.orderBy("doc_id").collect()] == want
    assert _plan(df).count("regexp_replace") == len(X.SCRIPTS) + 1


def _relations(spark, pairs):
    return spark.createDataFrame([(a, b, "t", round(0.1 + 0.01 * i, 2)) for i, (a, b) in enumerate(pairs)], "src string, dst string, type string, weight double")


def _ids(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_explore_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(24)}", f"n{rng.randrange(24)}") for _ in range(34)]
    heaviest = {}
    for r in _relations(spark, pairs).collect():
        for a, b in ((r["src"], r["dst"]), (r["dst"], r["src"])):
            if a != b:
                heaviest[a, b] = max(heaviest.get((a, b), 0), r["weight"])
    starts, goals = [f"n{i}" for i in range(8)], [f"n{i}" for i in range(6, 20)]
    want = {}
    for s in starts:
        level, seen = {s: [s]}, {s}
        for _ in range(3):
            new = {}
            for at, path in level.items():
                for a, b in heaviest:
                    if a == at and b not in seen:
                        new[b] = min(new.get(b, ["~"]), [*path, b])
            seen, level = seen | set(new), new
            want |= {(s, g): p for g, p in new.items() if g in goals}
    got = {(r["start"], r["goal"]): r for r in graph.explore(_relations(spark, pairs), _ids(spark, starts), _ids(spark, goals)).collect()}
    assert {k: r["path"] for k, r in got.items()} == want and len(want) > 20
    assert all(r["weights"] == [heaviest[x] for x in zip(r["path"], r["path"][1:])] for r in got.values())


def test_explore_holds_only_what_leads_to_a_goal(spark, monkeypatch):
    """Of a node that 200 others share, only the one goal beside it is held, and nothing goes on from there."""
    held, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="table": held.append((name, out := write(df, name))) or out)
    rel = _relations(spark, [*((f"c{i}", "hub") for i in range(200)), ("goal", "hub"), *(("goal", f"p{i}") for i in range(50))])
    rows = graph.explore(rel, _ids(spark, ["c0", "c1"]), _ids(spark, ["goal"])).collect()
    assert sorted(r["path"] for r in rows) == [["c0", "hub", "goal"], ["c1", "hub", "goal"]]
    assert max(df.count() for name, df in held if name == "paths") <= 2


def test_common_neighbours_of_a_hub_in_many_tasks(spark):
    rng = random.Random(7)
    pairs = [*((f"c{i}", f"hub{i % 2}") for i in range(60)), *((f"s{i}", "hub0") for i in range(6)), *((f"s{rng.randrange(6)}", f"p{rng.randrange(9)}") for _ in range(30))]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = [f"c{i}" for i in range(0, 60, 5)] + ["s0", "s3", "hub1"]
    want = {(a, b, len(near[a] & near[b])) for a in asked for b in near if a != b and near[a] & near[b]}
    got = [tuple(r) for r in graph.common_neighbors(_relations(spark, pairs), _ids(spark, asked), _ids(spark, near), pairs=20).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_parts_follow_the_size(spark, monkeypatch):
    from tidewell import session

    rel = session.written(_relations(spark, [(f"a{i}", f"b{i % 7}") for i in range(500)]))
    monkeypatch.setattr(session, "PART", 1_000)
    assert graph.neighbors(rel).rdd.getNumPartitions() > 8
    assert {r["depth"] for r in graph.distances(rel, _ids(spark, ["a0"])).collect()} == {0, 1, 2}


def test_json_files_of_bounded_arrays(spark, monkeypatch):
    """More events make more files; no row holds its neighbours' lists."""
    files = []
    monkeypatch.setattr(flows, "_FILE", 10)
    monkeypatch.setattr(flows, "load_json", lambda s, at, *a: files.append(at) or load(s, at, *a)) if (load := flows.load_json) else None
    events = spark.range(1000).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.concat(F.lit('{"k": '), F.col("id").cast("string"), F.lit("}")).alias("props"))
    got = {(r["id"], r["content"], r["kind"]) for r in flows.json_props_docs(SimpleNamespace(spark=spark, sf_dir="", events=events)).collect()}
    assert got == {(f"e{i}", str(i), "view") for i in range(1000)}
    lengths = [r["value"].count('"key"') for r in spark.read.text(files[0], wholetext=True).collect()]
    assert len(lengths) == 100 and max(lengths) == 10


def _nearest(ids, q, ci, c, k, same, least, digits, ask=None):
    s = q @ c.T
    s = np.where(s >= least, s, -np.inf)
    s = s if digits is None else np.round(s, digits)
    if not same:
        s[ids[:, None] == ci] = -np.inf
    if ask is not None:
        s[~ask] = -np.inf
    order = [np.lexsort((ci, -x))[:k] for x in s]
    return [[(int(ci[j]), round(float(s[i, j]), 8)) for j in o if np.isfinite(s[i, j])] for i, o in enumerate(order)]


def test_best_products_against_brute_force():
    """Blocks in any order of ids, hundreds of equal vectors, zero vectors, codes near and far, and queries that want few of them."""
    rng = np.random.default_rng(3)
    c = search._units(np.concatenate((rng.normal(size=(2500, 16)), np.repeat(rng.normal(size=(2, 16)), 400, axis=0), np.zeros((40, 16)))))
    ci = rng.permutation(len(c)).astype(np.int64)
    pick = rng.permutation(len(c))[:300]
    ids, q = ci[pick], c[pick]
    wanted = rng.random((len(q), len(c))) < 0.05
    for same, least, noise, asks in ((False, 0.0, None, False), (True, -2.0, None, False), (False, -np.inf, 0.01, False), (False, -np.inf, 2.0, False), (False, 0.3, None, True)):
        best = search.Best(ids, q, 5, same, least)
        near = c + (noise or 0) * rng.normal(size=c.shape) / 4
        errors = np.linalg.norm(c - near, axis=1)
        for at in range(0, len(c), 1500):
            x = slice(at, at + 1500)
            best.meet(ci[x], c[x], (near[x], errors[x]) if noise else None, (lambda rows, x=x: wanted[rows, x]) if asks else None)
        got = [[(int(i), round(float(v), 8)) for i, v in zip(a, b) if np.isfinite(v)] for a, b in zip(best.found, best.score)]
        assert got == _nearest(ids, q, ci, c, 5, same, least, 9, wanted if asks else None)


def test_blocks_are_larger_than_arrow_batches(spark):
    """What goes on is k rows a query and part of the corpus; with a block for each small batch it was k rows a query and batch."""
    df = spark.range(0, 2100, 1, 1).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        assert search._blocks(df, "vec_id", "embedding", "c").count() == 1
        assert search._blocks(df, "vec_id", "embedding", "q").count() == 3
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_relations_are_found_in_one_search(spark):
    """The quicker patterns find what PATTERNS find, each by one search of the text."""
    rng = random.Random(11)
    bits = "Ann Bob is the CEO of ceo parent was founded wa by located in part related to taught works at for work xé é_1 , . \n".split(" ") + ["is  in", "İs", "partof", "is the CEO of", "is the PARENT of", "wa founded by", "was taught by", "is located in", "part of", "related to", "works at"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(60)))) for i in range(400)] + [(400, None), (401, "")], "doc_id long, text string")
    want, found = ({tuple(r) for r in graph.extract_relations(docs, p).collect()} for p in (graph.PATTERNS, None))
    assert want == found and {r[3] for r in found} == set(graph.PATTERNS)
    assert _plan(graph.extract_relations(docs)).count("regexp_extract_all") == len(graph.PATTERNS)


def test_overlap_counts_each_list_once(spark):
    from collections import Counter

    from tidewell.operators import evaluate

    rng = random.Random(2)
    a, b = ([f"w{rng.randrange(3000)}" for _ in range(6000)] for _ in range(2))
    df = spark.createDataFrame([(a, b), (["x"], []), (None, ["x"])], "a array<string>, b array<string>").select(evaluate.token_f1(F.col("a"), F.col("b")).alias("f"))
    assert [round(r["f"], 9) for r in df.collect()] == [round(2 * (Counter(a) & Counter(b)).total() / 12000, 9), 0, 0]
    assert "aggregate(" not in _plan(df)


def test_adaptive_search_ranks_what_the_last_try_needs(spark):
    """What is read in the end are the rows that some try may want, already ranked."""
    from tests.conftest import SMALL
    from tidewell.plans import registry

    df = registry.queries()["adaptive_search"](spark, SMALL)
    assert "Window" not in _plan(df) and df.take(1)
