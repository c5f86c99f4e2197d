"""The store from upload to deletion, and the wrappers of model callables."""

import pytest

from tidewell.functions import calls, embed
from tidewell.operators import filters
from tidewell.store import Store


def whole(text):
    return [text]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), embed.mock_embedding(16))
    assert store.count() == 0 and store.namespaces() == []
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky"), (4, None)], "doc_id long, text string")
    from pyspark.sql import functions as F

    store.upload(docs, "food", whole, F.create_map(F.lit("n"), F.col("doc_id").cast("string")))
    store.upload(docs.where("doc_id = 3"), "other", whole)
    assert store.count() == 4 and store.namespaces() == ["food", "other"] and store.count(["other"]) == 1 and store.count([]) == 0
    assert [r["chunk_id"] for r in store.search_keywords("apple", namespaces=["food"]).collect()] == ["2::chunk-0", "1::chunk-0"]
    vector = [float(x) for x in embed.mock_vectors(["blue sky"], 16)[0]]
    top = store.search(vector, 1, namespaces=["other"]).first()
    assert top["doc_id"] == 3 and top["score"] == pytest.approx(1, abs=1e-6)
    assert store.search(vector, 5, [filters.Term("n", "2")], min_score=-1).count() == 1
    both = store.search_hybrid("apple", vector, 0.5, 3, namespaces=["food"]).collect()
    assert {r["chunk_id"] for r in both} >= {"1::chunk-0", "2::chunk-0"}
    store.upload(spark.createDataFrame([(2, "yellow pear")], "doc_id long, text string"), "food", whole)
    assert store.get("2::chunk-0")["content"] == "yellow pear" and store.count(["food"]) == 3
    store.delete_document(2)
    assert store.get("2::chunk-0") is None and store.count(["food"]) == 2
    store.upload(spark.createDataFrame([(2, "back")], "doc_id long, text string"), "food", whole)
    assert store.get("2::chunk-0")["content"] == "back"
    assert {r["n"] for r in store.integrity().collect()} == {0}


def test_calls(spark):
    state = {"n": 0, "t": 0.0}

    def flaky(prompt):
        state["n"] += 1
        if state["n"] % 3:
            raise OSError
        return "- a\n- b\n- a"

    waits = []
    assert calls.decompose(calls.retrying(flaky, 3, 1, waits.append), "q") == ["a", "b"] and waits == [1, 2]
    assert calls.falling_back(lambda p: 1 / 0, lambda p: "ok")("x") == "ok"
    breaker = calls.Breaker(lambda p: 1 / 0, 2, 10, lambda: state["t"])
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker("x")
    with pytest.raises(RuntimeError):
        breaker("x")
    state["t"] = 11
    with pytest.raises(ZeroDivisionError):
        breaker("x")
    slept = []
    limit = calls.RateLimit(lambda p: p, 2, 1, lambda: 0.0, slept.append)
    assert [limit("a"), limit("b")] == ["a", "b"] and slept == [0.5]
    assert calls.extracted('Sure: [{"id": "a"}, 3]') == [{"id": "a"}] and calls.extracted("none [") == []
    df = spark.createDataFrame([("00-" + "a" * 32 + "-" + "b" * 16 + "-01",), ("00-" + "0" * 32 + "-" + "b" * 16 + "-01",), ("x",), (None,)], "h string")
    got = [r[0] for r in df.select(calls.traceparent("h")).collect()]
    assert got[0]["sampled"] and got[0]["trace_id"] == "a" * 32 and got[1:] == [None] * 3
    a, b = spark.createDataFrame([(" Query ", "x"), ("query", "x")], "q string, n string").select(calls.cache_key("q", "n").alias("k")).collect()
    assert a == b
    spans = spark.createDataFrame([("t", "1", None, "a", 1, 9), ("t", "2", "1", "b", 2, 3)], "trace_id string, span_id string, parent_id string, name string, start int, end int")
    assert calls.traces(spans).first()["n_spans"] == 2
