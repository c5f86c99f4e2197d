"""Connectors, caches, stored graphs, migrations, batches of sources."""

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidewell.functions import calls
from tidewell.operators import chunking, filters, graph, ingest, rerank
from tidewell.sources import connectors, files


def test_hosted_repository(spark):
    blobs = {"s1": b"# One", "s2": b"print(1)", "s3": b"\xff\xfe\x00"}
    tree = [{"path": "a.md", "sha": "s1", "type": "blob"}, {"path": "src", "sha": "x", "type": "tree"}, {"path": "src/b.py", "sha": "s2", "type": "blob"}, {"path": "c.bin", "sha": "s3", "type": "blob"}]

    class Host(BaseHTTPRequestHandler):
        def do_GET(self):
            body = {"tree": tree} if "/git/trees/" in self.path else {"content": base64.b64encode(blobs[self.path.rsplit("/", 1)[-1]]).decode()}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Host)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(connectors.HostedRepository)
    try:
        read = spark.read.format("hosted_repository").option("repo", "o/n").option("base", f"http://127.0.0.1:{server.server_port}").option("batch", "1")
        assert {tuple(r) for r in read.load().collect()} == {("a.md", "s1", "# One"), ("src/b.py", "s2", "print(1)")}
        assert [r["path"] for r in read.option("extensions", "md, txt").load().collect()] == ["a.md"]
    finally:
        server.shutdown()


def test_bucket_by_its_scheme(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("plain")
    assert connectors.bucket_documents(spark, "", f"{tmp_path}/docs".lstrip("/"), scheme="file").first()["content"] == "plain"


def test_remembering():
    now, seen = [0.0], []
    call = calls.Remembering(lambda x: seen.append(x) or x * 2, most=2, ttl=10, clock=lambda: now[0])
    assert [call(1), call(2), call(1), call(3), call(2)] == [2, 4, 2, 6, 4] and seen == [1, 2, 3, 2] and call.hits == 1
    now[0] = 11
    assert call(2) == 4 and seen[-1] == 2 and len(seen) == 5


def test_stored_graph_and_restore(spark, tmp_path):
    en = spark.createDataFrame([("a", "A", "x")], "id string, label string, type string")
    rel = spark.createDataFrame([("a", "b", "knows", 0.5), ("b", "a", "likes", 1.0)], "src string, dst string, type string, weight double")
    graph.save(en, rel, str(tmp_path / "g"))
    e, r = graph.load(spark, str(tmp_path / "g"))
    assert e.collect() == en.collect() and sorted(r.collect()) == sorted(rel.collect())
    files.backup(spark, str(tmp_path / "g" / "entities"), str(tmp_path / "b"))
    files.restore(spark, str(tmp_path / "b"), str(tmp_path / "back"), "id string, label string, score double")
    assert [tuple(x) for x in spark.read.parquet(str(tmp_path / "back")).collect()] == [("a", "A", None)]


def test_batch_of_sources(spark):
    docs = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    state = spark.createDataFrame([], "id long, hash string")
    told = []
    got = ingest.run_batch(spark, {"one": lambda: docs("a text", "a text", ""), "bad": lambda: 1 / 0, "two": lambda: docs("b")}, state, ingest.problems(), lambda n, c: told.append((n, c)))
    rows = {(r["source"], r["status"]): (r["n"], r["error"]) for r in got.collect()}
    assert rows == {("one", "duplicate"): (1, None), ("one", "invalid"): (1, None), ("one", "uploaded"): (1, None), ("bad", "failed"): (1, "ZeroDivisionError: division by zero"), ("two", "uploaded"): (1, None)}
    assert [n for n, _ in told] == ["one", "bad", "two"]


def test_year_sections_and_marks(spark):
    df = spark.createDataFrame([("2020-05-01",), ("1999-01-01T00:00:00Z",), ("no",), (None,)], "d string")
    count = lambda how, y: df.where(filters.Year("d", y, how).column()).count()
    assert [count("eq", 2020), count("ne", 2020), count("gt", 1999), count("gte", 1999), count("lt", 2020), count("lte", 1998)] == [1, 1, 1, 2, 1, 0]
    assert chunking.by_sections("a b\n---\n\n---\nc", lambda s: [(3, s), s.upper()]) == ["a b", "A B", "c", "C"]
    text = "One two three. " * 60
    assert all(len(c) <= 4 * 64 for c in chunking.adaptive(text.replace(". ", ".\n"))) and chunking.adaptive("") == []
    cand = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "query_id long, doc_id long")
    hits = lambda good: {(r["query_id"], r["doc_id"]) for r in rerank.mark(cand, good).where("relevant").collect()}
    assert hits(cand.where("doc_id = 1").select("doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))) == {(1, 1), (2, 1)}
    assert hits(cand.where("query_id = 2")) == {(2, 1)} and rerank.mark(cand, cand.limit(0)).where(~F.col("relevant")).count() == 3


@pytest.mark.parametrize("bad", [{"tree": [], "truncated": True}])
def test_cut_trees_are_an_error(bad, monkeypatch):
    reader = connectors.RepositoryReader({"repo": "o/n"})
    monkeypatch.setattr(reader, "_get", lambda path: bad)
    with pytest.raises(ValueError):
        reader.partitions()
