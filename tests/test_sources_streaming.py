"""Ingest, exchange and streaming pipelines."""

import json
import uuid

from pyspark.sql import functions as F

from graphlens.operators import control
from graphlens.sources import exchange, ingest
from graphlens.store import Graph
from graphlens.streaming import pipelines
from graphlens.schema import make_edges, make_nodes

CODE = b'''"""Module text."""
import os
from pkg.util import helper as h

class A(Base):
    def go(self, x: int) -> str:
        """Runs."""
        return h(x) + self.stop()

    def stop(self):
        if os.getcwd():
            return ""

def test_a():
    A().go(1)
'''


def test_ingest(spark, tmp_path):
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "src" / "node_modules").mkdir()
    (tmp_path / "src" / "main.py").write_bytes(CODE)
    (tmp_path / "src" / "pkg" / "util.py").write_text("def helper(x):\n    return str(x)\n")
    (tmp_path / "src" / "bad.py").write_text("def (:\n")
    (tmp_path / "src" / "node_modules" / "skip.py").write_text("x = 1\n")
    parsed = ingest.parse(ingest.scan(spark, str(tmp_path / "src"))).cache()
    rows = {r.path.rsplit("/", 1)[-1]: r for r in parsed.collect()}
    assert set(rows) == {"main.py", "util.py", "bad.py"} and rows["bad.py"].error and not rows["bad.py"].nodes
    names = {(n.type, n["name"]) for n in rows["main.py"].nodes}
    assert names == {("File", "main.py"), ("Class", "A"), ("Function", "go"), ("Function", "stop"), ("Test", "test_a")}
    go = next(n for n in rows["main.py"].nodes if n["name"] == "go")
    assert go.signature == "def go(self, x: int) -> str" and go.docstring == "Runs."
    nodes = ingest.nodes_of(parsed)
    flat = nodes.select("id", "name", "file_path", F.xxhash64("id").alias("seq"))
    imports = parsed.select("path", F.explode("imports").alias("i")).select("path", "i.*")
    linked = ingest.link(ingest.candidates_of(parsed), flat, imports).filter("type = 'CALLS'").collect()
    by = {(r.target_id.split("::")[-2] if not r.target_id.startswith("::") else r.target_id, r.by) for r in linked}
    assert ("helper", "import") in by and ("stop", "same_file") in by and any(b == "unresolved" for _, b in by)
    assert make_nodes(nodes).filter("structural.name = 'stop'").first().structural.complexity == 2
    now = parsed.select("path", "content_hash")
    assert ingest.changed_files(now, now.select(F.col("path").alias("file_path"), "content_hash")).count() == 0
    assert ingest.changed_files(now, now.limit(0).select(F.col("path").alias("file_path"), "content_hash")).count() == 3


def test_exchange(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "function", "x.py", "a"), ("b", None, "x.py", "b"), (None, "Class", "x.py", "c"), ("", "Class", "x.py", "c"), ("d", "NoType", "x.py", "d")], "id string, type string, file string, name string")
    edges = spark.createDataFrame([("a", "b", None), ("a", None, "CALLS"), ("a", "b", "NOPE")], "source string, target string, type string")
    g, skipped = exchange.load(nodes, edges)
    assert g.nodes.count() == 2 and g.edges.first().type == "CALLS" and {(r.kind, r.n) for r in skipped.collect()} == {("nodes", 3), ("edges", 2)}
    folder = f"file://{tmp_path}/snap"
    exchange.backup(g, folder, "one")
    exchange.backup(Graph(g.nodes.limit(1), g.edges), folder, "two")
    assert exchange.restore(spark, folder).nodes.count() == 1
    assert exchange.restore(spark, folder, "one").nodes.count() == 2
    assert json.loads(exchange.to_json(g.edges.select("type")).first().json) == {"type": "CALLS"}
    a = exchange.signed(g, "k").first().signature
    assert a == exchange.signed(g, "k").first().signature != exchange.signed(g, "other").first().signature
    assert exchange.verify(g, exchange.signed(g, "k"), "k") and not exchange.verify(Graph(g.nodes.limit(1), g.edges), exchange.signed(g, "k"), "k")
    g.register("t_")
    assert spark.sql("select count(*) from t_nodes").first()[0] == 2


def stream(spark, tmp_path, rows, schema):
    folder = tmp_path / uuid.uuid4().hex
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    return spark.readStream.schema(schema).json(str(folder))


def test_file_events_and_debounce(spark, tmp_path):
    t = lambda s: f"2025-01-01T00:00:{s:06.3f}Z"
    rows = [{"path": "a.py", "event_type": "modified", "ts": t(0)}, {"path": "a.py", "event_type": "modified", "ts": t(0.3)}, {"path": "a.py", "event_type": "modified", "ts": t(0.6)}, {"path": "b.py", "event_type": "moved", "to_path": "c.py", "ts": t(1)}, {"path": "x.txt", "event_type": "created", "ts": t(1)}, {"path": "a.py", "event_type": "odd", "ts": t(2)}]
    events = pipelines.normalise(stream(spark, tmp_path, rows, pipelines.EVENTS))
    out = pipelines.run_once(pipelines.debounce(events), "debounced", str(tmp_path / "c1"))
    got = sorted((r.path, r.event_type) for r in out.collect())
    assert got == [("a.py", "modified"), ("a.py", "modified"), ("b.py", "deleted"), ("c.py", "created")]


def test_leases_and_rates(spark, tmp_path):
    schema = "file_path string, ts timestamp, action string, session_id string, ttl double"
    t = lambda s: f"2025-01-01T00:00:{s:02}Z"
    rows = [{"file_path": "f", "ts": t(k), "action": a, "session_id": s, "ttl": 10} for k, a, s in [(0, "lock", "A"), (1, "lock", "B"), (2, "unlock", "B"), (3, "steal", "B"), (4, "unlock", "A"), (20, "lock", "A")]]
    out = pipelines.run_once(pipelines.leases(stream(spark, tmp_path, rows, schema)), "leases", str(tmp_path / "c2")).orderBy("ts").collect()
    assert [r.granted for r in out] == [True, False, False, True, False, True] and [r.fencing_token for r in out] == [1, None, None, 2, None, 3]
    calls = [{"key": "k", "ts": t(k)} for k in range(5)]
    allowed = pipelines.run_once(pipelines.rate_limit(stream(spark, tmp_path, calls, "key string, ts timestamp"), 3), "rates", str(tmp_path / "c3")).filter("allowed").count()
    assert allowed == 3


def test_control(spark):
    events = spark.createDataFrame([("s1", "a", "t", ["f"], "w", "open", 1), ("s1", "a", "t", ["f"], "w", "closed", 2), ("s2", "a", "t", ["f", "g"], "w", "open", 1)], "session_id string, agent_id string, task string, scope array<string>, mode string, status string, ts int")
    s = control.latest_sessions(events)
    assert {r.session_id: r.status for r in s.collect()} == {"s1": "closed", "s2": "open"}
    reviews = spark.createDataFrame([("r", "created", 1), ("r", "comment", 2), ("r", "approved", 3), ("r", "comment", 4)], "review_id string, event string, ts int")
    row = control.reviews(reviews).first()
    assert (row.status, row.comments) == ("approved", 2)
    g = Graph(make_nodes(spark.createDataFrame([("a", "f.py", "a")], "id string, file_path string, name string")), make_edges(spark.createDataFrame([], "source_id string, target_id string, type string")))
    files = spark.createDataFrame([("f.py",)], "file_path string")
    saved = control.checkpoint(g, files)
    assert control.rollback_report(saved, g).count() == 0
    assert control.guard(g.nodes.select("id"), g, files).first().verdict == "block"
    proposed = spark.createDataFrame([("b", "f.py", ""), ("c", "g.py", "")], "id string, file_path string, signature string")
    assert {(r.id, r.change, r.verdict) for r in control.dry_run(g, proposed, files).collect()} == {("a", "removed", "block"), ("b", "added", "block"), ("c", "added", "allow")}


def test_sessions(spark):
    import datetime

    at = lambda h: datetime.datetime(2025, 1, 1, h)
    none = spark.createDataFrame([], "session_id string, agent_id string, task string, scope array<string>, mode string, status string, ts timestamp")
    e = control.open_session(none, "s", "a", "t", ["f"], "write", at(1))
    assert control.open_session(e, "s", "a", "t", ["f"], "write", at(2)).count() == 1
    locks = spark.createDataFrame([("f", "s", at(1), at(9), 1), ("g", "s", at(1), at(2), 2)], "file_path string, session_id string, acquired_at timestamp, expires_at timestamp, fencing_token long")
    r = control.recover_sessions(e, locks, at(3)).first()
    assert (r.session_id, r.files, r.started_at) == ("s", ["f"], at(1))
    closed = control.close_session(e, "s", at(4))
    assert control.latest_sessions(closed).first().status == "closed" and control.close_session(closed, "s", at(5)).count() == 2 and control.recover_sessions(closed, locks, at(3)).count() == 0


def test_parse_on_demand(spark):
    files = lambda *x: spark.createDataFrame([(p, None if t is None else bytearray(t, "utf-8")) for p, t in x], "path string, content binary")
    one = ingest.ensure_parsed(ingest.parse(files().limit(0)), files(("a.py", "def f(): pass\n"), ("b.py", "def (:"), ("c.py", None), (None, "x")))
    names = lambda parsed: {r.path: sorted(n["name"] for n in r.nodes) for r in parsed.collect()}
    assert names(one) == {"a.py": ["a.py", "f"], "b.py": [], "c.py": ["c.py"]}
    now = files(("a.py", "def g(): pass\n"), ("c.py", ""), ("d.py", "x = 1"))
    from graphlens.functions.scalar import content_hash

    hashed = now.select("path", content_hash()(F.col("content").cast("string")).alias("content_hash"))
    assert {r.path: r.status for r in ingest.parse_status(one, hashed).collect()} == {"a.py": "stale", "c.py": "parsed", "d.py": "not_parsed"}
    some = ingest.ensure_parsed(one, now, spark.createDataFrame([("d.py",)], "path string"))
    assert set(names(some)) == {"a.py", "b.py", "c.py", "d.py"} and names(some)["a.py"] == ["a.py", "f"]
    assert names(ingest.ensure_parsed(some, now)) == {"a.py": ["a.py", "g"], "c.py": ["c.py"], "d.py": ["d.py"]}


def test_reparse_by_priority(spark):
    rows = [("a.py", "modified", 1, 45), ("b.py", "created", 1, 5), ("c.py", "deleted", 2, 5), ("c.py", "created", 1, 5), ("d.py", "modified", 1, 3)]
    batch = spark.createDataFrame(rows, "path string, event_type string, ts int, priority int")
    written, gone = [], []
    pipelines.reparse(batch, lambda p: p.select("path", F.lit("x = 1").alias("content")), lambda out: written.append({r.path for r in out.collect()}), lambda p: gone.extend(r.path for r in p.collect()))
    assert written == [{"b.py", "d.py"}, {"a.py"}] and gone == ["c.py"]
