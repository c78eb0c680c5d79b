"""Graph operators on small fixtures."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from graphlens.functions import scalar
from graphlens.operators import changelog, community, enrich, explore, sets, telemetry, traverse, vectors
from graphlens.plans import pathql
from graphlens.store import Graph

CALLS = [("login", "validate"), ("validate", "log"), ("handler", "login")]


@pytest.fixture(scope="module")
def graph(spark):
    names = [("login", "Function", "src/auth/login.py", 1), ("validate", "Function", "src/auth/login.py", 20), ("log", "Function", "src/auth/login.py", 40), ("handler", "Function", "src/api/handler.py", 5), ("User", "Class", "src/models/user.py", 1), ("__init__", "Function", "src/models/user.py", 5)]
    nodes = spark.createDataFrame([(n, t, f, n, f"def {n}():", f"{n} docs", line, k) for k, (n, t, f, line) in enumerate(names)], "id string, type string, file_path string, name string, signature string, docstring string, start_line int, seq long")
    edges = [(a, b, "CALLS") for a, b in CALLS] + [("User", "__init__", "DEFINES"), ("login", "User", "USES"), ("login", "gone", "CALLS"), ("login", "::print::", "CALLS")]
    return Graph.from_flat(nodes, spark.createDataFrame([(a, b, t, k) for k, (a, b, t) in enumerate(edges)], "source_id string, target_id string, type string, seq long"))


def pairs(result):
    return {(r.source_id, r.target_id) for r in result.edges.collect()}


def test_path_expressions(graph):
    assert pairs(pathql.run(graph, "Function CALLS Function")) == set(CALLS)
    assert pairs(pathql.run(graph, "function[name='login'] calls Function")) == {("login", "validate")}
    assert pairs(pathql.run(graph, "Function[name='handler'] CALLS+ Function[name='log']")) == set(CALLS)
    assert pairs(pathql.run(graph, "Function[name='log'] <-CALLS<- Function")) == {("validate", "log")}
    assert pairs(pathql.run(graph, "Class -> Function")) == {("User", "__init__")}
    assert pairs(pathql.run(graph, "'login' USES Class DEFINES *")) == {("login", "User"), ("User", "__init__")}
    assert pairs(pathql.run(graph, "*[nosuch!='x'] CALLS *")) == set()
    assert pathql.run(graph, "Function[name=~'^log']").nodes.count() == 2
    stats = pathql.run(graph, "Function[name='login'] CALLS Function").stats.first()
    assert tuple(stats) == (2, 1, 1, 1)
    for bad in ("", "Nothing CALLS *", "Function NOSUCH *", "Function ->CALLS<- *", "Function[name=~'('] CALLS *", "Function[name] CALLS *", "Function ?"):
        with pytest.raises(pathql.PathError):
            pathql.run(graph, bad).edges.collect()


def test_cycle_under_plus(graph, spark):
    more = Graph(graph.nodes, graph.edges.unionByName(spark.createDataFrame([("log", "login", "CALLS", 99)], "source_id string, target_id string, type string, seq long").withColumn("metadata", F.lit(None).cast("map<string,string>"))))
    r = pathql.run(more, "Function[name='login'] CALLS+ Function[name='login']")
    assert r.stats.first().terminal_nodes == 1


def walk_model(nodes, edges, start, depth, cap):
    """A queue that looks at its cap before it expands a node."""
    if start not in nodes:
        return []
    out, seen, queue = [start], {start}, deque([(start, 0)])
    while queue:
        x, level = queue.popleft()
        if len(out) >= cap:
            break
        if level >= depth:
            continue
        for a, b in edges:
            if a == x and b in nodes and b not in seen:
                seen.add(b)
                out.append(b)
                queue.append((b, level + 1))
    return out


@pytest.mark.parametrize("seed,small", [(0, 4096), (1, 4096), (2, 2), (3, 2), (4, 0)])
def test_capped_walk(spark, seed, small, monkeypatch):
    monkeypatch.setattr(traverse, "SMALL", small)
    r = random.Random(seed)
    names = [f"n{k}" for k in range(12)]
    edges = [(r.choice(names), r.choice([*names, "dangling"])) for _ in range(30)]
    cap, depth = r.choice([1, 3, 5, 9]), r.choice([1, 2, 4])
    g = Graph.from_flat(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "id string, seq long"), spark.createDataFrame([(a, b, "CALLS", k) for k, (a, b) in enumerate(edges)], "source_id string, target_id string, type string, seq long"))
    got = [x.id for x in traverse.traverse(g, "n0", ["CALLS"], depth, cap).orderBy("rank").collect()]
    assert got == walk_model(set(names), edges, "n0", depth, cap)
    assert traverse.traverse(g, "unknown").count() == 0


@pytest.mark.parametrize("small", [0, 3, 4096])
def test_walks_of_any_size(spark, small, monkeypatch):
    monkeypatch.setattr(traverse, "SMALL", small)
    r = random.Random(small)
    names = [f"n{k}" for k in range(14)]
    edges = sorted({(r.choice(names), r.choice(names)) for _ in range(18)})
    g = Graph.from_flat(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "id string, seq long"), spark.createDataFrame([(a, b, "CALLS", k) for k, (a, b) in enumerate(edges)], "source_id string, target_id string, type string, seq long"))
    seen, new = set(), {"n0"}
    while new:
        new = {b for a, b in edges if a in new} - seen
        seen |= new
    assert {x.id for x in traverse.reachable(g, g.get_node("n0"), ["CALLS"], merge=2).collect()} == seen
    ways = {"n0": ["n0"]}
    level = dict(ways)
    while level:
        level = {b: min([*level[a], b] for a, c in edges if c == b and a in level) for b in {b for a, b in edges if a in level} - set(ways)}
        ways |= level
    for end in names[:5]:
        assert traverse.dependency_chain(g, "n0", end, 14) == (ways.get(end) if end != "n0" else None)


def test_entities(graph):
    assert graph.resolve("src/api/handler.py") == "handler" and graph.resolve("valid") == "validate" and graph.resolve("zzz") is None
    assert graph.resolve_target("src/auth/login.py:fn:log") == "log" and graph.resolve_target("fn:handler") == "handler"
    rows = {(r.relation, r.id) for r in explore.navigate(graph, "login").collect()}
    assert {("entity", "login"), ("calls", "validate"), ("called_by", "handler")} <= rows
    assert explore.navigate(graph, "zzz").count() == 0
    said = explore.why(graph, "validate").collect()
    assert {r.reason for r in said} == {"login CALLS validate", "validate CALLS log"} and said[0].total_relationships == 2
    hit = traverse.impact(graph, "log")
    assert [r.id for r in hit.orderBy("rank").collect()] == ["log", "validate", "login", "handler"] and hit.first().severity == "medium"
    path = traverse.flow(graph, "handler", "log").orderBy("step").collect()
    assert [r.name for r in path] == ["handler", "login", "validate", "log"] and path[1].transformation == "handler → login"
    assert traverse.flow(graph, "log", "handler").count() == 0 and traverse.flow(graph, "log", "log").count() == 1
    assert explore.search(graph, ["log"]).first().score == 5 and explore.search(graph, []).count() == 0
    assert explore.locate(graph, "", 2).count() == 2
    assert explore.locate(graph, "login").first().matched_on == "name"
    about = explore.context(graph, "src/auth/login.py")
    assert about["summary"].first().role == "isolated" and about["data_flow_out"].count() == 3
    assert explore.context(graph, "nowhere") == {}
    assert explore.plan(graph, "x", "src/auth/login.py", "signature_change")["steps"].count() == 4


def test_sets_and_integrity(graph):
    base = sets.baseline(graph.nodes)
    assert sets.check(base).filter("NOT ok").count() == 0
    assert {(r.id, r.change) for r in sets.diff(base, base.filter("id <> 'log'")).collect()} == {("log", "removed")}
    assert {(r.problem, r.target_id) for r in sets.integrity(graph).collect()} == {("dangling", "gone")}
    a, b = sets.merkle(graph.nodes), sets.merkle(graph.nodes.filter("id <> 'handler'"))
    assert {r.path for r in sets.merkle_diff(a, b).collect()} == {"", "src", "src/api", "src/api/handler.py"}
    assert sets.merkle_diff(a, sets.merkle(graph.nodes)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    names = [f"n{k:02}" for k in range(40)]
    edges = [(r.choice(names), r.choice(names)) for _ in range(25)] + [("n00", "ghost")]
    g = Graph.from_flat(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "id string, seq long"), spark.createDataFrame([(a, b, "CALLS", k) for k, (a, b) in enumerate(edges)], "source_id string, target_id string, type string, seq long"))
    label = {n: n for n in [*names, "ghost"]}
    for _ in range(50):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {x.id: x.community for x in community.components(g).collect()} == label


def test_communities(graph):
    members = community.components(graph, ["DEFINES"])
    assert community.bridges(graph, members).count() == 6
    cross = community.boundaries(graph, members).filter("to_community = 'User'").first()
    assert cross.edge_count == 1 and cross.coupling == 0.25 and len(cross.examples) == 1


def test_changelog_against_a_replay(spark):
    r = random.Random(5)
    for _ in range(3):
        log = [(k, r.choice(["BEGIN", "COMMIT", "ABORT", "NODE_UPSERT", "NODE_UPSERT", "NODE_UPSERT", "NODE_DELETE", "FILE_DELETE", "EDGE_UPSERT"])) for k in range(60)]
        rows, buffer, live, edges, inside = [], [], {}, [], False

        def apply(seq, kind, key):
            if kind == "NODE_UPSERT":
                live[key] = (live[key][0] if key in live else seq, seq, f"f{key[-1]}")
            elif kind == "EDGE_UPSERT":
                edges.append((key, seq))
            else:
                for n in [n for n in live if (n == key if kind == "NODE_DELETE" else live[n][2] == key)]:
                    del live[n]
                    edges[:] = [e for e in edges if n not in e[0].split(">")]

        for seq, kind in log:
            node = f"n{r.randint(0, 5)}"
            key = {"FILE_DELETE": f"f{r.randint(0, 5)}", "EDGE_UPSERT": f"n{r.randint(0, 5)}>n{r.randint(0, 5)}"}.get(kind, node)
            payload = '{"source_id": "%s", "target_id": "%s", "type": "CALLS"}' % tuple(key.split(">")) if kind == "EDGE_UPSERT" else '{"file_path": "f%s"}' % node[-1]
            rows.append((seq, kind, key, None, payload))
            if kind == "BEGIN":
                buffer, inside = [], True
            elif kind == "COMMIT":
                for x in buffer if inside else []:
                    apply(*x)
                buffer, inside = [], False
            elif kind == "ABORT":
                buffer, inside = [], False
            elif inside:
                buffer.append((seq, kind, key))
            else:
                apply(seq, kind, key)
        df = spark.createDataFrame(rows, "seq long, rtype string, key string, tx_id long, payload string")
        state = changelog.replay(df)
        assert {x.key: (x.first_seq, x.seq) for x in state["nodes"].collect()} == {k: v[:2] for k, v in live.items()}
        got = sorted((f"{x.source_id}>{x.target_id}", x.seq) for x in state["edges"].collect())
        assert got == sorted(edges)
        keep = changelog.committed(df, span=7).select("seq").collect()
        assert sorted(x.seq for x in keep) == sorted(x.seq for x in changelog.committed(df).select("seq").collect())


def test_annotations(graph, spark):
    n = graph.nodes
    assert enrich.status_counts(enrich.enrich(n, "t", n.limit(2))).filter("status = 'enriched'").first().n == 2
    tagged = enrich.tag(enrich.tag(n, ["a", "b"]), ["a"], "remove")
    assert tagged.first().semantic.tags == ["b"] and enrich.tag(n, ["a"], "other").first().semantic.tags == []
    notes = spark.createDataFrame([("log", "text", None), ("log", None, ["t"])], "id string, description string, tags array<string>")
    out = enrich.annotate(n, notes).filter("id = 'log'").first().semantic
    assert (out.description, out.tags, out.manually_set) == ("text", ["t"], True)
    assert telemetry.degrees(graph).filter("id = 'login'").first().degree == 5


def test_scalars(spark):
    df = spark.createDataFrame([("src/api/x.py", ["@get", "@app.get('/')"], 'a"b\\c\nd')], "p string, d array<string>, v string")
    row = df.select(scalar.http_decorators(F.col("d")).alias("h"), scalar.file_stem(F.col("p")).alias("s"), scalar.label_escape(F.col("v")).alias("e"), scalar.name_similarity(F.lit("ab"), F.lit("abc")).alias("j"), scalar.name_similarity(F.lit(""), F.lit("abc")).alias("z")).first()
    assert (row.h, row.s, row.e, round(row.j, 3), row.z) == (["@get"], "x", 'a\\"b\\\\c\\nd', 0.667, 0.0)


def test_vectors(spark):
    rows = [("A", [1.0, 0.0, 0.0, 0.0]), ("B", [0.0, 1.0, 0.0, 0.0]), ("C", [1.0, 1.0, 0.0, 0.0]), ("zero", [0.0] * 4)]
    v = spark.createDataFrame([(i, e, {"f": i}, k, False) for k, (i, e) in enumerate(rows)], "id string, embedding array<float>, metadata map<string,string>, seq long, deleted boolean")
    got = [(r.id, round(r.score, 4)) for r in vectors.top_k(v, [1, 0, 0, 0]).collect()]
    assert got == [("A", 0.0), ("C", 0.2929), ("B", 1.0), ("zero", 1.0)]
    assert vectors.top_k(v, [1, 0, 0, 0], where={"f": "B"}).count() == 1
    again = v.unionByName(v.filter("id = 'A'").withColumn("deleted", F.lit(True)).withColumn("seq", F.lit(9)))
    assert vectors.latest(again).count() == 3 and vectors.check_dimension(v, 3).count() == 4


def test_vector_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    queries = e.filter(F.col("id").cast("int") % 100 == 0)
    near = {(r.query_id, r.id) for r in vectors.many_top_k(e, queries, 10).collect()}
    exact = {(q.id, r.id) for q in queries.collect() for r in vectors.top_k(e, list(q.embedding), 10).collect()}
    assert len(near & exact) >= 0.9 * len(exact)


def test_vector_neighbors_of_many_rows(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 20_000
    m = np.random.default_rng(5).standard_normal((n, 64)).astype(np.float32)
    m[7], m[300] = m[200], 0
    pq.write_table(pa.table({"id": [str(k) for k in range(n)], "embedding": pa.array(list(m), pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    e = spark.read.parquet(str(tmp_path / "e.parquet"))
    u = m.astype(np.float64) / np.maximum(np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True), 1e-30)
    asked = [k for k in range(0, n, 100) if k != 300]
    want = {(str(q), str(j)) for q, d in zip(asked, 1 - u[asked] @ u.T) for j in np.argsort(d, kind="stable")[:10]}
    queries = e.filter("id % 100 = 0 AND id != 300")
    assert {(r.query_id, r.id) for r in vectors.many_top_k(e, queries, 10).collect()} == want
    assert {(r.query_id, r.id) for r in vectors.many_top_k(e.repartition(5), queries, 10, block=64).collect()} == want
    assert vectors.many_top_k(e.limit(0), queries.limit(0)).count() == 0


def test_whole_graph_queries_see_every_node(spark):
    import __spark_entry__ as entry
    from graphlens.queries import graph as whole
    from tests.helpers import SF

    nodes = {r.id: r for r in whole.graph(spark, SF).nodes.select("id", "type", "seq").collect()}
    bad = {r.id for r in entry.queries()["integrity_check"](spark, SF).filter("state = 'changed'").collect()}
    assert bad == {i for i, r in nodes.items() if r.seq % 7 == 0}
    changed = {nodes[r.id].type for r in entry.queries()["snapshot_diff"](spark, SF).collect()}
    for types in ({nodes[i].type for i in bad}, changed):
        assert types >= {"Package", "File", "Class", "Function"}
    assert entry.entry(spark).count() > 0


def test_paths_of_any_length_of_result(graph):
    for most in (1, 2, 10**9):
        r = pathql.run(graph, "Function CALLS Function", most)
        assert r.nodes.count() > 0 and r.cut == ([1] if most < 3 else [])
    assert pairs(pathql.run(graph, "Function CALLS Function", 10**9)) == set(CALLS)
    ends = {r.id for r in pathql.run(graph, "Class -> Function", 1).nodes.collect()}
    assert ends == {"User", "__init__"}


def test_numbered(spark):
    from graphlens.operators.order import first, numbered

    df = spark.range(5000).selectExpr("id", "id % 7 as g", "'x' as n").repartition(6)
    rows = numbered(df, [F.desc("g"), "id"], "place", 1).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.place)] == sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert sorted(r.place for r in rows) == list(range(1, 5001))
    assert sorted(r.id for r in first(df, 3, ["id"]).collect()) == [0, 1, 2] and numbered(df.limit(0), ["id"]).count() == 0


def test_writes(graph, spark, tmp_path):
    new = Graph.from_flat(spark.createDataFrame([("log", "Function", "z.py", "log2", 0), ("more", "Class", "z.py", "more", 1), ("more", "Class", "z.py", "last", 2)], "id string, type string, file_path string, name string, seq long"), spark.createDataFrame([("more", "log", "CALLS", 0), (None, "log", "CALLS", 1)], "source_id string, target_id string, type string, seq long"))
    g = graph.upsert_nodes(new.nodes).upsert_edges(new.edges)
    names = {r.id: (r.name, r.seq) for r in g.nodes.select("id", "structural.name", "seq").collect()}
    assert names["log"] == ("log2", 2) and names["more"] == ("last", 7) and len(names) == 7
    assert g.edges.count() == graph.edges.count() + 1 and g.upsert_edges(new.edges).edges.count() == graph.edges.count() + 2
    left = g.delete_nodes(spark.createDataFrame([("log",), ("gone",)], "id string"))
    assert left.nodes.count() == 6 and {r.target_id for r in left.edges.collect()} == {"validate", "login", "__init__", "User", "gone", "::print::"}
    assert g.delete_by_file(spark.createDataFrame([("z.py",)], "file_path string")).nodes.count() == 5 and g.clear().edges.count() == 0
    g.save(f"file://{tmp_path}/g")
    loaded = Graph.load(spark, f"file://{tmp_path}/g")
    assert loaded.stored and not Graph(loaded.nodes, loaded.edges.filter("type = 'CALLS'")).stored
    assert {tuple(r) for r in traverse.traverse(loaded, "log", None, 3, None, "incoming").select("id", "level").collect()} == {tuple(r) for r in traverse.traverse(g, "log", None, 3, None, "incoming").select("id", "level").collect()}
    assert loaded.get_edges("log").count() == g.get_edges("log").count() == 2


def test_hub_under_a_cap(spark):
    edges = spark.range(3000).selectExpr("'hub' as source_id", "concat('n', id) as target_id", "'CALLS' as type", "id + 1 as seq").unionByName(spark.createDataFrame([("a", "hub", "CALLS", 0), ("a", "b", "CALLS", 1), ("b", "c", "CALLS", 2)], "source_id string, target_id string, type string, seq long"))
    nodes = edges.selectExpr("target_id as id", "seq").unionByName(spark.createDataFrame([("a", -1)], "id string, seq long"))
    got = traverse.traverse(Graph.from_flat(nodes, edges), "a", ["CALLS"], 3, 50).collect()
    assert len(got) == 3003 and sorted(r.rank for r in got) == list(range(3003)) and "c" not in {r.id for r in got}


def test_journal(spark, tmp_path):
    log = changelog.Journal(spark, f"file://{tmp_path}/log")
    assert log.read().count() == 0
    rows = lambda *x: spark.createDataFrame([(k, r, key, None, None) for k, (r, key) in enumerate(x)], "at int, rtype string, key string, tx_id long, payload string")
    assert log.append(rows(("BEGIN", None), ("NODE_UPSERT", "a"), ("COMMIT", None)), ["at"]) == 3
    assert log.append(rows(("NODE_UPSERT", "b"), ("NODE_DELETE", "a")), ["at"]) == 5 and log.append(rows().limit(0), ["at"]) == 5
    assert [(r.seq, r.rtype) for r in log.read().orderBy("seq").collect()] == [(0, "BEGIN"), (1, "NODE_UPSERT"), (2, "COMMIT"), (3, "NODE_UPSERT"), (4, "NODE_DELETE")]
    assert {r.key for r in changelog.replay(log.read())["nodes"].collect()} == {"b"}


def test_collection(spark, tmp_path):
    c = vectors.Collection(spark, f"file://{tmp_path}/v", 2)
    put = lambda *x: c.upsert(spark.createDataFrame([(i, e, {"f": i or ""}, "d") for i, e in x], "id string, embedding array<float>, metadata map<string,string>, document string"))
    assert c.live().count() == 0
    put(("a", [1.0, 0.0]), ("b", [0.0, 1.0]), (None, [0.0, 1.0]))
    put(("a", [0.0, 2.0]))
    c.delete(spark.createDataFrame([("b",), ("z",)], "id string"))
    assert [(r.id, list(r.embedding)) for r in c.live().collect()] == [("a", [0.0, 2.0])] and c.get(spark.createDataFrame([("b",)], "id string")).count() == 0
    with pytest.raises(ValueError):
        put(("q", [1.0]))
    c.clear()
    assert c.live().count() == 0
