"""Tables that grow with the graph are never broadcast, however small Spark takes their files to be."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from graphlens.operators import ranking, sets, telemetry, traverse
from graphlens.plans import pathql
from graphlens.session import Staged
from graphlens.store import Graph


@pytest.fixture(scope="module")
def graph(spark):
    """A saved graph of 40 nodes in a chain, opened again."""
    nodes = spark.range(40).select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("File").alias("type"), F.col("id").alias("seq"))
    edges = spark.range(39).select(F.concat(F.lit("n"), "id").alias("source_id"), F.concat(F.lit("n"), F.col("id") + 1).alias("target_id"), F.lit("CALLS").alias("type"), F.col("id").alias("seq"))
    path = f"{tempfile.mkdtemp()}/g"
    Graph.from_flat(nodes, edges).save(path)
    return Graph.load(spark, path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def staged(monkeypatch):
    """The plans of the tables written meanwhile."""
    plans, write = [], Staged.__init__

    def keep(self, df, name="stage"):
        plans.append(plan(df))
        write(self, df, name)

    monkeypatch.setattr(Staged, "__init__", keep)
    return plans


def broadcast(text: str) -> list[str]:
    """The scans below broadcasts, as the folders they read."""
    out, inside = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth <= inside:
            inside = None
        if inside is None and "BroadcastExchange" in line:
            inside = depth
        if inside is not None and "FileScan" in line:
            out.append(re.search(r"Location: \w+\(1 paths\)\[(?:.*/)?([^/\]]+)", line)[1])
    return out


def test_reading_plans(graph):
    """A join of small files is one that Spark broadcasts."""
    assert broadcast(plan(graph.edges.join(graph.nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi"))) == ["nodes"]


def test_edges_by_type(graph):
    out = telemetry.edges_by_type(graph)
    assert "nodes" not in broadcast(plan(out)) and out.count() == 78


def test_integrity(graph):
    some = Graph(graph.nodes.filter("seq <> 7"), graph.edges)
    out = sets.integrity(some)
    assert "nodes" not in broadcast(plan(out)) and {tuple(r)[:3] for r in out.collect()} == {("orphan", "n7", "n8"), ("dangling", "n6", "n7")}


def test_seed_walk(graph, staged):
    out = traverse.seed_walk(graph, graph.nodes.filter("id = 'n5'"), 2)
    assert {tuple(r) for r in out.collect()} == {("n5", 0), ("n4", 1), ("n6", 1), ("n3", 2), ("n7", 2)}
    assert len(staged) == 3 and not any("nodes" in broadcast(p) for p in staged)


def test_pagerank(graph, staged):
    out = ranking.pagerank(graph, ["CALLS"], 2)
    assert out.count() == 40 and out.agg(F.sum("rank")).first()[0] == pytest.approx(1)
    assert len(staged) == 5 and not any(re.match("nodes|ranks", x) for p in staged for x in broadcast(p))


def test_reachable(graph, staged, monkeypatch):
    monkeypatch.setattr(traverse, "SMALL", 0)
    out = traverse.reachable(graph, graph.nodes.filter("id = 'n30'"), ["CALLS"], merge=2)
    assert sorted(r.id for r in out.collect()) == [f"n{k}" for k in range(31, 40)]
    assert len(staged) > 9 and not any(re.match("nodes|seen", x) for p in staged for x in broadcast(p))


def test_transitive_path(graph, staged):
    out = pathql.run(graph, "*[id='n30'] CALLS+ File").edges
    assert {r.source_id for r in out.collect()} == {f"n{k}" for k in range(30, 39)}
    assert not any(re.match("nodes|closure|starts", x) for p in [*staged, plan(out)] for x in broadcast(p))


def test_flow(graph):
    out = traverse.flow(graph, "n3", "n6")
    assert [r.id for r in out.orderBy("step").collect()] == ["n3", "n4", "n5", "n6"]
    assert "nodes" not in broadcast(plan(out))


def test_large_levels_of_a_flow(graph, staged, spark, monkeypatch):
    """300 ways of two steps: beyond ``FEW`` a level is not broadcast."""
    monkeypatch.setattr(traverse, "SMALL", 0)
    monkeypatch.setattr(traverse, "FEW", 0)
    ends = [("a", f"m{k}") for k in range(300)] + [(f"m{k}", "z") for k in range(300)]
    edges = spark.createDataFrame([(*e, "CALLS", k) for k, e in enumerate(ends)], "source_id string, target_id string, type string, seq long")
    wide = Graph.from_flat(spark.createDataFrame([(x, x, k) for k, x in enumerate(["a", "z"])], "id string, name string, seq long"), edges)
    assert [r.id for r in traverse.flow(wide, "a", "z").orderBy("step").collect()] == ["a", "z"]
    assert not any(x.startswith("flow") for x in broadcast(staged[-1]))
