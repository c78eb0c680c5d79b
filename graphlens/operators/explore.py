"""Questions about single entities and files: navigate, why, search, locate, context, plan, conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens import schema
from graphlens.functions import scalar
from graphlens.operators.order import numbered
from graphlens.operators.traverse import traverse, with_nodes
from graphlens.session import stage
from graphlens.store import Graph


def navigate(graph: Graph, query: str) -> DataFrame:
    """(relation, id, position): what an entity calls, is called by, depends on and is imported by, each in order of the edges.

    A row with relation 'entity' gives the entity itself; no rows if none is meant.
    """
    id_ = graph.resolve(query)
    if id_ is None:
        return graph.spark.createDataFrame([], "relation string, id string, position int")
    e = graph.edges
    out, into = e.filter(F.col("source_id") == id_), e.filter(F.col("target_id") == id_)
    named = lambda df, relation, end: df.select(F.lit(relation).alias("relation"), F.col(end).alias("id"), "seq")
    rows = (
        named(out.filter("type = 'CALLS'"), "calls", "target_id")
        .unionByName(named(into.filter("type = 'CALLS'"), "called_by", "source_id"))
        .unionByName(named(out.filter("type = 'DEPENDS_ON'"), "depends_on", "target_id"))
        .unionByName(named(into.filter("type = 'IMPORTS'"), "imported_by", "source_id"))
    )
    order = Window.partitionBy("relation").orderBy("seq", "id")  # rows of one entity
    me = graph.spark.createDataFrame([("entity", id_, 1)], "relation string, id string, position int")
    return me.unionByName(rows.select("relation", "id", F.row_number().over(order).alias("position")))


def why(graph: Graph, entity: str, depth: int = 3) -> DataFrame:
    """(side, position, edge_type, other, file, reason, total_relationships): the first ``depth`` edges of either side, in words.

    Edges whose other end is no node take a place but do not come out.
    """
    id_ = graph.resolve(entity, "path")
    if id_ is None:
        return graph.spark.createDataFrame([], "side string, position int, edge_type string, other string, file string, reason string, total_relationships bigint")
    me = graph.get_node(id_).select("structural.name").limit(1).collect()
    own = me[0][0]
    edges = graph.get_edges(id_)
    total = edges.count()
    first = edges.withColumn("position", F.row_number().over(Window.partitionBy("side").orderBy("seq", "source_id", "target_id", "type"))).filter(F.col("position") <= depth)
    other = F.when(F.col("side") == "incoming", F.col("source_id")).otherwise(F.col("target_id"))
    ends = graph.nodes.select(F.col("id").alias("_end"), F.col("structural.name").alias("other"), F.col("file_path").alias("file"))
    rows = first.withColumn("_end", other).join(ends, "_end")
    said = F.when(F.col("side") == "incoming", F.concat_ws(" ", "other", "type", F.lit(own))).otherwise(F.concat_ws(" ", F.lit(own), "type", "other"))
    return rows.select("side", "position", F.col("type").alias("edge_type"), "other", "file", said.alias("reason"), F.lit(total).cast("bigint").alias("total_relationships"))


def search(graph: Graph, terms: list[str], top_k: int = 5, node_types: list[str] | None = None, match: str = "any", tags: list[str] | None = None, scope: str = "full") -> DataFrame:
    """(id, type, name, file_path, score), best first, ties in order of insertion; only scores above 0.

    ``match='all'``, ``tags`` and ``scope`` narrow the search as their names
    say; by default they do nothing.
    """
    nodes = graph.in_scope(scope)
    if node_types:
        nodes = nodes.filter(F.col("type").isin(*node_types))
    if tags:
        nodes = nodes.filter(F.arrays_overlap("semantic.tags", F.array(*[F.lit(t) for t in tags])))
    name, doc, text = F.col("structural.name"), F.col("semantic.docstring"), F.col("semantic.description")
    if match == "all":
        for t in terms:
            nodes = nodes.filter(scalar.search_score(name, doc, text, [t]) > 0)
    scored = nodes.withColumn("score", scalar.search_score(name, doc, text, terms)).filter("score > 0")
    return scored.orderBy(F.desc("score"), "seq").limit(top_k).select("id", "type", name.alias("name"), "file_path", "score")


def locate(graph: Graph, query: str, top_k: int = 5, node_types: list[str] | None = None) -> DataFrame:
    """(id, name, file, matched_on, docstring, tags, score), best first, ties in order of insertion."""
    nodes = graph.nodes.filter(F.col("type").isin(*node_types)) if node_types else graph.nodes
    s = scalar.locate_score(F.col("structural.name"), F.col("semantic.docstring"), F.col("semantic.tags"), query.split())
    hit = nodes.withColumn("s", s).filter("s.score > 0")
    return hit.orderBy(F.desc("s.score"), "seq").limit(top_k).select("id", F.col("structural.name").alias("name"), F.col("file_path").alias("file"), "s.matched_on", "semantic.docstring", "semantic.tags", "s.score")


def related_patterns(graph: Graph, file_path: str, top_k: int = 5, least: float = 0.5) -> DataFrame:
    """(file_path, name, similarity): nodes of other files with the type of the file's first node and a like name."""
    first = graph.find_nodes(file_path=file_path).orderBy("seq").limit(1).select("type", "structural.name").collect()
    if not first:
        return graph.spark.createDataFrame([], "file_path string, name string, similarity double")
    like = scalar.name_similarity(F.lit(first[0].name), F.col("structural.name"))
    rows = graph.nodes.filter((F.col("type") == first[0].type) & (F.col("file_path") != file_path)).withColumn("s", like).filter(F.col("s") > least)
    return rows.withColumn("similarity", F.round("s", 2)).orderBy(F.desc("similarity"), "seq").limit(top_k).select("file_path", F.col("structural.name").alias("name"), "similarity")


def file_summaries(graph: Graph) -> DataFrame:
    """One row per file: role, blast radius, complexities, heat and risk of its first node, for all files at once."""
    first = graph.nodes.groupBy("file_path").agg(F.min_by(F.struct("id", "type"), "seq").alias("n")).select("file_path", "n.id", "n.type")
    e = graph.edges
    api = graph.nodes.filter(F.col("file_path").contains("/api")).select(F.col("id").alias("source_id"), F.lit(1).alias("api"))
    into = e.filter("type = 'IMPORTS'").join(api, "source_id", "left").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("blast_radius"), F.count("api").alias("api_layer_callers"))
    http = F.size(scalar.http_decorators(F.col("semantic.decorators")))
    target = graph.nodes.select(F.col("id").alias("target_id"), F.col("structural.complexity").alias("c"), http.alias("h"))
    out = e.filter("type = 'DEFINES'").join(target, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("defined"), F.avg("c").alias("avg"), F.max("c").alias("max_complexity"), F.sum("h").alias("http"))
    tests = e.filter("type = 'TESTS'").join(graph.nodes.select(F.col("id").alias("source_id"), F.col("file_path").alias("test")), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("test").alias("test_files"))
    rows = first.join(into, "id", "left").join(out, "id", "left").join(tests, "id", "left").fillna(0, ["blast_radius", "api_layer_callers", "defined", "max_complexity", "http", "test_files"]).fillna(0.0, ["avg"])
    blast, high = F.col("blast_radius"), F.col("max_complexity")
    return rows.select(
        "file_path",
        "id",
        scalar.role(F.col("file_path"), F.col("type"), blast, F.col("defined"), F.col("http")).alias("role"),
        "blast_radius",
        "api_layer_callers",
        "defined",
        F.bround("avg", 1).alias("avg_complexity"),
        "max_complexity",
        (F.col("test_files") > 0).alias("has_tests"),
        ((blast > 10) | (high > 8)).alias("is_hot_node"),
        (blast + high).alias("heat_score"),
        scalar.risk(blast, F.bround("avg", 1)).alias("risk_level"),
    )


def test_files(graph: Graph, id_: str) -> DataFrame:
    """(position, file_path): the distinct files of what tests a node, in order of the path."""
    tests = graph.get_edges(id_, "TESTS", "incoming").select(F.col("source_id").alias("id")).join(graph.nodes.select("id", "file_path"), "id")
    return numbered(tests.select("file_path").distinct(), ["file_path"], "position", 1).select("position", "file_path")


def context(graph: Graph, file_path: str, depth: int = 2) -> dict[str, DataFrame]:
    """All about one file, as frames: self, imports, imported_by, defines, related_patterns, entry_points, data_flow_in, data_flow_out, tests, summary.

    ``tests`` (position, file_path): files with tests of it, each once, in order.

    An unknown file gives {}.
    """
    first = graph.find_nodes(file_path=file_path).orderBy("seq").limit(1).select("id").collect()
    if not first:
        return {}
    id_ = first[0].id
    pair = lambda df: df.orderBy("seq").select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    defined = graph.get_edges(id_, "DEFINES", "outgoing").select(F.col("target_id").alias("id"), F.col("seq").alias("at")).join(graph.nodes, "id")
    web = scalar.http_decorators(F.col("semantic.decorators"))
    flow = lambda way: with_nodes(graph, traverse(graph, id_, ["CALLS"], depth, 50, way)).select("rank", F.col("id").alias("node_id"), "name", "file_path")
    mine = Graph(graph.nodes, graph.edges.filter((F.col("source_id") == id_) | (F.col("target_id") == id_)))
    return {
        "self": graph.get_node(id_).select(*schema.flat_node()),
        "imports": pair(graph.get_edges(id_, "IMPORTS", "outgoing")),
        "imported_by": pair(graph.get_edges(id_, "IMPORTS", "incoming")),
        "defines": defined.orderBy("at").select(*schema.flat_node()),
        "related_patterns": related_patterns(graph, file_path),
        "entry_points": defined.filter(F.size(web) > 0).select(F.col("structural.name").alias("name"), web.alias("decorators"), "file_path"),
        "data_flow_in": flow("incoming"),
        "data_flow_out": flow("outgoing"),
        "tests": test_files(graph, id_),
        "summary": file_summaries(mine).filter(F.col("file_path") == file_path),
    }


def plan(graph: Graph, description: str, target_file: str, change_type: str = "refactor") -> dict[str, DataFrame]:
    """affected (node_id), steps (step, action, details) and risk (risk_level) of a change to a file.

    A node counts as affected if a walk against its calls finds anything; as
    the node itself is found, all nodes of the file are.
    """
    affected = stage(graph.find_nodes(file_path=target_file).select(F.col("id").alias("node_id"), "seq"), "affected")
    n = affected.count()
    steps = [(1, "Backup current state", f"Snapshot {target_file}"), (2, "Apply changes", description), (3, "Run tests", f"Test affected nodes: {n}")]
    if change_type == "signature_change":
        steps.append((4, "Update callers", f"Update {n} dependent functions"))
    risk = "high" if n > 10 else "medium" if n else "low"
    spark = graph.spark
    return {"affected": affected.orderBy("seq").select("node_id"), "steps": spark.createDataFrame(steps, "step int, action string, details string"), "risk": spark.createDataFrame([(risk,)], "risk_level string")}


def plan_files(graph: Graph, files: list[str]) -> DataFrame:
    """(step, file, dependants_in_plan, dependencies_in_plan, blast_radius, risk_level), in the order given."""
    listed = graph.spark.createDataFrame([(k, f) for k, f in enumerate(files, 1)], "step int, file string")
    owner = listed.join(graph.nodes.select("id", F.col("file_path").alias("file")), "file")
    source, target = owner.select(F.col("id").alias("source_id"), F.col("file").alias("from_file")), owner.select(F.col("id").alias("target_id"), F.col("file").alias("to_file"))
    calls = graph.typed(["CALLS"]).select("source_id", "target_id").join(source, "source_id").join(target, "target_id").filter("from_file <> to_file")
    depend = calls.select("from_file", "target_id", F.col("to_file").alias("file")).distinct().groupBy("file").agg(F.count("*").alias("dependants_in_plan"))
    out = graph.edges.join(source, "source_id").groupBy(F.col("from_file").alias("file")).agg(F.count("*").alias("dependencies_in_plan"))
    rows = listed.join(depend, "file", "left").join(out, "file", "left").fillna(0)
    n = F.col("dependants_in_plan")
    return rows.select("step", "file", n, "dependencies_in_plan", n.alias("blast_radius"), F.when(n > 3, "high").when(n > 0, "medium").otherwise("low").alias("risk_level"))


def dependency_order(graph: Graph, files: list[str]) -> DataFrame:
    """(file, layer): files of a plan, leaves first; files in a cycle share the layer behind all others (-1)."""
    listed = graph.spark.createDataFrame([(f,) for f in files], "file string").distinct()
    owner = graph.nodes.select("id", F.col("file_path").alias("file")).join(listed, "file", "left_semi")
    source, target = owner.select(F.col("id").alias("source_id"), F.col("file").alias("f")), owner.select(F.col("id").alias("target_id"), F.col("file").alias("t"))
    needs = stage(graph.typed(["CALLS", "IMPORTS", "DEPENDS_ON"]).join(source, "source_id").join(target, "target_id").filter("f <> t").select("f", "t").distinct(), "needs")
    left, out, layer = stage(listed, "left"), None, 0
    while True:
        open_ = needs.join(left.withColumnRenamed("file", "t"), "t", "left_semi").select(F.col("f").alias("file")).distinct()
        done = stage(left.join(open_, "file", "left_anti").withColumn("layer", F.lit(layer)), "layer")
        if done.isEmpty():
            rest = left.withColumn("layer", F.lit(-1))
            return rest if out is None else out.unionByName(rest)
        out = done if out is None else out.unionByName(done)
        left, layer = stage(left.join(done.select("file"), "file", "left_anti"), "left"), layer + 1


def conflicts(graph: Graph, entities: DataFrame | None = None, locked_files: list[str] | None = None) -> DataFrame:
    """(id, caller_count, conflict, high_blast_radius, locked, annotated) for the given ids, or all nodes.

    More than five calls into a node, or a lock on its file, is a conflict; a
    node annotated by hand is a warning.
    """
    nodes = graph.nodes.select("id", "file_path", "semantic.manually_set")
    if entities is not None:
        nodes = nodes.join(entities.select("id").distinct(), "id", "left_semi")
    callers = graph.typed(["CALLS"]).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("caller_count"))
    rows = nodes.join(callers, "id", "left").fillna(0, ["caller_count"])
    high, locked = F.col("caller_count") > 5, F.col("file_path").isin(*locked_files) if locked_files else F.lit(False)
    return rows.select("id", "caller_count", (high | locked).alias("conflict"), high.alias("high_blast_radius"), locked.alias("locked"), F.col("manually_set").alias("annotated"))


def session_overlap(sessions: DataFrame) -> DataFrame:
    """(session_a, session_b, files): open sessions whose scopes share files; pairs come from shared files only."""
    s = sessions.filter("status = 'open'").select("session_id", F.explode("scope").alias("file")).distinct()
    a, b = s.withColumnRenamed("session_id", "session_a"), s.withColumnRenamed("session_id", "session_b")
    return a.join(b, "file").filter("session_a < session_b").groupBy("session_a", "session_b").agg(F.count("*").alias("files"))
