"""Walks over the graph: bounded breadth-first, reachability, shortest flow.

Each level is one join of the frontier with the edges of the wanted types; a
level is written before the next begins, so lineage stays short and a lost
executor costs one level.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens import schema
from graphlens.operators.order import numbered
from graphlens.session import Staged, stage
from graphlens.store import Graph

_REACHED = "id string, level int, rank bigint, parent_rank bigint"
#: Steps of a level, and nodes of a walk, up to which the driver holds them.
SMALL = 4096
#: Rows of a level up to which Spark may broadcast it: their files say little of their size, as paths and ids repeat.
FEW = 65536


def _known_steps(graph: Graph, types: list[str] | None, direction: str, columns: tuple[str, ...]) -> DataFrame:
    """Steps (here, there, ...): read from the store where that is cheap, else worked out and written once, in ranges of ``here``."""
    steps = graph.ends(types, direction).select(*columns)
    if graph.stored:
        return steps
    return stage(steps.repartitionByRange("here", "there").sortWithinPartitions("here"), "steps")


def _from(steps: DataFrame, frontier: DataFrame, most: int = 256) -> DataFrame:
    """Frontier rows (here, ...) with their steps. A small frontier is named in a filter, so that files without its nodes are not read."""
    few = [r.here for r in frontier.select("here").distinct().limit(most + 1).collect()]
    if len(few) <= most:
        return frontier.join(steps.filter(F.col("here").isin(few)), "here")
    return (frontier if frontier.count() <= FEW else frontier.hint("merge")).join(steps, "here")


def _few_steps(steps: DataFrame, ids: list[str], columns: tuple[str, ...]) -> list | None:
    """The distinct steps from a few nodes, on the driver; None if there are more than ``SMALL``."""
    rows = steps.filter(F.col("here").isin(ids)).select(*columns).distinct().limit(SMALL + 1).collect()
    return rows if len(rows) <= SMALL else None


def _known(nodes: DataFrame, ids) -> set[str]:
    ids = list(ids)
    return {r.id for r in nodes.filter(F.col("id").isin(ids)).select("id").collect()} if ids else set()


def _cut(children: list[tuple[int, int]], total: int, max_nodes: int | None) -> tuple[int, int]:
    """(nodes kept, last parent expanded) of (parent rank, children) in order: a parent is expanded while fewer than ``max_nodes`` nodes are there."""
    n, last = 0, -1
    for parent, count in sorted(children):
        if max_nodes is not None and total + n >= max_nodes:
            break
        n, last = n + count, parent
    return n, last


def traverse(graph: Graph, start: str, types: list[str] | None = None, depth: int = 3, max_nodes: int | None = 100, direction: str = "outgoing") -> DataFrame:
    """(id, level, rank, parent_rank) in breadth-first order, the start node first.

    An unknown start gives no rows; no types means all; ends that are no nodes
    are passed over; ``both`` walks outwards, as incoming edges lead back to
    where the walk is. The cap is looked at before a node is expanded, so the
    last expansion may overshoot it: a node is kept if fewer than ``max_nodes``
    nodes were there before its parent was expanded.

    Levels of at most ``SMALL`` steps are worked out on the driver, from reads
    that name the nodes in question. From the first larger one on all is done
    in tables, with the same result. With a cap a level has fewer than
    ``max_nodes`` nodes to expand, so their numbers of children fit on the
    driver, which finds the parent that passes the cap; what later parents
    reach is dropped before anything is ordered.
    """
    known = graph.nodes.select(F.col("id").alias("there"))
    begin = graph.nodes.filter(F.col("id") == start).select("id").limit(1).collect()
    if not begin:
        return graph.spark.createDataFrame([], _REACHED)
    steps = _known_steps(graph, types, "incoming" if direction == "incoming" else "outgoing", ("here", "there", "seq"))
    rows, ranks = [(start, 0, 0, -1)], {start: 0}
    total, level = 1, 0
    while level < depth and ranks and (max_nodes is None or total < max_nodes):
        near = _few_steps(steps, list(ranks), ("here", "there", "seq"))
        if near is None or len(rows) > SMALL:
            break
        level, seen, best = level + 1, {r[0] for r in rows}, {}
        for r in near:
            if r.there not in seen:
                best[r.there] = min(best.get(r.there, (ranks[r.here], r.seq)), (ranks[r.here], r.seq))
        there = _known(graph.nodes, best)
        children = Counter(best[x][0] for x in there)
        n, last = _cut(list(children.items()), total, max_nodes)
        new = sorted((*best[x], x) for x in there if best[x][0] <= last)
        ranks = {x: total + k for k, (_, _, x) in enumerate(new)}
        rows += [(x, level, ranks[x], parent) for parent, _, x in new]
        total += n
    begun = graph.spark.createDataFrame(rows, _REACHED)
    if level >= depth or not ranks or (max_nodes is not None and total >= max_nodes):
        return begun
    levels = [Staged(begun.filter(F.col("level") < level), "bfs"), Staged(begun.filter(F.col("level") == level), "bfs")]
    for level in range(level + 1, depth + 1):
        if max_nodes is not None and total >= max_nodes:
            break
        frontier = levels[-1].df.select(F.col("id").alias("here"), F.col("rank").alias("parent_rank"))
        reached = levels[0].df.select("id")
        for x in levels[1:]:
            reached = reached.unionByName(x.df.select("id"))
        met = _from(steps, frontier).groupBy("there").agg(F.min(F.struct("parent_rank", "seq")).alias("m"))
        new = met.join(reached.withColumnRenamed("id", "there"), "there", "left_anti").join(known, "there", "left_semi")
        new = Staged(new.select(F.col("there").alias("id"), F.lit(level).alias("level"), F.col("m.parent_rank").alias("parent_rank"), F.col("m.seq").alias("seq")), "met")
        if max_nodes is None:
            n = new.df.count()
            nxt = Staged(new.df.select("id", "level", F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("parent_rank")), "bfs")
        else:
            n, last = _cut([tuple(r) for r in new.df.groupBy("parent_rank").agg(F.count("*")).collect()], total, max_nodes)
            nxt = Staged(numbered(new.df.filter(F.col("parent_rank") <= last), ["parent_rank", "seq", "id"], "rank", total).select("id", "level", "rank", "parent_rank"), "bfs")
        new.drop()
        if not n:
            nxt.drop()
            break
        levels.append(nxt)
        total += n
    out = levels[0].df
    for x in levels[1:]:
        out = out.unionByName(x.df)
    return out


def neighbors(graph: Graph, id_: str, types: list[str] | None = None, depth: int = 1) -> DataFrame:
    return traverse(graph, id_, types, depth, 1000)


def trace(graph: Graph, start: str, relationship: str = "CALLS", depth: int = 3, direction: str = "outgoing") -> DataFrame:
    """Nodes of a bounded walk, with level and rank; an unknown relationship counts as CALLS."""
    types = [relationship if relationship in schema.EDGE_TYPES else "CALLS"]
    return with_nodes(graph, traverse(graph, start, types, depth, 100, direction))


def with_nodes(graph: Graph, reached: DataFrame) -> DataFrame:
    return reached.select("id", "level", "rank").join(graph.nodes.select(*schema.flat_node()), "id")


def impact(graph: Graph, entity: str, change_type: str = "delete", max_nodes: int | None = 200) -> DataFrame:
    """(rank, id, file_path, name, severity, recommendation): what depends on an entity, itself first.

    A row per dependent, so the result stays a table however many there are;
    severity and advice, the same on all rows, go by their number. An unknown
    entity gives no rows.
    """
    from graphlens.functions.scalar import severity

    id_ = graph.resolve_target(entity)
    if id_ is None:
        return graph.spark.createDataFrame([], "rank bigint, id string, file_path string, name string, severity string, recommendation string")
    reached = traverse(graph, id_, ["CALLS", "IMPORTS", "DEFINES"], 10, max_nodes, "incoming")
    rows = stage(with_nodes(graph, reached).select("rank", "id", "file_path", "name"), "impact")
    n = rows.count()
    said = {"signature_change": f"Update {n} callers to match new signature", "delete": f"Remove or stub {n} dependent references"}.get(change_type, "")
    return rows.withColumn("severity", severity(F.lit(n))).withColumn("recommendation", F.lit(said))


def impact_files(affected: DataFrame) -> DataFrame:
    """(file_path, position): the files of an impact in order of first sight, by rank."""
    return affected.groupBy("file_path").agg(F.min("rank").alias("position"))


def reachable(graph: Graph, starts: DataFrame, types: list[str] | None, direction: str = "outgoing", merge: int = 8) -> DataFrame:
    """(id) of nodes at one step or more from any start; a start is among them only if a path leads back to one.

    As many rounds as the longest shortest path. Small rounds are worked out
    on the driver as in ``traverse``. A larger one joins the last level with
    the steps; what was seen before is kept in few tables: every ``merge``
    levels they are written as one and the old ones freed.
    """
    steps = _known_steps(graph, types, direction, ("here", "there"))
    begin = starts.select("id").distinct().filter("id IS NOT NULL")
    few = [r.id for r in begin.limit(SMALL + 1).collect()]
    got: set[str] = set()
    while few and len(few) <= SMALL and len(got) <= SMALL:
        near = _few_steps(steps, few, ("there",))
        if near is None:
            break
        few = list(_known(graph.nodes, {r.there for r in near} - got))
        got |= set(few)
    one = lambda ids: graph.spark.createDataFrame([(x,) for x in sorted(ids)], "id string")
    if not few:
        return one(got)
    frontier = Staged(one(few) if got else begin, "frontier")
    seen = [Staged(one(got), "seen")] if got else []
    while True:
        new = _from(steps, frontier.df.withColumnRenamed("id", "here")).select(F.col("there").alias("id")).distinct().join(graph.ids, "id", "left_semi")
        for x in seen:
            new = new.join(x.df.hint("merge"), "id", "left_anti")  # up to all nodes, and several at once
        nxt = Staged(new, "frontier")
        if nxt.df.isEmpty():
            break
        if frontier not in seen:
            frontier.drop()
        seen.append(nxt)
        frontier = nxt
        if len(seen) > merge:
            old, whole = seen[:-1], seen[0].df
            for x in old[1:]:
                whole = whole.unionByName(x.df)
            seen = [Staged(whole, "seen"), nxt]
            for x in old:
                x.drop()
    out = seen[0].df if seen else nxt.df
    for x in seen[1:]:
        out = out.unionByName(x.df)
    return out


def distances(graph: Graph, start: str, types: list[str] | None = None, direction: str = "outgoing", most: int = 10) -> DataFrame:
    """(id, level): least number of steps from the start, up to ``most``; no cap on nodes."""
    return traverse(graph, start, types, most, None, direction).select("id", "level")


def flow(graph: Graph, start: str, end: str, flow_type: str = "data", max_edges: int = 10) -> DataFrame:
    """(step, id, name, type, transformation) along a shortest path of at most ``max_edges`` edges.

    Of several shortest paths the least by the ids along it is taken. Nodes
    that are not in the graph may be walked through but do not come out. Equal
    start and end give that node alone.
    """
    a, b = graph.resolve(start, "name"), graph.resolve(end, "name")
    empty = graph.spark.createDataFrame([], "step int, id string, name string, type string, transformation string")
    if a is None or (b is None and start != end):
        return empty
    if start == end:
        path = [a]
    else:
        types = ["IMPORTS", "DEFINES"] if flow_type == "dependency" else ["CALLS", "DEFINES"]
        path = _shortest(graph, a, b, types, max_edges)
        if path is None:
            return empty
    steps = graph.spark.createDataFrame([(k, x) for k, x in enumerate(path)], "at int, id string")
    # at most max_edges + 1 rows; without a word Spark takes them for large and broadcasts the nodes
    found = F.broadcast(steps).join(graph.nodes.select("id", F.col("structural.name").alias("name"), "type"), "id")
    order = Window.orderBy("at")  # as few rows
    out = found.withColumn("step", F.row_number().over(order)).withColumn("before", F.lag("name").over(order))
    return out.select("step", "id", "name", "type", F.when(F.col("before").isNotNull(), F.concat("before", F.lit(" → "), "name")).alias("transformation"))


def _shortest(graph: Graph, start: str, end: str, types: list[str], max_edges: int) -> list[str] | None:
    """Forward levels until the end is met, then back along them: each node keeps the least path that leads to it."""
    steps = _known_steps(graph, types, "outgoing", ("here", "there"))
    paths, met, done = {start: [start]}, {start}, 0
    while done < max_edges and paths and len(met) <= SMALL:
        near = _few_steps(steps, list(paths), ("here", "there"))
        if near is None:
            break
        new: dict[str, list[str]] = {}
        for r in near:
            if r.there is not None and r.there not in met:
                new[r.there] = min(new.get(r.there, paths[r.here]), paths[r.here])
        done, paths = done + 1, {x: [*way, x] for x, way in new.items()}
        met |= set(paths)
        if end in paths:
            return paths[end]
    if done == max_edges or not paths:
        return None
    frontier = Staged(graph.spark.createDataFrame(list(paths.items()), "id string, path array<string>"), "flow")
    seen = graph.spark.createDataFrame([(x,) for x in sorted(met)], "id string")
    for _ in range(max_edges - done):
        new = _from(steps, frontier.df.withColumnRenamed("id", "here")).groupBy("there").agg(F.min("path").alias("path"))
        new = new.join(seen.withColumnRenamed("id", "there"), "there", "left_anti").select(F.col("there").alias("id"), F.concat("path", F.array("there")).alias("path"))
        frontier = Staged(new, "flow")
        hit = frontier.df.filter(F.col("id") == end).limit(1).collect()
        if hit:
            return list(hit[0].path)
        if frontier.df.isEmpty():
            return None
        seen = seen.unionByName(frontier.df.select("id"))
    return None


def dependency_chain(graph: Graph, start: str, end: str, max_edges: int = 10) -> list[str] | None:
    """Ids along a shortest path over edges of any type, or None."""
    return _shortest(graph, start, end, list(schema.EDGE_TYPES), max_edges)


def seed_walk(graph: Graph, seeds: DataFrame, hops: int = 2, types: list[str] | None = None) -> DataFrame:
    """(id, level): nodes within ``hops`` steps of any seed, in either direction; seeds have level 0."""
    steps = graph.ends(types, "either").select("here", "there").join(graph.ids.withColumnRenamed("id", "there"), "there", "left_semi")
    frontier = stage(seeds.select("id").distinct().withColumn("level", F.lit(0)), "seeds")
    out = frontier
    for level in range(1, hops + 1):
        new = _from(steps, frontier.select(F.col("id").alias("here"))).select(F.col("there").alias("id")).distinct().join(out.select("id"), "id", "left_anti")
        frontier = stage(new.withColumn("level", F.lit(level)), "walk")
        out = out.unionByName(frontier)
    return out
