"""Parent-child rows to full hierarchies: path, depth, root, descendants and loops.

Method: deterministic hash splitters. Every node walks to its next splitter or
root by pointer doubling (few rounds, since gaps between splitters are short),
the much smaller graph of splitters is solved, and results are expanded back.
Walks that meet no splitter lie in or below a loop without one and are solved
apart. Nothing is collected but row counts and at most 64 hot keys.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.skew import hot_keys, join_unique
from graphlens.session import Staged, stage

#: One node in SPLIT is a splitter.
SPLIT = 16


def current_parents(nodes: DataFrame, key: str = "node_id", parent: str = "parent_id", version: str = "row_seq") -> DataFrame:
    """One row (node, parent) per key: that of the highest version.

    A null key is left out. Equal versions: the greatest parent by code point
    counts. A missing parent is null or ''. Repeated rows count once.
    """
    rows = nodes.select(F.col(key).alias("node"), F.col(version).alias("v"), F.coalesce(F.col(parent), F.lit("")).alias("p"))
    best = rows.filter(F.col("node").isNotNull()).groupBy("node").agg(F.max(F.struct(F.coalesce("v", F.lit(-(2**62))).alias("v"), "p")).alias("b"))
    return best.select("node", F.when(F.col("b.p") != "", F.col("b.p")).alias("parent"))


def _double(p: DataFrame) -> DataFrame:
    """One round: every open walk goes on by the walk of the node it has reached."""
    far = p.select(
        F.col("node").alias("cur"),
        F.col("cur").alias("_cur"),
        F.col("steps").alias("_steps"),
        F.col("low").alias("_low"),
        F.col("open").alias("_open"),
        F.col("seg").alias("_seg"),
    )
    joined = p.filter("open").join(far, "cur")
    gone_on = joined.select(
        "node",
        F.col("_cur").alias("cur"),
        (F.col("steps") + F.col("_steps")).alias("steps"),
        F.least("low", "_low").alias("low"),
        F.col("_open").alias("open"),
        F.concat("_seg", "seg").alias("seg"),
    )
    return p.filter("NOT open").unionByName(gone_on)


def _walk(start: DataFrame, name: str) -> tuple[Staged, int]:
    """Double until no walk is open, or a round closes none.

    A walk with an end passes nodes of every smaller distance to that end, so
    as long as one is open a round closes some: those left over are endless.
    """
    at = Staged(start, name)
    before, left = -1, at.df.filter("open").count()
    while left and left != before:
        nxt = Staged(_double(at.df), name)
        at.drop()
        at, before = nxt, left
        left = at.df.filter("open").count()
    return at, left


def _loops(open_walks: DataFrame, count: int) -> DataFrame:
    """(node, loop): the smallest id in the loop that an endless walk leads into.

    All pointers stay within the given rows. After at least ``count`` further
    steps every walk is inside its loop, and a walk of that length from there
    has seen all of the loop.
    """
    p = Staged(open_walks.withColumn("seg", F.array().cast("array<string>")), "loops")
    for _ in range(max(1, math.ceil(math.log2(max(2, count))) + 1)):
        nxt = Staged(_double(p.df), "loops")
        p.drop()
        p = nxt
    seen = p.df.select(F.col("node").alias("cur"), F.col("low").alias("loop"))
    return join_unique(p.df.select("node", "cur"), seen, "cur").select("node", "loop")


def resolve(nodes: DataFrame, key: str = "node_id", parent: str = "parent_id", version: str = "row_seq", paths: bool = False, split: int = SPLIT) -> DataFrame:
    """(node_id, root_id, depth, path) of every distinct node.

    A node without parent, or whose parent is no node, is a root with depth 0.
    Nodes in or below a loop get depth -1 and the smallest node_id of the loop
    as root; their path is null. ``path`` runs from root to node and is null
    unless ``paths``. An empty table gives no rows.
    """
    cur = stage(current_parents(nodes, key, parent, version), "parents")
    known = cur.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    tied = Staged(join_unique(cur, known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent")), "tied")
    hubs = hot_keys(tied.df, "parent", 1 / 256)
    chosen = F.pmod(F.xxhash64("node"), F.lit(split)) == 0
    if hubs:
        chosen = chosen | F.col("node").isin(hubs)
    linked = tied.df.withColumn("stop", chosen | F.col("parent").isNull())
    ends = linked.filter("stop").select(F.col("node").alias("parent"), F.lit(True).alias("end"))
    empty = F.array().cast("array<string>")
    own = F.array("node") if paths else empty
    first = (
        join_unique(linked, ends, "parent", "left")
        .select(
            "node",
            F.coalesce("parent", "node").alias("cur"),
            F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps"),
            F.col("node").alias("low"),
            (F.col("parent").isNotNull() & F.col("end").isNull()).alias("open"),
            own.alias("seg"),
            "stop",
        )
        .withColumn("is_root", F.col("steps") == 0)
    )
    flagged = Staged(first, "first")
    roots = flagged.df.filter("is_root").select("node")
    # splitters walk as well, but nobody's walk goes on through one
    walked, lost = _walk(flagged.df.drop("stop", "is_root"), "walk")
    flags = flagged.df.select("node", "stop", "is_root")
    done = Staged(walked.df.join(flags, "node"), "walked")
    walked.drop()
    # the reduced graph: splitters and roots only; a walk in it also ends at a splitter that was lost above
    ends_here = roots.select(F.col("node").alias("cur")).unionByName(done.df.filter("stop AND open").select(F.col("node").alias("cur"))).withColumn("ends_here", F.lit(True))
    reduced0 = join_unique(done.df.filter("stop AND NOT open"), ends_here, "cur", "left").select("node", "cur", "steps", "low", F.col("ends_here").isNull().alias("open"), "seg")
    solved, turning = _walk(reduced0, "reduced")
    loops = None
    if lost:
        loops = _loops(done.df.filter("open").select("node", "cur", "steps", "low", "open"), lost)
    top = solved.df
    if turning:
        circling = top.filter("open").select("node", "cur", "steps", "low", "open")
        lost_stops = _loops(circling, turning)
        loops = lost_stops if loops is None else loops.unionByName(lost_stops)
    if loops is not None:
        loops = stage(loops, "loop")
    nothing = F.lit(None).cast("string")
    ends_at = top.filter("NOT open").select("node", F.col("cur").alias("root"), F.col("steps").alias("more"), (F.when(F.col("steps") > 0, F.concat(F.array("cur"), "seg")).otherwise(F.col("seg")) if paths else F.col("seg")).alias("front"))
    if loops is None:
        ends_at = ends_at.withColumn("loop", nothing)
    else:
        met = loops.select(F.col("node").alias("root"), "loop")
        ends_at = join_unique(stage(ends_at, "tops"), met, "root", "left")
        ends_at = ends_at.unionByName(loops.select("node", F.col("node").alias("root"), F.lit(0).alias("more"), empty.alias("front"), "loop"))
    ends_at = stage(ends_at.withColumnRenamed("node", "cur"), "ends")
    plain = done.df.filter("NOT stop AND NOT open").select("node", "cur", "steps", "seg")
    out = join_unique(plain, ends_at, "cur").select("node", "root", "loop", (F.col("steps") + F.col("more")).alias("depth"), F.concat("front", "seg").alias("path"))
    self_solved = ends_at.select(F.col("cur").alias("node"), "root", "loop", F.col("more").alias("depth"), F.col("front").alias("path"))
    both = out.unionByName(self_solved)
    return both.select(
        F.col("node").alias("node_id"),
        F.coalesce("loop", "root").alias("root_id"),
        F.when(F.col("loop").isNotNull(), -1).otherwise(F.col("depth")).cast("int").alias("depth"),
        (F.when(F.col("loop").isNull(), F.col("path")) if paths else F.lit(None).cast("array<string>")).alias("path"),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance): every node with everything below it.

    ``resolved`` needs paths. The rows are the result itself, one per node and
    ancestor, and are made without a join by unfolding each path. Nodes in or
    below loops have no path and give no rows here: ``loop_descendants`` has
    them.
    """
    steps = resolved.filter("depth > 0").select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "node_id"))
    return steps.filter(F.col("at") < F.col("depth")).select("node_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))


def loops(nodes: DataFrame, resolved: DataFrame, key: str = "node_id", parent: str = "parent_id", version: str = "row_seq") -> DataFrame:
    """(node_id, loop_id, in_loop, path, ring, at) of every node in or below a loop.

    ``resolved`` is what ``resolve`` gives for ``nodes``. ``ring`` holds the
    nodes of the loop in the direction of the children, from the smallest id
    (``loop_id``) on; ``path`` runs from the loop node the node hangs from,
    which is at place ``at`` of the ring, to the node; a loop node is its own
    path. Each loop is opened at its smallest id, so what is left are trees
    and one more walk solves them.
    """
    stuck = resolved.filter("depth = -1").select(F.col("node_id").alias("node"), F.col("root_id").alias("loop_id"))
    cut = stage(stuck.join(current_parents(nodes, key, parent, version), "node"), "cut")
    trees = cut.select(F.col("node").alias("node_id"), F.when(F.col("node") != F.col("loop_id"), F.col("parent")).alias("parent_id"), F.lit(0).alias("row_seq"))
    walked = stage(resolve(trees, paths=True).select("node_id", F.col("root_id").alias("loop_id"), "path"), "opened")
    # the parent of the smallest id is the last node of the loop: its path is the loop
    last = cut.filter("node = loop_id").select(F.col("parent").alias("node_id"))
    rings = stage(walked.join(last, "node_id", "left_semi").select("loop_id", F.col("path").alias("ring")), "rings")
    both = join_unique(walked, rings, "loop_id").withColumn("k", F.size(F.array_intersect("path", "ring")))
    return both.select("node_id", "loop_id", (F.col("k") == F.size("path")).alias("in_loop"), F.slice("path", F.col("k"), F.size("path")).alias("path"), "ring", (F.col("k") - 1).alias("at"))


def loop_descendants(looped: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance) of the nodes in and below loops, from ``loops``.

    A loop node has below it the other nodes of its loop and all that hangs
    from any of them. ``distance`` is the least number of steps; no node is
    its own descendant.
    """
    size = F.size("path")
    tail = looped.select(F.col("node_id").alias("descendant_id"), size.alias("size"), F.posexplode("path").alias("i", "node_id"))
    below = tail.filter("i > 0 AND i < size - 1").select("node_id", "descendant_id", (F.col("size") - 1 - F.col("i")).alias("distance"))
    around = looped.select(F.col("node_id").alias("descendant_id"), size.alias("size"), "at", F.size("ring").alias("round"), F.posexplode("ring").alias("i", "node_id"))
    return below.unionByName(around.filter("node_id != descendant_id").select("node_id", "descendant_id", (F.pmod(F.col("at") - F.col("i"), F.col("round")) + F.col("size") - 1).alias("distance")))
