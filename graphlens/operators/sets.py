"""Comparing graphs: snapshot diff, sync, integrity, Merkle hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions import scalar
from graphlens.store import Graph


def node_signature() -> F.Column:
    s = "structural."
    return scalar.signature(F.col("id"), F.col("type"), F.col("file_path"), F.col(s + "name"), F.col(s + "signature"), F.col(s + "start_line"), F.col(s + "end_line"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): nodes added, removed, or changed by their source hash (null equals null). One full outer join."""
    a = before.select("id", F.col("semantic.source_hash").alias("h"), F.lit(1).alias("in_a"))
    b = after.select("id", F.col("semantic.source_hash").alias("g"), F.lit(1).alias("in_b"))
    kind = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("h").eqNullSafe(F.col("g")), "changed")
    return a.join(b, "id", "full_outer").select("id", kind.alias("change")).filter("change IS NOT NULL")


def sync(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, state): ids with a signature, here and there: missing_locally, missing_remotely, changed or in_sync."""
    a, b = local.select("id", F.col("signature").alias("here")), remote.select("id", F.col("signature").alias("there"))
    kind = F.when(F.col("here").isNull(), "missing_locally").when(F.col("there").isNull(), "missing_remotely").when(F.col("here") != F.col("there"), "changed").otherwise("in_sync")
    return a.join(b, "id", "full_outer").select("id", kind.alias("state"))


def signatures(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", node_signature().alias("signature"))


def baseline(nodes: DataFrame) -> DataFrame:
    """Nodes with their signature kept as source hash."""
    return nodes.withColumn("semantic", F.col("semantic").withField("source_hash", node_signature()))


def check(nodes: DataFrame) -> DataFrame:
    """(id, ok): whether a node's signature still equals the one kept; ok is null where none was."""
    kept = F.col("semantic.source_hash")
    return nodes.select("id", F.when(kept != "", kept == node_signature()).alias("ok"))


def integrity(graph: Graph, locks: DataFrame | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """(problem, source_id, target_id, type): edges from no node, edges to no node (placeholders '::name::' excepted), locks of unknown sessions."""
    known = graph.ids
    orphan = graph.edges.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select(F.lit("orphan").alias("problem"), "source_id", "target_id", "type")
    dangling = graph.edges.filter(~F.col("target_id").startswith("::")).join(known.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select(F.lit("dangling").alias("problem"), "source_id", "target_id", "type")
    out = orphan.unionByName(dangling)
    if locks is not None and sessions is not None:
        lost = locks.join(sessions.select("session_id"), "session_id", "left_anti")
        out = out.unionByName(lost.select(F.lit("lock").alias("problem"), F.col("session_id").alias("source_id"), F.col("file_path").alias("target_id"), F.lit("LOCK").alias("type")))
    return out


def _part(text: F.Column, at: int) -> F.Column:
    """15 hex digits of a SHA-256 as a number: sums of such numbers are merged map-side, whatever the order."""
    return F.conv(F.substring(F.sha2(text, 256), at, 15), 16, 10).cast("decimal(38,0)")


def _combined(text: F.Column) -> F.Column:
    total = lambda at: F.sum(_part(text, at)).cast("string")
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), total(1), total(16)), 256)


def file_hashes(nodes: DataFrame) -> DataFrame:
    """(path, hash, nodes) of every file: a hash over its nodes' signatures, as a set."""
    return nodes.groupBy(F.coalesce("file_path", F.lit("")).alias("path")).agg(_combined(F.concat_ws("=", "id", node_signature())).alias("hash"), F.count("*").alias("nodes"))


def merkle(nodes: DataFrame) -> DataFrame:
    """(path, depth, hash, nodes): a hash of every file and directory, made bottom-up; '' is the whole tree.

    A file's hash is over its nodes' signatures, a directory's over its
    children's hashes, each as a set, so equal hashes mean equal content and
    no file or directory is ever gathered in one task.
    """
    from graphlens.session import stage

    level = stage(file_hashes(nodes).select("path", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))).alias("depth"), "hash", "nodes"), "merkle")
    deepest = level.agg(F.max("depth")).first()[0] or 0
    out = level
    for depth in range(deepest, 0, -1):
        parent = F.regexp_replace("path", r"/?[^/]*$", "")
        up = out.filter(F.col("depth") == depth).groupBy(parent.alias("path")).agg(_combined(F.concat_ws("=", "path", "hash")).alias("hash"), F.sum("nodes").alias("nodes"))
        out = stage(out.unionByName(up.select("path", F.lit(depth - 1).alias("depth"), "hash", "nodes")), "merkle")
    return out


def merkle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, depth): paths whose hashes differ or that only one side has."""
    x, y = a.select("path", "depth", F.col("hash").alias("h")), b.select("path", "depth", F.col("hash").alias("g"))
    return x.join(y, ["path", "depth"], "full_outer").filter(~F.col("h").eqNullSafe(F.col("g"))).select("path", "depth")
