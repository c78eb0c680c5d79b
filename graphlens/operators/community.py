"""Communities: connected components, their bridges and how they are coupled; label propagation as a finer cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens import schema
from graphlens.session import Staged, stage
from graphlens.store import Graph


def components(graph: Graph, types: list[str] | None = None) -> DataFrame:
    """(id, community): connected components of the undirected graph; a community is named by its least id.

    Unknown edge types are passed over; if none is left all count. Ends that
    are no nodes belong as well. Alternating large-star and small-star joins:
    a number of rounds logarithmic in the size, no group is collected.
    """
    given = [t for t in types or [] if t in schema.EDGE_TYPES]
    edges = graph.typed(given).select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    everyone = graph.nodes.select("id").unionByName(edges.select(F.col("u").alias("id"))).unionByName(edges.select(F.col("v").alias("id"))).distinct()
    pairs = Staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    while True:
        both = pairs.df.unionByName(pairs.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour to the least one
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(large, "large")
        # small star: every smaller neighbour, and the node itself, to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        nxt = Staged(nxt, "pairs")
        same = nxt.df.count() == pairs.df.count() and nxt.df.join(pairs.df, ["u", "v"], "left_anti").isEmpty()
        pairs = nxt
        if same:
            break
    return everyone.join(pairs.df.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").select("id", F.coalesce("c", "id").alias("community"))


def sizes(members: DataFrame) -> DataFrame:
    """(community, size), largest first."""
    return members.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community")


def bridges(graph: Graph, members: DataFrame) -> DataFrame:
    """(community, source_id, target_id, type): edges that leave a community; equal edges come as often as they are there."""
    m = members.select("id", "community")
    out = graph.edges.join(m.withColumnRenamed("id", "source_id"), "source_id").join(m.select(F.col("id").alias("target_id"), F.col("community").alias("to")), "target_id", "left")
    return out.filter("to IS NULL OR to <> community").select("community", "source_id", "target_id", "type")


def boundaries(graph: Graph, members: DataFrame, min_coupling: float = 0.0, examples: int = 3) -> DataFrame:
    """(from_community, to_community, edge_count, coupling, examples): crossing edges over all edges out of the first community."""
    a = members.select(F.col("id").alias("source_id"), F.col("community").alias("from_community"))
    b = members.select(F.col("id").alias("target_id"), F.col("community").alias("to_community"))
    out = graph.edges.join(a, "source_id")
    total = out.groupBy("from_community").agg(F.count("*").alias("total"))
    cross = out.join(b, "target_id").filter("from_community <> to_community")
    counts = cross.groupBy("from_community", "to_community").agg(F.count("*").alias("edge_count"))
    place = Window.partitionBy("from_community", "to_community").orderBy("seq", "source_id", "target_id")
    few = cross.withColumn("n", F.row_number().over(place)).filter(F.col("n") <= examples)
    shown = few.groupBy("from_community", "to_community").agg(F.array_sort(F.collect_list(F.struct("n", "source_id", "target_id", "type"))).alias("examples"))
    ratio = F.col("edge_count") / F.col("total")
    rows = counts.join(total, "from_community").filter(ratio >= min_coupling).join(shown, ["from_community", "to_community"])
    return rows.select("from_community", "to_community", "edge_count", F.round(ratio, 4).alias("coupling"), "examples").orderBy(F.desc("coupling"), "from_community", "to_community")


def label_propagation(graph: Graph, rounds: int = 5, types: list[str] | None = None) -> DataFrame:
    """(id, community): each node takes the label most frequent among its neighbours, ties to the least, ``rounds`` times.

    A stand-in for modularity-based communities, and named as what it is.
    """
    ends = stage(graph.ends(types, "either").filter("here <> there").groupBy("here", "there").agg(F.count("*").alias("w")), "ends")
    labels = Staged(graph.nodes.select("id", F.col("id").alias("community")), "labels")
    for _ in range(rounds):
        votes = ends.join(labels.df.withColumnRenamed("id", "there"), "there").groupBy("here", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy(F.col("here").alias("id")).agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("b")).select("id", F.col("b.community").alias("new"))
        nxt = Staged(labels.df.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community")), "labels")
        labels.drop()
        labels = nxt
    return labels.df
