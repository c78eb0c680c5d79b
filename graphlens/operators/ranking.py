"""Ranking over text and structure: BM25, PageRank, shared imports, routed location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.session import Staged, stage
from graphlens.store import Graph

#: The usual constants; the specification names none.
K1, B = 1.2, 0.75


def term_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): words of letters and digits, in lower case."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(key, words.alias("w")).withColumn("length", F.size("w"))
    return rows.select(key, "length", F.explode("w").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", top_k: int = 10, match: str = "any") -> DataFrame:
    """(key, score), best first, ties by key. Only texts with a query term are ever grouped; lengths and counts cover all texts."""
    terms = sorted({w for w in query.lower().split() if w})
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = docs.select(key, words.alias("w")).withColumn("length", F.size("w"))
    n, mean = rows.agg(F.count("*"), F.avg("length")).first()
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    hits = rows.select(key, "length", F.explode(F.filter("w", lambda w: F.array_contains(wanted, w))).alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))
    hits = stage(hits, "hits")
    df = {r.term: r.df for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}  # at most one row per query term
    idf = F.lit(0.0)
    import math

    for t, d in df.items():
        idf = F.when(F.col("term") == t, math.log(1 + (n - d + 0.5) / (d + 0.5))).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1))))
    scored = hits.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("met"))
    if match == "all":
        scored = scored.filter(F.col("met") == len(terms))
    return scored.orderBy(F.desc("score"), key).limit(top_k).select(key, "score")


def pagerank(graph: Graph, types: list[str] | None = None, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank): ranks sum to 1; what nodes without outgoing edges hold is spread over all."""
    edges = stage(graph.typed(types).select("source_id", "target_id").join(graph.ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(graph.ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"), "links")
    out = edges.groupBy("source_id").agg(F.count("*").alias("n"))
    links = stage(edges.join(out, "source_id"), "weighted")
    total = graph.nodes.count()
    if not total:
        return graph.spark.createDataFrame([], "id string, rank double")
    ranks = Staged(graph.nodes.select("id", F.lit(1.0 / total).alias("rank")), "ranks")
    for _ in range(rounds):
        held = ranks.df.withColumnRenamed("id", "source_id").hint("merge")  # a row for each node, as graph.ids
        given = links.join(held, "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        idle = 1.0 - (links.select("source_id").distinct().join(held, "source_id").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0])
        new = ranks.df.select("id").join(given.hint("merge"), "id", "left").select("id", (F.lit((1 - damping) / total + damping * idle / total) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        nxt = Staged(new, "ranks")
        ranks.drop()
        ranks = nxt
    return ranks.df


def shared_imports(graph: Graph, node_id: str, top_k: int = 10) -> DataFrame:
    """(id, shared): nodes that import most of what a node imports."""
    own = graph.edges.filter((F.col("type") == "IMPORTS") & (F.col("source_id") == node_id)).select("target_id").distinct()
    others = graph.edges.filter((F.col("type") == "IMPORTS") & (F.col("source_id") != node_id)).select("source_id", "target_id").distinct()
    return others.join(own, "target_id").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "id").limit(top_k)


def ranked_location(graph: Graph, similar: DataFrame, hops: int = 1, top_k: int = 10) -> DataFrame:
    """(id, score): 0.5 likeness + 0.3 PageRank over its maximum + 0.2 heat of 100, over what lies near the seeds (id, like)."""
    from graphlens.operators.telemetry import degrees
    from graphlens.operators.traverse import seed_walk

    near = seed_walk(graph, similar, hops)
    ranks = stage(pagerank(graph), "ranks")
    most = ranks.agg(F.max("rank")).first()[0] or 1.0
    heat = degrees(graph).select("id", F.least(F.col("degree"), F.lit(100)).alias("heat"))
    rows = near.join(similar.select("id", "like"), "id", "left").join(ranks, "id", "left").join(heat, "id", "left").fillna(0.0)
    score = 0.5 * F.col("like") + 0.3 * F.col("rank") / most + 0.2 * F.col("heat") / 100
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(top_k)
