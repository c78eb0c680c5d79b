"""Import, export, backup and restore of graphs."""

from __future__ import annotations

import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens import schema
from graphlens.session import _filesystem
from graphlens.store import Graph

_LOOSE_NODES = "id string, type string, file_path string, file string, name string, signature string, start_line int, end_line int, docstring string, structural struct<name:string,file:string,signature:string,start_line:int,end_line:int,complexity:int>"
_LOOSE_EDGES = "source_id string, target_id string, source string, target string, type string, metadata map<string,string>"


def read_json(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Loose JSON lines with an explicit schema; aliases are settled in ``load``."""
    return spark.read.schema(_LOOSE_NODES).json(nodes), spark.read.schema(_LOOSE_EDGES).json(edges)


def load(nodes: DataFrame, edges: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, skipped): loose rows to a graph; skipped (kind, n) counts rows without id or ends, or of an unknown type.

    ``file`` stands for file_path, ``source`` and ``target`` for the ends of
    an edge; types default to Function and CALLS and are taken in any case.
    """
    known = lambda c, default, all_: F.element_at(F.create_map(*[F.lit(x) for t in all_ for x in (t.lower(), t)]), F.lower(F.coalesce(F.col(c), F.lit(default))))
    has = set(nodes.columns)
    inner = lambda c, path: F.coalesce(*[F.col(x) for x in (c, path) if x.split(".")[0] in has])
    n = nodes.select("id", known("type", "Function", schema.NODE_TYPES).alias("type"), F.coalesce(*[F.col(c) for c in ("file_path", "file") if c in has], F.lit("")).alias("file_path"), *[inner(c, f"structural.{c}").alias(c) for c in ("name", "signature", "start_line", "end_line") if c in has or "structural" in has], *([F.col("docstring")] if "docstring" in has else []))
    have = set(edges.columns)
    end = lambda a, b: F.coalesce(*[F.col(c) for c in (a, b) if c in have])
    e = edges.select(end("source_id", "source").alias("source_id"), end("target_id", "target").alias("target_id"), known("type", "CALLS", schema.EDGE_TYPES).alias("type"), *([F.col("metadata")] if "metadata" in have else []))
    good_n, good_e = F.col("id").isNotNull() & (F.col("id") != "") & F.col("type").isNotNull(), F.col("source_id").isNotNull() & (F.col("source_id") != "") & F.col("target_id").isNotNull() & (F.col("target_id") != "") & F.col("type").isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    skipped = n.filter(~yes(good_n)).agg(F.lit("nodes").alias("kind"), F.count("*").alias("n")).unionByName(e.filter(~yes(good_e)).agg(F.lit("edges").alias("kind"), F.count("*").alias("n")))
    return Graph.from_flat(n.filter(good_n), e.filter(good_e)), skipped


def to_json(df: DataFrame) -> DataFrame:
    """(json): one JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def backup(graph: Graph, folder: str, label: str) -> str:
    """Write a snapshot beside others and make it the current one by one rename; its path."""
    path = f"{folder.rstrip('/')}/{label}"
    graph.save(path)
    point(graph.spark, folder, label)
    return path


def point(spark: SparkSession, folder: str, label: str) -> None:
    from graphlens.operators.incremental import StateStore

    StateStore(spark, folder).swap(label)


def restore(spark: SparkSession, folder: str, label: str | None = None) -> Graph:
    """The graph of a snapshot, the current one by default; with a label that snapshot becomes current, the others stay."""
    from graphlens.operators.incremental import StateStore

    if label is not None:
        fs, where = _filesystem(spark, f"{folder}/{label}/nodes")
        if not fs.exists(where):
            raise FileNotFoundError(label)
        point(spark, folder, label)
    current = StateStore(spark, folder).current()
    if current is None:
        raise FileNotFoundError(folder)
    return Graph.load(spark, f"{folder}/{current}")


def signed(graph: Graph, secret: str) -> DataFrame:
    """(root, nodes, edges, signature): the tree's hash and counts, with an HMAC-SHA-256 of them under a shared secret."""
    from graphlens.operators.sets import merkle

    root = merkle(graph.nodes).filter("path = '' AND depth = 0").select("hash", "nodes").first()
    edges = graph.edges.count()
    text = ":".join((root.hash if root else "", str(root.nodes if root else 0), str(edges)))
    mark = hmac.new(secret.encode(), text.encode(), "sha256").hexdigest()
    return graph.spark.createDataFrame([(root.hash if root else None, root.nodes if root else 0, edges, mark)], "root string, nodes bigint, edges bigint, signature string")


def verify(graph: Graph, signature: DataFrame, secret: str) -> bool:
    """Whether a graph is the one that was signed with the secret."""
    said, now = signature.first(), signed(graph, secret).first()
    return said is not None and hmac.compare_digest(said.signature, now.signature)
