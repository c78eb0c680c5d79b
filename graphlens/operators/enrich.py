"""Annotations on nodes: enrich, annotate, tag, coverage and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions import scalar

STALE = ("no_metadata", "stale")


def _status() -> Column:
    return F.coalesce(F.nullif(F.col("semantic.status"), F.lit("")), F.lit("no_metadata"))


def enrich(nodes: DataFrame, at: str, ids: DataFrame | None = None, force: bool = False, only_stale: bool = False) -> DataFrame:
    """Nodes with status ``enriched`` and the time set, where asked for; those enriched already stay as they are unless forced."""
    wanted = F.lit(True) if force else _status() != "enriched"
    if only_stale:
        wanted = wanted & _status().isin(*STALE)
    out = nodes
    if ids is not None:
        out = out.join(ids.select("id", F.lit(True).alias("_asked")).distinct(), "id", "left")
        wanted = wanted & F.coalesce("_asked", F.lit(False))
    done = F.col("semantic").withField("status", F.lit("enriched")).withField("enriched_at", F.lit(at))
    return out.withColumn("semantic", F.when(wanted, done).otherwise(F.col("semantic"))).drop("_asked").select(*nodes.columns)


def status_counts(nodes: DataFrame) -> DataFrame:
    """(status, n); an empty status counts as no_metadata."""
    return nodes.groupBy(_status().alias("status")).agg(F.count("*").alias("n"))


def coverage(nodes: DataFrame, by: str = "type") -> DataFrame:
    """(by, nodes, enriched, described, documented, share): how much is enriched, per type or file."""
    said = lambda c: F.sum((F.coalesce(F.col(c), F.lit("")) != "").cast("int"))
    out = nodes.groupBy(by).agg(F.count("*").alias("nodes"), F.sum((_status() == "enriched").cast("int")).alias("enriched"), said("semantic.description").alias("described"), said("semantic.docstring").alias("documented"))
    return out.withColumn("share", F.col("enriched") / F.col("nodes"))


def annotate(nodes: DataFrame, notes: DataFrame, force: bool = True) -> DataFrame:
    """Nodes with annotations (id, description, tags[, seq]) put in, in order of seq.

    Tags are joined; the last description that is not '' counts; the node is
    marked as set by hand. Without ``force`` nodes set by hand stay as they are.
    """
    if "seq" not in notes.columns:
        notes = notes.withColumn("seq", F.lit(0))
    each = notes.select("id", "seq", F.nullif(F.coalesce("description", F.lit("")), F.lit("")).alias("d"), F.coalesce("tags", F.array().cast("array<string>")).alias("t"))
    tags = each.select("id", F.posexplode("t").alias("at", "tag"), "seq").groupBy("id", "tag").agg(F.min(F.struct("seq", "at")).alias("o")).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "tag"))), lambda x: x.tag).alias("_tags"))
    said = each.groupBy("id").agg(F.max_by("d", F.when(F.col("d").isNotNull(), F.col("seq"))).alias("_description"))
    joined = nodes.join(said.join(tags, "id", "left").withColumn("_noted", F.lit(True)), "id", "left")
    s = F.col("semantic")
    new = s.withField("tags", scalar.add_tags(F.col("semantic.tags"), F.coalesce("_tags", F.array().cast("array<string>")))).withField("description", F.coalesce("_description", "semantic.description")).withField("manually_set", F.lit(True))
    wanted = F.coalesce("_noted", F.lit(False)) & (F.lit(force) | ~F.coalesce("semantic.manually_set", F.lit(False)))
    return joined.withColumn("semantic", F.when(wanted, new).otherwise(s)).select(*nodes.columns)


def tag(nodes: DataFrame, tags: list[str], action: str = "add", where: Column | None = None) -> DataFrame:
    """Nodes with tags added, removed or set, where a condition holds; another action changes nothing."""
    given = F.array(*[F.lit(t) for t in tags]) if tags else F.array().cast("array<string>")
    old = F.col("semantic.tags")
    new = {"add": scalar.add_tags(old, given), "remove": scalar.remove_tags(old, given), "set": F.array_distinct(given)}.get(action, old)
    tagged = F.col("semantic").withField("tags", new)
    return nodes.withColumn("semantic", tagged if where is None else F.when(where, tagged).otherwise(F.col("semantic")))


def stale(nodes: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, file_path): nodes whose kept hash differs from their file's current one (file_path, content_hash)."""
    kept = F.col("semantic.source_hash")
    return nodes.filter(kept != "").join(hashes, "file_path").filter(kept != F.col("content_hash")).select("id", "file_path")


def latest_per_key(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row per key, that of the highest version; ties to the greatest row."""
    order = Window.partitionBy(*key).orderBy(F.desc(version), *[F.desc(c) for c in rows.columns if c not in (*key, version)])
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
