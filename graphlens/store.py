"""A property graph as two DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens import schema
from graphlens.session import Staged, stage


class Graph:
    """``nodes`` and ``edges`` by ``schema.NODES`` and ``schema.EDGES``; every operator takes one.

    Results come in order of ``seq``, the order of insertion, where an order
    matters. Edges are a multiset: equal ones count as often as they occur.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, by_target: DataFrame | None = None):
        """``by_target``: the same edges where they are stored in the order of their targets."""
        self.nodes, self.edges, self.spark = nodes, edges, nodes.sparkSession
        self._stored, self._by_target = edges, by_target

    @property
    def stored(self) -> bool:
        """Whether the edges lie in tables of both orders, so that reading them for a few ends is cheap."""
        return self._by_target is not None and self.edges is self._stored

    @property
    def edges_by_target(self) -> DataFrame:
        return self._by_target if self.stored else self.edges

    @property
    def ids(self) -> DataFrame:
        """(id) of the nodes, for joins that only ask whether a node is there. Never broadcast: of the
        table's files Spark counts a small part for this column (9 of 125 MB for 11 million ids), which is below its threshold."""
        return self.nodes.select("id").hint("merge")

    @classmethod
    def from_flat(cls, nodes: DataFrame, edges: DataFrame) -> Graph:
        """Rows without ``seq`` are numbered once and written, so that the order of insertion is the same in every plan."""
        rows = [df if "seq" in df.columns else stage(df.withColumn("seq", F.monotonically_increasing_id()), "inserted") for df in (nodes, edges)]
        return cls(schema.make_nodes(rows[0]), schema.make_edges(rows[1]))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        read = lambda kind, name: spark.read.schema(kind).parquet(f"{path}/{name}")
        return cls(read(schema.NODES, "nodes"), read(schema.EDGES, "edges"), read(schema.EDGES, "edges_by_target"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Nodes in ranges of the id; edges once in ranges of (type, source), once of (type, target).

        A file then holds a narrow range, and its statistics let a lookup from
        either end leave out the others.
        """
        self.nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(f"{path}/nodes")
        edges = Staged(self.edges, "edges")
        for name, end in (("edges", "source_id"), ("edges_by_target", "target_id")):
            # seq splits an end that holds a large part of the edges
            edges.df.repartitionByRange("type", end, "seq").sortWithinPartitions("type", end).write.mode(mode).parquet(f"{path}/{name}")
        edges.drop()

    def register(self, prefix: str = "") -> None:
        """Temp views ``nodes`` and ``edges``, for SQL of any kind."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")

    # lookups
    def get_node(self, id_: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == id_)

    def find_nodes(self, type_: str = "", file_path: str = "", name: str = "") -> DataFrame:
        """Nodes that meet every given condition; '' or None is no condition."""
        out = self.nodes
        for column, value in ((F.col("type"), type_), (F.col("file_path"), file_path), (F.col("structural.name"), name)):
            if value:
                out = out.filter(column == value)
        return out

    def in_scope(self, scope: str = "full") -> DataFrame:
        """Nodes of a scope: 'full', 'package:<path>' or 'file:<path>'; any other text is a path prefix."""
        kind, _, path = scope.partition(":")
        if scope in ("", "full"):
            return self.nodes
        if kind == "file":
            return self.nodes.filter(F.col("file_path") == path)
        prefix = path.rstrip("/") + "/" if kind == "package" else scope
        return self.nodes.filter(F.col("file_path").startswith(prefix))

    def typed(self, types: list[str] | None, direction: str = "outgoing") -> DataFrame:
        """Edges of the given types; all where none are given. ``incoming``: read in order of the targets where that is stored."""
        edges = self.edges_by_target if direction == "incoming" else self.edges
        return edges.filter(F.col("type").isin(*types)) if types else edges

    def get_edges(self, id_: str, type_: str = "", direction: str = "both") -> DataFrame:
        """Outgoing, then incoming edges of a node, tagged with ``side``; a loop comes twice under both; an unknown direction gives none."""
        types = [type_] if type_ else None
        out = self.typed(types).filter(F.col("source_id") == id_).withColumn("side", F.lit("outgoing"))
        into = self.typed(types, "incoming").filter(F.col("target_id") == id_).withColumn("side", F.lit("incoming"))
        return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}.get(direction, out.limit(0))

    def ends(self, types: list[str] | None = None, direction: str = "outgoing") -> DataFrame:
        """(here, there, seq, type): edges as steps. ``either`` gives both ways."""
        out = self.typed(types).select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "seq", "type")
        into = self.typed(types, "incoming").select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "seq", "type")
        return out.unionByName(into) if direction == "either" else into if direction == "incoming" else out

    def count_nodes(self) -> DataFrame:
        return self.nodes.agg(F.count("*").alias("nodes"))

    def count_edges(self) -> DataFrame:
        return self.edges.agg(F.count("*").alias("edges"))

    # writes; each gives a new graph, the old one stays as it is
    def upsert_nodes(self, nodes: DataFrame) -> Graph:
        """Nodes (``schema.NODES``) put in; of rows with one id the last by ``seq`` counts, and a known id keeps its place.

        Rows without id are left out. ``seq`` of the given rows tells their
        order among themselves; new ids come behind all that are there.
        """
        given = nodes.filter("id IS NOT NULL")
        last = given.groupBy("id").agg(F.max_by(F.struct(*[c for c in given.columns if c != "id"]), "seq").alias("r"), F.min("seq").alias("first"))
        behind = self.nodes.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top")).first().top + 1
        old = self.nodes.select("id", F.col("seq").alias("place"))
        put = last.join(old, "id", "left").select("id", "r.type", "r.file_path", F.coalesce("place", F.col("first") + F.lit(behind)).alias("seq"), "r.structural", "r.semantic")
        kept = self.nodes.join(last.select("id"), "id", "left_anti")
        return Graph(kept.select(*self.nodes.columns).unionByName(put), self.edges)

    def upsert_edges(self, edges: DataFrame) -> Graph:
        """Edges appended behind those there: a multiset keeps equal ones. Rows without an end are left out."""
        behind = self.edges.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top")).first().top + 1
        more = edges.filter("source_id IS NOT NULL AND target_id IS NOT NULL").withColumn("seq", F.col("seq") + F.lit(behind))
        return Graph(self.nodes, self.edges.unionByName(more.select(*self.edges.columns)))

    def delete_nodes(self, ids: DataFrame) -> Graph:
        """Without the nodes of the given ids (id) and the edges at them; ids of no node take no edges away."""
        gone = self.nodes.select("id").join(ids.select("id").distinct(), "id", "left_semi").distinct()
        kept = self.nodes.join(gone, "id", "left_anti").select(*self.nodes.columns)
        edges = self.edges
        for end in ("source_id", "target_id"):
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*self.edges.columns)
        return Graph(kept, edges)

    def delete_by_file(self, files: DataFrame) -> Graph:
        """Without the nodes of the given files (file_path), and their edges."""
        return self.delete_nodes(self.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi").select("id"))

    def clear(self) -> Graph:
        return Graph(self.nodes.limit(0), self.edges.limit(0))

    # resolution of what a caller means by an entity
    def resolve(self, query: str, how: str = "navigate") -> str | None:
        """The id meant by a text, or None: the first node by (rule, seq).

        Rules: an exact id; then, if it looks like a path, nodes of that file,
        else nodes of that name; for ``navigate`` then any id that holds the
        text; for ``name`` no rule but id and name.
        """
        nodes = self.nodes.select("id", "file_path", F.col("structural.name").alias("name"), "seq")
        path_like = how != "name" and ("/" in query or query.endswith(".py"))
        by: Column = F.when(F.col("id") == query, 0).when((F.col("file_path") if path_like else F.col("name")) == query, 1)
        if how == "navigate":
            by = by.when(F.col("id").contains(query), 2)
        best = nodes.withColumn("by", by).filter("by IS NOT NULL").orderBy("by", "seq").limit(1).collect()
        return best[0].id if best else None

    def resolve_target(self, entity: str) -> str | None:
        """The id meant by 'file:type:name', 'kind:name', an id, a name or a part of an id; exact file and name before a file that holds the text."""
        file, name = None, entity
        parts = entity.rsplit(":", 2)
        # fixed values: prefixes of an entity text
        if len(parts) == 3:
            file, _, name = parts
        elif len(parts) == 2 and parts[0] in ("fn", "func", "function", "class", "struct", "file"):
            name = parts[1]
        n, f = F.col("structural.name"), F.col("file_path")
        by = F.when(F.col("id") == entity, 0)
        if file:
            by = by.when((f == file) & (n == name), 1).when((n == name) & f.contains(file), 2)
        by = by.when(n == name, 3).when(F.col("id").contains(entity), 4)
        best = self.nodes.select("id", "seq", by.alias("by")).filter("by IS NOT NULL").orderBy("by", "seq").limit(1).collect()
        return best[0].id if best else None
