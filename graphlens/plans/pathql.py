"""A small language for paths in the graph, compiled to joins.

    query  := node ( edge node )*
    node   := (IDENT | '*' | STRING) ( '[' [ filter (',' filter)* ] ']' )?
    filter := IDENT ('=' | '!=' | '=~') (STRING | IDENT | NUMBER)
    edge   := arrow? (IDENT '+'?)? arrow?      at least one part; two arrows must be alike
    arrow  := '->' | '<-' | '<->'

A node given as a string is an exact name. Behind a leading arrow a word is an
edge type only if another arrow follows it; else it is the next node, so
``Class -> Function`` is a hop over edges of any type. ``+`` follows edges of
the type over any number of steps; nodes on the way need not match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens import schema
from graphlens.operators.order import first
from graphlens.session import stage
from graphlens.store import Graph


class PathError(ValueError):
    """A path expression that cannot be read or compiled."""


@dataclass
class Filter:
    field: str
    operator: str
    value: str


@dataclass
class Node:
    type: str | None = None
    name: str | None = None
    filters: list[Filter] = field(default_factory=list)


@dataclass
class Edge:
    type: str | None
    direction: str
    transitive: bool = False


@dataclass
class Path:
    start: Node
    hops: list[tuple[Edge, Node]]


@dataclass
class Result:
    """``nodes`` (id), ``edges`` (source_id, target_id, type), a one-row frame of counts, and the hops (from 1) that ``max_results`` cut."""

    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame
    cut: list[int] = field(default_factory=list)


_TOKEN = re.compile(r"""\s*(?:(?P<arrow><->|->|<-)|(?P<op>=~|!=|=)|(?P<punct>[\[\],*+])|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<number>\d+(?:\.\d+)?)|(?P<ident>[A-Za-z_][\w]*))""")


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PathError(f"cannot read {text[at:at + 10]!r} at {at}")
        kind = m.lastgroup
        value = m.group(kind)
        if kind == "string":
            value = re.sub(r"\\(.)", r"\1", value[1:-1])
        out.append((kind, value))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.all, self.at = tokens(text), 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.all[self.at + k] if self.at + k < len(self.all) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        self.at += 1
        return t

    def take(self, value: str) -> bool:
        kind, v = self.peek()
        if kind in ("punct", "op", "arrow") and v == value:
            self.at += 1
            return True
        return False

    def node(self) -> Node:
        kind, value = self.next()
        if kind == "string":
            out = Node(name=value)
        elif kind == "ident":
            out = Node(type=value)
        elif (kind, value) == ("punct", "*"):
            out = Node()
        else:
            raise PathError(f"expected a node, found {value or 'the end'}")
        if self.take("["):
            while not self.take("]"):
                out.filters.append(self.filter())
                if not self.take(",") and self.peek() != ("punct", "]"):
                    raise PathError("expected , or ] in a filter")
        return out

    def filter(self) -> Filter:
        kind, name = self.next()
        if kind != "ident":
            raise PathError(f"expected a field, found {name or 'the end'}")
        kind, operator = self.next()
        if kind != "op":
            raise PathError(f"expected =, != or =~, found {operator or 'the end'}")
        kind, value = self.next()
        if kind not in ("string", "ident", "number"):
            raise PathError(f"expected a value, found {value or 'the end'}")
        return Filter(name, operator, value)

    def edge(self) -> Edge:
        first = self.next()[1] if self.peek()[0] == "arrow" else None
        type_, plus = None, False
        if self.peek()[0] == "ident":
            k = 2 if self.peek(1) == ("punct", "+") else 1
            if first is None or self.peek(k)[0] == "arrow":
                type_ = self.next()[1]
                plus = self.take("+")
        last = self.next()[1] if self.peek()[0] == "arrow" else None
        if first is None and last is None and type_ is None:
            raise PathError(f"expected an edge, found {self.peek()[1] or 'the end'}")
        if first and last and first != last:
            raise PathError(f"arrows disagree: {first} and {last}")
        arrow = first or last or "->"
        return Edge(type_, {"->": "outgoing", "<-": "incoming", "<->": "either"}[arrow], plus)


def parse(text: str) -> Path:
    r = _Reader(text)
    if not r.all:
        raise PathError("an empty path")
    start, hops = r.node(), []
    while r.peek()[0] != "end":
        edge = r.edge()
        hops.append((edge, r.node()))
    return Path(start, hops)


FIELDS = {
    "id": "id", "type": "type", "file_path": "file_path", "name": "structural.name", "signature": "structural.signature", "start_line": "structural.start_line",
    "end_line": "structural.end_line", "docstring": "semantic.docstring", "description": "semantic.description", "status": "semantic.status",
}


def condition(f: Filter) -> Column:
    """A filter as a column; an unknown field meets nothing, not even !=. Values are compared as text, null as ''."""
    if f.field not in FIELDS:
        return F.lit(False)
    c = F.coalesce(F.col(FIELDS[f.field]).cast("string"), F.lit(""))
    if f.operator == "=":
        return c == f.value
    if f.operator == "!=":
        return c != f.value
    try:
        pattern = re.compile(f.value)
    except re.error as e:
        raise PathError(f"not a regular expression: {f.value!r} ({e})") from e
    if re.search(r"\(\?P|\(\?\(|\\Z", f.value):  # what only Python's expressions know

        @F.pandas_udf("boolean")
        def matches(s):
            return s.map(lambda x: pattern.search(x) is not None)

        return matches(c)
    return c.rlike(f.value)


def _matching(nodes: DataFrame, node: Node, strict: bool) -> DataFrame:
    out = nodes
    if node.name is not None:
        out = out.filter(F.col("structural.name") == node.name)
    if node.type is not None:
        known = schema.node_type(node.type)
        if known is None and strict:
            raise PathError(f"unknown node type {node.type}")
        out = out.filter(F.col("type") == known) if known else out.filter(F.lit(False))
    for f in node.filters:
        out = out.filter(condition(f))
    return out


def run(graph: Graph, text: str, max_results: int | None = None) -> Result:
    """Compile and prepare a path. Unknown start and edge types are errors, an unknown target type matches nothing.

    ``nodes`` holds the starts and the matches of every hop; ``edges`` each
    edge once, those walked under + included. By default every hop hands on all
    its nodes. ``max_results`` is a feature of its own: it bounds the nodes a
    hop hands on, in order of insertion, and ``Result.cut`` names the hops
    where it left some out.
    """
    path = parse(text)
    nodes = graph.nodes
    current = _matching(nodes, path.start, True).select("id", "seq")
    current = stage(current.select("id"), "starts")
    all_nodes, all_edges, cut = [current], [], []
    walked = None
    for hop, (edge, node) in enumerate(path.hops, 1):
        types = None
        if edge.type is not None:
            known = schema.edge_type(edge.type)
            if known is None:
                raise PathError(f"unknown edge type {edge.type}")
            types = [known]
        wanted = _matching(nodes, node, False).select(F.col("id").alias("there"), F.col("seq").alias("_order"))
        out = graph.typed(types).select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), "source_id", "target_id", "type")
        into = graph.typed(types).select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), "source_id", "target_id", "type")
        steps = {"outgoing": out, "incoming": into}.get(edge.direction)
        steps = out.unionByName(into) if steps is None else steps
        if edge.transitive:
            from graphlens.operators.traverse import reachable

            near = stage(reachable(graph, current, types, edge.direction), "closure")
            ends = near.withColumnRenamed("id", "there").hint("merge").join(wanted, "there")
            bases = current.unionByName(near).distinct().withColumnRenamed("id", "here")
            walked = steps.join(bases.hint("merge"), "here").join(graph.ids.withColumnRenamed("id", "there"), "there", "left_semi")
        else:
            walked = current.withColumnRenamed("id", "here").join(steps, "here").join(wanted, "there")
            ends = walked.select("there", "_order").distinct()
        all_edges.append(walked.select("source_id", "target_id", "type"))
        matched = ends.groupBy("there").agg(F.min("_order").alias("_order"))
        if max_results is not None:
            matched = stage(matched, "matched")
            if matched.count() > max_results:
                cut.append(hop)
                matched = first(matched, max_results, ["_order", "there"])
        current = stage(matched.select(F.col("there").alias("id")), "hop")
        all_nodes.append(current)
    found = all_nodes[0]
    for more in all_nodes[1:]:
        found = found.unionByName(more)
    found = found.distinct()
    empty = graph.edges.select("source_id", "target_id", "type").limit(0)
    edges = empty
    for more in all_edges:
        edges = edges.unionByName(more)
    edges = edges.distinct()
    one = lambda df, k: df.select(F.lit(k).alias("k"))
    count = lambda k: F.sum((F.col("k") == k).cast("bigint"))
    rows = one(found, 0).unionByName(one(edges, 1)).unionByName(one(current, 2))
    counts = rows.agg(*[F.coalesce(count(k), F.lit(0)).alias(name) for k, name in enumerate(("matched_nodes", "matched_edges", "terminal_nodes"))]).withColumn("hops", F.lit(len(path.hops)))
    return Result(found, edges, counts, cut)
