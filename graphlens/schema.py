"""Schemas of nodes, edges and side tables, and the fixed values they may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of nodes, edges and languages.
NODE_TYPES = ("Repository", "Package", "File", "Class", "Function", "Variable", "Interface", "Test", "Config")
EDGE_TYPES = ("CONTAINS", "IMPORTS", "DEFINES", "CALLS", "CALLS_RUNTIME", "INHERITS", "IMPLEMENTS", "DEPENDS_ON", "TESTS", "USES", "REFERENCES")

STRUCTURAL = "struct<name:string,file:string,signature:string,start_line:int,end_line:int,complexity:int,lines:int,parameters:int>"
SEMANTIC = (
    "struct<status:string,docstring:string,description:string,inline_comments:array<struct<line:int,text:string>>,decorators:array<string>,"
    "annotations:struct<params:map<string,string>,returns:string,throws:array<string>>,tags:array<string>,score:double,manually_set:boolean,source_hash:string,enriched_at:string>"
)
NODES = f"id string, type string, file_path string, seq bigint, structural {STRUCTURAL}, semantic {SEMANTIC}"
EDGES = "source_id string, target_id string, type string, metadata map<string,string>, seq bigint"
VECTORS = "id string, embedding array<float>, metadata map<string,string>, document string, seq bigint, deleted boolean"
CHANGES = "seq bigint, rtype string, key string, tx_id bigint, payload string"
AUDIT = "ts timestamp, event string, session_id string, detail map<string,string>"
SESSIONS = "session_id string, agent_id string, task string, scope array<string>, mode string, status string, started_at timestamp"
LOCKS = "file_path string, session_id string, acquired_at timestamp, expires_at timestamp, fencing_token bigint"


def node_type(name: str) -> str | None:
    """The node type of that name in any case, or None."""
    return next((t for t in NODE_TYPES if t.lower() == name.lower()), None)


def edge_type(name: str) -> str | None:
    """The edge type of that name in any case, or None."""
    return next((t for t in EDGE_TYPES if t.lower() == name.lower()), None)


def make_nodes(flat: DataFrame) -> DataFrame:
    """Nodes from a flat frame; absent columns take defaults, null strings become ''."""
    have = set(flat.columns)
    text = lambda c, d="": F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in have else F.lit(d)
    number = lambda c, d=0: F.coalesce(F.col(c).cast("int"), F.lit(d)) if c in have else F.lit(d).cast("int")
    null = lambda k: F.lit(None).cast(k)
    given = lambda c, k: F.col(c).cast(k) if c in have else null(k)
    array = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    structural = F.struct(text("name").alias("name"), text("file_path").alias("file"), text("signature").alias("signature"), number("start_line").alias("start_line"), number("end_line").alias("end_line"), number("complexity").alias("complexity"), number("lines").alias("lines"), number("parameters").alias("parameters"))
    comments = "array<struct<line:int,text:string>>"
    semantic = F.struct(
        text("status", "no_metadata").alias("status"),
        text("docstring").alias("docstring"),
        given("description", "string").alias("description"),
        (F.coalesce(F.col("inline_comments"), F.array().cast(comments)) if "inline_comments" in have else F.array().cast(comments)).alias("inline_comments"),
        array("decorators").alias("decorators"),
        given("annotations", "struct<params:map<string,string>,returns:string,throws:array<string>>").alias("annotations"),
        array("tags").alias("tags"),
        (F.coalesce(F.col("score"), F.lit(0.0)) if "score" in have else F.lit(0.0)).alias("score"),
        (F.coalesce(F.col("manually_set"), F.lit(False)) if "manually_set" in have else F.lit(False)).alias("manually_set"),
        text("source_hash").alias("source_hash"),
        text("enriched_at").alias("enriched_at"),
    )
    seq = F.col("seq").cast("bigint") if "seq" in have else F.monotonically_increasing_id()
    return flat.select(F.col("id"), text("type", "Function").alias("type"), text("file_path").alias("file_path"), seq.alias("seq"), structural.alias("structural"), semantic.alias("semantic"))


def make_edges(flat: DataFrame) -> DataFrame:
    """Edges from a flat frame (source_id, target_id, type[, metadata, seq])."""
    meta = F.col("metadata") if "metadata" in flat.columns else F.lit(None).cast("map<string,string>")
    seq = F.col("seq").cast("bigint") if "seq" in flat.columns else F.monotonically_increasing_id()
    return flat.select("source_id", "target_id", "type", meta.alias("metadata"), seq.alias("seq"))


def flat_node() -> list:
    """The rich projection of a node."""
    s, m = "structural.", "semantic."
    return ["id", "type", "file_path", F.col(s + "name").alias("name"), F.col(s + "signature").alias("signature"), F.col(s + "start_line").alias("start_line"), F.col(s + "end_line").alias("end_line"), F.col(s + "complexity").alias("complexity"), F.col(s + "lines").alias("lines"), F.struct(*[F.col(m + c) for c in ("status", "docstring", "description", "decorators", "tags")]).alias("semantic")]
