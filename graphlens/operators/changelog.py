"""The change log: transactional replay, latest state, cascading deletes, compaction.

A log row is (seq, rtype, key, tx_id, payload). Types: NODE_UPSERT,
NODE_DELETE, FILE_DELETE, EDGE_UPSERT, CLEAR, BEGIN, COMMIT, ABORT and those
of sessions, locks, audit and parse status.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.operators.order import numbered
from graphlens.schema import CHANGES
from graphlens.session import _filesystem

# Types of records.
RECORDS = ("NODE_UPSERT", "NODE_DELETE", "FILE_DELETE", "EDGE_UPSERT", "CLEAR", "BEGIN", "COMMIT", "ABORT", "SESSION_UPSERT", "SESSION_DELETE", "LOCK", "UNLOCK", "AUDIT", "PARSE_STATUS")
CONTROL = ("BEGIN", "COMMIT", "ABORT")


def committed(log: DataFrame, span: int = 1_000_000) -> DataFrame:
    """Rows that take effect: outside a transaction at once, inside one if COMMIT ends it.

    ABORT, a second BEGIN or the end of the log drop what was begun. The log
    is cut into spans of seq, so a span is a task; the control rows before and
    behind a span come from a summary with one row per span.
    """
    part = F.floor(F.col("seq") / span).cast("bigint")
    rows = log.withColumn("_part", part)
    control = rows.filter(F.col("rtype").isin(*CONTROL)).select("_part", "seq", "rtype")
    summary = control.groupBy("_part").agg(F.min_by("rtype", "seq").alias("first"), F.max_by("rtype", "seq").alias("last"))
    every = rows.select("_part").distinct().join(summary, "_part", "left")
    order = Window.orderBy("_part")  # one row per span
    carried = every.select("_part", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.last("first", True).over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("behind"))
    inside = Window.partitionBy("_part").orderBy("seq")
    # what follows is what came last in the reversed order: a frame that only grows takes one pass
    backwards = Window.partitionBy("_part").orderBy(F.desc("seq"))
    mark = F.when(F.col("rtype").isin(*CONTROL), F.col("rtype"))
    seen = rows.withColumn("_last", F.last(mark, True).over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_next", F.last(mark, True).over(backwards.rowsBetween(Window.unboundedPreceding, -1)))
    joined = seen.join(carried, "_part")
    last, nxt = F.coalesce("_last", "before"), F.coalesce("_next", "behind")
    keep = ~F.col("rtype").isin(*CONTROL) & (F.coalesce(last != "BEGIN", F.lit(True)) | (nxt == "COMMIT"))
    return joined.filter(F.coalesce(keep, F.lit(False))).select(*log.columns)


def current(log: DataFrame, upsert: str, delete: str) -> DataFrame:
    """(key, first_seq, seq, payload): live keys with their last payload.

    ``first_seq`` is the first upsert behind the last delete or CLEAR: the
    place a key keeps while it is upserted again.
    """
    cleared = log.filter("rtype = 'CLEAR'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("s")).first().s
    rows = log.filter(F.col("rtype").isin(upsert, delete) & (F.col("seq") > cleared))
    gone = rows.filter(F.col("rtype") == delete).groupBy("key").agg(F.max("seq").alias("gone"))
    live = rows.filter(F.col("rtype") == upsert).join(gone, "key", "left").filter(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    return live.groupBy("key").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def live_edges(edges: DataFrame, deletes: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, type, seq) that no later delete of either end (key, seq) took away."""
    last = deletes.groupBy("key").agg(F.max("seq").alias("gone"))
    source, target = last.select(F.col("key").alias("source_id"), F.col("gone").alias("g1")), last.select(F.col("key").alias("target_id"), F.col("gone").alias("g2"))
    joined = edges.join(source, "source_id", "left").join(target, "target_id", "left")
    return joined.filter((F.col("g1").isNull() | (F.col("g1") < F.col("seq"))) & (F.col("g2").isNull() | (F.col("g2") < F.col("seq")))).select(*edges.columns)


def file_deletes(nodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """(key, seq): node deletes that file deletes stand for. ``nodes`` (key, file_path, seq) are upserts, ``deleted`` (file_path, seq).

    A file delete takes the nodes whose last upsert before it has that path.
    """
    span = Window.partitionBy("key").orderBy("seq")
    until = nodes.withColumn("until", F.coalesce(F.lead("seq").over(span), F.lit(2**62)))
    return until.join(deleted.withColumnRenamed("seq", "at"), "file_path").filter("at > seq AND at < until").select("key", F.col("at").alias("seq"))


def replay(log: DataFrame) -> dict[str, DataFrame]:
    """nodes (key, first_seq, seq, payload) and edges (source_id, target_id, type, seq) that a log leads to.

    Payloads are JSON: nodes with file_path, edges with source_id, target_id
    and type.
    """
    rows = committed(log)
    path = F.get_json_object("payload", "$.file_path")
    upserts = rows.filter("rtype = 'NODE_UPSERT'").select("key", path.alias("file_path"), "seq")
    by_file = file_deletes(upserts, rows.filter("rtype = 'FILE_DELETE'").select(F.col("key").alias("file_path"), "seq"))
    asked = rows.filter("rtype = 'NODE_DELETE'").select("key", "seq").unionByName(by_file)
    # a delete takes effect only on a node that is there: the row before it, of the same key, must be an upsert
    both = upserts.select("key", "seq", F.lit(True).alias("up")).unionByName(asked.withColumn("up", F.lit(False)))
    was_up = F.lag("up").over(Window.partitionBy("key").orderBy("seq", F.desc("up")))
    deletes = both.withColumn("was_up", was_up).filter("NOT up AND was_up").select("key", "seq")
    effective = deletes.withColumn("rtype", F.lit("NODE_DELETE")).withColumn("payload", F.lit(None).cast("string"))
    nodes = current(rows.filter("rtype IN ('NODE_UPSERT', 'CLEAR')").select("rtype", "key", "seq", "payload").unionByName(effective.select("rtype", "key", "seq", "payload")), "NODE_UPSERT", "NODE_DELETE")
    cleared = rows.filter("rtype = 'CLEAR'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("s")).first().s
    field = lambda c: F.get_json_object("payload", f"$.{c}").alias(c)
    edges = rows.filter((F.col("rtype") == "EDGE_UPSERT") & (F.col("seq") > cleared)).select(field("source_id"), field("target_id"), field("type"), "seq")
    return {"nodes": nodes, "edges": live_edges(edges, deletes)}


def compact(log: DataFrame) -> DataFrame:
    """A log with the same outcome: one upsert per live node, all live edges, numbered anew in order."""
    state = replay(log)
    n = state["nodes"].select(F.lit("NODE_UPSERT").alias("rtype"), "key", "payload", F.col("first_seq").alias("at"))
    e = state["edges"].select(F.lit("EDGE_UPSERT").alias("rtype"), F.concat_ws("|", "source_id", "type", "target_id").alias("key"), F.to_json(F.struct("source_id", "target_id", "type")).alias("payload"), F.col("seq").alias("at"))
    return n.unionByName(e).select(F.col("at").alias("seq"), "rtype", "key", F.lit(None).cast("bigint").alias("tx_id"), "payload")


class Journal:
    """An append-only log below ``path``: batches of records, each written whole or not at all.

    A batch is staged in a folder of its own and appears by one rename; its
    name holds the first number of its records, so numbers go on across
    batches. ``durable`` batches are read again before ``append`` returns.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[tuple[int, int, str]]:
        fs, where = _filesystem(self.spark, self.path)
        if not fs.exists(where):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(where)]
        return sorted((int(a), int(b), n) for n in names if n.startswith("batch-") for _, a, b in [n.split("-")])

    def read(self) -> DataFrame:
        """All records in ``schema.CHANGES``."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/{name}" for _, _, name in batches])

    def append(self, records: DataFrame, order: list[str], durable: bool = True) -> int:
        """Append records (rtype, key, tx_id, payload) in an order of theirs; the number of records of the log."""
        batches = self._batches()
        at = batches[-1][0] + batches[-1][1] if batches else 0
        rows = numbered(records, order, "seq", at).select("seq", "rtype", "key", F.col("tx_id").cast("bigint").alias("tx_id"), "payload")
        staged = f"{self.path}/.staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        n = self.spark.read.schema(CHANGES).parquet(staged).count()
        if n:
            fs, source = _filesystem(self.spark, staged)
            _, target = _filesystem(self.spark, f"{self.path}/batch-{at}-{n}")
            if not fs.rename(source, target):
                raise OSError(f"another batch begins at {at}")
            if durable and self.spark.read.schema(CHANGES).parquet(f"{self.path}/batch-{at}-{n}").count() != n:
                raise OSError(f"batch {at} is not whole")
        return at + n


def counts(log: DataFrame) -> DataFrame:
    """(rtype, n)."""
    return log.groupBy("rtype").agg(F.count("*").alias("n"))


def checksums(log: DataFrame) -> DataFrame:
    """(seq, crc): CRC-32 of each payload."""
    return log.select("seq", F.crc32(F.coalesce("payload", F.lit("")).cast("binary")).alias("crc"))
