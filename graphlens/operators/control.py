"""Sessions, locks, checkpoints and reviews as tables. Each function takes and gives DataFrames; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions import scalar
from graphlens.store import Graph


def latest_sessions(events: DataFrame) -> DataFrame:
    """(session_id, agent_id, task, scope, mode, status, started_at): the last state of each session from its events (…, ts)."""
    fields = ("agent_id", "task", "scope", "mode", "status")
    last = events.groupBy("session_id").agg(F.max_by(F.struct(*fields), "ts").alias("r"), F.min("ts").alias("started_at"))
    return last.select("session_id", "r.*", "started_at")


def open_session(events: DataFrame, session_id: str, agent_id: str, task: str, scope: list[str], mode: str, at) -> DataFrame:
    """Session events with an opening; a session that is open already is not opened again."""
    now = latest_sessions(events)
    if not now.filter((F.col("session_id") == session_id) & (F.col("status") == "open")).isEmpty():
        return events
    row = events.sparkSession.createDataFrame([(session_id, agent_id, task, scope, mode, "open", at)], events.schema)
    return events.unionByName(row)


def close_session(events: DataFrame, session_id: str, at, status: str = "closed") -> DataFrame:
    """Session events with a closing; a session that is not open stays as it is."""
    last = latest_sessions(events).filter((F.col("session_id") == session_id) & (F.col("status") == "open"))
    row = last.select("session_id", "agent_id", "task", "scope", "mode", F.lit(status).alias("status"), F.lit(at).alias("ts"))
    return events.unionByName(row.select(*[F.col(c).cast(events.schema[c].dataType).alias(c) for c in events.columns]))


def recover_sessions(events: DataFrame, locks: DataFrame, now) -> DataFrame:
    """(session_id, agent_id, task, scope, mode, started_at, files): open sessions with the files they still hold."""
    held = live_locks(locks, latest_sessions(events), now).groupBy("session_id").agg(F.sort_array(F.collect_set("file_path")).alias("files"))
    rows = latest_sessions(events).filter("status = 'open'").join(held, "session_id", "left")
    return rows.select("session_id", "agent_id", "task", "scope", "mode", "started_at", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def dry_run(graph: Graph, proposed: DataFrame, locks: DataFrame) -> DataFrame:
    """(id, change, verdict): what a proposed parse of some files (id, file_path, ...) would add, change or remove, and the guard's word on it.

    A node that only comes in is allowed unless its file is locked.
    """
    files = proposed.select("file_path").distinct()
    now = graph.nodes.join(files, "file_path", "left_semi").select("id", F.col("file_path").alias("f"), F.col("structural.signature").alias("was"))
    then = proposed.select("id", F.col("file_path").alias("g"), F.col("signature").alias("is"))
    both = now.join(then, "id", "full_outer")
    change = F.when(F.col("f").isNull(), "added").when(F.col("g").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    rows = both.select("id", F.coalesce("f", "g").alias("file_path"), change.alias("change")).filter("change IS NOT NULL")
    word = guard(rows.filter("change <> 'added'").select("id"), graph, locks)
    held = locks.select("file_path", F.lit(True).alias("held")).distinct()
    return rows.join(word, "id", "left").join(held, "file_path", "left").select("id", "change", F.coalesce("verdict", F.when(F.col("held"), "block").otherwise("allow")).alias("verdict"))


def live_locks(locks: DataFrame, sessions: DataFrame, now) -> DataFrame:
    """Locks that still hold: not expired, of an open session, the highest fencing token of each file."""
    best = locks.groupBy("file_path").agg(F.max_by(F.struct("session_id", "acquired_at", "expires_at", "fencing_token"), "fencing_token").alias("r")).select("file_path", "r.*")
    return best.filter(F.col("expires_at") > F.lit(now)).join(sessions.filter("status = 'open'").select("session_id"), "session_id", "left_semi")


def stale_locks(locks: DataFrame, now) -> DataFrame:
    """Locks whose ISO time of expiry has passed; text that is no time never is."""
    return locks.filter(scalar.stale_lease(F.col("expires_at").cast("string"), F.lit(now).cast("timestamp")))


def checkpoint(graph: Graph, files: DataFrame) -> DataFrame:
    """(file_path, id, fingerprint): what the nodes of some files look like now."""
    n = graph.nodes.join(files.select("file_path").distinct(), "file_path", "left_semi")
    mark = F.concat_ws("::", "file_path", "type", "structural.name", F.col("structural.start_line").cast("string"))
    return n.select("file_path", "id", mark.alias("fingerprint"))


def rollback_report(saved: DataFrame, graph: Graph) -> DataFrame:
    """(file_path, id, state): what differs from a checkpoint; nothing is restored."""
    now = checkpoint(graph, saved).select("file_path", "id", F.col("fingerprint").alias("now"))
    both = saved.join(now, ["file_path", "id"], "full_outer")
    state = F.when(F.col("fingerprint").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("fingerprint") != F.col("now"), "changed")
    return both.select("file_path", "id", state.alias("state")).filter("state IS NOT NULL")


def reviews(events: DataFrame) -> DataFrame:
    """(review_id, status, opened_at, comments): the last status of each review and its number of comments."""
    status = F.when(F.col("event") != "comment", F.col("event"))
    return events.groupBy("review_id").agg(F.max_by(status, F.when(status.isNotNull(), F.col("ts"))).alias("status"), F.min("ts").alias("opened_at"), F.sum((F.col("event") == "comment").cast("int")).alias("comments"))


def guard(targets: DataFrame, graph: Graph, locks: DataFrame) -> DataFrame:
    """(id, verdict): block where the file is locked, warn above five callers, else allow."""
    from graphlens.operators.explore import conflicts

    c = conflicts(graph, targets)
    where = graph.nodes.select("id", "file_path").join(locks.select("file_path", F.lit(True).alias("held")).distinct(), "file_path", "left")
    return c.join(where, "id").select("id", F.when(F.col("held"), "block").when(F.col("high_blast_radius"), "warn").otherwise("allow").alias("verdict"))
