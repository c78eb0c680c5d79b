"""Live behaviour as Structured Streaming: file events, debounce, reparse, leases, rate limits, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.sources.ingest import accepted

EVENTS = "path string, event_type string, ts timestamp, to_path string"
# Quiet time after an event, least lease, length of the rate window.
QUIET_SECONDS, LEAST_TTL, RATE_SECONDS = 0.5, 1, 60


def file_events(spark: SparkSession, folder: str, form: str = "json") -> DataFrame:
    """A stream of events from files that land in a folder."""
    return spark.readStream.schema(EVENTS).format(form).load(folder)


def normalise(events: DataFrame) -> DataFrame:
    """(path, event_type, ts): a move becomes a deletion and a creation; unknown events and extensions are left out."""
    moved = F.col("event_type") == "moved"
    rows = F.when(moved, F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("event_type")), F.struct(F.col("to_path").alias("path"), F.lit("created").alias("event_type")))).otherwise(F.array(F.struct(F.col("path").alias("path"), F.col("event_type").alias("event_type"))))
    out = events.select("ts", F.explode(rows).alias("e")).select("e.path", "e.event_type", "ts")
    return out.filter(F.col("event_type").isin("created", "modified", "deleted") & F.col("path").isNotNull() & accepted(F.col("path")))


def moments(seconds: list[float], utc: bool = False):
    """Seconds since the epoch as times of whole microseconds, as Arrow takes them."""
    return pd.to_datetime([round(s * 1e6) for s in seconds], unit="us", utc=utc).as_unit("us")


def debounced_times(times: list[float], last: float | None, quiet: float = QUIET_SECONDS) -> tuple[list[float], float | None]:
    """Of sorted times those at least ``quiet`` behind the last one kept."""
    kept = []
    for t in times:
        if last is None or t - last >= quiet:
            kept.append(t)
            last = t
    return kept, last


def debounce(events: DataFrame, quiet: float = QUIET_SECONDS) -> DataFrame:
    """Drops an event of the same path and kind that follows the last one kept too soon; state per (path, event_type)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = sorted(t.timestamp() for b in batches for t in b["ts"] if t is not pd.NaT)
        last = state.get[0] if state.exists else None
        kept, last = debounced_times(times, last, quiet)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"path": [key[0]] * len(kept), "event_type": [key[1]] * len(kept), "ts": moments(kept)})

    return events.groupBy("path", "event_type").applyInPandasWithState(step, "path string, event_type string, ts timestamp", "last double", "append", "NoTimeout")


def changes_only(events: DataFrame, status: DataFrame) -> DataFrame:
    """Events with content_hash whose file was last parsed with another hash; a stream against a static table."""
    kept = status.select(F.col("file_path").alias("path"), F.col("content_hash").alias("_kept"))
    return events.join(kept, "path", "left").filter((F.col("event_type") == "deleted") | ~F.col("content_hash").eqNullSafe(F.col("_kept"))).drop("_kept")


def reparse(batch: DataFrame, read, write, delete) -> None:
    """One micro-batch: each path once, by its last event; deleted files go, others are parsed, the most urgent first.

    ``read(paths)`` gives (path, content), ``write(parsed)`` and
    ``delete(paths)`` store the outcome; all take DataFrames. A batch with a
    column ``priority`` (see ``scalar.parse_priority``) is written in classes
    of ten, lowest first: a class is there before the next one is begun.
    """
    from graphlens.session import stage
    from graphlens.sources.ingest import parse

    rank = F.min("priority") if "priority" in batch.columns else F.min(F.lit(0))
    last = stage(batch.groupBy("path").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("event_type"), F.floor(F.coalesce(rank, F.lit(99)) / 10).alias("class")), "events")
    delete(last.filter("event_type = 'deleted'").select("path"))
    todo = last.filter("event_type <> 'deleted'")
    for (k,) in sorted(tuple(r) for r in todo.select("class").distinct().collect()):  # priorities are below 100
        write(parse(read(todo.filter(F.col("class") == k).select("path"))))


def lease_steps(requests: list[tuple], state: tuple | None) -> tuple[list[tuple], tuple | None]:
    """Lock requests (ts, action, session_id, ttl) on one file in order; ((ts, action, session, granted, token) rows, new state).

    State is (session, expires, token). A lock is given if free, expired, its
    own or stolen; each grant has a higher token. Only the holder may unlock.
    """
    holder, expires, token = state or (None, 0.0, 0)
    out = []
    for ts, action, session, ttl in sorted(requests):
        free = holder is None or ts >= expires
        if action in ("lock", "steal"):
            granted = free or holder == session or action == "steal"
            if granted:
                token += 1
                holder, expires = session, ts + max(LEAST_TTL, ttl or LEAST_TTL)
            out.append((ts, action, session, granted, token if granted else None))
        elif action == "unlock":
            granted = holder == session and not free
            if granted:
                holder, expires = None, 0.0
            out.append((ts, action, session, granted, None))
    return out, (holder, expires, token)


def leases(requests: DataFrame) -> DataFrame:
    """(file_path, ts, action, session_id, granted, fencing_token) of lock requests; state per file."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = [(r.ts.timestamp(), r.action, r.session_id, None if pd.isna(r.ttl) else float(r.ttl)) for b in batches for r in b.itertuples()]
        held = None
        if state.exists:
            s = state.get
            held = (s[0], s[1], s[2])
        done, (holder, expires, token) = lease_steps(rows, held)
        state.update((holder, expires, token))
        yield pd.DataFrame({"file_path": [key[0]] * len(done), "ts": moments([d[0] for d in done]), "action": [d[1] for d in done], "session_id": [d[2] for d in done], "granted": [d[3] for d in done], "fencing_token": pd.array([d[4] for d in done], dtype="Int64")})

    return requests.groupBy("file_path").applyInPandasWithState(step, "file_path string, ts timestamp, action string, session_id string, granted boolean, fencing_token bigint", "holder string, expires double, token bigint", "append", "NoTimeout")


def allowed_calls(times: list[float], kept: list[float], limit: int, window: float = RATE_SECONDS) -> tuple[list[bool], list[float]]:
    """Of calls in order of time, which are allowed: at most ``limit`` allowed ones in any window."""
    out = []
    for t in times:
        kept = [k for k in kept if k > t - window]
        ok = len(kept) < limit
        if ok:
            kept = [*kept, t]
        out.append(ok)
    return out, kept


def rate_limit(calls: DataFrame, limit: int, window: float = RATE_SECONDS) -> DataFrame:
    """(key, ts, allowed); state per key: the times of allowed calls in the window, so at most ``limit``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times = sorted(t.timestamp() for b in batches for t in b["ts"])
        ok, kept = allowed_calls(times, list(state.get[0]) if state.exists else [], limit, window)
        state.update((kept,))
        yield pd.DataFrame({"key": [key[0]] * len(times), "ts": moments(times), "allowed": ok})

    return calls.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, allowed boolean", "kept array<double>", "append", "NoTimeout")


def calls_in_window(calls: DataFrame, key: str, seconds: float = RATE_SECONDS, ts: str = "ts") -> DataFrame:
    """(key, ts, n): how many calls of a key lie in the window that ends at each of its calls, itself included; equal times once.

    Counts per time are summed over the window, so equal times are one row
    before any key is gathered.
    """
    from pyspark.sql import Window

    at = calls.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, ts).agg(F.count("*").alias("k"))
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-round(seconds * 1e6) + 1, 0)
    return at.select(key, ts, F.sum("k").over(w).alias("n"))


def windowed_counts(events: DataFrame, by: list[str], window: str = "5 minutes", slide: str | None = None, late: str | None = "10 minutes") -> DataFrame:
    """(start, end, by..., n): counts by event time; ``late`` is the watermark, None keeps all late rows."""
    rows = events.withWatermark("ts", late) if late and events.isStreaming else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def runtime_edges(calls: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Observed calls to CALLS_RUNTIME edges per window of event time."""
    rows = calls.withWatermark("ts", late) if calls.isStreaming else calls
    out = rows.groupBy(F.window("ts", window).alias("w"), "source_id", "target_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"))
    return out.select("source_id", "target_id", F.lit("CALLS_RUNTIME").alias("type"), F.col("w.start").alias("start"), "n", "first_seen")


def run_once(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give its rows: for tests and small reports."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return spark.table(name)
