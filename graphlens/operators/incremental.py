"""Processing only new or changed records, run after run, with persisted state.

The state of a feed is kept in versions below one folder. A version holds what
its commit moved (key, run, state after and before it), which is both its
output and its change of the state, and a small ``META`` file: the last run
that is done, the versions that make up the state, and those whose rows nobody
has acknowledged yet. A one-line pointer file names the current version and is
replaced by one rename, so rows, state and progress stand or fall together.

A run that dies before the rename leaves the old version current and is done
again; one that dies behind it is done, and its rows come out of the next call
until they are acknowledged. The rename is atomic on HDFS and on POSIX file
systems. On an object store it is not: there the pointer must be a conditional
put, or lie on a file system that has the rename.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.session import _filesystem, remove, stage

STATE = "struct<at:timestamp,id:bigint,hash:string,gone:boolean>"
STATE_SCHEMA = f"key string, s {STATE}"
MOVED_SCHEMA = f"key string, run_id int, s {STATE}, before {STATE}"
OUT_SCHEMA = "run_id int, file_path string, content_hash string"
#: Commits after which the changes of the state are written as one table again.
COMPACT = 16


class StateStore:
    """Versions of the state of one feed below ``path``; the pointer names the current one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str) -> str | None:
        fs, where = _filesystem(self.spark, f"{self.path}/{name}")
        if not fs.exists(where):
            return None
        stream = fs.open(where)
        try:
            return bytes(b & 255 for b in stream.readAllBytes()).decode()
        finally:
            stream.close()

    def current(self) -> str | None:
        return self._file("CURRENT")

    def meta(self) -> dict:
        """What the current version's META says; ``last`` is (cutoff in microseconds, run_id)."""
        version = self.current()
        nothing = {"base": None, "deltas": [], "pending": [], "last": None, "runs": []}
        return json.loads(self._file(f"{version}/META")) if version else nothing

    def read(self, meta: dict | None = None) -> DataFrame:
        """(key, s): the newest state of each key. A state only ever grows, so the greatest counts."""
        meta = self.meta() if meta is None else meta
        if not meta["base"] and not meta["deltas"]:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        parts = []
        if meta["base"]:
            parts.append(self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.path}/{meta['base']}/state"))
        if meta["deltas"]:
            parts.append(self._moved(meta["deltas"]).select("key", "s"))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.groupBy("key").agg(F.max("s").alias("s"))

    def _moved(self, versions: list[str]) -> DataFrame:
        return self.spark.read.schema(MOVED_SCHEMA).parquet(*[f"{self.path}/{v}/moved" for v in versions])

    def pending(self, meta: dict | None = None) -> DataFrame:
        """(run_id, file_path, content_hash): rows of all commits that nobody has acknowledged yet."""
        meta = self.meta() if meta is None else meta
        if not meta["pending"]:
            return self.spark.createDataFrame([], OUT_SCHEMA)
        changed = ~F.col("s.gone") & (F.col("before").isNull() | F.col("before.gone") | ~F.col("before.hash").eqNullSafe(F.col("s.hash")))
        return self._moved(meta["pending"]).filter(changed).select("run_id", F.col("key").alias("file_path"), F.col("s.hash").alias("content_hash"))

    def acknowledge(self) -> None:
        """Say that the rows of all commits so far have arrived: they come out no more, and what only they needed is removed."""
        meta = self.meta()
        kept = {meta["base"], *meta["deltas"]}
        done = [v for v in meta["pending"] if v not in kept]
        self._commit(self.new_version("ack"), meta | {"pending": []})
        for version in done:
            remove(self.spark, f"{self.path}/{version}")

    def write(self, version: str, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{version}/{name}")

    def new_version(self, label: str) -> str:
        return f"v-{label}-{uuid.uuid4().hex[:8]}"

    def put(self, name: str, text: str) -> None:
        fs, where = _filesystem(self.spark, f"{self.path}/{name}")
        out = fs.create(where, True)
        out.write(text.encode())
        out.close()

    def _commit(self, version: str, meta: dict) -> None:
        self.put(f"{version}/META", json.dumps(meta))
        self.swap(version)

    def swap(self, version: str) -> None:
        """Make ``version`` current by one atomic rename of the pointer file."""
        jvm = self.spark.sparkContext._jvm
        temp = f".CURRENT-{uuid.uuid4().hex}"
        self.put(temp, version)
        _, source = _filesystem(self.spark, f"{self.path}/{temp}")
        _, where = _filesystem(self.spark, f"{self.path}/CURRENT")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = jvm.org.apache.hadoop.fs.Options.Rename
        args = self.spark.sparkContext._gateway.new_array(option, 1)
        args[0] = option.OVERWRITE
        context.rename(source, where, args)


def successful_runs(runs: DataFrame) -> list:
    """(run_id, cutoff_at) of runs whose last logged status is ``ok``, by cutoff.

    The log has a few rows per run and is the schedule itself, so it is read to
    the driver. Equal logged_at: the greater status counts. Rows without
    run_id or cutoff_at are left out.
    """
    last = runs.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.max(F.struct("logged_at", "status", "cutoff_at")).alias("l"))
    rows = last.filter("l.status = 'ok' AND l.cutoff_at IS NOT NULL").select("run_id", F.col("l.cutoff_at").alias("cutoff")).orderBy("cutoff", "run_id")
    return [(r.run_id, r.cutoff) for r in rows.collect()]


def arrivals(scans: DataFrame) -> DataFrame:
    """Rows that say something about content: (key, s, arrived).

    A null hash is only of use on a deletion; rows without key, observed_at or
    arrived_at are left out. Second deliveries are harmless: the earliest counts.
    """
    gone = F.coalesce(F.col("event_type") == "deleted", F.lit(False))
    return scans.filter((F.col("content_hash").isNotNull() | gone) & F.col("file_path").isNotNull() & F.col("observed_at").isNotNull() & F.col("arrived_at").isNotNull()).select(
        F.col("file_path").alias("key"),
        F.struct(F.col("observed_at").alias("at"), F.coalesce("scan_id", F.lit(-1)).cast("long").alias("id"), F.col("content_hash").alias("hash"), gone.alias("gone")).alias("s"),
        F.col("arrived_at").alias("arrived"),
    )


def _micros(at) -> int:
    return round(at.timestamp() * 1e6)


def _until(micros: int) -> Column:
    return F.timestamp_micros(F.lit(micros))


def _segment(rows: DataFrame, state: DataFrame, runs: list) -> DataFrame:
    """(key, run_id, s, before) of one commit: the state after each of its runs, and the one before it.

    Rows are first reduced to one per key and run, which no key can exceed
    however often it was scanned, then joined with the persisted state. A key
    whose rows of a run are all older than what is known does not move.
    """
    if len(runs) == 1:  # no run within the commit to look back to
        latest = rows.groupBy("key").agg(F.max("s").alias("new")).join(state.select("key", F.col("s").alias("before")), "key", "left")
        moved = latest.select("key", F.lit(runs[0][1]).cast("int").alias("run_id"), F.greatest("new", "before").alias("s"), "before")
        return moved.filter(~F.col("s").eqNullSafe(F.col("before")))
    number = F.lit(None).cast("int")
    for k in range(len(runs) - 1, -1, -1):
        number = F.when(F.col("arrived") <= _until(runs[k][0]), F.lit(k)).otherwise(number)
    latest = rows.withColumn("run", number).filter("run IS NOT NULL").groupBy("key", "run").agg(F.max("s").alias("s"))
    by_key = Window.partitionBy("key").orderBy("run")
    joined = latest.join(state.select("key", F.col("s").alias("kept")), "key", "left")
    moving = joined.withColumn("s", F.greatest(F.max("s").over(by_key), "kept"))
    ids = F.create_map(*[F.lit(x) for n, r in enumerate(runs) for x in (n, r[1])])
    moved = moving.withColumn("before", F.coalesce(F.lag("s").over(by_key), "kept"))
    return moved.filter(~F.col("s").eqNullSafe(F.col("before"))).select("key", ids[F.col("run")].cast("int").alias("run_id"), "s", "before")


def process(scans: DataFrame, runs: list, store: StateStore, runs_per_commit: int = 1) -> DataFrame:
    """Work through those of ``runs`` (run_id, cutoff_at) that are not done; the rows nobody has acknowledged.

    A file comes out at a run if its state there is present and new, changed
    or back after a deletion. Each run is a commit of its own;
    ``runs_per_commit`` lets several share one, with the same rows. The same
    call again, after a crash or not, gives the same rows until
    ``store.acknowledge()``. A run that is not done but lies before one that
    is cannot be done any more: an error.
    """
    meta = store.meta()
    wanted = sorted((_micros(cutoff), run) for run, cutoff in runs)
    last = tuple(meta["last"]) if meta["last"] else None
    late = [run for at, run in wanted if last and (at, run) <= last and run not in meta["runs"]]
    if late:
        raise ValueError(f"runs {late[:5]} lie before the last run that is done")
    todo = [r for r in wanted if last is None or r > last]
    rows = arrivals(scans)
    if len(todo) > runs_per_commit:
        # a replay of many runs: in order of arrival, so that each commit reads its own part only
        if last:
            rows = rows.filter(F.col("arrived") > _until(last[0]))
        rows = stage(rows.filter(F.col("arrived") <= _until(todo[-1][0])).repartitionByRange("arrived").sortWithinPartitions("arrived"), "arrivals")
    for k in range(0, len(todo), runs_per_commit):
        part = todo[k : k + runs_per_commit]
        window = rows.filter(F.col("arrived") <= _until(part[-1][0]))
        if meta["last"]:
            window = window.filter(F.col("arrived") > _until(meta["last"][0]))
        version = store.new_version(str(part[-1][1]))
        store.write(version, "moved", _segment(window, store.read(meta), part))
        meta = meta | {"deltas": [*meta["deltas"], version], "pending": [*meta["pending"], version], "last": list(part[-1]), "runs": [*meta["runs"], *(run for _, run in part)]}
        if len(meta["deltas"]) >= COMPACT:
            store.write(version, "state", store.read(meta))
            meta = meta | {"base": version, "deltas": []}
        store._commit(version, meta)
    return store.pending(meta)
