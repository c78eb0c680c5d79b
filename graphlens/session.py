"""Session settings and staged tables.

Long plans are cut by writing a Parquet table to the folder all executors
share (``spark.checkpoint.dir``). A lost executor loses nothing: the table is
read again, nothing is recomputed from the start.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: set[tuple[int, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names.

    Where none is set, one of our own, but only if executors run in this very
    process (``local``): on a cluster they would not see it, so that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="graphlens-")
        spark.sparkContext.setCheckpointDir(given)
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _filesystem(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _filesystem(spark, path)
    return fs.exists(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder, removed when Python ends."""
    path = f"{shared_dir(spark)}/graphlens/{name}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(_clean)
    _OWN.add((id(spark), path))
    _SESSIONS[id(spark)] = spark
    return path


_SESSIONS: dict[int, SparkSession] = {}


def _clean() -> None:
    for key, path in _OWN:
        try:
            remove(_SESSIONS[key], path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            pass


class Staged:
    """A written intermediate table; ``drop()`` frees it once a later one replaces it."""

    def __init__(self, df: DataFrame, name: str = "stage"):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and read it back: one evaluation however often it is used."""
    return Staged(df, name).df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="graphlens-ship-")) / "graphlens.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # copied to Spark's own file server, from where executors fetch it
    spark.sparkContext.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, True)
    _SHIPPED.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
