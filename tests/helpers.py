"""Shared by tests and tools: a local session and a comparison of result sets."""

from __future__ import annotations

import math
import os

from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .appName("graphlens")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    """DuckDB with a view for each table of a folder."""
    from pathlib import Path

    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    c.execute("set timezone='UTC'")
    return c


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if hasattr(x, "isoformat"):
        return "~" if str(x) == "NaT" else x.replace(tzinfo=None).isoformat()
    if hasattr(x, "tolist"):
        return str([_plain(v) for v in x.tolist()])
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(x)


def same_rows(a, b) -> str:
    """'' if two pandas frames hold the same rows in any order, else what differs."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    columns = sorted(a.columns)
    x, y = (sorted(tuple(map(_plain, r)) for r in d[columns].itertuples(index=False, name=None)) for d in (a, b))
    if x == y:
        return ""
    only_x, only_y = list(set(x) - set(y))[:3], list(set(y) - set(x))[:3]
    return f"{len(x)} and {len(y)} rows; only left {only_x}, only right {only_y}"
