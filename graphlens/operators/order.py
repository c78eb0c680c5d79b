"""Numbers in a global order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.session import Staged


def numbered(df: DataFrame, order: list[Column | str], name: str = "n", start: int = 0) -> DataFrame:
    """``df`` with a bigint ``name`` from ``start`` on, in the given order; ties in no fixed order.

    Rows are partitioned by ranges of the order. Each range is numbered by
    itself and moved on by the sizes of the ranges before it, of which the
    driver gets one number each, so no task sees more than a range.
    """
    parts = Staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges").df
    sizes = sorted(tuple(r) for r in parts.groupBy("_range").agg(F.count("*")).collect())
    at, offsets = start - 1, []
    for part, size in sizes:
        offsets.append((part, at))
        at += size
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "_range int, _before bigint"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return parts.withColumn(name, place.cast("bigint")).join(before, "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def first(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` rows in the given order, for any ``n``: none is kept in a task's memory as a top-k buffer would."""
    return numbered(df, order, "_n").filter(F.col("_n") < n).drop("_n")
