"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold more than ``share`` of the rows: at most ``1/share`` values, whatever the data."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    total = df.count()
    return [r[0] for r in counts.filter(F.col("count") > F.lit(total * share)).select(key).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """Join to a side on which ``key`` is unique, without sending a hot key to one task.

    ``left`` should be a written table, as it is read twice. Rows of hot keys
    meet the at most ``1/share`` right-hand rows by broadcast, which is a proven
    bound; all others take the ordinary shuffle join. A null key matches nothing.
    """
    hot = hot_keys(left, key, share)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = right.filter(F.col(key).isin(hot))
    rest = right.filter(~F.col(key).isin(hot))
    return left.filter(is_hot).join(F.broadcast(few), key, how).unionByName(left.filter(~is_hot).join(rest, key, how))
