"""Joins with tables of one row per key, of whose keys a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that can be broadcast: those with at least a 1/HOT of all rows, of which there are no more than HOT.
HOT = 10_000


def join_with_hot(rows: DataFrame, dimension: DataFrame, on: str, often: Column) -> DataFrame:
    """rows joined with `dimension` (one row per key): its rows for which `often` holds are broadcast, others are shuffled by key.

    often: whether a key has at least a 1/HOT of all rows, by a count that `dimension` carries. So no shuffle key has more.
    """
    hot = F.broadcast(dimension.filter(often))
    rare = rows.join(hot.select(on), on, "left_anti").join(dimension.filter(~often), on)
    return rows.join(hot, on).unionByName(rare)
