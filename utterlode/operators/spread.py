"""Joins in which one key may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in ``SHARE`` times as many rows as there are tasks.
SHARE = 4


def hot_keys(sizes: DataFrame, size: str, total: int, tasks: int) -> DataFrame:
    """The rows of ``sizes`` whose keys are hot: ``SHARE * tasks`` at most, as their shares add up to no more than all."""
    return sizes.where(F.col(size) * (SHARE * tasks) > total)


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, tasks: int) -> DataFrame:
    """``rows`` left-joined with ``groups``, one row for each value of ``key`` that names how many of ``rows`` hold it.

    Rows of hot keys meet a broadcast table, which is small by definition, where they lie; only the others move. Both
    inputs are read twice, so they should be tables.
    """
    hot = F.broadcast(hot_keys(groups, size, total, tasks))
    cold = groups.where(F.col(size) * (SHARE * tasks) <= total)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key, "left"))
