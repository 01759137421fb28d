"""Joins that hold up when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from captionloom.session import materialize


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join of ``left`` with ``right``, a table of one row per key, which may be an aggregate.

    Spark splits the partitions of a hot key, and of null keys where they are kept, by the bytes that it
    measures, for every join type that keeps left rows only once. It can do so where both sides come
    straight from an exchange. An aggregate by the same key would not, so the right side is written
    out first; a small one is then broadcast, by its size on disk.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    return left.join(materialize(right, "joined"), key, how)
