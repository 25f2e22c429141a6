"""Likes: a fold of toggles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(toggles: DataFrame) -> DataFrame:
    """(id, n, liked_seq): how often an id is toggled, and when last.

    Counts and maxima combine before the shuffle, so a much toggled id costs one row a task.
    """
    return toggles.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("liked_seq"))


def liked(toggles: DataFrame) -> DataFrame:
    """(id, liked_seq) of ids toggled an odd number of times; liked_seq is the last toggle, which set the like."""
    return counted(toggles).where(F.col("n") % 2 == 1).select("id", "liked_seq")
