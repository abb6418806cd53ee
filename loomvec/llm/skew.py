"""Joining a grouped summary back to its rows so that a hot key can be split.

A summary that was grouped by the join key already lies where the join wants it,
so Spark would run the grouping and the join in one stage, which adaptive
execution cannot split. Joining by an image of the key gives the summary (one
row a key) a shuffle of its own, and the rows of a hot key go to several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_back(rows: DataFrame, summary: DataFrame, key: str, *others: str) -> DataFrame:
    """``rows`` with the columns of ``summary``, which has at most one row for each ``key`` (an integer or a string) and ``others``; rows without one go."""
    image = F.reverse(key) if dict(rows.dtypes)[key] == "string" else F.bitwise_not(key)
    return rows.withColumn("image", image).join(summary.select(image.alias("image"), *[c for c in summary.columns if c != key]), ["image", *others]).drop("image")
