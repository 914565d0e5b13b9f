"""Ranks inside groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order, with their rank from 1.

    Written as row_number() <= n, which Spark plans as a group limit on both sides of the shuffle: at most n rows of
    each group leave a task, so a large group isn't gathered in one.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= n)
