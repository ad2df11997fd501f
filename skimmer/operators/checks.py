"""Assertions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unsorted(rows: DataFrame, order: str, value: str, by: list[str] = ()) -> DataFrame:
    """Rows whose value isn't greater than the one before: none if the values ascend strictly. by: parts that are
    each tested on their own; without, all rows meet in one task, so give it for large tables."""
    return rows.withColumn("before", F.lag(value).over(Window.partitionBy(*by).orderBy(order))).where(F.col(value) <= F.col("before"))
