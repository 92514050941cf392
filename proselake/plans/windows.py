"""Reusable relational patterns: runs, first occurrences, shares, set overlap with the previous row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, keys: list[str], order: str, value: str, least: int = 1) -> DataFrame:
    """Maximal runs of equal values: keys, value, first position, length. Null values end a run and form none."""
    w = Window.partitionBy(*keys).orderBy(order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    out = rows.withColumn("__i", island).groupBy(*keys, value, "__i").agg(F.min(order).alias("first_pos"), F.count(F.lit(1)).alias("run_length"))
    return out.filter(F.col(value).isNotNull() & (F.col("run_length") >= least)).drop("__i")


def first_occurrence(rows: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """(keys, item, first position): the state 'known before p' is first_pos < p, without collecting sets."""
    return rows.groupBy(*keys, item).agg(F.min(order).alias("first_pos"))


def percentiles(hist: DataFrame, keys: list[str], value: str, count: str, points: tuple[int, ...]) -> DataFrame:
    """Discrete percentiles of a histogram: the least value whose cumulative count reaches the share."""
    w = Window.partitionBy(*keys).orderBy(value)
    h = hist.withColumn("__c", F.sum(count).over(w)).withColumn("__t", F.sum(count).over(Window.partitionBy(*keys)))
    return h.groupBy(*keys).agg(*[F.min(F.when(F.col("__c") * 100 >= F.col("__t") * p, F.col(value))).alias(f"p{p}") for p in points])
