"""Comparison of metrics before and after an update, over many lectures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(metrics: DataFrame, digits: int = 3) -> DataFrame:
    """(i, method, metric columns) from long (i, method, metric_name, value), rounded, by i and method; names are read from the data."""
    names = [r[0] for r in metrics.select("metric_name").distinct().orderBy("metric_name").collect()]  # a fixed set of metric names
    return metrics.groupBy("i", "method").pivot("metric_name", names).agg(F.round(F.first("value"), digits))


def means(compared: DataFrame, digits: int | None = None) -> DataFrame:
    """Means of all metric columns by method."""
    cols = [c for c in compared.columns if c not in ("i", "method")]
    avg = lambda c: F.avg(c) if digits is None else F.round(F.avg(c), digits)
    return compared.groupBy("method").agg(*[avg(c).alias(c) for c in cols])


def change(metrics: DataFrame, before: str, after: str) -> DataFrame:
    """(i, metric_name, before, after, gain) of metrics that both versions have."""
    side = lambda m, c: metrics.where(F.col("method") == m).select("i", "metric_name", F.col("value").alias(c))
    return side(before, "before").join(side(after, "after"), ["i", "metric_name"]).withColumn("gain", F.col("after") - F.col("before"))
