"""Ordered identifiers without a single-task sort.

``ordinals`` numbers rows in a total order: rows are dealt into ranges of the order, ranges are counted, and each row's number is its
place within its range plus the rows of the ranges before. Only the counts, a row a range, are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.shared import cut, partitions


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def last_by(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The last row of each key by ``order`` (upsert)."""
    return first_by(df, keys, [F.desc(order)])


def top_by(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def ordinals(df: DataFrame, order: list, name: str = "n") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in ``order``, which must be total."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    kept = cut(ranged, "ranges")  # ranges are sampled: they must not be drawn twice
    sizes = kept.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_f"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("_p").alias("_q"), "_f", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    return kept.join(starts, F.col("_p") == F.col("_q")).withColumn(name, F.col("_i") - F.col("_f") + F.col("_b") + 1).drop("_p", "_q", "_i", "_f", "_b")


def offsets(df: DataFrame, order: list, size: str, name: str = "start") -> DataFrame:
    """``df`` with ``name``: the sum of ``size`` over the rows before it in ``order``, which must be total."""
    kept = cut(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("_p").agg(F.sum(size).alias("_c")).select(F.col("_p").alias("_q"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return kept.join(starts, F.col("_p") == F.col("_q")).withColumn(name, F.coalesce(F.sum(size).over(own), F.lit(0)) + F.col("_b")).drop("_p", "_q", "_b")


def prefix_of(df: DataFrame, column: str, default: str, order: str = "ord") -> Column:
    """A scalar subquery: the most frequent first letter of the identifiers, the first seen of equals; ``default`` if there is none."""
    letters = df.where(F.col(column).rlike("^[A-Za-z]")).groupBy(F.substring(column, 1, 1).alias("p")).agg(F.count("*").alias("c"), F.min(order).alias("o"))
    best = letters.orderBy(F.desc("c"), "o").limit(1).agg(F.coalesce(F.max("p"), F.lit(default)).alias("p"))
    return best.scalar()


def largest_suffix(df: DataFrame, column: str, prefix: Column) -> Column:
    """A scalar subquery: the largest number after ``prefix`` in the identifiers that are the prefix and digits; 0 if there is none."""
    rest = F.when(F.col(column).startswith(prefix), F.substr(F.col(column), F.length(prefix) + 1))
    return df.agg(F.coalesce(F.max(F.when(rest.rlike("^[0-9]+$"), rest.try_cast("bigint"))), F.lit(0)).alias("m")).scalar()
