"""Operators that the dialect needs beside Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.shared import shared_dir, written

_ROW_BITS = 33  # of monotonically_increasing_id(): below them the row within its partition


_INT_MOST = (1 << 31) - 1


def range_rows(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """The half-open range as one column ``range``: INT, or 64 bits wide where a bound is beyond 32 bits."""
    wide = max(abs(start), abs(stop)) > _INT_MOST
    return spark.range(start, stop, step).select(F.col("id").cast("long" if wide else "int").alias("range"))


def one_row(spark: SparkSession, values: dict) -> DataFrame:
    """A single row of constants."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def numbered(df: DataFrame, order: list, name: str = "__position") -> DataFrame:
    """Rows with their place, from 0, in the order of the columns ``order``; rows equal in them in any order.

    The sort is by range and stays distributed.  The sorted rows are written once to the shared
    folder with their partition and their place in it: what numbers them and what counts them has
    then seen the same partitions, whatever a plan that runs twice would make of its ranges.  One
    count a partition is summed up and broadcast; no task sees more than its own range.
    """
    spark = df.sparkSession
    placed = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = written(spark, placed.withColumn("__part", F.shiftrightunsigned("__id", _ROW_BITS)), shared_dir(spark), "sorted")
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    row = F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + row).drop("__id", "__part", "__start")


def zip_rows(*sides: tuple[DataFrame, list]) -> DataFrame:
    """Sides put next to each other row by row, each in its order; the shorter ones end in nulls.

    sides: (rows, order columns); their column names must differ.
    """
    counted = [numbered(df, order) for df, order in sides]
    return reduce(lambda a, b: a.join(b, "__position", "full"), counted).drop("__position")


def latest(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of the rows with one key, the one that comes first in the order."""
    window = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(window)).where(F.col("__place") == 1).drop("__place")
