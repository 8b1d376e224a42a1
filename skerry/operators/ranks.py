"""Row numbers over a whole table, and draws that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.storage import cut


def numbered(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """df with its rows numbered from 0 in the order given. Rows are ranged over all tasks, numbered in each and offset by the tasks before, so no task sees them all; order should be total."""
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_p", "_b")
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_b") + F.col("_r") - 1).drop("_p", "_r", "_b")


def running_before(df: DataFrame, order: list[Column | str], value: str, name: str = "before") -> DataFrame:
    """df with the sum of value over all rows before, in the order given. Summed in ranges and offset by the ranges before, as `numbered` does; order should be total."""
    ranged = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = cut(ranged.withColumn("_r", F.coalesce(F.sum(value).over(inside), F.lit(0))))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    offsets = ranged.groupBy("_p").agg(F.sum(value).alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("_p", "_b")
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_b") + F.col("_r")).drop("_p", "_r", "_b")


def draw(seed: int, *columns: Column | str) -> Column:
    """A whole number from 0 to 2^32 - 1: the first eight hexadecimal digits of the MD5 of seed and columns, joined by commas."""
    text = F.concat_ws(",", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def unit(seed: int, *columns: Column | str) -> Column:
    """A draw as a number from 0 up to, not including, 1."""
    return draw(seed, *columns) / float(1 << 32)
