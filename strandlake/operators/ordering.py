"""Exact ranks and running sums over all rows of a table, without a task that sees them all.

Rows are dealt by ranges of the order and written; what lies before a range follows from one sum a range, and a window
runs inside each range. Ties that repeat in every column of the order are taken in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake import workspace


def running(rows: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Adds ``name``, the weight of all rows before each one. The order should tell all rows apart: rows equal in it share a task."""
    dealt = workspace.table(rows.withColumn("__weight", weight).repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ordered")
    sums = dealt.groupBy("__range").agg(F.sum("__weight").alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select("__range", (F.sum("__sum").over(before) - F.col("__sum")).alias("__ahead"))  # one row a range
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(sums), "__range").withColumn(name, F.col("__ahead") + F.sum("__weight").over(inside) - F.col("__weight"))
    return out.drop("__range", "__weight", "__ahead")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the number of rows before each one."""
    return running(rows, order, F.lit(1).cast("bigint"), name)
