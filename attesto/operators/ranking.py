"""Ranks over all rows without putting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Bits of monotonically_increasing_id that count within a partition.
_LOCAL = 33


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with the place, from 1, of each row in an order that has no ties.

    Rows are dealt by ranges of the order and sorted within them; a row's place is its
    place in its range and the sizes of the ranges before, of which there is a row each.
    A window without a partition would sort all rows in one task.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__at", _LOCAL)).withColumn("__local", F.col("__at").bitwiseAND(F.lit(2**_LOCAL - 1)))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))  # a row a partition
    return placed.join(F.broadcast(starts), "__range").withColumn(name, F.col("__before") + F.col("__local") + 1).drop("__at", "__range", "__local", "__before")
