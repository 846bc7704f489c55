"""Numbers for the rows of a whole table, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import fixed


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with ``place``: 0, 1, ... in the order of the distinct column ``by``.

    Spark range-partitions the rows with splitters that it samples, so ranges are even whatever the values look like; rows
    are numbered inside their range, after the rows of the ranges before it.  Ranges are written once, as another sample
    would cut them elsewhere.
    """
    dealt = fixed(rows.repartitionByRange(by).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return dealt.join(F.broadcast(starts), "__part").withColumn("place", F.col("__start") + inside - 1).drop("__part", "__start")
