"""Positions of rows in a total order, for any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traderisk.llm.common import written

_SHIFT = 33  # monotonically_increasing_id: partition above, row below


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with a column ``name``: 0, 1, 2 ... in the order given.

    Rows are range-partitioned and sorted where they are; a row's place is its place in the
    partition plus the rows of the partitions before, which come from a table of one row per
    partition.  The sorted rows are written once, so that places and counts tell of the same
    rows.  ``order`` should end in columns that tell rows apart, so that ties can be cut.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = written(sorted_rows, f"numbered-{name}").withColumn("_part", F.shiftright("_at", _SHIFT))
    sizes = table.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    return table.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_at", "_before")
