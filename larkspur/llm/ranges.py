"""Numbers for the rows of a whole table in a given order, without gathering a key or the table.

Rows are sorted range by range, and the sizes of the ranges, a row for each task, are carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, saved

_BITS = 33  # of monotonically_increasing_id, those of a row within its task


def ranges(df: DataFrame, *order: Column, within: tuple[Column, ...] | None = None) -> DataFrame:
    """df dealt into sorted ranges. within: a finer order inside of a range, which starts with the same columns."""
    return df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*(within or order))


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df, written to the shared folder, with the place of each row in the order, from 1. Rows that the order leaves equal follow each other as it happens."""
    placed = saved(ranges(df, *order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", _BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.col("at").bitwiseAND((1 << _BITS) - 1)
    return placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn(name, F.col("before") + inside + 1).drop("part", "before", "at")
