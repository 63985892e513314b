"""Whole tables in order, without one task that holds a table or a key: ranges are sorted apart, and what each comes to is carried forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import written

_BITS = 33  # of monotonically_increasing_id, those of a row within its task


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df, written in sorted ranges, with `part`, the number of its range, and `at`, its place in it."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    return placed.withColumns({"part": F.shiftright("at", _BITS), "at": F.col("at").bitwiseAND((1 << _BITS) - 1)})


def numbered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df with the place of each row in the order, from 0."""
    placed = in_ranges(df, *order)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each task
    return placed.join(F.broadcast(sizes), "part").withColumn(name, F.col("before") + F.col("at")).drop("part", "at", "before")


def best_before(df: DataFrame, key: str, place: str, worth: str, name: str) -> DataFrame:
    """df with the largest worth of the rows of the same key that come before, null for the first ones."""
    placed = in_ranges(df, F.col(key), F.col(place))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    # a range is what one task has sorted; a key has one row for each range that it reaches into
    whole = placed.groupBy(key, "part").agg(F.max(worth).alias("top")).withColumn("carried", F.max("top").over(before.partitionBy(key).orderBy("part"))).drop("top")
    inner = placed.withColumn("inner", F.max(worth).over(before.partitionBy("part", key).orderBy("at")))
    return inner.join(whole, [key, "part"]).withColumn(name, F.greatest("inner", "carried")).drop("part", "at", "inner", "carried")
