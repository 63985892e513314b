"""Connected components of small link tables, as duplicate listings give them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder, which all executors share."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path, not there yet, in the folder that driver and executors share. A session that names none gets one of this machine, if it runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-tables-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, *parts: str) -> DataFrame:
    """df as a table in the shared folder: lost executors lose nothing of it, and it is computed once. Rows of one value of the columns `parts` lie apart."""
    path = new_folder(df.sparkSession, "table")
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labels(links: DataFrame) -> DataFrame:
    """id and label, the smallest id that it is linked with: labels pass over the links, and labels of labels are taken, until none changes."""
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    while True:
        near = both.join(now.toDF("b", "l"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("near"))
        step = now.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.join(step.select(F.col("id").alias("label"), F.col("label").alias("far")), "label")
        new = checkpointed(jump.select("id", F.least("label", "far").alias("label"), "old"))
        if new.where("label <> old").isEmpty():
            return new.select("id", "label")
        now = new.select("id", "label")


def met(rows: DataFrame, facts: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows with the facts of their key, null where it has none. facts has at most one row for a key, with seen: how many of the `total` rows have it.

    Keys of more than a thousandth of all rows are under a thousand and meet their facts by broadcast, and rows with a
    null in their key meet nothing; so no task gets all rows of a frequent key.
    """
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    new = [f for f in facts.schema.fields if f.name not in (*on, "seen")]
    often = F.col("seen") * 1000 > total
    few, rest = facts.where(often).drop("seen"), facts.where(~often).drop("seen")
    near = rows.join(F.broadcast(few), on)
    far = rows.where(whole).join(F.broadcast(few.select(*on)), on, "left_anti").join(rest, on, "left")
    columns = [*rows.columns, *(f.name for f in new)]
    alone = rows.where(~whole).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
    return near.select(*columns).unionByName(far.select(*columns)).unionByName(alone.select(*columns))
