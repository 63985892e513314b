"""A table in hash buckets that batches change one by one, each only the buckets that it touches.

    root/data/version=N/bucket=K   what batch N left of bucket K
    root/commits                   a row for each bucket that a batch has written: batch, bucket

A batch writes its buckets first, and commits them by one small file that is
appended at the end: a batch counts once its commit is there, and one that is
committed is never done again. A batch that failed on the way is written anew in
its place, and readers see what the commits name. Batches come one after another,
as a streaming query gives them; two writers at a time are not provided for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMITS = "batch long, bucket int"
START = -1  # the batch that makes the empty table


class Buckets:
    """key: the column whose hash tells a row's bucket."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    def create(self, buckets: int = 64) -> "Buckets":
        """An empty table, if there is none yet. The number of buckets is the table's for good."""
        if not self._is_there():
            self._commit(START, list(range(buckets)))
        return self

    def _is_there(self) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _commit(self, batch: int, buckets: list[int]) -> None:
        # one file, which the writer puts in place as a whole
        self.spark.createDataFrame([(batch, b) for b in buckets], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")

    def size(self) -> int:
        return self.commits().where(F.col("batch") == START).count()

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _now(self, only: list[int] | None = None) -> list[str]:
        """The folders that hold the table, or some of its buckets: one for each bucket that was ever written."""
        last = self.commits().groupBy("bucket").agg(F.max("batch").alias("batch")).where(F.col("batch") > START).where("bucket >= 0")
        if only is not None:
            last = last.where(F.col("bucket").isin(only))
        return [f"{self.root}/data/version={r['batch']}/bucket={r['bucket']}" for r in last.collect()]

    def read(self, only: list[int] | None = None) -> DataFrame:
        paths = self._now(only)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def change(self, number: int, batch: DataFrame, new: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """new(current, batch) replaces the rows of the buckets that batch, which has the key, touches. False if batch `number` is committed already."""
        if not self.commits().where(F.col("batch") == number).isEmpty():
            return False
        buckets = self.size()
        own = self.bucket_of(buckets)
        touched = [r[0] for r in batch.select(own).distinct().collect()]  # as many as there are buckets at most
        if touched:
            rows = new(self.read(touched), batch).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
            rows.withColumn("bucket", own).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/version={number}")
        # a batch without rows is committed as well, under no bucket of the table
        self._commit(number, touched or [-1])
        return True

    def sweep(self) -> int:
        """Deletes what later batches have replaced, and tells how many folders that were. No batch and no reader may be at work."""
        last = self.commits().where("bucket >= 0").groupBy("bucket").agg(F.max("batch").alias("last"))
        old = self.commits().join(last, "bucket").where(F.col("batch").between(START + 1, F.col("last") - 1)).select("batch", "bucket").collect()
        jvm, gone = self.spark._jvm, 0
        for r in old:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/version={r['batch']}/bucket={r['bucket']}")
            gone += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone
