"""Keyword search through an index: which listings hold which three characters in a row.

    bucket=K    gram, block, places: where in its block of listings a gram stands
    bucket=64   block, ids: the listings of a block, in order

A gram is a number, of 21 bits for each character. Listings are indexed block by
block, so that there is one row for each different gram of a block rather than of
a listing. A pattern's literal parts of three characters or more are grams as well.
Only their buckets are read, and in these only their rows; listings that have all
of them are candidates, and the search itself is asked of these alone. A pattern
without such a part is asked of all listings.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .feeds import keyword_search

SCHEMA = "gram long, block binary, places array<smallint>, ids array<string>, bucket int"
BUCKETS = 64
#: Most listings and, unless a listing has more, most characters of a block.
BLOCK, BLOCK_CHARS = 4096, 1 << 22


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def distinct_grams(fields: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The different (gram, place) of a block of listings, in that order; place is a listing's number. No gram crosses fields."""
    lens = np.array([len(t) for own in fields for t in own], np.int64)
    place = np.repeat(np.repeat(np.arange(len(fields)), [len(own) for own in fields]), lens)
    chars = np.frombuffer("".join(t for own in fields for t in own).encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.flatnonzero(np.arange(len(chars)) + 2 < np.repeat(np.cumsum(lens), lens))
    # characters are numbered in their order, so that gram and place are one number to sort
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    alphabet = np.flatnonzero(seen)
    n, size = len(alphabet), max(1, len(fields))
    own = (np.cumsum(seen) - 1)[chars]
    grams = (own[at] * n + own[at + 1]) * n + own[at + 2]
    if n**3 * size < 1 << 63:
        both = np.sort(grams * size + place[at])
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        grams, place = both // size, both % size
    else:
        names, at_name = np.unique(grams, return_inverse=True)
        both = np.unique(at_name * size + place[at])
        grams, place = names[both // size], both % size
    first, second, third = alphabet[grams // n // n] if n else grams, alphabet[grams // n % n] if n else grams, alphabet[grams % n] if n else grams
    return first << 42 | second << 21 | third, place


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index of id, fields (already in lower case)."""
    for batch in batches:
        ids, fields = batch.column("id").to_pylist(), batch.column("fields").to_pylist()
        size = np.cumsum([sum(map(len, own)) for own in fields])
        start = 0
        while start < len(ids):
            before = int(size[start - 1]) if start else 0
            end = max(start + 1, min(start + BLOCK, int(np.searchsorted(size, before + BLOCK_CHARS, "right"))))
            name = uuid.uuid4().bytes
            grams, place = distinct_grams(fields[start:end])
            cuts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
            n = len(cuts)
            places = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(grams)).astype(np.int32)), pa.array(place.astype(np.int16)))
            yield pa.RecordBatch.from_pydict({"gram": pa.array(grams[cuts], pa.int64()), "block": pa.array([name] * n, pa.binary()), "places": places, "ids": pa.nulls(n, pa.list_(pa.string()))})
            yield pa.RecordBatch.from_pydict({"gram": pa.nulls(1, pa.int64()), "block": pa.array([name], pa.binary()), "places": pa.nulls(1, pa.list_(pa.int16())), "ids": pa.array([ids[start:end]], pa.list_(pa.string()))})
            start = end


def write_index(listings: DataFrame, path: str, spread: int = 8) -> None:
    """Adds listings to the index at path. Rows of a frequent gram go to `spread` files, in which they lie together."""
    fields = [F.col(c) for c in ("raw_title", "enriched_description", "raw_description", "venue")] + [F.array_join("tags", ",")]
    texts = listings.select(F.col("id").cast("string").alias("id"), F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in fields]).alias("fields"))
    rows = texts.mapInArrow(_blocks, "gram long, block binary, places array<smallint>, ids array<string>").withColumn("bucket", F.when(F.col("gram").isNull(), BUCKETS).otherwise(_bucket(F.col("gram"))))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("block"), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(path)


def pattern_grams(words: str) -> list[str]:
    """The grams that every text has which matches the pattern; % and _ in it are wildcards."""
    parts = re.split(r"[%_]", words.lower())
    return sorted({p[k : k + 3] for p in parts for k in range(len(p) - 2)})


def gram_number(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def candidates(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """id of the listings that have all of the grams."""
    numbers = [gram_number(g) for g in grams]
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in numbers], "gram long").select(_bucket(F.col("gram"))).distinct().collect()]
    index = spark.read.schema(SCHEMA).parquet(path)
    some = index.where(F.col("bucket").isin(buckets) & F.col("gram").isin(numbers)).select("block", F.explode("places").alias("place"))
    full = some.groupBy("block", "place").agg(F.count("*").alias("n")).where(F.col("n") == len(numbers)).select("block", "place")
    names = index.where(F.col("bucket") == BUCKETS).select("block", F.posexplode("ids").alias("place", "id"))
    return full.join(names, ["block", "place"]).select("id")


def indexed_search(listings: DataFrame, path: str, words: str, today: Column, limit: int = 10) -> DataFrame:
    """What keyword_search finds in listings that are all in the index."""
    grams = pattern_grams(words)
    some = listings.join(candidates(listings.sparkSession, path, grams), "id", "left_semi") if grams else listings
    return keyword_search(some, words, today, limit)
