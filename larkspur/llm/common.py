"""What the operators of this subpackage share: scratch tables in the shared
folder, and word hashing straight on Arrow's UTF-8 buffers.

Words are maximal runs of bytes above 0x20, so that a word never depends on a
locale or on Unicode tables and hashing needs no Python loop over words.
"""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session that names none gets one of this machine, if it runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and lost executors lose nothing of it.

    Shuffle files of the write go once it has ended, rather than when the driver next collects garbage.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def joined_to(rows: DataFrame, facts: DataFrame, on: list[str], seen: str, total: int) -> DataFrame:
    """Rows with the facts of their key; facts has a row for each key, and in `seen` how many of the `total` rows have it.

    Keys of more than a thousandth of all rows are under a thousand, and their facts are broadcast; so no task gets all rows of a frequent key.
    """
    often = F.col(seen) * 1000 > total
    few = facts.where(often)
    near = rows.join(F.broadcast(few), on)
    far = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(facts.where(~often), on)
    return near.unionByName(far)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small_batches(spark: SparkSession, most: int = 2048, most_bytes: int = 8 << 20) -> None:
    """Bounds the rows and the bytes of an Arrow batch: whole texts and blocks of arrays are long, and a batch lies in the
    JVM and in Python at once. A row is never split. A number of bytes that the session itself names stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= most:
        spark.conf.set(key, str(most))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's own default
        spark.conf.set(key, f"{most_bytes}b")


def lean_worker() -> None:
    """For tasks that encode nothing: a Python worker serves one operator after another, and gives back what vocabularies took."""
    encode = sys.modules.get(f"{__package__}.encode")
    if encode is not None and encode._cached:
        encode._cached.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def pieces_of(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int, base: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= CHUNK_BYTES + 1:  # longer ones are for single long texts
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with hash of data[a:b] = (S[b] - S[a]) * inverse ** a, modulo 2 ** 64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data), _BASE), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[end] - sums[start]) * powers(len(sums), _INVERSE)[start])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie in data at offsets (from 0): hash, start and end of each word, and the n + 1 word offsets of the texts."""
    inside = data > 32
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.ones(len(data), bool)
    if len(data):
        after[:-1] = ~inside[1:]
        cuts = offsets[1:] - 1
        after[cuts[cuts >= 0]] = True
    ends = np.flatnonzero(inside & after) + 1
    hashes = range_hash(prefix_sums(_LOWER[data] if lower else data), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def word_chunks(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, word offsets) for ranges of the column."""
    data, off = utf8(column)
    for i, j in pieces_of(off):
        a, b = off[i], off[j]
        hashes, _, _, words = word_hashes(data[a:b], off[i : j + 1] - a, lower)
        yield i, j, hashes, words


def shingles(hashes: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and their offsets by text; a text of fewer words, but of one at least, is one shingle."""
    count = np.diff(words)
    own = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(own)])
    total = int(off[-1])
    first = np.repeat(words[:-1] - off[:-1], own) + np.arange(total)
    length = np.repeat(np.minimum(count, n), own)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        live = length > k
        at = np.minimum(first + k, max(len(hashes) - 1, 0))
        out = np.where(live, out * np.uint64(0x2545F4914F6CDD1D) + hashes[at] + np.uint64(k + 1), out) if total else out
    return mixed(out), off
