"""Token-id archive: documents as compressed id arrays that can be read singly.

A shard is one row of a Parquet table: the zstandard frames of its documents,
end to end, with their ids, token counts and end offsets as index. All frames
use one dictionary, trained on serialised id arrays and named in every shard by
its SHA-256, so that a wrong dictionary is noticed before anything is decoded.
Spark commits the files, so a lost executor or a second attempt leaves no
half-written shard.

Nulls: a null text has no ids of its own; a null doc_id sorts first and is kept.
Repeated rows are kept, documents of equal doc_id in order of their text. A very
long text is one frame, and its shard ends with it. Empty tables give empty
archives. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, small_batches
from .encode import encoder

VERSION = 1
SHARDS = "part int, seq int, version int, dict_sha256 string, width int, first_id long, last_id long, tokens long, doc_id array<bigint>, n_tokens array<int>, ends array<bigint>, frames binary"


def _ids(texts: pa.Array, vocabulary: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text, with the end id."""
    ids, off = encoder(vocabulary).encode(texts)
    for a, b in zip(off.tolist(), off[1:].tolist(), strict=False):
        yield np.append(ids[a:b], np.uint32(end_id))


def _packed(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(documents: DataFrame, vocabulary: str, end_id: int, width: int, sample: int = 2000, size: int = 1 << 16, piece: int = 1 << 15) -> bytes:
    """A dictionary from the `sample` documents whose doc_ids hash lowest: a documented bound, since a dictionary of fixed
    size gains nothing from more. Long ones are learnt in pieces of `piece` ids. It is trained in one task; the driver
    gets the dictionary alone. Too few documents to train on: an empty dictionary, and frames without one.
    """
    import zstandard

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = sorted(_packed(x, width) for b in batches for x in _ids(b.column("text"), vocabulary, end_id))
        parts = [x[k : k + piece * width] for x in drawn for k in range(0, len(x), piece * width)]
        try:
            made = zstandard.train_dictionary(size, parts).as_bytes() if len(parts) >= 8 else b""
        except zstandard.ZstdError:
            made = b""
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([made], pa.binary())})

    drawn = documents.select("doc_id", F.xxhash64("text").alias("mark"), F.xxhash64("doc_id", F.lit(3)).alias("order")).distinct().orderBy("order", "doc_id", "mark").limit(sample)
    marked = documents.withColumn("mark", F.xxhash64("text"))
    chosen = marked.join(F.broadcast(drawn.select("doc_id", "mark")), ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"]).select("text")
    return next(iter(chosen.coalesce(1).mapInArrow(train, "dictionary binary").collect()), [b""])[0] or b""


def write_archive(documents: DataFrame, path: str, vocabulary: str, end_id: int, shard_tokens: int = 1 << 20, level: int = 3) -> None:
    """Encodes every whole text and writes shards in ascending doc_id order under path, the dictionary beside them."""
    spark = documents.sparkSession
    small_batches(spark)
    width = 2 if max(encoder(vocabulary).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(documents.select("doc_id", "text"), vocabulary, end_id, width)
    sha = hashlib.sha256(dictionary).hexdigest()
    shared = spark.sparkContext.broadcast(dictionary)  # of a fixed size
    spark.createDataFrame([(sha, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        press = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)
        part, seq = TaskContext.get().partitionId(), 0
        docs: list = []
        counts: list[int] = []
        frames: list[bytes] = []

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(f) for f in frames]).tolist()
            named = [d for d in docs if d is not None]
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "version": pa.array([VERSION], pa.int32()), "dict_sha256": [sha], "width": pa.array([width], pa.int32()),
                    "first_id": pa.array([named[0] if named else None], pa.int64()), "last_id": pa.array([named[-1] if named else None], pa.int64()), "tokens": pa.array([sum(counts)], pa.int64()),
                    "doc_id": pa.array([docs], pa.list_(pa.int64())), "n_tokens": pa.array([counts], pa.list_(pa.int32())), "ends": pa.array([ends], pa.list_(pa.int64())), "frames": pa.array([b"".join(frames)], pa.binary()),
                }
            )

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                for doc, ids in zip(some.column("doc_id").to_pylist(), _ids(some.column("text"), vocabulary, end_id), strict=True):
                    docs.append(doc)
                    counts.append(len(ids))
                    frames.append(press.compress(_packed(ids, width)))
                    held += counts[-1]
                    if held >= shard_tokens:
                        yield row()
                        docs, counts, frames, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield row()

    ordered = documents.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards, SHARDS).write.option("compression", "none").parquet(f"{path}/shards")


def _decoder(dictionary: bytes, sha: str):
    import zstandard

    if hashlib.sha256(dictionary).hexdigest() != sha:
        raise ValueError("the dictionary is not the one that the shards were written with")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_archive(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """A row per archived document: doc_id, start, n_tokens, ids_crc32, and ids if with_ids.

    start counts the ids of all documents before it. doc_ids: only these documents (a short list of wanted ids); other
    shards are skipped by their range and other frames by the offset index, without being decompressed.
    """
    dictionary = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"]))
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")
    # shards are summed within their part, and parts, a row for each task that wrote, in order
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", earlier(Window.orderBy("part")).alias("whole"))
    base = shards.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("inner")).join(parts, "part").select("part", "seq", (F.col("whole") + F.col("inner")).alias("base"))
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        overlap = F.lit(False)
        for d in sorted(wanted):
            overlap = overlap | ((F.col("first_id") <= d) & (F.col("last_id") >= d))
        shards = shards.where(overlap)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_with: dict[str, object] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: batch.column(n)[r] for n in ("part", "seq", "dict_sha256", "width", "doc_id", "n_tokens", "ends")}
                one = {k: v.as_py() for k, v in one.items()}
                unpress = open_with.get(one["dict_sha256"]) or open_with.setdefault(one["dict_sha256"], _decoder(dictionary.value, one["dict_sha256"]))
                frames = memoryview(batch.column("frames")[r].as_buffer())
                starts, first = np.concatenate([[0], np.cumsum(one["n_tokens"])]).tolist(), [0, *one["ends"]]
                out: dict[str, list] = {"doc_id": [], "local": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for k, doc in enumerate(one["doc_id"]):
                    if wanted is not None and doc not in wanted:
                        continue
                    raw = np.frombuffer(unpress.decompress(frames[first[k] : first[k + 1]]), f"<u{one['width']}").astype("<u4")
                    if len(raw) != one["n_tokens"][k]:
                        raise ValueError(f"document {doc}: the index and the frame disagree")
                    for name, v in zip(out, (doc, starts[k], len(raw), zlib.crc32(raw.tobytes()), raw.tolist() if with_ids else None), strict=True):
                        out[name].append(v)
                n = len(out["doc_id"])
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([one["part"]] * n, pa.int32()), "seq": pa.array([one["seq"]] * n, pa.int32())}
                    | {k: pa.array(v, pa.list_(pa.int64()) if k == "ids" else pa.int64()) for k, v in out.items()}
                )

    rows = shards.select("part", "seq", "dict_sha256", "width", "doc_id", "n_tokens", "ends", "frames").mapInArrow(decode, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long, ids array<bigint>")
    rows = rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return rows if with_ids else rows.drop("ids")


def archived(documents: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes an archive of the documents in the shared folder and reads all of it back."""
    path = new_path(documents.sparkSession, "tokens")
    write_archive(documents, path, vocabulary, end_id)
    return read_archive(documents.sparkSession, path)
