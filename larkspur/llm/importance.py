"""Quality by importance resampling.

Target text (documents labelled good) and raw text (all documents) are each
modelled by the shares of documents that hold a hashed n-gram: a token or two
tokens in a row. A token is a run of letters and digits or a run of other
characters; one that repeats the token before it is written as a repeat mark, so
that saying anything over and over is an n-gram of its own.

The log ratio of both models counts for an n-gram where its numbers in target
and raw text differ by more than chance (Poisson deviance: `nats` against a text,
an eighth of it in its favour), and against it only where target text has less
than a third (`telling`) of its share, so that many slight differences don't add
up against long texts. The log importance weight of a document is the
mean of the ratios in its favour and the sum of those against it: the ordinary
n-grams of a text all say the same thing, while a single one may be what is wrong
with it. Documents are then drawn without replacement by Gumbel top-k on these weights.

k is the number of documents above the weight that best parts good from other
labelled documents on a fifth of the labels that the models never saw.

Copies would count as evidence again and again: a labelled document counts as
one over the number of labelled ones that share its smallest pair of tokens, by
that of four hashes by which they are most, and raw counts shrink as those of the labelled documents do.

Nulls: a null text has no n-grams and weight 0. A label with a null doc_id,
quality or toxic is no label; a document with several labels is good if all of
them are. Rows of equal doc_id and text have one weight and are drawn together;
other texts of the doc_id are documents of their own. Documents that tie with
the last one drawn are kept. Very long texts are read whole. Without labels
every document is kept. An empty table gives no rows. Columns other than those
named here are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_to, lean_worker, mixed, partitions, pieces_of, prefix_sums, range_hash, saved, small_batches, utf8

BITS, BLOCK_BITS = 20, 14
#: Two tables of single tokens, since a rare one may share its bucket with a telling one, and one of pairs.
BUCKETS = 3 << BITS
_KIND = np.full(256, 2, np.uint8)
_KIND[:33] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts that lie in data at offsets (from 0), and the n + 1 token offsets of the texts."""
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(data))
    said = kind[starts] > 0
    starts, ends = starts[said], ends[said]
    hashes = range_hash(prefix_sums(data), starts, ends)
    at = np.searchsorted(starts, offsets)
    if len(hashes):
        again = np.append(False, hashes[1:] == hashes[:-1])
        again[at[:-1][np.diff(at) > 0]] = False
        hashes = np.where(again, _REPEAT, hashes)
    return hashes, at


def ngrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, text and hash of each distinct token, text and hash of each distinct pair) for ranges of the column."""
    data, off = utf8(column)
    most = np.uint64((1 << 44) - 1)
    for i, j in pieces_of(off):
        hashes, at = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
        owner = np.repeat(np.arange(j - i), np.diff(at)).astype(np.uint64) << np.uint64(44)
        inner = owner[1:] == owner[:-1]
        pairs = mixed(hashes[:-1] * np.uint64(0x2545F4914F6CDD1D) + hashes[1:])[inner]
        one = np.unique(owner | hashes & most)
        two = np.unique(owner[1:][inner] | pairs & most)
        yield i, j, (one >> np.uint64(44)).astype(np.int64), one & most, (two >> np.uint64(44)).astype(np.int64), two & most


def buckets(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two buckets of each token, and that of each pair."""
    low = np.uint64((1 << BITS) - 1)
    return (one & low).astype(np.int64), (one >> np.uint64(BITS) & low).astype(np.int64) + (1 << BITS), (two & low).astype(np.int64) + (2 << BITS)


def labelled(labels: DataFrame, most: int) -> DataFrame:
    """doc_id, good and held (a fifth kept from fitting) for at most `most` labelled documents, chosen by hash."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null")
    each = clean.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    order = F.xxhash64("doc_id", F.lit(17))
    return each.orderBy(order, "doc_id").limit(most).withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(5)) == 0)


def with_shares(documents: DataFrame, labels: DataFrame, hashes: int = 4) -> DataFrame:
    """The labels with share: one over the number of labelled documents with the same smallest pair of tokens, in that of several orders in which they are most."""
    factors = np.random.default_rng(3).integers(0, 1 << 62, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            low = np.zeros((batch.num_rows, hashes), np.uint64)
            for i, _, _, _, text, pair in ngrams(batch.column("text")):
                if len(text):
                    new = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                    for k, f in enumerate(factors):
                        low[i + text[new], k] = np.minimum.reduceat(mixed(pair * f), new)
            ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), hashes)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids), "k": pa.array(np.tile(np.arange(hashes), batch.num_rows)), "low": pa.array(low.ravel().view(np.int64))})

    found = documents.join(F.broadcast(labels.select("doc_id")), "doc_id").mapInArrow(smallest, "doc_id long, k long, low long").groupBy("doc_id", "k").agg(F.min("low").alias("low"))
    found = saved(found, "smallest")
    sizes = found.groupBy("k", "low").agg(F.count("*").alias("n"))
    shares = joined_to(found, sizes, ["k", "low"], "n", max(1, found.count())).groupBy("doc_id").agg((1 / F.max("n")).alias("share"))
    return labels.join(shares, "doc_id")


def log_ratio(raw: np.ndarray, seen: np.ndarray, single: np.ndarray, target: np.ndarray, totals: np.ndarray, nats: float, telling: float) -> np.ndarray:
    """log of target to raw share for buckets, 0 where chance explains the difference, or where it says little against a text.

    raw: documents with the bucket. seen, single: labelled ones, and the sum of their shares. target: the sum of the
    shares of good ones. totals: the same four of all documents.
    """
    # raw documents less their copies, in the measure of the target
    expected = raw * np.where(seen > 0, single / np.maximum(seen, 1), 1.0)
    expected *= totals[3] / max(totals[0] * totals[2] / max(totals[1], 1), 1e-300)
    deviance = target * np.log(np.maximum(target, 1e-300) / np.maximum(expected, 1e-300)) - target + expected
    ratio = np.log((target + 1) / (expected + 1))
    return np.where((deviance >= np.where(ratio > 0, nats / 8, nats)) & ((ratio > 0) | (ratio < -math.log(telling))), ratio, 0.0)


def fit(marked: DataFrame, nats: float = 8.0, telling: float = 3.0) -> np.ndarray:
    """The log ratio of each bucket, from all documents. Counts are added up in blocks of buckets; the driver gets the ratios that aren't 0."""
    import zstandard

    names, width = 4, 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        sums = np.zeros((names, BUCKETS), np.float32)
        totals = np.zeros(names)
        for batch in batches:
            fitting = np.array([g is not None and not h for g, h in zip(batch.column("good").to_pylist(), batch.column("held").to_pylist(), strict=True)])
            good = np.array([bool(g) for g in batch.column("good").to_pylist()])
            share = np.nan_to_num(batch.column("share").to_numpy(zero_copy_only=False)) * fitting
            totals += (batch.num_rows, fitting.sum(), share.sum(), (share * good).sum())
            for i, j, t1, one, t2, two in ngrams(batch.column("text")):
                a, b, c = buckets(one, two)
                text, bucket = np.concatenate([t1, t1, t2]), np.concatenate([a, b, c])
                np.add.at(sums[0], bucket, np.float32(1))
                own = fitting[i:j][text]
                text, bucket = text[own] + i, bucket[own]
                np.add.at(sums[1], bucket, np.float32(1))
                np.add.at(sums[2], bucket, share[text].astype(np.float32))
                np.add.at(sums[3], bucket, (share * good)[text].astype(np.float32))
        press = zstandard.ZstdCompressor(level=1)
        data = [press.compress(np.ascontiguousarray(sums[:, k : k + width]).tobytes()) for k in range(0, BUCKETS, width)] + [press.compress(totals.tobytes())]
        block = [*range(len(data) - 1), -1]
        yield pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int32()), "data": pa.array(data, pa.binary())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(open_.decompress(data), np.float64 if block < 0 else np.float32).astype(np.float64)
                held[block] = held[block] + x if block in held else x
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int32()), "data": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    counted = marked.select("text", "good", "held", "share").mapInArrow(count, "block int, data binary")
    sums = saved(counted.repartition(min(64, partitions(marked.sparkSession)), "block").mapInArrow(total, "block int, data binary"), "counts")
    whole = sums.where("block = -1").first()
    totals = np.frombuffer(whole["data"], np.float64) if whole else np.zeros(names)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
                r = log_ratio(*np.frombuffer(data, np.float64).reshape(names, width), totals, nats, telling)
                at = np.flatnonzero(r)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(block * width + at), "ratio": pa.array(r[at])})

    ratio = np.zeros(BUCKETS)
    if totals[3]:
        rows = sums.where("block >= 0").mapInArrow(sparse, "bucket long, ratio double").toArrow()  # BUCKETS rows at most
        ratio[rows.column("bucket").to_numpy()] = rows.column("ratio").to_numpy()
    return ratio


def weights(column: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """The log importance weight of each text."""
    out = np.zeros(len(column))
    for i, j, t1, one, t2, two in ngrams(column):
        a, b, c = buckets(one, two)
        # of both tables the one that says less
        single = np.where(np.abs(ratio[a]) <= np.abs(ratio[b]), ratio[a], ratio[b])
        text, r = np.concatenate([t1, t2]), np.concatenate([single, ratio[c]])
        above = np.maximum(r, 0)
        out[i:j] = np.bincount(text, np.minimum(r, 0), j - i) + np.bincount(text, above, j - i) / np.maximum(np.bincount(text[above > 0], minlength=j - i), 1)
    return out


def weighed(marked: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, mark, good, held, rest and log_weight of every document."""
    model = marked.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))  # of a fixed size
    kept = ("doc_id", "mark", "good", "held", "rest")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            weight = pa.array(weights(batch.column("text"), model.value).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), weight], [*kept, "log_weight"])

    rest = marked.schema["rest"].dataType.simpleString()
    return marked.select(*kept, "text").mapInArrow(weigh, f"doc_id long, mark long, good boolean, held boolean, rest {rest}, log_weight double")


def best_cut(rows: DataFrame, care: float) -> float:
    """The weight from which on held-out documents count as good, at the best mean of both classes' accuracies, that of good ones counting `care` times."""
    step = 0.25
    found = rows.where("held and good is not null").groupBy(F.floor(F.greatest("log_weight", F.lit(-1000.0)) / step).alias("bin"), "good").count().collect()  # at most 8000 rows
    good, other = {r["bin"]: r["count"] for r in found if r["good"]}, {r["bin"]: r["count"] for r in found if not r["good"]}
    if not good or not other:
        return -math.inf
    n_good, n_other, below_good, below_other, best, cut = sum(good.values()), sum(other.values()), 0, 0, care / (care + 1), -math.inf
    for b in sorted({*good, *other}):
        # everything below this bin is rejected
        if (score := (care * (1 - below_good / n_good) + below_other / n_other) / (care + 1)) > best:
            best, cut = score, b * step
        below_good, below_other = below_good + good.get(b, 0), below_other + other.get(b, 0)
    return cut


def kth_largest(rows: DataFrame, column: str, k: int, most: int = 4096) -> float:
    """The k-th largest value of a column, by histograms of `most` bins that close in on it; the driver gets `most` rows a round."""
    ends = rows.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    low, high, above = ends["a"], ends["b"], 0
    while True:
        width = (high - low) / most
        if width <= 0 or low + width == low:
            return low
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        bins = sorted(inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(most - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect(), key=lambda r: -r["bin"])
        for r in bins:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["a"] == r["b"] or (r["a"], r["b"]) == (low, high):
            return r["a"]
        low, high = r["a"], r["b"]


def _marked(documents: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    rest = F.struct(*carry) if carry else F.lit(0)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    return docs.withColumn("mark", F.xxhash64("text"))


def _keyed(rows: DataFrame, temperature: float) -> DataFrame:
    """Rows with key: the log weight with Gumbel noise that follows from the document."""
    uniform = (F.xxhash64("doc_id", "mark", F.lit(41)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return rows.withColumn("key", F.col("log_weight") - F.lit(temperature) * F.log(-F.log(uniform)))


def _drawn(documents: DataFrame, labels: DataFrame, most_labels: int, temperature: float, care: float, keep: int | None, nats: float, telling: float) -> tuple[np.ndarray, DataFrame, float]:
    """The model, the weights and keys of all documents, and the least key that is drawn."""
    small_batches(documents.sparkSession)
    docs = _marked(documents)
    known = saved(with_shares(docs.select("doc_id", "text"), saved(labelled(labels, most_labels), "labels")), "labels")
    marked = docs.join(F.broadcast(known), "doc_id", "left")  # most_labels rows at most
    ratio = fit(marked, nats, telling)
    rows = saved(_keyed(weighed(marked, ratio).drop("rest"), temperature), "weights")
    if keep is None:
        cut = best_cut(rows, care)
        keep = rows.where(F.col("log_weight") >= cut).count() if cut > -math.inf else rows.count()
    return ratio, rows, kth_largest(rows, "key", keep) if keep > 0 and not rows.isEmpty() else math.inf


def resampled(documents: DataFrame, labels: DataFrame, most_labels: int = 50_000, temperature: float = 1.0, care: float = 4.0, keep: int | None = None, nats: float = 8.0, telling: float = 3.0) -> DataFrame:
    """doc_id, mark (the xxhash64 of the text), log_weight, key and kept for every document.

    most_labels bounds the labelled documents that the target model is fitted on. temperature scales the Gumbel noise
    on the log weights; 1 draws in proportion to the weights. care: how many times a good document's loss counts
    against a bad one kept, in choosing k. keep: how many documents to draw, if not as many as the held-out labels
    suggest. Documents that tie with the last one drawn are kept too.
    """
    _, rows, last = _drawn(documents, labels, most_labels, temperature, care, keep, nats, telling)
    return rows.select("doc_id", "mark", "log_weight", "key", (F.col("key") >= last).alias("kept"))


def kept_documents(documents: DataFrame, labels: DataFrame, columns: tuple[str, ...], most_labels: int = 50_000, temperature: float = 1.0, care: float = 4.0, keep: int | None = None, nats: float = 8.0, telling: float = 3.0) -> DataFrame:
    """The given columns of the documents that resampled keeps. They are weighed once more rather than joined, which would shuffle all texts."""
    ratio, _, last = _drawn(documents, labels, most_labels, temperature, care, keep, nats, telling)
    docs = _marked(documents, columns).withColumns({"good": F.lit(None).cast("boolean"), "held": F.lit(None).cast("boolean")})
    return _keyed(weighed(docs, ratio), temperature).where(F.col("key") >= last).select("rest.*")
