"""Importance resampling towards the distribution of a target corpus.

Features are the runs of 1 to `max_n` words of a text, joined by one blank; a
feature's bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`. A bucket's
gain is the logarithm of its share in the target over its share in all
documents, and a document's weight the sum over its features. Gumbel noise from
a hash of the doc_id makes the highest scores a sample without replacement.

Words are split, packed and looked up as arrays. A head vocabulary is broadcast:
the CRC states of frequent words, from which the CRC of a longer run goes on,
and the buckets of frequent pairs. It has a fixed size and is exact: an entry
holds the whole word (of up to 16 bytes), which is compared. What is not in it,
the tail, gets its CRC from its bytes, so that the head decides on speed alone.
Both feed the same totals, which count every feature of every document.

Texts are read twice (head, features). Features are kept as one histogram of
buckets for each document, of which totals and weights are taken; no text is
shuffled. What reaches the driver is the head and one number for each bucket.

Nulls: a null text has no words, a null doc_id draws noise as an empty one and
comes last among ties. Repeated rows count as often as they occur and are drawn
one by one, ties in any order. A text without words weighs 0. Very long texts
count whole, in no more entries than there are buckets. Without documents there
are no rows; without target texts all buckets have the target count 0. Columns
other than those named are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_worker, mixed, pieces_of, saved, small_batches, utf8
from .ranges import numbered

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 64
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _steps() -> np.ndarray:
    """The table of CRC-32 for one byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1).astype(np.uint32)
    return c


_CRC = _steps()


def crc32_on(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """zlib.crc32(data[start:end], state) of many spans at once."""
    n = end - start
    order = np.argsort(-np.minimum(n, _LONG + 1), kind="stable")
    c, at, size = ~state[order], start[order], n[order]
    long = int(np.searchsorted(-size, -_LONG, "left"))
    for k in range(int(min(size[long], _LONG)) if long < len(size) else 0):
        live = slice(long, int(np.searchsorted(-size, -k, "left")))
        c[live] = _CRC[(c[live] ^ data[at[live] + k]) & 255] ^ (c[live] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~c
    for k in order[:long].tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(state[k]))
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased texts that lie in data at offsets (from 0): start and end of each word, and the n + 1 word offsets of the texts."""
    inside = _IN_WORD[data]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    if len(data):
        first[1:], last[:-1] = ~inside[:-1], ~inside[1:]
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    return starts, np.flatnonzero(inside & last) + 1, np.searchsorted(starts, offsets)


def packed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first 16 bytes of each word as two numbers. No word holds a zero byte, so they tell words of up to 16 bytes apart."""
    room = np.append(data, np.zeros(16, np.uint8))
    both = np.lib.stride_tricks.sliding_window_view(room, 16)[start].copy()
    both[np.arange(16) >= (end - start)[:, None]] = 0
    return both.view("<u8")


def _slot(lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(lo ^ mixed(hi + _MULTIPLY)) >> np.uint64(64 - bits)).astype(np.int64)


class Head:
    """Frequent words with their CRC states and frequent pairs of them with their buckets. Of entries that want one slot the first has it, the others are tail."""

    def __init__(self, words: list[str], pairs: list[tuple[str, str]], buckets: int):
        raw = [w.encode() for w in words if len(w.encode()) <= 16]
        self.bits = max(4, len(raw).bit_length() + 2)
        data = np.frombuffer(b"".join(raw), np.uint8)
        end = np.cumsum([len(w) for w in raw], dtype=np.int64)
        start = end - np.array([len(w) for w in raw], np.int64)
        keys = packed(data, start, end) if raw else np.zeros((0, 2), np.uint64)
        self.entry = np.full(1 << self.bits, -1, np.int64)
        slots = _slot(keys[:, 0], keys[:, 1], self.bits)
        self.entry[slots[::-1]] = np.arange(len(raw))[::-1]
        self.keys, self.state = keys, crc32_on(np.zeros(len(raw), np.uint32), data, start, end) if raw else np.zeros(0, np.uint32)
        number = {w: k for k, w in enumerate(raw)}
        both = [(number[a], number[b], zlib.crc32(f"{x} {y}".encode()) % buckets) for x, y in pairs if (a := x.encode()) in number and (b := y.encode()) in number]
        self.pair_bits = max(4, len(both).bit_length() + 2)
        self.pair_keys = np.array([a * len(raw) + b for a, b, _ in both], np.uint64)
        self.pair_buckets = np.array([c for *_, c in both], np.int64)
        self.pair_entry = np.full(1 << self.pair_bits, -1, np.int64)
        self.pair_entry[_slot(self.pair_keys, self.pair_keys, self.pair_bits)[::-1]] = np.arange(len(both))[::-1]

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each word, -1 for the tail."""
        if not len(self.keys) or not len(start):
            return np.full(len(start), -1, np.int64)
        keys = packed(data, start, end)
        at = self.entry[_slot(keys[:, 0], keys[:, 1], self.bits)]
        return np.where((at >= 0) & (end - start <= 16) & (self.keys[at] == keys).all(1), at, -1)

    def find_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The bucket of each pair of entries, -1 for the tail."""
        if not len(self.pair_keys) or not len(a):
            return np.full(len(a), -1, np.int64)
        keys = (np.maximum(a, 0) * len(self.keys) + np.maximum(b, 0)).astype(np.uint64)
        at = self.pair_entry[_slot(keys, keys, self.pair_bits)]
        return np.where((at >= 0) & (a >= 0) & (b >= 0) & (self.pair_keys[at] == keys), self.pair_buckets[at], -1)


def feature_buckets(data: np.ndarray, offsets: np.ndarray, head: Head, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the text of each feature, and the number of words of each text."""
    start, end, words = words_of(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
    known = head.find(data, start, end)
    state = np.zeros(len(start), np.uint32)
    state[known >= 0] = head.state[known[known >= 0]]
    tail = np.flatnonzero(known < 0)
    state[tail] = crc32_on(state[tail], data, start[tail], end[tail])
    out, of = [(state % np.uint32(buckets)).astype(np.int64)], [owner]
    first = np.arange(len(start))  # of the runs that are n - 1 words long
    for n in range(2, max_n + 1):
        grows = first + n - 1 < len(start)
        grows[grows] = owner[first[grows] + n - 1] == owner[first[grows]]
        first, state = first[grows], state[grows]
        last = first + n - 1
        found = head.find_pairs(known[first], known[last]) if n == 2 else np.full(len(first), -1, np.int64)
        # states go on where the tail or a longer run needs them
        need = np.flatnonzero(found < 0) if n == max_n else np.arange(len(first))
        blank = ~state[need]
        blank = ~(_CRC[(blank ^ np.uint32(32)) & 255] ^ (blank >> np.uint32(8)))
        state[need] = crc32_on(blank, data, start[last[need]], end[last[need]])
        out.append(np.where(found >= 0, found, state % np.uint32(buckets)).astype(np.int64))
        of.append(owner[first])
    return np.concatenate(out), np.concatenate(of), np.diff(words)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for ranges of a column, lower-cased in A to Z."""
    data, off = utf8(column)
    for i, j in pieces_of(off):
        yield i, j, _LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]


def head_of(documents: DataFrame, max_n: int, words: int, pairs: int, summary: int = 1 << 14) -> tuple[list[str], list[tuple[str, str]]]:
    """The most frequent words and pairs of all documents, from summaries of bounded size. Which they are changes no result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        seen: dict[int, Counter] = {n: Counter() for n in range(1, min(max_n, 2) + 1)}
        for batch in batches:
            for _, _, data, off in _texts(batch.column("text")):
                start, end, at = words_of(data, off)
                short = end - start <= 16
                keys = packed(data, start, end)
                single = mixed(keys[:, 0] ^ mixed(keys[:, 1] + _MULTIPLY))
                raw = data.tobytes()
                for n, some in seen.items():
                    if n == 1:
                        live, key = np.flatnonzero(short), single[short]
                    else:
                        inner = np.ones(max(len(start) - 1, 0), bool)
                        inner[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(start))] - 1] = False
                        live = np.flatnonzero(inner & short[:-1] & short[1:])
                        key = mixed(single[live] * _MULTIPLY + single[live + 1]) if len(live) else np.zeros(0, np.uint64)
                    _, where, times = np.unique(key, return_index=True, return_counts=True)
                    for k in np.argsort(-times, kind="stable")[: summary // 4].tolist():
                        if times[k] > 1:
                            run = live[where[k]]
                            some[" ".join(raw[start[i] : end[i]].decode() for i in range(run, run + n))] += int(times[k])
                    if len(some) > 4 * summary:
                        seen[n] = Counter(dict(some.most_common(summary)))
        for n, some in seen.items():
            top = some.most_common(summary)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n] * len(top), pa.int32()), "feature": pa.array([f for f, _ in top], pa.string()), "times": pa.array([c for _, c in top], pa.int64())})

    totals = saved(documents.select("text").mapInArrow(count, "n int, feature string, times long").groupBy("n", "feature").agg(F.sum("times").alias("times")), "head")
    sums = {r["n"]: r["all"] for r in totals.groupBy("n").agg(F.sum("times").alias("all")).collect()}

    def best(n: int, most: int) -> list[str]:
        # those of at least a share of 1 in 4 * most are 4 * most at the most
        often = totals.where((F.col("n") == n) & (F.col("times") * (4 * most) >= sums.get(n, 0)))
        return [r["feature"] for r in often.orderBy(F.desc("times"), "feature").limit(most).collect()]

    return best(1, words), [tuple(f.split(" ")) for f in best(2, pairs)] if max_n > 1 else []


FEATURES = "n_words long, n_features long, buckets array<int>, counts array<int>"


def bucket_counts(documents: DataFrame, head: Head, max_n: int, buckets: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per text: the columns in keep, its numbers of words and features, and its buckets with their counts."""
    kept = documents.select(*keep, "text")
    shared = documents.sparkSession.sparkContext.broadcast(head)  # of a fixed number of entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for batch in batches:
            for i, j, data, off in _texts(batch.column("text")):
                found, of, words = feature_buckets(data, off, shared.value, max_n, buckets)
                each, times = np.unique(of * buckets + found, return_counts=True)
                ends = np.searchsorted(each, np.arange(j - i + 1) * buckets).astype(np.int32)
                listed = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (each % buckets, times)]
                own = [batch.column(c).slice(i, j - i) for c in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words.astype(np.int64)), pa.array(np.bincount(of, minlength=j - i)), *listed], [*keep, "n_words", "n_features", "buckets", "counts"])

    fields = "".join(f"`{c}` {kept.schema[c].dataType.simpleString()}, " for c in keep)
    return kept.mapInArrow(run, fields + FEATURES)


def totals(counted: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket. Each task sums up by itself; a number for each bucket comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy(), buckets).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(sums[some])})

    out = np.zeros(buckets, np.int64)
    for r in counted.select("buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in all documents, rounded down."""
    all_raw, all_target, m = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((t + 1) * float(all_raw + m) / ((s + 1) * float(all_target + m)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def resampled(documents: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, head_words: int = 1 << 14, head_pairs: int = 1 << 16) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those that are not drawn.

    Of the documents with at least `least_words` words `percent` in a hundred are drawn, those of the highest scores.
    target has a column text. max_n is the length of the longest run of words that is a feature.
    """
    small_batches(documents.sparkSession)
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    head = Head(*head_of(named, max_n, head_words, head_pairs), buckets)
    counted = saved(bucket_counts(named, head, max_n, buckets, ("doc_id",)), "features")
    gain = documents.sparkSession.sparkContext.broadcast(gains(totals(counted, buckets), totals(bucket_counts(target, head, max_n, buckets), buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            sums = np.concatenate([[0], np.cumsum(gain.value[lists.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy())]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(sums[ends[1:]] - sums[ends[:-1]])], ["doc_id", "n_words", "n_features", "weight"])

    weighed = counted.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("short", F.col("n_words") < least_words).withColumn("no", F.monotonically_increasing_id())
    order = (F.col("short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("no"))
    ranked = numbered(scored, *order)
    drawn = percent * counted.where(F.col("n_words") >= least_words).count() // 100
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
