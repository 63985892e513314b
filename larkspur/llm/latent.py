"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of `size` words at half that stride. Their TF-IDF matrix
over the words of the benchmark is compressed row-wise by a sparse random sign
matrix (one pass over all documents, which also counts document frequencies);
the singular vectors of the sketch, stacked on the benchmark's own rows, are the
latent space. Passages whose cosine with an item is high enough are candidates,
and are checked on words: the longest common subsequence has to hold nearly all
of the item, or most of it with the item's ending, its answer. Where `gram_words`
words in a row are those of an item the same check is made, whatever the cosine,
so that verbatim copies are found of items that have no weight in the space. Words of
most passages have none; an item of which they are most is met by `weak_gram_words`
in a row, so that its paraphrases are found as well.

A word that stands in few distinct contexts is as telling as one that occurs as
often as it has contexts: a leak that is copied everywhere keeps its weight.

Words are runs of letters, digits and bytes above 0x7F, ASCII in lower case.
Items of fewer than `gram_words` words can't be told from chance by likeness: they
are found where all of their words stand in a row. Of passages that are equally
like an item each is checked; the best one is told, ties by the higher cosine.

Nulls: null texts and items have no words, and items without words are in no
text. A null item_id or doc_id is carried. Repeated rows give their pairs once,
other texts of one doc_id pairs of their own. Very long texts are searched whole,
a passage at a time. Empty tables give no rows. Columns other than doc_id,
item_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_worker, mixed, pieces_of, saved, shingles, small_batches, utf8, word_hashes

REGISTERS = 64

_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def letter_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As word_chunks, with punctuation as white space."""
    data, off = utf8(column)
    for i, j in pieces_of(off):
        part = data[off[i] : off[j]]
        hashes, _, _, words = word_hashes(np.where(_INSIDE[part], part, np.uint8(32)), off[i : j + 1] - off[i], lower=True)
        yield i, j, hashes, words


class Terms:
    """The benchmark's words as columns: a bitmap answers for most other words without a search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.hashes & np.uint64((1 << 20) - 1)] = True

    def columns(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and columns of the words that have one."""
        at = np.flatnonzero(self.bitmap[hashes & np.uint64((1 << 20) - 1)])
        col = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        ok = self.hashes[col] == hashes[at]
        return at[ok], col[ok]


def strides(words: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """The first stride of each text, with one more at the end, and the stride of each word."""
    count = np.diff(words)
    own = -(-count // stride)
    first = np.concatenate([[0], np.cumsum(own)])
    inner = np.arange(words[-1]) - np.repeat(words[:-1], count)
    return first, np.repeat(first[:-1], count) + inner // stride


def contexts(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of each word with its neighbours in its text."""
    before, after = np.zeros_like(hashes), np.zeros_like(hashes)
    before[1:], after[:-1] = hashes[:-1], hashes[1:]
    filled = np.flatnonzero(np.diff(words))
    before[words[filled]] = 0
    after[words[filled + 1] - 1] = 0
    return mixed(mixed(mixed(before + np.uint64(1)) + hashes) + after)


def ranks(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The register of each hash, and the place of its first set bit."""
    rest = marks >> np.uint64(11)
    return (marks % np.uint64(REGISTERS)).astype(np.int64), 54 - np.frexp(rest.astype(np.float64))[1].astype(np.int64)


def distinct_of(registers: np.ndarray) -> np.ndarray:
    """HyperLogLog estimates, a row of registers each."""
    raw = 0.709 * REGISTERS**2 / np.exp2(-registers.astype(float)).sum(axis=1)
    none = (registers == 0).sum(axis=1)
    return np.where((raw <= 2.5 * REGISTERS) & (none > 0), REGISTERS * np.log(REGISTERS / np.maximum(none, 1)), raw)


def _statistics(terms, stride: int, sketch: int):
    """Of a task: the number of strides, the strides with each term, the sketch of their term counts and the registers of the terms' contexts, as one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        import zstandard

        vocabulary = terms.value
        d = len(vocabulary.hashes)
        total, df, rows = 0, np.zeros(d, np.int64), np.zeros(sketch * d, np.int64)
        registers = np.zeros(d * REGISTERS, np.int64)
        for batch in batches:
            for _, _, hashes, words in letter_words(batch.column("text")):
                first, at = strides(words, stride)
                total += int(first[-1])
                where, col = vocabulary.columns(hashes)
                register, rank = ranks(contexts(hashes, words)[where])
                np.maximum.at(registers, col * REGISTERS + register, rank)
                key, tf = np.unique(at[where] * d + col, return_counts=True)
                stride_no, col = key // d, key % d
                df += np.bincount(col, minlength=d)
                # a random row and sign for each stride, from what it holds, so that a second attempt draws the same
                marks = mixed(np.bincount(at, (hashes >> np.uint64(40)).astype(np.float64), int(first[-1])).astype(np.uint64) + np.uint64(1))
                row, sign = (marks % np.uint64(sketch)).astype(np.int64), np.where(marks >> np.uint64(63), 1, -1)
                np.add.at(rows, row[stride_no] * d + col, tf * sign[stride_no])
        data = np.concatenate([registers, [total], df, rows]).tobytes()
        yield pa.RecordBatch.from_pydict({"data": pa.array([zstandard.ZstdCompressor(level=1).compress(data)], pa.binary())})

    return run


def _summed(highest: int):
    """Blocks added up; of the first numbers the highest counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = None
        for batch in batches:
            for data in batch.column("data").to_pylist():
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int64)
                if total is None:
                    total = x.copy()
                else:
                    np.maximum(total[:highest], x[:highest], out=total[:highest])
                    total[highest:] += x[highest:]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"data": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})

    return run


def _space(counts: np.ndarray, d: int, sketch: int, items: np.ndarray, rank: int, most_share: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the terms and the latent space: a column for each term."""
    apart, counts = distinct_of(counts[: d * REGISTERS].reshape(d, REGISTERS)), counts[d * REGISTERS :]
    total, df, rows = max(1, int(counts[0])), counts[1 : d + 1], counts[d + 1 :].reshape(sketch, d)
    # copies of a passage say no more than one; the estimate counts only where it is clearly lower
    df = np.where(apart < df / 2, apart, df)
    # a word of most passages says nothing; in a small corpus a dozen passages are not most
    weight = np.where(df <= max(most_share * total, 12), np.log((total + 1) / (df + 1)), 0.0)
    corpus, own = rows * weight, items * weight
    # the benchmark's rows weigh as much as all passages do, else the space would be that of frequent passages alone
    matrix = np.concatenate([corpus * (np.linalg.norm(own) / max(np.linalg.norm(corpus), 1e-9)), own])
    # of d by d or rows by rows the smaller Gram matrix would do as well; rows are few
    _, s, v = np.linalg.svd(matrix, full_matrices=False)
    return weight, v[: min(rank, int((s > 1e-9 * max(s[0], 1e-300)).sum()) or 1)].T.astype(np.float32)


def common_length(item: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence; item: a bit mask of its positions for each of its n words."""
    v = full = (1 << n) - 1
    for w in words:
        m = item.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def gram_places(items: list[list[int]], n: int, most: int = 8) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Sorted hashes of n words in a row and the items and places that have them; of hashes that many items share only what an item needs."""
    own = [shingles(np.array(w, np.uint64), np.array([0, len(w)]), n)[0].tolist() for w in items]
    places: dict[int, list[tuple[int, int]]] = {}
    for k, grams in enumerate(own):
        for place, g in enumerate(grams):
            places.setdefault(g, []).append((k, place))
    needed = {(k, min(grams, key=lambda g: len(places[g]))) for k, grams in enumerate(own) if grams}
    kept = {g: [x for x in at if len(at) <= most or (x[0], g) in needed] for g, at in places.items()}
    order = sorted(g for g, at in kept.items() if at)
    return np.array(order, np.uint64), [kept[g] for g in order]


def short_places(items: list[tuple[int | None, list[int]]]) -> list[tuple[int, np.ndarray, list[list[tuple]]]]:
    """For each number of words: sorted hashes of the items of so many words, and the items that have each."""
    out = []
    for n in sorted({len(w) for _, w in items}):
        found: dict[int, list[tuple]] = {}
        for item in items:
            if len(item[1]) == n:
                found.setdefault(int(shingles(np.array(item[1], np.uint64), np.array([0, n]), n)[0][0]), []).append(item)
        out.append((n, np.array(sorted(found), np.uint64), [found[h] for h in sorted(found)]))
    return out


def _search(model, stride: int, cosine: float, likeness: float, certain: float, answer_words: int, mass_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        terms, weight, space, latent, norms, items, counts, by_grams, short = model.value
        in_rows = [(n, Terms(grams), places) for n, grams, places in by_grams]
        exact = [(n, Terms(h), own) for n, h, own in short]
        masks = [(item_id, len(w), _masks(w), _masks(w[-answer_words:]), min(answer_words, len(w))) for item_id, w in items]
        least = mass_share * float((norms[norms > 0] ** 2).min(initial=np.inf))
        seen = np.zeros(len(weight), np.float32)

        def held_share(item, low, high, hashes, all_where, all_col):
            """The share of an item that a stretch of words holds, if it is enough."""
            _, size, whole, ending, most = masks[item]
            held = all_col[np.searchsorted(all_where, low) : np.searchsorted(all_where, high)]
            seen[held] = 1
            most_common = counts[item] @ seen  # in whatever order
            seen[held] = 0
            if most_common < likeness * size:
                return None
            window = hashes[low:high].tolist()
            share = common_length(whole, size, window) / size
            if share >= certain or share >= likeness and common_length(ending, most, window) >= 0.6 * most:
                return share
            return None

        for batch in batches:
            found: list[tuple] = []
            ids = list(zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), strict=True))
            for i, j, hashes, words in letter_words(batch.column("text")):
                for n, known, own in exact:
                    in_row, begins = shingles(hashes, words, n)
                    spots, which = known.columns(in_row)
                    texts = np.searchsorted(begins, spots, "right") - 1
                    for x, g, t in zip(spots.tolist(), which.tolist(), texts.tolist(), strict=True):
                        begin = words[t] + x - begins[t]
                        found += [(*ids[i + t], item_id, 1.0, None) for item_id, w in own[g] if hashes[begin : min(begin + n, words[t + 1])].tolist() == w]
                if not items:
                    continue
                first, at = strides(words, stride)
                n = int(first[-1])
                all_where, all_col = terms.columns(hashes)
                met: set[tuple[int, int, int]] = set()
                for of_words, gram_terms, places in in_rows:
                    in_row, begins = shingles(hashes, words, of_words)
                    spots, which = gram_terms.columns(in_row)
                    texts = np.searchsorted(begins, spots, "right") - 1
                    met |= {(item, t, words[t] + x - begins[t] - place) for x, g, t in zip(spots.tolist(), which.tolist(), texts.tolist(), strict=True) for item, place in places[g]}
                for item, t, begin in met:
                    item_id, size = masks[item][:2]
                    share = held_share(item, max(words[t], begin - size), min(words[t + 1], begin + 2 * size), hashes, all_where, all_col)
                    if share is not None:
                        found.append((*ids[i + t], item_id, share, None))
                live = weight[all_col] > 0
                where, col = all_where[live], all_col[live]
                own = at[where]
                mass = np.bincount(own, weight[col] ** 2, n)
                ends = np.zeros(n, bool)
                ends[first[1:][np.diff(first) > 0] - 1] = True
                follow = np.where(ends, 0, np.append(mass[1:], 0))
                # a passage is a stride and the next one of its text
                chosen = np.flatnonzero(mass + follow >= least)
                if not len(chosen):
                    continue
                need = np.unique(np.concatenate([chosen, chosen[~ends[chosen]] + 1]))
                used = np.isin(own, need)
                o, c = own[used], col[used]
                cuts = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, int)
                vectors = np.zeros((len(need), space.shape[1]), np.float32)
                for lo in range(0, len(cuts), 4096):  # bounded memory, whatever the number of passages
                    hi = min(lo + 4096, len(cuts))
                    a, b = cuts[lo], cuts[hi] if hi < len(cuts) else len(o)
                    sums = np.add.reduceat(space[c[a:b]] * weight[c[a:b], None].astype(np.float32), cuts[lo:hi] - a, axis=0)
                    vectors[np.searchsorted(need, o[cuts[lo:hi]])] = sums
                here = np.searchsorted(need, chosen)
                passage = vectors[here]
                two = ~ends[chosen]
                passage[two] += vectors[here[two] + 1]
                length = np.linalg.norm(passage, axis=1)
                like = passage @ latent.T / np.maximum(length, 1e-9)[:, None]
                p, q = np.nonzero(like >= cosine)
                text = np.searchsorted(first, chosen[p], "right") - 1
                for k, t, item in zip(p.tolist(), text.tolist(), q.tolist(), strict=True):
                    item_id, size = masks[item][:2]
                    begin = words[t] + (int(chosen[k]) - int(first[t])) * stride
                    low, high = max(words[t], begin - stride), min(words[t + 1], begin + max(3 * stride, 2 * size))
                    share = held_share(item, low, high, hashes, all_where, all_col)
                    if share is not None:
                        found.append((*ids[i + t], item_id, share, float(like[k, item])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "mark", "item_id", "lcs_share", "cosine"])

    return run


FOUND = "doc_id long, mark long, item_id long, lcs_share double, cosine double"


def leaks(documents: DataFrame, benchmark: DataFrame, size: int = 64, rank: int = 256, sketch: int = 256, cosine: float = 0.35, likeness: float = 0.6, certain: float = 0.75, answer_words: int = 6, items_at_once: int = 1000, most_share: float = 0.05, gram_words: int = 8, mass_share: float = 0.4, weak_gram_words: int = 4, least_told: float = 0.5) -> DataFrame:
    """doc_id, mark (the xxhash64 of the text), item_id, lcs_share and cosine (of the best passage) for each document that holds an item.

    cosine is null where only words in a row led to the item. Passages are candidates whose weight is `mass_share` of
    the lightest item's at least.

    Items are searched in blocks of items_at_once, each with a latent space of its own, so that what is broadcast has
    a bound and the items may be any number.
    """
    import zstandard

    spark = documents.sparkSession
    small_batches(spark)
    stride = size // 2
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    count = benchmark.count()
    out = spark.createDataFrame([], FOUND)
    blocks = -(-count // items_at_once)
    numbered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for k in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").toArrow()  # about items_at_once
        items, short = [], []
        for i, j, hashes, words in letter_words(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())):
            for r in range(j - i):
                own = (rows.column("item_id")[i + r].as_py(), hashes[words[r] : words[r + 1]])
                if len(own[1]):
                    (items if len(own[1]) >= gram_words else short).append(own)
        if not items and not short:
            continue
        terms = Terms(np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64))
        d = len(terms.hashes)
        matrix = np.stack([np.bincount(np.searchsorted(terms.hashes, w), minlength=d) for _, w in items]).astype(float) if items else np.zeros((0, d))
        weight, space = np.zeros(d), np.zeros((d, 1), np.float32)
        if items:
            known = spark.sparkContext.broadcast(terms)
            parts = docs.select("text").mapInArrow(_statistics(known, stride, sketch), "data binary")
            # sums of a fixed size, added up in a tree
            sums = parts.repartition(8).mapInArrow(_summed(d * REGISTERS), "data binary").repartition(1).mapInArrow(_summed(d * REGISTERS), "data binary")
            got = sums.collect()
            if not got:
                continue
            counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(got[0]["data"]), np.int64)
            weight, space = _space(counts, d, sketch, matrix, rank, most_share)
        latent = (matrix * weight) @ space
        norms = np.linalg.norm(matrix * weight, axis=1)
        length = np.linalg.norm(latent, axis=1, keepdims=True)
        norms = np.where(length[:, 0] > 1e-9, norms, 0.0)  # such items are found by words in a row only
        latent = np.where(length > 1e-9, latent / np.maximum(length, 1e-9), 0.0).astype(np.float32)
        kept = [(a, w.tolist()) for a, w in items]
        by_grams = [(gram_words, *gram_places([w for _, w in kept], gram_words))]
        # items most of whose words say nothing in the space are met by fewer words in a row
        weak = np.flatnonzero((matrix * (weight > 0)).sum(axis=1) < least_told * matrix.sum(axis=1)).tolist()
        if weak:
            grams, places = gram_places([kept[k][1] for k in weak], weak_gram_words)
            by_grams.append((weak_gram_words, grams, [[(weak[k], place) for k, place in at] for at in places]))
        model = (terms, weight, space, latent, norms, kept, matrix.astype(np.float32), by_grams, short_places([(a, w.tolist()) for a, w in short]))
        searched = docs.mapInArrow(_search(spark.sparkContext.broadcast(model), stride, cosine, likeness, certain, answer_words, mass_share), FOUND)
        out = out.unionByName(searched)
    by_space = F.when(F.col("cosine").isNotNull(), F.struct("lcs_share", "cosine"))
    best = out.groupBy("doc_id", "mark", "item_id").agg(F.max("lcs_share").alias("lcs_share"), F.max(by_space).alias("b"))
    return saved(best.select("doc_id", "mark", "item_id", "lcs_share", "b.cosine"), "leaks")
