"""N-gram Jaccard self-join by MinHash banding.

Each text gets `bands * rows` one-byte minima of its shingle hashes; texts that
agree in all rows of a band meet in that band's bucket. Bands and rows are chosen
for a target recall at the threshold. A pair is looked at in the first band that
it agrees in, and passes if the minima make the threshold at all likely; what
passes ties texts into groups, and within each group all pairs are verified on
their full shingle sets.

Equal texts are one class, counted but never paired. Buckets and groups of any
size are cut into blocks, and pairs of blocks are the unit of work; blocks give
link counts and a spanning forest, so no pair of a large group is ever a row.

Words are runs of bytes above 0x20, ASCII letters in lower case. A text of fewer
than n words is one shingle. Nulls: null texts and texts without words link with
nothing. A null doc_id takes no part. Rows of equal doc_id count separately.
Very long texts have sets of all their shingles. An empty table gives no rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_worker, mixed, partitions, saved, shingles, small_batches, utf8, word_chunks
from .components import component_labels, forest

SKETCH_BLOCK, SET_BLOCK = 2048, 512


def stated_recall(threshold: float, bands: int, rows: int, floor: float) -> float:
    """The least probability that a pair at the threshold is verified: that a band agrees, and that a share `floor` of all minima does."""
    n = bands * rows
    few = sum(math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(math.ceil(floor * n)))
    return 1 - (1 - threshold**rows) ** bands - few


def banding(threshold: float, recall: float, floor: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows, with the most rows (and so the fewest idle meetings) that find a pair at the threshold with the wanted probability."""
    for rows in range(12, 0, -1):
        for bands in range(1, most // rows + 1):
            if stated_recall(threshold, bands, rows, floor) >= recall:
                return bands, rows
    raise ValueError("the recall can't be reached with so few hashes")


def sketches(hashes: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """One byte for each of count minima, by text; texts have one shingle at least."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(5)
    flips, factors = rng.integers(0, 1 << 32, count, dtype=np.uint32), rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(offsets) - 1, count), np.uint8)
    y = np.empty_like(x)
    for k in range(count):
        np.bitwise_xor(x, flips[k], out=y)
        np.multiply(y, factors[k], out=y)
        low = np.minimum.reduceat(y, offsets[:-1])
        low = (low ^ (low >> np.uint32(13))) * np.uint32(0x9E3779B1)
        out[:, k] = low >> np.uint32(24)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches sorted by key; a run is bounded by two blocks."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        both = pa.Table.from_batches(held)
        keys = both.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield both.slice(0, cut)
            held = both.slice(cut).combine_chunks().to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def by_blocks(df: DataFrame, key: str, size: str, block: int, item: str) -> DataFrame:
    """Rows dealt to pairs of blocks of their key: adds `unit`, a number of the pair, and `block`, this row's own one of the two."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(item, F.lit(3)), blocks).cast("int")
    spread = df.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.withColumn("unit", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))).drop("other")


def _sketch_rows(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        import xxhash

        for batch in batches:
            data, off = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, hashes, words in word_chunks(batch.column("text")):
                grams, at = shingles(hashes, words, n)
                live = np.flatnonzero(np.diff(at))
                if not len(live):
                    continue
                made = sketches(grams, np.append(at[live], at[-1]), bands * rows)
                names = [xxhash.xxh3_128_digest(data[off[i + k] : off[i + k + 1]].tobytes()) for k in live]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[i + live], pa.int64()), "mark": batch.column("mark").take(pa.array(i + live)), "name": pa.array(names, pa.binary()), "sketch": pa.array([r.tobytes() for r in made], pa.binary())})

    return run


def _likely(bands: int, rows: int, floor: float) -> Callable:
    """Spanning forests of the pairs of a unit that agree first in its band, and in a share `floor` of all minima."""

    def pairs(x: np.ndarray, y: np.ndarray, band: int) -> np.ndarray:
        hit = np.zeros((len(x), len(y)), bool)
        for at in range(0, len(x), 128):
            same = x[at : at + 128, None, :] == y[None, :, :]
            ok = same.mean(2) >= floor
            if ok.any():
                a, b = np.nonzero(ok)
                agreed = same[a, b].reshape(len(a), bands, rows).all(2)
                ok[a, b] = agreed.argmax(1) == band
                ok[a, b] &= agreed.any(1)
            hit[at : at + 128] = ok
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for t in whole_runs(batches, "unit"):
            keys = t.column("unit").to_numpy()
            reps, block, band = t.column("rep").to_numpy(), t.column("block").to_numpy(), t.column("band").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(keys), bands * rows)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            two = last - first == 2
            left, right = [], []
            if two.any():  # most buckets hold two texts
                a, b = first[two], first[two] + 1
                same = sketch[a] == sketch[b]
                agreed = same.reshape(len(a), bands, rows).all(2)
                ok = (same.mean(1) >= floor) & (agreed.argmax(1) == band[a]) & agreed.any(1)
                left.append(a[ok])
                right.append(b[ok])
            for s, e in zip(first[~two], last[~two], strict=True):
                if e - s < 2:
                    continue
                own = block[s:e]
                p = s + np.flatnonzero(own == own.min())
                q = s + np.flatnonzero(own == own.max())
                hit = pairs(sketch[p], sketch[q], band[s])
                if own.min() == own.max():
                    hit = np.triu(hit, 1)
                a, b = np.nonzero(hit)
                left.append(p[a])
                right.append(q[b])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                if len(a):
                    root = forest(len(keys), a, b)
                    moved = np.flatnonzero(root != np.arange(len(keys)))
                    yield pa.RecordBatch.from_pydict({"a": pa.array(reps[moved], pa.int64()), "b": pa.array(reps[root[moved]], pa.int64())})

    return run


def _set_rows(n: int):
    """Distinct shingles of each text, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        import xxhash

        for batch in batches:
            for i, j, hashes, words in word_chunks(batch.column("text")):
                grams, at = shingles(hashes, words, n)
                some = batch.slice(i, j - i)
                # another text may have the same doc_id
                own = [k for k, (t, name) in enumerate(zip(some.column("text").to_pylist(), some.column("name").to_pylist(), strict=True)) if xxhash.xxh3_128_digest(t.encode()) == name]
                sets = [np.unique(grams[at[k] : at[k + 1]]).tobytes() for k in own]
                yield pa.RecordBatch.from_pydict({c: some.column(c).take(pa.array(own, pa.int64())) for c in ("rep", "n", "home", "members")} | {"grams": pa.array(sets, pa.binary())})

    return run


def overlaps(sets: list[np.ndarray], home: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets with the same home."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    grams = grams ^ mixed(home.astype(np.uint64))[owner]  # texts of different homes share no shingle
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(grams)))
    # shingles that the same texts hold count together
    marks = np.random.default_rng(11).integers(0, 1 << 63, n, dtype=np.uint64)
    held = np.add.reduceat(marks[owner], first) if len(first) else np.zeros(0, np.uint64)
    shared = np.flatnonzero(count > 1)
    _, pick, weight = np.unique(held[shared], return_index=True, return_counts=True)
    first, count = first[shared][pick], count[shared][pick]
    out = np.zeros(n * n, np.float64)
    for c in range(2, 17):
        own = np.flatnonzero(count == c)
        if len(own):
            texts = owner[first[own][:, None] + np.arange(c)]
            for p in range(c):
                for q in range(p + 1, c):
                    out += np.bincount(texts[:, p] * n + texts[:, q], weights=weight[own], minlength=n * n) if len(own) > n * n // 8 else 0
                    if len(own) <= n * n // 8:
                        np.add.at(out, texts[:, p] * n + texts[:, q], weight[own])
    out = out.reshape(n, n)
    wide = np.flatnonzero(count > 16)
    for at in range(0, len(wide), 2048):
        own = wide[at : at + 2048]
        has = np.zeros((n, len(own)), np.float32)
        has[owner[np.concatenate([np.arange(f, f + c) for f, c in zip(first[own], count[own], strict=True)])], np.repeat(np.arange(len(own)), count[own])] = 1
        out += np.triu((has * weight[own]) @ has.T, 1)
    return out


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for t in whole_runs(batches, "unit", 256):
            keys = t.column("unit").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            reps, sizes, homes, block = (t.column(c).to_numpy() for c in ("rep", "n", "home", "block"))
            raw = t.column("grams").combine_chunks()
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e - s < 2:
                    continue
                _, once = np.unique(reps[s:e], return_index=True)  # repeated rows give their class more than once
                pick = s + np.sort(once)
                sets = [np.frombuffer(raw[int(k)].as_buffer(), np.uint64) for k in pick]
                lengths = np.array([len(x) for x in sets])
                common = overlaps(sets, homes[pick])
                union = lengths[:, None] + lengths[None, :] - common
                a, b = np.nonzero((common > 0) & (common >= threshold * union - 1e-9))
                own = block[pick]
                if own.min() != own.max():  # pairs within a block belong to that block's own unit
                    across = own[a] != own[b]
                    a, b = a[across], b[across]
                if not len(a):
                    continue
                links = np.bincount(a, sizes[pick][b], len(pick)) + np.bincount(b, sizes[pick][a], len(pick))
                root = forest(len(pick), a, b)
                live = np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({"rep": pa.array(reps[pick][live], pa.int64()), "links": pa.array(links[live].astype(np.int64)), "root": pa.array(reps[pick][root[live]], pa.int64())})

    return run


def near_copies(documents: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995) -> DataFrame:
    """doc_id, mark, class_id, n_links and kept for every row: mark is the xxhash64 of the text, class_id the smallest doc_id
    that links lead to, n_links the number of other documents with a similarity of threshold or more, equal ones included.
    kept holds for one text of each class, that of the smallest doc_id (of several such texts, of the smallest hash), and
    for all rows that repeat it exactly.

    recall is that of a pair just at the threshold; it counts both the banding and the share of minima that is asked for
    before a pair is verified.
    """
    spark = documents.sparkSession
    small_batches(spark)
    floor = threshold - 0.3
    bands, rows = banding(threshold, recall, floor)
    deal = partitions(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    known = docs.where("doc_id is not null and text is not null")

    marked = saved(known.mapInArrow(_sketch_rows(bands, rows, n), "doc_id long, mark long, name binary, sketch binary"), "sketches")
    by_name = marked.groupBy("name").agg(F.min(F.struct("doc_id", "mark")).alias("d"), F.count("*").alias("n"), F.first("sketch").alias("sketch"))
    classes = saved(by_name.select("name", F.col("d.doc_id").alias("doc"), F.col("d.mark").alias("mark"), "n", "sketch", F.xxhash64("name").alias("rep")), "classes")

    # buckets of one text are most of all, and go before anything is attached to the others
    keyed = classes.select("rep", F.posexplode(F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 1 + k * rows, rows)) for k in range(bands)])).alias("band", "bucket"))
    sizes = saved(keyed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    met = keyed.join(sizes, "bucket").join(classes.select("rep", "sketch"), "rep")
    units = by_blocks(met, "bucket", "members", SKETCH_BLOCK, "rep").select("unit", "block", "band", "rep", "sketch")
    likely = units.repartition(deal, "unit").sortWithinPartitions("unit").mapInArrow(_likely(bands, rows, floor), "a long, b long")
    groups = saved(component_labels(likely), "likely")

    # facts of groups and classes are written before rows are joined to them, so that Spark can split a frequent key's rows
    # small groups share a unit, large ones are cut into blocks
    counted = saved(groups.groupBy("label").agg(F.count("*").alias("members")), "groups")
    grouped = groups.count()
    shelves = max(1, grouped // 128)
    placed = groups.join(counted, "label").select(F.col("id").alias("rep"), F.col("label").alias("home"), "members")
    placed = placed.join(classes.select("rep", "doc", "mark", "name", "n"), "rep")
    sets = known.join(placed.withColumnRenamed("doc", "doc_id"), ["doc_id", "mark"]).mapInArrow(_set_rows(n), "rep long, n long, home long, members long, grams binary")
    small = F.col("members") <= SET_BLOCK // 8
    shelf = sets.withColumn("key", F.when(small, F.pmod(F.xxhash64("home"), F.lit(shelves))).otherwise(F.xxhash64("home"))).withColumn("size", F.when(small, 1).otherwise(F.col("members")))
    tasks = by_blocks(shelf, "key", "size", SET_BLOCK, "rep").select("unit", "block", "rep", "n", "home", "grams")
    links = saved(tasks.repartition(deal, "unit").sortWithinPartitions("unit").mapInArrow(_verified(threshold), "rep long, links long, root long"), "links")

    labels = component_labels(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    linked = saved(labels.join(classes.select("rep", "doc", "name"), "rep"), "labels")
    smallest = saved(linked.groupBy("label").agg(F.min(F.struct("doc", "name")).alias("first")), "smallest")
    tied = linked.select("rep", "label").join(smallest, "label").select("rep", "first")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.select("name", "rep", "doc", "n").join(counts, "rep", "left").join(tied, "rep", "left")
    own = F.struct(F.col("doc"), F.col("name"))
    by_class = by_class.select("name", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("first", own).alias("first"))
    out = marked.select("doc_id", "mark", "name").join(saved(by_class, "linked"), "name")
    out = out.select("doc_id", "mark", F.col("first.doc").alias("class_id"), "n_links", ((F.col("doc_id") == F.col("first.doc")) & (F.col("name") == F.col("first.name"))).alias("kept"))
    # texts without words took no part so far
    empty = docs.where(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.coalesce(F.col("text").rlike("[^\\x00-\\x20]"), F.lit(False)))
    return out.union(empty.select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(0).cast("long"), F.lit(True)))
