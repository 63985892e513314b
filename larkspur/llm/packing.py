"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become pieces of at most `capacity` tokens. Pieces are dealt at random
into blocks of bounded size, and each block is a bin-packing problem of its own
that several islands evolve at once: an individual is a list of bins, crossover
injects filled bins of one parent whole into the other, whose bins with the same
pieces are dissolved together with its loose ones, and what that displaces is
placed by best fit, or, in half of the children, by the set of displaced pieces
that fits best next to each large one. A block's evolution ends where its bins
are as few as its tokens allow. Between epochs each island's best packing
migrates to the next island of the block. At an island's end loose bins and a few
others are dissolved and dealt anew as long as it does no harm, which gathers the
free room in few bins. Pieces of bins that aren't full meet again in further rounds.

Nulls: a null text counts as empty (its end id alone). A null doc_id is kept.
Repeated rows are packed as often as they occur, each in a block of its own
drawing; which of several equal ones lies where is the only thing that may differ
between runs or partitionings. Pieces of equal length go in order of their numbers. Very long texts become as many pieces as they need. An empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches
from .encode import encoder
from .ranges import numbered

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """A row per piece; only documents longer than capacity are cut, the first piece taking what is left over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                ids, off = encoder(vocabulary).encode(some.column("text"))
                raw = memoryview(ids.astype("<u4").tobytes())
                out: list[list] = [[], [], [], [], []]
                for doc, a, z in zip(some.column("doc_id").to_pylist(), off.tolist(), off[1:].tolist(), strict=False):
                    n = z - a + 1
                    cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                    for k, (b, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        crc = zlib.crc32(raw[4 * (a + b) : 4 * min(a + e, z)])
                        for c, v in zip(out, (doc, k, b, e - b, zlib.crc32(end, crc) if e == n else crc), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class Bins:
    """A packing: bins of items, and how full they are. Bins under construction are found by their free room: bit f of `mask` is set if one has f tokens free."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_free, self.bins, self.fills = capacity, 0, [[] for _ in range(capacity + 1)], [], []

    def add(self, items: list[int], fill: int) -> None:
        free = self.capacity - fill
        self.by_free[free].append(len(self.bins))
        self.mask |= 1 << free
        self.bins.append(items)
        self.fills.append(fill)

    def best_fit(self, item: int, size: int) -> None:
        fitting = self.mask >> size
        if not fitting:
            self.add([item], size)
            return
        free = size + (fitting & -fitting).bit_length() - 1
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask ^= 1 << free
        self.bins[at].append(item)
        self.fills[at] += size
        self.by_free[free - size].append(at)
        self.mask |= 1 << (free - size)

    def best_fits(self, items: list[int], sizes: list[int]) -> "Bins":
        """The items one by one, the largest first, each where least room is left."""
        for i in sorted(items, key=sizes.__getitem__, reverse=True):
            self.best_fit(i, sizes[i])
        return self

    def best_sets(self, items: list[int], sizes: list[int], rng: random.Random, most: int = 48) -> "Bins":
        """A new bin for the largest item and the set of others, of `most` drawn ones, that leaves least room, and so on."""
        left = sorted(items, key=sizes.__getitem__)
        keys = [sizes[i] for i in left]
        while left:
            own, gap = [left.pop()], self.capacity - keys.pop()
            n = bisect.bisect_right(keys, gap)
            drawn = sorted(range(n) if n <= most else rng.sample(range(n), most), reverse=True)
            # bit t of sums: some of the items so far have t tokens together
            sums, full, steps = 1, (1 << (gap + 1)) - 1, []
            for k in drawn:
                steps.append(sums)
                sums |= (sums << keys[k]) & full
                if sums >> gap & 1:
                    break
            t = sums.bit_length() - 1
            fill = self.capacity - gap + t
            taken = []
            for k, before in zip(drawn[len(steps) - 1 :: -1] if steps else [], reversed(steps), strict=True):
                if not before >> t & 1:
                    taken.append(k)
                    t -= keys[k]
            for k in taken:  # in ascending order
                own.append(left[k])
            for k in reversed(taken):
                del left[k], keys[k]
            self.add(own, fill)
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return -len(self.bins), sum(f * f for f in self.fills) / self.capacity**2


def cross(mother: Bins, father: Bins, sizes: list[int], rng: random.Random) -> Bins:
    """mother's bins, with some of father's filled bins injected whole."""
    tight = mother.capacity - 1
    filled = [k for k, f in enumerate(father.fills) if f >= tight]
    taken = rng.sample(filled, rng.randint(1, len(filled))) if filled else []
    inside = {i for k in taken for i in father.bins[k]}
    child, displaced = Bins(mother.capacity), []
    for k in taken:
        child.add(list(father.bins[k]), father.fills[k])
    for items, fill in zip(mother.bins, mother.fills, strict=True):
        if not inside.isdisjoint(items):
            displaced += [i for i in items if i not in inside]
        # mutation: loose bins are dissolved too, and now and then a filled one, so that their room is dealt anew
        elif fill < tight or rng.random() < 0.05:
            displaced += items
        else:
            child.add(list(items), fill)
    return child.best_sets(displaced, sizes, rng) if rng.random() < 0.5 else child.best_fits(displaced, sizes)


def settled(packing: Bins, sizes: list[int], rng: random.Random, steps: int, least: int) -> Bins:
    """packing after mutations that it doesn't suffer from: a few bins, loose ones above all, are dissolved and dealt anew
    by best sets, which stays if they are fewer then, or as many and no less uneven. So free room gathers in few bins, until
    one of them is left out."""
    capacity, bins, fills = packing.capacity, [list(b) for b in packing.bins], list(packing.fills)
    count, loose = len(bins), []
    for step in range(steps):
        if count <= least:
            break
        if step % 32 == 0:
            loose = [k for k, f in enumerate(fills) if f < capacity]
        if len(loose) < 2:
            break
        drawn = {min(rng.sample(loose, min(len(loose), 12)), key=fills.__getitem__), *rng.sample(loose, min(len(loose), rng.randint(2, 6))), *rng.sample(range(len(bins)), min(len(bins), rng.randint(0, 3)))}
        drawn = [k for k in sorted(drawn) if bins[k]]
        items = [i for k in drawn for i in bins[k]]
        rng.shuffle(items)
        new = Bins(capacity).best_sets(items, sizes, rng)
        if (len(drawn) - len(new.bins), sum(f * f for f in new.fills)) >= (0, sum(fills[k] ** 2 for k in drawn)):
            count -= len(drawn) - len(new.bins)
            for j, k in enumerate(drawn):
                # a bin that is no more counts as full
                bins[k], fills[k] = (new.bins[j], new.fills[j]) if j < len(new.bins) else ([], capacity)
    out = Bins(capacity)
    for items, fill in zip(bins, fills, strict=True):
        if items:
            out.add(items, fill)
    return out


def evolve(sizes: list[int], capacity: int, seed: int, start: list[Bins], population: int, generations: int, steps: int = 0) -> Bins:
    """The best packing of an island's run, settled at its end by so many steps. It ends early at the least number of bins that the sizes allow."""
    rng, least = random.Random(seed), -(-sum(sizes) // capacity)
    everything = list(range(len(sizes)))
    herd = [(b.fitness(), b) for b in start]
    if not herd:
        first = Bins(capacity).best_fits(everything, sizes)
        herd = [(first.fitness(), first)]
    while len(herd) < population and max(x[0][0] for x in herd) < -least:
        dealt, bins = rng.sample(everything, len(everything) // 8), Bins(capacity)
        for i in dealt:
            bins.best_fit(i, sizes[i])
        taken = set(dealt)
        bins.best_fits([i for i in everything if i not in taken], sizes)
        herd.append((bins.fitness(), bins))
    for _ in range(generations):
        herd.sort(key=lambda x: x[0], reverse=True)
        if herd[0][0][0] >= -least or len(herd) < 2:
            break
        mother, father = (x[1] for x in rng.sample(herd, 2))
        child = cross(mother, father, sizes, rng)
        fit = child.fitness()
        if fit > herd[-1][0] and all(fit != x[0] for x in herd):
            herd[-1] = (fit, child)
    best = max(herd, key=lambda x: x[0])[1]
    return best if len(best.bins) <= least else settled(best, sizes, rng, steps, least)


def _numbered(packing: Bins, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(packing.bins):
        out[b] = k
    return out


def _packing(numbers: np.ndarray, sizes: list[int], capacity: int) -> Bins:
    out = Bins(capacity)
    order = np.argsort(numbers, kind="stable")
    for items in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
        out.add(items.tolist(), sum(sizes[i] for i in items))
    return out


def _round(items: DataFrame, n: int, capacity: int, block_size: int, islands: int, epochs: int, population: int, generations: int, steps: int, salt: int) -> DataFrame:
    """Every item with how full its bin is, its place there, and the bin's number, the smallest of its items' ones."""
    blocks = max(1, -(-n // block_size))
    items = items.withColumn("block", F.pmod(F.xxhash64("no", F.lit(salt)), F.lit(blocks)))
    spread = items.select("block", "no", "length").withColumn("island", F.explode(F.array([F.lit(i) for i in range(islands)])))
    found = "block long, island int, score long, filled double, bins binary"

    def epoch(number: int):
        def run(key, rows: pd.DataFrame, came: pd.DataFrame | None = None) -> pd.DataFrame:
            sizes = rows.sort_values("no")["length"].tolist()
            start = [] if came is None else [_packing(np.frombuffer(b, np.int32), sizes, capacity) for b in came["bins"]]
            if not sizes:
                return pd.DataFrame({"block": [], "island": [], "score": [], "filled": [], "bins": []})
            best = evolve(sizes, capacity, hash((int(key[0]), int(key[1]), number, salt)) & 0xFFFFFFFF, start, population, generations, steps if number + 1 == epochs else 0)
            score, filled = best.fitness()
            to = [int(key[1])] if epochs == number + 1 or islands == 1 else [int(key[1]), (int(key[1]) + 1) % islands]
            return pd.DataFrame({"block": int(key[0]), "island": to, "score": score, "filled": filled, "bins": [_numbered(best, len(sizes)).tobytes()] * len(to)})

        return (lambda key, rows: run(key, rows)) if number == 0 else (lambda key, rows, came: run(key, rows, came))

    best = spread.groupBy("block", "island").applyInPandas(epoch(0), found)
    for k in range(1, epochs):
        best = spread.groupBy("block", "island").cogroup(best.groupBy("block", "island")).applyInPandas(epoch(k), found)
    elite = best.groupBy("block").agg(F.max_by("bins", F.struct("score", "filled", F.col("island"))).alias("bins"))

    def place(key, rows: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no", ignore_index=True)
        own = rows.groupby(np.frombuffer(won["bins"].iloc[0], np.int32)) if len(rows) else rows.groupby("no")
        rows["sequence_id"] = own["no"].transform("min")
        rows["fill"] = own["length"].transform("sum")
        rows["offset"] = own["length"].cumsum() - rows["length"]
        return rows[["no", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]]

    return items.groupBy("block").cogroup(elite.groupBy("block")).applyInPandas(place, f"no long, {PIECES}, sequence_id long, offset long, fill long")


def pack(documents: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, block_size: int = 4096, islands: int = 2, epochs: int = 2, population: int = 8, generations: int = 40, steps: int = 8000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    After a round the sequences that aren't full are dissolved, and their pieces, a small part of all, meet in new blocks,
    until a round saves no sequence or none can be saved. Where one block holds all that is left, its islands settle their
    packings in `steps`.
    """
    small_batches(documents.sparkSession)
    out = [x.split(" ")[0] for x in PIECES.split(", ")]
    # each piece has a number of its own, whatever the partitions, and a sequence that of its first piece
    cut = numbered(saved(pieces(documents, vocabulary, end_id, capacity), "pieces"), *[F.col(c) for c in out], name="no")
    whole = cut.where(F.col("length") == capacity).select(*out, F.col("no").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, salt, before = cut.where(F.col("length") < capacity), 1, None
    while True:
        n = left.count()
        single = n <= block_size
        now = saved(_round(left, n, capacity, block_size, islands, epochs, population, generations, steps if single else 0, salt), "packed")
        full = F.col("fill") == capacity
        made, loose, tokens = now.agg(F.count_distinct("sequence_id"), F.count_distinct(F.when(~full, F.col("sequence_id"))), F.coalesce(F.sum(F.when(~full, F.col("length"))), F.lit(0))).first()
        # no more rounds where one block has settled, where loose ones are as few as their tokens allow, or where a round has saved none
        last = single or loose <= -(-tokens // capacity) or before is not None and made >= before
        whole = whole.unionByName((now if last else now.where(full)).select(*whole.columns))
        if last:
            return whole
        left, salt, before = now.where(~full).select("no", *out), salt + 1, loose
