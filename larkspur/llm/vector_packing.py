"""Packing of training examples under several limits at once.

An example demands tokens, segments (one, or as many as it says) and tokens that
bear loss; a sequence has a limit for each. A sequence is filled by the
dot-product heuristic: of the waiting examples that fit under all limits the one
comes next whose demand, in shares of the limits, has the largest product with
the room that is left, each dimension weighed by how much is demanded of it.

`pack_examples` keeps examples whole, as instruction data wants it.
`pack_documents` may cut: where no whole document fits any more, the waiting
document with the largest product gives up as many ids as there is room for, and
its rest waits on. A sequence that a limit closes before it is full, and the
last ones of a task, are cut at a power of two, at which sequences need no
padding, so that none is padded.

Nothing is shuffled: each task packs its own rows, of which up to `block` wait
at a time, whatever their keys, and what is left waits for the next ones. So the
places depend on how the input is dealt to tasks, but the same tasks give the
same places again. Memory is bounded by `block` examples or `held` ids and one
document.

Nulls: a null text is empty (its end id alone), a null demand is 0; a null id
is kept. Repeated rows are packed as often as they occur, ties in the order of
the input. A very long document becomes as many pieces as it needs. An example
that is over a limit by itself can't be placed whole: its sequence_id and offset
are null. Empty tables give no rows. Columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .encode import encoder


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be 1 at least")

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.int64)


class Waiting:
    """Examples by their demands, in rows (tokens, segments, loss); what is placed is marked and swept out now and then."""

    def __init__(self, limits: Limits):
        self.limits = limits.array()
        self.demand = np.zeros((0, 3), np.int64)
        self.live = np.zeros(0, bool)
        self.what: list = []

    def add(self, demands: np.ndarray, what: list) -> None:
        self.demand = np.concatenate([self.demand[self.live], demands])
        self.what = [w for w, x in zip(self.what, self.live.tolist(), strict=True) if x] + what
        self.live = np.ones(len(self.what), bool)
        # a dimension weighs by what is demanded of it; one that nothing is demanded of doesn't count
        self.weights = (self.demand / self.limits).mean(axis=0) / self.limits if len(self.demand) else np.zeros(3)
        self.weighed = self.demand * self.weights

    def __len__(self) -> int:
        return int(self.live.sum())

    def tokens(self) -> int:
        return int(self.demand[self.live, 0].sum())

    def best(self, room: np.ndarray, whole: bool = True) -> int:
        """The waiting example with the largest dot product with the room; whole: among those that fit. -1 if there is none."""
        can = self.live & (self.demand <= room).all(axis=1) if whole else self.live
        if not can.any():
            return -1
        return int(np.argmax(np.where(can, self.weighed @ (room / self.limits), -1.0)))

    def take(self, k: int) -> None:
        self.live[k] = False

    def shorten(self, k: int, demand: tuple[int, int, int]) -> None:
        self.demand[k] = demand
        self.weighed[k] = self.demand[k] * self.weights

    def fill(self) -> list[int]:
        """A sequence of whole examples."""
        room, out = self.limits.copy(), []
        while (k := self.best(room)) >= 0:
            self.take(k)
            room -= self.demand[k]
            out.append(k)
        return out


PLACES = "sequence_id long, offset long"


def pack_examples(examples: DataFrame, limits: Limits = Limits(), block: int = 2048) -> DataFrame:
    """id, tokens, segments, loss, sequence_id and offset (in tokens, gapless from 0) of every example, none of which is cut.

    examples has a long id and the demands tokens, segments and loss; loss counts the tokens that the loss is taken of.
    """
    demands = ("tokens", "segments", "loss")
    rows = examples.select(F.col("id").cast("long").alias("id"), *[F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(c) for c in demands])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, number = Waiting(limits), TaskContext.get().partitionId() << 33

        def placed(least: int) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            while len(waiting) > least:
                at = 0
                for k in waiting.fill():
                    n = waiting.demand[k].tolist()
                    out.append((waiting.what[k], *n, number, at))
                    at += n[0]
                number += 1
            return rows_of(out)

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", *demands, "sequence_id", "offset"])

        for batch in batches:
            ids, all_demands = batch.column("id").to_pylist(), np.stack([batch.column(c).to_numpy() for c in demands], axis=1)
            fits = (all_demands <= waiting.limits).all(axis=1)
            if not fits.all():
                yield rows_of([(ids[k], *all_demands[k].tolist(), None, None) for k in np.flatnonzero(~fits).tolist()])
            for at in range(0, len(ids), block):
                some = at + np.flatnonzero(fits[at : at + block])
                waiting.add(all_demands[some], [ids[k] for k in some.tolist()])
                if len(waiting) >= block:
                    yield placed(block // 4)
        yield placed(0)

    return rows.mapInArrow(run, f"id long, tokens long, segments long, loss long, {PLACES}")


def chat_examples(turns: DataFrame, vocabulary: str, loss_role: str = "assistant") -> DataFrame:
    """Conversations as examples of one segment: id, tokens, segments, loss. Each turn has an end id; turns of loss_role bear loss. Turns without conv_id are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = encoder(vocabulary).encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("role"), pa.array(np.diff(off) + 1)], ["conv_id", "role", "n"])

    small_batches(turns.sparkSession)
    each = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("role").cast("string"), "text").mapInArrow(count, "conv_id long, role string, n long")
    return each.groupBy(F.col("conv_id").alias("id")).agg(F.sum("n").alias("tokens"), F.lit(1).cast("long").alias("segments"), F.sum(F.when(F.col("role") == loss_role, F.col("n")).otherwise(0)).alias("loss"))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack_documents(documents: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits(), block: int = 1024, held: int = 1 << 22) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for every piece of every document.

    A document is its ids and the end id. All ids of a piece bear loss but the first, which nothing in the sequence
    precedes. Every sequence has limits.tokens ids, or a power of two of them.
    """
    small_batches(documents.sparkSession)
    cap, most = limits.tokens, min(limits.tokens, limits.loss + 1)

    def whole(n: int) -> bool:
        return n == cap or n & (n - 1) == 0

    def demand(n: int) -> tuple[int, int, int]:
        return n, 1, n - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, number = Waiting(limits), TaskContext.get().partitionId() << 33

        def sequence() -> list[tuple]:
            """The pieces (doc_id, all its ids, ids before it, ids) of the next sequence."""
            room, out = waiting.limits.copy(), []
            while room[0] and room[1]:
                k = waiting.best(room)
                if k >= 0:
                    waiting.take(k)
                    room -= waiting.demand[k]
                    out.append(waiting.what[k])
                    continue
                k = waiting.best(room, whole=False)
                if k < 0:
                    break
                # none fits: the first ids of one fill what is left
                n = int(min(room[0], room[2] + 1))
                doc, total, start, ids = waiting.what[k]
                out.append((doc, total, start, ids[:n]))
                room -= demand(n)
                waiting.what[k] = (doc, total, start + n, ids[n:].copy())
                waiting.shorten(k, demand(len(ids) - n))
            used = cap - int(room[0])
            if not whole(used):
                # back to a power of two; the ids beyond it wait again
                keep, back = 1 << (used.bit_length() - 1), []
                while used > keep:
                    doc, total, start, ids = out.pop()
                    n = len(ids) - min(len(ids), used - keep)
                    back.append((doc, total, start + n, ids[n:]))
                    used -= len(ids) - n
                    if n:
                        out.append((doc, total, start, ids[:n]))
                waiting.add(np.array([demand(len(x[3])) for x in back], np.int64), back)
            return out

        def placed(least: int) -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            while waiting.live.any() and (len(waiting) > least or waiting.tokens() > held) and (least == 0 or waiting.tokens() >= cap):
                at = 0
                for doc, total, start, own in sequence():
                    out.append((doc, start, len(own), zlib.crc32(own.tobytes()), total, number, at))
                    at += len(own)
                number += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*(x.split(" ")[0] for x in PIECES.split(", ")), "sequence_id", "offset"])

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                ids, off = encoder(vocabulary).encode(some.column("text"))
                new: list[tuple] = []
                for doc, a, z in zip(some.column("doc_id").to_pylist(), off.tolist(), off[1:].tolist(), strict=False):
                    own = np.append(ids[a:z], np.uint32(end_id)).astype("<u4")
                    # parts that one sequence can hold
                    new += [(doc, len(own), b, own[b : b + most].copy()) for b in range(0, len(own), most)]
                waiting.add(np.array([demand(len(x[3])) for x in new], np.int64).reshape(-1, 3), new)
                if len(waiting) >= block or waiting.tokens() > held:
                    yield placed(block // 4)
        yield placed(0)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{PIECES}, {PLACES}")
