"""Removal of long repeats with a logarithmic family of suffix arrays.

A byte goes if a string of `length` bytes around it also starts in a document
with a smaller doc_id. Suffixes are sampled at anchors: of the 16-byte strings in
every window of `length` bytes the one with the smallest hash is its anchor, so
that equal windows have equal anchors wherever they stand. An entry of an array
is an anchor with the bytes of all its windows: those of the suffix that starts
at the anchor, and those to its left.

Entries are dealt to parts by their anchor string, and each part keeps a family
of its own: documents come in batches of ascending doc_id, the entries of a batch
are sorted into a suffix array, by the bytes of the suffixes, and scanned against
the existing levels as far as these share anchor strings with it. In the merged
order the common length with either neighbour bounds how far a match reaches to
the right, and the order of what stands to the left of an anchor how far it
reaches to the left; where both together reach `length` bytes, windows are
compared byte by byte (hashes only bring together what is compared). Then the
batch becomes a level, and levels of equal weight merge.

A family can be kept (`index`): its levels are tables in the given folder, the
next call's documents are scanned against them, and only the level that is new
or merged is written. A folder's documents have to come in ascending doc_id.

Anchor strings that stand in very many surroundings are found in a sample of
documents; entries of these are cut into their single windows, and each of these
is dealt by all of its bytes, so that no part gets all surroundings of a frequent
string. The choice only decides where windows meet, not which ones do.

All rows between the stages are compressed blocks of arrays, and repeats within
a task's own texts are settled before the shuffle, so that what very many
documents share costs a row for each task.

Nulls: a null text is empty. A document with a null doc_id is neither smaller nor
larger than another and keeps all its bytes. Rows of equal doc_id are documents
of their own that don't repeat each other. Very long texts are read whole. An
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean_worker, mixed, partitions, pieces_of, prefix_sums, range_hash, saved, small_batches, utf8

GRAM, KEY = 16, 24
ROWS = "kind string, part long, data binary"
LEVEL = "part long, data binary"
META = "number int, path string, weight long, length int, parts int, last_id long, hot binary"
_FLUSH = 300_000
_CHUNK = 1 << 19

Rows = dict[str, np.ndarray]


def _pressed(arrays: Rows) -> bytes:
    """Arrays as one block; each is compressed by itself, like by like."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    return pickle.dumps({k: (v.dtype.str, v.shape, press.compress(np.ascontiguousarray(v).tobytes())) for k, v in arrays.items()}, protocol=5)


def _opened(data: bytes) -> Rows:
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    return {k: np.frombuffer(unpress.decompress(x), kind).reshape(shape) for k, (kind, shape, x) in pickle.loads(data).items()}


def _joined(parts: list[Rows]) -> Rows:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _dealt(kind: str, arrays: Rows, to: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each number in `to`, with the rows of the arrays that have it."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(to[order])) + 1, [len(to)]])
    parts, blocks = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = order[a:b]
        parts.append(int(to[own[0]]))
        blocks.append(_pressed({k: v[own] for k, v in arrays.items()}))
    yield pa.RecordBatch.from_pydict({"kind": [kind] * len(parts), "part": pa.array(parts, pa.int64()), "data": pa.array(blocks, pa.binary())})


class Gathered:
    """Rows that wait until there are enough of them: a task then gives a row for each number they are dealt to, not for each of its parts."""

    def __init__(self, kind: str, homes: int):
        self.kind, self.homes, self.held, self.total = kind, homes, [], 0

    def add(self, arrays: Rows) -> Iterator[pa.RecordBatch]:
        if len(arrays["doc"]):
            self.held.append(arrays)
            self.total += len(arrays["doc"])
        if self.total >= _FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            rows = _joined(self.held)
            rows = _tight(rows) if self.kind == "span" else rows
            yield from _dealt(self.kind, rows, rows["doc"] % self.homes)
        self.held, self.total = [], 0


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Rows:
    """Of texts that lie in data at offsets: text, key (the anchor string's hash), at (its place), lead and reach (bytes of its windows before and from it), and ctx (these bytes)."""
    n, span = len(data), length - GRAM + 1
    own = np.diff(offsets) >= length
    if n < length or not own.any():
        return {"text": np.zeros(0, np.int64)}
    at = np.arange(n - GRAM + 1)
    grams = range_hash(prefix_sums(data), at, at + GRAM)
    bits = np.uint64(max(20, int(n).bit_length()))
    low = (grams >> bits << bits) | at.astype(np.uint64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: n - length + 1], low[span - width : span - width + n - length + 1])
    pick = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(n + 2, np.int32)
    np.add.at(inside, offsets[:-1][own], 1)
    np.add.at(inside, offsets[1:][own] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: n - length + 1] > 0)
    text = np.searchsorted(offsets, windows, "right") - 1
    p = pick[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (p[1:] != p[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    s1, s2, p, text = windows[first], windows[last], p[first], text[first]
    lead, reach = (p - s1).astype(np.uint8), (s2 + length - p).astype(np.uint8)
    padded = np.concatenate([np.zeros(length - GRAM, np.uint8), data, np.zeros(length, np.uint8)])
    return {"text": text, "key": grams[p], "at": (p - offsets[text]).astype(np.uint32), "lead": lead, "reach": reach, "ctx": _masked(sliding_window_view(padded, 2 * length - GRAM)[p], lead, reach, length)}


def _masked(ctx: np.ndarray, lead: np.ndarray, reach: np.ndarray, length: int) -> np.ndarray:
    """The contexts with zeros outside of the windows."""
    place = np.arange(2 * length - GRAM, dtype=np.int16) - (length - GRAM)
    return ctx * ((place >= -lead.astype(np.int16)[:, None]) & (place < reach[:, None]))


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit numbers that sort as the bytes do."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def _hashed(rows: np.ndarray, *more: np.ndarray, seed: int = 0) -> np.ndarray:
    factors = np.random.default_rng(seed).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    words = _words(rows)
    out = np.zeros(len(rows), np.uint64)
    for k, w in enumerate([*words.T, *more]):
        out = mixed(out + w.astype(np.uint64) * factors[k])
    return out


def _repeated(doc: np.ndarray, rows: np.ndarray, *more: np.ndarray, seed: int = 0) -> np.ndarray:
    """Whether a row of the same bytes (and of the same further numbers) has a smaller doc. Rows that hashes bring together are compared."""
    out = np.zeros(len(doc), bool)
    if len(doc) < 2:
        return out
    h = _hashed(rows, *more, seed=seed)
    order = np.lexsort((doc, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    lowest = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = order != lowest
    order, lowest = order[later], lowest[later]
    same = np.ones(len(order), bool)
    for k in range(0, len(order), _FLUSH):
        a, b = order[k : k + _FLUSH], lowest[k : k + _FLUSH]
        same[k : k + _FLUSH] = (rows[a] == rows[b]).all(1)
    for x in more:
        same &= x[order] == x[lowest]
    out[order[same]] = doc[order[same]] > doc[lowest[same]]
    other = np.sort(order[~same])
    if len(other):  # different rows of one hash: among themselves by another one
        out[other] |= _repeated(doc[other], rows[other], *(x[other] for x in more), seed=seed + 1)
    return out


def _known_before(rows: Rows) -> np.ndarray:
    """Whether a smaller document has the same anchor with the same windows."""
    return _repeated(rows["doc"], rows["ctx"], rows["lead"], rows["reach"])


def _single_windows(rows: Rows, length: int) -> Rows:
    """Each entry as one for each of its windows."""
    low = np.maximum(0, length - rows["reach"].astype(np.int64))
    count = rows["lead"].astype(np.int64) - low + 1
    own = np.repeat(np.arange(len(count)), count)
    lead = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own]
    out = {k: v[own] for k, v in rows.items()}
    out |= {"lead": lead.astype(np.uint8), "reach": (length - lead).astype(np.uint8)}
    return out | {"ctx": _masked(out["ctx"], out["lead"], out["reach"], length)}


def _spans(rows: Rows) -> Rows:
    """What the windows of entries cover."""
    start = rows["at"].astype(np.int64) - rows["lead"]
    return _tight({"doc": rows["doc"], "mark": rows["mark"], "start": start, "end": rows["at"].astype(np.int64) + rows["reach"]})


def _mark(text: bytes, marked: bool) -> int:
    """What tells texts of one doc_id apart: their hash, or nothing if no doc_id has several rows."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text) if marked else 0


def _texts(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, a mark of each text, and the texts as bytes and offsets, in ranges of bounded size."""
    for batch in batches:
        data, off = utf8(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i, j in pieces_of(off, _CHUNK):
            part = data[off[i] : off[j]]
            at = off[i : j + 1] - off[i]
            marks = np.array([_mark(part[a:b].tobytes() if marked else b"", marked) for a, b in zip(at, at[1:], strict=False)], np.uint64)
            yield ids[i:j].astype(np.int64), marks, part, at


def _scan(length: int, parts: int, marked: bool, homes: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        held: list[Rows] = []
        spans = Gathered("span", homes)

        def settled(rows: Rows) -> Iterator[pa.RecordBatch]:
            """What an earlier text of this very task holds needs no shuffle, and is no source of anything new."""
            known = _known_before(rows)
            yield from spans.add(_spans({k: v[known] for k, v in rows.items()}))
            for k in rows:
                rows[k] = rows[k][~known]

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = _joined(held)
            held.clear()
            yield from settled(rows)
            frequent = np.isin(rows["key"], hot.value)
            some = _single_windows({k: v[frequent] for k, v in rows.items()}, length)
            yield from settled(some)
            some["key"] = _hashed(some["ctx"], some["lead"])
            rows = {k: np.concatenate([v[~frequent], some[k]]) for k, v in rows.items()}
            key = rows.pop("key")
            order = _order(rows, length)  # like stands by like: better compressed, and half sorted for the family
            yield from _dealt("anchor", {k: v[order] for k, v in rows.items()}, (key[order] % np.uint64(parts)).astype(np.int64))

        total = 0
        for ids, marks, data, off in _texts(batches, marked):
            made = anchors(data, off, length)
            text = made.pop("text")
            if len(text):
                held.append(made | {"doc": ids[text], "mark": marks[text]})
                total += len(text)
            if total >= _FLUSH:
                yield from flush()
                total = 0
        yield from flush()
        yield from spans.flush()

    return run


def frequent_strings(docs: DataFrame, length: int, every: int, crowd: int, most: int = 100_000) -> np.ndarray:
    """Hashes of anchor strings that stand in about `crowd` different surroundings, judged by a sample of one document in `every`; at most `most` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        for _, _, data, off in _texts(batches, False):
            made = anchors(data, off, length)
            if len(made["text"]):
                _, one = np.unique(_hashed(made["ctx"], made["lead"], made["reach"]), return_index=True)
                key, count = np.unique(made["key"][one], return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "n": pa.array(count)})

    found = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(every)) == 0).select("doc_id", "text").mapInArrow(run, "key long, n long")
    rows = found.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(4, crowd // every)).orderBy(F.desc("n"), "key").limit(most).collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


def _tight(span: Rows) -> Rows:
    """Spans of a text that touch or overlap as one."""
    order = np.lexsort((span["start"], span["mark"], span["doc"]))
    doc, mark, start, end = (span[k][order] for k in ("doc", "mark", "start", "end"))
    start, end = start.astype(np.int64), end.astype(np.int64)
    if not len(doc):
        return {"doc": doc, "mark": mark, "start": start, "end": end}
    text = np.ones(len(doc), bool)
    text[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    # the furthest end so far within a text, by lifting each text above the one before
    lift = (np.cumsum(text) - 1) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift)
    new = text.copy()
    new[1:] |= start[1:] + lift[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return {"doc": doc[first], "mark": mark[first], "start": start[first], "end": (far - lift)[last]}


def _order(rows: Rows, length: int) -> np.ndarray:
    """The order of the suffixes by their first KEY bytes."""
    w = _words(rows["ctx"][:, length - GRAM : length - GRAM + KEY])
    return np.lexsort(w.T[::-1])


def _common(a: np.ndarray) -> np.ndarray:
    """How many bytes each row of words has in common with the row before it."""
    out = np.zeros(len(a), np.int64)
    open_ = np.ones(max(0, len(a) - 1), bool)
    for w in a.T:
        x = w[1:] ^ w[:-1]
        # bits from the first that differs, of each half, as a float holds 32 bits exactly
        high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
        bits = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
        out[1:] += np.where(open_, 8 - (bits + 7) // 8, 0)
        open_ &= x == 0
    return out


class Level:
    """A suffix array: entries in byte order of their suffixes. weight counts the batches in it."""

    def __init__(self, rows: Rows, length: int, weight: int):
        order = _order(rows, length)
        self.rows, self.weight = {k: v[order] for k, v in rows.items()}, weight
        self.first = _words(self.rows["ctx"][:, length - GRAM : length - GRAM + 8])[:, 0]

    def like(self, first: np.ndarray) -> Rows:
        """The entries whose first eight bytes are among these, which are sorted: one walk over both."""
        at = np.minimum(np.searchsorted(first, self.first), len(first) - 1)
        hit = first[at] == self.first
        return {k: v[hit] for k, v in self.rows.items()}


class Family:
    """The levels of one part. Batches come in ascending doc_id."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level | None] = []

    def add(self, batch: Rows, keep: bool) -> Rows:
        """Scans a batch against itself and all levels, and gives the spans that smaller documents hold too. keep: the batch becomes a level."""
        length, left = self.length, self.length - GRAM
        batch = {k: v[order] for order in (_order(batch, length),) for k, v in batch.items()}
        first = np.unique(_words(batch["ctx"][:, left : left + 8])[:, 0])
        some = _joined([batch, *(level.like(first) for level in self.levels if level)])
        number = np.concatenate([np.arange(len(batch["doc"])), np.full(len(some["doc"]) - len(batch["doc"]), -1)])
        order = _order(some, length)
        some, number = {k: v[order] for k, v in some.items()}, number[order]

        # to the right: the longer of what either neighbour shares; to the left: the same in the order of what stands there
        right = self._reached(_words(some["ctx"][:, left : left + KEY]), KEY, length, some["reach"])
        run = np.cumsum(np.append(True, _common(_words(some["ctx"][:, left : left + GRAM]))[1:] < GRAM))
        met = np.flatnonzero(right >= GRAM)
        before = _words(some["ctx"][met][:, left - GRAM : left][:, ::-1])
        by_left = np.lexsort((before[:, 1], before[:, 0], run[met]))
        far = self._reached(np.column_stack([run[met].astype(np.uint64), before])[by_left], 8 + GRAM, length, None) - 8
        reach_left = np.zeros(len(run), np.int64)
        reach_left[met[by_left]] = np.where(far >= GRAM, left, np.maximum(far, 0))
        reach_left = np.minimum(reach_left, some["lead"])
        near = np.flatnonzero(right + reach_left >= length)

        # entries that are alike as a whole
        own = {k: v[near] for k, v in some.items()}
        known = _known_before(own)
        fresh = number[near] >= 0
        spans = [_spans({k: v[known & fresh] for k, v in own.items()})]
        dropped = np.zeros(len(batch["doc"]), bool)
        dropped[number[near][known & fresh]] = True
        rest = near[~known]
        spans += self._by_window({k: v[rest] for k, v in some.items()}, number[rest] >= 0, right[rest], reach_left[rest], run[rest])
        if keep:
            kept = {k: v[~dropped] for k, v in batch.items()}
            if len(kept["doc"]):
                self.levels.append(Level(kept, length, 1))
        return _tight(_joined(spans))

    @staticmethod
    def _reached(words: np.ndarray, whole: int, most: int, bound: np.ndarray | None) -> np.ndarray:
        """The longer of the lengths in common with the row before and the row after; `most` where all `whole` bytes are alike, since there the order says no more."""
        same = _common(words)
        same = np.where(same >= whole, most + 8, same)
        both = np.maximum(same, np.append(same[1:], 0)) if len(same) else same
        return both if bound is None else np.minimum(both, bound)

    def _by_window(self, some: Rows, fresh: np.ndarray, right: np.ndarray, left: np.ndarray, run: np.ndarray) -> list[Rows]:
        """Spans of windows that a smaller document has, in pieces of whole runs of one anchor string."""
        length = self.length
        low = np.maximum(0, length - np.minimum(right, some["reach"]).astype(np.int64))
        count = np.maximum(np.minimum(left, some["lead"]) - low + 1, 0)
        ends = np.flatnonzero(np.append(run[1:] != run[:-1], True)) + 1 if len(run) else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(count)])
        out, a = [], 0
        while a < len(run):
            # runs up to about so many windows, one run at least
            k = max(int(np.searchsorted(sums[ends], sums[a] + _FLUSH, "right")) - 1, int(np.searchsorted(ends, a, "right")))
            b = int(ends[k])
            c = count[a:b]
            own = np.repeat(np.arange(a, b), c)
            lead = np.arange(len(own)) - np.repeat(np.cumsum(c) - c, c) + low[own]
            windows = sliding_window_view(some["ctx"], length, axis=1)[own, length - GRAM - lead]
            doc = some["doc"][own]
            hit = _repeated(doc, windows, run[own].astype(np.uint64)) & fresh[own]
            at = some["at"][own[hit]].astype(np.int64) - lead[hit]
            out.append(_tight({"doc": doc[hit], "mark": some["mark"][own[hit]], "start": at, "end": at + length}))
            a = b
        return out

    def merge(self, stored: int) -> None:
        """New levels of equal weight become one of twice the weight; the `stored` first ones stay."""
        while len(self.levels) > stored + 1 and self.levels[-2].weight <= self.levels[-1].weight:
            a, b = self.levels[-2:]
            self.levels[-2:] = [Level(_joined([a.rows, b.rows]), self.length, a.weight + b.weight)]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, Rows]]]]:
    """The opened blocks of each part, with their kinds; rows come sorted by part."""
    part, held = None, []
    for batch in batches:
        for kind, p, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "data")), strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append((kind, _opened(data)))
    if held:
        yield part, held


def _match(length: int, homes: int, cuts: list[int], weights: list[int], fixed: int | None):
    """Families of the parts: the levels that are stored (kinds level0, level1 ...), then a batch for each range of doc_ids between the cuts.

    fixed: the number of stored levels that stay; all others become one that is given as a row of each part. None: nothing is stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        settled: list[pa.RecordBatch] = []
        found = Gathered("span", homes)

        def unsettled() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = pc.equal(batch.column("kind"), "span")
                if pc.any(spans).as_py():
                    settled.append(batch.filter(spans))
                yield batch.filter(pc.invert(spans))

        for part, blocks in _by_part(unsettled()):
            yield from settled
            settled.clear()
            family = Family(length)
            for k, weight in enumerate(weights):
                own = [rows for kind, rows in blocks if kind == f"level{k}"]
                if own or fixed is not None and k < fixed:
                    family.levels.append(Level(_joined(own), length, weight) if own else None)
            stored = len(family.levels)
            new = [rows for kind, rows in blocks if kind == "anchor"]
            blocks.clear()
            if new:
                rows = _joined(new)
                new.clear()
                number = np.searchsorted(np.array(cuts, np.int64), rows["doc"], "right")
                for k in range(len(cuts) + 1):
                    own = number == k
                    if own.any():
                        yield from found.add(family.add({c: v[own] for c, v in rows.items()}, fixed is not None or k < len(cuts)))
                        family.merge(stored)
            changed = [level.rows for level in family.levels[fixed:] if level] if fixed is not None else []
            if changed:
                blob = _pressed(Level(_joined(changed), length, 0).rows)
                yield pa.RecordBatch.from_pydict({"kind": ["level"], "part": pa.array([part], pa.int64()), "data": pa.array([blob], pa.binary())})
        yield from settled
        yield from found.flush()

    return run


def _homed(documents: DataFrame, homes: int) -> DataFrame:
    """Texts, compressed, as rows of the same form as the blocks, which sort before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                data = [press.compress((t or "").encode()) for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"kind": ["text"] * some.num_rows, "part": some.column("part"), "doc_id": some.column("doc_id"), "data": pa.array(data, pa.binary()), "rest": some.column("rest")})

    part = F.coalesce(F.pmod(F.col("doc_id"), F.lit(homes)), F.lit(0))
    rest = documents.schema["rest"].dataType.simpleString()
    return documents.select(part.alias("part"), "doc_id", "text", "rest").mapInArrow(run, f"kind string, part long, doc_id long, data binary, rest {rest}")


def _met(blocks: DataFrame, documents: DataFrame, homes: int, deal: int) -> DataFrame:
    texts = _homed(documents, homes)
    rows = texts.unionByName(blocks.select("kind", "part", F.lit(None).cast("long").alias("doc_id"), "data", F.lit(None).cast(texts.schema["rest"].dataType).alias("rest")))
    return rows.repartition(deal, "part").sortWithinPartitions("part", "kind")


def _with_texts(batches: Iterator[pa.RecordBatch], marked: bool) -> Iterator[tuple[int | None, bytes, Rows, object]]:
    """Each doc_id and text with the rows that the blocks of its part have for it, and with its carried columns."""
    import zstandard

    unpress = zstandard.ZstdDecompressor()
    part, blocks, by_text = None, [], None
    for batch in batches:
        for kind, p, doc, data, rest in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "doc_id", "data", "rest")), strict=True):
            if p != part:
                part, blocks, by_text = p, [], None
            if kind != "text":
                blocks.append(_opened(data))
                continue
            if by_text is None:
                by_text = {}
                if blocks:
                    rows = _joined(blocks)
                    order = np.lexsort((rows["mark"], rows["doc"]))
                    rows = {k: v[order] for k, v in rows.items()}
                    new = np.flatnonzero((np.diff(rows["doc"]) != 0) | (np.diff(rows["mark"]) != 0)) + 1
                    cuts = np.concatenate([[0], new, [len(order)]])
                    by_text = {(int(rows["doc"][a]), int(rows["mark"][a])): {k: v[a:b] for k, v in rows.items()} for a, b in zip(cuts, cuts[1:], strict=False)}
                blocks = []
            text = unpress.decompress(data)
            yield doc, text, by_text.get((doc, _mark(text, marked)), {}) if doc is not None and by_text else {}, rest


def _cut(with_kept: bool, marked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary(), "text": pa.string(), "rest": None}
        out: dict[str, list] = {c: [] for c in kinds}
        size = 0

        def typed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds["rest"] = batch.column("rest").type
                yield batch

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: pa.array(v, kinds[c]) for c, v in out.items()})

        for doc, text, rows, rest in _with_texts(typed(), marked):
            spans: list[tuple[int, int]] = []
            if rows:
                tight = _tight(rows)
                spans = list(zip(tight["start"].tolist(), tight["end"].tolist(), strict=True))
            at, left = 0, []
            for a, b in spans:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            kept = b"".join(left)
            for c, v in zip(out, (doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_kept else None, kept.decode("utf-8", "ignore") if with_kept else None, rest), strict=True):
                out[c].append(v)
            size += len(kept) if with_kept else 0
            if len(out["doc_id"]) >= 4096 or size > 1 << 23:
                yield batch()
                out, size = {c: [] for c in out}, 0
        if out["doc_id"]:
            yield batch()

    return run


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def stored_levels(spark: SparkSession, index: str) -> list:
    """Rows of META for the levels of a stored family, oldest first; none if there is no family yet."""
    files, at = _folder(spark, f"{index}/states")
    if not files.exists(at):
        return []
    last = max(int(f.getPath().getName()) for f in files.listStatus(at))
    return spark.read.schema(META).parquet(f"{index}/states/{last:08d}").orderBy("number").collect()


def without_repeats(documents: DataFrame, length: int = 50, batches: int = 4, with_kept: bool = True, carry: tuple[str, ...] = (), index: str | None = None, crowd: int = 200_000, sampled: int = 1_000_000, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, text and the carried columns, as rest, of every document.

    kept has the exact bytes left over, text what of them is valid UTF-8 (a repeat may end within a character).

    index: a folder that all executors share. Repeats of documents that were added there before go as well, and these
    documents are added to it at once, before the result is read. Their doc_ids have to be larger than all before.
    crowd: the surroundings of an anchor string, judged by a sample of about `sampled` documents, from which on its
    windows are dealt singly.
    """
    if length < KEY:
        raise ValueError(f"length must be {KEY} bytes at least")
    spark = documents.sparkSession
    small_batches(spark)
    deal = partitions(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*carry).alias("rest") if carry else F.lit(0).alias("rest"))
    live = docs.where("doc_id is not null").select("doc_id", "text")
    marked = not live.groupBy("doc_id").count().where("count > 1").isEmpty()
    shares = [k / batches for k in range(1, batches)]
    ends = live.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.percentile_approx("doc_id", shares or [0.5], 1000).alias("cuts")).first()
    cuts = sorted(set(ends["cuts"] or [])) if shares else []

    levels = stored_levels(spark, index) if index else []
    if levels:
        parts, hot = levels[0]["parts"], np.frombuffer(levels[0]["hot"], np.uint64)
        if levels[0]["length"] != length or ends["n"] and ends["a"] <= levels[0]["last_id"]:
            raise ValueError("the index has another length, or doc_ids that aren't smaller")
    else:
        parts = max(3 * deal, (ends["bytes"] or 0) // part_bytes)  # more parts than tasks, so that tasks get about as many
        hot = frequent_strings(live, length, max(min(64, crowd), ends["n"] // sampled), crowd)
    homes = max(3 * deal, (ends["bytes"] or 0) // part_bytes)
    weights = [r["weight"] for r in levels]
    fixed, weight = len(weights), 1
    while fixed and weights[fixed - 1] <= weight:
        fixed -= 1
        weight += weights[fixed]

    # one shuffle for the anchors and for what tasks have settled already, and nothing of it is written twice
    known = spark.sparkContext.broadcast(hot)  # 100,000 numbers at most
    rows = live.mapInArrow(_scan(length, parts, marked, homes, known), ROWS)
    for k, r in enumerate(levels):
        rows = rows.unionByName(spark.read.schema(LEVEL).parquet(r["path"]).select(F.lit(f"level{k}").alias("kind"), "part", "data"))
    matched = rows.repartition(deal, "part").sortWithinPartitions("part", "kind").mapInArrow(_match(length, homes, cuts, weights, fixed if index else None), ROWS)
    matched = saved(matched, "matches")
    if index:
        files, at = _folder(spark, f"{index}/states")
        number = 1 + max((int(f.getPath().getName()) for f in files.listStatus(at)), default=0) if files.exists(at) else 1
        path = f"{index}/levels/{number:08d}"
        matched.where("kind = 'level'").select("part", "data").write.parquet(path)
        last = max([x for x in (ends["b"], *(r["last_id"] for r in levels[:1])) if x is not None], default=-(1 << 63))
        state = [(k, r["path"], r["weight"]) for k, r in enumerate(levels[:fixed])] + [(fixed, path, weight)]
        spark.createDataFrame([(*s, length, parts, last, bytearray(hot.tobytes())) for s in state], META).coalesce(1).write.parquet(f"{index}/states/{number:08d}")
    spans = matched.where("kind = 'span'").select("kind", "part", "data")
    out = _met(spans, docs, homes, deal).mapInArrow(_cut(with_kept, marked), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, text string, rest {docs.schema['rest'].dataType.simpleString()}")
    return out if with_kept else out.drop("kept", "text", "rest")
