"""Exact token ids at the price of a look-up for each word that was seen before.

Both vocabularies used here never merge across a single blank, so that ids of a
text are those of its blank-separated parts. Each distinct part is encoded once
by the tokenizers library, and found again by a 64-bit hash; a text that could
break this rule (runs of white space, marker strings, control characters) goes
to the library as a whole. Look-ups and the joining of ids are array operations
on whole ranges of a column.
"""

from __future__ import annotations

import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa

from .common import mixed, pieces_of, prefix_sums, range_hash, utf8

_ODD = re.compile(r"<\||[\s\x00-\x1f\x7f-\x9f\u180e\u200b-\u200d\ufeff]")
_SLOTS, _PROBES, _AT_ONCE = 22, 3, 1 << 15
_cached: dict[tuple[str, int], "Encoder"] = {}


class Encoder:
    """encode() gives the ids of all texts of a column. memo bounds the parts kept in memory."""

    def __init__(self, path: str, memo: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = memo
        self.blank_matters = self._ids("a b") != self._ids("a  b")
        self.mark = "\n" if self.blank_matters else " \x01 "
        self.mark_ids = self._ids(self.mark)
        if len(self.mark_ids) != 1:
            raise ValueError("the part separator must be one token")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _SLOTS, np.uint64)
        self.entry = np.zeros(1 << _SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 19, np.uint32), 0
        self.first, self.length, self.count = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 0  # length -1: an odd part

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _slots(self, h: np.ndarray):
        for k in range(_PROBES):
            yield (h >> np.uint64(k * 21) & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of the hashes, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for k, slot in enumerate(self._slots(h)):
            slot = slot[left]
            hit = self.keys[slot] == h[left]
            out[left[hit]] = self.entry[slot[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def _learn(self, h: np.ndarray, parts: list[str], context: np.ndarray) -> np.ndarray:
        """Encodes parts in one call and stores their ids; gives their entries. context: 0 after a blank, 1 after a line feed, 2 at a text's start."""
        odd = np.zeros(len(parts), bool)
        if _ODD.search(self.mark[:1].join(parts).replace(self.mark[:1], "")):
            odd = np.array([bool(_ODD.search(p)) for p in parts])
        keep = np.flatnonzero(~odd).tolist()
        lead = " " if self.blank_matters else ""
        said = self.mark.join([parts[k] if context[k] else lead + parts[k] for k in keep])
        ids = np.array(self.tokenizer.encode_batch_fast([said], add_special_tokens=False)[0].ids if keep else [], np.uint32)
        cuts = np.flatnonzero(ids == self.mark_ids[0])
        if keep and len(cuts) != len(keep) - 1:
            raise ValueError("a part holds the separator")
        begin, end = np.append(0, cuts + 1), np.append(cuts, len(ids))
        # a line feed is kept as the first id of the part after it: it lies just before the part, or is put there
        n, need = len(parts), len(ids) + 2 * len(parts)
        while self.used + need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + n > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        new = np.arange(self.count, self.count + n)
        self.length[new] = -1
        if keep:
            base = self.used + 1
            self.flat[self.used] = self.mark_ids[0]
            self.flat[base : base + len(ids)] = ids
            line = ((context[~odd] == 1) & self.blank_matters).astype(np.int64)
            self.first[new[~odd]] = base + begin - line
            self.length[new[~odd]] = end - begin + line
            self.used = base + len(ids)
        self.count += n
        left = np.arange(n)
        for slot in self._slots(h):
            slot = slot[left]
            free = self.keys[slot] == 0
            take = left[free]
            # of parts that want one slot the last one written has it
            self.keys[slot[free]] = h[take]
            self.entry[slot[free]] = new[take]
            left = left[self.keys[slot] != h[left]]
        return new

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the n + 1 offsets of the texts."""
        data, off = utf8(column)
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for i, j in pieces_of(off):
            a, b = self._range(data[off[i] : off[j]], off[i : j + 1] - off[i])
            ids.append(a)
            counts.append(b)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate([[0], *[np.cumsum(c) for c in [np.concatenate(counts)]]]) if counts else np.zeros(1, np.int64)

    def _range(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = len(off) - 1
        gap = (data == 32) | (data == 10)
        inside = ~gap
        head = np.zeros(len(data) + 1, bool)
        head[off[:-1]] = True
        head = head[: len(data)]
        starts = np.flatnonzero(inside & (head | np.append(True, gap[:-1]))) if len(data) else np.zeros(0, np.int64)
        tail = np.zeros(len(data), bool)
        tail[off[1:][off[1:] > 0] - 1] = True
        ends = np.flatnonzero(inside & (tail | np.append(gap[1:], True))) + 1 if len(data) else starts
        words = np.searchsorted(starts, off)
        owner = np.repeat(np.arange(texts), np.diff(words))
        context = np.zeros(len(starts), np.int8)
        odd = np.zeros(texts, bool)
        if self.blank_matters and len(data):
            before = data[np.maximum(starts - 1, 0)]
            context = np.where(head[starts], 2, np.where(before == 10, 1, 0)).astype(np.int8)
            # two separators in a row, or one at either end of a text
            bad = gap & (head | tail | np.append(False, gap[:-1]))
            odd[np.searchsorted(off, np.flatnonzero(bad), "right") - 1] = True
        h = range_hash(prefix_sums(data), starts, ends)
        h = mixed(h + context.astype(np.uint64)) | np.uint64(1)
        if self.count + len(h) // 2 > self.most:
            self._clear()
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, pick, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[pick]
            raw = data.tobytes()
            learnt = []
            for k in range(0, len(one), _AT_ONCE):  # the library holds much for each token while it works
                some = one[k : k + _AT_ONCE]
                parts = [raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                learnt.append(self._learn(h[some], parts, context[some]))
            entry[new] = np.concatenate(learnt)[back]
        length = self.length[entry].astype(np.int64)
        odd[owner[length < 0]] = True
        length[odd[owner]] = 0
        total = int(length.sum())
        out = self.flat[np.repeat(self.first[entry] - np.cumsum(length) + length, length) + np.arange(total)]
        count = np.bincount(owner, length, texts).astype(np.int64)
        if odd.any():  # these go to the library whole
            which = np.flatnonzero(odd)
            raw = data.tobytes()
            direct = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([raw[off[k] : off[k + 1]].decode() for k in which], add_special_tokens=False)]
            pieces = np.split(out, np.cumsum(count)[:-1])
            for k, x in zip(which, direct, strict=True):
                pieces[k] = x
                count[k] = len(x)
            out = np.concatenate(pieces)
        return out, count


def encoder(path: str, memo: int = 1_500_000) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    key = (path, memo)
    if key not in _cached:
        _cached[key] = Encoder(path, memo)
    return _cached[key]
