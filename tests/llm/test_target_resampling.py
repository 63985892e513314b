import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.target_resampling import Head, _texts, crc32_on, feature_buckets, resampled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, max_n):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, max_n + 1) for k in range(len(words) - n + 1)]


def brute(rows, target, max_n, buckets, percent, least):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, max_n)[1])
    s, t = count([x for _, x in rows]), count(target)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * float(s.total() + buckets) / ((s[b] + 1) * float(t.total() + buckets)))) for b in s}
    out = []
    for doc, text in rows:
        n, own = features(text, max_n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(order[: percent * len(order) // 100], 1):
        ranks.setdefault(r[:1] + r[2:], []).append(k)
    return sorted((r[0] is not None, r[0], *r[2:]) for r in out if r[0] is not None) + [(False, *r[:1], *r[2:]) for r in out if r[0] is None], ranks


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=90), st.integers(0, 2**32 - 1)), max_size=8))
def test_crc_goes_on_from_a_state(spans):
    data = np.frombuffer(b"".join(b for b, _ in spans), np.uint8)
    end = np.cumsum([len(b) for b, _ in spans], dtype=np.int64)
    start = end - np.array([len(b) for b, _ in spans], np.int64)
    got = crc32_on(np.array([s for _, s in spans], np.uint32), data, start, end)
    assert got.tolist() == [zlib.crc32(b, s) for b, s in spans]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aBé0ß .\n-_"), max_size=40), max_size=6), st.sets(st.sampled_from(["a", "b", "é", "ab", "0", "ba", "aaaaaaaaaaaaaaaab"])), st.integers(1, 3))
def test_features_with_any_head_are_those_of_the_definition(texts, words, max_n):
    head = Head(sorted(words), [(a, b) for a in words for b in words], 97)
    got = [[] for _ in texts]
    for i, _, data, off in _texts(pa.array(texts, pa.string())):
        found, of, words_in = feature_buckets(data, off, head, max_n, 97)
        for b, k in zip(found.tolist(), of.tolist(), strict=True):
            got[i + k].append(b)
        assert words_in.tolist() == [features(t, 1)[0] for t in texts[i : i + len(words_in)]]
    assert [Counter(x) for x in got] == [Counter(zlib.crc32(f.encode()) % 97 for f in features(t, max_n)[1]) for t in texts]


@pytest.mark.parametrize("max_n, head_words", [(1, 50), (2, 50), (2, 0), (3, 4)])
def test_resampling_equals_brute_force(spark, max_n, head_words):
    long = "tail" * 40 + " " + "word Zwei-drei été " * 30_000
    rows = [(i, " ".join(f"w{i % 7} x{j % (i % 9 + 1)} The é{j}" for j in range(i % 11))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "?! -- \n"), (503, long), (None, long), (None, "no id " * 12), (7, rows[7][1]), (7, rows[7][1]), (8, "another text of one id " * 6)]
    target = ["the w1 x0 é3 the", None, "", "zwei drei"]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n_words long, buckets string")
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampled(docs, bench, max_n=max_n, buckets=211, percent=30, head_words=head_words, head_pairs=8).collect()
    want, ranks = brute(rows, target, max_n, 211, 30, 20)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((r[1:] for r in want), key=key)
    drawn = {}
    for r in got:
        if r["rank"] is not None:
            drawn.setdefault(tuple(r)[:4], []).append(r["rank"])
    assert {k: sorted(v) for k, v in drawn.items()} == ranks and ranks


def test_nothing_to_draw_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resampled(empty, empty).collect() == []
    one = resampled(spark.createDataFrame([(1, "one two " * 20)], "doc_id long, text string"), empty, percent=100).first()
    assert (one["n_features"], one["rank"]) == (40, 1)
