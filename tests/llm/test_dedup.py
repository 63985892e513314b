import hashlib
import random
import re

import numpy as np
import pytest

from larkspur.llm.common import new_path
from larkspur.llm.components import component_labels
from larkspur.llm.jaccard import near_copies, overlaps
from larkspur.llm.pivots import near_vectors
from larkspur.llm.suffix_index import stored_levels, without_repeats

SCHEMA = "doc_id long, text string, label string"  # a column named as one of the operator's own


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 120))) for _ in range(n // 3)]
    out = list(texts)
    while len(out) < n:
        t = rng.choice(texts).split()
        how = rng.random()
        if how < 0.4:
            t[rng.randrange(len(t))] = "changed"
        elif how < 0.6:
            t = t[len(t) // 3 :] + rng.choice(texts).split()[:30]
        elif how < 0.8:
            t = t[: rng.randint(1, len(t))]
        out.append(" ".join(t))
    out += ["", "  \n", "one", "one", "a" * 400, "a" * 120, "\U0001f600 " * 60]
    rows = [(i * 3 % 1009, t, "x") for i, t in enumerate(out)]
    return rows + [(5000, None, "x"), (None, out[0], "x"), (rows[4][0], rows[4][1], "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_long_repeats_against_brute_force(spark, seed):
    rows = corpus(seed)
    first = {}
    for d, t, _ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49) if d is not None else ():
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], d), d)
    want = []
    for d, t, _ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49) if d is not None else ():
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    got = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")) for r in without_repeats(spark.createDataFrame(rows, SCHEMA), carry=("label",)).collect()]
    assert sorted(map(repr, got)) == sorted(repr((*w[:5], bytes(w[5]))) for w in want)
    assert sum(w[2] for w in want) > 1000
    # frequent strings by their single windows
    crowded = without_repeats(spark.createDataFrame(rows, SCHEMA), crowd=1, with_kept=False).collect()
    assert sorted(map(repr, map(tuple, crowded))) == sorted(repr(w[:5]) for w in want)
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_stored_index_gives_what_one_pass_gives(spark):
    rows = sorted({r[0]: r for r in corpus(7, 90) if r[0] is not None}.values())
    rows[50] = (rows[50][0], " ".join(f"w{i % 977}" for i in range(60_000)), "x")  # a very long text
    want = sorted(map(tuple, without_repeats(spark.createDataFrame(rows, SCHEMA), with_kept=False).collect()))
    index, got = new_path(spark, "index"), []
    for k in range(5):
        got += map(tuple, without_repeats(spark.createDataFrame(rows[k * 20 : k * 20 + 20], SCHEMA), with_kept=False, batches=k % 2 + 1, index=index).collect())
    assert sorted(got) == want and sum(w[2] for w in want) > 1000
    assert [r["weight"] for r in stored_levels(spark, index)] == [4, 1]
    with pytest.raises(ValueError):
        without_repeats(spark.createDataFrame(rows[:3], SCHEMA), index=index)


def shingled(text):
    words = re.findall(r"[^\x00-\x20]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


@pytest.mark.parametrize("seed", [3, 4])
def test_near_copies_against_brute_force(spark, seed):
    rows = corpus(seed)
    sets = [shingled(t) if d is not None else frozenset() for d, t, _ in rows]
    links, group = [set() for _ in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i].add(j)
    for _ in rows:
        group = [min([group[i], *(group[j] for j in links[i])], key=lambda k: (rows[k][0] is None, rows[k][0], k)) for i in range(len(rows))]
    want = [(d, rows[group[i]][0], len(links[i])) for i, (d, _, _) in enumerate(rows)]
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in near_copies(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(w[2] for w in want) > 40
    assert near_copies(spark.createDataFrame([], SCHEMA)).collect() == []


def test_overlaps_of_many_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, 120)).astype(np.uint64) for _ in range(40)]
    home = rng.integers(0, 2, 40)
    got = overlaps(sets, home)
    for i in range(40):
        for j in range(i + 1, 40):
            assert got[i, j] == (len(np.intersect1d(sets[i], sets[j])) if home[i] == home[j] else 0)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(45)] + [(7, 7), (None, 3), (500, 500)]
    label = {v: v for e in edges for v in e if None not in e and e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a in label and b in label and a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres, centres[:10] + 0.05 * rng.normal(size=(10, 16)), centres[:10] * 2, centres[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] * 16, "x"), (903, [1.0], "x"), (904, [None] * 16, "x"), (0, x[0].tolist(), "x")]
    rows += [(905, [1.0, 2.0, 3.0], "x"), (906, [1.0, 2.0, 3.001], "x"), (907, [3.0, -2.0, 1.0], "x"), (1, (-x[7]).tolist(), "x")]
    schema = "vec_id long, embedding array<float>, pivot string"
    got = near_vectors(spark.createDataFrame(rows, schema)).collect()
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and len(v) == 16 and i < 900 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = unit @ unit.T >= 0.95
    want = sorted((i, int(n) - 1) for (i, _), n in zip(good, hit.sum(1), strict=True))
    assert sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] < 900) == want
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in got if r["vec_id"] >= 900 and r["vec_id"] not in (905, 906))
    # vectors of another length link among themselves, and rows of one vec_id have links of their own
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in (905, 906)) == [(905, 1, 905), (906, 1, 905)]
    split = near_vectors(spark.createDataFrame(rows, schema), long_list=4).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, got))
    assert {r["vec_id"]: r["component_id"] for r in got}[40] == 0 and not {r["vec_id"]: r["kept"] for r in got}[40]
    assert near_vectors(spark.createDataFrame([], schema)).collect() == []


def test_components_take_few_jobs(spark):
    """A hub, a long path and many small components, in few jobs of the driver."""
    edges = [(1000 + k, 5) for k in range(400)] + [(k, k + 1) for k in range(2000, 2600)] + [(10_000 + 2 * k, 10_001 + 2 * k) for k in range(300)]
    edges += [(9_000, 8_000 + k) for k in range(400)] + [(5, 5), (None, 1)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("components", "components")
    try:
        labels = component_labels(df)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    got = {r["id"]: r["label"] for r in labels.collect()}
    want = {1000 + k: 5 for k in range(400)} | {5: 5} | {k: 2000 for k in range(2000, 2601)} | {10_000 + 2 * k + j: 10_000 + 2 * k for k in range(300) for j in (0, 1)}
    assert got == want | {8_000 + k: 8_000 for k in range(400)} | {9_000: 8_000}
    assert jobs <= 50, jobs  # 137 with stars made by joins
