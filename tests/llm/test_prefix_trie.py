import hashlib
import random
import re
import zlib

from larkspur.llm.prefix_trie import prefix_trie, rebuilt, stored_turns, verified


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    # nodes by number; children by the turn that leads to them
    kids, parent, words, members, ends = [{}], [None], [0], [[]], [[]]
    for c in sorted(convs):
        h = zlib.crc32(str(c).encode()) % 4
        at = 0
        members[0].append(c)
        for t in convs.get(c - c % 20, [])[:h] + convs[c][h:]:
            if t not in kids[at]:
                kids[at][t] = len(kids)
                kids.append({})
                parent.append(at)
                words.append(len(re.findall(r"[^\x20\x09-\x0D]+", t[1])))
                members.append([])
                ends.append([])
            at = kids[at][t]
            members[at].append(c)
        ends[at].append(c)
    n = len(kids)
    depth, leaves, saved = [0] * n, [0] * n, [(len(m) - 1) * w for m, w in zip(members, words, strict=True)]
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
    for k in reversed(range(n)):
        leaves[k] += not kids[k]
        if k:
            leaves[parent[k]] += leaves[k]
            saved[parent[k]] += saved[k]
    return sorted((min(members[k]), depth[k], -1 if k == 0 else min(members[parent[k]]), len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k in range(n))


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_equals_brute_force(spark):
    rng = random.Random(4)
    say = lambda: rng.choice(["hi", "what is this", "tell me more\tnow please", "", None, "é ü  ß"])
    rows = [(c, t, rng.choice(["user", "assistant", None]), say()) for c in range(130) if c % 7 for t in range(rng.choice([0, 1, 2, 3, 5, 8]))]
    rows += [(c, t, "user", "the same in all") for c in range(2000, 2300) for t in range(3)]  # a frequent conversation
    rows += [(5, None, "user", "without a number"), (5, None, None, "another"), (40, 2, "user", "same turn"), (40, 2, "user", "same turn"), (40, 2, "assistant", "x" * 70), (None, 1, "user", "lost"), (1_000_003, 0, "user", "far " * 100_000), (-7, 0, "user", "below"), (-7, 9, "user", "zero"), (2**40, 0, None, None)]
    turns = spark.createDataFrame([(*r, 0, 0) for r in rows], f"{SCHEMA}, depth long, pos int")
    assert found(prefix_trie(turns)) == brute(rows)
    assert prefix_trie(turns.limit(0)).collect() == []
    only = [(24, 0, "user", "gone")]  # its base is absent and it has no more turns than its head: none are left
    assert found(prefix_trie(spark.createDataFrame(only, SCHEMA))) == brute(only)


def test_long_and_hot_conversations_are_spread(spark):
    # three quarters of all rows are one conversation and its copy, which tasks share and chunks of depths sum up
    rng = random.Random(8)
    long = [(t, "user" if t % 2 else "assistant", f"turn {rng.randint(0, 9)}") for t in range(5000)]
    rows = [(c, *t) for c in (4, 23) for t in long] + [(c, t, "user", f"w{c % 9}") for c in range(100, 400) for t in range(9)]
    rows += [(4, None, "user", f"unnumbered {k % 40}") for k in range(600)]
    rows += [(23, None, "user", f"unnumbered {k % 40}") for k in range(600)]
    turns = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert found(prefix_trie(turns)) == brute(rows)


def test_turns_that_differ_under_one_fingerprint_are_noticed(spark):
    rows = [(c, t, "user", f"c{c} t{t}") for c in (20, 40, 41, 42) for t in range(5)] + [(60, t, "user", f"c20 t{t}") for t in range(5)]
    stored = stored_turns(spark.createDataFrame(rows, SCHEMA))
    paths, _ = rebuilt(stored, 20, 4)
    assert verified(stored, paths)
    wrong = stored.selectExpr("conv_id", "pos", "role", "case when conv_id = 60 and pos = 4 then 'other' else text end as text")
    assert not verified(wrong, paths)
