import random

from larkspur.operators import store

SCHEMA = "seq long, id string, email string, unsubscribe_token string"


def replay(stored, requests):
    keys = [{r[k] for r in stored if r[k] is not None} for k in (1, 2, 3)]
    out = []
    for r in sorted(requests):
        new = all(r[k] is None or r[k] not in keys[k - 1] for k in (1, 2, 3))
        if new:
            for k in (1, 2, 3):
                if r[k] is not None:
                    keys[k - 1].add(r[k])
        out.append((*r, not new))
    return out


def both(spark, stored, requests):
    order = requests[:]
    random.Random(1).shuffle(order)
    got = store.subscribe(spark.createDataFrame(stored, SCHEMA), spark.createDataFrame(order, SCHEMA), "seq")
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(replay(stored, requests), key=key)


def test_a_refused_request_blocks_nothing(spark):
    both(spark, [(0, "1", "s@x", "ts")], [(1, "1", "a@x", "t1"), (2, "2", "a@x", "t2")])


def test_keys_that_clash_crosswise(spark):
    rng = random.Random(7)
    any_of = lambda n: str(rng.randint(0, n)) if rng.random() > 0.05 else None
    for n in (8, 30, 90):
        rows = [(k, any_of(n), any_of(n), any_of(n)) for k in range(60)]
        both(spark, [(0, any_of(n), any_of(n), any_of(n)) for _ in range(6)], rows)


def test_a_frequent_address_and_a_chain(spark):
    hot = [(k, f"h{k}", "everyone@x", f"ht{k}") for k in range(3000)]
    chain = [(10_000 + k, f"c{k // 2}", f"c{(k + 1) // 2}@x", f"ct{k}") for k in range(12)]
    again = [(20_000, *hot[7][1:]), (20_001, *hot[0][1:]), (20_002, None, None, None), (20_003, None, None, None), (20_004, None, "c0@x", None)]
    both(spark, [(0, "c2", "z@x", "zt")], hot + chain + again)
    empty = spark.createDataFrame([], SCHEMA)
    assert store.subscribe(empty, empty, "seq").collect() == []
    assert [r["already_exists"] for r in store.subscribe(empty, spark.createDataFrame([(1, "a", "b", "c")] * 2, SCHEMA), None).collect()].count(False) == 1
