"""Every query of the library against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from larkspur.plans import queries as plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def rows_of(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir)
    want = duck.sql(plans.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows_of(got.select(*columns).collect()) == rows_of(want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_phase_two_equals_a_global_pass(spark, sf_dir):
    from pyspark.sql import functions as F

    from larkspur.operators import dedup
    from larkspur.plans import fixtures

    rows = plans._after_phase_one(fixtures.listings(spark, sf_dir))
    links = {(r["a"], r["b"]) for r in dedup.matching_pairs(rows).collect()}
    order = rows.select("id", F.length("raw_description").alias("n"), "created_at", "event_date_start").orderBy("event_date_start", "id").collect()
    want = sorted(x[:2] for x in dedup.sweep([(r["id"], r["n"], r["created_at"]) for r in order], links))
    got = dedup.phase_two(rows)
    assert sorted((r["duplicate_id"], r["canonical_id"]) for r in got.collect()) == want and want
    assert [r["seq"] for r in got.orderBy("seq").collect()] == list(range(len(want)))


def test_phase_two_sweeps_components_of_any_size(spark):
    import datetime as dt
    import random

    from larkspur.operators import dedup

    # more than 5000 copies in one component, around them rows that match only some
    rng = random.Random(3)
    day, at = dt.date(2026, 3, 1), dt.datetime(2026, 1, 1)
    rows = [(f"c{i:05d}", "Spring fair of lanterns", "Old harbour hall", day, None, "x" * rng.randint(0, 40), at + dt.timedelta(hours=rng.randint(0, 9))) for i in range(5100)]
    titles = ["Spring lanterns", "Spring lanterns market", "Market evening songs", "Evening songs choir", "Choir rehearsal winter"]
    rows += [(f"{rng.choice('bcd')}x{i}", rng.choice(titles), "Old harbour hall", day + dt.timedelta(days=rng.randint(0, 6)), day + dt.timedelta(days=rng.randint(6, 9)), "y" * rng.randint(0, 9), at + dt.timedelta(hours=rng.randint(0, 9))) for i in range(60)]
    schema = "id string, raw_title string, venue string, event_date_start date, event_date_end date, raw_description string, created_at timestamp"
    everything = spark.createDataFrame(rows, schema)
    got = dedup.phase_two(everything).collect()
    assert all(r["duplicate_id"] for r in got) and len({r["duplicate_id"] for r in got if r["duplicate_id"] < "c" * 2 and r["duplicate_id"][1] != "x"}) > 5000

    some = spark.createDataFrame(rows[:150] + rows[5100:], schema)
    links = {(r["a"], r["b"]) for r in dedup.matching_pairs(some).collect()}
    order = sorted(rows[:150] + rows[5100:], key=lambda r: (r[3], r[0]))
    want = sorted(x[:2] for x in dedup.sweep([(r[0], len(r[5]), r[6]) for r in order], links))
    assert sorted((r["duplicate_id"], r["canonical_id"]) for r in dedup.phase_two(some).collect()) == want
    assert dedup.phase_two(some.limit(0)).collect() == []


LISTED = "id string, raw_title string, venue string, event_date_start date, event_date_end date, raw_description string, created_at timestamp, included boolean, is_duplicate boolean"


def test_matching_finds_what_comparing_all_finds(spark):
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from larkspur.operators import dedup

    rng = random.Random(5)
    words = lambda some, most: " ".join(rng.choice(some) for _ in range(rng.randint(0, most)))
    days = lambda: dt.date(2026, 3, 20) + dt.timedelta(days=rng.randint(0, 25))
    rows = [(f"{i:03d}", words("pqrstu", 6), words("xyz", 3), days(), rng.choice([None, days()]), "", dt.datetime(2026, 1, 1), rng.choice([None, True]), False) for i in range(250)]
    listings = spark.createDataFrame(rows, LISTED)
    shapes = dedup._shaped(listings).cache()
    a, b = (shapes.select(*[F.col(c).alias(f"{x}_{c}") for c in shapes.columns]) for x in "ab")
    exact = dedup.titles_match(F.col("a_tt"), F.col("b_tt")) & dedup.venues_match(F.col("a_vt"), F.col("b_vt")) & dedup.dates_overlap(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))
    want = {tuple(r) for r in a.crossJoin(b).where(exact).select("a_h", "b_h").collect()}
    got = [tuple(r) for r in dedup.matching_shapes(listings, listings).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500

    ends = [x for r in dedup.matching_pairs(listings).collect() for x in r]
    counts = dedup.link_counts(listings).collect()
    assert {r["id"]: r["n_links"] for r in counts} == {r[0]: ends.count(r[0]) for r in rows}
    assert len(counts) == len(rows) and len({r["class_id"] for r in counts}) == shapes.count()


def test_matching_pairs_names_both_rows_of_every_link(spark):
    import datetime as dt
    import random

    from larkspur.operators import dedup

    def query(listings):
        return next(x.cell_contents for x in plans.QUERIES["matching_pairs"].__closure__ if getattr(x.cell_contents, "__name__", "") == "matching_pairs")(listings)

    # copies, near copies of one form, and rows that end before they start, in forms of more rows than a block has
    rng = random.Random(11)
    words = lambda some, most: " ".join(rng.choice(some) for _ in range(rng.randint(0, most)))
    day, at = dt.date(2026, 3, 1), dt.datetime(2026, 1, 1)
    days = lambda: day + dt.timedelta(days=rng.randint(0, 12))
    rows = [(f"{rng.choice('abc')}{i}", words("pqrstu", 6), words("xyz", 3), days(), rng.choice([None, days()]), "", at, None, False) for i in range(120)]
    rows += [(f"{rng.choice('abc')}{i}", "der und zu" + rng.choice(["", f" k{i}"]), "Hof 12", day + dt.timedelta(days=i % 2), day + dt.timedelta(days=i % 3), "", at, None, False) for i in range(200, 290)]
    duck, listings = duckdb.connect(), spark.createDataFrame(rows, LISTED)
    duck.execute("CREATE TABLE listings (id VARCHAR, raw_title VARCHAR, venue VARCHAR, event_date_start DATE, event_date_end DATE)")
    duck.executemany("INSERT INTO listings VALUES (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    said = plans.ORACLE_SQL["matching_pairs"]
    want = sorted(duck.sql("WITH " + said[said.index("worded AS (") :]).fetchall())
    assert query(listings).columns == ["a", "b"] and len(want) > 2500
    assert sorted(map(tuple, query(listings).collect())) == want
    assert sorted(map(tuple, dedup.matching_pairs(listings, most=7).collect())) == want


def test_near_copies_are_not_compared_with_each_other(spark):
    import datetime as dt

    from larkspur.operators import dedup

    day, at = dt.date(2026, 3, 1), dt.datetime(2026, 1, 1)
    rows = [(f"{i:04d}", f"der und zu k{i} m{i}", "Hof 12", day, None, "", at, True if i % 2 else None, False) for i in range(1000)]
    rows += [("9998", "der und zu", "Hof 12", day - dt.timedelta(days=3), day, "", at, True, False), ("9999", "der der", "Hof", day, None, "", at, None, False)]
    found = dedup.phase_one(spark.createDataFrame(rows, LISTED))
    assert {r["canonical_id"] for r in found.collect()} == {"9998"} and found.count() == 501
    seen = {}
    plan = found._jdf.queryExecution().executedPlan()
    nodes = [plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            seen[node.hashCode()] = node.metrics().apply("numOutputRows").value()
        below = node.plan() if "QueryStage" in name else None
        nodes += [below] if below is not None else [node.children().apply(k) for k in range(node.children().size())]
    assert seen and max(seen.values()) < 100_000


def test_near_copies_are_of_one_form(spark):
    import datetime as dt

    from larkspur.operators import dedup

    day, at = dt.date(2026, 3, 1), dt.datetime(2026, 1, 1)
    rows = [(f"{i:04d}", f"der und zu k{i} m{i % 7}", "Hof 12", day, None, "x" * (i * 37 % 101), at, None, False) for i in range(400)]
    formed, pairs = dedup.forms(spark.createDataFrame(rows, LISTED))
    assert formed.count() == 400 and pairs.count() == 1


def test_phase_two_of_any_words_and_dates_equals_a_pass(spark):
    import datetime as dt
    import random

    from larkspur.operators import dedup

    # some end before they start: these match what covers both days, but not their copies
    rng = random.Random(8)
    words = lambda some, most: " ".join(rng.choice(some) for _ in range(rng.randint(0, most)))
    days = lambda: dt.date(2026, 3, 20) + dt.timedelta(days=rng.randint(0, 25))
    rows = [(f"{i:03d}", words("pqrstuvw", 6), words("xyz", 3), days(), rng.choice([None, days()]), "d" * rng.randint(0, 9), dt.datetime(2026, 1, rng.randint(1, 9)), None, False) for i in range(220)]
    rows += [(f"{i:03d}", "pp qq", "xx", dt.date(2026, 4, 9), dt.date(2026, 4, 5), "", dt.datetime(2026, 1, 1), None, False) for i in range(300, 303)]
    rows += [("400", "pp qq", "xx", dt.date(2026, 4, 9), None, "ddd", dt.datetime(2026, 1, 1), None, False), ("401", "pp qq", "xx", dt.date(2026, 4, 1), dt.date(2026, 4, 20), "", dt.datetime(2026, 1, 2), None, False), ("402", "pp qq", "xx", dt.date(2026, 4, 9), dt.date(2026, 4, 20), "", dt.datetime(2026, 1, 1), None, False)]
    listings = spark.createDataFrame(rows, LISTED)
    for some in (listings.where("id < '300'"), listings.where("id >= '300'")):
        links = {(r["a"], r["b"]) for r in dedup.matching_pairs(some).collect()}
        order = sorted(map(tuple, some.collect()), key=lambda r: (r[3], r[0]))
        want = dedup.sweep([(r[0], len(r[5]), r[6]) for r in order], links)
        assert [(r["duplicate_id"], r["canonical_id"]) for r in dedup.phase_two(some).orderBy("seq").collect()] == [x[:2] for x in want] and want


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) >= 60 and e.entry(spark).columns


def test_dedup_plan_has_no_cross_join(spark, sf_dir):
    plan = plans.QUERIES["matching_pairs"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pages_of_all_sources_are_made_once(spark, sf_dir):
    plan = plans.QUERIES["all_sources_report"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan
