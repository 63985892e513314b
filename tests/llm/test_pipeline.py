import corpus_pipeline
from larkspur.llm.jaccard import near_copies
from larkspur.llm.latent import leaks


def test_stages_in_order_and_their_effect(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    single = corpus_pipeline.one_of_each(spark, docs, sf_dir)
    assert single.columns == docs.columns and near_copies(single).where("n_links > 0").isEmpty()
    clean = corpus_pipeline.decontamination(spark, docs, sf_dir)
    assert leaks(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).isEmpty() and clean.count() < docs.count()
    assert corpus_pipeline.repeats(spark, docs, sf_dir).count() == docs.count()
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty() and not packed.isEmpty()


def test_texts_of_one_doc_id_are_judged_apart(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    near = say(1).replace("w1x30", "other")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    rows = [(1, say(1)), (5, say(1)), (5, say(2)), (5, near), (5, near), (7, say(3)), (7, say(3)), (9, item), (9, say(4)), (None, near)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], schema)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()]
    assert sorted(left, key=repr) == sorted([(1, say(1)), (5, say(2)), (7, say(3)), (9, item), (9, say(4)), (None, near)], key=repr)
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, docs, sf_dir).collect()]
    assert sorted(left, key=repr) == sorted((r for r in rows if r != (9, item)), key=repr)


def test_stages_against_brute_force(spark, sf_dir):
    import random
    import re

    from larkspur.llm.importance import resampled

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = {}
    for d, t in texts:
        words = re.findall(r"[^\x00-\x20]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    label = {d: d for d in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    low = min(label[a], label[b])
                    label = {d: low if x in (label[a], label[b]) else x for d, x in label.items()}
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, sf_dir).collect()} == set(label.values())
    kept = {r["doc_id"] for r in resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()} == kept and len(kept) > 150
    some = dict(random.Random(1).sample(texts, 60))
    first: dict[bytes, int] = {}
    for d in sorted(some):
        b = (some[d] or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], d)
    want = {}
    for d, t in some.items():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        want[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    left = corpus_pipeline.repeats(spark, docs.where(docs["doc_id"].isin(*some)), sf_dir)
    assert {r["doc_id"]: r["text"] for r in left.collect()} == want


def test_stages_on_odd_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, "en", "s", 9, "x"), (1, long, "en", "s", 9, "x"), (2, long, None, None, None, "x"), (3, None, "en", "s", 0, "x"), (4, "", "en", "s", 0, "x"), (None, "no id at all", "en", "s", 9, "x"), (1, "another text", "en", "s", 9, "x")]
    docs = spark.createDataFrame(rows, schema)
    for docs in (docs, docs.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert out.count() == (n - 2 if name == "near_copies" and n else n), name
        assert corpus_pipeline.packing(spark, docs, sf_dir).agg(F.count_distinct("doc_id")).first()[0] == (4 if n else 0)
