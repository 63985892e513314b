import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from larkspur.llm.encode import encoder
from larkspur.llm.vector_packing import Limits, chat_examples, pack_documents, pack_examples

WORD = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text, end=2):
    return np.array([*encoder(WORD).tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def check_documents(rows, docs, limits):
    """Every id in one piece, sequences gapless, within their limits and without padding."""
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append(ids_of(t))
    sequences, found = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        found.setdefault(r["doc_id"], []).append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        n = sum(r["length"] for r in own)
        assert n == limits.tokens or (n < limits.tokens and n & (n - 1) == 0)
        assert len(own) <= limits.segments and n - len(own) <= limits.loss
    assert set(found) == set(want)
    for d, texts in want.items():
        left = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found[d])
        for ids in texts:  # texts of one doc_id take their pieces from those that are left
            at = 0
            while at < len(ids):
                k = next(k for k, x in enumerate(left) if x[0] == at and x[3] == len(ids) and zlib.crc32(ids[at : at + x[1]].tobytes()) == x[2])
                at += left.pop(k)[1]
            assert at == len(ids)
        assert not left
    return sequences


SCHEMA = "doc_id long, text string, length string"


@pytest.mark.parametrize("limits, block", [(Limits(), 1024), (Limits(256, 6, 256), 16), (Limits(256, 128, 100), 16), (Limits(100, 3, 99), 1), (Limits(7, 1, 1), 64)])
def test_documents_are_packed_without_padding(spark, limits, block):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.choice([0, 1, 2, 9, 40, 90, 300])))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "long " * 20_000), (None, "no id here"), (3, docs[3][1]), (3, docs[3][1]), (3, "another one of this id")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA)
    rows = [r.asDict() for r in pack_documents(frame, WORD, 2, limits, block).collect()]
    check_documents(rows, docs, limits)
    again = [r.asDict() for r in pack_documents(frame, WORD, 2, limits, block).collect()]
    key = lambda r: (r["sequence_id"], r["offset"])
    assert sorted(again, key=key) == sorted(rows, key=key)


def test_few_documents_are_cut(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    rows = [r.asDict() for r in pack_documents(docs, WORD, 2).collect()]
    sequences = check_documents(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], Limits())
    total = sum(r["length"] for r in rows)
    # full ones as many as the ids allow, then one for each bit of what is left
    assert len(sequences) == total // 4096 + bin(total % 4096).count("1")
    short = {r["doc_id"] for r in rows if r["doc_tokens"] <= 4096}
    cut = {r["doc_id"] for r in rows if r["doc_tokens"] <= 4096 and r["length"] < r["doc_tokens"]}
    assert len(cut) < 0.3 * len(short)


def test_examples_stay_whole_under_three_limits(spark):
    rng = random.Random(9)
    limits = Limits(2048, 12, 700)
    rows = [(i, t := rng.randint(1, 900), rng.randint(1, 3), rng.randint(0, t // 2)) for i in range(3000)] + [(None, 10, 1, 5), (None, 10, 1, 5), (7, 10, 1, 5), (8, 3000, 1, 0), (9, 10, 13, 0), (10, 1000, 1, 800), (11, None, None, None), (12, 0, 0, 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "id long, tokens long, segments long, loss long, offset long")
    got = [tuple(r) for r in pack_examples(frame, limits).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((r[:4] for r in got), key=key) == sorted(((r[0], *(x or 0 for x in r[1:])) for r in rows), key=key)
    apart = [r for r in got if r[4] is None]
    assert sorted(r[0] for r in apart) == [8, 9, 10] and all(r[5] is None for r in apart)
    by = {}
    for r in got:
        if r[4] is not None:
            by.setdefault(r[4], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r[5], r[1]))
        assert all(sum(r[k] for r in own) <= most for k, most in ((1, 2048), (2, 12), (3, 700)))
        assert [r[5] for r in own] == [sum(x[1] for x in own[:k]) for k in range(len(own))]
    placed = [r for own in by.values() for r in own]
    least = max(-(-sum(r[k] for r in placed) // most) for k, most in ((1, 2048), (2, 12), (3, 700)))
    assert least <= len(by) <= 1.03 * least + 3
    assert pack_examples(frame.limit(0)).collect() == [] and pack_documents(spark.createDataFrame([], SCHEMA), WORD, 2).collect() == []


def test_the_next_example_has_the_largest_product(spark):
    # much loss is demanded, so that the first to go beside a long one without loss is the one with most of it
    rows = [(1, 90, 1, 0), (2, 10, 1, 9), (3, 10, 1, 2), (4, 8, 1, 8), (5, 9, 1, 10)]
    frame = spark.createDataFrame(rows, "id long, tokens long, segments long, loss long").coalesce(1)
    got = {r["id"]: r["sequence_id"] for r in pack_examples(frame, Limits(100, 9, 10)).collect()}
    assert got[1] == got[5] and len(set(got.values())) == 3


def test_chat_examples_bear_loss_on_answers(spark, sf_dir):
    turns = spark.createDataFrame([(1, "user", "hello there"), (1, "assistant", "hi"), (2, None, None), (None, "user", "lost"), (1, "assistant", "hi")], "conv_id long, role string, text string")
    got = {tuple(r) for r in chat_examples(turns, WORD).collect()}
    assert got == {(1, len(ids_of("hello there")) + 2 * len(ids_of("hi")), 1, 2 * len(ids_of("hi"))), (2, 1, 1, 0)}
    limits = Limits(4096, 16, 2048)
    packed = pack_examples(chat_examples(spark.read.parquet(f"{sf_dir}/conversations.parquet"), WORD), limits)
    sums = packed.where("sequence_id is not null").groupBy("sequence_id").sum("tokens", "loss", "segments")
    assert sums.where("`sum(tokens)` > 4096 or `sum(loss)` > 2048 or `sum(segments)` > 16").isEmpty() and packed.where("sequence_id is null").where("tokens <= 4096 and loss <= 2048").isEmpty()
