import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.common import new_path
from larkspur.llm.encode import encoder
from larkspur.llm.packing import pack
from larkspur.llm.token_archive import read_archive, write_archive

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a  b", "\n\nfoo bar\n", "x\ty z", "don't 'll s", "a b", "<|endoftext|> hi", "É é́ x", "\r\nq", "123 45\n67", "Iİ ΑΣ.", "a\x1cb", "\x01 a", "b", "a\nb c\nb", "word " * 3000]
DOCS = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "y"), (None, "lost id", "z"), (3, "\n\nfoo bar\n", "again"), (3, "other text", "again")]
SCHEMA = "doc_id long, text string, frames string"  # a column named as one of the archive's


def ids_of(path, text, end):
    return np.array([*encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("abéE's .,1\n \t ​́<|!")), max_size=6))
def test_encoder_gives_the_librarys_ids(path, texts):
    ids, off = encoder(path).encode(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, off, off[1:], strict=False):
        assert ids[a:b].tolist() == encoder(path).tokenizer.encode(t, add_special_tokens=False).ids


def test_archive_round_trip(spark):
    path = new_path(spark, "archive")
    write_archive(spark.createDataFrame(DOCS, SCHEMA), path, WORD, 1, shard_tokens=500)
    got = [tuple(r) for r in read_archive(spark, path, with_ids=True).orderBy("start").collect()]
    want, at = [], 0
    for doc, text, _ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of(WORD, text, 1)
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    assert got == want
    some = read_archive(spark, path, doc_ids=[16, 100], with_ids=True).collect()
    assert sorted(tuple(r) for r in some) == sorted(r for r in want if r[0] in (16, 100))


def test_archive_of_nothing(spark):
    path = new_path(spark, "archive")
    write_archive(spark.createDataFrame([], SCHEMA), path, WORD, 1)
    assert read_archive(spark, path).collect() == []


def test_packing_places_every_piece_once(spark):
    rows = [r.asDict() for r in pack(spark.createDataFrame(DOCS, SCHEMA), BYTE, 2).collect()]
    want = []
    for doc, text, _ in DOCS:
        ids = ids_of(BYTE, text, 2)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    for n in {r["sequence_id"] for r in rows}:
        own = sorted((r["offset"], r["length"]) for r in rows if r["sequence_id"] == n)
        assert [o for o, _ in own] == [sum(w for _, w in own[:k]) for k in range(len(own))] and sum(w for _, w in own) <= 1024
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 1024)
    assert pack(spark.createDataFrame([], SCHEMA), BYTE, 2).collect() == []
