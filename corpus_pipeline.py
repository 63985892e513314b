"""The corpus pipeline: documents pass one operator after another.

A stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns
of documents; the last one returns packed pieces. Every stage works on all that
the one before it kept. Null, empty and repeated rows are treated as each
operator says; rows that are neither judged bad nor copies are never dropped.
Texts of one doc_id are judged apart: a row goes by its doc_id and its text.
Very long texts pass whole, an empty table gives empty results, and columns
other than those of documents are left behind by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import saved, table
from larkspur.llm.importance import kept_documents
from larkspur.llm.jaccard import near_copies
from larkspur.llm.latent import leaks
from larkspur.llm.packing import pack
from larkspur.llm.suffix_index import without_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id and text gone names, by doc_id and mark."""
    marked = docs.withColumn("mark", F.xxhash64("text"))
    return marked.join(gone, marked["doc_id"].eqNullSafe(gone["doc_id"]) & (marked["mark"] == gone["mark"]), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    return kept_documents(docs, table(spark, sf_dir, "labels"), COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies one with the smallest doc_id stays, and of equal rows one."""
    copies = saved(near_copies(docs).where("not kept").select("doc_id", "mark").distinct(), "copies")
    live = docs.where("doc_id is not null").withColumn("mark", F.xxhash64("text"))
    # equal rows become one before the shuffle, which is that of the anti-join
    once = live.groupBy("doc_id", "mark").agg(*[F.first(c).alias(c) for c in COLUMNS[1:]]).join(copies, ["doc_id", "mark"], "left_anti")
    return once.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What repeats 50 bytes of a document with a smaller doc_id goes; documents stay, whatever is left of them."""
    left = without_repeats(docs, carry=("lang", "source"))
    return left.select("doc_id", "text", "rest.lang", "rest.source", F.length("text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return _without(docs, leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "mark").distinct())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)


STAGES = [("quality", quality), ("near_copies", one_of_each), ("repeats", repeats), ("decontamination", decontamination), ("packing", packing)]

#: Hashing, model fitting and packing have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
