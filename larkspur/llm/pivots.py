"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its `prefix` nearest of a set of pivots, in order. An
inverted list for each pivot holds the vectors that have it in their prefix. Two
vectors are candidates if they share at least `shared` pivots, and are compared
once, in the list of their smallest common pivot, by cosine in double precision.
A list of more than `long_list` vectors is split by a second pivot of its
vectors, so that lists stay short while pivots are few; candidates that share
one pivot alone aren't wanted anyway.

Equal vectors are one entry of the index, with their number. Vectors of each
length have pivots and lists of their own. Lists that are still long are cut
into blocks, and pairs of blocks are the unit of work, so that no task holds a
list of any length; a block gives counts and a spanning forest, never its pairs.

Nulls: vectors that are null, zero, or hold null or non-finite components link
with nothing; each is a component of its own. Vectors of different lengths don't
link. Rows of equal vec_id count as separate vectors, whether their vectors are
equal or not. Very long vectors cost memory in proportion only. An empty table
gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_to, saved
from .components import component_labels

BLOCK = 1024


def _good() -> F.Column:
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine, F.lit(False))


def _unit(rows: list[bytes] | pd.Series, kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(r, kind) for r in rows]).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spread_out(sample: np.ndarray, most: int, alike: float = 0.7) -> np.ndarray:
    """Of the sampled unit vectors, in order, those that aren't close to one taken before, up to most of them.

    Pivots within one dense group would be about equally near to all of its vectors, and their order a matter of chance.
    """
    kept = np.empty((0, sample.shape[1]))
    for v in sample:
        if len(kept) >= most:
            break
        if not len(kept) or (kept @ v).max() < alike:
            kept = np.vstack([kept, v])
    return kept


def pivots_of(classes: DataFrame, length: int, count: int, most: int) -> np.ndarray:
    """Pivots for the vectors of one length, from a sample that a hash chooses: at most 4 * sqrt(count), and `most`."""
    chosen = min(max(16, 4 * math.isqrt(count)), most)
    sample = classes.where(F.size("embedding") == length).orderBy(F.xxhash64("h1", F.lit(7)), "h1", "rep").limit(2 * chosen).select("embedding").collect()
    return spread_out(_unit([np.array(r["embedding"], np.float64).tobytes() for r in sample], "<f8"), chosen)


def prefixes(classes: DataFrame, pivots: dict[int, np.ndarray], prefix: int, kind: str) -> DataFrame:
    """rep, n, vector and the numbers of the pivots nearest to it, in order. Pivots of different lengths have different numbers."""
    first, at = {}, 0
    for d in sorted(pivots):
        first[d], at = at, at + len(pivots[d])
    shared = classes.sparkSession.sparkContext.broadcast((pivots, first))  # at most max_pivots vectors of each length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = shared.value
        for batch in batches:
            vectors = batch.column("embedding")
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                some = batch.take(pa.array(own))
                raw = [np.array(x, kind).tobytes() for x in some.column("embedding").to_pylist()]
                near = _unit(raw, kind) @ known[d].T
                m = min(prefix, near.shape[1])
                top = np.argpartition(-near, m - 1, axis=1)[:, :m]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1) + base[d]
                yield pa.RecordBatch.from_pydict({"rep": some.column("rep"), "n": some.column("n"), "vector": pa.array(raw, pa.binary()), "prefix": pa.array(top.tolist(), pa.list_(pa.int32()))})

    return classes.mapInArrow(run, "rep long, n long, vector binary, prefix array<int>")


def _compare(threshold: float, shared: int, kind: str):
    nothing = pd.DataFrame({"rep": [], "links": [], "root": []})

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, second, i, j = (int(k) for k in key)
        a, b = rows[rows["block"] == i], rows[rows["block"] == j]
        if not len(a) or not len(b) or (i == j and len(a) < 2):
            return nothing
        reps = [x["rep"].to_numpy(np.int64) for x in (a, b)]
        sizes = [x["n"].to_numpy(np.int64) for x in (a, b)]
        owns = [np.array(x["prefix"].tolist(), np.int64) for x in (a, b)]
        names, local = np.unique(np.concatenate(owns), return_inverse=True)
        local = local.reshape(-1, owns[0].shape[1])
        has = np.zeros((len(local), len(names)), np.float32)
        np.put_along_axis(has, local, 1, 1)
        x, y = has[: len(a)], has[len(a) :]
        # candidates share enough pivots, and none before this list's own (but its first one), where they would be met as well
        earlier = int(np.searchsorted(names, pivot if second < 0 else second))
        hit = (x @ y.T >= min(shared, owns[0].shape[1])) & (x[:, :earlier] @ y[:, :earlier].T == (0 if second < 0 else 1))
        if i == j:
            hit = np.triu(hit, 1)
        if hit.any():
            hit &= _unit(a["vector"], kind) @ _unit(b["vector"], kind).T >= threshold
        if not hit.any():
            return nothing
        links = [hit @ sizes[1], sizes[0] @ hit]
        labels = [reps[0].copy(), reps[1].copy()]
        while True:  # smallest label over the links, until none changes
            big = np.iinfo(np.int64).max
            left = np.minimum(labels[0], np.where(hit, labels[1][None, :], big).min(1))
            right = np.minimum(labels[1], np.where(hit, left[:, None], big).min(0))
            if i == j:
                left = right = np.minimum(left, right)
            if (left == labels[0]).all() and (right == labels[1]).all():
                break
            labels = [left, right]
        out = pd.DataFrame({"rep": np.concatenate(reps), "links": np.concatenate(links), "root": np.concatenate(labels)})
        return out[out["links"] > 0].groupby("rep", as_index=False).agg({"links": "sum", "root": "min"})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, prefix: int = 8, shared: int = 2, max_pivots: int = 4096, long_list: int = 16 * BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    The pivots are at most 4 * sqrt(number of distinct vectors) of them, and max_pivots, spread out from a sample of
    twice as many that a hash chooses; every vector is indexed. Links are found with a recall below 1 where vectors
    near each other share too few pivots.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", "embedding", _good().alias("good"), F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    usable = rows.where("good")
    grouped = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    # a class has a number of its own, since vectors that differ may have one vec_id
    classes = saved(grouped.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lengths = classes.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("count"), F.sum("n").alias("rows")).collect()  # a row for each length of vectors
    if not lengths:
        return alone
    pivots = {r["d"]: pivots_of(classes, r["d"], r["count"], max_pivots) for r in lengths}

    entries = saved(prefixes(classes, pivots, prefix, kind), "prefixes")
    listed = entries.withColumn("pivot", F.explode("prefix"))
    members = listed.groupBy("pivot").agg(F.count("*").alias("members"))
    long = F.broadcast(members.where(F.col("members") > long_list).select("pivot", F.lit(True).alias("long")))  # pivots are few
    later = F.filter("prefix", lambda q: q > F.col("pivot"))
    split = listed.join(long, "pivot", "left").withColumn("second", F.explode(F.when(F.col("long") & F.lit(shared > 1), later).otherwise(F.array(F.lit(-1)))))
    large = saved(split.groupBy("pivot", "second").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "lists")
    blocks = F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    cut = split.join(large, ["pivot", "second"], "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = cut.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    links = saved(met.select("pivot", "second", "i", "j", "block", "rep", "n", "vector", "prefix").groupBy("pivot", "second", "i", "j").applyInPandas(_compare(threshold, shared, kind), "rep long, links long, root long"), "links")

    labels = component_labels(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    linked = saved(labels.join(classes.select("rep", "least"), "rep"), "components")
    smallest = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    placed = joined_to(linked.select("rep", "label"), smallest, ["label"], "size", max(1, sum(r["count"] for r in lengths)))
    by_class = classes.select("h1", "h2", "rep", "least", "n").join(counted, "rep", "left").join(placed.select("rep", "component_id"), "rep", "left")
    by_class = saved(by_class.select("h1", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "classes")
    out = joined_to(usable.select("vec_id", "h1", "h2"), by_class, ["h1", "h2"], "n", sum(r["rows"] for r in lengths))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")).union(alone)
