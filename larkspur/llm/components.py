"""Connected components of an edge table: tasks contract what they hold, and parents jump to their own parents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_worker, partitions, saved

HELD = 1 << 20


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that it reaches over the links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the same components: every node but the smallest of its component, and that one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(len(ids), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task as stars. What is held are the task's nodes, not its edges."""
    lean_worker()
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    most, count = HELD, 0
    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        count += batch.num_rows
        if count > most:
            held = [contracted(*map(np.concatenate, zip(*held, strict=True)))]
            count = len(held[0][0])
            most = max(HELD, 2 * count)
    a, b = contracted(*map(np.concatenate, zip(*held, strict=True)))
    for k in range(0, len(a), 1 << 16):
        yield pa.RecordBatch.from_pydict({"a": pa.array(a[k : k + (1 << 16)]), "b": pa.array(b[k : k + (1 << 16)])})


def _dealt(edges: DataFrame) -> DataFrame:
    """Edges contracted where they lie, which leaves a node one edge a task, then with all edges of their larger ends together."""
    stars = edges.mapInArrow(_contract, "a long, b long")
    return stars.repartition(partitions(edges.sparkSession), "a").mapInArrow(_contract, "a long, b long")


def _jumped(edges: DataFrame) -> DataFrame:
    """Edges lead to the parent of their smaller end, if it has one: the smallest node that it is tied to."""
    # written, since Spark splits a smaller end of very many edges only where a join reads what was dealt for it alone
    parents = saved(edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), "parents")
    return edges.join(parents, "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def _unsettled(edges: DataFrame) -> int:
    """Nodes with two edges to smaller ones, or with smaller and larger neighbours: none in stars."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").count()


def component_labels(edges: DataFrame) -> DataFrame:
    """id and label, the smallest id that it is connected with, for the ids a, b of all edges. Null ends and loops are no edges.

    A star is what a component ends as; the rounds grow with the logarithm of the longest path. Each round is written
    to the shared folder, and only the number of nodes that aren't settled comes to the driver.
    """
    now = saved(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    now = saved(_dealt(now), "edges")
    while _unsettled(now):
        now = saved(_dealt(_jumped(now)), "edges")
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).union(now.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct())
