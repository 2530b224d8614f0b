"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation and a join on a node, so a node with very many neighbours is
pre-aggregated and its join partition can be split; edges and labels never leave the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Edges that a task joins at once.
HELD = 1 << 20


def join_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of the component of each of n places, given edges a-b (and earlier labels)."""
    out = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = out[a], out[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            break
        np.minimum.at(out, np.maximum(la, lb), np.minimum(la, lb))
        while (out[out] != out).any():
            out = out[out]
    return out


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of the edges of a task, HELD edges at a time."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = join_labels(len(nodes), at[: len(a)], at[len(a) :])
        far = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) > HELD:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def _unfinished(pairs: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller neighbour that has one itself."""
    two = pairs.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return bool(two.unionByName(chained).take(1))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with an edge to another; component is the smallest node it reaches.

    Loops, repeated edges and edges with a null end are ignored.
    """
    found = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    # directed from the larger to the smaller end
    pairs = stored(found.mapInArrow(_spanning, "u long, v long").distinct(), "cc-edges")
    while _unfinished(pairs):
        # large star: every larger neighbour of u is tied to the smallest neighbour of u
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ties = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = stored(ties.unionByName(low.select("u", F.col("m").alias("v"))).mapInArrow(_spanning, "u long, v long").distinct(), "cc-edges")
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
