"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated by a fixed random rotation and cut into blocks of `block_dims`
dimensions. Two vectors of cosine c are at squared distance 2 - 2c, which the blocks share: in
at least one block it is at most its proportional part. Each block is therefore joined by
itself within that radius, and the union of what the blocks find is verified exactly in double
precision. A pair is counted where it is found first (in the lowest block within budget).

A block is a range join: along its first coordinate vectors fall into cells as wide as the
radius, so partners lie in the same or the next cell. A cell is cut into chunks of
`chunk_rows`, and each pair of chunks that may hold partners is a task's group; within it
block distances are matrix products. Equal vectors are joined once, as one class with a
multiplicity, so a group of copies of any size is one row here. Links are counted where they
are found; only spanning links of a group leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, join_labels
from .shared import stored

#: Added to every block's budget, against rounding.
SLACK = 1e-6
#: Rows of one side of a matrix product.
STEP = 1024


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same on every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a double matrix."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; they are scaled by their largest component first, so nothing overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bounds(dims: int, block_dims: int) -> list[int]:
    n = max(1, dims // block_dims)
    return [dims * i // n for i in range(n + 1)]


def _cells(block_dims: int, least: float):
    """Each class once for each block: (dims, block, cell) of the rotated unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch["dims"])
            for dims in np.unique(lengths):
                rows = np.flatnonzero(lengths == dims)
                part = batch.take(pa.array(rows))
                x = _matrix(part["embedding"])
                x = _unit(x) @ rotation(int(dims))
                edges = _bounds(int(dims), block_dims)
                for b, lo in enumerate(edges[:-1]):
                    radius = np.sqrt((2 - 2 * least) * (edges[b + 1] - lo) / dims + SLACK)
                    cell = np.floor(x[:, lo] / radius).astype(np.int32)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays([part["cid"], part["dims"], pa.array(np.full(n, b, np.int32)), pa.array(cell)], names=["cid", "dims", "block", "cell"])

    return run


def _join(block_dims: int, least: float):
    """Links in one pair of chunks: rows (a, b) for spanning links between classes, (a, null, n) for a class's number of links."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid").combine_chunks()
        dims, block = t["dims"][0].as_py(), t["block"][0].as_py()
        x = _unit(_matrix(t["embedding"].chunk(0) if t["embedding"].num_chunks else t["embedding"]))
        y = x @ rotation(dims)
        edges = _bounds(dims, block_dims)
        budgets = [(2 - 2 * least) * (hi - lo) / dims + SLACK for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        own = y[:, edges[block] : edges[block + 1]].astype(np.float32)
        square = (own * own).sum(1)
        side, rep, many = (t[c].to_numpy() for c in ("side", "cid", "many"))
        within = side.min() == side.max()  # a chunk with itself
        left, right = (np.arange(len(rep)),) * 2 if within else (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()))
        label, links = np.arange(len(rep)), np.zeros(len(rep), np.int64)
        for i in range(0, len(left), STEP):
            for j in range(i if within else 0, len(right), STEP):
                p, q = left[i : i + STEP], right[j : j + STEP]
                near = square[p][:, None] + square[q][None, :] - 2 * own[p] @ own[q].T <= np.float32(budgets[block] + 1e-5)
                a, b = np.nonzero(near)
                a, b = p[a], q[b]
                if within:
                    a, b = a[a < b], b[a < b]
                for lo in range(0, len(a), 1 << 16):
                    u, v = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                    d = y[u] - y[v]
                    d *= d
                    ok = np.add.reduce(d[:, edges[block] : edges[block + 1]], 1) <= budgets[block]
                    for e in range(block):  # found there already
                        ok &= np.add.reduce(d[:, edges[e] : edges[e + 1]], 1) > budgets[e]
                    u, v = u[ok], v[ok]
                    ok = np.einsum("ij,ij->i", x[u], x[v]) >= least
                    u, v = u[ok], v[ok]
                    links += np.bincount(u, many[v], len(rep)).astype(np.int64) + np.bincount(v, many[u], len(rep)).astype(np.int64)
                    label = join_labels(len(rep), u, v, label)
        far, hit = label != np.arange(len(rep)), links > 0
        a = np.concatenate([rep[far], rep[hit]])
        b = pa.array(np.concatenate([rep[label[far]], np.zeros(hit.sum(), rep.dtype)]), mask=np.arange(len(a)) >= far.sum())
        return pa.table([pa.array(a), b, pa.array(np.concatenate([np.zeros(far.sum(), np.int64), links[hit]]))], names=["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, block_dims: int = 16, chunk_rows: int = 8192) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing and are components of their own. Vectors of different lengths never link. Equal
    vectors link with each other; rows with equal ids count as rows in n_links and share a
    component. A row with a null id is counted as a link of others and joins them, but names no
    component (one without any id is null, and kept is then false). An empty table gives no
    rows; further columns of the input, whatever their names, are ignored.
    """
    x = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    good = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    # 0.0 and -0.0 are one component here; equal vectors are told by two 64-bit hashes
    plain = F.transform(x, lambda v: v + F.lit(0.0))
    rows = stored(rows.select("vec_id", F.when(good, plain).alias("embedding")).withColumn("h0", F.when(x.isNotNull(), F.xxhash64("embedding"))).withColumn("h1", F.when(x.isNotNull(), F.xxhash64(F.lit(1), F.reverse("embedding")))), "vector-rows")
    known = rows.where("h0 is not null")
    # a class has a number of its own, whether or not any of its rows has an id
    classes = known.groupBy("h0", "h1").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("dims", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    cells = stored(classes.select("cid", "embedding", "dims").mapInArrow(_cells(block_dims, least), "cid long, dims int, block int, cell int"), "vector-cells")
    sizes = cells.groupBy("dims", "block", "cell").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    after = sizes.select("dims", "block", (F.col("cell") - 1).alias("cell"), F.col("chunks").alias("next"))
    before = sizes.select("dims", "block", (F.col("cell") + 1).alias("cell"), F.col("chunks").alias("previous"))
    key = ["dims", "block", "cell"]
    plan = sizes.join(after, key, "left").join(before, key, "left").fillna(0, ["next", "previous"])
    plan = stored(plan, "vector-chunks")  # a row for each cell
    own = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("own")
    placed = cells.join(plan, key).select("cid", *key, own, "chunks", "next", "previous")
    each = lambda n: F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda o: o)
    # partners: chunks of the same cell, of the next one, and of the previous one (whose groups are named by that cell)
    groups = F.concat(
        F.transform(each(F.col("chunks")), lambda o: F.struct(F.col("cell").alias("cell"), F.lit(False).alias("across"), F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(o == F.col("own"), 0).otherwise((F.col("own") > o).cast("int")).alias("side"))),
        F.transform(each(F.col("next")), lambda o: F.struct(F.col("cell").alias("cell"), F.lit(True).alias("across"), F.col("own").alias("i"), o.alias("j"), F.lit(0).alias("side"))),
        F.transform(each(F.col("previous")), lambda o: F.struct((F.col("cell") - 1).alias("cell"), F.lit(True).alias("across"), o.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))),
    )
    sent = placed.withColumn("g", F.explode(groups)).select("cid", "dims", "block", F.col("g.cell").alias("cell"), F.col("g.across").alias("across"), F.col("g.i").alias("i"), F.col("g.j").alias("j"), F.col("g.side").alias("side"))
    sent = sent.join(classes.select("cid", "many", "embedding"), "cid")
    found = stored(sent.groupBy("dims", "block", "cell", "across", "i", "j").applyInArrow(_join(block_dims, least), "a long, b long, n long"), "vector-links")
    counted = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("b is not null").select("a", "b").unionByName(_same_id(known, classes)))
    named = classes.select("h0", "h1", "cid", "rep", "many").join(counted, "cid", "left").join(parts, F.col("cid") == F.col("node"), "left")
    named = stored(named.select("h0", "h1", "rep", (F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component")), "vector-components")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = stored(named.join(smallest, "component").select("h0", "h1", "n_links", "component_id"), "vector-labels")
    out = rows.select("vec_id", "h0", "h1").join(labels, ["h0", "h1"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _same_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Ties between the classes that rows of one id stand in."""
    several = known.where("vec_id is not null").groupBy("vec_id").agg(F.min("h0").alias("x"), F.max("h0").alias("y")).where("x <> y").select("vec_id")
    stand = known.join(several, "vec_id", "left_semi").join(classes.select("h0", "h1", "cid"), ["h0", "h1"]).select("vec_id", "cid").distinct()
    return stand.join(stand.groupBy("vec_id").agg(F.min("cid").alias("b")), "vec_id").select(F.col("cid").alias("a"), "b")
