"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups go, largest first, to the shard
with the fewest bytes so far. Groups of one size are interchangeable, so the heap is run over
(size, number of groups): all groups of a size are dealt at once, exactly as one after the
other would be. What reaches the driver is one row for each distinct size of a group, at most
sqrt(2 * total bytes) of them; which of them a group is follows from its number among those of
its size. Numbers come from counts of small cells and running totals of these, so no task
holds a shard, a size or a hot group.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` items of one size each shard takes, each item going to the least load (ties: first shard).

    Items go by the load they are put on. All that are put on at most level - size are taken
    by a search for the level; fewer items than there are shards are left for the heap.
    """
    fill = lambda level: [max(0, (level - x) // size) for x in loads]
    low, high = min(loads), max(loads) + size * (count + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if sum(fill(middle)) <= count else (low, middle)
    taken = fill(low)
    heap = [(x + size * n, shard) for shard, (x, n) in enumerate(zip(loads, taken, strict=True))]
    heapq.heapify(heap)
    for _ in range(count - sum(taken)):
        load, shard = heap[0]
        taken[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return taken


def lpt(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(size, number of groups) runs -> (size, how many of them each shard takes), largest size first."""
    loads, out = [0] * shards, []
    for size, count in sorted(runs, reverse=True):
        taken = deal(loads, size, count)
        loads = [x + size * n for x, n in zip(loads, taken, strict=True)]
        out.append((size, taken))
    return out


def numbered(rows: DataFrame, by: str, cell, order: list[str], out: str) -> DataFrame:
    """rows with their number, from 0, among those that agree in `by`; cells are numbered apart and added up."""
    rows = rows.withColumn("cell", cell)
    before = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(by, "cell").agg(F.count("*").alias("n")).select(by, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy(by, "cell").orderBy(*order))
    return rows.withColumn("nth", nth).join(starts, [by, "cell"]).withColumn(out, F.col("start") + F.col("nth") - 1).drop("cell", "nth", "start")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", size_cells: int = 1024, cell_rows: int = 1000) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes + 1), text_crc32, law 'bytes', shard, slot, grown_shard (null).

    A null text counts as an empty one (size 1, checksum 0) and shares its group. Equal ids,
    null ids or fully equal rows stay separate rows with slots of their own. Groups are told
    apart by a 64-bit hash of the text, its size and its checksum. An empty table gives no rows;
    other columns of the input, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("grp"))
    base = stored(rows, "shard-rows")
    key = ["grp", "size", "text_crc32"]
    groups = stored(base.groupBy(*key).agg(F.count("*").alias("copies")).withColumn("bytes", F.col("size") * F.col("copies")), "shard-groups")
    runs = groups.groupBy("bytes").agg(F.count("*").alias("n")).toArrow()  # a row for each distinct size
    plan = lpt(list(zip(runs["bytes"].to_pylist(), runs["n"].to_pylist(), strict=True)), shards)
    upto = [[sum(taken[: i + 1]) for i in range(shards)] for _, taken in plan]
    table = spark.createDataFrame(pa.table({"bytes": pa.array([s for s, _ in plan], pa.int64()), "upto": pa.array(upto, pa.list_(pa.int64()))}))
    ranked = numbered(groups, "bytes", F.pmod("grp", F.lit(size_cells)), key, "number").join(table, "bytes")
    placed = ranked.select(*key, F.size(F.filter("upto", lambda n: n <= F.col("number"))).alias("shard"))
    cells = max(1, -(-base.count() // cell_rows))
    out = numbered(base.join(placed, key), "shard", F.pmod(F.xxhash64("doc_id", "grp"), F.lit(cells)), ["doc_id", *key], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
