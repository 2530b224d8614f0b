"""Bootstrap intervals as plans: draws are rows, starts are hashes, sums come from running totals.

A draw's blocks (or clusters) are named by hashes of the seed, the group's size, the draw and the
place in it, so a run can be repeated and written in SQL; groups of one size share their draws. The
running totals of a group travel as one array, so a block's sum is a difference of two of its
elements; draws are dealt out in ranges. A task holds the windows of a group, however many draws
there are, and the quantiles of the draws' means are read from their sorted order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Draws that one row stands for before they are made.
RANGE = 500
DRAWS = 10_000
QUANTILES = (0.025, 0.975)


def start(n: Column, *key: Column | int) -> Column:
    """A whole number below n, spread evenly over the keys."""
    text = F.concat_ws(":", *[(F.lit(k) if isinstance(k, int) else k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % n


def _drawn(groups: DataFrame, by: list[str], draws: int, starts: Callable[[Column], Column], *sized: str) -> DataFrame:
    """Each group (by, n, ...) once for every draw, with the draw's `starts`; columns `sized` follow from n.

    Draws are made once for each size of a group and dealt out in ranges, which groups of that
    size meet by an equi-join.
    """
    firsts = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(RANGE))).alias("first")
    sizes = groups.select("n", *sized).distinct().select("n", *sized, firsts).repartition("n", "first")
    made = sizes.withColumn("draw", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + RANGE, F.lit(draws)) - 1)))
    return groups.select("*", firsts).join(made.select("n", "first", "draw", starts(F.col("draw")).alias("starts")), ["n", "first"])


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def interval(means: DataFrame, by: list[str], value: str, draws: int, quantiles: tuple[float, float] = QUANTILES) -> DataFrame:
    """(by, ci_low, ci_high): quantiles of exactly `draws` rows a group, linear between neighbours in order."""
    placed = means.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1)

    def quantile(q: float) -> Column:
        at = (draws - 1) * q
        low, high = (F.max(F.when(F.col("nth") == k, F.col(value))) for k in (math.floor(at), math.ceil(at)))
        return low + (high - low) * F.lit(at - math.floor(at))

    return placed.groupBy(*by).agg(*[quantile(q).alias(c) for q, c in zip(quantiles, ("ci_low", "ci_high"), strict=True)])


def block_draws(rows: DataFrame, by: list[str], value: str, order: str, block: int, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """(by, draw, mean): means of circular block samples of each group's values, the last block shortened to the group's size."""
    running = rows.withColumn("total", F.sum(value).over(Window.partitionBy(*by).orderBy(order)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("total").alias("t")))), lambda s: s["t"])
    groups = running.groupBy(*by).agg(F.concat(F.array(F.lit(0.0)), listed).alias("p"))
    n, p = (F.size("p") - 1).cast("long"), F.col("p")
    groups = groups.select(*by, "p", n.alias("n"), F.least(F.lit(block).cast("long"), n).alias("b")).withColumn("k", F.ceil(F.col("n") / F.col("b")).cast("int"))

    def block_sum(s: Column, j: Column) -> Column:
        end = s + F.when(j == F.col("k") - 1, F.col("n") - (F.col("k") - 1) * F.col("b")).otherwise(F.col("b"))
        at = lambda i: F.element_at(p, (i + 1).cast("int"))
        over = end > F.col("n")
        return at(F.when(over, end - F.col("n")).otherwise(end)) - at(s) + F.when(over, at(F.col("n"))).otherwise(F.lit(0.0))

    starts = lambda draw: F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: start(F.col("n"), seed, F.col("n"), block, draw, j))
    return _drawn(groups, by, draws, starts, "k").select(*by, "draw", (_total(F.transform("starts", block_sum)) / F.col("n")).alias("mean"))


def block_intervals(rows: DataFrame, by: list[str], value: str, order: str, block: int, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """(by, ci_low, ci_high) of the mean under a circular block bootstrap. value is never null; (by, order) tells rows apart."""
    return interval(block_draws(rows, by, value, order, block, draws, seed), by, "mean", draws)


def cluster_draws(rows: DataFrame, by: list[str], value: str, cluster: str, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """(by, draw, mean): means over as many clusters as a group has, drawn with replacement."""
    named = rows.select(*by, F.col(cluster).alias("_o"), F.col(value).alias("_v"))
    sums = named.groupBy(*by, "_o").agg(F.sum("_v").alias("s"), F.count("*").cast("double").alias("c"))
    groups = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_o", "s", "c"))).alias("p")).withColumn("n", F.size("p").cast("long"))
    starts = lambda draw: F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda j: start(F.col("n"), seed, F.col("n"), draw, j))
    both = F.aggregate("starts", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c")), lambda a, i: F.struct((a["s"] + F.element_at("p", (i + 1).cast("int"))["s"]).alias("s"), (a["c"] + F.element_at("p", (i + 1).cast("int"))["c"]).alias("c")), lambda a: a["s"] / a["c"])
    return _drawn(groups, by, draws, starts).select(*by, "draw", both.alias("mean"))


def cluster_intervals(rows: DataFrame, by: list[str], value: str, cluster: str, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """(by, ci_low, ci_high) of a mean whose rows come in clusters: clusters are drawn, not rows."""
    return interval(cluster_draws(rows, by, value, cluster, draws, seed), by, "mean", draws)


