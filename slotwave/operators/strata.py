"""Activity strata of items, metrics per stratum, and re-analysis of detailed score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import selection
from .ranking import mape, protocol, rank_items

LABELS = ("low", "medium", "high", "very high")


def strata(frames: DataFrame, x: str = "x_w", observed: str = "observed_w", thresholds: tuple[float, float, float] | None = None) -> DataFrame:
    """(item_id, mean, stratum 0-3) by the mean per observed row in each item's first window; thresholds default to its quartiles Q25, Q50 and Q90."""
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    rows = frames.select("item_id", "window_id", (total / F.greatest(F.col(observed), F.lit(1))).alias("mean"))
    first = rows.groupBy("item_id").agg(F.min_by("mean", "window_id").alias("mean"))
    cuts = first.limit(1).select(F.array(*map(F.lit, thresholds)).alias("q")) if thresholds else selection.cuts(first, "mean", (0.25, 0.5, 0.9))
    m = F.col("mean")
    return first.crossJoin(F.broadcast(cuts)).select("item_id", "mean", F.when(m < F.col("q")[0], 0).when(m < F.col("q")[1], 1).when(m < F.col("q")[2], 2).otherwise(3).alias("stratum"))


def stratum_summary(labelled: DataFrame) -> DataFrame:
    """Per stratum: items, share in per cent, and the distribution of means."""
    return labelled.groupBy("stratum").agg(F.count("*").alias("n_items"), F.min("mean").alias("min"), F.max("mean").alias("max"), F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std")).join(selection.quantiles(labelled, ["stratum"], "mean", {"median": 0.5}), "stratum").select("stratum", "n_items", "min", "max", "mean", "median", "std", (100.0 * F.col("n_items") / F.sum("n_items").over(Window.partitionBy())).alias("percent"))


def detailed_scores(scores: DataFrame, labelled: DataFrame) -> DataFrame:
    """window_id, item_id, method, stratum, popularity_score, actual_count, mae, rank_predicted, rank_actual."""
    rows = rank_items(scores).join(labelled.select("item_id", "stratum"), "item_id", "left")
    return rows.select("window_id", "item_id", "method", "stratum", F.col("score").alias("popularity_score"), F.col("truth").alias("actual_count"), F.abs(F.col("score") - F.col("truth")).alias("mae"), F.col("rank").alias("rank_predicted"), F.col("truth_rank").alias("rank_actual"))


def by_stratum(detailed: DataFrame) -> DataFrame:
    """Per window, method and stratum: items, errors, share of positive scores, rank difference."""
    return detailed.groupBy("window_id", "method", "stratum").agg(F.count("*").alias("n_items"), F.avg("mae").alias("mae"), mape(F.col("popularity_score"), F.col("actual_count")).alias("mape"), F.avg((F.col("popularity_score") > 0).cast("double")).alias("positive_share"), F.avg(F.abs(F.col("rank_predicted") - F.col("rank_actual"))).alias("rank_difference"))


def top_share(detailed: DataFrame, percent: float) -> DataFrame:
    """Rows of the items whose total actual count is at or above the (100 - percent)th percentile."""
    totals = detailed.groupBy("item_id").agg(F.sum("actual_count").alias("t"))
    cut = selection.quantiles(totals, [], "t", {"cut": 1 - percent / 100})
    return detailed.join(totals.crossJoin(F.broadcast(cut)).where("t >= cut").select("item_id"), "item_id", "left_semi")


def chosen(detailed: DataFrame, stratum: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of one stratum and of a range of windows."""
    rules = [(stratum, F.col("stratum") == stratum), (first, F.col("window_id") >= first), (last, F.col("window_id") <= last)]
    for given, rule in rules:
        detailed = detailed if given is None else detailed.where(rule)
    return detailed


def protocol_from_detailed(detailed: DataFrame) -> DataFrame:
    """Metric rows recomputed from stored scores."""
    return protocol(detailed.select("window_id", "method", "item_id", F.col("popularity_score").alias("score"), F.col("actual_count").alias("truth")))


def evolution(detailed: DataFrame) -> DataFrame:
    """Mean, median and sd of the error per window and method."""
    return detailed.groupBy("window_id", "method").agg(F.avg("mae").alias("mean"), F.percentile("mae", F.lit(0.5)).alias("median"), F.stddev_samp("mae").alias("std"))


def dataset_means(protocols: DataFrame, metrics: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Means per dataset and method; columns may be named by older names."""
    for old, new in (aliases or {}).items():
        if old in protocols.columns and new not in protocols.columns:
            protocols = protocols.withColumnRenamed(old, new)
    return protocols.groupBy("dataset", "method").agg(*[F.avg(m).alias(m) for m in metrics])


def profile(dense: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: cells, items, zero share, eligible items per window, largest and tenth-largest count per slot (medians)."""
    w = Window.partitionBy("slot").orderBy(F.desc("v"), "item_id")
    top = dense.withColumn("n", F.row_number().over(w)).where("n in (1, 10)").groupBy("slot").agg(F.max(F.when(F.col("n") == 1, F.col("v"))).alias("v1"), F.max(F.when(F.col("n") == 10, F.col("v"))).alias("v10"))
    per = rows.groupBy("window_id").agg(F.count("*").alias("n"))
    return (
        dense.agg(F.count("*").alias("n_cells"), F.count_distinct("item_id").alias("n_items"), F.avg((F.col("v") == 0).cast("double")).alias("zero_share"))
        .crossJoin(per.agg(F.percentile("n", F.lit(0.5)).alias("median_eligible"), F.min("n").alias("min_eligible"), F.max("n").alias("max_eligible")))
        .crossJoin(top.agg(F.percentile("v1", F.lit(0.5)).alias("median_largest"), F.percentile("v10", F.lit(0.5)).alias("median_tenth")))
    )
