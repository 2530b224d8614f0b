"""Entries of items into the true top ranks, and how soon a method's ranking shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import jaccard, pearson


def truth_ranks(dense: DataFrame) -> DataFrame:
    """Rank of every item in every slot by its count (ties by item); null where the item has no request or the slot no row."""
    w = Window.partitionBy("slot")
    rows = dense.withColumn("n", F.row_number().over(w.orderBy(F.desc("v"), "item_id"))).withColumn("live", F.max("present").over(w))
    return rows.select("item_id", "slot", "v", F.when((F.col("live") == 1) & (F.col("v") > 0), F.col("n")).alias("rank"))


def entry_events(ranks: DataFrame, k: int = 10, run: int = 6, before: int = 6, strict: int = 20, first: int = 32) -> DataFrame:
    """Runs of at least `run` slots in the top k after `before` slots outside it, starting at max(first, before) or later.

    Gaps and islands: a run starts where the slot before is outside, and its number is the
    running count of starts.
    """
    w = Window.partitionBy("item_id").orderBy("slot")
    r = F.coalesce(F.col("rank"), F.lit(2147483647))
    rows = ranks.withColumn("r", r).withColumn("inside", r <= k)
    rows = rows.withColumn("starts", (F.col("inside") & ~F.coalesce(F.lag("inside").over(w), F.lit(True))).cast("int"))
    rows = rows.withColumn("run_no", F.sum("starts").over(w)).withColumn("pre_best", F.min("r").over(w.rowsBetween(-before, -1))).withColumn("pre_mean", F.avg("v").over(w.rowsBetween(-before, -1)))
    end = ranks.agg(F.max("slot").alias("end"))
    # the start row of each run decides; rows of the run that follow it without a gap count
    rows = rows.withColumn("gap", F.sum((~F.col("inside")).cast("int")).over(Window.partitionBy("item_id", "run_no").orderBy("slot")))
    runs = rows.where("run_no > 0 and gap = 0").groupBy("item_id", "run_no").agg(F.min("slot").alias("t0"), F.count("*").alias("run_len"), F.max("slot").alias("last"), F.min_by("pre_best", "slot").alias("pre_best_rank"), F.min_by("pre_mean", "slot").alias("pre_mean_count"), F.avg("v").alias("run_mean_count"), F.max("v").alias("run_peak_count"), F.min_by("v", "slot").alias("count_t0"))
    kept = runs.crossJoin(F.broadcast(end)).where((F.col("t0") >= max(first, before)) & (F.col("run_len") >= run) & (F.col("pre_best_rank") > k))
    return kept.select("item_id", "t0", "run_len", (F.col("last") == F.col("end")).alias("run_hits_end"), (F.col("pre_best_rank") > strict).alias("strict"), F.when(F.col("pre_best_rank") == 2147483647, -1).otherwise(F.col("pre_best_rank")).alias("pre_best_rank"), "pre_mean_count", "run_mean_count", "run_peak_count", "count_t0")


def delays(events: DataFrame, ranked: DataFrame, k: int = 10) -> DataFrame:
    """Event x method: slots until the item is in the method's top k, coverage of the run, slots without eligibility.

    Each event names the slots of its run, so the join to ranked rows is on (item, slot).
    """
    slots = events.select("item_id", "t0", "run_len", F.explode(F.sequence(F.col("t0"), F.col("t0") + F.col("run_len") - 1)).alias("window_id"))
    methods = ranked.select("method").distinct()
    rows = slots.crossJoin(F.broadcast(methods)).join(ranked.select("window_id", "item_id", "method", "rank"), ["window_id", "item_id", "method"], "left")
    hit = F.coalesce(F.col("rank") <= k, F.lit(False))
    step = F.col("window_id") - F.col("t0")
    return rows.groupBy("item_id", "t0", "run_len", "method").agg(
        F.min(F.when(hit, step)).alias("delay"), F.avg(hit.cast("double")).alias("coverage"),
        F.bool_or((step == 0) & F.col("rank").isNotNull()).alias("eligible_at_t0"), F.sum(F.col("rank").isNull().cast("int")).alias("n_ineligible_run"),
    ).withColumn("detected", F.col("delay").isNotNull()).withColumn("delay_restricted", F.coalesce("delay", "run_len"))


def summarize_delays(d: DataFrame) -> DataFrame:
    """Per method: events, miss rate, median delay with a miss as infinite (null if undefined), means and shares."""
    median = F.percentile(F.coalesce(F.col("delay").cast("double"), F.lit(float("inf"))), F.lit(0.5))
    share = lambda n: F.avg(F.coalesce((F.col("delay") <= n).cast("double"), F.lit(0.0))).alias(f"share_delay_le{n}")
    return d.groupBy("method").agg(
        F.count("*").alias("n_events"), F.count_distinct("item_id").alias("n_items"), F.avg((~F.col("detected")).cast("double")).alias("miss_rate"),
        F.when((median < float("inf")) & ~F.isnan(median), median).alias("median_delay"), F.avg("delay_restricted").alias("mean_delay_restricted"), F.avg("delay").alias("mean_delay_detected"),
        share(0), share(1), share(3), F.avg("coverage").alias("mean_coverage"), F.avg((~F.col("eligible_at_t0")).cast("double")).alias("share_ineligible_at_t0"), F.avg("run_len").alias("mean_run_len"),
    )


def truth_rsi(ranks: DataFrame, k: int = 10) -> DataFrame:
    """Overlap of the true top k with that of the slot before, and the overlap one slot earlier ('seen')."""
    tops = ranks.where(F.col("rank") <= k).groupBy(F.col("slot").alias("window_id")).agg(F.collect_set("item_id").alias("top"))
    w = Window.partitionBy().orderBy("window_id")
    out = tops.withColumn("truth_rsi", F.when(F.lag("top").over(w).isNotNull(), jaccard(F.col("top"), F.lag("top").over(w))))
    return out.select("window_id", "truth_rsi", F.lag("truth_rsi").over(w).alias("seen_rsi"))


def stability(protocol: DataFrame, truth: DataFrame) -> DataFrame:
    """Per method: how its RSI follows the change it could have seen, and the share of windows below it by more than 0.1."""
    both = protocol.select("window_id", "method", "rsi_10").join(truth, "window_id").where("rsi_10 is not null and seen_rsi is not null")
    return both.groupBy("method").agg(F.count("*").alias("n"), pearson("rsi_10", "seen_rsi").alias("corr"), F.avg((F.round("rsi_10", 9) < F.round(F.col("seen_rsi") - 0.1, 9)).cast("double")).alias("failure_share"))


def examples(d: DataFrame) -> DataFrame:
    """Per method the event nearest to the median delay ('typical') and the worst one; ties by slot and item."""
    w = Window.partitionBy("method")
    rows = d.withColumn("m", F.percentile("delay_restricted", F.lit(0.5)).over(w))
    pick = lambda kind, *by: rows.withColumn("nth", F.row_number().over(w.orderBy(*by, "t0", "item_id"))).where("nth = 1").select("method", F.lit(kind).alias("kind"), "item_id", "t0", "delay_restricted")
    return pick("typical", F.abs(F.col("delay_restricted") - F.col("m"))).unionByName(pick("worst", F.desc("delay_restricted")))


def rank_trace(ranked: DataFrame, item: str, first: int, last: int) -> DataFrame:
    """Rank of one item in each method for every window of a range; null where it is not eligible."""
    slots = ranked.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("window_id"))
    own = ranked.where((F.col("item_id") == item) & F.col("window_id").between(first, last)).select("window_id", "method", "rank")
    return slots.crossJoin(F.broadcast(ranked.select("method").distinct())).join(own, ["window_id", "method"], "left")
