"""Checks for look-ahead, and comparisons of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid as G
from .ranking import jaccard


def window_structure(frames: DataFrame, x: str, window: int) -> DataFrame:
    """One row: windows of a wrong length. A window k holds min(k, window) slots, all of them before k."""
    size = F.size(x)
    wrong = size != F.least(F.col("window_id"), F.lit(window))
    return frames.agg(F.count("*").alias("n"), F.sum(wrong.cast("int")).alias("wrong_length"), F.sum((size < window).cast("int")).alias("short"))


def window_lengths(frames: DataFrame, x: str) -> DataFrame:
    """Actual window lengths and how often they occur."""
    return frames.groupBy(F.size(x).alias("length")).agg(F.count("*").alias("n_rows"), F.count_distinct("window_id").alias("n_windows"))


def membership_changes(rows: DataFrame) -> DataFrame:
    """Per window: eligible items, and overlap with those of the window before."""
    w = Window.partitionBy().orderBy("window_id")
    sets = rows.groupBy("window_id").agg(F.collect_set("item_id").alias("items"))
    return sets.select("window_id", F.size("items").alias("n_items"), F.when(F.lag("items").over(w).isNotNull(), jaccard(F.col("items"), F.lag("items").over(w))).alias("overlap"))


def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Per value column: cells compared, cells that differ, largest difference, keys on one side only. Null and NaN equal themselves."""
    values = [c for c in a.columns if c not in keys and c in b.columns]
    kinds = dict(a.dtypes)
    both = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in values], F.lit(1).alias("in_a")).join(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in values], F.lit(1).alias("in_b")), keys, "full_outer")
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()

    def one(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if kinds[c] in ("double", "float"):
            gap = F.abs(x - y)
            same = x.eqNullSafe(y) | F.coalesce(gap <= tolerance * F.greatest(F.lit(1.0), F.abs(x)), F.lit(False))
        else:
            gap, same = F.lit(None).cast("double"), x.eqNullSafe(y)
        return F.struct(F.lit(c).alias("name"), F.sum((shared & ~same).cast("long")).alias("n_different"), F.max(F.when(shared, gap)).alias("max_difference"))

    total = both.agg(F.sum(shared.cast("long")).alias("n_compared"), F.sum(F.col("in_b").isNull().cast("long")).alias("only_a"), F.sum(F.col("in_a").isNull().cast("long")).alias("only_b"), F.array(*map(one, values)).alias("cells"))
    return total.select("n_compared", "only_a", "only_b", F.explode("cells").alias("c")).select("c.*", "n_compared", "only_a", "only_b")


def truncated(dense: DataFrame, last: int) -> DataFrame:
    return dense.where(F.col("slot") <= last)


def overwritten_future(dense: DataFrame, first: int, seed: int = 7) -> DataFrame:
    """Counts of slots from `first` on replaced by a hash of the cell."""
    noise = (F.pmod(F.xxhash64(F.lit(seed), "item_id", "slot"), F.lit(1000))).cast("double")
    return dense.withColumn("v", F.when(F.col("slot") >= first, noise).otherwise(F.col("v")))


def leaky_frames(dense: DataFrame, window: int) -> DataFrame:
    """A wrong window that holds its own slot: the positive control of the leakage tests."""
    w = Window.partitionBy("item_id").orderBy("slot").rowsBetween(-window + 1, 0)
    return dense.select(F.col("slot").alias("window_id"), "item_id", F.collect_list("v").over(w).alias("x_w"))


def catalogue_audit(demand: DataFrame, dense: DataFrame, min_total: int) -> DataFrame:
    """One row: items that a whole-file threshold removes, their share, their largest slot count, and the slots in which one of them would reach the top ten."""
    totals = demand.groupBy("item_id").agg(F.sum("count").alias("total"), F.max("count").alias("largest"))
    gone = totals.where(F.col("total") < min_total)
    tenth = dense.withColumn("n", F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("v"), "item_id"))).where("n = 10").select("slot", F.col("v").alias("tenth"))
    reach = dense.join(gone.select("item_id"), "item_id", "left_semi").join(tenth, "slot").where("v >= tenth and v > 0").select("slot").distinct().agg(F.count("*").alias("slots_reaching_top10"))
    out = totals.agg(F.count("*").alias("n_items"), F.sum((F.col("total") < min_total).cast("int")).alias("n_removed"), F.max(F.when(F.col("total") < min_total, F.col("largest"))).alias("largest_removed_count"))
    return out.crossJoin(F.broadcast(reach)).withColumn("removed_share", F.col("n_removed") / F.col("n_items"))


def snapshot_profile(snapshots: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Per item (item, ts, total, diff), in order: rows, repeats, full hours, falls of the total, share of diff = difference of totals, negatives, missing.

    A full hour is one by minute and second; fractions of a second are cut.
    """
    w = Window.partitionBy("item").orderBy(*order)
    rows = snapshots.withColumn("step", F.col("total") - F.lag("total").over(w)).withColumn("again", F.col("ts") == F.lag("ts").over(w))
    n = lambda rule: F.coalesce(F.sum(F.coalesce(rule, F.lit(False)).cast("int")), F.lit(0))
    return rows.groupBy("item").agg(
        F.count("*").alias("n_rows"), n(F.col("again")).alias("n_repeated"), n(F.unix_seconds(F.col("ts").cast("timestamp")) % 3600 == 0).alias("n_on_hour"), n(F.col("step") < 0).alias("n_falls"),
        F.avg((F.abs(F.col("step") - F.col("diff")) < 1e-6).cast("double")).alias("share_consistent"), n(F.col("diff") < 0).alias("n_negative"), n(F.col("diff").isNull()).alias("n_missing"),
    )


def step_counts(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows left after each cleaning step, in order; one pass over the data."""
    rules = [reduce(lambda a, b: a & b, [F.coalesce(r, F.lit(False)) for _, r in steps[: i + 1]]) for i in range(len(steps))]
    one = df.agg(F.count("*").alias("0"), *[F.sum(r.cast("long")).alias(str(i + 1)) for i, r in enumerate(rules)])
    names = ["input", *[n for n, _ in steps]]
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.coalesce(F.col(str(i)), F.lit(0)).alias("n_rows")) for i, n in enumerate(names)])).alias("s")).select("s.*")


def threshold_interval(demand: DataFrame, n: int) -> DataFrame:
    """One row: the totals between which a threshold keeps exactly n items (least, most inclusive)."""
    totals = demand.groupBy("item_id").agg(F.sum("count").alias("total")).orderBy(F.desc("total")).limit(n + 1)
    w = Window.orderBy(F.desc("total"))
    rows = totals.withColumn("nth", F.row_number().over(w)).withColumn("next", F.lead("total").over(w))
    return rows.where(F.col("nth") == n).select((F.coalesce("next", F.lit(-1)) + 1).alias("least"), F.col("total").alias("most"))


def gap_slots(dense: DataFrame) -> DataFrame:
    """Slots without any row."""
    return dense.groupBy("slot").agg(F.max("present").alias("any")).where("any = 0").select("slot")


def gap_sensitivity(protocol: DataFrame, gaps: DataFrame, window: int, metric: str) -> DataFrame:
    """Method means and ranks with and without the windows that touch a gap."""
    touched = G.gap_windows(gaps, protocol, window).select("window_id").distinct()
    clean = protocol.join(touched, "window_id", "left_anti")
    means = lambda d, name: d.groupBy("method").agg(F.avg(metric).alias(name))
    w = Window.partitionBy()
    out = means(protocol, "all").join(means(clean, "without"), "method", "left")
    return out.withColumn("rank_all", F.rank().over(w.orderBy(F.desc("all")))).withColumn("rank_without", F.rank().over(w.orderBy(F.desc("without"))))


def dataset_summary(dense: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: items, slots, share of observed cells, items that ever enter a window."""
    admitted = rows.agg(F.count_distinct("item_id").alias("n_admitted"))
    return dense.agg(F.count_distinct("item_id").alias("n_items"), (F.max("slot") + 1).alias("n_slots"), F.avg(F.col("present").cast("double")).alias("presence")).crossJoin(F.broadcast(admitted))


def rsi_audit(item_order: DataFrame, position_order: DataFrame) -> DataFrame:
    """Per method: windows in which item-wise and position-wise overlap differ (both with rsi_10)."""
    both = item_order.select("method", "window_id", F.col("rsi_10").alias("a")).join(position_order.select("method", "window_id", F.col("rsi_10").alias("b")), ["method", "window_id"])
    return both.groupBy("method").agg(F.count("*").alias("n"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("int")).alias("n_different"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_difference"))


def version_table(old: DataFrame, new: DataFrame, metrics: list[str]) -> DataFrame:
    """Method summaries of two versions side by side: windows, and each metric's mean in both with the difference."""
    a = old.select("method", F.col("n_windows").alias("windows_old"), *[F.col(f"{m}_mean").alias(f"{m}_old") for m in metrics])
    b = new.select("method", F.col("n_windows").alias("windows_new"), *[F.col(f"{m}_mean").alias(f"{m}_new") for m in metrics])
    return a.join(b, "method").select("method", "windows_old", "windows_new", *[x for m in metrics for x in (F.col(f"{m}_old"), F.col(f"{m}_new"), (F.col(f"{m}_new") - F.col(f"{m}_old")).alias(f"{m}_change"))])


def configuration_table(configs: dict[str, dict], windows: DataFrame) -> DataFrame:
    """Each run's settings and what it covered: windows (run, window_id, ...) counted, with the first and the last one; runs without windows are kept."""
    spark = windows.sparkSession
    rows = spark.createDataFrame([{"run": run} | config for run, config in configs.items()])
    found = windows.groupBy("run").agg(F.count_distinct("window_id").alias("n_windows"), F.count("*").alias("n_rows"), F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"))
    return rows.join(found, "run", "left").fillna(0, ["n_windows", "n_rows"])
