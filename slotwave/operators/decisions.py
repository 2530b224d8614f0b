"""Verdict algebra: from paired comparisons of cells (scenario, horizon, reference, method, metric) to decisions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import average_rank

CELL = ["scenario", "horizon"]


def _count(rule: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(rule, F.lit(False)).cast("int")), F.lit(0))


def pareto_cells(verdicts: DataFrame, gain: str = "rsi_10", hold: str = "ndcg_10") -> DataFrame:
    """Per cell, reference and method: success if the reference is better on `gain` and not worse on `hold`; null if either is missing."""
    wide = verdicts.where(F.col("metric").isin(gain, hold)).groupBy(*CELL, "reference", "method").pivot("metric", [gain, hold]).agg(F.first("verdict"))
    return wide.withColumn("success", (F.col(gain) == "ref_better") & (F.col(hold) != "ref_worse"))


def success_rule(cells: DataFrame, need: int, by: list[str]) -> DataFrame:
    """Counts of successful, failed and missing cells, and whether at least `need` succeed (null while the missing ones decide)."""
    out = cells.groupBy(*by).agg(_count(F.col("success")).alias("n_success"), _count(~F.col("success")).alias("n_fail"), F.sum(F.col("success").isNull().cast("int")).alias("n_missing"))
    return out.withColumn("passed", F.when(F.col("n_success") >= need, True).when(F.col("n_success") + F.col("n_missing") < need, False))


def best_baseline(means: DataFrame, baselines: list[str], lower_is_better: tuple[str, ...] = ("mae",)) -> DataFrame:
    """Best baseline per cell and metric by mean; ties go to the earlier one in the list."""
    place = F.array_position(F.array(*map(F.lit, baselines)), F.col("method"))
    value = F.when(F.col("metric").isin(*lower_is_better), -F.col("mean")).otherwise(F.col("mean"))
    w = Window.partitionBy(*CELL, "metric").orderBy(F.desc("_v"), "_p")
    return means.where(F.col("method").isin(baselines)).withColumn("_v", value).withColumn("_p", place).withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*CELL, "metric", F.col("method").alias("best"), F.col("mean").alias("best_mean"))


def gain_claims(means: DataFrame, best: DataFrame, method: str) -> DataFrame:
    """Relative gain of a method over the best baseline of each cell and metric."""
    own = means.where(F.col("method") == method).select(*CELL, "metric", F.col("mean").alias("own_mean"))
    return own.join(best, [*CELL, "metric"]).withColumn("gain", (F.col("own_mean") - F.col("best_mean")) / F.nullif(F.abs("best_mean"), F.lit(0.0)))


def effect_table(means: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Difference of means of named method pairs per cell and metric (a method's domain effect)."""
    parts = []
    for a, b in pairs:
        left, right = (means.where(F.col("method") == m).select(*CELL, "metric", F.col("mean").alias(n)) for m, n in ((a, "mean_a"), (b, "mean_b")))
        parts.append(left.join(right, [*CELL, "metric"]).select(*CELL, "metric", F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col("mean_a") - F.col("mean_b")).alias("effect")))
    return reduce(lambda x, y: x.unionByName(y), parts)


def negative_results(verdicts: DataFrame, cells: DataFrame) -> DataFrame:
    """Findings against the reference, with their kind."""
    worse = verdicts.where("verdict = 'ref_worse'").select(*CELL, "method", "metric", F.lit("worse").alias("kind"))
    flat = verdicts.where("verdict = 'n.s.'").select(*CELL, "method", "metric", F.lit("no_difference").alias("kind"))
    failed = cells.where("success = false").select(*CELL, "method", F.lit("all").alias("metric"), F.lit("cell_failed").alias("kind"))
    return worse.unionByName(flat).unionByName(failed)


def relation(verdicts: DataFrame, by: list[str] = [*CELL, "reference", "method"]) -> DataFrame:  # noqa: B006
    """dominates, dominated, trade-off or equal, by the reference's better and worse metrics."""
    out = verdicts.groupBy(*by).agg(_count(F.col("verdict") == "ref_better").alias("n_better"), _count(F.col("verdict") == "ref_worse").alias("n_worse"))
    return out.withColumn("relation", F.when((F.col("n_better") > 0) & (F.col("n_worse") > 0), "trade-off").when(F.col("n_better") > 0, "dominates").when(F.col("n_worse") > 0, "dominated").otherwise("equal"))


def dominance_counts(relations: DataFrame, by: list[str]) -> DataFrame:
    return relations.groupBy(*by).agg(*[_count(F.col("relation") == r).alias(r.replace("-", "_")) for r in ("dominates", "dominated", "trade-off", "equal")])


def turned(verdicts: DataFrame) -> DataFrame:
    """The same comparisons with reference and method exchanged."""
    flip = F.when(F.col("verdict") == "ref_better", "ref_worse").when(F.col("verdict") == "ref_worse", "ref_better").otherwise(F.col("verdict"))
    return verdicts.withColumn("_m", F.col("method")).withColumn("method", F.col("reference")).withColumn("reference", F.col("_m")).withColumn("verdict", flip).drop("_m")


def screen(counts: DataFrame, least: int) -> DataFrame:
    """Final state per row of dominance counts: accept, reject or open."""
    return counts.withColumn("state", F.when((F.col("dominates") >= least) & (F.col("dominated") == 0), "accept").when(F.col("dominated") >= least, "reject").otherwise("open"))


def screens(relations: DataFrame, candidate: str, other: str, most: int, most_losses: int, part: str = "part") -> DataFrame:
    """Per part: how often candidate and other are dominated, how often other dominates candidate, three conditions, and whether all hold.

    T1: the candidate is dominated in at most `most` comparisons; T2: in fewer than the other
    method; T3: the other dominates it in at most most_losses of them. relations hold each pair
    in both directions.
    """
    own = lambda name, rule: _count((F.col("reference") == name) & rule)
    lost = F.col("relation") == "dominated"
    out = relations.groupBy(part).agg(own(candidate, lost).alias("d_candidate"), own(other, lost).alias("d_other"), own(other, (F.col("method") == candidate) & (F.col("relation") == "dominates")).alias("n_lost"))
    out = out.withColumn("t1", F.col("d_candidate") <= most).withColumn("t2", F.col("d_candidate") < F.col("d_other")).withColumn("t3", F.col("n_lost") <= most_losses)
    return out.withColumn("passed", F.col("t1") & F.col("t2") & F.col("t3"))


def final_state(screened: DataFrame) -> DataFrame:
    """screened with the decision over all its parts: accepted if all pass, rejected if none does, else inconsistent."""
    every = Window.partitionBy()
    return screened.withColumn("final", F.when(F.min("passed").over(every), "accepted").when(~F.max("passed").over(every), "rejected").otherwise("inconsistent"))


def mechanism_outcome(relations: DataFrame, richer: str, plain: str, cells: int, least: int) -> DataFrame:
    """One row: in how many cells the richer method dominates the plain one or is dominated, and what follows.

    adds: it dominates in at least `cells`; nothing: it does not in at least `cells`, and dominates in fewer than `least`; else mixed.
    """
    pair = relations.where((F.col("reference") == richer) & (F.col("method") == plain))
    out = pair.agg(F.count("*").alias("n_cells"), *[_count(F.col("relation") == r).alias(r) for r in ("dominates", "dominated")])
    won = F.col("dominates")
    return out.withColumn("outcome", F.when(won >= cells, "adds").when((F.col("n_cells") - won >= cells) & (won < least), "nothing").otherwise("mixed"))


def clamp_cost(verdicts: DataFrame, clamped: str, free: str, most: int) -> DataFrame:
    """Per metric: cells in which the clamped method is better, not different or worse than the free one, and whether worse ones are more than `most`."""
    pair = verdicts.where((F.col("reference") == clamped) & (F.col("method") == free))
    counts = {"better": "ref_better", "not_different": "n.s.", "worse": "ref_worse"}
    return pair.groupBy("metric").agg(*[_count(F.col("verdict") == v).alias(n) for n, v in counts.items()]).withColumn("lowered", F.col("worse") > most)


def mechanism(gains: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Signs of gains against verdicts: S+ / S- gains of either sign, R+ / R- those that the verdict supports."""
    both = gains.join(verdicts.select(*CELL, "metric", "verdict"), [*CELL, "metric"])
    up = F.col("gain") > 0
    return both.groupBy("metric").agg(_count(up).alias("s_plus"), _count(F.col("gain") < 0).alias("s_minus"), _count(up & (F.col("verdict") == "ref_better")).alias("r_plus"), _count((F.col("gain") < 0) & (F.col("verdict") == "ref_worse")).alias("r_minus"))


def block_sensitivity(verdicts: DataFrame, a: str = "verdict", b: str = "verdict_sens", by: tuple[str, ...] = ("metric",)) -> DataFrame:
    """How verdicts change under another block length: same, significance lost or gained, reversed."""
    x, y = F.col(a), F.col(b)
    kind = F.when(x == y, "same").when(y == "n.s.", "lost").when(x == "n.s.", "gained").otherwise("reversed")
    return verdicts.withColumn("_k", kind).groupBy(*by).agg(*[_count(F.col("_k") == k).alias(k) for k in ("same", "lost", "gained", "reversed")])


def effect_medians(report: DataFrame, by: tuple[str, ...] = ("metric",)) -> DataFrame:
    return report.groupBy(*by).agg(F.percentile("rank_biserial", F.lit(0.5)).alias("median_biserial"), F.percentile("cliffs_delta", F.lit(0.5)).alias("median_delta"), F.count("*").alias("n"))


def aggregate_ranking(means: DataFrame, lower_is_better: tuple[str, ...] = ("mae",)) -> DataFrame:
    """Per method: average rank over cells and metrics, and number of first places."""
    value = F.when(F.col("metric").isin(*lower_is_better), F.col("mean")).otherwise(-F.col("mean"))
    ranked = means.withColumn("_v", value).withColumn("r", average_rank("_v", [*CELL, "metric"]))
    return ranked.groupBy("method").agg(F.avg("r").alias("average_rank"), _count(F.col("r") == 1).alias("first_places"), F.percentile("r", F.lit(0.5)).alias("median_rank"), F.count("*").alias("n"))


def median_ranks(means: DataFrame, lower_is_better: tuple[str, ...] = ("mae",)) -> DataFrame:
    """Median over cells of each method's average rank in a metric."""
    value = F.when(F.col("metric").isin(*lower_is_better), F.col("mean")).otherwise(-F.col("mean"))
    ranked = means.withColumn("_v", value).withColumn("r", average_rank("_v", [*CELL, "metric"]))
    return ranked.groupBy("method", "metric").agg(F.percentile("r", F.lit(0.5)).alias("median_rank"), F.count("*").alias("n_cells"))


def cell_ranges(comparisons: DataFrame) -> DataFrame:
    """Per cell: least and most windows and blocks of its comparisons (n_windows, n_blocks)."""
    return comparisons.groupBy(*CELL).agg(*[f(c).cast("long").alias(f"{n}_{c[2:]}") for c in ("n_windows", "n_blocks") for f, n in ((F.min, "least"), (F.max, "most"))])


def bound_extremes(bounds: DataFrame, by: tuple[str, ...] = ("horizon", "method")) -> DataFrame:
    """Smallest and largest ratio over scenarios, with the bounds that hold for them."""
    return bounds.groupBy(*by).agg(F.min("lower").alias("lower"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("upper").alias("upper"))


def select_setting(verdicts: DataFrame, setting: str, metrics: tuple[str, ...], cells: int) -> DataFrame:
    """Per setting (the reference of its verdicts): cells, complete ones and successes; the one with most successes is selected, of equals the largest.

    A cell succeeds if the setting is better on one metric at least and worse on none. Nothing
    is selected while a cell is missing.
    """
    by = [setting, *CELL]
    own = verdicts.where(F.col("metric").isin(*metrics)).groupBy(*by).agg(_count(F.col("verdict") == "ref_better").alias("b"), _count(F.col("verdict") == "ref_worse").alias("w"), F.count_distinct("metric").alias("n"))
    success = (F.col("n") == len(metrics)) & (F.col("b") >= 1) & (F.col("w") == 0)
    out = own.groupBy(setting).agg(F.count("*").alias("n_cells"), _count(F.col("n") == len(metrics)).alias("n_complete"), _count(success).alias("n_success"))
    everything = Window.partitionBy()
    first = F.row_number().over(everything.orderBy(F.desc("n_success"), F.desc(setting))) == 1
    return out.withColumn("selected", first & (F.min("n_complete").over(everything) == cells))


def sensitivity(means: DataFrame, by: str, metrics: tuple[str, ...]) -> DataFrame:
    """Per value of a setting: number of configurations, mean and range of each metric over them."""
    return means.groupBy(by).agg(F.count("*").alias("n"), *[f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.min, "min"), (F.max, "max"))])


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("method", "metric").pivot("verdict", ["ref_better", "ref_worse", "n.s."]).count().fillna(0).withColumnRenamed("n.s.", "not_significant")


def skyline(rows: DataFrame, up: list[str], down: list[str], by: list[str]) -> DataFrame:
    """Rows with flag `skyline`: no other row of the group is as good on all criteria and better on one.

    Groups are the methods of a scenario, so the self-join stays inside small groups.
    """
    other = rows.select(*by, *[F.col(c).alias(f"o_{c}") for c in up + down])
    as_good = reduce(lambda a, b: a & b, [F.col(f"o_{c}") >= F.col(c) for c in up] + [F.col(f"o_{c}") <= F.col(c) for c in down])
    better = reduce(lambda a, b: a | b, [F.col(f"o_{c}") > F.col(c) for c in up] + [F.col(f"o_{c}") < F.col(c) for c in down])
    beaten = rows.join(other, by).where(as_good & better).select(*rows.columns).distinct()
    return rows.join(beaten.withColumn("_b", F.lit(True)), rows.columns, "left").withColumn("skyline", F.col("_b").isNull()).drop("_b")


def _undominated(v: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Which points no other point dominates (at least as large in all criteria, larger in one): in falling order of their sums, against the points kept so far."""
    order = np.argsort(-v.sum(1), kind="stable")
    kept, keep = np.zeros((0, v.shape[1])), np.zeros(len(v), bool)
    for lo in range(0, len(order), chunk):
        at = order[lo : lo + chunk]
        at = at[~_dominated(v[at], kept)]
        at = at[~_dominated(v[at], v[at])]
        keep[at] = True
        kept = np.concatenate([kept, v[at]])
    return keep


def _dominated(v: np.ndarray, by: np.ndarray, step: int = 4096) -> np.ndarray:
    """Which points of v some point of `by` dominates."""
    out = np.zeros(len(v), bool)
    for lo in range(0, len(by), step):
        left = np.flatnonzero(~out)
        b = by[lo : lo + step]
        as_large, larger = np.ones((len(left), len(b)), bool), np.zeros((len(left), len(b)), bool)
        for c in range(v.shape[1]):
            as_large &= b[None, :, c] >= v[left, None, c]
            larger |= b[None, :, c] > v[left, None, c]
        out[left] = (as_large & larger).any(1)
    return out


def skyline_large(rows: DataFrame, up: list[str], down: list[str], by: list[str], parts: int = 16) -> DataFrame:
    """rows with the flag skyline, for any number of rows in a group of `by`.

    Each part of a group keeps its own skyline; what is kept is then held against the kept points
    of every other part, pair by pair of parts. No task holds more than two parts. A row with a null or
    undefined criterion neither dominates nor is dominated; equal rows do not dominate each other.
    """
    from ..sources.tables import stored

    value = [F.col(f"`{c}`").cast("double") for c in up] + [-F.col(f"`{c}`").cast("double") for c in down]
    base = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "skyline-rows")
    width = len(value)
    whole = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) for x in value])
    points = base.where(whole).select("_id", F.xxhash64(F.lit(0), *by).alias("g"), F.array(*value).alias("v")).withColumn("part", F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int"))

    def matrix(t: pa.Table) -> np.ndarray:
        return np.array(t["v"].combine_chunks().flatten()).reshape(t.num_rows, width)

    def own(t: pa.Table) -> pa.Table:
        return t.filter(pa.array(_undominated(matrix(t))))

    def lost(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"_id": pa.array([], pa.int64())})
        return a.select(["_id"]).filter(pa.array(_dominated(matrix(a), matrix(b))))

    kept = stored(points.groupBy("g", "part").applyInArrow(own, points.schema), "skyline-kept")
    others = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("k")
    one = kept.select("_id", "g", "v", F.col("part").alias("i"), others).withColumnRenamed("k", "j").where("i <> j")
    two = kept.select("g", "v", F.col("part").alias("j"), others).withColumnRenamed("k", "i").where("i <> j")
    gone = one.groupBy("g", "i", "j").cogroup(two.groupBy("g", "i", "j")).applyInArrow(lost, "_id long").distinct()
    inside = kept.join(gone, "_id", "left_anti").select("_id", F.lit(True).alias("_in"))
    return base.withColumn("_whole", whole).join(inside, "_id", "left").withColumn("skyline", ~F.col("_whole") | F.col("_in").isNotNull()).drop("_id", "_in", "_whole")


def rolling_mean(protocol: DataFrame, metric: str, length: int, least: int = 1) -> DataFrame:
    """Centred rolling mean and sd of a metric over a method's windows; null below `least` values."""
    w = Window.partitionBy("method").orderBy("window_id").rowsBetween(-(length // 2), length - length // 2 - 1)
    enough = F.count(metric).over(w) >= least
    return protocol.select("method", "window_id", metric, F.when(enough, F.avg(metric).over(w)).alias("mean"), F.when(enough, F.stddev_samp(metric).over(w)).alias("sd"))


def normalised(wide: DataFrame, up: list[str], down: list[str]) -> DataFrame:
    """Min-max scaled metrics over the methods; lower-is-better ones inverted."""
    w = Window.partitionBy()
    scale = lambda c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-12)
    return wide.select("method", *[scale(c).alias(c) for c in up], *[(1 - scale(c)).alias(c) for c in down])


def composite(scaled: DataFrame, weights: dict[str, float]) -> DataFrame:
    total = sum(weights.values())
    return scaled.withColumn("composite", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)) / total)


def best_mask(wide: DataFrame, metrics: list[str], digits: int = 3, lower_is_better: tuple[str, ...] = ("mae",)) -> DataFrame:
    """Which methods are best at the printed precision, metric by metric."""
    w = Window.partitionBy()
    out = lambda c: F.round(c, digits) == (F.min if c in lower_is_better else F.max)(F.round(c, digits)).over(w)
    return wide.select("method", *[out(c).alias(f"best_{c}") for c in metrics])


def window_table(protocol: DataFrame, metric: str, methods: list[str], baselines: list[str]) -> DataFrame:
    """One column per method on common windows, and the lift of each other method over the best baseline."""
    wide = protocol.groupBy("window_id").pivot("method", methods).agg(F.first(metric)).dropna()
    top = F.greatest(*[F.col(f"`{b}`") for b in baselines]) if len(baselines) > 1 else F.col(f"`{baselines[0]}`")
    return wide.select("*", *[(F.col(f"`{m}`") - top).alias(f"lift_{m}") for m in methods if m not in baselines])


def run_ranges(protocol: DataFrame, by: list[str]) -> DataFrame:
    return protocol.groupBy(*by).agg(F.min("window_id").alias("first"), F.max("window_id").alias("last"), F.count_distinct("window_id").alias("n_windows"))


def numbers_table(wide: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Long form (key, name, value) of a wide table."""
    return wide.select(key, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([key], names, "name", "value")


def cross_check(table: DataFrame, other: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Per name: values of a numbers table compared with those of another source (again), and how many differ or are missing."""
    both = table.join(other, keys, "full_outer")
    apart = F.coalesce(F.abs(F.col("value") - F.col("again")) > tolerance, F.col("value").isNull() != F.col("again").isNull())
    return both.groupBy("name").agg(F.count("*").alias("n_compared"), F.sum(apart.cast("long")).alias("n_different"))
