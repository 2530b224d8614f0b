"""Paired comparison of methods over windows: block bootstrap, signed ranks, effect sizes, Holm's correction, verdicts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .grid import time_split, union_all
from .ranking import average_rank
from .resampling import block_intervals, cluster_intervals

#: What a comparison is made within, beside the metric.
KEYS = ("scenario", "horizon", "part", "report")
#: Values are compared at so many digits, so that ties do not hang on the order of sums.
DIGITS = 9
#: Metrics of which less is better.
LOWER_IS_BETTER = ("mae", "distortion", "mape")


def long_metrics(protocol: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(window_id, method, metric, value at nine digits), nulls dropped; further key columns are kept."""
    keys = ["window_id", "method", *[c for c in KEYS if c in protocol.columns]]
    return protocol.select(*keys, *[F.round(F.col(m).cast("double"), DIGITS).alias(m) for m in metrics]).unpivot(keys, list(metrics), "metric", "value").where("value is not null and not isnan(value)")


def block_means(rows: DataFrame, block: int, by: list[str]) -> DataFrame:
    """Means of consecutive blocks of windows per group; an incomplete last block is dropped."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("window_id")) - 1
    return rows.withColumn("block", F.floor(nth / block)).groupBy(*by, "block").agg(F.avg("value").alias("value"), F.count("*").alias("n")).where(F.col("n") == block).drop("n")


def _ranks(x: np.ndarray) -> np.ndarray:
    order = np.argsort(x, kind="stable")
    _, at, n = np.unique(x[order], return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    out = np.empty(len(x))
    out[order] = (ends - (n - 1) / 2)[at]
    return out


def wilcoxon(d: np.ndarray) -> float:
    """Two-sided signed-rank p value; zeros are dropped, all zero gives 1.

    Exact for at most 50 differences without ties, else normal with correction for ties.
    """
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    r = _ranks(np.abs(d))
    plus = r[d > 0].sum()
    tied = len(np.unique(np.abs(d))) < n
    if n <= 50 and not tied:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for i in range(1, n + 1):
            ways[i:] = ways[i:] + ways[:-i]
        low = min(plus, n * (n + 1) / 2 - plus)
        return float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24
    counts = np.unique(np.abs(d), return_counts=True)[1]
    var -= (counts**3 - counts).sum() / 48
    return float(math.erfc(abs(plus - mean) / math.sqrt(2 * var)))


def _by(rows: DataFrame) -> list[str]:
    return [c for c in KEYS if c in rows.columns] + ["metric", "method"]


def paired(long_rows: DataFrame, reference: str) -> DataFrame:
    """(metric, method, window_id, ref, value, diff) in each cell: diff is positive where the reference is better."""
    keys = [*_by(long_rows)[:-1], "window_id"]
    ref = long_rows.where(F.col("method") == reference).select(*keys, F.col("value").alias("ref"))
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1.0).otherwise(1.0)
    return long_rows.where(F.col("method") != reference).join(ref, keys).select(*keys, "method", "ref", "value", F.round((F.col("ref") - F.col("value")) * sign, DIGITS).alias("diff"))


def effect_sizes(pairs: DataFrame) -> DataFrame:
    """Per metric and method: windows, wins, losses, ties, mean difference, matched rank-biserial, Cliff's delta."""
    by = _by(pairs)
    some = pairs.where("diff <> 0").withColumn("size", F.abs("diff")).withColumn("r", average_rank("size", by))
    biserial = some.groupBy(*by).agg((F.sum(F.when(F.col("diff") > 0, F.col("r")).otherwise(-F.col("r"))) / F.sum("r")).alias("rank_biserial"))
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -1.0).otherwise(1.0)
    both = pairs.select(*by, (F.col("ref") * sign).alias("v"), F.lit(1).alias("own")).unionByName(pairs.select(*by, (F.col("value") * sign).alias("v"), F.lit(0).alias("own")))
    ranked = both.withColumn("r", average_rank("v", by))
    n = F.sum("own")
    cliff = ranked.groupBy(*by).agg((2 * (F.sum(F.when(F.col("own") == 1, F.col("r"))) - n * (n + 1) / 2) / (n * n) - 1).alias("cliffs_delta"))
    count = lambda rule: F.sum(rule.cast("int"))
    base = pairs.groupBy(*by).agg(F.count("*").alias("n"), count(F.col("diff") > 0).alias("wins"), count(F.col("diff") < 0).alias("losses"), count(F.col("diff") == 0).alias("ties"), F.avg("diff").alias("mean_diff"))
    return base.join(biserial, by, "left").join(cliff, by, "left")


def tests(pairs: DataFrame, block: int) -> DataFrame:
    """Per cell, metric and method: p of single windows and of block means, number of blocks. One group is one pair's windows."""
    by = _by(pairs)
    kinds = dict(pairs.dtypes)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("window_id")
        d = t["diff"].to_numpy()
        full = np.round(d[: len(d) // block * block].reshape(-1, block).mean(1), 12)
        facts = {"p_window": wilcoxon(d), "p_block": wilcoxon(full) if len(full) else None}
        return pa.table([*(t[c].slice(0, 1) for c in by), *(pa.array([x], pa.float64()) for x in facts.values()), pa.array([len(full)], pa.int64())], names=[*by, *facts, "n_blocks"])

    return pairs.select(*by, "window_id", "diff").groupBy(*by).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", p_window double, p_block double, n_blocks long")


def cell_verdicts(long_rows: DataFrame, reference: str, block: int) -> DataFrame:
    """Per cell, metric and method: mean difference to the reference, verdict by Holm-adjusted block tests, and by single windows."""
    pairs, family = paired(long_rows, reference), _by(long_rows)[:-1]
    out = pairs.groupBy(*_by(pairs)).agg(F.avg("diff").alias("mean_diff")).join(tests(pairs, block), _by(pairs))
    out = holm(out, "p_block", family, "p_holm").withColumn("verdict", verdict("p_holm")).withColumn("verdict_sens", verdict("p_window"))
    return out.withColumn("reference", F.lit(reference))


def holm(df: DataFrame, p: str, family: list[str], out: str) -> DataFrame:
    """Holm-adjusted p values in each family; nulls stay null."""
    w = Window.partitionBy(*family, F.col(p).isNull()).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*family))
    step = df.withColumn("_step", (m - F.row_number().over(w) + 1) * F.col(p))
    running = F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), running))).drop("_step")


def verdict(p: str, diff: str = "mean_diff", level: float = 0.05) -> Column:
    """ref_better, ref_worse or n.s."""
    return F.when((F.col(p) < level) & (F.col(diff) > 0), "ref_better").when((F.col(p) < level) & (F.col(diff) < 0), "ref_worse").otherwise("n.s.")


@dataclass(frozen=True)
class Report:
    """A part report: methods (None: all others) against a reference on some parts of the windows.

    p values are corrected over the methods of a metric, or over the metrics of a method where
    `over` says so (a confirmation of one planned pair).
    """

    name: str
    reference: str
    methods: tuple[str, ...] | None = None
    parts: tuple[str, ...] = ("all", "tune", "test")
    over: str = "methods"


def with_parts(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """rows once as part all, and once as part tune (the first windows) or test."""
    split = time_split(rows, share)
    return rows.join(split.withColumnRenamed("part", "own"), "window_id").withColumn("part", F.explode(F.array(F.lit("all"), "own"))).drop("own")


def report_pairs(long_rows: DataFrame, reports: list[Report]) -> DataFrame:
    """Paired differences of every report, with its name; long_rows has a part."""
    out = []
    for r in reports:
        rows = long_rows.where(F.col("part").isin(*r.parts))
        if r.methods is not None:
            rows = rows.where(F.col("method").isin(r.reference, *r.methods))
        out.append(paired(rows, r.reference).withColumn("report", F.lit(r.name)).withColumn("reference", F.lit(r.reference)))
    return union_all(out)


def part_reports(protocol: DataFrame, reports: list[Report], metrics: tuple[str, ...], block: int, block_sens: int | None = None, draws: int = 10_000, seed: int = 42, share: float = 0.3) -> DataFrame:
    """Report x part x metric x method: effect sizes, interval of the mean difference, corrected p values and verdicts, also for a second block length.

    All reports and parts go through the same few exchanges, as keys.
    """
    long_rows = with_parts(long_metrics(protocol, metrics), share)
    pairs = stored(report_pairs(long_rows, reports), "report-pairs")
    by = _by(pairs)
    facts = effect_sizes(pairs).join(tests(pairs, block), by).join(block_intervals(pairs, by, "diff", "window_id", block, draws, seed), by)
    if block_sens:
        facts = facts.join(tests(pairs, block_sens).select(*by, F.col("p_block").alias("p_sens")), by)
    over_metrics = [r.name for r in reports if r.over == "metrics"]
    facts = facts.withColumn("_family", F.when(F.col("report").isin(over_metrics), F.col("method")).otherwise(F.col("metric")))
    family = [*by[:-2], "_family"]
    facts = holm(holm(facts, "p_window", family, "p_window_holm"), "p_block", family, "p_block_holm").withColumn("verdict", verdict("p_block_holm"))
    if block_sens:
        facts = holm(facts, "p_sens", family, "p_sens_holm").withColumn("verdict_sens", verdict("p_sens_holm"))
    names = F.create_map(*[F.lit(x) for r in reports for x in (r.name, r.reference)])
    return facts.drop("_family").withColumn("reference", names[F.col("report")])


def paired_report(protocol: DataFrame, reference: str, metrics: tuple[str, ...], block: int, block_sens: int | None = None, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Metric x method against a reference over all windows (see part_reports)."""
    return part_reports(protocol, [Report("main", reference, parts=("all",))], metrics, block, block_sens, draws, seed).drop("report", "part")


def method_moments(long_rows: DataFrame) -> DataFrame:
    """Metric x method: n, mean, sd, median."""
    return long_rows.groupBy("metric", "method").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.lit(0.5)).alias("median"))


def method_summary(long_rows: DataFrame, block: int, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Metric x method: n, mean, sd, median, and the block-bootstrap interval of the mean."""
    by = ["metric", "method"]
    return method_moments(long_rows).join(block_intervals(long_rows, by, "value", "window_id", block, draws, seed), by)


def cluster_bootstrap(rows: DataFrame, by: str, value: str, position: str, block: int, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Number of clusters, mean, and its interval when rows come in clusters of positions (position // block): clusters are drawn, not rows."""
    picked = rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"), F.floor(F.col(position) / block).cast("long").alias("c"))
    facts = picked.groupBy(by).agg(F.count_distinct("c").alias("n_clusters"), F.avg("v").alias("mean"))
    return facts.join(cluster_intervals(picked, [by], "v", "c", draws, seed), by)


def bonferroni(pairs: DataFrame, least: int = 10) -> DataFrame:
    """Signed-rank tests at 0.05 over the number of tests; pairs with fewer than `least` non-zero differences are skipped."""
    enough = pairs.where("diff <> 0").groupBy("metric", "method").agg(F.count("*").alias("m")).where(F.col("m") >= least)
    out = tests(pairs, 1).select("metric", "method", "p_window").join(enough, ["metric", "method"])
    return out.withColumn("significant", F.col("p_window") < 0.05 / F.count("*").over(Window.partitionBy()))


def block_length(base: int, window: int, horizon: int, rule: str = "overlap") -> int:
    """max(b, h), or max(b, N + h - 1) where windows overlap."""
    return max(base, horizon) if rule == "horizon" else max(base, window + horizon - 1)


def pairing_check(protocol: DataFrame, reference: str) -> DataFrame:
    """Per method: windows without a partner on either side, and windows whose item counts differ."""
    ref = protocol.where(F.col("method") == reference).select("window_id", F.col("num_items").alias("n_ref"))
    methods = protocol.select("method").distinct().where(F.col("method") != reference)
    full = protocol.where(F.col("method") != reference).select("method", "window_id", "num_items").join(methods.crossJoin(ref), ["method", "window_id"], "full_outer")
    count = lambda rule: F.sum(rule.cast("int"))
    return full.groupBy("method").agg(count(F.col("num_items").isNull()).alias("only_reference"), count(F.col("n_ref").isNull()).alias("only_method"), F.coalesce(count(F.col("num_items") != F.col("n_ref")), F.lit(0)).alias("other_items"))
