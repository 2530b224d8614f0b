"""Ranks, top-K sets and ranking metrics per window and method, over rows (window_id, method, item_id, score, truth)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (5, 10, 20)
BY = ["window_id", "method"]


def rank_key(score: str = "score") -> Column:
    """Non-finite and missing scores rank last."""
    s = F.col(score)
    return F.when(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")), F.lit(float("-inf"))).otherwise(s)


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with nth, the place in ascending order from 0 (ties at random), and n_all, the number of rows.

    Rows are dealt into ranges of the order; only the counts of the ranges meet in one task.
    """
    from ..sources.tables import stored

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, since a second run could draw other bounds
    dealt = stored(rows.withColumn("_tie", F.rand(42)).repartitionByRange(parts, order, "_tie").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.partitionBy().orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n_all"))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order, "_tie")) - 1)
    return inside.join(F.broadcast(before), "_part").withColumn("nth", F.col("_before") + F.col("_in")).drop("_part", "_tie", "_in", "_before")


def to_long(wide: DataFrame, methods: list[str], keep: list[str]) -> DataFrame:
    """One column per method -> rows (keep..., method, score)."""
    quoted = [F.col(f"`{m}`") for m in methods]
    return wide.select(*keep, *quoted).unpivot(keep, quoted, "method", "score")


def rank_items(scores: DataFrame, by: list[str] = BY) -> DataFrame:
    """scores with key, rank (score down, item up), truth_rank, n_items, tied (equal to the score before)."""
    w = Window.partitionBy(*by)
    ordered = w.orderBy(F.desc("key"), "item_id")
    return scores.withColumn("key", rank_key()).select(
        "*", F.row_number().over(ordered).alias("rank"), F.row_number().over(w.orderBy(F.desc("truth"), "item_id")).alias("truth_rank"), F.count("*").over(w).alias("n_items"), (F.lag("key").over(ordered) == F.col("key")).alias("tied"),
    )


def places(rows: DataFrame, by: list[str], order: list[Column], out: str, ranges: int) -> DataFrame:
    """rows with `out`, the place from 1 in its group by a complete order, where no task holds a group.

    Rows are dealt into ranges of (group, order); places inside a range are moved on by the counts
    of the group's earlier ranges, of which there are no more than groups and ranges together.
    """
    from ..sources.tables import stored

    # stored, since a second run could draw other bounds
    dealt = stored(rows.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()), "places")
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n")).select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    return inside.join(counts, [*by, "_range"]).withColumn(out, (F.col("_before") + F.col("_in")).cast("int")).drop("_range", "_in", "_before")


def _ranked_by(rows: DataFrame, by: list[str], value: str, place: str, mean: str, ranges: int) -> DataFrame:
    """rows with the place by (value down, item up), the average rank from below, _first (the first place of equal values) and n_items; no task holds a group.

    As in places, rows are dealt into ranges. Equal values are counted inside a range; of those that
    lie in several ranges, at most one for each range, the counts are put together and broadcast.
    """
    from ..sources.tables import stored

    # stored, since a second run could draw other bounds
    dealt = stored(rows.repartitionByRange(ranges, *by, F.desc(value), "item_id").withColumn("_range", F.spark_partition_id()), "places")
    whole = Window.partitionBy(*by)
    counts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    counts = stored(counts.select("*", F.sum("_n").over(whole).alias("n_items"), F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")), "counts")
    small = F.broadcast if counts.count() <= 1 << 18 else (lambda d: d)
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc(value))
    out = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(F.desc(value), "item_id")))
    out = out.withColumn("_at", F.rank().over(inside)).withColumn("_c", F.count("*").over(inside.rangeBetween(Window.currentRow, Window.currentRow)))
    out = out.join(small(counts.select(*by, "_range", "n_items", "_before")), [*by, "_range"])
    # a value goes on in the next range where that one starts with it
    ends = counts.withColumn("_more", F.lead("_hi").over(whole.orderBy("_range")) == F.col("_lo"))
    split = ends.where("_more").select(*by, F.col("_lo").alias(value)).distinct()
    parts = dealt.select(*by, "_range", value).join(F.broadcast(split), [*by, value]).groupBy(*by, value).agg(F.count("*").alias("_all"), F.min("_range").alias("_range"))
    firsts = parts.join(small(counts.select(*by, "_range", "_before", "_n", F.col("_hi").alias("_top"))), [*by, "_range"])
    own = dealt.select(*by, "_range", value).join(F.broadcast(parts.select(*by, value, "_range")), [*by, "_range", value]).groupBy(*by, value).agg(F.count("*").alias("_m"))
    shared = firsts.join(own, [*by, value]).select(*by, value, "_all", (F.col("_before") + F.col("_n") - F.col("_m") + 1).alias("_start"))
    out = out.join(F.broadcast(shared), [*by, value], "left")
    first, n = F.coalesce("_start", F.col("_before") + F.col("_at")), F.coalesce("_all", "_c")
    return out.withColumn(place, (F.col("_before") + F.col("_in")).cast("int")).withColumn("_first", first).withColumn(mean, F.col("n_items") + 1 - (first + (n - 1) / 2)).drop("_range", "_in", "_at", "_c", "_before", "_start", "_all")


def rank_large(scores: DataFrame, by: list[str] = BY, ranges: int = 200) -> DataFrame:
    """What rank_items gives, and the average ranks r_score and r_truth, for windows of any number of items.

    truth_rank and r_truth are kept where scores has them (with_truth_ranks).
    """
    rows = scores if "truth_rank" in scores.columns else with_truth_ranks(scores, by, ranges)
    rows = _ranked_by(rows.withColumn("key", rank_key()), by, "key", "rank", "r_score", ranges)
    return rows.withColumn("tied", F.when(F.col("rank") > 1, F.col("rank") > F.col("_first"))).drop("_first")


def with_truth_ranks(rows: DataFrame, by: list[str], ranges: int = 200) -> DataFrame:
    """rows with truth_rank and r_truth: once for all methods, where each of them scores every item."""
    return _ranked_by(rows, by, "truth", "truth_rank", "r_truth", ranges).drop("_first", "n_items")


#: Rows of one range of a large ranking.
RANGE_ROWS = 1 << 20


def protocol_large(wide: DataFrame, methods: list[str], ks: tuple[int, ...], ranges: int, rows: int, least: int = 1) -> DataFrame:
    """What protocol gives with ranges, from one row an item with a score of every method; `rows` rows have at least `ranges` ranges, of about RANGE_ROWS."""
    cut = lambda n: max(ranges, -(-n // RANGE_ROWS))
    placed = with_truth_ranks(wide, ["window_id"], cut(rows))
    long = to_long(placed, methods, ["window_id", "item_id", "truth", "truth_rank", "r_truth"])
    return with_rsi(window_metrics(rank_large(long, ranges=cut(rows * len(methods))), ks).where(F.col("num_items") >= least), ks).drop(*[f"top_{k}" for k in ks])


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1, equal values share the mean of their places."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def pearson(a: str, b: str) -> Column:
    """Correlation of two columns over the rows that hold both; null where either does not vary.

    Made of moments: the built-in aggregate divides by zero there before any guard around it.
    """
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def ndcg(k: int) -> Column:
    at = lambda rank: F.sum(F.when(F.col(rank) <= k, (F.pow(F.lit(2.0), F.log10(1 + F.col("truth"))) - 1) / F.log2(F.lit(1.0) + F.col(rank))))
    return F.coalesce(at("rank") / F.nullif(at("truth_rank"), F.lit(0.0)), F.lit(0.0))


def coverage(k: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("truth"))) / F.nullif(F.sum("truth"), F.lit(0.0)), F.lit(0.0))


def window_metrics(ranked: DataFrame, ks: tuple[int, ...] = KS, by: list[str] = BY) -> DataFrame:
    """One row per window and method: num_items, ndcg, coverage and top-K sets for each K, mae, spearman_rho, ties_top21, n_nonfinite.

    spearman_rho is null for fewer than two items or a range below 1e-12 on either side.
    """
    rows = ranked if "r_score" in ranked.columns else ranked.withColumn("r_score", average_rank("key", by)).withColumn("r_truth", average_rank("truth", by))
    flat = (F.max("key") - F.min("key") < 1e-12) | (F.max("truth") - F.min("truth") < 1e-12) | (F.count("*") < 2)
    return rows.groupBy(*by).agg(
        F.count("*").alias("num_items"),
        *[ndcg(k).alias(f"ndcg_{k}") for k in ks],
        *[coverage(k).alias(f"coverage_{k}") for k in ks],
        *[F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.col("item_id")))).alias(f"top_{k}") for k in ks],
        F.avg(F.abs(F.col("score") - F.col("truth"))).alias("mae"),
        F.when(~flat, pearson("r_score", "r_truth")).alias("spearman_rho"),
        F.coalesce(F.bool_or(F.col("tied") & (F.col("rank") <= 21)), F.lit(False)).alias("ties_top21"),
        F.sum((F.col("key") == float("-inf")).cast("int")).alias("n_nonfinite"),
    )


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def with_rsi(metrics: DataFrame, ks: tuple[int, ...] = KS, method: str = "method") -> DataFrame:
    """Adds rsi_K: overlap of the top-K set with that of the method's previous evaluated window (null for the first)."""
    w = Window.partitionBy(method).orderBy("window_id")
    return metrics.select("*", *[F.when(F.lag(f"top_{k}").over(w).isNotNull(), jaccard(F.col(f"top_{k}"), F.lag(f"top_{k}").over(w))).alias(f"rsi_{k}") for k in ks])


def protocol(scores: DataFrame, ks: tuple[int, ...] = KS, least: int = 1, ranges: int | None = None) -> DataFrame:
    """Metric rows of every window and method with at least so many items, without the top-K sets. With ranges, windows are ranked by rank_large."""
    ranked = rank_items(scores) if ranges is None else rank_large(scores, ranges=ranges)
    out = with_rsi(window_metrics(ranked, ks).where(F.col("num_items") >= least), ks)
    return out.drop(*[f"top_{k}" for k in ks])


#: Scores of one window that protocol_wide holds in a task at once (512 MB); larger windows are ranked by rank_large.
CELLS = 1 << 26
#: Values that one partition of rows by window is to hold (8 bytes each), so long as there are windows to deal.
TASK_CELLS = 1 << 24


def decimals(x: np.ndarray) -> np.ndarray:
    """Nine digits after the point, halves away from zero."""
    y = x * 1e9
    return np.where(np.abs(y) < 2.0**52, np.trunc(y + np.copysign(0.5, y)) / 1e9, x)


def significant(x: np.ndarray) -> np.ndarray:
    """Nine significant digits of values from 1 on."""
    scale = 10.0 ** np.floor(np.log10(np.maximum(np.abs(x), 1.0)))
    return decimals(x / scale) * scale


def _significant(score: Column) -> Column:
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs(score), F.lit(1.0)))))
    return F.round(score / scale, 9) * scale


#: How scores are rounded before they are compared: in arrays, and as a column.
DIGITS = {"decimals": (decimals, lambda s: F.round(s, 9)), "significant": (significant, _significant)}


def _mean_ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1 less their mean; equal values share the mean of their places."""
    order = np.argsort(v)
    s = v[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    ends = np.append(first[1:], len(s))
    out = np.empty(len(s))
    out[order] = np.repeat((first + ends + 1) / 2, ends - first)
    return out - (len(s) + 1) / 2


def _truth_side(truth: np.ndarray, deepest: int, rho: bool) -> dict:
    """What all methods that score the same items share: their largest truths, the sum, and ranks."""
    least = min(deepest, len(truth))
    flat = len(truth) < 2 or np.ptp(truth) < 1e-12
    best = np.sort(np.partition(truth, len(truth) - least)[len(truth) - least :])[::-1] if least else truth[:0]
    return {"best": best, "total": truth.sum(), "flat": flat, "ranks": _mean_ranks(truth) if rho and not flat else None}


def _gains(truth: np.ndarray) -> np.ndarray:
    return (2.0 ** np.log10(1 + truth) - 1) / np.log2(2.0 + np.arange(len(truth)))


def _measured(score: np.ndarray, truth: np.ndarray, items: pa.Array, side: dict, ks: tuple[int, ...], rho: bool) -> dict:
    """The columns of window_metrics for one method; rows come in any order."""
    n = len(score)
    key = np.where(np.isfinite(score), score, -np.inf)
    deep = min(max(*ks, 21) if ks else 21, n)
    near = np.flatnonzero(key >= np.partition(key, n - deep)[n - deep])
    order = pc.sort_indices(pa.table([pa.array(-key[near]), items.take(pa.array(near))], names=["key", "item"]), [("key", "ascending"), ("item", "ascending")])
    top = near[order.to_numpy()[:deep]]
    got, ideal = _gains(truth[top]), _gains(side["best"])
    out = {"num_items": n, "mae": float(np.abs(score - truth).mean()), "n_nonfinite": int((key == -np.inf).sum()), "ties_top21": bool((key[top[1:21]] == key[top[: min(deep, 21) - 1]]).any()), "spearman_rho": None}
    for k in ks:
        most = ideal[:k].sum()
        out[f"ndcg_{k}"] = float(got[:k].sum() / most) if most else 0.0
        out[f"coverage_{k}"] = float(truth[top[:k]].sum() / side["total"]) if side["total"] else 0.0
        out[f"top_{k}"] = sorted(items.take(pa.array(top[:k])).to_pylist())
    if rho and not side["flat"] and not key.max() - key.min() < 1e-12:
        a, b = _mean_ranks(key), side["ranks"]
        spread = float(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
        out["spearman_rho"] = float((a * b).sum()) / spread if spread else None
    return out


def wide_metrics(wide: DataFrame, methods: dict[str, Column], ks: tuple[int, ...] = KS, digits: str = "decimals", rho: bool = True, cells: int = 0, truths: dict[str, str] | None = None) -> DataFrame:
    """What window_metrics gives, from rows (window_id, item_id, truth, what the scores are made of): one row an item, not one a method.

    Rows are exchanged once, by window, before the scores are made; a window's rows follow each
    other and are measured when it ends, method by method. A null score is none: the item has no
    place in that method's ranking. Without rho spearman_rho stays null, and no method is sorted whole.
    cells is the most rows that there can be, times their columns: a partition is to have TASK_CELLS of them.
    truths names each method's column of truths, if not truth; where that is null, the method has no score.
    """
    truths = truths or dict.fromkeys(methods, "truth")
    sides_of = {t: i for i, t in enumerate(dict.fromkeys(truths.values()))}
    names, kinds = list(methods), dict(wide.dtypes)
    wanted = -(-cells // TASK_CELLS)
    dealt = wide.repartition(wanted, "window_id") if wanted > int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")) else wide.repartition("window_id")
    scores = [c.cast("double") if truths[m] == "truth" else F.when(F.col(truths[m]).isNotNull(), c.cast("double")) for m, c in methods.items()]
    rows = dealt.sortWithinPartitions("window_id").select("window_id", "item_id", *[F.col(t).cast("double").alias(f"t{i}") for t, i in sides_of.items()], *[c.alias(f"s{i}") for i, c in enumerate(scores)])
    fields = {"window_id": kinds["window_id"], "method": "string", "num_items": "long"} | {f"{m}_{k}": "double" for m in ("ndcg", "coverage") for k in ks} | {f"top_{k}": f"array<{kinds['item_id']}>" for k in ks}
    fields |= {"mae": "double", "spearman_rho": "double", "ties_top21": "boolean", "n_nonfinite": "long"}
    nine = DIGITS[digits][0]

    def measure(parts: list[pa.RecordBatch]) -> Iterator[dict]:
        t = pa.Table.from_batches(parts)
        window, items, every = t.column(0)[0].as_py(), t.column(1).combine_chunks(), [t.column(2 + i).to_numpy() for i in sides_of.values()]
        sides: dict[tuple[int, bytes], dict] = {}
        for i, name in enumerate(names):
            column, truth = t.column(2 + len(every) + i), every[sides_of[truths[name]]]
            here = None if column.null_count == 0 else np.asarray(column.is_valid())
            score, own, of = column.to_numpy(), truth, items
            if here is not None:
                if not here.any():
                    continue
                score, own, of = score[here], truth[here], items.filter(pa.array(here))
            at = sides_of[truths[name]], b"" if here is None else np.packbits(here).tobytes()
            if at not in sides:
                sides[at] = _truth_side(own, max(ks, default=0), rho)
            yield {"window_id": window, "method": name} | _measured(nine(score), own, of, sides[at], ks, rho)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = None, []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column(0)[0].as_py() != ids[lo]:
                    yield out_batch(list(measure(held)), held[0])
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield out_batch(list(measure(held)), held[0])

    arrow = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}

    def out_batch(made: list[dict], like: pa.RecordBatch) -> pa.RecordBatch:
        kind = lambda c, t: like.schema.field(0).type if c == "window_id" else pa.list_(like.schema.field(1).type) if c.startswith("top_") else arrow[t]
        return pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], kind(c, t)) for c, t in fields.items()], names=list(fields))

    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in fields.items()))


def protocol_wide(wide: DataFrame, methods: dict[str, Column], ks: tuple[int, ...] = KS, least: int = 1, live: DataFrame | None = None, items: int | None = None, digits: str = "decimals", rho: bool = True, cells: int = CELLS, windows: int = 0, truths: dict[str, str] | None = None) -> DataFrame:
    """What protocol gives for the methods' scores, rounded to nine digits, over one row an item (see wide_metrics).

    live names the windows that count, if not all; items is the most that a window can have, windows their number.
    Where these are too many for one task, rows are unpivoted and ranked by ranges, for one column of truths at a time (see wide_metrics for truths).
    """
    if items is not None and items * len(methods) > cells:
        if truths:
            from ..sources.tables import stored

            once, parts = stored(wide, "wide"), []
            for t in dict.fromkeys(truths.values()):
                own = once.where(F.col(t).isNotNull()).withColumn("truth", F.col(t))
                parts.append(protocol_wide(own, {m: c for m, c in methods.items() if truths[m] == t}, ks, least, live, items, digits, rho, cells, windows))
            return reduce(DataFrame.unionByName, parts)
        named = wide.select("window_id", "item_id", F.col("truth").cast("double").alias("truth"), *[c.cast("double").alias(n) for n, c in methods.items()])
        long = to_long(named, list(methods), ["window_id", "item_id", "truth"]).where("score is not null").withColumn("score", DIGITS[digits][1](F.col("score")))
        found = window_metrics(rank_large(long), ks)
    else:
        most = (items or 0) * windows * (len(wide.columns) + 2)
        found = wide_metrics(wide, methods, ks, digits, rho, min(most, windows * TASK_CELLS), truths)
    found = found.where(F.col("num_items") >= least)
    found = found if live is None else found.join(live, "window_id", "left_semi")
    return with_rsi(found, ks).drop(*[f"top_{k}" for k in ks])


def _inversions(y: np.ndarray) -> int:
    """Pairs out of order, by merging sorted runs."""
    total, width, n = 0, 1, len(y)
    y = y.copy()
    while width < n:
        for lo in range(0, n - width, 2 * width):
            left, right = y[lo : lo + width], y[lo + width : lo + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, "right")).sum())
            y[lo : lo + len(left) + len(right)] = np.sort(np.concatenate([left, right]), kind="stable")
        width *= 2
    return total


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Tie-aware tau-b in O(n log^2 n); null for fewer than two values or a range below 1e-12."""
    n = len(x)
    if n < 2 or np.ptp(x) < 1e-12 or np.ptp(y) < 1e-12:
        return None
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    tied = lambda v: int((c * (c - 1) // 2).sum()) if len(c := np.unique(v, return_counts=True)[1]) else 0
    both = np.unique(np.stack([x, y]), axis=1, return_counts=True)[1]
    pairs, tx, ty, txy = n * (n - 1) // 2, tied(x), tied(y), int((both * (both - 1) // 2).sum())
    swaps = _inversions(y)
    return (pairs - tx - ty + txy - 2 * swaps) / float(np.sqrt(float(pairs - tx)) * np.sqrt(float(pairs - ty)))


def kendall(scores: DataFrame, by: list[str] = BY) -> DataFrame:
    """kendall_tau of score and truth per group; one group is one window's items."""
    kinds = dict(scores.dtypes)

    def run(t: pa.Table) -> pa.Table:
        x, y = (t[c].to_numpy().astype(float) for c in ("key", "truth"))
        x = np.where(np.isfinite(x), x, -1e308)
        return pa.table([*(t[c].slice(0, 1) for c in by), pa.array([kendall_tau_b(x, y)], pa.float64())], names=[*by, "kendall_tau"])

    return scores.select(*by, rank_key().alias("key"), F.col("truth").cast("double")).groupBy(*by).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", kendall_tau double")


def blocks(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """by, p, q and their blocks _a and _b, of `block` rows or the square root of the group's."""
    sizes = rows.groupBy(*by).agg(F.greatest(F.lit(block), F.ceil(F.sqrt(F.count("*")))).alias("_block"))
    cut = lambda c: F.floor((F.col(c) - 1) / F.col("_block"))
    return rows.select(*by, F.col("p").cast("long"), F.col("q").cast("long")).join(sizes, by).withColumn("_a", cut("p")).withColumn("_b", cut("q")).drop("_block")


def inversions(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """by and swaps, the pairs with p rising and q falling, for places p and q from 1 that no two rows of a group share.

    Both places are cut into blocks. Pairs within a block of q, and pairs within a block of p but
    in different ones of q, are counted in tasks of at most a block's rows; pairs apart in both
    follow from the counts of the cells (block of p, block of q) by running totals. A block has
    `block` rows, or the square root of the group's where that is more, so that a group never
    has more cells than about its rows.
    """
    kinds = dict(rows.dtypes)
    placed = blocks(rows, by, block)

    def count(t: pa.Table) -> pa.Table:
        v = t["v"].to_numpy()[np.argsort(t["p"].to_numpy())]
        return pa.table([*(t[c].slice(0, 1) for c in by), pa.array([_inversions(v)], pa.int64())], names=[*by, "swaps"])

    # a block of q compares q itself, a block of p the blocks of q, so that no pair is seen twice
    split = placed.select(*by, "p", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_b").alias("at"), F.col("q").alias("v")), F.struct(F.lit(1).alias("side"), F.col("_a").alias("at"), F.col("_b").alias("v")))).alias("s")).select(*by, "p", "s.*")
    inside = split.groupBy(*by, "side", "at").applyInArrow(count, ", ".join(f"{c} {kinds[c]}" for c in by) + ", swaps long")
    cells = placed.groupBy(*by, "_a", "_b").agg(F.count("*").alias("_n"))
    last = placed.groupBy(*by).agg(F.max("_a").alias("_last"))
    # every cell of the grid: rows of earlier blocks of p by block of q, then of all later blocks of q
    grid = last.select(*by, "_last", F.explode(F.sequence(F.lit(0), "_last")).alias("_a")).select(*by, "_a", F.explode(F.sequence(F.lit(0), "_last")).alias("_b"))
    full = grid.join(cells, [*by, "_a", "_b"], "left").fillna(0, ["_n"])
    earlier = full.withColumn("_e", F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)))
    later = F.sum("_e").over(Window.partitionBy(*by, "_a").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    apart = earlier.withColumn("_over", later).select(*by, F.coalesce(F.col("_n") * F.col("_over"), F.lit(0)).alias("swaps"))
    return inside.unionByName(apart).groupBy(*by).agg(F.sum("swaps").alias("swaps"))


def kendall_large(scores: DataFrame, by: list[str] = BY, ranges: int = 200, block: int = 65536) -> DataFrame:
    """What kendall gives, for windows of any number of items: no task holds more than `block` rows of a window, or the square root of its rows.

    Swaps are inversions between places by (score, truth) and places by truth, both from places().
    Items of a window must differ. The cells of blocks are about as many as the rows at most.
    """
    rows = scores.select(*by, "item_id", rank_key().alias("key"), F.col("truth").cast("double").alias("truth"))
    rows = places(rows, by, [F.col("key"), F.col("truth"), F.col("item_id")], "p", ranges)
    rows = places(rows, by, [F.col("truth"), F.col("p")], "q", ranges)
    pairs = lambda n: n * (n - 1) / 2
    equal = rows.groupBy(*by, "key", "truth").agg(F.count("*").alias("_n"))
    out = inversions(rows, by, block)
    for name, columns in (("txy", ["key", "truth"]), ("tx", ["key"]), ("ty", ["truth"])):
        tied = equal.groupBy(*by, *columns).agg(F.sum("_n").alias("_n")).groupBy(*by).agg(F.sum(pairs(F.col("_n"))).alias(name))
        out = out.join(tied, by)
    finite = F.when(F.col("key") > float("-inf"), F.col("key")).otherwise(F.lit(-1e308))
    out = out.join(equal.groupBy(*by).agg(F.sum("_n").alias("_all"), (F.max(finite) - F.min(finite)).alias("_x"), (F.max("truth") - F.min("truth")).alias("_y")), by)
    n, flat = pairs(F.col("_all")), (F.col("_all") < 2) | (F.col("_x") < 1e-12) | (F.col("_y") < 1e-12)
    tau = (n - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("swaps")) / (F.sqrt(n - F.col("tx")) * F.sqrt(n - F.col("ty")))
    return out.select(*by, F.when(~flat, tau).alias("kendall_tau"))


METRICS = tuple(f"{m}_{k}" for m in ("ndcg", "coverage", "rsi") for k in KS) + ("mae", "spearman_rho")


def summarize(protocol_rows: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean and sample sd of each metric per method, first and last window, share of windows with tied scores."""
    return protocol_rows.groupBy("method").agg(
        F.count("*").alias("n_windows"), F.min("window_id").alias("first_window"), F.max("window_id").alias("last_window"),
        *[f(m).alias(f"{m}_{s}") for m in metrics for f, s in ((F.avg, "mean"), (F.stddev_samp, "sd"))],
        F.avg(F.col("ties_top21").cast("double")).alias("ties_top21_share"), F.sum("n_nonfinite").alias("n_nonfinite_total"),
    )


def mape(score: Column, truth: Column) -> Column:
    """Mean absolute percentage error; rows with truth 0 count as 0."""
    return F.avg(F.when(truth == 0, 0.0).otherwise(F.abs(score - truth) / truth)) * 100


def positional_order(scores: DataFrame, by: list[str] = BY) -> DataFrame:
    """The older order: an ascending sort read from its end, so equal scores rank by item downwards."""
    return scores.withColumn("key", rank_key()).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("key"), F.desc("item_id"))))
