"""Perturbed windows and what they do to ranks.

Random draws are hash orders of (seed, window, item): equal in distribution to a generator's,
the same on every run and independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wavelets as W
from ..functions.scorers import BASELINES, of_matrix
from .ranking import BY, TASK_CELLS, decimals, jaccard, rank_key
from .series import MATRIX, partitions

#: Spikes: size in means, age of the oldest slot they touch (1: the newest; None: drawn), slots.
SPIKES = {f"size{s}": (s, 1, 1) for s in (2, 5, 10, 20, 50)} | {"pos_middle": (10, 32, 1), "pos_first": (10, 64, 1), "pos_random": (10, None, 1), "dur3": (10, 1, 3), "dur6": (10, 1, 6)}
#: Noise on all items: kind, signal-to-noise ratio in decibels.
NOISES = {"noise_poisson": ("poisson", 0.0), "noise_gauss_snr10": ("gauss", 10.0), "noise_gauss_snr0": ("gauss", 0.0)}


def draw_order(seed: int, *names: str) -> list[Column]:
    """A fixed arithmetic hash of the window and the item's text: order by it, then by item."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(n).cast("string") for n in names])), 1, 12), 16, 10).cast("long")
    return [number, F.col(names[-1])]


def low_activity_targets(frames: DataFrame, x: str = "x_w", n: int = 50, seed: int = 42) -> DataFrame:
    """(window_id, item_id) to perturb: all of a small window, else at most n non-zero items of mean at or below the median of these."""
    w = Window.partitionBy("window_id")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    rows = frames.select("window_id", "item_id", mean.alias("m")).withColumn("n_all", F.count("*").over(w)).withColumn("n_some", F.sum((F.col("m") > 0).cast("int")).over(w))
    half = frames.select("window_id", mean.alias("m")).where("m > 0").groupBy("window_id").agg(F.percentile("m", F.lit(0.5)).alias("half"))
    rows = rows.join(half, "window_id", "left")
    pool = F.when(F.col("n_all") < n, F.lit(True)).when(F.col("n_some") < n, F.col("m") > 0).otherwise((F.col("m") > 0) & (F.col("m") <= F.col("half")))
    nth = F.row_number().over(w.orderBy(*draw_order(seed, "window_id", "item_id")))
    return rows.where(pool).withColumn("nth", nth).where(F.col("nth") <= n).select("window_id", "item_id")


def seeded_targets(frames: DataFrame, seeds: tuple[int, ...], x: str = "x_w", n: int = 50) -> DataFrame:
    """low_activity_targets of every seed (window_id, item_id, seed), from one reading of the windows."""
    rows = frames.select("window_id", "item_id", (F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)).alias("m"))
    some = F.when(F.col("m") > 0, F.col("m"))
    facts = rows.groupBy("window_id").agg(F.count("*").alias("n_all"), F.count(some).alias("n_some"), F.percentile(some, F.lit(0.5)).alias("half"))
    pool = F.when(F.col("n_all") < n, F.lit(True)).when(F.col("n_some") < n, F.col("m") > 0).otherwise((F.col("m") > 0) & (F.col("m") <= F.col("half")))
    each = rows.join(facts, "window_id").where(pool).select("window_id", "item_id", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("seed", "window_id", "item_id")])), 1, 12), 16, 10).cast("long")
    nth = F.row_number().over(Window.partitionBy("window_id", "seed").orderBy(number, "item_id"))
    return each.withColumn("nth", nth).where(F.col("nth") <= n).select("window_id", "item_id", "seed")


def common_targets(frames_by_method: list[DataFrame], x: str = "x_w", n: int = 50, seed: int = 42) -> DataFrame:
    """Targets that every configuration can score: drawn from the items eligible in all of them."""
    pool = frames_by_method[0]
    for other in frames_by_method[1:]:
        pool = pool.join(other.select("window_id", "item_id"), ["window_id", "item_id"], "left_semi")
    return low_activity_targets(pool, x, n, seed)


def spiked(x: Column, size: float = 10.0, age: Column | int = 1, duration: int = 1) -> Column:
    """x with max(size * mean, 1) added to `duration` slots, the oldest of them max(age, duration) slots from the end (1: the newest)."""
    n = F.size(x)
    high = F.greatest(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n * size, F.lit(1.0))
    first = n - F.least(F.greatest(F.lit(age) if isinstance(age, int) else age, F.lit(duration)), n)
    return F.transform(x, lambda v, i: F.when((i >= first) & (i < first + duration), v + high).otherwise(v))


def spiked_rows(targets: DataFrame, spikes: dict[str, tuple], x: str = "x_w") -> DataFrame:
    """A row with a spiked window for each target and condition, named in `condition`; all conditions in one pass."""
    drawn = F.pmod(F.xxhash64(F.lit(5), *[F.col(c) for c in ("seed", "window_id", "item_id") if c in targets.columns]), F.size(x)).cast("int") + 1
    each = F.array(*[F.struct(F.lit(n).alias("condition"), spiked(F.col(x), float(s), drawn if a is None else a, d).alias("spiked")) for n, (s, a, d) in spikes.items()])
    rest = [c for c in targets.columns if c != x]
    return targets.select(*rest, F.explode(each).alias("s")).select(*rest, F.col("s.condition").alias("condition"), F.col("s.spiked").alias(x))


def _mixed(keys: np.ndarray) -> np.ndarray:
    """Every bit of 64 depends on all."""
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            keys = (keys ^ (keys >> np.uint64(shift))) * np.uint64(factor)
    return keys ^ (keys >> np.uint64(31))


def _uniform(seeds: np.ndarray, stream: int) -> np.ndarray:
    """Uniform in (0, 1) from a number for each cell and the number of a draw."""
    with np.errstate(over="ignore"):
        bits = _mixed(_mixed(seeds + np.uint64(stream)) + np.uint64(0x9E3779B97F4A7C15))
    return ((bits >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _poisson(mean: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Poisson counts by inversion; large means are sums of draws of at most 500 each."""
    total, stream = np.zeros(len(mean)), 0
    left = mean.copy()
    while (left > 0).any():
        part = np.minimum(left, 500.0)
        u, k = _uniform(seeds, stream), np.zeros(len(mean))
        chance = np.exp(-part)
        upto = chance.copy()
        more = np.flatnonzero((u > upto) & (part > 0))
        while len(more):
            k[more] += 1
            chance[more] *= part[more] / k[more]
            upto[more] += chance[more]
            more = more[(u[more] > upto[more]) & (chance[more] > 0)]
        total, left, stream = total + k, left - part, stream + 1
    return total


def noisy(frames: DataFrame, x: str = "x_w", kind: str = "poisson", snr_db: float = 10.0, seed: int = 42) -> DataFrame:
    """Windows with noise: counts redrawn as Poisson, or Gaussian noise at a signal-to-noise ratio, held at zero or more.

    Draws are hashes of (seed, window, item, slot in the window), so all methods see the same noise.
    """
    keyed = frames.withColumn("_seed", F.xxhash64(F.lit(seed), "window_id", "item_id"))
    names = keyed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[x]
            starts = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
            v = _noised(np.asarray(lists.flatten(), float), np.diff(starts), batch["_seed"].to_numpy().view(np.uint64), kind, snr_db)
            made = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(v))
            yield pa.RecordBatch.from_arrays([made if c == x else batch[c] for c in names if c != "_seed"], names=[c for c in names if c != "_seed"])

    return keyed.mapInArrow(run, frames.schema)


def _noised(v: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, kind: str, snr_db: float) -> np.ndarray:
    """Values of windows of the given sizes, one after the other, with noise drawn by a number for each window."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    with np.errstate(over="ignore"):
        cells = seeds[row] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    if kind == "poisson":
        return _poisson(np.maximum(v, 0), cells)
    power = np.bincount(row, v * v, len(sizes)) / np.maximum(sizes, 1)
    normal = np.sqrt(-2 * np.log(_uniform(cells, 0))) * np.cos(2 * np.pi * _uniform(cells, 1))
    return np.maximum(v + normal * np.sqrt(power / 10 ** (snr_db / 10))[row], 0)


def _keys(score: np.ndarray) -> np.ndarray:
    """Non-finite scores rank last."""
    return np.where(np.isfinite(score), score, -np.inf)


def _ahead(key: np.ndarray, place: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each (value, at): how many of `key` are larger, or equal and of a smaller place. No sort of `key`."""
    distinct = np.unique(value)
    bucket = np.searchsorted(distinct, key)
    upto = np.cumsum(np.bincount(bucket, minlength=len(distinct) + 1))
    mine = np.searchsorted(distinct, value)
    equal = np.flatnonzero(distinct[np.minimum(bucket, len(distinct) - 1)] == key)
    codes = np.sort(bucket[equal].astype(np.int64) * (len(key) + 1) + place[equal])
    below = np.searchsorted(codes, mine.astype(np.int64) * (len(key) + 1) + at) - np.searchsorted(codes, mine.astype(np.int64) * (len(key) + 1))
    return len(key) - upto[mine] + below


def _top(key: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The k first by key down, place up."""
    k = min(k, len(key))
    near = np.flatnonzero(key >= np.partition(key, len(key) - k)[len(key) - k])
    return near[np.lexsort((place[near], -key[near]))][:k]


def _places(items: pa.ChunkedArray) -> np.ndarray:
    out = np.empty(len(items), np.int64)
    out[pc.sort_indices(items).to_numpy()] = np.arange(len(items))
    return out


def _by_window(windows: DataFrame, targets: DataFrame, work, schema: str, cells: int) -> DataFrame:
    """work on the rows of each window of both sides; partitions follow `cells`, the number of values of the larger side."""
    n = partitions(windows, -(-cells // TASK_CELLS))
    left, right = (d.repartition(n, "window_id").groupBy("window_id") for d in (windows, targets))
    return left.cogroup(right).applyInArrow(work, schema)


def moved_ranks(scores: DataFrame, changed: DataFrame, names: list[str], cells: int = 0) -> DataFrame:
    """What replaced_ranks gives for several methods, from a column of scores for each: window_id, method, item_id, rank_before, rank_after.

    A window's scores are held by one task; only places of the changed items are counted.
    """

    def run(t: pa.Table, c: pa.Table) -> pa.Table:
        place = _places(t["item_id"])
        at = pc.index_in(c["item_id"].combine_chunks(), t["item_id"].combine_chunks()).to_numpy()
        out = []
        for name in names if len(c) else []:
            key, new = _keys(t[name].to_numpy()), _keys(c[name].to_numpy())
            before = 1 + _ahead(key, place, key[at], place[at])
            after = 1 + _ahead(key, place, new, place[at]) - (key[at] > new)
            out.append(pa.table([c["window_id"], pa.array([name] * len(c)), c["item_id"], pa.array(before), pa.array(after)], names=kinds))
        return pa.concat_tables(out) if out else pa.table([pa.array([], k) for k in (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())], names=kinds)

    kinds = ["window_id", "method", "item_id", "rank_before", "rank_after"]
    return _by_window(scores, changed, run, "window_id int, method string, item_id string, rank_before long, rank_after long", cells)


#: The methods of the robustness study: baselines over 7 and 64 slots, and three of the transforms.
ROBUST = (*(f"{s.name}@{n}" for s in BASELINES for n in (7, 64)), "WSPI@64", "DTCWT+AF@64", "DWT+AF@64")


def robust_scores(m: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of ROBUST for windows of one size as the rows of a matrix, and mu_l and the exponent of the index."""
    plain = {n: of_matrix(m[:, -n:], n) for n in (7, 64)}
    whole = W.pad_left(m[:, -64:], 64, "reflect")
    dt, dw = W.features(whole), W.features(whole, 3, "dwt")
    power = dt["r"] - dt["w_e"]
    out = {f"{s.name}@{n}": plain[n][s.name] for s in BASELINES for n in (7, 64)}
    return out | {"WSPI@64": dt["mu_l"] * np.exp(power), "DTCWT+AF@64": dt["af"], "DWT+AF@64": dw["af"], "mu": dt["mu_l"], "power": power}


def robust_windows(pool: DataFrame, after: DataFrame, seeds: tuple[int, ...], noises: dict[str, tuple[str, float]], cells: int = 0, x: str = "x_w", k: int = 10) -> DataFrame:
    """Rows (window_id, method, seed, condition, item_id, rank_before, rank_after) of targets, and with item_id null top10, the overlap of the top k with that under noise.

    after holds the targets with their scores under the other conditions (item_id, seed, condition, a
    column for each of ROBUST). A task takes one window: noise is drawn, scored and dropped, a
    condition and seed after the other, and only the targets' places are counted; nothing is sorted whole.
    """
    keyed = pool.select("window_id", "item_id", x, *[F.xxhash64(F.lit(s), "window_id", "item_id").alias(f"_seed{s}") for s in seeds])
    fields = {"window_id": pa.int32(), "method": pa.string(), "seed": pa.int32(), "condition": pa.string(), "item_id": pa.string(), "rank_before": pa.int64(), "rank_after": pa.int64(), "top10": pa.float64()}

    def scored(m: np.ndarray, kind: str | None = None, snr: float = 0.0, drawn: np.ndarray | None = None) -> dict[str, np.ndarray]:
        out = {name: np.empty(len(m)) for name in ROBUST}
        for lo in range(0, len(m), MATRIX):
            some = m[lo : lo + MATRIX]
            if kind:
                some = _noised(some.ravel(), np.full(len(some), m.shape[1]), drawn[lo : lo + MATRIX], kind, snr).reshape(some.shape)
            made = robust_scores(some)
            for name in ROBUST:
                out[name][lo : lo + MATRIX] = _keys(decimals(made[name]))
        return out

    def run(t: pa.Table, c: pa.Table) -> pa.Table:
        parts = []

        def put(method: str, rows: pa.Table | None, seed, condition, **more) -> None:
            n = 1 if rows is None else len(rows)
            made = {"window_id": pa.array([window] * n, pa.int32()), "method": pa.array([method] * n), "seed": seed, "condition": condition} | more
            parts.append(pa.table([made.get(f, pa.nulls(n, kind)) for f, kind in fields.items()], schema=pa.schema(list(fields.items()))))

        if len(t) and len(c):
            window, items = t["window_id"][0].as_py(), t["item_id"].combine_chunks()
            m = t[x].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
            place, clean = _places(t["item_id"]), scored(m)
            at = pc.index_in(c["item_id"].combine_chunks(), items).to_numpy()
            tops = {name: _top(clean[name], place, k) for name in ROBUST}
            for name in ROBUST:
                key, new = clean[name], _keys(decimals(c[name].to_numpy()))
                before, later = 1 + _ahead(key, place, key[at], place[at]), 1 + _ahead(key, place, new, place[at]) - (key[at] > new)
                put(name, c, c["seed"], c["condition"], item_id=c["item_id"], rank_before=pa.array(before), rank_after=pa.array(later))
            targets = {s: np.unique(at[c["seed"].to_numpy() == s]) for s in seeds}
            for condition, (kind, snr) in noises.items():
                for s in seeds:
                    noised, mine = scored(m, kind, snr, t[f"_seed{s}"].to_numpy().view(np.uint64)), targets[s]
                    for name in ROBUST:
                        same = lambda n: {"seed": pa.array([s] * n, pa.int32()), "condition": pa.array([condition] * n)}  # noqa: E731, B023
                        before, later = (1 + _ahead(d[name], place, d[name][mine], place[mine]) for d in (clean, noised))
                        rows = items.take(pa.array(mine))
                        put(name, rows, **same(len(rows)), item_id=rows, rank_before=pa.array(before), rank_after=pa.array(later))
                        both = len(np.intersect1d(tops[name], _top(noised[name], place, k)))
                        put(name, None, **same(1), top10=pa.array([both / (2 * len(tops[name]) - both)]))
        return pa.concat_tables(parts) if parts else pa.schema(list(fields.items())).empty_table()

    return _by_window(keyed, after, run, "window_id int, method string, seed int, condition string, item_id string, rank_before long, rank_after long, top10 double", cells)


def replaced_ranks(scores: DataFrame, changed: DataFrame, by: list[str] = BY) -> DataFrame:
    """changed (by..., item_id, new_score, further columns) with rank_before and rank_after when only this score is replaced.

    One sort of a window's scores and new scores together: the scores before a new one are
    counted, its own among them taken off. A new score goes before an equal one of its item.
    """
    keyed = scores.select(*by, "item_id", rank_key().alias("key"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("key"), "item_id"))
    own = keyed.withColumn("rank_before", first)
    more = [c for c in changed.columns if c not in (*by, "item_id", "new_score")]
    new = changed.withColumn("_new", rank_key("new_score")).join(own, [*by, "item_id"])
    both = new.select(*by, "item_id", F.col("_new").alias("_k"), F.lit(0).alias("_peer"), F.col("key").alias("_own"), "rank_before", "new_score", *more)
    empty = {c: t for c, t in both.dtypes}
    peers = keyed.select(*by, "item_id", F.col("key").alias("_k"), F.lit(1).alias("_peer"), *[F.lit(None).cast(empty[c]).alias(c) for c in ("_own", "rank_before", "new_score", *more)])
    before = Window.partitionBy(*by).orderBy(F.desc("_k"), "item_id", "_peer").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_peer").over(before), F.lit(0)) - (F.col("_own") > F.col("_k")).cast("long")
    return both.unionByName(peers).withColumn("rank_after", 1 + ahead).where("_peer = 0").drop("_k", "_peer", "_own")


def count_distortion(scores: DataFrame, changed: DataFrame, by: list[str] = BY) -> DataFrame:
    """Mean change of the number of higher scores, the new score against the clean ones; equal scores are not higher.

    Scores and new scores are sorted together, and those of a larger value counted.
    """
    keyed = scores.select(*by, "item_id", rank_key().alias("_k"))
    new = changed.select(*by, "item_id", rank_key("new_score").alias("_k"), F.lit(0).alias("_peer"))
    higher = Window.partitionBy(*by).orderBy(F.desc("_k")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy(*by, "_k")
    both = keyed.withColumn("_peer", F.lit(1)).unionByName(new)
    ranked = both.withColumn("above", F.sum("_peer").over(higher) - F.sum("_peer").over(equal))
    old = ranked.where("_peer = 1").select(*by, "item_id", F.col("above").alias("old"))
    after = ranked.where("_peer = 0").select(*by, "item_id", "above")
    return after.join(old, [*by, "item_id"]).groupBy(*by).agg(F.avg(F.abs(F.col("old") - F.col("above"))).alias("distortion"), F.count("*").alias("n_targets"))


def rank_distortion(ranks: DataFrame, by: list[str] = BY) -> DataFrame:
    """Mean |change|, mean signed change and share of targets that rise, per window and method."""
    change = F.col("rank_before") - F.col("rank_after")
    return ranks.groupBy(*by).agg(F.avg(F.abs(change)).alias("distortion"), F.avg(change).alias("signed"), F.avg((change > 0).cast("double")).alias("up_share"), F.count("*").alias("n_targets"))


def top_overlap(before: DataFrame, after: DataFrame, by: list[str] = BY, k: int = 10) -> DataFrame:
    """Jaccard overlap of the top-k sets of two rankings (rows with rank)."""
    tops = lambda d, name: d.where(F.col("rank") <= k).groupBy(*by).agg(F.collect_set("item_id").alias(name))
    return tops(before, "a").join(tops(after, "b"), by).select(*by, jaccard(F.col("a"), F.col("b")).alias("overlap"))


def target_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per window: overlap of two target choices."""
    sets = lambda d, name: d.groupBy("window_id").agg(F.collect_set("item_id").alias(name))
    return sets(a, "a").join(sets(b, "b"), "window_id").select("window_id", jaccard(F.col("a"), F.col("b")).alias("overlap"), F.size("a").alias("n_a"), F.size("b").alias("n_b"))


def seeded_overlap(before: DataFrame, after: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """Overlap of the top k before (by window and method) with those after, for each seed."""
    old = before.where(F.col("rank") <= k).groupBy("window_id", "method").agg(F.collect_set("item_id").alias("a"))
    new = after.where(F.col("rank") <= k).groupBy(*by).agg(F.collect_set("item_id").alias("b"))
    return new.join(old, ["window_id", "method"]).select(*by, jaccard(F.col("a"), F.col("b")).alias("top10"))


def trend_shift(clean: DataFrame, after: DataFrame) -> DataFrame:
    """Per condition: mean change of log mu and of the exponent (mu, power) of the targets; targets without a finite logarithm are left out."""
    both = after.select("window_id", "item_id", "seed", "condition", F.col("mu").alias("m1"), F.col("power").alias("p1")).join(clean.select("window_id", "item_id", F.col("mu").alias("m0"), F.col("power").alias("p0")), ["window_id", "item_id"])
    fine = (F.col("m0") > 0) & (F.col("m1") > 0)
    return both.groupBy("condition").agg(F.avg(F.when(fine, F.ln(F.when(F.col("m1") > 0, F.col("m1"))) - F.ln(F.when(F.col("m0") > 0, F.col("m0"))))).alias("dlogmu"), F.avg(F.when(fine, F.col("p1") - F.col("p0"))).alias("dpower"))


def seed_table(ranks: DataFrame) -> DataFrame:
    """Per method, condition and seed: windows, and the mean over windows of the targets' |change of rank|."""
    per = ranks.groupBy("window_id", "method", "condition", "seed").agg(F.avg(F.abs(F.col("rank_before") - F.col("rank_after"))).alias("d"))
    return per.groupBy("method", "condition", "seed").agg(F.count("*").alias("n_windows"), F.avg("d").alias("distortion"))


def condition_summary(ranks: DataFrame, tops: DataFrame, shift: DataFrame) -> DataFrame:
    """Per method and condition: mean |change| and signed change (seeds averaged within windows), share that rises, sd over windows, spread over seeds, top-10 overlap, and for the index the change of its parts."""
    change = F.col("rank_before") - F.col("rank_after")
    per = ranks.groupBy("window_id", "method", "condition", "seed").agg(F.avg(F.abs(change)).alias("d"), F.avg(change).alias("s"), F.avg((change > 0).cast("double")).alias("u"))
    per = per.groupBy("window_id", "method", "condition").agg(*[F.avg(c).alias(c) for c in "dsu"])
    out = per.groupBy("method", "condition").agg(F.count("*").alias("n_windows"), F.avg("d").alias("distortion"), F.stddev_samp("d").alias("distortion_sd"), F.avg("s").alias("signed"), F.avg("u").alias("up_share"))
    seeds = seed_table(ranks).groupBy("method", "condition").agg(F.min("distortion").alias("seed_min"), F.max("distortion").alias("seed_max"), F.stddev_samp("distortion").alias("seed_sd"))
    over = tops.groupBy("method", "condition").agg(F.avg("top10").alias("top10"))
    parts = shift.withColumn("method", F.lit("WSPI@64"))
    return out.join(seeds, ["method", "condition"]).join(over, ["method", "condition"], "left").join(parts, ["method", "condition"], "left")


def rank_check(means: DataFrame) -> DataFrame:
    """Ranks of the methods (equal means share the lower one) by own and by common targets."""
    place = lambda c: F.rank().over(Window.partitionBy().orderBy(c))
    return means.withColumn("own_rank", place("own_mean")).withColumn("common_rank", place("common_mean"))
