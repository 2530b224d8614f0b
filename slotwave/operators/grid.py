"""From sparse demand rows to the dense slot grid, and to causal trailing windows.

Demand: timestamp, item_id (string), count. Window k sees the slots before k only; its truth
is the sum of slots k to k + horizon - 1. Window arrays are built, scored and dropped in one
stage; what is shuffled afterwards is light.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection


def infer_slot_minutes(demand: DataFrame) -> DataFrame:
    """One row, slot_minutes: the median step of the distinct timestamps, rounded half to even."""
    steps = demand.select("timestamp").distinct().select((F.unix_seconds(F.col("timestamp").cast("timestamp")) - F.lag(F.unix_seconds(F.col("timestamp").cast("timestamp"))).over(Window.orderBy("timestamp"))).alias("s"))
    return steps.agg(F.bround(F.percentile("s", F.lit(0.5)) / 60).cast("long").alias("slot_minutes")).select(F.when(F.col("slot_minutes") > 0, F.col("slot_minutes")).otherwise(F.raise_error(F.lit("slots are shorter than a minute or there is one timestamp only"))).alias("slot_minutes"))


def infer_grid(demand: DataFrame, slot_seconds: int | None = None) -> DataFrame:
    """One row: t0, slot_seconds, n_slots (the last slot's number)."""
    slot = demand.sparkSession.range(1).select(F.lit(slot_seconds).cast("long").alias("slot_seconds")) if slot_seconds else infer_slot_minutes(demand).select((F.col("slot_minutes") * 60).alias("slot_seconds"))
    span = demand.agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    seconds = F.unix_seconds(F.col("t1").cast("timestamp")) - F.unix_seconds(F.col("t0").cast("timestamp"))
    return span.crossJoin(F.broadcast(slot)).select("t0", "slot_seconds", F.floor(seconds / F.col("slot_seconds")).cast("int").alias("n_slots"))


def with_slot(demand: DataFrame, grid: DataFrame) -> DataFrame:
    """demand with slot; a timestamp off the grid raises an error. grid is one row."""
    since = F.unix_seconds(F.col("timestamp").cast("timestamp")) - F.unix_seconds(F.col("t0").cast("timestamp"))
    slot = F.when(since % F.col("slot_seconds") == 0, since / F.col("slot_seconds")).otherwise(F.raise_error(F.lit("timestamp off the slot grid")))
    return demand.crossJoin(F.broadcast(grid)).withColumn("slot", slot.cast("int")).drop("t0", "slot_seconds", "n_slots")


def duplicate_rows(demand: DataFrame) -> DataFrame:
    """(timestamp, item_id, n) that occur more than once; a grid needs none."""
    return demand.groupBy("timestamp", "item_id").agg(F.count("*").alias("n")).where("n > 1")


def densify(demand: DataFrame, grid: DataFrame) -> DataFrame:
    """item_id, slot, v, present: every item in every slot, zero where there is no row. Two rows of one item and slot raise an error."""
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("several rows of one item and slot"))).otherwise(F.sum("count"))
    seen = with_slot(demand, grid).groupBy("item_id", "slot").agg(one.cast("double").alias("v"))
    slots = demand.select("item_id").distinct().crossJoin(F.broadcast(grid)).select("item_id", F.explode(F.sequence(F.lit(0), F.col("n_slots"))).alias("slot"))
    return slots.join(seen, ["item_id", "slot"], "left").select("item_id", "slot", F.coalesce("v", F.lit(0.0)).alias("v"), F.col("v").isNotNull().cast("int").alias("present"))


def whole_file_catalogue(demand: DataFrame, min_total: int) -> DataFrame:
    """Rows of the items whose total count is at least min_total."""
    keep = demand.groupBy("item_id").agg(F.sum("count").alias("total")).where(F.col("total") >= min_total).select("item_id")
    return demand.join(keep, "item_id", "left_semi")


def select_items(demand: DataFrame, n: int, how: str = "top", seed: int = 42) -> DataFrame:
    """n items: the largest totals, a hash-ordered draw, or a draw proportional by stratum (see strata)."""
    totals = demand.groupBy("item_id").agg(F.sum("count").alias("total"), F.avg("count").alias("mean"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "item_id")), 1, 12), 16, 10).cast("long")
    by = {"top": [F.desc("total"), F.col("item_id")], "random": [draw, F.col("item_id")]}
    if how in by:
        return totals.orderBy(*by[how]).limit(n).select("item_id")
    labelled = totals.crossJoin(F.broadcast(selection.cuts(totals, "mean", (0.25, 0.5, 0.9)))).crossJoin(F.broadcast(totals.agg(F.count("*").alias("all")))).withColumn("stratum", F.when(F.col("mean") < F.col("q")[0], 0).when(F.col("mean") < F.col("q")[1], 1).when(F.col("mean") < F.col("q")[2], 2).otherwise(3))
    in_stratum = Window.partitionBy("stratum")
    drawn = labelled.withColumn("nth", F.row_number().over(in_stratum.orderBy(draw, "item_id"))).withColumn("quota", F.floor(F.count("*").over(in_stratum) * n / F.col("all")))
    # quotas first, then fill up by hash order
    return drawn.orderBy((F.col("nth") > F.col("quota")).cast("int"), draw, "item_id").limit(n).select("item_id")


def _chunked(dense: DataFrame, before: int, after: int, chunk: int) -> tuple[DataFrame, Window]:
    """Rows by (item, chunk of slots) with the neighbours' rows that its windows need."""
    own = F.floor(F.col("slot") / chunk).cast("int")
    place = F.col("slot") % chunk
    back, ahead = -(-before // chunk), -(-after // chunk)
    to = [F.when(place + before >= chunk * k, own + k) for k in range(1, back + 1)] + [F.when(place - after < -chunk * (k - 1), own - k) for k in range(1, ahead + 1)]
    rows = dense.withColumn("chunk", F.explode(F.array_compact(F.array(own, *to)))).withColumn("halo", F.col("chunk") != own)
    return rows, Window.partitionBy("item_id", "chunk").orderBy("slot")


def _series(dense: DataFrame, back: int, ahead: int, chunk: int | None) -> tuple[DataFrame, Window, Column]:
    """Rows with halo (a neighbour's row, to be dropped), their window specification, and the item's total before a slot."""
    if chunk is None:
        w = Window.partitionBy("item_id").orderBy("slot")
        return dense.withColumn("halo", F.lit(False)), w, F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = dense.groupBy("item_id", F.floor(F.col("slot") / chunk).cast("int").alias("chunk")).agg(F.sum("v").alias("s"))
    sums = sums.select("item_id", "chunk", F.coalesce(F.sum("s").over(Window.partitionBy("item_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("earlier"))
    rows, w = _chunked(dense, back, ahead, chunk)
    own = F.sum(F.when(~F.col("halo"), F.col("v"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(sums, ["item_id", "chunk"]), w, F.col("earlier") + F.coalesce(own, F.lit(0.0))


def chunk_for(n_slots: int, longest: int, limit: int) -> int | None:
    """Slots of a piece of a series of more than `limit` slots: the limit, but no less than four of the longest windows. None for shorter ones."""
    return max(limit, 4 * longest) if n_slots > limit else None


def frames(dense: DataFrame, windows: dict[str, int], horizon: int = 1, chunk: int | None = None) -> DataFrame:
    """Rows (window_id, item_id, present, before, truth, last_slot) with x_<name> and observed_<name> for each window length.

    before is the item's total in all earlier slots, truth its total in the next `horizon`
    slots, last_slot the last slot of the item's grid. With `chunk`, a long series is cut into
    pieces of so many slots that are worked on in parallel.
    """
    rows, w, before = _series(dense, max(windows.values()), horizon - 1, chunk)
    columns: list[Column] = []
    for name, n in windows.items():
        frame = w.rowsBetween(-n, -1)
        columns += [F.collect_list("v").over(frame).alias(f"x_{name}"), F.coalesce(F.sum("present").over(frame), F.lit(0)).alias(f"observed_{name}")]
    out = rows.select(F.col("slot").alias("window_id"), "item_id", "present", "halo", before.alias("before"), F.sum("v").over(w.rowsBetween(0, horizon - 1)).alias("truth"), F.max("slot").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("chunk_end"), *columns)
    return out.where(~F.col("halo")).drop("halo", "chunk_end")


def present_frames(dense: DataFrame, window: int, horizon: int = 1) -> DataFrame:
    """The older windows: of the window - 1 slots before a slot only those with a row, gaps skipped. Columns as in frames, named w."""
    w = Window.partitionBy("item_id").orderBy("slot")
    rows = dense.withColumn("held", F.when(F.col("present") == 1, F.col("v")))
    past = w.rowsBetween(-(window - 1), -1)
    return rows.select(F.col("slot").alias("window_id"), "item_id", "present", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"), F.sum("v").over(w.rowsBetween(0, horizon - 1)).alias("truth"), F.collect_list("held").over(past).alias("x_w"), F.coalesce(F.sum("present").over(past), F.lit(0)).alias("observed_w"))


def in_time(df: DataFrame, grid: DataFrame, horizon: int) -> DataFrame:
    """Windows whose whole future of `horizon` slots lies on the grid."""
    return df.crossJoin(F.broadcast(grid.select("n_slots"))).where(F.col("window_id") + horizon - 1 <= F.col("n_slots")).drop("n_slots")


def eligible(name: str, min_obs: int, min_total: int, causal: bool = True) -> Column:
    """Row-level rule: a slot before the window, enough observed slots in it, and enough requests before it. Arrays are not read."""
    rule = (F.col("window_id") > 0) & (F.col(f"observed_{name}") >= min_obs)
    return rule & (F.col("before") >= min_total) if causal else rule


def spans(dense: DataFrame, grid: DataFrame, lengths: tuple[int, ...], horizons: tuple[int, ...] = (1,), chunk: int | None = None) -> DataFrame:
    """Rows (window_id, item_id, before, x, observed_<length>, truth_<horizon>) of every length and horizon from one exchange of the slots.

    x holds the newest max(lengths) slots, of which shorter windows are slices; a truth whose
    future leaves the grid is null. The first slot, and slots without any row of the catalogue, are left out.
    With `chunk`, long series are worked on in pieces, as in frames.
    """
    series, w, before = _series(dense, max(lengths), max(horizons) - 1, chunk)
    seen = [F.coalesce(F.sum("present").over(w.rowsBetween(-n, -1)), F.lit(0)).alias(f"observed_{n}") for n in lengths]
    ahead = [F.sum("v").over(w.rowsBetween(0, h - 1)).alias(f"t_{h}") for h in horizons]
    rows = series.select(F.col("slot").alias("window_id"), "item_id", "halo", before.alias("before"), F.collect_list("v").over(w.rowsBetween(-max(lengths), -1)).alias("x"), *seen, *ahead)
    truths = [F.when(F.col("window_id") + h - 1 <= F.col("n_slots"), F.col(f"t_{h}")).alias(f"truth_{h}") for h in horizons]
    live = dense.groupBy(F.col("slot").alias("window_id")).agg(F.max("present").alias("any")).where("any = 1").select("window_id")
    kept = rows.where("window_id > 0 and not halo").join(live, "window_id", "left_semi").crossJoin(F.broadcast(grid.select("n_slots")))
    return kept.select("window_id", "item_id", "before", "x", *[f"observed_{n}" for n in lengths], *truths)


def newest(x: str, n: int) -> Column:
    """The last n values of an array, or all of a shorter one; x is not empty."""
    k = F.least(F.lit(n), F.size(x))
    return F.slice(x, -k, k)


def valid_windows(rows: DataFrame, dense: DataFrame, keys: list[str]) -> DataFrame:
    """Semi-filter: the slot holds any row of the catalogue and at least two items are eligible."""
    live = dense.groupBy(F.col("slot").alias("window_id")).agg(F.max("present").alias("any")).where("any = 1").select("window_id")
    enough = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 2").select(*keys)
    return rows.join(live, "window_id", "left_semi").join(enough, keys, "left_semi")


def first_window(rows: DataFrame, first: int) -> DataFrame:
    """Rows of the windows from `first` on."""
    return rows.where(F.col("window_id") >= first)


def strided(rows: DataFrame, step: int) -> DataFrame:
    """Rows of every step-th window."""
    return rows.where(F.col("window_id") % step == 0)


def common_windows(protocol: DataFrame) -> DataFrame:
    """Rows of the windows that every method has."""
    methods = protocol.select("method").distinct().agg(F.count("*").alias("m"))
    ids = protocol.groupBy("window_id").agg(F.count_distinct("method").alias("n")).crossJoin(F.broadcast(methods)).where("n = m").select("window_id")
    return protocol.join(ids, "window_id", "left_semi")


def time_split(ids: DataFrame, share: float = 0.3) -> DataFrame:
    """window_id, part: the first floor(share n) windows tune, the rest test."""
    order = Window.orderBy("window_id")
    distinct = ids.select("window_id").distinct().withColumn("nth", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy()))
    return distinct.select("window_id", F.when(F.col("nth") <= F.floor(F.col("n") * F.lit(share)), "tune").otherwise("test").alias("part"))


PADS = ("reflect", "symmetric", "edge", "zero", "periodic")


def power_of_two(n: Column, level: int) -> Column:
    """The least power of two that holds n values and bears a decomposition to `level`."""
    return F.greatest(F.lit(2 ** (level + 1)), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(2))))).cast("int"))


def pad_left(x: Column, target: int | Column, how: str = "reflect") -> Column:
    """x with values in front up to `target` ones, by the named extension."""
    n = F.size(x)
    k = F.lit(target) - n
    at = F.sequence(-k, F.lit(-1))  # places before the first

    def value(i: Column) -> Column:
        if how == "zero":
            return F.lit(0.0)
        if how == "edge":
            place = F.lit(0)
        elif how == "periodic":
            place = F.pmod(i, n)
        elif how == "symmetric":
            m = F.pmod(i, 2 * n)
            place = F.least(m, 2 * n - 1 - m)
        elif how == "reflect":
            period = F.greatest(2 * n - 2, F.lit(1))
            m = F.pmod(i, period)
            place = F.when(n == 1, 0).otherwise(F.least(m, period - m))
        else:
            raise ValueError(how)
        return F.element_at(x, (place + 1).cast("int"))

    return F.when(k > 0, F.concat(F.transform(at, value), x)).otherwise(x)


def window_limits(level: int, transform: str = "dtcwt") -> dict[str, int]:
    """Smallest, recommended and largest sensible window for a decomposition level."""
    if level < 1:
        raise ValueError("level must be at least 1")
    least = 2 ** (level + 2) if transform == "dtcwt" else 2 ** (level + 1)
    return {"min": least, "recommended": 2 * least, "max": 32 * least}


def level_for(length: Column, level: int, taps: int = 8) -> Column:
    """The deepest level up to `level` that a window of so many slots bears for a filter of so many taps, at least 1."""
    return F.when(length >= taps, F.greatest(F.lit(1), F.least(F.lit(level), F.floor(F.log2(length / F.lit(taps - 1.0))).cast("int")))).otherwise(F.lit(1))


def window_sizes(rows: DataFrame, length: Column, level: int = 3) -> DataFrame:
    """Per window length: rows, the level it bears, and whether it lies within the limits of either transform at `level`."""
    limits = {t: window_limits(level, t) for t in ("dwt", "dtcwt")}
    out = rows.groupBy(length.cast("int").alias("length")).agg(F.count("*").alias("n_rows"))
    inside = [F.col("length").between(v["min"], v["max"]).alias(f"fits_{t}") for t, v in limits.items()]
    return out.select("length", "n_rows", level_for(F.col("length"), level).cast("int").alias("level"), *inside)


def gap_windows(gaps: DataFrame, ids: DataFrame, window: int) -> DataFrame:
    """Windows whose trailing slots hold a gap slot: each gap names the windows it touches, so this is an equi-join."""
    touched = gaps.select(F.explode(F.sequence(F.col("slot") + 1, F.col("slot") + window)).alias("window_id")).distinct()
    return ids.join(touched, "window_id", "left_semi")


def union_all(frames_: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames_)
