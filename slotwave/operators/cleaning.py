"""Raw events to demand rows: parsing, filters, slot aggregation, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered

#: Slot lengths by name, in seconds; weeks start on Monday.
SLOTS = {"5min": 300, "15min": 900, "30min": 1800, "1h": 3600, "6h": 21600, "1D": 86400, "1W": 604800}
#: The Unix epoch was a Thursday; its Monday lies three days before.
_MONDAY = 3 * 86400


def parse_time(raw: Column, unit: str | None = None, fmt: str | None = None) -> Column:
    """Timestamp from an epoch number (unit s, ms or us), by a pattern, or as text; null where it cannot be read."""
    if unit:
        return {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[unit](raw)
    return F.try_to_timestamp(raw, F.lit(fmt)) if fmt else raw.try_cast("timestamp")


def slot_start(ts: Column, slot: str) -> Column:
    size = SLOTS[slot]
    shift = _MONDAY if slot == "1W" else 0
    return F.timestamp_seconds(F.floor((F.unix_seconds(ts.cast("timestamp")) + shift) / size) * size - shift)


def in_period(ts: Column, earliest: str, latest: str, start: str | None = None, end: str | None = None) -> Column:
    """Inside the valid dates and the user's range, both inclusive; a date without a time is its midnight."""
    rule = ts.between(F.lit(earliest).cast("timestamp"), F.lit(latest).cast("timestamp"))
    for bound, op in ((start, "__ge__"), (end, "__le__")):
        if bound:
            rule &= getattr(ts, op)(F.lit(bound).cast("timestamp"))
    return rule


def valid_id(c: Column) -> Column:
    return c.isNotNull() & (c > 0)


def within(ranges: dict[str, tuple[float, float]]) -> Column:
    """All named columns inside their closed ranges; a null fails."""
    rule = F.lit(True)
    for name, (lo, hi) in ranges.items():
        rule &= F.coalesce(F.col(name).between(lo, hi), F.lit(False))
    return rule


def non_negative(*names: str) -> Column:
    rule = F.lit(True)
    for name in names:
        rule &= F.coalesce(F.col(name) >= 0, F.lit(False))
    return rule


def slot_rows(df: DataFrame, ts: str, item: str, slot: str | None, features: tuple[str, ...] = ()) -> DataFrame:
    """timestamp, item_id, count of rows, and the features' means to two digits (halves to even)."""
    at = slot_start(F.col(ts), slot) if slot else F.col(ts)
    return df.groupBy(at.alias("timestamp"), F.col(item).cast("string").alias("item_id")).agg(F.count("*").alias("count"), *[F.bround(F.avg(f), 2).alias(f) for f in features])


def slot_sums(df: DataFrame, ts: str, item: str, value: str, slot: str | None, features: tuple[str, ...] = ()) -> DataFrame:
    """timestamp, item_id, count as the sum of a value column, and the features' means."""
    at = slot_start(F.col(ts), slot) if slot else F.col(ts)
    return df.groupBy(at.alias("timestamp"), F.col(item).cast("string").alias("item_id")).agg(F.sum(value).alias("count"), *[F.bround(F.avg(f), 2).alias(f) for f in features])


def rating_rows(df: DataFrame, slot: str, min_rating: float | None = None, exact: bool = True) -> DataFrame:
    """Ratings (userId, movieId, rating, timestamp) per slot and item: count, mean_rating, user_count."""
    if min_rating is not None:
        df = df.where(F.col("rating") >= min_rating)
    users = F.count_distinct("userId") if exact else F.approx_count_distinct("userId")
    return df.groupBy(slot_start(F.col("timestamp"), slot).alias("timestamp"), F.col("movieId").cast("string").alias("item_id")).agg(F.count("*").alias("count"), F.avg("rating").alias("mean_rating"), users.alias("user_count"))


def distinct_sketches(df: DataFrame, slot: str, user: str = "userId", item: str = "movieId", precision: int = 12) -> DataFrame:
    """Per slot and item: count, and a mergeable sketch (HLL) of the distinct users, of 2**precision registers at most."""
    return df.groupBy(slot_start(F.col("timestamp"), slot).alias("timestamp"), F.col(item).cast("string").alias("item_id")).agg(F.count("*").alias("count"), F.hll_sketch_agg(F.col(user).cast("string"), F.lit(precision)).alias("users"))


def roll_up(sketches: DataFrame, slot: str) -> DataFrame:
    """Rows of distinct_sketches merged into longer slots, with user_count, the estimate; the events are not read again.

    The estimate of merged sketches is that of a sketch of all rows: its standard error is some
    1.04 / sqrt(registers).
    """
    merged = sketches.groupBy(slot_start(F.col("timestamp"), slot).alias("timestamp"), "item_id").agg(F.sum("count").alias("count"), F.hll_union_agg("users").alias("users"))
    return merged.withColumn("user_count", F.hll_sketch_estimate("users"))


def merge_rows(demand: DataFrame, features: tuple[str, ...] = (), how: str = "weighted") -> DataFrame:
    """One row per (timestamp, item_id): counts added; features as count-weighted means, or how='first'."""
    one = {"weighted": lambda f: F.sum(F.col(f) * F.col("count")) / F.sum(F.when(F.col(f).isNotNull(), F.col("count"))), "first": lambda f: F.first(f, ignorenulls=True)}[how]
    return demand.groupBy("timestamp", "item_id").agg(F.sum("count").alias("count"), *[one(f).alias(f) for f in features])


def min_total(demand: DataFrame, least: int) -> DataFrame:
    keep = demand.groupBy("item_id").agg(F.sum("count").alias("t")).where(F.col("t") >= least).select("item_id")
    return demand.join(keep, "item_id", "left_semi")


def same_slots(a: DataFrame, b: DataFrame) -> DataFrame:
    """Timestamps that only one of two tables has."""
    x, y = (d.select("timestamp").distinct() for d in (a, b))
    return x.exceptAll(y).unionByName(y.exceptAll(x))


def daily_and_weekly(df: DataFrame, ts: str, item: str, first_day: str, last_day: str) -> DataFrame:
    """grain ('day' or 'week'), timestamp, item_id, count inside the period; weeks only if all seven days are inside."""
    day = F.to_date(ts)
    inside = df.where(day.between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    daily = inside.groupBy(day.alias("d"), F.col(item).cast("string").alias("item_id")).agg(F.count("*").alias("count"))
    monday = F.date_sub("d", F.pmod(F.datediff("d", F.lit("1970-01-05").cast("date")), F.lit(7)))
    weekly = daily.groupBy(monday.alias("d"), "item_id").agg(F.sum("count").alias("count")).where((F.col("d") >= F.lit(first_day).cast("date")) & (F.date_add("d", 6) <= F.lit(last_day).cast("date")))
    return daily.withColumn("grain", F.lit("day")).unionByName(weekly.withColumn("grain", F.lit("week"))).select("grain", F.col("d").cast("timestamp").alias("timestamp"), "item_id", "count")


def first_day_counts(df: DataFrame, ts: str, user: str) -> DataFrame:
    """Per day: ratings, and the share of them on their user's first day."""
    day = F.to_date(ts).alias("day")
    per = df.groupBy(F.col(user).alias("user"), day).agg(F.count("*").alias("n"))
    first = per.groupBy("user").agg(F.min("day").alias("first_day"))
    return per.join(first, "user").groupBy("day").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("day") == F.col("first_day"), F.col("n")).otherwise(0)).alias("n_first_day"))


def year_profile(demand: DataFrame) -> DataFrame:
    """Rows, items and requests per year, and in all (year null)."""
    return demand.rollup(F.year("timestamp").alias("year")).agg(F.count("*").alias("n_rows"), F.count_distinct("item_id").alias("n_items"), F.sum("count").alias("requests"))


def ends_with(name: str, suffix: str) -> Column:
    """Items whose name ends in _<suffix>."""
    return F.coalesce(F.col(name).endswith(f"_{suffix}"), F.lit(False))


def view_rows(views: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, day, views) to demand: missing views are zero, zero rows go, items are the pages' numbers (page, item_id)."""
    filled = views.select("page", "day", F.coalesce("views", F.lit(0)).cast("long").alias("count")).where("count > 0")
    return filled.join(pages, "page").select(F.col("day").cast("timestamp").alias("timestamp"), "item_id", "count")


def systematic_sample(items: DataFrame, n_days: int, max_cells: int, order: str = "item_id") -> DataFrame:
    """Every k-th item in order, with the smallest k such that the kept items fill at most max_cells item-days."""
    k = F.ceil(F.col("n_all") / F.lit(max(1, max_cells // n_days))).cast("int")
    return numbered(items, order).withColumn("k", k).where(F.col("nth") % F.col("k") == 0).drop("n_all", "nth")


def value_violations(df: DataFrame, value: str) -> DataFrame:
    """One row: how many values are missing, not finite, negative, not whole."""
    v = F.col(value).cast("double")
    count = lambda rule: F.coalesce(F.sum(F.coalesce(rule, F.lit(False)).cast("long")), F.lit(0))
    return df.agg(count(v.isNull()).alias("n_missing"), count(F.isnan(v) | (F.abs(v) == float("inf"))).alias("n_not_finite"), count(v < 0).alias("n_negative"), count(v != F.floor(v)).alias("n_not_whole"))


def checked(df: DataFrame, value: str) -> DataFrame:
    """df itself; a value that is not finite, non-negative and whole raises an error when read."""
    v = F.col(value).cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v == F.floor(v)) & (v < float("inf"))
    return df.withColumn(value, F.when(good, F.col(value)).otherwise(F.raise_error(F.concat(F.lit(f"bad value in {value}: "), F.col(value).cast("string")))))


def validate_schema(df: DataFrame) -> DataFrame:
    """Null counts of the required columns; a missing or mistyped column raises an error."""
    kinds = dict(df.dtypes)
    missing = {"timestamp", "item_id", "count"} - kinds.keys()
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if not kinds["timestamp"].startswith("timestamp"):
        raise TypeError(f"timestamp is {kinds['timestamp']}")
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls") for c in ("timestamp", "item_id", "count")])


def statistics(demand: DataFrame) -> DataFrame:
    """One row: records, items, span, days, total, mean per slot."""
    return demand.agg(F.count("*").alias("n_records"), F.count_distinct("item_id").alias("n_items"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.datediff(F.max("timestamp"), F.min("timestamp")).alias("n_days"), F.sum("count").alias("total"), (F.sum("count") / F.count_distinct("timestamp")).alias("mean_per_slot"), F.avg("count").alias("mean_count"), F.stddev_samp("count").alias("sd_count"))


def to_demand(df: DataFrame, ts: str, item: str, slot: str, least: int | None = None, features: tuple[str, ...] = ()) -> DataFrame:
    """Raw rows to demand: unreadable times and missing items dropped, counted per slot, rare items dropped."""
    rows = df.withColumn("_ts", parse_time(F.col(ts))).where(F.col("_ts").isNotNull() & F.col(item).isNotNull())
    out = slot_rows(rows, "_ts", item, slot, features)
    return min_total(out, least) if least else out


#: Seconds of calendar steps; a month counts 30 days.
STEPS = {"minute": 60, "hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2592000}


def slots_between(a: Column, b: Column, step: str, minutes: int | None = None) -> Column:
    return F.floor((F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))) / (minutes * 60 if minutes else STEPS[step]))


def add_slots(ts: Column, n: Column | int, step: str, minutes: int | None = None) -> Column:
    return F.timestamp_seconds(F.unix_seconds(ts.cast("timestamp")) + n * (minutes * 60 if minutes else STEPS[step]))


def days_to_slots(days: float, step: str, minutes: int | None = None) -> int:
    return max(1, int(days * 86400 // (minutes * 60 if minutes else STEPS[step])))
