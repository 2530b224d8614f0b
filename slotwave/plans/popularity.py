"""Evaluations on demand tables: scores of every item in every window, rankings and their metrics."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scorers as S
from ..operators import grid as G
from ..operators import ranking as R
from ..operators import series as N
from ..operators import wavelet as V

#: Requests an item needs before a window to enter it.
MIN_TOTAL = 24
WEEK = 7 * 86400
NUDGE = 3.7e-10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand: shipped order lines of each supplier per Monday week."""
    lines = table(spark, sf_dir, "lineitem").select(F.date_trunc("week", "l_shipdate").alias("timestamp"), F.col("l_suppkey").cast("string").alias("item_id"))
    return N.spread(lines, "item_id").groupBy("timestamp", "item_id").agg(F.count("*").alias("count"))


def user_six_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand: events of each user per six hours."""
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600) * 21600)
    events = table(spark, sf_dir, "events").select(slot.alias("timestamp"), F.col("user_id").cast("string").alias("item_id"))
    return N.spread(events, "item_id").groupBy("timestamp", "item_id").agg(F.count("*").alias("count"))


class Study:
    """A demand table on its grid."""

    def __init__(self, demand: DataFrame, slot_seconds: int | None = None, min_total: int = MIN_TOTAL, long_series: int = 65536):
        #: Written once: the grid, every length, horizon and method start from it.
        self.demand, self.min_total, self.long_series = held(demand, "demand"), min_total, long_series
        self.grid = G.infer_grid(self.demand, slot_seconds)

    @cached_property
    def dense(self) -> DataFrame:
        """Every item in every slot, for what is not made of whole series (see counts)."""
        return held(G.densify(self.demand, self.grid), "dense")

    @cached_property
    def counts(self) -> DataFrame:
        """item_id, slot, v of the rows that there are."""
        t0, seconds = self._span
        slot = (F.unix_seconds(F.col("timestamp").cast("timestamp")) - F.lit(t0)) / F.lit(seconds)
        whole = F.when(slot == F.floor(slot), slot).otherwise(F.raise_error(F.lit("timestamp off the slot grid")))
        return self.demand.where("item_id is not null").select("item_id", whole.cast("int").alias("slot"), F.col("count").cast("double").alias("v"))

    @cached_property
    def _first(self):
        return self.grid.select(F.unix_seconds(F.col("t0").cast("timestamp")).alias("t0"), "slot_seconds", "n_slots").first()

    @property
    def _span(self) -> tuple[int, int]:
        return self._first.t0 or 0, self._first.slot_seconds or 1

    @property
    def n_slots(self) -> int:
        return (self._first.n_slots or 0) + 1

    @cached_property
    def n_items(self) -> int:
        return self.demand.select("item_id").distinct().count()

    @property
    def live(self) -> DataFrame:
        """Windows whose slot holds any row of the catalogue."""
        return self.counts.where("v is not null").select(F.col("slot").alias("window_id")).distinct()

    def wide(self, parts: list[N.Part], horizon: int = 1, step: int = 1, together: bool = False, since: int = 0, until: int | None = None) -> DataFrame:
        """Rows (window_id, item_id, truth, columns of the parts) of the eligible items, made of whole series inside tasks (see series.windows); long series go through arrays in pieces."""
        cut = self.chunk(max(*[p.length for p in parts], horizon))
        if cut is None:
            return N.windows(self.counts, self.n_slots - 1, self.n_items, parts, horizon, self.min_total, step, together, since, until)
        fits = [F.col(f"observed_p{i}") >= p.least for i, p in enumerate(parts)]
        some = reduce((lambda a, b: a & b) if together else (lambda a, b: a | b), fits)
        rows = G.strided(self.windows({f"p{i}": p.length for i, p in enumerate(parts)}, horizon, cut), step).where((F.col("window_id") > 0) & (F.col("before") >= self.min_total) & some)
        rows = rows.where((F.col("window_id") >= since) & (F.col("window_id") < (self.n_slots if until is None else until)))
        columns = []
        for i, p in enumerate(parts):
            if p.work is None:
                columns += [F.col(f"x_p{i}").alias(n) for n in p.names]
                continue
            rows = V._batchwise(rows, f"x_p{i}", ", ".join(f"`{n}` double" for n in p.names), p.work)
            columns += [F.when(fits[i], F.col(f"`{n}`")).alias(n) for n in p.names]
        return rows.select("window_id", "item_id", "truth", *columns)

    def ahead(self, part: N.Part, horizons: tuple[int, ...]) -> DataFrame:
        """Rows (window_id, item_id, truth_<horizon>, columns of the part) of the eligible items, made once for all horizons; a truth whose future leaves the grid is null."""
        if self.chunk(max(part.length, *horizons)) is None:
            return N.windows(self.counts, self.n_slots - 1, self.n_items, [part], horizons, self.min_total)
        rows = self.spans((part.length,), horizons).where(F.col(f"observed_{part.length}") >= part.least)
        rows = rows.where(F.col(f"truth_{min(horizons)}").isNotNull()).select("window_id", "item_id", *[f"truth_{h}" for h in horizons], "x")
        return V._batchwise(rows, "x", ", ".join(f"`{n}` double" for n in part.names), part.work)

    def valid(self, rows: DataFrame) -> DataFrame:
        """window_id of the windows that count: their slot holds any row of the catalogue, and they have at least two of these rows."""
        return rows.groupBy("window_id").agg(F.count("*").alias("n")).where("n >= 2").join(self.live, "window_id", "left_semi").select("window_id")

    def chunk(self, longest: int, given: int | None = None) -> int | None:
        """Slots of a piece of a series: as given, else by the number of slots (see grid.chunk_for)."""
        return given or G.chunk_for(self.n_slots, longest, self.long_series)

    def windows(self, lengths: dict[str, int], horizon: int = 1, chunk: int | None = None) -> DataFrame:
        """Trailing windows of all items; series of more than long_series slots are worked on in pieces."""
        cut = self.chunk(max(*lengths.values(), horizon), chunk)
        return G.in_time(G.frames(self.dense, lengths, horizon, cut), self.grid, horizon)

    def spans(self, lengths: tuple[int, ...], horizons: tuple[int, ...] = (1,)) -> DataFrame:
        """Windows of all lengths and horizons at once (see grid.spans), of items with enough requests before them."""
        return G.spans(self.dense, self.grid, lengths, horizons, self.chunk(max(*lengths, *horizons))).where(F.col("before") >= self.min_total)

    def measured(self, wide: DataFrame, methods: dict[str, Column], ks: tuple[int, ...] = R.KS, **more) -> DataFrame:
        """Metric rows of valid windows (see ranking.protocol_wide)."""
        return R.protocol_wide(wide, methods, ks, 2, self.live, self.n_items, windows=self.n_slots, **more)

    def protocol(self, scorers: list[S.Scorer], horizon: int = 1, ks: tuple[int, ...] = R.KS, **more) -> DataFrame:
        """Metric rows of the scorers; those with equal window and eligibility share one row an item."""
        if all(s in S.BASELINES for s in scorers):
            names = tuple(s.name for s in scorers)
            return self.measured(self.wide([baselines_part(names)], horizon), {n: F.col(n) for n in names}, ks, **more)
        parts = [self.measured(wide, {n: F.col(n) for n in names}, ks, **more) for wide, names in self._wide(scorers, horizon)]
        return G.union_all(parts)

    def _wide(self, scorers: list[S.Scorer], horizon: int = 1, chunk: int | None = None, causal: bool = True):
        """(rows with a column for each scorer, their names) for each window and eligibility."""
        groups: dict[tuple[int, int], list[S.Scorer]] = {}
        for s in scorers:
            groups.setdefault((s.window, s.min_obs), []).append(s)
        for (window, min_obs), members in groups.items():
            rows = self.windows({"w": window}, horizon, chunk).where(G.eligible("w", min_obs, self.min_total, causal))
            yield rows.select("window_id", "item_id", "truth", *[s.expr(F.col("x_w")).cast("double").alias(s.name) for s in members]), [s.name for s in members]

    def scored(self, scorers: list[S.Scorer], horizon: int = 1, chunk: int | None = None, causal: bool = True) -> DataFrame:
        """Rows (window_id, item_id, truth, method, score) of the eligible items of valid windows.

        Scorers with equal window and eligibility share their window array; each group of them is
        one narrow pass after the window exchange.
        """
        parts = []
        for wide, names in self._wide(scorers, horizon, chunk, causal):
            parts.append(R.to_long(G.valid_windows(wide, self.dense, ["window_id"]), names, ["window_id", "item_id", "truth"]))
        return G.union_all(parts)


def baselines_part(names: tuple[str, ...]) -> N.Part:
    """Baselines over the newest seven slots."""
    return N.Part(7, 3, names, lambda m: S.of_matrix(m, 7))


def weekly(spark: SparkSession, sf_dir: str, min_total: int = MIN_TOTAL) -> Study:
    return Study(supplier_weeks(spark, sf_dir), WEEK, min_total)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (halves by a nudge first), so that sums taken in another order compare equal."""
    return df.select(*[F.round(F.col(c) + F.lit(NUDGE), digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def compare(study: Study, scorers: list[S.Scorer], horizon: int = 1) -> DataFrame:
    return R.protocol(study.scored(scorers, horizon))


def sweep(study: Study, lengths: tuple[int, ...], make: Callable[[int], list[S.Scorer]], horizon: int = 1) -> DataFrame:
    """Protocol rows of every (window length, scorer) on the windows common to all; methods are named name@N."""
    scorers = [S.Scorer(f"{s.name}@{n}", n, s.min_obs, s.expr) for n in lengths for s in make(n)]
    return G.common_windows(R.protocol(study.scored(scorers, horizon)))


def baselines_at(n: int) -> list[S.Scorer]:
    return [S.Scorer(s.name, n, 3, s.expr) for s in S.BASELINES] + [S.Scorer("SMA", n, 3, lambda x: S.moving_average(x, n)), S.Scorer("EWMAeq", n, 3, lambda x: S.ewma_equivalent(x, n)), S.Scorer("Holt", n, 3, S.holt)]


def forecast_baselines(horizon: int) -> list[S.Scorer]:
    return [
        S.Scorer("Persistence", 64, 3, lambda x: S.persistence(x, horizon)), S.Scorer("MA64", 64, 3, lambda x: S.moving_average(x, 64, horizon)),
        S.Scorer("AR2", 64, 3, lambda x: S.ar2(x, horizon)), S.Scorer("HoltF", 64, 3, lambda x: S.holt(x, horizon)),
    ]


def held(df: DataFrame, name: str) -> DataFrame:
    """df written once to the folder that all executors share, and read from there."""
    from ..sources.tables import stored

    return stored(df, name)


def named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in columns.items()]
