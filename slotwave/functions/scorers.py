"""Time-domain scorers as column expressions: ARRAY<DOUBLE>, oldest to newest, to DOUBLE."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _newest(x: Column) -> Column:
    return F.element_at(x, -1)


def _since_last(x: Column) -> Column:
    """Slots since the newest non-zero value; null without one."""
    at = F.array_position(F.transform(F.reverse(x), lambda v: v != 0), True)
    return F.when(at > 0, at - 1)


def af(x: Column) -> Column:
    """Sum of 2**-i times the count i slots ago."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a * 0.5 + v)


def ewma(x: Column, alpha: float = 0.2) -> Column:
    return F.aggregate(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.element_at(x, 1), lambda e, v: F.lit(alpha) * v + F.lit(1 - alpha) * e)


def rrd(x: Column) -> Column:
    """Total over the slots since the first non-zero one."""
    first = F.array_position(F.transform(x, lambda v: v != 0), True)
    return F.when(first > 0, _sum(x) / (F.size(x) - first + 1)).otherwise(F.lit(0.0))


def vse(x: Column) -> Column:
    return F.coalesce(_sum(x) / (_since_last(x) + 1), F.lit(0.0))


def compound(x: Column) -> Column:
    """Half the mean, 0.3 of the mean of the newest fifth, 0.2 of the recency; 0 for all zero."""
    recent = F.greatest(F.lit(1), F.floor(F.size(x) * F.lit(0.2)).cast("int"))
    value = 0.5 * (_sum(x) / F.size(x)) + 0.3 * (_sum(F.slice(x, -recent, recent)) / recent) + 0.2 * (1.0 / (_since_last(x) + 1))
    return F.coalesce(value, F.lit(0.0))


def pfrf(x: Column) -> Column:
    return F.aggregate(x, F.lit(1.0), lambda a, v: a * F.when(v > 0, 1.2).otherwise(0.8))


def moving_average(x: Column, n: int, horizon: int = 1) -> Column:
    """Mean of the newest n slots, or of all if there are fewer, times the horizon."""
    k = F.least(F.lit(n), F.size(x))
    return _sum(F.slice(x, -k, k)) / k * horizon


def ewma_equivalent(x: Column, n: int, horizon: int = 1) -> Column:
    return ewma(x, 2.0 / (n + 1)) * horizon


def persistence(x: Column, horizon: int = 1) -> Column:
    return F.greatest(_newest(x), F.lit(0.0)) * horizon


def holt(x: Column, horizon: int = 1, alpha: float = 0.3, gamma: float = 0.1) -> Column:
    """Linear trend; sum of the non-negative forecasts. A single value is repeated."""
    start = F.struct(F.element_at(x, 1).alias("l"), (F.element_at(x, 2) - F.element_at(x, 1)).alias("b"))

    def step(s: Column, v: Column) -> Column:
        level = F.lit(alpha) * v + F.lit(1 - alpha) * (s["l"] + s["b"])
        return F.struct(level.alias("l"), (F.lit(gamma) * (level - s["l"]) + F.lit(1 - gamma) * s["b"]).alias("b"))

    end = F.aggregate(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), start, step, lambda s: _ahead(s, horizon))
    sane = _let(end, lambda e: F.when(F.isnan(e) | (F.abs(e) == float("inf")), _newest(x) * horizon).otherwise(e))
    return F.when(F.size(x) < 2, F.element_at(x, 1) * horizon).otherwise(sane)


def _ahead(s: Column, horizon: int) -> Column:
    return sum((F.greatest(F.lit(0.0), s["l"] + k * s["b"]) for k in range(1, horizon + 1)), F.lit(0.0))


def ar2(x: Column, horizon: int = 1) -> Column:
    """AR(2) by Yule-Walker on the demeaned window; a rejected fit forecasts the mean, a short window its last value."""
    n = F.size(x)

    def lagged(d: Column, k: int) -> Column:
        both = F.zip_with(F.slice(d, 1, F.greatest(n - k, F.lit(0))), F.slice(d, k + 1, F.greatest(n - k, F.lit(0))), lambda a, b: a * b)
        return _sum(both) / n

    def forecast(s: Column) -> Column:
        a = s["r0"] + 1e-8
        det = a * a - s["r1"] * s["r1"]
        p1, p2 = (a * s["r1"] - s["r1"] * s["r2"]) / F.nullif(det, F.lit(0.0)), (a * s["r2"] - s["r1"] * s["r1"]) / F.nullif(det, F.lit(0.0))
        bad = (s["r0"] <= 1e-12) | p1.isNull() | F.isnan(p1) | F.isnan(p2) | (F.abs(p1) + F.abs(p2) > 4)
        return _let(F.struct(F.when(bad, 0.0).otherwise(p1).alias("q1"), F.when(bad, 0.0).otherwise(p2).alias("q2")), lambda q: run(s, q))

    def run(s: Column, q: Column) -> Column:
        ahead = lambda r: q["q1"] * r["h1"] + q["q2"] * r["h2"]
        start = F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"), F.lit(0.0).alias("t"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, lambda r, _: F.struct(ahead(r).alias("h1"), r["h1"].alias("h2"), (r["t"] + F.greatest(F.lit(0.0), ahead(r) + s["m"])).alias("t")), lambda r: r["t"])

    state = lambda d, m: F.struct(lagged(d, 0).alias("r0"), lagged(d, 1).alias("r1"), lagged(d, 2).alias("r2"), _newest(d).alias("h1"), F.element_at(d, -2).alias("h2"), m.alias("m"))
    fit = _let(_sum(x) / n, lambda m: _let(F.transform(x, lambda v: v - m), lambda d: _let(state(d, m), forecast)))
    return F.when(n < 4, _newest(x) * horizon).otherwise(fit)


def statistical(x: Column, alpha: float = 1.0, beta: float = 0.5, gamma: float = 0.3) -> Column:
    """alpha mean + beta skewness + gamma excess kurtosis (population forms); fewer than three values: the mean."""
    n = F.size(x)
    moment = lambda mean, k: _sum(F.transform(x, lambda v: F.pow(v - mean, F.lit(float(k))))) / n

    def value(s: Column) -> Column:
        whole = alpha * s["m"] + beta * (s["m3"] / F.pow(s["m2"], F.lit(1.5))) + gamma * (s["m4"] / (s["m2"] * s["m2"]) - 3.0)
        return F.when(n < 3, s["m"]).when(s["m2"] > 0, whole).otherwise(F.lit(0.0))

    return _let(_sum(x) / n, lambda mean: _let(F.struct(mean.alias("m"), *[moment(mean, k).alias(f"m{k}") for k in (2, 3, 4)]), value))


def series_features(x: Column) -> dict[str, Column]:
    """Mean, population sd, skewness, kurtosis, extremes and exact quartiles of a window."""
    n = F.size(x)
    mean = _sum(x) / n
    moment = lambda k: _sum(F.transform(x, lambda v: F.pow(v - mean, F.lit(float(k))))) / n
    m2 = moment(2)
    ordered = F.array_sort(x)

    def quantile(q: float) -> Column:
        at = (n - 1) * F.lit(q)
        lo = F.floor(at).cast("int")
        low, high = F.element_at(ordered, lo + 1), F.element_at(ordered, F.least(lo + 2, n))
        return low + (high - low) * (at - lo)

    return {
        "mean": mean, "std": F.sqrt(m2), "skew": F.when(m2 > 0, moment(3) / F.pow(m2, F.lit(1.5))).otherwise(0.0), "kurt": F.when(m2 > 0, moment(4) / (m2 * m2) - 3.0).otherwise(0.0),
        "min": F.array_min(x), "max": F.array_max(x), "median": quantile(0.5), "q25": quantile(0.25), "q75": quantile(0.75),
    }


@dataclass(frozen=True)
class Scorer:
    """A named scorer over the newest `window` slots; items need min_obs observed slots among them."""

    name: str
    window: int
    min_obs: int
    expr: Callable[[Column], Column]


#: The six baselines with their default windows.
BASELINES = (Scorer("AF", 7, 3, af), Scorer("EWMA", 7, 3, ewma), Scorer("RRD", 7, 3, rrd), Scorer("VSE", 7, 3, vse), Scorer("CompoundPop", 7, 3, compound), Scorer("PFRF", 7, 3, pfrf))


def of_matrix(m, length: int) -> dict:
    """The baselines, SMA, EWMAeq and Holt for one slot ahead, of windows of one size as the rows of a matrix; length is the one asked for.

    The same steps as the columns take, all windows at once: a sweep needs them for many lengths of a window.
    """
    import numpy as np

    n = m.shape[1]
    total, some = m.sum(1), m != 0
    any_, first, last = some.any(1), some.argmax(1), some[:, ::-1].argmax(1)
    recent = max(1, int(np.floor(n * 0.2)))

    def smoothed(alpha: float):
        e = m[:, 0]
        for i in range(1, n):
            e = alpha * m[:, i] + (1 - alpha) * e
        return e

    af_, level, slope = np.zeros(len(m)), m[:, 0], (m[:, 1] - m[:, 0] if n > 1 else None)
    power = np.ones(len(m))
    for i in range(n):
        af_ = af_ * 0.5 + m[:, i]
        power = power * np.where(m[:, i] > 0, 1.2, 0.8)
        if i:
            new = 0.3 * m[:, i] + (1 - 0.3) * (level + slope)
            level, slope = new, 0.1 * (new - level) + (1 - 0.1) * slope
    ahead = m[:, 0] if n < 2 else np.maximum(0.0, level + slope)
    out = {"AF": af_, "EWMA": smoothed(0.2), "RRD": np.where(any_, total / (n - first), 0.0), "VSE": np.where(any_, total / (last + 1), 0.0), "PFRF": power}
    out["CompoundPop"] = np.where(any_, 0.5 * (total / n) + 0.3 * (m[:, n - recent :].sum(1) / recent) + 0.2 * (1.0 / (last + 1)), 0.0)
    return out | {"SMA": total / n, "EWMAeq": smoothed(2.0 / (length + 1)), "Holt": np.where(np.isfinite(ahead), ahead, m[:, -1])}


@lru_cache(maxsize=128)
def linear_weights(n: int, alphas: tuple[float, ...]):
    """Weights (n x columns) that make of a window of n slots its ewma for each alpha, and Holt's level and slope: what they make of unit vectors."""
    import numpy as np

    unit = np.eye(n)
    smooth, level, slope = [unit[0]] * len(alphas), unit[0], unit[min(1, n - 1)] - unit[0]
    for v in unit[1:]:
        smooth = [a * v + (1 - a) * e for a, e in zip(alphas, smooth, strict=True)]
        new = 0.3 * v + (1 - 0.3) * (level + slope)
        level, slope = new, 0.1 * (new - level) + (1 - 0.1) * slope
    return np.stack([*smooth, level, slope], 1)


#: Lengths of the moving averages and smoothed means among the value forecasters.
SPANS = (8, 16, 32, 64)


def forecasts_of(horizons: tuple[int, ...]):
    """Names of the value forecasters' columns, and the function that makes them of a matrix of windows.

    Those that are a level (Persistence, SMA and EWMA of each of SPANS) are for one slot, to be multiplied by the horizon;
    Holt_<h> and ARYW_<h> are totals of h slots. The same as persistence, moving_average, ewma_equivalent, holt and ar2.
    """
    import numpy as np

    def work(m) -> dict:
        n = m.shape[1]
        made = m @ linear_weights(n, tuple(2.0 / (s + 1) for s in SPANS))
        newest, level, slope = m[:, -1], made[:, -2], made[:, -1]
        out = {"Persistence": np.maximum(newest, 0.0)} | {f"SMA{s}": m[:, -s:].sum(1) / min(s, n) for s in SPANS} | {f"EWMA{s}": made[:, i] for i, s in enumerate(SPANS)}
        mean = m.sum(1) / n
        x = m - mean[:, None]
        r0, r1, r2 = (np.einsum("ij,ij->i", x[:, : max(n - k, 0)], x[:, k:]) / n for k in range(3))
        a = r0 + 1e-8
        det = a * a - r1 * r1
        with np.errstate(all="ignore"):
            p1, p2 = (a * r1 - r1 * r2) / det, (a * r2 - r1 * r1) / det
            good = (r0 > 1e-12) & (det != 0) & (np.abs(p1) + np.abs(p2) <= 4)
        p1, p2 = np.where(good, p1, 0.0), np.where(good, p2, 0.0)
        h1, h2 = x[:, -1], x[:, -min(2, n)]
        trend, fitted = np.zeros(len(m)), np.zeros(len(m))
        for k in range(1, max(horizons) + 1):
            trend = trend + np.maximum(0.0, level + k * slope)
            h1, h2 = p1 * h1 + p2 * h2, h1
            fitted = fitted + np.maximum(0.0, h1 + mean)
            if k in horizons:
                out[f"Holt_{k}"] = np.where(np.isfinite(trend), trend, newest * k) if n > 1 else newest * k
                out[f"ARYW_{k}"] = fitted if n > 3 else newest * k
        return out

    return ("Persistence", *(f"{w}{s}" for w in ("SMA", "EWMA") for s in SPANS), *(f"{w}_{h}" for w in ("Holt", "ARYW") for h in horizons)), work


def all_baselines(x: Column) -> list[Column]:
    return [s.expr(x).alias(s.name) for s in BASELINES]


def validated(x: Column) -> Column:
    """The series, or null unless it is non-empty and all values are finite."""
    return F.when((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), x)


def user_scores(rows, name: str, batch, x: str = "x_w"):
    """rows with the scores of a user's function in place of the windows, and <name>_failed.

    batch maps a list of arrays to as many scores. If it raises, each window is scored alone; one
    that still raises scores 0 and is marked. A list in place of a score counts as its mean.
    """
    import numpy as np
    import pyarrow as pa

    kept = [c for c in rows.columns if c != x]

    def score(windows: list) -> tuple[list[float], list[bool]]:
        single = lambda v: float(np.mean(v)) if np.ndim(v) else float(v)
        try:
            return [single(v) for v in batch(windows)], [False] * len(windows)
        except Exception:  # noqa: BLE001  whatever the user's code raises
            if len(windows) == 1:
                return [0.0], [True]
        alone = [score([w]) for w in windows]
        return [s[0][0] for s in alone], [s[1][0] for s in alone]

    def run(batches):
        for b in batches:
            values, failed = score([np.asarray(w, float) for w in b[x].to_pylist()]) if b.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(values, pa.float64()), pa.array(failed, pa.bool_())], names=[*kept, name, f"{name}_failed"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != x)
    return rows.mapInArrow(run, f"{schema}, `{name}` double, `{name}_failed` boolean")
