"""Transform-domain scores of windows: features once, every index and forecast as columns of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wavelets as W
from ..functions.scorers import of_matrix

FEATURES = "low array<double>, energies array<double>, mu_l double, r double, w_e double, d double, h_q double, e_tot double, af double, slope double"


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each window length in a batch."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), float)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        if n:
            yield rows, flat[starts[rows][:, None] + np.arange(n)]


def _numbers(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """A column from (rows, values) parts; rows in no part are null."""
    out, missing = np.zeros(n), np.ones(n, bool)
    for rows, values in parts:
        out[rows], missing[rows] = values, False
    return pa.array(out, pa.float64(), mask=missing)


def _lists(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
    sizes, missing = np.zeros(n, np.int32), np.ones(n, bool)
    for rows, values in parts:
        sizes[rows], missing[rows] = values.shape[1], False
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.zeros(starts[-1])
    for rows, values in parts:
        flat[starts[rows][:, None] + np.arange(values.shape[1])] = values
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat), mask=pa.array(missing))


def _batchwise(df: DataFrame, x: str, out: str, work) -> DataFrame:
    """Columns of `out` from arrays of equal windows; work maps a matrix to named arrays. x is dropped."""
    keep = [c for c in df.columns if c != x]
    kinds = {p.split()[0].strip("`"): p.split(maxsplit=1)[1] for p in out.split(", ")}
    names = list(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {n: [] for n in names}
            for rows, m in _by_length(batch.column(x)):
                made = work(m)
                for name in names:
                    found[name].append((rows, made[name]))
            new = [(_lists if kinds[n].startswith("array") else _numbers)(found[n], batch.num_rows) for n in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], names=[*keep, *names])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != x)
    return df.mapInArrow(run, f"{schema}, {out}" if schema else out)


def wavelet_features(frames: DataFrame, x: str = "x_w", level: int = 3, transform: str = "dtcwt", how: str = "symmetric", pad: str = "reflect", target: int = 64) -> DataFrame:
    """frames with the features of each window in place of the window; short windows are padded on the left."""
    size = max(target, 2 ** (level + 1))
    return _batchwise(frames, x, FEATURES, lambda m: W.features(W.pad_left(m, size, pad), level, transform, how))


#: Features that feature_sets gives for each setting.
SET = ("mu_l", "r", "w_e", "af")


def feature_sets(frames: DataFrame, settings: dict[str, dict], x: str = "x_w", target: int = 64, baselines: tuple[int, ...] = ()) -> DataFrame:
    """frames with <name>_mu_l, <name>_r, <name>_w_e and <name>_af for each setting, all from one pass over the windows.

    A setting may name level, transform, how and pad, and of which newest slots (last) it is
    made, filled up to that length. For each of the lengths in baselines there are the columns
    <name>_<length> of scorers.of_matrix, of so many newest slots.
    """
    names, work = sets_of(settings, target, baselines)
    return _batchwise(frames, x, ", ".join(f"{c} double" for c in names), work)


def sets_of(settings: dict[str, dict], target: int = 64, baselines: tuple[int, ...] = ()):
    """The names of feature_sets' columns, and the function that makes them of a matrix of windows."""
    full = {name: {"level": 3, "transform": "dtcwt", "how": "symmetric", "pad": "reflect", "last": target} | o for name, o in settings.items()}

    def work(m: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for name, o in full.items():
            made = W.features(W.pad_left(m[:, -o["last"] :], max(o["last"], 2 ** (o["level"] + 1)), o["pad"]), o["level"], o["transform"], o["how"])
            out |= {f"{name}_{k}": made[k] for k in SET}
        for n in baselines:
            out |= {f"{k}_{n}": v for k, v in of_matrix(m[:, -n:], n).items()}
        return out

    return (*(f"{name}_{k}" for name in settings for k in SET), *(f"{k}_{n}" for n in baselines for k in of_matrix(np.ones((1, 2)), n))), work


def features_of(*names: str, target: int = 64):
    """Names of wavelet_features' columns at its defaults, and the function that makes them of a matrix of windows."""
    return names, lambda m: W.features(W.pad_left(m, target, "reflect"))


def index(alpha: float = 1.0, beta: float = 1.0, use_r: bool = True, use_w: bool = True, of: str = "") -> Column:
    """mu_L exp(alpha R - beta W_E), of plain features or of a setting's (`of`)."""
    p = f"{of}_" if of else ""
    power = F.lit(0.0)
    power = power + alpha * F.col(f"{p}r") if use_r else power
    power = power - beta * F.col(f"{p}w_e") if use_w else power
    return F.col(f"{p}mu_l") * F.exp(power)


def fusions(of: str = "") -> dict[str, Column]:
    mu, r, w = (F.col(f"{of}_{c}" if of else c) for c in ("mu_l", "r", "w_e"))
    return {"full": index(of=of), "trend": mu, "R": index(use_w=False, of=of), "WE": index(use_r=False, of=of), "linear": mu * (1 + r - w), "product": mu * r * (1 - w), "additive": mu + r - w}


def slope_index(alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0, clip: float | None = 3.0) -> Column:
    """The earlier index with a slope term: mu exp(clip(alpha S + beta R - gamma W_E))."""
    power = alpha * F.col("slope") + beta * F.col("r") - gamma * F.col("w_e")
    power = F.least(F.greatest(power, F.lit(-clip)), F.lit(clip)) if clip is not None else power
    return F.col("mu_l") * F.exp(power)


def entropy_residual(level: int = 3) -> Column:
    """w_e log2(J+1) - (h(r) + (1 - r) H(q)); zero up to rounding."""
    r = F.col("r")
    term = lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)
    return F.col("w_e") * float(np.log2(level + 1)) - (term(r) + term(1 - r) + (1 - r) * F.col("h_q"))


def structural_gate(gamma: float = 0.3) -> Column:
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r") * (1 - F.col("w_e")))), F.lit(gamma))


#: Settings of the sensitivity study: clamps, gate exponents and trust factors.
CLAMPS, GAMMAS, TRUSTS, KAPPAS = (2.0, 4.0, 8.0), (0.1, 0.3, 0.5), (0.8, 1.0), (1.0, 1.5, 2.0, 3.0)


def _name(text: str, value: float) -> str:
    return f"{text}{value:g}".replace(".", "_")


def coefficient_forecasts(features: DataFrame, horizon: int = 1, level: int = 3, clamps: tuple[float, ...] = (4.0,), kappas: tuple[float, ...] = (1.0,)) -> DataFrame:
    """features (with low) plus the extended means of each forecaster, the backtest gate and skill factors; low is dropped.

    mu_<forecaster>_c<clamp> is clamped at the last coefficient, mu_<forecaster>_free is not, and
    mu_mean_level is clamped at mu_L.
    """
    names, work = _forecasts(horizon, level, clamps, kappas)
    return _batchwise(features, "low", ", ".join(f"{n} double" for n in names), work)


def _forecasts(horizon: int, level: int, clamps: tuple[float, ...], kappas: tuple[float, ...]):
    """Names of coefficient_forecasts' columns, and the function that makes them of low coefficients; every forecaster runs once.

    The function takes forecasts that are made, of as many steps or more, as raw.
    """
    m = W.ahead(horizon, level)
    columns = {_name(f"mu_{k.lower()}_c", c): (k, c) for k in ("NLMS", "YW", "TS", "LEVEL") for c in clamps} | {"mu_yw_free": ("YW", None), "mu_mean_free": ("MEAN", None)}

    def work(a: np.ndarray, raw: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        raw = {how: raw[how][:, :m] if raw else W.FORECASTS[how](a, m) for how in dict.fromkeys(how for how, _ in columns.values())}
        tested = W.backtest(a, m)
        out = {name: W.extended(a, raw[how], c) for name, (how, c) in columns.items()}
        out["mu_mean_level"] = W.extended(a, raw["MEAN"], 4.0, W.recency_mean(a))
        out["gate"] = W.backtest_gate(a, m, tested=tested)
        return out | {_name("skill_", k): W.skill(a, m, k, tested=tested) for k in kappas}

    return (*columns, "mu_mean_level", "gate", *[_name("skill_", k) for k in kappas]), work


def forecasts_of(horizon: int = 1, clamps: tuple[float, ...] = (4.0,), kappas: tuple[float, ...] = (1.0,), target: int = 64):
    """Names of mu_l, r, w_e and coefficient_forecasts' columns, and the function that makes them of a matrix of windows."""
    names, work = _forecasts(horizon, 3, clamps, kappas)

    def made(m: np.ndarray) -> dict[str, np.ndarray]:
        found = W.features(W.pad_left(m, target, "reflect"))
        return {k: found[k] for k in ("mu_l", "r", "w_e")} | work(found["low"])

    return ("mu_l", "r", "w_e", *names), made


def forecast_index(mu_hat: str, share: Column | float = 1.0, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """mu_L^(1-s) mu_hat^s exp(alpha R - beta W_E); zero where mu_L vanishes, and mu_L in place of a mu_hat that does."""
    s = share if isinstance(share, Column) else F.lit(float(share))
    hat = F.when((F.col(mu_hat) > 1e-12) & ~F.isnan(mu_hat), F.col(mu_hat)).otherwise(F.col("mu_l"))
    level = F.col("mu_l") * F.pow(hat / F.greatest(F.col("mu_l"), F.lit(1e-12)), s)
    return F.when(F.col("mu_l") <= 1e-12, 0.0).otherwise(level * F.exp(alpha * F.col("r") - beta * F.col("w_e")))


def forecast_scores(gamma: float = 0.3) -> dict[str, Column]:
    """The forecast indices over coefficient_forecasts()."""
    return {
        "WSPI-F": forecast_index("mu_nlms_c4"), "WSPI-FYW": F.col("mu_yw_free") * F.exp(F.col("r") - F.col("w_e")), "WSPI-F2": forecast_index("mu_yw_c4", structural_gate(gamma)),
        "WSPI-FT": forecast_index("mu_ts_c4"), "WSPI-FG": forecast_index("mu_yw_c4", F.col("gate")), "WSPI-S": forecast_index("mu_level_c4"),
        "WSPI-M": F.col("mu_mean_free") * F.exp(F.col("r") - F.col("w_e")), "WSPI-H": forecast_index("mu_mean_level"), "WSPI-HL": forecast_index("mu_mean_level", alpha=0.0, beta=0.0),
    }


def skilled_scores(kappas: tuple[float, ...] = KAPPAS, gamma: float = 0.3) -> dict[str, Column]:
    """The index whose share is the structural gate times the skill factor, for each kappa (over coefficient_forecasts(kappas=...))."""
    return {f"WSPI-FS{k:g}": forecast_index("mu_yw_c4", structural_gate(gamma) * F.col(_name("skill_", k))) for k in kappas}


def scores_at(horizons: tuple[int, ...], kappas: tuple[float, ...] = KAPPAS, gamma: float = 0.3, target: int = 64):
    """Names of the index (WSPI) and of forecast_scores and skilled_scores at each horizon (<method>_<horizon>), and the function that makes them of a matrix of windows.

    Features are made once; a forecaster runs once, to the farthest horizon, and nearer ones take its first steps.
    """
    each = {h: _forecasts(h, 3, (4.0,), kappas)[1] for h in horizons}
    most = W.ahead(max(horizons), 3)
    names = (*forecast_scores(gamma), *skilled_scores(kappas, gamma))

    def made(m: np.ndarray) -> dict[str, np.ndarray]:
        found = W.features(W.pad_left(m, target, "reflect"))
        mu, r, w_e = found["mu_l"], found["r"], found["w_e"]
        raw = {how: f(found["low"], most) for how, f in W.FORECASTS.items()}
        some, floor, rise, gate = mu > 1e-12, np.maximum(mu, 1e-12), np.exp(r - w_e), np.clip(r * (1 - w_e), 0.0, 1.0) ** gamma

        def index(hat: np.ndarray, share: np.ndarray | float = 1.0, rise: np.ndarray | float = rise) -> np.ndarray:
            return np.where(some, mu * (np.where(hat > 1e-12, hat, mu) / floor) ** share * rise, 0.0)

        out = {"WSPI": mu * rise}
        for h, work in each.items():
            c = work(found["low"], raw)
            own = (
                index(c["mu_nlms_c4"]), c["mu_yw_free"] * rise, index(c["mu_yw_c4"], gate), index(c["mu_ts_c4"]), index(c["mu_yw_c4"], c["gate"]), index(c["mu_level_c4"]),
                c["mu_mean_free"] * rise, index(c["mu_mean_level"]), index(c["mu_mean_level"], rise=1.0), *[index(c["mu_yw_c4"], gate * c[_name("skill_", k)]) for k in kappas],
            )
            out |= {f"{n}_{h}": v for n, v in zip(names, own, strict=True)}
        return out

    return ("WSPI", *(f"{n}_{h}" for h in horizons for n in names)), made


def sensitivity_scores(clamps: tuple[float, ...] = CLAMPS, gammas: tuple[float, ...] = GAMMAS, trusts: tuple[float, ...] = TRUSTS) -> dict[str, Column]:
    """The gated index for every clamp, gate exponent and trust factor (over coefficient_forecasts(clamps=...))."""
    return {f"WSPI-F2_c{c:g}_g{g:g}_p{p:g}": forecast_index(_name("mu_yw_c", c), p * structural_gate(g)) for c in clamps for g in gammas for p in trusts}


def shift_energies(frames: DataFrame, x: str = "x_w", level: int = 3, transform: str = "dtcwt", shifts: int = 9) -> DataFrame:
    """Variation of band energies, R and W_E over circular shifts 0 to shifts - 1 of each window (population forms)."""

    def work(m: np.ndarray) -> dict[str, np.ndarray]:
        all_ = [W.features(np.roll(m, s, axis=1), level, transform, "periodic" if transform == "dtcwt" else "periodization") for s in range(shifts)]
        e = np.stack([f["energies"] for f in all_])
        mean = e.mean(0)
        out = {f"cv_{b}": np.where(mean[:, b] > 0, e[:, :, b].std(0) / np.where(mean[:, b] > 0, mean[:, b], 1), 0.0) for b in range(level + 1)}
        return out | {"sd_r": np.stack([f["r"] for f in all_]).std(0), "sd_w": np.stack([f["w_e"] for f in all_]).std(0)}

    return _batchwise(frames, x, ", ".join([f"cv_{b} double" for b in range(level + 1)] + ["sd_r double", "sd_w double"]), work)


def boundary_weights(spark: SparkSession, n: int = 64, level: int = 3, transform: str = "dtcwt") -> DataFrame:
    """Per low coefficient: the share of its weight that falls on extended samples, and its share of the recency weights of mu_L."""
    whole, _ = W.matrices(transform, n, level, "symmetric")
    inner, _ = W.matrices(transform, n, level, "zero")
    total, w = np.abs(whole).sum(1), W.recency(len(whole))
    rows = [(i, float(np.abs(whole[i] - inner[i]).sum() / total[i]), float(w[i] / w.sum())) for i in range(len(whole))]
    return spark.createDataFrame(rows, "coefficient int, outside double, weight double")


def boundary_effect(frames: DataFrame, x: str = "x_w", level: int = 3, target: int = 64) -> DataFrame:
    """Per low coefficient, over all windows: mean of the coefficient, mean change if samples outside count as zero, and the weights of boundary_weights."""
    low = lambda how, name: wavelet_features(frames.select("window_id", "item_id", x), x, level, "dtcwt", how, target=target).select("window_id", "item_id", F.col("low").alias(name))
    both = low("symmetric", "a").join(low("zero", "b"), ["window_id", "item_id"]).select(F.posexplode(F.arrays_zip("a", "b")).alias("coefficient", "v"))
    means = both.groupBy("coefficient").agg(F.avg("v.a").alias("mean"), F.avg(F.abs(F.col("v.a") - F.col("v.b"))).alias("change"))
    return means.join(F.broadcast(boundary_weights(frames.sparkSession, target, level)), "coefficient")


def nlms_convergence(features: DataFrame) -> DataFrame:
    """Per method and place t: median and 90 % quantile (by sketch) of the one-step error over mu_L, of NLMS and of AR(2)."""

    def work(a: np.ndarray) -> dict[str, np.ndarray]:
        level = np.maximum(W.recency_mean(a), 1e-12)[:, None]
        return {"NLMS": W.nlms_errors(a) / level, "YW": W.yule_walker_errors(a) / level}

    rows = _batchwise(features.select("low"), "low", "NLMS array<double>, YW array<double>", work)
    both = rows.select(F.explode(F.create_map(F.lit("NLMS"), "NLMS", F.lit("YW"), "YW")).alias("method", "errors"))
    return both.select("method", F.posexplode("errors").alias("t", "e")).groupBy("method", (F.col("t") + 3).alias("t")).agg(F.percentile_approx("e", 0.5, 10000).alias("median"), F.percentile_approx("e", 0.9, 10000).alias("q90"), F.count("*").alias("n"))
