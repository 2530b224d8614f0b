"""A learned ranker: features of windows, leak-free training rows, leaf-wise boosted trees."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wavelets as W
from . import boosting as B

#: Slots that are summed, and the names of the features.
SUMS = (1, 2, 4, 8, 16, 32, 64)
FEATURES = (*(f"sum_{k}" for k in SUMS), "slope_16", "zero_share")


def window_features(x: Column) -> dict[str, Column]:
    """log1p sums of the newest 1, 2, 4, ... 64 slots, least-squares slope of the newest 16, share of zeros."""
    n = F.size(x)

    def tail(k: int) -> Column:
        m = F.least(F.lit(k), n)
        return F.slice(x, -m, m)

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    out = {f"sum_{k}": F.log1p(total(tail(k))) for k in SUMS}
    last = tail(16)
    m = F.size(last)
    middle = (m - 1) / 2
    squares = m * (m * m - 1) / 12.0
    out["slope_16"] = F.coalesce(total(F.transform(last, lambda v, i: v * (i - middle))) / F.nullif(squares, F.lit(0.0)), F.lit(0.0))
    out["zero_share"] = total(F.transform(x, lambda v: F.when(v == 0, 1.0).otherwise(0.0))) / n
    return out


def of_matrix(m: np.ndarray) -> dict[str, np.ndarray]:
    """window_features of windows of one size as the rows of a matrix."""
    out = {f"sum_{k}": np.log1p(m[:, -k:].sum(1)) for k in SUMS}
    last = m[:, -16:]
    n = last.shape[1]
    out["slope_16"] = last @ (np.arange(n) - (n - 1) / 2) / (n * (n * n - 1) / 12.0) if n > 1 else np.zeros(len(m))
    out["zero_share"] = (m == 0).sum(1) / m.shape[1]
    return out


def features_of(*transform: str, target: int = 64) -> tuple[tuple[str, ...], Callable[[np.ndarray], dict[str, np.ndarray]]]:
    """Names of window_features and of the transform's features named, and the function that makes them of a matrix of windows."""

    def work(m: np.ndarray) -> dict[str, np.ndarray]:
        made = W.features(W.pad_left(m, target, "reflect"))
        return of_matrix(m) | {c: made[c] for c in transform}

    return (*FEATURES, *transform), work


def predictions_of(models: Broadcast, features: Callable[[np.ndarray], dict[str, np.ndarray]]) -> tuple[tuple[str, ...], Callable[[np.ndarray], dict[str, np.ndarray]]]:
    """Names of the models, and the function that makes their predictions of a matrix of windows; features leave no task."""

    def work(m: np.ndarray) -> dict[str, np.ndarray]:
        found = features(m)
        return {name: model.predict(np.stack([found[c] for c in model.features], axis=1)) for name, model in models.value.items()}

    return tuple(models.value), work


def first_test_window(frames: DataFrame, share: float = 0.3) -> int | None:
    """The first window after the first floor(share n) ones."""
    from .grid import time_split

    return time_split(frames.select("window_id"), share).where("part = 'test'").agg(F.min("window_id")).first()[0]


def sample_order(seed: int = 42) -> Column:
    """A number below 2**48 for each row of a window and item, the same on every run."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("window_id").cast("string"), "item_id")
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def training_rows(frames: DataFrame, first_test: int, horizon: int = 1, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Rows of windows whose truth ends before the first test window, all or, if asked for, `sample` of them in hash order; label log1p(truth).

    Numbers are spread evenly, so rows far above the share that is wanted are left out before the
    order is made; the rest is sorted and cut exactly.
    """
    rows = frames.where(F.col("window_id") + horizon - 1 < first_test).withColumn("label", F.log1p("truth"))
    if sample is None:
        return rows
    rows = rows.withColumn("draw", sample_order(seed))
    n = rows.count()
    if n <= sample:
        return rows.drop("draw")
    limit = min(1.0, sample / n + 8 * (sample / n / n) ** 0.5 + 8 / n)
    some = rows.where(F.col("draw") <= F.lit(int(limit * 2**48)))
    if some.count() < sample:
        some = rows
    return some.orderBy("draw", "window_id", "item_id").limit(sample).drop("draw")


def fit_rankers(train: DataFrame, feature_sets: dict[str, list[str]], settings: B.Settings = B.Settings()) -> dict[str, B.Model]:
    """Boosted trees on log1p of the truth for each set of features, fitted on the same rows."""
    return B.fit(train, feature_sets, "label", ["window_id", "item_id"], settings)


def scores(models: dict[str, B.Model]) -> dict[str, Column]:
    """The score of each model over its prediction: expm1, at least zero."""
    return {m: F.greatest(F.expm1(f"`{m}`"), F.lit(0.0)) for m in models}


def score(models: dict[str, B.Model], frames: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., method, score) of each model: expm1 of the prediction, at least zero."""
    from .ranking import to_long

    out = B.predicted(frames, models)
    return to_long(out.select(*keep, *[c.alias(m) for m, c in scores(models).items()]), list(models), keep)
