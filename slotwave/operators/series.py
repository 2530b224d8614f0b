"""Windows made inside tasks from whole series: a row for each item and slot that counts comes in, one for each item and window goes out.

Counts are exchanged once, by blocks of items; no array of a window leaves its task unless asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (items times slots) that a task works on at once, cells of one partition, and windows of one matrix.
BLOCK, CELLS, MATRIX = 1 << 17, 1 << 21, 1 << 14


@dataclass(frozen=True)
class Part:
    """Columns made of the newest `length` slots of the items with `least` observed ones; work maps a matrix of windows to named columns.

    Without work, a name is a column of the windows themselves; without names, the rows that fit are all there is.
    """

    length: int
    least: int
    names: tuple[str, ...]
    work: Callable[[np.ndarray], dict[str, np.ndarray]] | None = None

    def kind(self) -> str:
        return "double" if self.work else "array<double>"


def partitions(rows: DataFrame, wanted: int) -> int:
    """The session's number of partitions, or `wanted` where that is more."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def spread(rows: DataFrame, by: str, most: int = 1 << 20) -> DataFrame:
    """rows in as many partitions by a column as keep them at about `most` rows; few rows stay as they are."""
    wanted = -(-rows.count() // most)
    return rows.repartition(wanted, by) if wanted > partitions(rows, 0) else rows


def cells(t: pa.Table, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Items, and their values and whether there is one, as matrices (items x slots). Two rows of an item and slot raise an error."""
    coded = t["item_id"].combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + t["slot"].to_numpy()
    values, present = np.zeros(len(coded.dictionary) * n), np.zeros(len(coded.dictionary) * n, np.int64)
    here = np.bincount(at, minlength=len(values))
    if (here > 1).any():
        raise ValueError("several rows of one item and slot")
    present[at] = np.asarray(t["v"].is_valid())
    values[at] = np.nan_to_num(t["v"].to_numpy())
    return coded.dictionary, values.reshape(-1, n), present.reshape(-1, n)


def _before(m: np.ndarray) -> np.ndarray:
    """Totals of the earlier columns."""
    return np.concatenate([np.zeros((len(m), 1), m.dtype), np.cumsum(m, 1)[:, :-1]], 1)


def _lists(values: np.ndarray, i: np.ndarray, k: np.ndarray, length: int) -> pa.Array:
    """The windows of rows i before slots k."""
    sizes = np.minimum(k, length)
    ends = np.cumsum(sizes)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(i * values.shape[1] + k - ends, sizes)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.ravel()[place]))


def _columns(values: np.ndarray, i: np.ndarray, k: np.ndarray, part: Part) -> dict[str, np.ndarray]:
    """The columns of a part for the windows of rows i before slots k, windows of one size at a time."""
    out = {name: np.empty(len(i)) for name in part.names}

    def put(at: np.ndarray, m: np.ndarray) -> None:
        made = part.work(m)
        for name in part.names:
            out[name][at] = made[name]

    whole = np.flatnonzero(k >= part.length)
    if len(whole):
        view = np.lib.stride_tricks.sliding_window_view(values, part.length, axis=1)
        for lo in range(0, len(whole), MATRIX):
            at = whole[lo : lo + MATRIX]
            put(at, view[i[at], k[at] - part.length])
    short = np.flatnonzero(k < part.length)
    for size in np.unique(k[short]):
        at = short[k[short] == size]
        put(at, values[i[at], :size])
    return out


def windows(counts: DataFrame, last: int, n_items: int, parts: list[Part], horizon: int | tuple[int, ...], min_total: float, step: int = 1, together: bool = False, since: int = 0, until: int | None = None) -> DataFrame:
    """Rows (window_id, item_id, truth, columns of the parts) from counts (item_id, slot, v) of slots 0 to `last`.

    As grid.frames, in_time and eligible have them: slots without a row count as zero, the truth is
    the total of the next `horizon` slots, which must all lie on the grid, and an item needs
    min_total before the window. Columns of a part are null where its slots are too few; a row
    with none at all is left out, with `together` one that lacks any. Every step-th window is made,
    from window `since` on and before window `until`.

    Of several horizons there are columns truth_<horizon>, null where that future leaves the grid.
    """
    n = last + 1
    blocks = -(-n_items * n // BLOCK)
    spread_over = partitions(counts, -(-n_items * n // CELLS))
    blocks = max(blocks, min(n_items, 2 * spread_over), 1)
    end = n if until is None else until
    kinds = [(name, p.kind()) for p in parts for name in p.names]
    truths = {horizon: "truth"} if isinstance(horizon, int) else {h: f"truth_{h}" for h in horizon}
    schema = "window_id int, item_id string" + "".join(f", {t} double" for t in truths.values()) + "".join(f", `{name}` {kind}" for name, kind in kinds)

    def run(t: pa.Table) -> pa.Table:
        items, values, present = cells(t, n)
        slot = np.arange(n)
        seen = _before(present)
        inside = (slot > 0) & (slot + min(truths) - 1 <= last) & (slot % step == 0) & (slot >= since) & (slot < end) & (_before(values) >= min_total)
        fits = [inside & (seen - seen[:, np.maximum(slot - p.length, 0)] >= p.least) for p in parts]
        rows = np.logical_and.reduce(fits) if together else np.logical_or.reduce(fits)
        i, k = np.nonzero(rows)
        out = [pa.array(k.astype(np.int32)), items.take(pa.array(i))]
        for h in truths:
            total = np.zeros_like(values)
            for j in range(min(h, n)):
                total[:, : n - j] += values[:, j:]
            out.append(pa.array(total[i, k], pa.float64(), mask=k + h - 1 > last))
        for p, fit in zip(parts, fits, strict=True):
            has = fit[i, k]
            if p.work is None:
                out += [_lists(values, i, k, p.length) for _ in p.names]
                continue
            made = _columns(values, i[has], k[has], p)
            for name in p.names:
                column = np.zeros(len(i))
                column[has] = made[name]
                out.append(pa.array(column, mask=~has))
        return pa.table(out, names=["window_id", "item_id", *truths.values(), *[name for name, _ in kinds]])

    dealt = counts.select("item_id", "slot", "v", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.repartition(spread_over, "block").groupBy("block").applyInArrow(run, schema)
