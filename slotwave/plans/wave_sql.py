"""SQL of transforms, their features, coefficient forecasts, metric rows and summaries.

A transform is worked out in SQL as a cascade of filters over unit vectors; the resulting rows
of weights are applied to the padded windows by dot products.
"""

from __future__ import annotations

import numpy as np

from ..functions import wavelets as W
from . import checks_sql as Q

#: Slots of a padded window, unless said otherwise.
N = 64


def doubles(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def recency(n: int) -> str:
    return doubles(2.0 ** -np.arange(n)[::-1])


def _inside(at: str, n: str, how: str) -> str:
    """Place inside 0..n-1 that stands for a place; -1 for none."""
    wrap = lambda p: f"(((({at}) % ({p})) + ({p})) % ({p}))"
    return {
        "symmetric": f"least({wrap(f'2 * {n}')}, 2 * {n} - 1 - {wrap(f'2 * {n}')})",
        "reflect": f"least({wrap(f'2 * {n} - 2')}, 2 * {n} - 2 - {wrap(f'2 * {n} - 2')})",
        "edge": f"greatest(0, least({n} - 1, {at}))",
        "periodic": wrap(n),
        "zero": f"CASE WHEN ({at}) < 0 OR ({at}) >= {n} THEN -1 ELSE {at} END",
    }[how]


def padded(name: str = "fr", how: str = "reflect", size: int = N) -> str:
    """px: each window's values, oldest first, filled up on the left to `size`."""
    at = _inside(f"j - ({size} - n)", "n", how)
    value = f"CASE WHEN {at} < 0 THEN 0.0 ELSE x[1 + {at}] END"
    return f"""xs AS (SELECT window_id, item_id, max(truth) AS truth, max(n) AS n, list(v ORDER BY i DESC) AS x FROM {name}_x GROUP BY 1, 2),
px AS (SELECT window_id, item_id, truth, CASE WHEN n >= {size} THEN x ELSE list_transform(range(0, {size}), lambda j: {value}) END AS x FROM xs)"""


def _filter(out: str, source: str, n: int, rows: int, taps, start: str, how: str, stride: int = 1, place: str = "t") -> str:
    """Rows (k, pos, w): weight of input k in output pos of a filter over the rows of source."""
    values = ", ".join(f"({q}, {float(w)!r}::DOUBLE)" for q, w in enumerate(taps))
    return f"""{out}_o AS (SELECT {place} AS pos, {_inside(f"{start} + {stride} * q", str(n), how)} AS src, sum(w) AS w FROM (SELECT unnest(range(0, {rows})) AS t), (VALUES {values}) taps(q, w) GROUP BY 1, 2),
{out} AS (SELECT s.k, o.pos, sum(s.w * o.w) AS w FROM {out}_o o JOIN {source} s ON s.pos = o.src GROUP BY 1, 2)"""


def dual_tree(level: int = 3, how: str = "symmetric", tag: str = "d", slots: int = N) -> tuple[str, str]:
    """CTEs of the dual-tree transform and a query of its rows (band, pos, k, w); band 0 is the low-pass, others finest first."""
    qa = np.array(W.QSHIFT_LOW)
    qb = qa[::-1]
    ha = qb * np.array([1.0, -1.0] * 5)
    ctes = [f"{tag}e AS (SELECT k, k AS pos, 1.0::DOUBLE AS w FROM (SELECT unnest(range(0, {slots})) AS k))"]
    ctes += [_filter(f"{tag}h1", f"{tag}e", slots, slots, W.NEAR_SYM_HIGH[::-1], "t - 3", how), _filter(f"{tag}l1", f"{tag}e", slots, slots, W.NEAR_SYM_LOW[::-1], "t - 2", how)]
    bands, low, size = [(1, f"{tag}h1")], f"{tag}l1", slots
    for j in range(2, level + 1):
        if size % 4:
            ctes.append(f"{low}p AS (SELECT k, pos + 1 AS pos, w FROM {low} UNION ALL SELECT k, 0, w FROM {low} WHERE pos = 0 UNION ALL SELECT k, {size} + 1, w FROM {low} WHERE pos = {size} - 1)")
            low, size = f"{low}p", size + 2
        made = {}
        for kind, a, b in (("h", ha[::-1], ha), ("l", qb, qa)):
            first = (a * b).sum() > 0
            parts = []
            for nth, taps, shift in ((0, a, 2), (1, b, 3)):
                name = f"{tag}{kind}{j}t{nth}"
                side = nth if first else 1 - nth
                ctes.append(_filter(name, low, size, size // 4, taps[::-1], f"4 * t - 10 + {shift}", how, 2, f"2 * t + {side}"))
                parts.append(f"SELECT * FROM {name}")
            made[kind] = f"{tag}{kind}{j}"
            ctes.append(f"{made[kind]} AS ({' UNION ALL '.join(parts)})")
        bands.append((j, made["h"]))
        low, size = made["l"], size // 2
    return ",\n".join(ctes), " UNION ALL ".join(f"SELECT {b} AS band, pos, k, w FROM {t}" for b, t in [(0, low), *bands])


def daubechies(level: int = 3, how: str = "symmetric", tag: str = "w", slots: int = N) -> tuple[str, str]:
    """The same for the decimated transform."""
    low_taps = np.array(W.DB4_LOW)
    high_taps = low_taps[::-1] * np.array([-1.0, 1.0] * 4)
    ctes = [f"{tag}e AS (SELECT k, k AS pos, 1.0::DOUBLE AS w FROM (SELECT unnest(range(0, {slots})) AS k))"]
    bands, low, size = [], f"{tag}e", slots
    for j in range(1, level + 1):
        rows = size // 2 if how == "periodization" else (size + 7) // 2
        start, mode = ("2 * t - 3", "periodic") if how == "periodization" else ("2 * t - 6", how)
        ctes += [_filter(f"{tag}h{j}", low, size, rows, high_taps[::-1], start, mode), _filter(f"{tag}l{j}", low, size, rows, low_taps[::-1], start, mode)]
        bands.append((j, f"{tag}h{j}"))
        low, size = f"{tag}l{j}", rows
    return ",\n".join(ctes), " UNION ALL ".join(f"SELECT {b} AS band, pos, k, w FROM {t}" for b, t in [(0, low), *bands])


def features(level: int = 3, transform: str = "dtcwt", how: str = "symmetric", tag: str = "f", source: str = "px", slots: int = N) -> str:
    """fe_<tag>: window_id, item_id, truth, a (low-pass magnitudes), e0 ... , mu_l, r, w_e, d, h_q, e_tot, af, slope."""
    ctes, rows = (dual_tree if transform == "dtcwt" else daubechies)(level, how, f"{tag}_", slots)
    pair = "pos // 2" if transform == "dtcwt" else "pos"
    e = [f"sum(CASE WHEN band = {b} THEN c * c ELSE 0 END)" for b in range(level + 1)]
    term = lambda p: f"(CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0 END)"
    whole = " + ".join(f"e{b}" for b in range(level + 1))
    detail = " + ".join(f"e{b}" for b in range(1, level + 1))
    entropy = " + ".join(term(f"e{b} / e_tot") for b in range(level + 1))
    inner = " + ".join(term(f"e{b} / detail") for b in range(1, level + 1))
    return f"""{ctes},
{tag}_all AS ({rows}),
{tag}_m AS (SELECT g.band, g.pos, list(coalesce(a.w, 0) ORDER BY g.k) AS w FROM (SELECT band, pos, k FROM (SELECT DISTINCT band, pos FROM {tag}_all), (SELECT unnest(range(0, {slots})) AS k)) g LEFT JOIN {tag}_all a ON a.band = g.band AND a.pos = g.pos AND a.k = g.k GROUP BY 1, 2),
{tag}_c AS (SELECT window_id, item_id, truth, band, pos, list_dot_product(x, w) AS c FROM {source}, {tag}_m),
{tag}_s AS (SELECT window_id, item_id, max(truth) AS truth, list(abs(c) ORDER BY pos) FILTER (band = 0) AS a, {", ".join(f"{x} AS e{b}" for b, x in enumerate(e))} FROM {tag}_c GROUP BY 1, 2),
{tag}_p AS (SELECT window_id, item_id, {pair} AS p, sqrt(sum(c * c)) AS mag FROM {tag}_c WHERE band = 1 GROUP BY 1, 2, 3),
{tag}_g AS (SELECT window_id, item_id, list_reduce(list(mag ORDER BY p), lambda s, v: s / 2 + v) AS af1 FROM {tag}_p GROUP BY 1, 2),
{tag}_t AS (SELECT *, {whole} AS e_tot, {detail} AS detail, list_reduce(a, lambda s, v: s / 2 + v) AS af0, len(a) AS n FROM {tag}_s),
fe_{tag} AS (SELECT t.window_id, t.item_id, t.truth, a, n, {", ".join(f"e{b}" for b in range(level + 1))}, e_tot, af0 / (2 - pow(0.5, n - 1)) AS mu_l, CASE WHEN e_tot > 0 THEN e0 / e_tot ELSE 0 END AS r,
  CASE WHEN e_tot > 0 THEN ({entropy}) / log2({level} + 1) ELSE 0 END AS w_e, CASE WHEN detail > 0 THEN ({inner}) / log2({max(level, 2)}) ELSE 0 END AS d, CASE WHEN detail > 0 THEN {inner} ELSE 0 END AS h_q, af0 + 0.1 * af1 AS af,
  list_dot_product(a, list_transform(range(0, n), lambda i: i - (n - 1) / 2.0)) / (n * (n * n - 1) / 12.0) / greatest(list_avg(a), 1e-8) AS slope
  FROM {tag}_t t JOIN {tag}_g USING (window_id, item_id))"""


def index(alpha: float = 1.0, beta: float = 1.0) -> str:
    return f"mu_l * exp({alpha} * r - {beta} * w_e)"


#: Fusions of the features.
FUSIONS = {"full": index(), "trend": "mu_l", "R": "mu_l * exp(r)", "WE": "mu_l * exp(-w_e)", "linear": "mu_l * (1 + r - w_e)", "product": "mu_l * r * (1 - w_e)", "additive": "mu_l + r - w_e"}


def scores(columns: dict[str, str], source: str) -> str:
    """Rows (window_id, item_id, truth, method, score) of a table's expressions."""
    return " UNION ALL ".join(f"SELECT window_id, item_id, truth, '{k}' AS method, round(CAST({x} AS DOUBLE), 9) AS score FROM {source}" for k, x in columns.items())


def _yule_walker(out: str, source: str, column: str, steps: int) -> str:
    """out: source's rows plus f, the list of forecasts of AR(2) by Yule-Walker, the last value where the fit is rejected."""
    ahead, value = [], ["nw", "od"]
    for _ in range(steps):
        value = [f"(p1 * {value[0]} + p2 * {value[1]})", value[0]]
        ahead.append(f"CASE WHEN good THEN {value[0]} + m ELSE last END")
    return f"""{out}1 AS (SELECT *, list_avg({column}) AS m, len({column}) AS k FROM {source}),
{out}2 AS (SELECT *, list_transform({column}, lambda v: v - m) AS dev FROM {out}1),
{out}3 AS (SELECT *, list_dot_product(dev, dev) / k AS r0, list_dot_product(dev[1:k - 1], dev[2:k]) / k AS r1, list_dot_product(dev[1:k - 2], dev[3:k]) / k AS r2, dev[k] AS nw, dev[k - 1] AS od, {column}[k] AS last FROM {out}2),
{out}4 AS (SELECT *, (r0 + 1e-8) * (r0 + 1e-8) - r1 * r1 AS det FROM {out}3),
{out}5 AS (SELECT *, r1 * (r0 + 1e-8 - r2) / nullif(det, 0) AS p1, ((r0 + 1e-8) * r2 - r1 * r1) / nullif(det, 0) AS p2 FROM {out}4),
{out}6 AS (SELECT *, coalesce(r0 > 1e-12 AND isfinite(p1) AND isfinite(p2) AND abs(p1) + abs(p2) <= 4, false) AS good FROM {out}5),
{out} AS (SELECT *, [{", ".join(ahead)}] AS f FROM {out}6)"""


def _clamped(raw: str, anchor: str, c: float | None) -> str:
    if c is None:
        return f"greatest({raw}, 0)"
    return f"(CASE WHEN {anchor} > 0 THEN greatest({anchor} * least(greatest(({raw}) / nullif({anchor}, 0), {1 / c!r}), {c!r}), 0) ELSE 0 END)"


def _extended(raw: list[str], c: float | None, anchor: str = "a[16]") -> str:
    """Recency mean of a with its forecasts."""
    n = 16 + len(raw)
    return f"list_dot_product(list_concat(a, [{', '.join(_clamped(x, anchor, c) for x in raw)}]), {recency(n)}) / {float((2.0 ** -np.arange(n)).sum())!r}"


def forecasts(horizon: int = 1, clamps: tuple[float, ...] = (4.0,), source: str = "fe_f") -> str:
    """fo: source's rows plus mu_nlms_c4, mu_yw_c4, mu_ts_c4, mu_level_c4 (one for each clamp), mu_yw_free, mu_mean_free, mu_mean_level, s_f, s_mu; sixteen low-pass values."""
    m = max(1, -(-horizon // 4))
    tails = [f"tail[{j + 1}]" for j in range(m)]
    late = 2.0 ** -np.arange(m)[::-1]
    s_f = " + ".join(f"{w} * abs({_clamped(f'f[{j + 1}]', 'last', 4.0)} - {t})" for j, (w, t) in enumerate(zip(late, tails, strict=True)))
    mean = "list_dot_product(head, wh) / list_sum(wh)"
    s_mu = " + ".join(f"{w} * abs({mean} - {t})" for w, t in zip(late, tails, strict=True))
    nlms, step = [], ["u[1]", "u[2]"]
    total = "a[16]"
    for _ in range(m):
        step = [f"(wt[1] * {step[0]} + wt[2] * {step[1]})", step[0]]
        total = f"({total} + {step[0]})"
        nlms.append(total)
    line = [f"base + incline * {16 + j}" for j in range(m)]
    made = {"nlms": nlms, "yw": [f"f[{j + 1}]" for j in range(m)], "ts": line, "level": ["(a[15] + a[16]) / 2"] * m}
    mean = ["list_avg(a)"] * m
    columns = [f"{_extended(raw, c)} AS mu_{k}_c{c:g}" for k, raw in made.items() for c in clamps]
    columns += [f"{_extended(made['yw'], None)} AS mu_yw_free", f"{_extended(mean, None)} AS mu_mean_free", f"{_extended(mean, 4.0, 'mu_l')} AS mu_mean_level"]
    return f"""ba AS (SELECT window_id, item_id, a[1:t] AS head, a[t + 1:t + {m}] AS tail, ({recency(16)})[17 - t:16] AS wh FROM {source}, (VALUES ({16 - m - 1}), ({16 - m})) o(t)),
{_yule_walker("bb", "ba", "head", m)},
bt AS (SELECT window_id, item_id, sum({s_f}) AS s_f, sum({s_mu}) AS s_mu FROM bb GROUP BY 1, 2),
{_yule_walker("ya", source, "a", m)},
pairs AS (SELECT window_id, item_id, median((a[j] - a[i]) / (j - i)) AS incline FROM {source}, (SELECT i, j FROM (SELECT unnest(range(1, 17)) AS i), (SELECT unnest(range(1, 17)) AS j) WHERE i < j) GROUP BY 1, 2),
tb AS (SELECT window_id, item_id, incline, median(a[i] - incline * (i - 1)) AS base FROM (SELECT window_id, item_id, a, unnest(range(1, 17)) AS i FROM {source}) JOIN pairs USING (window_id, item_id) GROUP BY 1, 2, 3),
nl AS (SELECT window_id, item_id, [a[16] - a[15], a[15] - a[14]] AS u, list_reduce(list_transform(range(4, 17), lambda k: [a[k - 1] - a[k - 2], a[k - 2] - a[k - 3], a[k] - a[k - 1]]), lambda s, x: [s[1] + 0.2 * (x[3] - s[1] * x[1] - s[2] * x[2]) / (x[1] * x[1] + x[2] * x[2] + 1e-8) * x[1], s[2] + 0.2 * (x[3] - s[1] * x[1] - s[2] * x[2]) / (x[1] * x[1] + x[2] * x[2] + 1e-8) * x[2], 0], [0, 0, 0]::DOUBLE[]) AS wt FROM {source}),
fo AS (SELECT y.*, s_f, s_mu, {", ".join(columns)} FROM ya y JOIN bt USING (window_id, item_id) JOIN tb USING (window_id, item_id) JOIN nl USING (window_id, item_id))"""


GATE = "CASE WHEN s_mu > 1e-9 * mu_l * 2 THEN greatest(0, 1 - s_f / nullif(s_mu, 0)) ELSE 0 END"


def skill(kappa: float) -> str:
    tol = "(1e-9 * mu_l * 2)"
    return f"CASE WHEN s_f > {tol} THEN least(1, {kappa} * (CASE WHEN s_mu > {tol} THEN s_mu ELSE 0 END) / nullif(s_f, 0)) ELSE 1 END"


def structural(gamma: float = 0.3) -> str:
    return f"pow(greatest(0, least(1, r * (1 - w_e))), {gamma})"


def forecast_index(mu_hat: str, share: str = "1.0", power: str = "r - w_e") -> str:
    return f"CASE WHEN mu_l <= 1e-12 THEN 0 ELSE mu_l * pow((CASE WHEN {mu_hat} > 1e-12 THEN {mu_hat} ELSE mu_l END) / greatest(mu_l, 1e-12), {share}) * exp({power}) END"


FORECAST_SCORES = {
    "WSPI-F": forecast_index("mu_nlms_c4"), "WSPI-FYW": "mu_yw_free * exp(r - w_e)", "WSPI-F2": forecast_index("mu_yw_c4", structural()), "WSPI-FT": forecast_index("mu_ts_c4"), "WSPI-FG": forecast_index("mu_yw_c4", GATE),
    "WSPI-S": forecast_index("mu_level_c4"), "WSPI-M": "mu_mean_free * exp(r - w_e)", "WSPI-H": forecast_index("mu_mean_level"), "WSPI-HL": forecast_index("mu_mean_level", power="0"),
}
SKILLED = {f"WSPI-FS{k:g}": forecast_index("mu_yw_c4", f"{structural()} * {skill(k)}") for k in (1.0, 1.5, 2.0, 3.0)}
SENSITIVE = {f"WSPI-F2_c{c:g}_g{g:g}_p{p:g}": forecast_index(f"mu_yw_c{c:g}", f"{p} * {structural(g)}") for c in (2.0, 4.0, 8.0) for g in (0.1, 0.3, 0.5) for p in (0.8, 1.0)}


def protocol(ks: tuple[int, ...] = (5, 10, 20)) -> str:
    """pr: metric rows of sc (window_id, item_id, truth, method, score)."""
    most = max(ks)
    shared = ", ".join(f"count(CASE WHEN a.rank <= {k} AND b.rank <= {k} THEN 1 END) AS c{k}" for k in ks)
    rsi = ", ".join(f"CASE WHEN w.prev IS NOT NULL THEN CAST(coalesce(c{k}, 0) AS DOUBLE) / (least({k}, m.num_items) + least({k}, b.num_items) - coalesce(c{k}, 0)) END AS rsi_{k}" for k in ks)
    return f"""{Q.RANKED},
rk AS (SELECT *, lag(score) OVER (PARTITION BY window_id, method ORDER BY score DESC, item_id) = score AS tied, rank() OVER (PARTITION BY window_id, method ORDER BY score) + (count(*) OVER (PARTITION BY window_id, method, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY window_id, method ORDER BY truth) + (count(*) OVER (PARTITION BY window_id, method, truth) - 1) / 2.0 AS rt FROM ranked),
met AS (SELECT window_id, method, count(*) AS num_items, {", ".join(f"{Q.ndcg(k)} AS ndcg_{k}, {Q.coverage(k)} AS coverage_{k}" for k in ks)}, avg(abs(score - truth)) AS mae, CASE WHEN max(score) - min(score) >= 1e-12 AND max(truth) - min(truth) >= 1e-12 THEN corr(rs, rt) END AS spearman_rho, coalesce(bool_or(tied AND rank <= 21), false) AS ties_top21 FROM rk GROUP BY 1, 2),
wn AS (SELECT method, window_id, lag(window_id) OVER (PARTITION BY method ORDER BY window_id) AS prev FROM met),
tp AS (SELECT method, window_id, item_id, rank FROM ranked WHERE rank <= {most}),
sh AS (SELECT w.method, w.window_id, {shared} FROM wn w JOIN tp a ON a.method = w.method AND a.window_id = w.window_id JOIN tp b ON b.method = w.method AND b.window_id = w.prev AND b.item_id = a.item_id GROUP BY 1, 2),
pr AS (SELECT m.*, {rsi} FROM met m JOIN wn w USING (method, window_id) LEFT JOIN met b ON b.method = w.method AND b.window_id = w.prev LEFT JOIN sh ON sh.method = w.method AND sh.window_id = w.window_id)"""


METRICS = tuple(f"{m}_{k}" for m in ("ndcg", "coverage", "rsi") for k in (5, 10, 20)) + ("mae", "spearman_rho")


def summary(metrics: tuple[str, ...] = METRICS, source: str = "pr", extra: str = "") -> str:
    columns = ", ".join(f"{Q.r6(f'avg({m})')} AS {m}_mean, {Q.r6(f'stddev_samp({m})')} AS {m}_sd" for m in metrics)
    return f"SELECT {extra}method, count(*) AS n_windows, min(window_id) AS first_window, max(window_id) AS last_window, {columns}, {Q.r6('avg(CASE WHEN ties_top21 THEN 1.0 ELSE 0.0 END)')} AS ties_top21_share, CAST(0 AS BIGINT) AS n_nonfinite_total FROM {source} GROUP BY {extra}method"
