"""SQL of paired comparisons: signed ranks with exact and normal p values, Holm's correction, verdicts, cells."""

from __future__ import annotations

from . import checks_sql as Q
from . import wave_sql as WS

LOWER = "('mae', 'distortion', 'mape')"


def long_metrics(metrics: tuple[str, ...], keys: str = "", source: str = "pr") -> str:
    """lm: (keys, method, window_id, metric, value) at nine digits."""
    return "lm AS (" + " UNION ALL ".join(f"SELECT {keys}method, window_id, '{m}' AS metric, round({m}, 9) AS value FROM {source} WHERE {m} IS NOT NULL" for m in metrics) + ")"


def pairs(reference: str, keys: tuple[str, ...] = ()) -> str:
    """df: (keys, metric, method, window_id, ref, val, d); d is positive where the reference is better."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in (*keys, "metric", "window_id"))
    return f"df AS (SELECT {''.join(f'b.{k}, ' for k in keys)}b.metric, b.method, b.window_id, a.value AS ref, b.value AS val, round((a.value - b.value) * CASE WHEN b.metric IN {LOWER} THEN -1 ELSE 1 END, 9) AS d FROM lm a JOIN lm b ON {on} WHERE a.method = '{reference}' AND b.method <> '{reference}')"


def blocks(size: int, by: str, out: str = "bl") -> str:
    """Means of full blocks of consecutive windows, at twelve digits."""
    return f"{out} AS (SELECT {by}, k // {size} AS block, round(avg(d), 12) AS d FROM (SELECT {by}, d, row_number() OVER (PARTITION BY {by} ORDER BY window_id) - 1 AS k FROM df) GROUP BY {by}, k // {size} HAVING count(*) = {size})"


def bootstrap(out: str, source: str, by: str, value: str, block: int, draws: int = 10_000, seed: int = 42) -> str:
    """out: (by, ci_low, ci_high) of the mean by circular block draws: running totals over the values taken twice, joined at both ends of each block."""
    keys = [k.strip() for k in by.split(",")]
    same = " AND ".join(f"a.{k} = z.{k}" for k in keys)
    of_a = ", ".join(f"a.{k}" for k in keys)
    return f"""{out}_v AS (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY window_id) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
{out}_p AS (SELECT {by}, n, i + 1 AS i, sum(v) OVER (PARTITION BY {by} ORDER BY i) AS s FROM (SELECT {by}, n, i, v FROM {out}_v UNION ALL SELECT {by}, n, i + n, v FROM {out}_v) UNION ALL SELECT DISTINCT {by}, n, 0, 0.0::DOUBLE FROM {out}_v),
{out}_n AS (SELECT n, b, CAST(ceil(n / b::DOUBLE) AS BIGINT) AS k FROM (SELECT DISTINCT n, least({block}, n) AS b FROM {out}_v)),
{out}_d AS (SELECT n, draw, CAST('0x' || substr(md5('{seed}:' || n || ':{block}:' || draw || ':' || j), 1, 12) AS BIGINT) % n AS s, CASE WHEN j = k - 1 THEN n - (k - 1) * b ELSE b END AS len FROM (SELECT *, unnest(range(0, k)) AS j FROM (SELECT *, unnest(range(0, {draws})) AS draw FROM {out}_n))),
{out}_m AS (SELECT {of_a}, d.draw, sum(z.s - a.s) / max(d.n) AS m FROM {out}_d d JOIN {out}_p a ON a.n = d.n AND a.i = d.s JOIN {out}_p z ON {same} AND z.i = d.s + d.len GROUP BY {of_a}, d.draw),
{out} AS (SELECT {by}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM {out}_m GROUP BY {by})"""


def cluster_bootstrap(out: str, source: str, by: str, value: str, cluster: str, draws: int = 10_000, seed: int = 42) -> str:
    """out: (by, n_clusters, mean, ci_low, ci_high), clusters drawn with replacement."""
    return f"""{out}_c AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n, s, k FROM (SELECT {by}, {cluster} AS c, sum({value})::DOUBLE AS s, count(*)::DOUBLE AS k FROM {source} GROUP BY 1, 2)),
{out}_d AS (SELECT n, draw, CAST('0x' || substr(md5('{seed}:' || n || ':' || draw || ':' || j), 1, 12) AS BIGINT) % n AS i FROM (SELECT n, draw, unnest(range(0, n)) AS j FROM (SELECT n, unnest(range(0, {draws})) AS draw FROM (SELECT DISTINCT n FROM {out}_c)))),
{out}_m AS (SELECT {by}, draw, sum(s) / sum(k) AS m FROM {out}_d JOIN {out}_c USING (n, i) GROUP BY {by}, draw),
{out} AS (SELECT {by}, n AS n_clusters, total / rows AS mean, ci_low, ci_high FROM (SELECT {by}, max(n) AS n, sum(s) AS total, sum(k) AS rows FROM {out}_c GROUP BY {by}) JOIN (SELECT {by}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM {out}_m GROUP BY {by}) USING ({by}))"""


def effects(by: str) -> str:
    """ef: (by, n, wins, losses, ties, mean_diff, rank_biserial, cliffs_delta) of df."""
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in by.split(","))
    of_a = ", ".join(f"a.{k.strip()}" for k in by.split(","))
    count = lambda rule: f"CAST(count(CASE WHEN {rule} THEN 1 END) AS BIGINT)"
    return f"""er AS (SELECT {by}, d, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0 AS r FROM df WHERE d <> 0), eb AS (SELECT {by}, sum(CASE WHEN d > 0 THEN r ELSE -r END) / sum(r) AS rank_biserial FROM er GROUP BY {by}),
ed AS (SELECT {of_a}, avg(sign(a.ref - b.val) * CASE WHEN a.metric IN {LOWER} THEN -1 ELSE 1 END) AS cliffs_delta FROM df a JOIN df b ON {same} GROUP BY {of_a}),
ef AS (SELECT * FROM (SELECT {by}, count(*) AS n, {count("d > 0")} AS wins, {count("d < 0")} AS losses, {count("d = 0")} AS ties, avg(d) AS mean_diff FROM df GROUP BY {by}) LEFT JOIN eb USING ({by}) LEFT JOIN ed USING ({by}))"""


def erfc(x: str) -> str:
    """By the series of positive terms of erf."""
    return f"(CASE WHEN {x} <= 0 THEN 1.0 WHEN {x} > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 150), lambda i: exp(2 * i * ln(2) + lgamma(i + 1.0) + (2 * i + 1) * ln({x}) - lgamma(2 * i + 2.0)))) END)"


def signed_ranks(out: str, source: str, by: str) -> str:
    """out: (by, p) of the two-sided signed-rank test of d.

    Exact up to 50 values without ties, from the characteristic function of the sum of ranks;
    else normal with correction for ties; 1 where all values are zero.
    """
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""{out}r AS (SELECT {by}, d, rank() OVER (PARTITION BY {by} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {by}, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {by}, abs(d)) AS t FROM {source} WHERE d <> 0),
{out}s AS (SELECT {by}, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END)::DOUBLE AS plus, max(t) AS most, sum(t * t - 1)::DOUBLE AS ties FROM {out}r GROUP BY {by}),
{out}n AS (SELECT *, n * (n + 1) / 2 AS total, least(plus, n * (n + 1) / 2 - plus) AS low, abs(plus - n * (n + 1) / 4) / sqrt(2 * (n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) AS x FROM {out}s),
{out}k AS (SELECT *, unnest(range(0, CAST(total AS BIGINT) + 1))::DOUBLE AS k FROM {out}n WHERE n <= 50 AND most = 1),
{out}c AS (SELECT {by}, k, any_value(total) AS total, any_value(low) AS low, product(cos(pi() * k * j / (total + 1))) AS c FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS j FROM {out}k) GROUP BY {by}, k),
{out}e AS (SELECT {by}, least(1.0, 2 * sum(c * (CASE WHEN k = 0 THEN low + 1 ELSE sin((low + 1) * pi() * k / (total + 1)) / sin(pi() * k / (total + 1)) * cos(pi() * k * (total - low) / (total + 1)) END)) / any_value(total + 1)) AS p FROM {out}c GROUP BY {by}),
{out} AS (SELECT a.*, coalesce(e.p, {erfc("b.x")}, 1.0) AS p FROM (SELECT DISTINCT {by} FROM {source}) a LEFT JOIN {out}n b ON {on} LEFT JOIN {out}e e ON {on.replace("b.", "e.")})"""


def holm(source: str, out: str, p: str, name: str, family: str) -> str:
    return f"""{out}_s AS (SELECT *, (count({p}) OVER (PARTITION BY {family}) - row_number() OVER (PARTITION BY {family} ORDER BY {p}) + 1) * {p} AS step FROM {source}),
{out} AS (SELECT * EXCLUDE (step), least(1.0, max(step) OVER (PARTITION BY {family} ORDER BY {p} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {name} FROM {out}_s)"""


def verdict(p: str) -> str:
    return f"CASE WHEN {p} < 0.05 AND mean_diff > 0 THEN 'ref_better' WHEN {p} < 0.05 AND mean_diff < 0 THEN 'ref_worse' ELSE 'n.s.' END"


_PREFIXED = lambda cell, name: f"SELECT window_id, item_id, truth, '{cell}:' || method AS method, round(score, 9) AS score FROM ({Q.long(Q.SCORES, name)})"
_KEYS = ("scenario", "horizon")
_BY = "scenario, horizon, metric, method"

#: ve (verdicts) and me (means) of two demand tables at two horizons.
CELLS = ",\n".join([
    Q.DEMAND, Q.USERS, *[Q.frames(7, 3, horizon=h, name=f"{s[0]}{h}", tag=t) for s, t in (("supplier", ""), ("user", "u_")) for h in (1, 4)],
    "sc AS (" + " UNION ALL ".join(_PREFIXED(f"{s}:{h}", f"{s[0]}{h}") for s in ("supplier", "user") for h in (1, 4)) + ")", WS.protocol((10,)),
    "cp AS (SELECT split_part(method, ':', 1) AS scenario, CAST(split_part(method, ':', 2) AS INTEGER) AS horizon, window_id, ndcg_10, rsi_10, mae, split_part(method, ':', 3) AS method FROM pr)",
    long_metrics(("ndcg_10", "rsi_10", "mae"), "scenario, horizon, ", "cp"), pairs("AF", _KEYS), blocks(8, _BY), signed_ranks("pw", "df", _BY), signed_ranks("pb", "bl", _BY),
    f"cr AS (SELECT *, mean_diff AS md FROM (SELECT {_BY}, avg(d) AS mean_diff FROM df GROUP BY {_BY}) JOIN (SELECT {_BY}, p AS p_window FROM pw) USING ({_BY}) LEFT JOIN (SELECT {_BY}, p AS p_block FROM pb) USING ({_BY}))",
    holm("cr", "ch", "p_block", "p_holm", "scenario, horizon, metric"),
    f"ve AS (SELECT {_BY}, 'AF' AS reference, mean_diff, {verdict('p_holm')} AS verdict, {verdict('p_window')} AS verdict_sens FROM ch)", f"me AS (SELECT {_BY}, round(avg(value), 9) AS mean FROM lm GROUP BY {_BY})",
])
