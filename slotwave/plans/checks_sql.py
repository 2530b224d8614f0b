"""SQL building blocks for the oracle of the registered queries."""

from __future__ import annotations


def study(rows: str, seconds: int, tag: str = "") -> str:
    """Demand from rows (ts, item_id, cnt) on its grid: <tag>demand, <tag>grid, <tag>dense."""
    return f"""{tag}demand AS ({rows}),
{tag}grid AS (SELECT min(ts) AS t0, CAST((epoch(max(ts)) - epoch(min(ts))) // {seconds} AS INTEGER) AS n FROM {tag}demand),
{tag}seen AS (SELECT item_id, CAST((epoch(ts) - epoch(t0)) // {seconds} AS INTEGER) AS slot, cnt FROM {tag}demand, {tag}grid),
{tag}slots AS (SELECT CAST(unnest(range(0, (SELECT n + 1 FROM {tag}grid))) AS INTEGER) AS slot),
{tag}dense AS (SELECT i.item_id, s.slot, CAST(coalesce(d.cnt, 0) AS DOUBLE) AS v, CASE WHEN d.cnt IS NULL THEN 0 ELSE 1 END AS present
  FROM (SELECT DISTINCT item_id FROM {tag}demand) i CROSS JOIN {tag}slots s LEFT JOIN {tag}seen d ON d.item_id = i.item_id AND d.slot = s.slot)"""


DEMAND = study("SELECT date_trunc('week', l_shipdate) AS ts, CAST(l_suppkey AS VARCHAR) AS item_id, count(*) AS cnt FROM lineitem GROUP BY 1, 2", 604800)
USERS = study("SELECT to_timestamp(floor(epoch(ts) / 21600) * 21600) AT TIME ZONE 'UTC' AS ts, CAST(user_id AS VARCHAR) AS item_id, count(*) AS cnt FROM events GROUP BY 1, 2", 21600, "u_")


def frames(window: int, min_obs: int, min_total: int = 24, horizon: int = 1, name: str = "fr", tag: str = "") -> str:
    """Eligible rows of valid windows of a study: window_id, item_id, truth, n (slots in the window)."""
    return f"""{name}_all AS (SELECT slot AS window_id, item_id, coalesce(sum(v) OVER (PARTITION BY item_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  coalesce(sum(present) OVER (PARTITION BY item_id ORDER BY slot ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING), 0) AS observed, least(slot, {window}) AS n,
  sum(v) OVER (PARTITION BY item_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND {horizon - 1} FOLLOWING) AS truth FROM {tag}dense),
{name}_ok AS (SELECT a.window_id, a.item_id, a.truth, a.observed FROM {name}_all a, {tag}grid g WHERE a.n > 0 AND observed >= {min_obs} AND before >= {min_total} AND window_id + {horizon - 1} <= g.n),
{name} AS (SELECT window_id, item_id, truth, observed, least(window_id, {window}) AS n FROM {name}_ok WHERE window_id IN (SELECT slot FROM {tag}dense GROUP BY slot HAVING max(present) = 1) AND window_id IN (SELECT window_id FROM {name}_ok GROUP BY window_id HAVING count(*) >= 2)),
{name}_x AS (SELECT f.window_id, f.item_id, f.truth, f.n, f.observed, d.v, f.window_id - 1 - d.slot AS i FROM {name} f JOIN {tag}dense d ON d.item_id = f.item_id AND d.slot >= f.window_id - {window} AND d.slot < f.window_id)"""


#: Scores from rows (v, i, n): i slots before the newest of n.
SCORES = {
    "AF": "sum(v * pow(0.5, i))",
    "EWMA": "sum(CASE WHEN i = n - 1 THEN pow(0.8, n - 1) ELSE 0.2 * pow(0.8, i) END * v)",
    "RRD": "coalesce(sum(v) / (max(CASE WHEN v <> 0 THEN i END) + 1), 0)",
    "VSE": "coalesce(sum(v) / (min(CASE WHEN v <> 0 THEN i END) + 1), 0)",
    "CompoundPop": "coalesce(0.5 * sum(v) / max(n) + 0.3 * sum(CASE WHEN i < greatest(1, CAST(floor(n * 0.2) AS INTEGER)) THEN v ELSE 0 END) / max(greatest(1, CAST(floor(n * 0.2) AS INTEGER))) + 0.2 / (min(CASE WHEN v <> 0 THEN i END) + 1), 0)",
    "PFRF": "pow(1.2, count(CASE WHEN v > 0 THEN 1 END)) * pow(0.8, count(CASE WHEN v > 0 THEN NULL ELSE 1 END))",
}


def wide(scores: dict[str, str], name: str = "fr") -> str:
    columns = ", ".join(f'{sql} AS "{k}"' for k, sql in scores.items())
    return f"SELECT window_id, item_id, max(truth) AS truth, {columns} FROM {name}_x GROUP BY window_id, item_id"


def long(scores: dict[str, str], name: str = "fr") -> str:
    return " UNION ALL ".join(f"SELECT window_id, item_id, max(truth) AS truth, '{k}' AS method, CAST({sql} AS DOUBLE) AS score FROM {name}_x GROUP BY window_id, item_id" for k, sql in scores.items())


#: Needs sc (window_id, item_id, truth, method, score). Scores are compared after rounding to 9 digits.
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY window_id, method ORDER BY score DESC, item_id) AS rank, row_number() OVER (PARTITION BY window_id, method ORDER BY truth DESC, item_id) AS truth_rank, count(*) OVER (PARTITION BY window_id, method) AS n_items FROM sc)"""


def r6(sql: str) -> str:
    """Rounded as the queries round."""
    return f"round({sql} + 3.7e-10, 6)"


def ndcg(k: int) -> str:
    gain = lambda r: f"sum(CASE WHEN {r} <= {k} THEN (pow(2, log10(1 + truth)) - 1) / log2(1.0 + {r}) END)"
    return f"coalesce({gain('rank')} / nullif({gain('truth_rank')}, 0), 0)"


def coverage(k: int) -> str:
    return f"coalesce(sum(CASE WHEN rank <= {k} THEN truth END) / nullif(sum(truth), 0), 0)"


def rsi(k: int) -> str:
    """CTEs prev_k and rsi_k: overlap of each window's top-K set with the method's previous window."""
    return f"""wins AS (SELECT method, window_id, lag(window_id) OVER (PARTITION BY method ORDER BY window_id) AS prev FROM (SELECT DISTINCT method, window_id FROM ranked)),
tops AS (SELECT method, window_id, item_id FROM ranked WHERE rank <= {k}),
sizes AS (SELECT method, window_id, count(*) AS n FROM tops GROUP BY 1, 2),
shared AS (SELECT w.method, w.window_id, count(*) AS c FROM wins w JOIN tops a ON a.method = w.method AND a.window_id = w.window_id JOIN tops b ON b.method = w.method AND b.window_id = w.prev AND b.item_id = a.item_id GROUP BY 1, 2),
rsi AS (SELECT w.method, w.window_id, CASE WHEN w.prev IS NULL THEN NULL ELSE CAST(coalesce(s.c, 0) AS DOUBLE) / (a.n + b.n - coalesce(s.c, 0)) END AS rsi
  FROM wins w JOIN sizes a ON a.method = w.method AND a.window_id = w.window_id LEFT JOIN sizes b ON b.method = w.method AND b.window_id = w.prev LEFT JOIN shared s ON s.method = w.method AND s.window_id = w.window_id)"""
