"""Queries on forecasts, transforms, robustness, events, comparisons, decisions, audits, learning and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scorers as S
from ..functions import sql_functions as SF
from ..operators import audit as A
from ..operators import boosting as B
from ..operators import decisions as D
from ..operators import events as E
from ..operators import grid as G
from ..operators import learned as L
from ..operators import ranking as R
from ..operators import relation as L2
from ..operators import selection
from ..operators import series as N
from ..operators import statistics as T
from ..operators import wavelet as V
from ..sources.tables import stored
from . import checks_sql as Q
from . import popularity as P
from . import stats_sql as TS
from . import wave_sql as WS
from .registry import query, with_

_NAMES = tuple(s.name for s in S.BASELINES)
_PICK = lambda *names: [s for s in S.BASELINES if s.name in names]


def _sc(*names: str) -> str:
    return f"sc AS (SELECT window_id, item_id, truth, method, round(score, 9) AS score FROM ({Q.long({k: Q.SCORES[k] for k in names})}))"


def _scored(spark, sf_dir, *names: str, horizon: int = 1):
    return P.weekly(spark, sf_dir).scored(_PICK(*names), horizon).withColumn("score", F.round("score", 9))


def _metric_rows(spark, sf_dir, *names: str, ks=(10,), horizon: int = 1):
    """Metric rows of the named baselines."""
    return P.weekly(spark, sf_dir).protocol(_PICK(*names), horizon, ks)


def _frames(spark, sf_dir, window: int = 64, min_obs: int = 32, horizon: int = 1):
    study = P.weekly(spark, sf_dir)
    rows = study.windows({"w": window}, horizon).where(G.eligible("w", min_obs, P.MIN_TOTAL)).select("window_id", "item_id", "truth", "observed_w", "x_w")
    return study, G.valid_windows(rows, study.dense, ["window_id"])


# Forecast baselines

_FORE = {
    "Persistence": "8 * greatest(max(CASE WHEN i = 0 THEN v END), 0)", "MA64": "8 * sum(v) / max(n)", "SMA16": "8 * sum(CASE WHEN i < 16 THEN v ELSE 0 END) / least(16, max(n))",
    "EWMAeq16": "8 * sum(CASE WHEN i = n - 1 THEN pow(15.0 / 17, n - 1) ELSE 2.0 / 17 * pow(15.0 / 17, i) END * v)",
}


@query(with_(Q.DEMAND, Q.frames(64, 3, horizon=8)) + "SELECT window_id, item_id, truth, " + ", ".join(f"{Q.r6(chr(34) + k + chr(34))} AS \"{k}\"" for k in _FORE) + f" FROM ({Q.wide(_FORE)})")
def x7_forecast_baselines(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    x = F.col("x_w")
    rows = study.windows({"w": 64}, 8).where(G.eligible("w", 3, P.MIN_TOTAL))
    wide = rows.select("window_id", "item_id", "truth", S.persistence(x, 8).alias("Persistence"), S.moving_average(x, 64, 8).alias("MA64"), S.moving_average(x, 16, 8).alias("SMA16"), S.ewma_equivalent(x, 16, 8).alias("EWMAeq16"))
    return P.rounded(G.valid_windows(wide, study.dense, ["window_id"]))


_AR = """m AS (SELECT window_id, item_id, max(truth) AS truth, max(n) AS n, avg(v) AS m, max(CASE WHEN i = 0 THEN v END) AS v0, max(CASE WHEN i = 1 THEN v END) AS v1 FROM fr_x GROUP BY 1, 2),
r AS (SELECT a.window_id, a.item_id, sum(CASE WHEN b.i = a.i THEN (a.v - m.m) * (b.v - m.m) ELSE 0 END) / max(m.n) AS r0, sum(CASE WHEN b.i = a.i + 1 THEN (a.v - m.m) * (b.v - m.m) ELSE 0 END) / max(m.n) AS r1, sum(CASE WHEN b.i = a.i + 2 THEN (a.v - m.m) * (b.v - m.m) ELSE 0 END) / max(m.n) AS r2
  FROM fr_x a JOIN fr_x b ON a.window_id = b.window_id AND a.item_id = b.item_id AND b.i BETWEEN a.i AND a.i + 2 JOIN m ON m.window_id = a.window_id AND m.item_id = a.item_id GROUP BY 1, 2),
p AS (SELECT m.*, r0, (r0 + 1e-8) * (r0 + 1e-8) - r1 * r1 AS det, r1, r2 FROM m JOIN r USING (window_id, item_id)),
q AS (SELECT *, ((r0 + 1e-8) * r1 - r1 * r2) / nullif(det, 0) AS p1, ((r0 + 1e-8) * r2 - r1 * r1) / nullif(det, 0) AS p2 FROM p)"""


@query(with_(Q.DEMAND, Q.frames(16, 8), _AR) + f"SELECT window_id, item_id, truth, {Q.r6('CASE WHEN n < 4 THEN v0 WHEN r0 <= 1e-12 OR p1 IS NULL OR abs(p1) + abs(p2) > 4 THEN greatest(m, 0) ELSE greatest(p1 * (v0 - m) + p2 * (v1 - m) + m, 0) END')} AS ar2 FROM q")
def x11_ar2(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    rows = study.windows({"w": 16}).where(G.eligible("w", 8, P.MIN_TOTAL)).select("window_id", "item_id", "truth", S.ar2(F.col("x_w")).alias("ar2"))
    return P.rounded(G.valid_windows(rows, study.dense, ["window_id"]))


_HOLT = "list_reduce(list_transform(x[2:], lambda v: [v, 0.0]), lambda s, e: [0.3 * e[1] + 0.7 * (s[1] + s[2]), 0.1 * (0.3 * e[1] + 0.7 * (s[1] + s[2]) - s[1]) + 0.9 * s[2]], [x[1], x[2] - x[1]])"
_MOMENTS = "hx AS (SELECT window_id, item_id, list(v ORDER BY i DESC) AS x FROM fr_x GROUP BY 1, 2), hm AS (SELECT *, list_avg(x) AS m, " + _HOLT + " AS lb FROM hx WHERE len(x) > 1), hk AS (SELECT *, list_avg(list_transform(x, lambda v: pow(v - m, 2))) AS m2, list_avg(list_transform(x, lambda v: pow(v - m, 3))) AS m3, list_avg(list_transform(x, lambda v: pow(v - m, 4))) AS m4 FROM hm)"


@query(with_(Q.DEMAND, Q.frames(16, 8), _MOMENTS) + f"SELECT window_id, item_id, {Q.r6('list_sum(list_transform(range(1, 9), lambda k: greatest(0.0, lb[1] + k * lb[2])))')} AS holt, {Q.r6('CASE WHEN m2 > 0 THEN m + 0.5 * m3 / pow(m2, 1.5) + 0.3 * (m4 / (m2 * m2) - 3) ELSE 0 END')} AS statistical FROM hk")
def x9_holt_statistical(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    rows = study.windows({"w": 16}).where(G.eligible("w", 8, P.MIN_TOTAL)).select("window_id", "item_id", S.holt(F.col("x_w"), 8).alias("holt"), S.statistical(F.col("x_w")).alias("statistical"))
    return P.rounded(G.valid_windows(rows, study.dense, ["window_id"]))


@query(with_(Q.DEMAND, Q.frames(7, 3)) + f"SELECT window_id, item_id, method, {Q.r6('score')} AS score FROM ({Q.long(Q.SCORES)})")
def x14_sql_scores(spark, sf_dir):
    """The six baselines asked for in SQL: a lateral call of the registered table function over the windows."""
    SF.register(spark)
    view = f"windows_{uuid.uuid4().hex}"
    _frames(spark, sf_dir, 7, 3)[1].select("window_id", "item_id", "x_w").createOrReplaceTempView(view)
    return P.rounded(spark.sql(f"SELECT w.window_id, w.item_id, s.method, s.score FROM {view} w, LATERAL baseline_scores(w.x_w) s"))


@query(with_(Q.DEMAND, Q.frames(7, 3), f"ws AS ({Q.wide(Q.SCORES)})") + f"SELECT window_id, {Q.r6('max(round(' + chr(34) + 'AF' + chr(34) + ', 9))')} AS largest, {Q.r6('avg(' + chr(34) + 'RRD' + chr(34) + ')')} AS mean_rrd FROM ws GROUP BY window_id")
def x1_sql_calls(spark, sf_dir):
    """Scalar scorers in the text of a query with grouping."""
    SF.register(spark)
    view = f"windows_{uuid.uuid4().hex}"
    _frames(spark, sf_dir, 7, 3)[1].select("window_id", "item_id", "x_w").createOrReplaceTempView(view)
    return P.rounded(spark.sql(f"SELECT window_id, max(round(af(x_w), 9)) AS largest, avg(rrd(x_w)) AS mean_rrd FROM {view} GROUP BY window_id"))


def _guarded(windows):
    """The range of each window; one of all zeros in the newest two slots raises."""
    if any(w[-2:].sum() == 0 for w in windows):
        raise ValueError("no recent request")
    return [[w.max() - w.min()] * 2 for w in windows]


@query(with_(Q.DEMAND, Q.frames(7, 3)) + "SELECT window_id, item_id, CASE WHEN sum(CASE WHEN i < 2 THEN v ELSE 0 END) = 0 THEN 0 ELSE max(v) - min(v) END AS own, sum(CASE WHEN i < 2 THEN v ELSE 0 END) = 0 AS own_failed FROM fr_x GROUP BY 1, 2")
def x15_user_scorer(spark, sf_dir):
    """A user's function that fails on some windows: these score zero and are marked."""
    rows = _frames(spark, sf_dir, 7, 3)[1].select("window_id", "item_id", "x_w")
    return S.user_scores(rows, "own", _guarded)


_PADS = {h: WS.padded(how=h).replace("xs AS", f"xs_{h} AS").replace("FROM xs)", f"FROM xs_{h})").replace("px AS", f"px_{h} AS") for h in G.PADS}


@query(with_(Q.DEMAND, Q.frames(64, 32), *_PADS.values()) + " UNION ALL ".join(f"SELECT '{h}' AS how, window_id, item_id, {Q.r6('list_dot_product(x, list_transform(range(1, 65), lambda k: k::DOUBLE))')} AS moment FROM px_{h}" for h in G.PADS))
def g14_paddings(spark, sf_dir):
    """Short windows filled up by every rule: the sum of value times place."""
    rows = _frames(spark, sf_dir)[1]
    moment = lambda h: F.aggregate(F.transform(G.pad_left(F.col("x_w"), 64, h), lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("how"), moment(h).alias("moment")) for h in G.PADS])).alias("p")
    return P.rounded(rows.select("window_id", "item_id", each).select("p.how", "window_id", "item_id", "p.moment"))


@query(with_(Q.DEMAND, Q.frames(48, 24), "sz AS (SELECT window_id, item_id, count(*) AS n, arg_max(v, i) AS oldest FROM fr_x GROUP BY 1, 2)", "tg AS (SELECT *, CASE WHEN n <= 8 THEN 8 WHEN n <= 16 THEN 16 WHEN n <= 32 THEN 32 ELSE 64 END AS target FROM sz)") + f"SELECT window_id, item_id, max(target) AS target, {Q.r6('max(oldest * (target - tg.n) * (target - tg.n + 1) / 2) + sum(v * (target - i))')} AS moment FROM fr_x JOIN tg USING (window_id, item_id) GROUP BY window_id, item_id")
def g14_power_of_two(spark, sf_dir):
    """Windows filled up with their oldest value to a power of two: the length and the sum of value times place."""
    target = G.power_of_two(F.size("x_w"), 2)
    rows = _frames(spark, sf_dir, 48, 24)[1].select("window_id", "item_id", target.alias("target"), G.pad_left(F.col("x_w"), target, "edge").alias("p"))
    moment = F.aggregate(F.transform("p", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return P.rounded(rows.select("window_id", "item_id", "target", moment.alias("moment")))


_PRESENT = """cf_all AS (SELECT slot AS window_id, item_id, coalesce(sum(v) OVER (PARTITION BY item_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum(present) OVER (PARTITION BY item_id ORDER BY slot ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0) AS observed, v AS truth FROM dense),
cf_ok AS (SELECT * FROM cf_all WHERE observed >= 3 AND before >= 24), cf AS (SELECT * FROM cf_ok WHERE window_id IN (SELECT slot FROM dense GROUP BY slot HAVING max(present) = 1) AND window_id IN (SELECT window_id FROM cf_ok GROUP BY 1 HAVING count(*) >= 2)),
cx AS (SELECT c.window_id, c.item_id, c.truth, c.observed AS n, d.v, row_number() OVER (PARTITION BY c.window_id, c.item_id ORDER BY d.slot DESC) - 1 AS i FROM cf c JOIN dense d ON d.item_id = c.item_id AND d.present = 1 AND d.slot BETWEEN c.window_id - 6 AND c.window_id - 1)"""


def _present(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    rows = G.in_time(G.present_frames(study.dense, 7), study.grid, 1).where(G.eligible("w", 3, P.MIN_TOTAL))
    return G.valid_windows(rows, study.dense, ["window_id"])


@query(with_(Q.DEMAND, _PRESENT) + f"SELECT window_id, item_id, max(truth) AS truth, max(n) AS observed_w, {Q.r6('sum(v * pow(0.5, i))')} AS af FROM cx GROUP BY 1, 2")
def g9_present_windows(spark, sf_dir):
    """The older windows of present rows only."""
    return P.rounded(_present(spark, sf_dir).select("window_id", "item_id", "truth", "observed_w", S.af(F.col("x_w")).alias("af")))


_OLD_NEW = lambda source, out: f"{out} AS (SELECT window_id, item_id, max(truth) AS truth, 'AF' AS method, round(sum(v * pow(0.5, i)), 9) AS score FROM {source} GROUP BY 1, 2)"


@query(with_(Q.DEMAND, Q.frames(7, 3), _PRESENT, _OLD_NEW("cx", "so"), _OLD_NEW("fr_x", "sn"), "sc AS (SELECT window_id, item_id, truth, 'old' AS method, score FROM so UNION ALL SELECT window_id, item_id, truth, 'new', score FROM sn)", WS.protocol((10,)), "vs AS (SELECT method, count(*) AS n, avg(ndcg_10) AS a, avg(rsi_10) AS b FROM pr GROUP BY 1)") + f"SELECT 'AF' AS method, o.n AS windows_old, v.n AS windows_new, {Q.r6('o.a')} AS ndcg_10_old, {Q.r6('v.a')} AS ndcg_10_new, {Q.r6('v.a - o.a')} AS ndcg_10_change, {Q.r6('o.b')} AS rsi_10_old, {Q.r6('v.b')} AS rsi_10_new, {Q.r6('v.b - o.b')} AS rsi_10_change FROM vs o, vs v WHERE o.method = 'old' AND v.method = 'new'")
def q12_versions(spark, sf_dir):
    """AF over the older windows and over the causal ones."""
    score = lambda rows: R.summarize(R.protocol(rows.select("window_id", "item_id", "truth", F.lit("AF").alias("method"), F.round(S.af(F.col("x_w")), 9).alias("score")), (10,)), ("ndcg_10", "rsi_10"))
    return P.rounded(A.version_table(score(_present(spark, sf_dir)), score(_frames(spark, sf_dir, 7, 3)[1]), ["ndcg_10", "rsi_10"]))


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("AF", "VSE"), Q.RANKED) + ", it AS (SELECT max(item_id) AS item FROM demand) SELECT CAST(k AS INTEGER) AS window_id, m.method, CAST(r.rank AS INTEGER) AS rank FROM (SELECT unnest(range(100, 141)) AS k) CROSS JOIN (SELECT DISTINCT method FROM ranked) m LEFT JOIN (SELECT * FROM ranked JOIN it ON item_id = item) r ON r.window_id = k AND r.method = m.method")
def r6_rank_trace(spark, sf_dir):
    """One item's rank in windows 100 to 140."""
    item = P.supplier_weeks(spark, sf_dir).agg(F.max("item_id")).first()[0]
    return E.rank_trace(R.rank_items(_scored(spark, sf_dir, "AF", "VSE")), item, 100, 140)


_FEATS = ", ".join(f"{Q.r6(sql)} AS {name}" for name, sql in {"mean": "avg(v)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "median": "quantile_cont(v, 0.5)", "q25": "quantile_cont(v, 0.25)", "q75": "quantile_cont(v, 0.75)"}.items())


@query(with_(Q.DEMAND, Q.frames(32, 16)) + f"SELECT window_id, item_id, {_FEATS} FROM fr_x GROUP BY window_id, item_id")
def x13_series_features(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    keep = ("mean", "std", "min", "max", "median", "q25", "q75")
    rows = study.windows({"w": 32}).where(G.eligible("w", 16, P.MIN_TOTAL)).select("window_id", "item_id", *[c.alias(k) for k, c in S.series_features(F.col("x_w")).items() if k in keep])
    return P.rounded(G.valid_windows(rows, study.dense, ["window_id"]))


# Ranking metrics


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("AF", "VSE"), Q.RANKED, Q.rsi(20)) + f"SELECT method, window_id, {Q.r6('rsi')} AS rsi_20 FROM rsi")
def m7_rsi(spark, sf_dir):
    out = R.with_rsi(R.window_metrics(R.rank_items(_scored(spark, sf_dir, "AF", "VSE")), (20,)), (20,))
    return P.rounded(out.select("method", "window_id", "rsi_20"))


_RHO = """a AS (SELECT window_id, method, score, truth, rank() OVER (PARTITION BY window_id, method ORDER BY score) + (count(*) OVER (PARTITION BY window_id, method, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY window_id, method ORDER BY truth) + (count(*) OVER (PARTITION BY window_id, method, truth) - 1) / 2.0 AS rt FROM sc)"""


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("AF", "RRD"), _RHO) + f"SELECT window_id, method, {Q.r6('CASE WHEN max(score) - min(score) >= 1e-12 AND max(truth) - min(truth) >= 1e-12 THEN corr(rs, rt) END')} AS spearman_rho FROM a GROUP BY window_id, method")
def m4_spearman(spark, sf_dir):
    return P.rounded(R.window_metrics(R.rank_items(_scored(spark, sf_dir, "AF", "RRD")), ()).select("window_id", "method", "spearman_rho"))


_TAU = """p AS (SELECT a.window_id, a.method, sum(sign(a.score - b.score) * sign(a.truth - b.truth)) AS s, sum(CASE WHEN a.score = b.score THEN 1 ELSE 0 END) AS tx, sum(CASE WHEN a.truth = b.truth THEN 1 ELSE 0 END) AS ty, count(*) AS n FROM sc a JOIN sc b ON a.window_id = b.window_id AND a.method = b.method AND a.item_id < b.item_id GROUP BY 1, 2)"""


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("PFRF"), _TAU) + f"SELECT window_id, method, {Q.r6('s / nullif(sqrt(CAST(n - tx AS DOUBLE)) * sqrt(CAST(n - ty AS DOUBLE)), 0)')} AS kendall_tau FROM p")
def m3_kendall(spark, sf_dir):
    return P.rounded(R.kendall(_scored(spark, sf_dir, "PFRF")))


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("AF", "RRD"), _TAU) + f"SELECT window_id, method, {Q.r6('s / nullif(sqrt(CAST(n - tx AS DOUBLE)) * sqrt(CAST(n - ty AS DOUBLE)), 0)')} AS kendall_tau FROM p")
def m3_large_kendall(spark, sf_dir):
    """Kendall's tau by blocks of places; blocks of 32 items, so that windows have many."""
    return P.rounded(R.kendall_large(_scored(spark, sf_dir, "AF", "RRD"), ranges=16, block=32))


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), Q.RANKED) + f", m AS (SELECT window_id, method, {Q.ndcg(10)} AS ndcg_10, {Q.coverage(10)} AS coverage_10 FROM ranked GROUP BY 1, 2) SELECT method, count(*) AS n_windows, min(window_id) AS first_window, max(window_id) AS last_window, {Q.r6('avg(ndcg_10)')} AS ndcg_10_mean, {Q.r6('stddev_samp(ndcg_10)')} AS ndcg_10_sd, {Q.r6('avg(coverage_10)')} AS coverage_10_mean FROM m GROUP BY method")
def m11_method_summary(spark, sf_dir):
    out = R.summarize(_metric_rows(spark, sf_dir, *_NAMES), ("ndcg_10", "coverage_10"))
    return P.rounded(out.select("method", "n_windows", "first_window", "last_window", "ndcg_10_mean", "ndcg_10_sd", "coverage_10_mean"))


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("PFRF"), Q.RANKED) + ", t AS (SELECT *, lag(score) OVER (PARTITION BY window_id ORDER BY score DESC, item_id) = score AS tied FROM ranked) SELECT window_id, coalesce(bool_or(tied AND rank <= 21), false) AS ties_top21 FROM t GROUP BY window_id")
def r3_ties(spark, sf_dir):
    return R.window_metrics(R.rank_items(_scored(spark, sf_dir, "PFRF")), ()).select("window_id", "ties_top21")


@query(with_(Q.DEMAND, Q.frames(7, 3, name="f7"), Q.frames(16, 8, name="f16")) + "SELECT window_id FROM f7 INTERSECT SELECT window_id FROM f16")
def g16_common_windows(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    rows = study.scored([S.Scorer("a", 7, 3, S.af), S.Scorer("b", 16, 8, S.af)])
    return G.common_windows(rows.select("window_id", "method").distinct()).select("window_id").distinct()


@query(with_(Q.DEMAND, Q.frames(7, 3)) + ", w AS (SELECT DISTINCT window_id FROM fr), n AS (SELECT window_id, row_number() OVER (ORDER BY window_id) AS k, count(*) OVER () AS n FROM w) SELECT window_id, CASE WHEN k <= floor(0.3 * n) THEN 'tune' ELSE 'test' END AS part FROM n")
def g19_time_split(spark, sf_dir):
    return G.time_split(_scored(spark, sf_dir, "AF"))


# Transforms and sweeps

_KEEP = ["window_id", "item_id", "truth"]
_WINDOWS = (Q.DEMAND, Q.frames(64, 32))


def _bare(spark, sf_dir, horizon: int = 1):
    """Windows of 64 slots of the items with 32 observed ones."""
    return _frames(spark, sf_dir, horizon=horizon)[1].drop("observed_w")


def _open(spark, sf_dir, horizon: int = 1):
    """The study, and its windows as _bare has them; which windows are valid is left to the metric rows."""
    study = P.weekly(spark, sf_dir)
    return study, study.windows({"w": 64}, horizon).where(G.eligible("w", 32, P.MIN_TOTAL)).select("window_id", "item_id", "truth", "x_w")


def _made(study, named, horizon: int = 1):
    """The windows that _open has, with columns that are made of them inside the task (names and function)."""
    return study.wide([N.Part(64, 32, *named)], horizon)


def _summary(study, wide, columns: dict, ks=R.KS, metrics=R.METRICS):
    return P.rounded(R.summarize(study.measured(wide, columns, ks, rho="spearman_rho" in metrics), metrics))


_LENGTHS = (7, 16, 32, 64, 128)
_DIGITS9 = lambda x: f"round({x} / pow(10, floor(log10(greatest(abs({x}), 1)))), 9) * pow(10, floor(log10(greatest(abs({x}), 1))))"
_HOLT_X = "list_reduce(list_transform(x[2:], lambda v: [v, 0.0]), lambda s, e: [0.3 * e[1] + 0.7 * (s[1] + s[2]), 0.1 * (0.3 * e[1] + 0.7 * (s[1] + s[2]) - s[1]) + 0.9 * s[2]], [x[1], x[2] - x[1]])"
_HOLT_SUM = lambda h: f"list_sum(list_transform(range(1, {h + 1}), lambda k: greatest(0.0, lb[1] + k * lb[2])))"


def _swept(n: int) -> str:
    """Scores of the sweep's methods over n slots."""
    averages = {"SMA": "sum(v) / max(n)", "EWMAeq": f"sum(CASE WHEN i = n - 1 THEN pow({n - 1} / {n + 1}.0, n - 1) ELSE 2.0 / {n + 1} * pow({n - 1} / {n + 1}.0, i) END * v)"}
    parts = [f"SELECT window_id, item_id, truth, method || '@{n}' AS method, score FROM ({Q.long(Q.SCORES | averages, 'fr')})", f"SELECT window_id, item_id, truth, 'Holt@{n}', {_HOLT_SUM(1)} FROM (SELECT *, {_HOLT_X} AS lb FROM (SELECT window_id, item_id, max(truth) AS truth, list(v ORDER BY i DESC) AS x FROM fr_x GROUP BY 1, 2))"]
    ctes = [Q.frames(n, 3)]
    if n > 7:
        ctes += [Q.frames(n, min(32, n // 2), name="fw"), WS.padded("fw", size=n), WS.features(tag="dt", slots=n), WS.features(transform="dwt", tag="dw", slots=n)]
        parts += [f"SELECT window_id, item_id, truth, '{m}@{n}', {x} FROM {t}" for m, x, t in (("WSPI", WS.index(), "fe_dt"), ("DTCWT+AF", "af", "fe_dt"), ("DWT+AF", "af", "fe_dw"))]
    return f"SELECT * FROM ({with_(*ctes)}{' UNION ALL '.join(parts)})"


_COMMON = "pc AS (SELECT * FROM pr WHERE window_id >= 32), pk AS (SELECT * FROM pc WHERE window_id IN (SELECT window_id FROM pc GROUP BY 1 HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM pc)))"


@query(with_(Q.DEMAND, f"sc AS (SELECT window_id, item_id, truth, method, {_DIGITS9('score')} AS score FROM ({' UNION ALL '.join(_swept(n) for n in _LENGTHS)}))", WS.protocol(), _COMMON) + WS.summary(source="pk"))
def e2_window_sweep(spark, sf_dir):
    """Twelve methods over 7 to 128 slots, wavelet methods from 16 on; windows from 32 on that all of them have. All lengths are slices of the longest window."""
    study = P.weekly(spark, sf_dir)
    rows = study.spans(_LENGTHS).where("truth_1 is not null").withColumnRenamed("truth_1", "truth")
    seen = lambda n, least: F.col(f"observed_{n}") >= least
    settings = {f"{k}{n}": {"transform": t, "last": n} for n in _LENGTHS[1:] for k, t in (("dt", "dtcwt"), ("dw", "dwt"))}
    sets = V.feature_sets(rows.select(*_KEEP, *[f"observed_{n}" for n in _LENGTHS], "x"), settings, x="x", baselines=_LENGTHS)
    plain = {f"{s.name}@{n}": F.when(seen(n, s.min_obs), F.col(f"{s.name}_{n}")) for n in _LENGTHS for s in P.baselines_at(n)}
    made = {f"{m}@{n}": F.when(seen(n, min(32, n // 2)), x) for n in _LENGTHS[1:] for m, x in (("WSPI", V.index(of=f"dt{n}")), ("DTCWT+AF", F.col(f"dt{n}_af")), ("DWT+AF", F.col(f"dw{n}_af")))}
    rows = P.held(study.measured(sets, plain | made, digits="significant"), "sweep")
    return P.rounded(R.summarize(G.common_windows(G.first_window(rows, 32))))


_NINE = ["sc AS (SELECT window_id, item_id, truth, method, round(score, 9) AS score FROM (" + Q.long(Q.SCORES, "f7") + ") UNION ALL " + WS.scores({"WSPI": WS.index(), "DTCWT+AF": "af"}, "fe_dt") + " UNION ALL " + WS.scores({"DWT+AF": "af"}, "fe_dw") + ")"]


@query(with_(Q.DEMAND, Q.frames(7, 3, name="f7"), Q.frames(64, 32), WS.padded(), WS.features(tag="dt"), WS.features(transform="dwt", tag="dw"), *_NINE, WS.protocol()) + WS.summary())
def e1_main_evaluation(spark, sf_dir):
    """Nine methods: six baselines over 7 slots, three transform scorers over 64, all from one pass over the slots."""
    study = P.weekly(spark, sf_dir)
    sets = study.wide([P.baselines_part(_NAMES), N.Part(64, 32, *V.sets_of({"dt": {}, "dw": {"transform": "dwt"}}))])
    made = {"WSPI": V.index(of="dt"), "DTCWT+AF": F.col("dt_af"), "DWT+AF": F.col("dw_af")}
    return _summary(study, sets, {n: F.col(n) for n in _NAMES} | made)


_TERM = lambda p: f"(CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0 END)"


@query(with_(*_WINDOWS, WS.padded(), WS.features()) + "SELECT window_id, item_id, " + ", ".join(f"{Q.r6(x)} AS {n}" for n, x in {"mu_l": "mu_l", "r": "r", "w_e": "w_e", "d": "d", "e_tot": "e_tot", "wspi": WS.index(), "residual": f"w_e * 2 - ({_TERM('r')} + {_TERM('(1 - r)')} + (1 - r) * h_q)"}.items()) + " FROM fe_f")
def w7_wavelet_features(spark, sf_dir):
    out = V.wavelet_features(_bare(spark, sf_dir))
    return P.rounded(out.select("window_id", "item_id", "mu_l", "r", "w_e", "d", "e_tot", V.index().alias("wspi"), V.entropy_residual().alias("residual")))


@query(with_(*_WINDOWS, WS.padded(), WS.features(transform="dwt")) + "SELECT window_id, item_id, " + ", ".join(f"{Q.r6(c)} AS {c}" for c in ("mu_l", "r", "w_e", "d", "e_tot", "af")) + " FROM fe_f")
def w2_decimated_features(spark, sf_dir):
    out = V.wavelet_features(_bare(spark, sf_dir), transform="dwt")
    return P.rounded(out.select("window_id", "item_id", "mu_l", "r", "w_e", "d", "e_tot", "af"))


_OUTSIDE = "fs_o AS (SELECT a.pos, sum(abs(a.w - coalesce(b.w, 0))) / sum(abs(a.w)) AS outside, any_value(pow(0.5, 15 - a.pos)) AS weight FROM (SELECT pos, k, sum(w) AS w FROM fs_all WHERE band = 0 GROUP BY 1, 2) a LEFT JOIN (SELECT pos, k, sum(w) AS w FROM fz_all WHERE band = 0 GROUP BY 1, 2) b USING (pos, k) GROUP BY a.pos)"


@query(
    with_(*_WINDOWS, WS.padded(), WS.features(tag="fs"), WS.features(how="zero", tag="fz"), _OUTSIDE, "be AS (SELECT window_id, item_id, unnest(range(0, 16)) AS coefficient, unnest(a) AS a, unnest(b) AS b FROM (SELECT window_id, item_id, s.a, z.a AS b FROM fe_fs s JOIN fe_fz z USING (window_id, item_id)))")
    + f"SELECT CAST(coefficient AS INTEGER) AS coefficient, {Q.r6('avg(a)')} AS mean, {Q.r6('avg(abs(a - b))')} AS change, {Q.r6('any_value(outside)')} AS outside, {Q.r6('any_value(weight) / (SELECT sum(weight) FROM fs_o)')} AS weight FROM be JOIN fs_o ON pos = coefficient GROUP BY coefficient"
)
def w12_boundary_effect(spark, sf_dir):
    """How much of each low coefficient comes from beyond the window's ends, in weights and over all windows."""
    return P.rounded(V.boundary_effect(_bare(spark, sf_dir)))


_SLOPED = "mu_l * exp(least(3, greatest(-3, slope + r - w_e)))"


@query(with_(*_WINDOWS, WS.padded(), WS.features(), f"sc AS ({WS.scores(WS.FUSIONS | {'slope_index': _SLOPED}, 'fe_f')})", WS.protocol()) + WS.summary())
def w10_fusions(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    feats = _made(study, V.features_of("mu_l", "r", "w_e", "slope"))
    return _summary(study, feats, V.fusions() | {"slope_index": V.slope_index()})


_BOTH = {"dtcwt": "dt", "dwt": "dw"}
_VARIANTS = {f"{k} {t}": (k, tag) for t, tag in _BOTH.items() for k in ("full", "trend", "R", "WE")} | {f"{k} dtcwt": (k, "dt") for k in ("linear", "product", "additive")} | {"linear dwt": ("linear", "dw")}


@query(with_(*_WINDOWS, WS.padded(), WS.features(tag="dt"), WS.features(transform="dwt", tag="dw"), "sc AS (" + " UNION ALL ".join(WS.scores({n: WS.FUSIONS[k]}, f"fe_{tag}") for n, (k, tag) in _VARIANTS.items()) + ")", WS.protocol((10,))) + WS.summary(("ndcg_10", "coverage_10", "rsi_10", "mae", "spearman_rho")))
def e7_ablation(spark, sf_dir):
    """Twelve variants: structure terms on and off over both transforms, and other fusions."""
    study = P.weekly(spark, sf_dir)
    sets = _made(study, V.sets_of({"dt": {}, "dw": {"transform": "dwt"}}))
    return _summary(study, sets, {n: V.fusions(tag)[k] for n, (k, tag) in _VARIANTS.items()}, (10,), ("ndcg_10", "coverage_10", "rsi_10", "mae", "spearman_rho"))


_CV = ("cv_0", "cv_1", "cv_2", "cv_3", "sd_r", "sd_w")


def _shifted(tag: str, transform: str, how: str) -> str:
    """sv_<tag>: per window the variation of energies over nine circular shifts."""
    return f"""{WS.features(3, transform, how, tag, "rolled")},
sv_{tag} AS (SELECT window_id, item_id // 16 AS item_id, {", ".join(f"coalesce(stddev_pop(e{b}) / nullif(avg(e{b}), 0), 0) AS cv_{b}" for b in range(4))}, stddev_pop(r) AS sd_r, stddev_pop(w_e) AS sd_w FROM fe_{tag} GROUP BY 1, 2)"""


_ROLLED = "fulls AS (SELECT window_id, CAST(item_id AS BIGINT) AS item_id, max(truth) AS truth, list(v ORDER BY i DESC) AS x FROM fr_x WHERE n = 64 GROUP BY 1, 2), rolled AS (SELECT window_id, item_id * 16 + s AS item_id, truth, list_concat(x[65 - s:64], x[1:64 - s]) AS x FROM fulls, (SELECT unnest(range(0, 9)) AS s))"


def _shifts(spark, sf_dir):
    rows = _frames(spark, sf_dir)[1].where("size(x_w) = 64").select("window_id", "item_id", "x_w")
    return {t: V.shift_energies(rows, transform=t) for t in _BOTH}


@query(with_(*_WINDOWS, _ROLLED, _shifted("dt", "dtcwt", "periodic"), _shifted("dw", "dwt", "periodization")) + " UNION ALL ".join(f"SELECT '{t}' AS transform, {', '.join(f'{Q.r6(f'avg({c})')} AS {c}' for c in _CV)} FROM sv_{tag}" for t, tag in _BOTH.items()))
def w13_shift_variation(spark, sf_dir):
    both = G.union_all([d.withColumn("transform", F.lit(t)) for t, d in _shifts(spark, sf_dir).items()])
    return P.rounded(both.groupBy("transform").agg(*[F.avg(c).alias(c) for c in _CV]))


_HIGHER = ", ".join(f"CAST(sum(CASE WHEN round(a.{c}, 9) > round(b.{c}, 9) THEN 1 ELSE 0 END) AS BIGINT) AS higher_{c}, {Q.r6(f'avg(a.{c})')} AS dual_{c}, {Q.r6(f'avg(b.{c})')} AS decimated_{c}" for c in _CV)


@query(with_(*_WINDOWS, _ROLLED, _shifted("dt", "dtcwt", "periodic"), _shifted("dw", "dwt", "periodization")) + f"SELECT window_id, count(*) AS num_items, {_HIGHER} FROM sv_dt a JOIN sv_dw b USING (window_id, item_id) GROUP BY window_id")
def e10_shift_windows(spark, sf_dir):
    """Per window: mean variation under shifts of both transforms, and items for which that of the dual tree is higher."""
    dual, decimated = (_shifts(spark, sf_dir)[t].select("window_id", "item_id", *[F.col(c).alias(f"{n}_{c}") for c in _CV]) for t, n in (("dtcwt", "dual"), ("dwt", "decimated")))
    both = dual.join(decimated, ["window_id", "item_id"])
    columns = [x for c in _CV for x in (F.sum((F.round(f"dual_{c}", 9) > F.round(f"decimated_{c}", 9)).cast("long")).alias(f"higher_{c}"), F.avg(f"dual_{c}").alias(f"dual_{c}"), F.avg(f"decimated_{c}").alias(f"decimated_{c}"))]
    return P.rounded(both.groupBy("window_id").agg(F.count("*").alias("num_items"), *columns))


_LEVELS = (2, 3, 4, 5)


@query(with_(*_WINDOWS, WS.padded(), *[WS.features(j, tag=f"j{j}") for j in _LEVELS], "sc AS (" + " UNION ALL ".join(WS.scores({f"WSPI J={j}": WS.index()}, f"fe_j{j}") for j in _LEVELS) + ")", WS.protocol()) + WS.summary())
def e3_level_sweep(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    sets = _made(study, V.sets_of({f"j{j}": {"level": j} for j in _LEVELS}))
    return _summary(study, sets, {f"WSPI J={j}": V.index(of=f"j{j}") for j in _LEVELS})


_PADDINGS = {"rs": ("reflect", "symmetric"), "ee": ("edge", "edge"), "zz": ("zero", "zero"), "sp": ("symmetric", "periodic")}


@query(with_(*_WINDOWS, *[WS.padded(how=p).replace("xs AS", f"xs_{k} AS").replace("FROM xs)", f"FROM xs_{k})").replace("px AS", f"px_{k} AS") + ",\n" + WS.features(how=h, tag=k, source=f"px_{k}") for k, (p, h) in _PADDINGS.items()], "sc AS (" + " UNION ALL ".join(WS.scores({f"{p}/{h}": WS.index()}, f"fe_{k}") for k, (p, h) in _PADDINGS.items()) + ")", WS.protocol()) + WS.summary())
def e8_padding(spark, sf_dir):
    """Ways to fill short windows and to continue windows at their ends."""
    study = P.weekly(spark, sf_dir)
    sets = _made(study, V.sets_of({k: {"pad": p, "how": h} for k, (p, h) in _PADDINGS.items()}))
    return _summary(study, sets, {f"{p}/{h}": V.index(of=k) for k, (p, h) in _PADDINGS.items()})


@query(with_(*_WINDOWS, WS.padded(), WS.features(), f"sc AS ({WS.scores({'WSPI': WS.index()}, 'fe_f')})", WS.protocol((10,)), "fl AS (SELECT window_id, avg(CASE WHEN n < 64 THEN 1.0 ELSE 0.0 END) AS padded FROM fr GROUP BY 1), pf AS (SELECT pr.*, padded > 0 AS padded FROM pr JOIN fl USING (window_id))") + " UNION ALL ".join(f"SELECT '{part}' AS part, count(*) AS n_windows, {Q.r6('avg(ndcg_10)')} AS ndcg_10, {Q.r6('avg(rsi_10)')} AS rsi_10, {Q.r6('avg(CASE WHEN padded THEN 1.0 ELSE 0.0 END)')} AS padded_share FROM pf WHERE {rule}" for part, rule in (("all", "true"), ("padded", "padded"), ("whole", "NOT padded"))))
def e8_padded_share(spark, sf_dir):
    """Metrics of all windows, of the padded ones and of those of full length."""
    study, rows = _open(spark, sf_dir)
    flags = rows.groupBy("window_id").agg(F.max((F.size("x_w") < 64).cast("int")).alias("padded"))
    pr = study.measured(V.wavelet_features(rows).select(*_KEEP, "mu_l", "r", "w_e"), {"WSPI": V.index()}, (10,), rho=False).join(flags, "window_id")
    parts = [pr.where(rule).agg(F.lit(part).alias("part"), F.count("*").alias("n_windows"), F.avg("ndcg_10").alias("ndcg_10"), F.avg("rsi_10").alias("rsi_10"), F.avg(F.col("padded").cast("double")).alias("padded_share")) for part, rule in (("all", "true"), ("padded", "padded = 1"), ("whole", "padded = 0"))]
    return P.rounded(G.union_all(parts))


#: Exponents of the grid study.
GRID = (0.0, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0)
_PAIRS = {f"{100 * a:g}_{100 * b:g}": (a, b) for a in GRID for b in GRID}
_GRID_SQL = (*_WINDOWS, WS.padded(), WS.features(), f"fx AS (SELECT window_id, item_id, truth, mu_l, r, w_e FROM fe_f), sc AS ({WS.scores({n: WS.index(a, b) for n, (a, b) in _PAIRS.items()}, 'fx')})", WS.protocol((10,)), "wi AS (SELECT window_id, row_number() OVER (ORDER BY window_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT window_id FROM pr)), ps AS (SELECT pr.*, CASE WHEN k <= floor(0.3 * n) THEN 'tune' ELSE 'test' END AS part FROM pr JOIN wi USING (window_id))")
_GRID_SUM = "gs AS (SELECT method, part, count(*) AS n_windows, avg(ndcg_10) AS ndcg_10, avg(rsi_10) AS rsi_10 FROM (SELECT method, part, ndcg_10, rsi_10 FROM ps UNION ALL SELECT method, 'all', ndcg_10, rsi_10 FROM ps) GROUP BY 1, 2)"


def _grid(spark, sf_dir):
    """Metric rows of every pair of exponents (named by a hundred times each), with the part of the windows."""
    study = P.weekly(spark, sf_dir)
    feats = _made(study, V.features_of("mu_l", "r", "w_e"))
    rows = P.held(study.measured(feats, {n: V.index(a, b) for n, (a, b) in _PAIRS.items()}, (10,), rho=False).select("window_id", "method", "ndcg_10", "rsi_10"), "grid")
    return rows.join(G.time_split(rows), "window_id")


@query(with_(*_GRID_SQL, _GRID_SUM) + f"SELECT method, part, n_windows, {Q.r6('ndcg_10')} AS ndcg_10, {Q.r6('rsi_10')} AS rsi_10 FROM gs")
def e6_grid_summary(spark, sf_dir):
    """Means of every configuration over all windows, the first 30 % of them and the rest."""
    return P.rounded(grid_summary(_grid(spark, sf_dir)))


_SELECTED = """tn AS (SELECT method, ndcg_10, rsi_10, abs(CAST(split_part(method, '_', 1) AS DOUBLE) - 100) + abs(CAST(split_part(method, '_', 2) AS DOUBLE) - 100) AS away, ndcg_10 >= 0.99::DOUBLE * max(ndcg_10) OVER () AS feasible FROM gs WHERE part = 'tune')"""


@query(with_(*_GRID_SQL, _GRID_SUM, _SELECTED) + f"SELECT method, {Q.r6('tn.ndcg_10')} AS tune_ndcg_10, {Q.r6('tn.rsi_10')} AS tune_rsi_10, {Q.r6('te.ndcg_10')} AS test_ndcg_10, {Q.r6('te.rsi_10')} AS test_rsi_10, feasible, row_number() OVER (ORDER BY feasible DESC, round(tn.rsi_10, 4) DESC, round(tn.ndcg_10, 4) DESC, away, method) = 1 AS selected FROM tn JOIN (SELECT * FROM gs WHERE part = 'test') te USING (method)")
def e4_parameter_grid(spark, sf_dir):
    """The 7 x 7 grid; of the configurations within 1 % of the best NDCG of the tuning windows the one with the most stable top 10, and what it gives on the test windows."""
    return P.rounded(select_config(grid_summary(_grid(spark, sf_dir))))


@query(with_(*_GRID_SQL, _GRID_SUM, _SELECTED) + f", sf AS (SELECT method, ndcg_10, rsi_10, away, ndcg_10 >= 0.99::DOUBLE * max(ndcg_10) OVER () AS fits FROM tn WHERE CAST(split_part(method, '_', 1) AS DOUBLE) + CAST(split_part(method, '_', 2) AS DOUBLE) = 200), se AS (SELECT method, row_number() OVER (ORDER BY fits DESC, round(rsi_10, 4) DESC, round(ndcg_10, 4) DESC, away, method) AS k FROM sf) SELECT method, {Q.r6('CAST(split_part(method, chr(95), 1) AS DOUBLE) / 200')} AS share, {Q.r6('gs.ndcg_10')} AS ndcg_10, {Q.r6('gs.rsi_10')} AS rsi_10, k = 1 AS selected FROM se JOIN gs USING (method) WHERE gs.part = 'test'")
def e6_equal_sum(spark, sf_dir):
    """The configurations whose exponents sum to two, with alpha's share, chosen among themselves."""
    rows = _grid(spark, sf_dir)
    a, b = (F.element_at(F.split("method", "_"), i).cast("double") for i in (1, 2))
    out = select_config(grid_summary(rows).where(a + b == 200))
    return P.rounded(out.select("method", (a / 200).alias("share"), F.col("test_ndcg_10").alias("ndcg_10"), F.col("test_rsi_10").alias("rsi_10"), "selected"))


def grid_summary(rows):
    """Per configuration and part (tune, test, all): windows and means."""
    both = rows.unionByName(rows.withColumn("part", F.lit("all")))
    return both.groupBy("method", "part").agg(F.count("*").alias("n_windows"), F.avg("ndcg_10").alias("ndcg_10"), F.avg("rsi_10").alias("rsi_10"))


def select_config(summary, tolerance: float = 0.01, default: tuple[float, float] = (100.0, 100.0)):
    """Flags the feasible configurations by the tuning windows and the one chosen: most stable, then best, then nearest to the default (4 digits)."""
    from pyspark.sql import Window

    everything = Window.partitionBy()
    a, b = (F.element_at(F.split("method", "_"), i).cast("double") for i in (1, 2))
    means = lambda part: summary.where(F.col("part") == part).select("method", *[F.col(m).alias(f"{part}_{m}") for m in ("ndcg_10", "rsi_10")])
    rows = means("tune").join(means("test"), "method").withColumn("feasible", F.col("tune_ndcg_10") >= (1 - tolerance) * F.max("tune_ndcg_10").over(everything)).withColumn("away", F.abs(a - default[0]) + F.abs(b - default[1]))
    order = everything.orderBy(F.desc("feasible"), F.desc(F.round("tune_rsi_10", 4)), F.desc(F.round("tune_ndcg_10", 4)), "away", "method")
    return rows.withColumn("selected", F.row_number().over(order) == 1).drop("away")


# Forecasts of coefficients

_AHEAD = lambda h, clamps=(4.0,): (Q.DEMAND, Q.frames(64, 32, horizon=h), WS.padded(), WS.features(), WS.forecasts(h, clamps))


@query(with_(*_AHEAD(8), f"sc AS ({WS.scores(WS.FORECAST_SCORES | {'WSPI': WS.index()}, 'fo')})", WS.protocol()) + WS.summary())
def f10_forecast_indices(spark, sf_dir):
    """Forecast indices for the eight slots to come, judged by their sum."""
    study = P.weekly(spark, sf_dir)
    fore = _made(study, V.forecasts_of(8), 8)
    return _summary(study, fore, V.forecast_scores() | {"WSPI": V.index()})


_FIVE = ("ndcg_10", "coverage_10", "rsi_10", "mae", "spearman_rho")


@query(with_(*_AHEAD(8, V.CLAMPS), f"sc AS ({WS.scores(WS.SKILLED | WS.SENSITIVE, 'fo')})", WS.protocol((10,))) + WS.summary(_FIVE))
def f11_forecast_settings(spark, sf_dir):
    """Four skill factors, and every clamp, gate exponent and trust factor, for eight slots to come."""
    study = P.weekly(spark, sf_dir)
    fore = _made(study, V.forecasts_of(8, clamps=V.CLAMPS, kappas=V.KAPPAS), 8)
    return _summary(study, fore, V.skilled_scores() | V.sensitivity_scores(), (10,), _FIVE)


_VALUES = ", ".join(f"{Q.r6(c)} AS {c}" for c in ("mu_nlms_c4", "mu_yw_c4", "mu_ts_c4", "mu_level_c4", "mu_yw_free", "mu_mean_free", "mu_mean_level"))


@query(with_(*_AHEAD(8)) + f"SELECT window_id, item_id, {_VALUES}, {Q.r6(WS.GATE)} AS gate, {Q.r6(WS.skill(1))} AS skill_1 FROM fo")
def f1_coefficient_forecasts(spark, sf_dir):
    """Extended means of every forecaster, backtest gate and skill factor of each window."""
    fore = V.coefficient_forecasts(V.wavelet_features(_bare(spark, sf_dir, 8)), horizon=8)
    return P.rounded(fore.select("window_id", "item_id", *[c for c in fore.columns if c.startswith("mu_") and c != "mu_l"], "gate", "skill_1"))


_HORIZONS = (1, 8, 24)


def _prediction_scores(h: int) -> dict:
    """Scores of all methods of the prediction runs at a horizon, over what _prediction_part makes."""
    levels = {"Persistence": "Persistence", "MA64": "SMA64"} | {f"{w}{n}": f"{w}{n}" for w in ("SMA", "EWMA") for n in S.SPANS}
    made = (*V.forecast_scores(), *V.skilled_scores(), "Holt", "ARYW")
    return {n: F.col(f"`{n}_{h}`") for n in made} | {"WSPI": F.col("WSPI")} | {n: F.col(c) * h for n, c in levels.items()}


def _prediction_part(horizons: tuple[int, ...]) -> N.Part:
    (own, values), (names, scores) = S.forecasts_of(horizons), V.scores_at(horizons)
    return N.Part(64, 32, (*own, *names), lambda m: values(m) | scores(m))


def _predicted(h: int) -> str:
    """Scores of all methods of the prediction runs at a horizon."""
    from_rows = {"Persistence": f"{h} * greatest(max(CASE WHEN i = 0 THEN v END), 0)", "MA64": f"{h} * sum(v) / max(n)"}
    from_rows |= {f"SMA{n}": f"{h} * sum(CASE WHEN i < {n} THEN v ELSE 0 END) / least({n}, max(n))" for n in (8, 16, 32, 64)}
    from_rows |= {f"EWMA{n}": f"{h} * sum(CASE WHEN i = n - 1 THEN pow({n - 1} / {n + 1}.0, n - 1) ELSE 2.0 / {n + 1} * pow({n - 1} / {n + 1}.0, i) END * v)" for n in (8, 16, 32, 64)}
    steps = f"list_reduce(list_transform(range(0, {h + 1}), lambda k: [x[n] - m, x[n - 1] - m, 0.0]), lambda s, e: [p1 * s[1] + p2 * s[2], s[1], s[3] + greatest(0.0, p1 * s[1] + p2 * s[2] + m)])[3]"
    fitted = """hx AS (SELECT window_id, item_id, max(truth) AS truth, list(v ORDER BY i DESC) AS x FROM fr_x GROUP BY 1, 2), h1 AS (SELECT *, len(x) AS n, list_avg(x) AS m FROM hx), h2 AS (SELECT *, list_transform(x, lambda v: v - m) AS dev FROM h1),
h3 AS (SELECT *, list_dot_product(dev, dev) / n AS r0, list_dot_product(dev[1:n - 1], dev[2:n]) / n AS r1, list_dot_product(dev[1:n - 2], dev[3:n]) / n AS r2 FROM h2), h4 AS (SELECT *, (r0 + 1e-8) * (r0 + 1e-8) - r1 * r1 AS det FROM h3),
h5 AS (SELECT *, ((r0 + 1e-8) * r1 - r1 * r2) / nullif(det, 0) AS p1, ((r0 + 1e-8) * r2 - r1 * r1) / nullif(det, 0) AS p2 FROM h4)"""
    holt = f"SELECT window_id, item_id, truth, 'Holt' AS method, {_HOLT_SUM(h)} AS score FROM (SELECT *, {_HOLT_X} AS lb FROM hx)"
    ar = f"SELECT window_id, item_id, truth, 'ARYW', CASE WHEN r0 <= 1e-12 OR p1 IS NULL OR abs(p1) + abs(p2) > 4 THEN {h} * greatest(m, 0) ELSE {steps} END FROM h5"
    made = WS.scores(WS.FORECAST_SCORES | WS.SKILLED | {"WSPI": WS.index()}, "fo")
    return f"SELECT window_id, item_id, truth, '{h}:' || method AS method, score FROM ({with_(*_AHEAD(h)[1:], fitted)}{Q.long(from_rows)} UNION ALL {holt} UNION ALL {ar} UNION ALL {made})"


_RUNS = "SELECT CAST(split_part(method, ':', 1) AS INTEGER) AS horizon, split_part(method, ':', 2) AS method, * EXCLUDE (method) FROM ({0})"


@query(_RUNS.format(with_(Q.DEMAND, f"sc AS (SELECT window_id, item_id, truth, method, round(score, 9) AS score FROM ({' UNION ALL '.join(_predicted(h) for h in _HORIZONS)}))", WS.protocol((10,))) + WS.summary(_FIVE)))
def e19_prediction_runs(spark, sf_dir):
    """Every forecaster at horizons of 1, 8 and 24 slots, from one pass over the windows: coefficient forecasts, levels, controls and value forecasters."""
    study = P.weekly(spark, sf_dir)
    scores = {f"{h}:{n}": c for h in _HORIZONS for n, c in _prediction_scores(h).items()}
    rows = study.measured(study.ahead(_prediction_part(_HORIZONS), _HORIZONS), scores, (10,), truths={m: f"truth_{m.split(':')[0]}" for m in scores})
    out = R.summarize(rows, _FIVE)
    return P.rounded(out.withColumn("horizon", F.split_part("method", F.lit(":"), F.lit(1)).cast("int")).withColumn("method", F.split_part("method", F.lit(":"), F.lit(2))))


_RATIO = "round(score / nullif(base, 0), 9)"


@query(with_(*_AHEAD(1), f"sc AS ({WS.scores(WS.FORECAST_SCORES, 'fo')}), rt AS (SELECT method, score, round({WS.index()}, 9) AS base FROM sc JOIN fe_f USING (window_id, item_id))") + f"SELECT method, {Q.r6(f'min({_RATIO})')} AS least, {Q.r6(f'max({_RATIO})')} AS most, CAST(count(CASE WHEN {_RATIO} < 0.25 THEN 1 END) AS BIGINT) AS n_below, CAST(count(CASE WHEN {_RATIO} > 4 THEN 1 END) AS BIGINT) AS n_above, CAST(count(CASE WHEN base = 0 THEN 1 END) AS BIGINT) AS n_zero_base, CAST(0 AS BIGINT) AS n_nonfinite FROM rt GROUP BY method")
def f13_score_bounds(spark, sf_dir):
    """Ratio of each forecast index to the plain one."""
    fore = V.coefficient_forecasts(V.wavelet_features(_bare(spark, sf_dir)))
    long = R.to_long(fore.select("window_id", "item_id", F.round(V.index(), 9).alias("base"), *P.named(V.forecast_scores())), list(V.forecast_scores()), ["window_id", "item_id", "base"])
    ratio = F.round(F.round("score", 9) / F.nullif(F.col("base"), F.lit(0.0)), 9)
    count = lambda rule: F.coalesce(F.sum(rule.cast("int")), F.lit(0))
    return P.rounded(long.groupBy("method").agg(F.min(ratio).alias("least"), F.max(ratio).alias("most"), count(ratio < 0.25).alias("n_below"), count(ratio > 4).alias("n_above"), count(F.col("base") == 0).alias("n_zero_base"), count(F.isnan("score")).alias("n_nonfinite")))


@query(with_(*_AHEAD(1)) + f"SELECT window_id, {Q.r6(f'median({WS.structural()})')} AS median_structural, {Q.r6(f'avg({WS.structural()})')} AS mean_structural, {Q.r6(f'median({WS.GATE})')} AS median_backtest, {Q.r6(f'avg(CASE WHEN round({WS.GATE}, 9) > 0 THEN 1.0 ELSE 0.0 END)')} AS share_open FROM fo GROUP BY window_id")
def f14_gate_profile(spark, sf_dir):
    """Medians and means of both gates per window; the medians by selection, whatever a window's number of items."""
    fore = stored(V.coefficient_forecasts(V.wavelet_features(_bare(spark, sf_dir))).select("window_id", V.structural_gate().alias("median_structural"), F.col("gate").alias("median_backtest")), "gates")
    means = fore.groupBy("window_id").agg(F.avg("median_structural").alias("mean_structural"), F.avg((F.round("median_backtest", 9) > 0).cast("double")).alias("share_open"))
    gates = ["median_structural", "median_backtest"]
    medians = selection.quantiles(fore.unpivot(["window_id"], gates, "gate", "value"), ["window_id", "gate"], "value", {"median": 0.5})
    wide = medians.groupBy("window_id").agg(*[F.max(F.when(F.col("gate") == g, F.col("median"))).alias(g) for g in gates])
    return P.rounded(means.join(wide, "window_id").select("window_id", "median_structural", "mean_structural", "median_backtest", "share_open"))


_BINS = f"gb AS (SELECT least(floor(round({WS.structural()}, 9) * 10000), 9999) AS bin, count(*) AS n FROM fe_f GROUP BY 1), gr AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM gb)"


@query(with_(*_WINDOWS, WS.padded(), WS.features(), _BINS) + f"SELECT q, {Q.r6('(bin + (q * total - (upto - n)) / n) / 10000')} AS value FROM gr, (SELECT unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS q) WHERE upto >= q * total AND upto - n < q * total")
def f15_gate_quantiles(spark, sf_dir):
    """Quantiles from 10,000 bins, linear inside the bin."""
    from pyspark.sql import Window

    fore = V.wavelet_features(_bare(spark, sf_dir)).select(F.least(F.floor(F.round(V.structural_gate(), 9) * 10000), F.lit(9999)).alias("bin"))
    bins = fore.groupBy("bin").agg(F.count("*").alias("n"))
    run = bins.withColumn("upto", F.sum("n").over(Window.partitionBy().orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    q = run.crossJoin(F.broadcast(spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "q double"))).where((F.col("upto") >= F.col("q") * F.col("all")) & (F.col("upto") - F.col("n") < F.col("q") * F.col("all")))
    return P.rounded(q.select("q", ((F.col("bin") + (F.col("q") * F.col("all") - (F.col("upto") - F.col("n"))) / F.col("n")) / 10000).alias("value")))


_SETTING = lambda i: f"CAST(substr(split_part(method, '_', {i}), 2) AS DOUBLE)"


@query(with_(*_AHEAD(8, V.CLAMPS), f"sc AS ({WS.scores(WS.SENSITIVE, 'fo')})", WS.protocol((10,)), f"se AS (SELECT method, {_SETTING(2)} AS clamp, {_SETTING(3)} AS gamma, {_SETTING(4)} AS trust, avg(ndcg_10) AS ndcg_10, avg(rsi_10) AS rsi_10 FROM pr GROUP BY 1)") + " UNION ALL ".join(f"SELECT '{by}' AS setting, {by} AS value, count(*) AS n, " + ", ".join(f"{Q.r6(f'{f}({m})')} AS {m}_{n}" for m in ("ndcg_10", "rsi_10") for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"))) + f" FROM se GROUP BY {by}" for by in ("clamp", "gamma", "trust")))
def t15_sensitivity(spark, sf_dir):
    """Means and ranges of the gated index over each of its settings."""
    study = P.weekly(spark, sf_dir)
    fore = _made(study, V.forecasts_of(8, clamps=V.CLAMPS), 8)
    means = P.held(study.measured(fore, V.sensitivity_scores(), (10,), rho=False).groupBy("method").agg(F.avg("ndcg_10").alias("ndcg_10"), F.avg("rsi_10").alias("rsi_10")), "sensitivity")
    part = lambda i: F.substring(F.split_part("method", F.lit("_"), F.lit(i)), 2, 9).cast("double")
    named = means.select(part(2).alias("clamp"), part(3).alias("gamma"), part(4).alias("trust"), "ndcg_10", "rsi_10")
    return P.rounded(G.union_all([D.sensitivity(named, by, ("ndcg_10", "rsi_10")).withColumnRenamed(by, "value").withColumn("setting", F.lit(by)) for by in ("clamp", "gamma", "trust")]))


_REFS = "lm AS (SELECT method, window_id, 'ndcg_10' AS metric, round(ndcg_10, 9) AS value FROM pr UNION ALL SELECT method, window_id, 'rsi_10', round(rsi_10, 9) FROM pr WHERE rsi_10 IS NOT NULL), df AS (SELECT a.method, a.metric, a.window_id, round(a.value - b.value, 9) AS d FROM lm a JOIN lm b ON a.metric = b.metric AND a.window_id = b.window_id WHERE b.method = 'WSPI-F2' AND a.method <> 'WSPI-F2')"


@query(with_(*_AHEAD(8), f"sc AS ({WS.scores(WS.SKILLED | {'WSPI-F2': WS.FORECAST_SCORES['WSPI-F2']}, 'fo')})", WS.protocol((10,)), _REFS, TS.blocks(8, "metric, method"), TS.signed_ranks("pb", "bl", "metric, method"), f"vd AS (SELECT metric, method, {TS.verdict('p')} AS verdict FROM (SELECT metric, method, avg(d) AS mean_diff FROM df GROUP BY 1, 2) JOIN pb USING (metric, method)), ks AS (SELECT CAST(substr(method, 8) AS DOUBLE) AS kappa, count(CASE WHEN verdict = 'ref_better' THEN 1 END) >= 1 AND count(CASE WHEN verdict = 'ref_worse' THEN 1 END) = 0 AS ok FROM vd GROUP BY 1)") + "SELECT kappa, CAST(1 AS BIGINT) AS n_cells, CAST(1 AS BIGINT) AS n_complete, CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS n_success, row_number() OVER (ORDER BY ok DESC, kappa DESC) = 1 AS selected FROM ks")
def t14_kappa_selection(spark, sf_dir):
    """The skill factor that does best against the gated index at eight slots, of equals the largest."""
    study = P.weekly(spark, sf_dir)
    fore = _made(study, V.forecasts_of(8, kappas=V.KAPPAS), 8)
    rows = P.held(T.long_metrics(study.measured(fore, V.skilled_scores() | {"WSPI-F2": V.forecast_scores()["WSPI-F2"]}, (10,), rho=False), ("ndcg_10", "rsi_10")), "kappa")
    turned = T.paired(rows, "WSPI-F2").withColumn("diff", -F.col("diff"))  # each skill factor is the reference
    out = turned.groupBy("metric", "method").agg(F.avg("diff").alias("mean_diff")).join(T.tests(turned, 8), ["metric", "method"]).withColumn("verdict", T.verdict("p_block"))
    cells = out.select(F.substring("method", 8, 9).cast("double").alias("kappa"), F.lit("supplier").alias("scenario"), F.lit(8).alias("horizon"), "metric", "verdict")
    return D.select_setting(cells, "kappa", ("ndcg_10", "rsi_10"), 1)


_SUMS = {f"sum_{k}": f"ln(1 + sum(CASE WHEN i < {k} THEN v ELSE 0 END))" for k in (1, 2, 4, 8, 16, 32, 64)} | {"slope_16": "sum(CASE WHEN i < 16 THEN v * ((least(n, 16) - 1) / 2.0 - i) ELSE 0 END) / max(least(n, 16) * (least(n, 16) * least(n, 16) - 1) / 12.0)", "zero_share": "avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END)"}


@query(with_(*_WINDOWS) + "SELECT window_id, item_id, " + ", ".join(f"{Q.r6(x)} AS {n}" for n, x in _SUMS.items()) + " FROM fr_x GROUP BY 1, 2")
def f17_ranker_features(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    rows = P.held(study.wide(_ranker_part(L.FEATURES, L.of_matrix)), "ranker-features")
    return P.rounded(rows.join(F.broadcast(study.valid(rows)), "window_id", "left_semi").drop("truth"))


@query()
def f16_nlms_convergence(spark, sf_dir):
    return P.rounded(V.nlms_convergence(V.wavelet_features(_bare(spark, sf_dir))))


# Relations of features

_MIN_SD = lambda c: f"stddev_pop({c}) >= 1e-12"
_CORR = lambda a, b: f"CASE WHEN count(*) >= 10 AND {_MIN_SD(a)} AND {_MIN_SD(b)} THEN corr({a}, {b}) END"
_RANKS_SQL = "rl AS (SELECT *, " + ", ".join(f"rank() OVER (PARTITION BY window_id ORDER BY {c}) + (count(*) OVER (PARTITION BY window_id, {c}) - 1) / 2.0 AS r_{c}" for c in ("r", "w_e", "truth", "mu_l")) + " FROM rd)"
_REL = "rs AS (SELECT window_id, count(*) AS n, " + ", ".join(f"{_CORR(a, b)} AS {n}" for n, a, b in (("s_r", "r_r", "r_truth"), ("p_r", "r", "truth"), ("s_w", "r_w_e", "r_truth"), ("p_w", "w_e", "truth"), ("rm", "r_r", "r_mu_l"), ("wm", "r_w_e", "r_mu_l"), ("tm", "r_truth", "r_mu_l"))) + " FROM rl GROUP BY 1)"
_DIGITS = "rd AS (SELECT window_id, item_id, truth, round(r, 9) AS r, round(w_e, 9) AS w_e, round(mu_l, 9) AS mu_l FROM fe_f)"


def _nine(rows):
    """Features at nine digits, so that equal windows tie wherever they are worked out."""
    return rows.select(*_KEEP, *[F.round(c, 9).alias(c) for c in ("r", "w_e", "mu_l")])


@query(with_(*_WINDOWS, WS.padded(), WS.features(), _DIGITS, _RANKS_SQL, _REL) + "SELECT window_id, n, " + ", ".join(f"{Q.r6(x)} AS {n}" for n, x in {"spearman_r": "s_r", "pearson_r": "p_r", "partial_r": "(s_r - rm * tm) / nullif(sqrt((1 - rm * rm) * (1 - tm * tm)), 0)", "spearman_w_e": "s_w", "pearson_w_e": "p_w", "partial_w_e": "(s_w - wm * tm) / nullif(sqrt((1 - wm * wm) * (1 - tm * tm)), 0)"}.items()) + " FROM rs")
def e11_feature_relation(spark, sf_dir):
    return P.rounded(L2.within_window(_nine(V.wavelet_features(_bare(spark, sf_dir))), ["r", "w_e"], "truth", "mu_l"))


_CELLS = lambda n: f"sp AS (SELECT min(r) AS r0, max(r) AS r1, min(w_e) AS w0, max(w_e) AS w1 FROM rd), ce AS (SELECT CAST(least(floor((r - r0) / (r1 - r0 + 1e-12) * {n}), {n - 1}) AS INTEGER) AS i, CAST(least(floor((w_e - w0) / (w1 - w0 + 1e-12) * {n}), {n - 1}) AS INTEGER) AS j, count(*) AS n FROM rd, sp GROUP BY 1, 2)"


@query(with_(*_WINDOWS, WS.padded(), WS.features(), _DIGITS, _CELLS(20), "cj AS (SELECT *, sum(n) OVER (PARTITION BY i) AS ni, sum(n) OVER (PARTITION BY j) AS nj, sum(n) OVER () AS total FROM ce), mi AS (SELECT sum(n / total * ln(n * total / (ni * nj))) AS m FROM (SELECT n::DOUBLE AS n, ni::DOUBLE AS ni, nj::DOUBLE AS nj, total::DOUBLE AS total FROM cj))") + f"SELECT {Q.r6('(SELECT m FROM mi)')} AS mutual_information, {Q.r6('corr(r, w_e)')} AS r, {Q.r6('1 / (1 - corr(r, w_e) * corr(r, w_e))')} AS vif, {Q.r6('avg(CASE WHEN r > 0.5 THEN 1.0 ELSE 0.0 END)')} AS share_above_half FROM rd")
def e12_dependence(spark, sf_dir):
    """Mutual information, correlation and variance inflation of two features over all windows."""
    rows = _nine(V.wavelet_features(_bare(spark, sf_dir)))
    return P.rounded(L2.mutual_information(rows, "r", "w_e").crossJoin(L2.collinearity(rows, ("r", "w_e"))))


@query(with_(*_WINDOWS, WS.padded(), WS.features(), _DIGITS) + " UNION ALL ".join(f"SELECT '{c}' AS name, " + ", ".join(f"{Q.r6(f'quantile_cont({c}, {q})')} AS q{round(100 * q):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM rd" for c in ("r", "w_e", "mu_l")))
def e12_quantiles(spark, sf_dir):
    return P.rounded(L2.quantiles(_nine(V.wavelet_features(_bare(spark, sf_dir))), ["r", "w_e", "mu_l"]))


@query()
def e12_pooled_relation(spark, sf_dir):
    """Share of the truth's variance between bins of equal size; ties of the feature fall into either bin."""
    return P.rounded(L2.eta_squared(_nine(V.wavelet_features(_bare(spark, sf_dir))), "r", "truth"))


@query(with_(*_WINDOWS, WS.padded(), WS.features(), _DIGITS, _CELLS(100)) + "SELECT i, j, n FROM ce")
def e13_density(spark, sf_dir):
    return L2.density(_nine(V.wavelet_features(_bare(spark, sf_dir))), "r", "w_e")


# Learned ranker

_FIRST_TEST = "ft AS (SELECT min(window_id) AS first FROM (SELECT window_id, row_number() OVER (ORDER BY window_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT window_id FROM fr)) WHERE k > floor(0.3 * n))"


def _ranker_part(names: tuple[str, ...] = (), work=None) -> list[N.Part]:
    return [N.Part(64, 32, names, work)]


def _ranker_windows(study):
    """Eligible rows, the windows that count, and the first test window (0 if there is none); no window is made for them."""
    rows = P.held(study.wide(_ranker_part()), "ranker-rows")
    valid = P.held(study.valid(rows), "ranker-windows")
    return rows, valid, L.first_test_window(valid) or 0


@query(with_(*_WINDOWS, _FIRST_TEST) + f"SELECT window_id, item_id, {Q.r6('ln(1 + truth)')} AS label FROM fr, ft WHERE window_id < first ORDER BY CAST('0x' || substr(md5('42:' || window_id || ':' || item_id), 1, 12) AS BIGINT), window_id, item_id LIMIT 2000")
def f18_training_rows(spark, sf_dir):
    """2000 of the rows that learned rankers are fitted on, in hash order: windows whose truth ends before the first test window."""
    rows, valid, first_test = _ranker_windows(P.weekly(spark, sf_dir))
    return P.rounded(L.training_rows(rows.join(F.broadcast(valid), "window_id", "left_semi"), first_test, sample=2000).select("window_id", "item_id", "label"))


@query()
def f19_learned_ranker(spark, sf_dir):
    """300 rounds of leaf-wise trees on plain window features (GBM) and on these with the transform's (GBM+W), both fitted on all rows before the first test window."""
    study = P.weekly(spark, sf_dir)
    names, work = L.features_of("mu_l", "r", "w_e")
    _, valid, first_test = _ranker_windows(study)
    train = L.training_rows(study.wide(_ranker_part(names, work), until=first_test).join(F.broadcast(valid), "window_id", "left_semi"), first_test)
    models = L.fit_rankers(train, {"GBM": list(L.FEATURES), "GBM+W": list(names)})
    scored = _ranker_part(*L.predictions_of(spark.sparkContext.broadcast(models), work))
    return P.rounded(R.summarize(study.measured(study.wide(scored, since=first_test), L.scores(models))))
