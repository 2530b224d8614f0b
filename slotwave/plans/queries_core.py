"""Queries on the grid, the scorers, ranks and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scorers as S
from ..operators import grid as G
from ..operators import ranking as R
from . import checks_sql as Q
from . import popularity as P
from .registry import query, with_


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = P.weekly(spark, sf_dir).scored([S.BASELINES[0]])
    out = R.with_rsi(R.window_metrics(R.rank_items(scored), (10,)), (10,))
    return P.rounded(out.select("window_id", "num_items", "ndcg_10", "coverage_10", "rsi_10"))


_SC = lambda *names: f"sc AS (SELECT window_id, item_id, truth, method, round(score, 9) AS score FROM ({Q.long({k: Q.SCORES[k] for k in names})}))"

query(
    with_(Q.DEMAND, Q.frames(7, 3), _SC("AF"), Q.RANKED, Q.rsi(10))
    + f"SELECT r.window_id, count(*) AS num_items, {Q.r6(Q.ndcg(10))} AS ndcg_10, {Q.r6(Q.coverage(10))} AS coverage_10, {Q.r6('max(rsi)')} AS rsi_10 FROM ranked r JOIN rsi USING (method, window_id) GROUP BY r.window_id"
)(flagship)


@query(with_(Q.DEMAND) + "SELECT item_id, slot, v, present FROM dense")
def g4_densify(spark, sf_dir):
    return P.weekly(spark, sf_dir).dense


@query("SELECT CAST(10080 AS BIGINT) AS slot_minutes, min(date_trunc('week', l_shipdate)) AS t0, CAST(date_diff('day', CAST(min(date_trunc('week', l_shipdate)) AS DATE), CAST(max(date_trunc('week', l_shipdate)) AS DATE)) // 7 AS INTEGER) AS n_slots FROM lineitem")
def g1_infer_grid(spark, sf_dir):
    demand = P.supplier_weeks(spark, sf_dir)
    return G.infer_grid(demand).select((F.col("slot_seconds") / 60).cast("long").alias("slot_minutes"), "t0", "n_slots")


@query(with_(Q.DEMAND, Q.frames(64, 32)) + "SELECT window_id, item_id, truth, n AS length FROM fr")
def g7_causal_windows(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    rows = study.windows({"w": 64}).where(G.eligible("w", 32, P.MIN_TOTAL))
    return G.valid_windows(rows.select("window_id", "item_id", "truth", F.size("x_w").alias("length")), study.dense, ["window_id"])


@query(with_(Q.DEMAND, Q.frames(7, 3, horizon=8)) + "SELECT window_id, item_id, truth, n AS length FROM fr")
def g12_horizon_truth(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    rows = study.windows({"w": 7}, 8, chunk=100).where(G.eligible("w", 3, P.MIN_TOTAL))
    return G.valid_windows(rows.select("window_id", "item_id", "truth", F.size("x_w").cast("int").alias("length")), study.dense, ["window_id"])


_NAMES = tuple(s.name for s in S.BASELINES)


@query(with_(Q.DEMAND, Q.frames(7, 3)) + "SELECT window_id, item_id, truth, " + ", ".join(f'{Q.r6(chr(34) + k + chr(34))} AS "{k}"' for k in _NAMES) + f" FROM ({Q.wide(Q.SCORES)})")
def x1_baseline_scores(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    rows = study.windows({"w": 7}).where(G.eligible("w", 3, P.MIN_TOTAL)).select("window_id", "item_id", "truth", *S.all_baselines(F.col("x_w")))
    return P.rounded(G.valid_windows(rows, study.dense, ["window_id"]))


_METRICS_SQL = ", ".join([f"{Q.r6(Q.ndcg(k))} AS ndcg_{k}, {Q.r6(Q.coverage(k))} AS coverage_{k}" for k in (5, 10, 20)])


@query(with_(Q.DEMAND, Q.frames(7, 3), _SC(*_NAMES), Q.RANKED) + f"SELECT window_id, method, count(*) AS num_items, {_METRICS_SQL}, {Q.r6('avg(abs(score - truth))')} AS mae FROM ranked GROUP BY window_id, method")
def m1_window_metrics(spark, sf_dir):
    scored = P.weekly(spark, sf_dir).scored(list(S.BASELINES)).withColumn("score", F.round("score", 9))
    out = R.window_metrics(R.rank_items(scored))
    return P.rounded(out.select("window_id", "method", "num_items", *[f"{m}_{k}" for k in R.KS for m in ("ndcg", "coverage")], "mae"))
