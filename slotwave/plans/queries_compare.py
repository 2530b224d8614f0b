"""Queries on robustness, events, statistics, decisions, strata, audits and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions import scorers as S
from ..operators import audit as A
from ..operators import cleaning as C
from ..operators import decisions as D
from ..operators import events as E
from ..operators import grid as G
from ..operators import perturb as X
from ..operators import ranking as R
from ..operators import series as N
from ..operators import statistics as T
from ..operators import strata as Z
from ..operators import wavelet as V
from ..sources import tables as SRC
from ..sources.tables import shared_dir
from ..streaming import online
from . import checks_sql as Q
from . import popularity as P
from . import stats_sql as TS
from . import wave_sql as WS
from .queries_study import _NAMES, _frames, _metric_rows, _sc, _scored
from .registry import query, with_

_COUNT = lambda rule: f"CAST(count(CASE WHEN {rule} THEN 1 END) AS BIGINT)"

# Robustness


def _af_frames(spark, sf_dir):
    study, rows = _frames(spark, sf_dir, 7, 3)
    scores = rows.select("window_id", "item_id", "truth", F.lit("AF").alias("method"), F.round(S.af(F.col("x_w")), 9).alias("score"))
    return study, rows, scores


_TARGETS = """tm AS (SELECT window_id, item_id, sum(v) / max(n) AS m, max(n) AS n FROM fr_x GROUP BY 1, 2),
tw AS (SELECT window_id, count(*) AS n_all, count(CASE WHEN m > 0 THEN 1 END) AS n_some, quantile_cont(CASE WHEN m > 0 THEN m END, 0.5) AS half FROM tm GROUP BY 1),
tp AS (SELECT tm.window_id, tm.item_id, tm.m, row_number() OVER (PARTITION BY tm.window_id ORDER BY CAST('0x' || substr(md5('42:' || CAST(tm.window_id AS VARCHAR) || ':' || tm.item_id), 1, 12) AS BIGINT), tm.item_id) AS nth FROM tm JOIN tw USING (window_id) WHERE CASE WHEN n_all < 50 THEN true WHEN n_some < 50 THEN m > 0 ELSE m > 0 AND m <= half END),
targets AS (SELECT * FROM tp WHERE nth <= 50)"""


@query(with_(Q.DEMAND, Q.frames(7, 3), _TARGETS) + "SELECT window_id, item_id FROM targets")
def p1_targets(spark, sf_dir):
    return X.low_activity_targets(_frames(spark, sf_dir, 7, 3)[1])


@query(
    with_(Q.DEMAND, Q.frames(7, 3), _sc("AF"), _TARGETS)
    + f""", new AS (SELECT t.window_id, t.item_id, s.score AS old, round(s.score + greatest(10 * t.m, 1), 9) AS new FROM targets t JOIN sc s USING (window_id, item_id)),
d AS (SELECT n.window_id, n.item_id, sum(CASE WHEN s.item_id <> n.item_id AND (s.score > n.old OR (s.score = n.old AND s.item_id < n.item_id)) THEN 1 ELSE 0 END) - sum(CASE WHEN s.item_id <> n.item_id AND (s.score > n.new OR (s.score = n.new AND s.item_id < n.item_id)) THEN 1 ELSE 0 END) AS c FROM new n JOIN sc s USING (window_id) GROUP BY 1, 2)
SELECT window_id, 'AF' AS method, {Q.r6('avg(abs(c))')} AS distortion, {Q.r6('avg(c)')} AS signed, {Q.r6('avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END)')} AS up_share, count(*) AS n_targets FROM d GROUP BY window_id"""
)
def m9_rank_distortion(spark, sf_dir):
    _, rows, scores = _af_frames(spark, sf_dir)
    targets = X.low_activity_targets(rows)
    changed = rows.join(targets, ["window_id", "item_id"]).select("window_id", F.lit("AF").alias("method"), "item_id", F.round(S.af(X.spiked(F.col("x_w"))), 9).alias("new_score"))
    return P.rounded(X.rank_distortion(X.replaced_ranks(scores, changed)))


_SPIKED = """sk AS (SELECT t.window_id, t.item_id, t.m, c.name, c.size, c.age, c.dur FROM targets t, (VALUES {rows}) c(name, size, age, dur)),
an AS (SELECT window_id, item_id, max(n) AS n FROM fr_x GROUP BY 1, 2),
sn AS (SELECT s.window_id, s.item_id, s.name AS condition, o.score AS old, round(o.score + greatest(s.size * s.m, 1) * (SELECT sum(pow(0.5, k)) FROM (SELECT unnest(range(0, 64)) AS k) WHERE k <= least(greatest(s.age, s.dur), n) - 1 AND k > least(greatest(s.age, s.dur), n) - 1 - s.dur), 9) AS new FROM sk s JOIN an USING (window_id, item_id) JOIN sc o USING (window_id, item_id)),
sd AS (SELECT n.window_id, n.condition, n.item_id, sum(CASE WHEN s.item_id <> n.item_id AND (s.score > n.old OR (s.score = n.old AND s.item_id < n.item_id)) THEN 1 ELSE 0 END) - sum(CASE WHEN s.item_id <> n.item_id AND (s.score > n.new OR (s.score = n.new AND s.item_id < n.item_id)) THEN 1 ELSE 0 END) AS c FROM sn n JOIN sc s USING (window_id) GROUP BY 1, 2, 3),
sw AS (SELECT window_id, condition, avg(abs(c)) AS distortion, avg(c) AS signed, avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END) AS up FROM sd GROUP BY 1, 2)"""
_CONDITIONS = {n: c for n, c in X.SPIKES.items() if c[1] is not None}


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("AF"), _TARGETS, _SPIKED.replace("{rows}", ", ".join(f"('{n}', {s}, {a}, {d})" for n, (s, a, d) in _CONDITIONS.items()))) + f"SELECT 'AF' AS method, condition, {Q.r6('avg(distortion)')} AS distortion, {Q.r6('avg(signed)')} AS signed, {Q.r6('avg(up)')} AS up_share, count(*) AS n_windows FROM sw GROUP BY condition")
def e9_spike_conditions(spark, sf_dir):
    """AF under every spike of a fixed place: sizes, ages and durations."""
    _, rows, scores = _af_frames(spark, sf_dir)
    targets = rows.join(X.low_activity_targets(rows), ["window_id", "item_id"])
    changed = X.spiked_rows(targets, _CONDITIONS).select("window_id", F.lit("AF").alias("method"), "item_id", "condition", F.round(S.af(F.col("x_w")), 9).alias("new_score"))
    ranks = X.rank_distortion(X.replaced_ranks(scores, changed), [*R.BY, "condition"])
    return P.rounded(ranks.groupBy("method", "condition").agg(F.avg("distortion").alias("distortion"), F.avg("signed").alias("signed"), F.avg("up_share").alias("up_share"), F.count("*").alias("n_windows")))


def _robustness(spark, sf_dir, seeds=(1, 2, 3, 4, 5), spikes=X.SPIKES, noises=X.NOISES):
    """Changes of rank of common targets: 13 conditions, five seeds, nine methods in two configurations; every fourth window.

    Windows of 64 slots of the items that all methods can score, of windows in which both configurations have two items.
    """
    study, keys = P.weekly(spark, sf_dir), ["window_id", "item_id"]
    mark = lambda n, least, name: N.Part(n, least, (name,), lambda m: {name: np.ones(len(m))})
    both = study.wide([mark(64, 32, "long"), mark(7, 3, "short")], step=4).groupBy("window_id").agg(F.count("long").alias("a"), F.count("short").alias("b")).where("a >= 2 and b >= 2")
    valid = P.held(both.join(study.live, "window_id", "left_semi").select("window_id"), "robust-valid")
    pool = study.wide([N.Part(64, 32, ("x_w",)), mark(7, 3, "short")], step=4, together=True).join(F.broadcast(valid), "window_id", "left_semi")  # a row a window
    pool = P.held(pool.select(*keys, "x_w"), "robust-windows")
    targets = P.held(X.seeded_targets(pool, seeds), "robust-targets")
    schema = ", ".join(f"`{n}` double" for n in (*X.ROBUST, "mu", "power"))
    chosen = P.held(pool.join(F.broadcast(targets), keys), "robust-chosen")  # 50 rows a window and seed
    after = P.held(V._batchwise(X.spiked_rows(chosen, spikes), "x_w", schema, X.robust_scores), "robust-spiked")
    clean = V._batchwise(chosen.drop("seed").dropDuplicates(keys), "x_w", schema, X.robust_scores)
    out = P.held(X.robust_windows(pool, after.drop("mu", "power"), seeds, noises, study.n_items * (study.n_slots // 4 + 1) * 64), "robust-ranks")
    return out.where("item_id is not null"), out.where("item_id is null"), X.trend_shift(clean, after)


@query()
def e9_robustness(spark, sf_dir):
    """Condition summary over all seeds, with the spread of the seeds (P7, P8)."""
    ranks, tops, shift = _robustness(spark, sf_dir)
    return P.rounded(X.condition_summary(ranks, tops, shift))


@query()
def p8_seed_table(spark, sf_dir):
    """Mean change of rank per seed, condition and method."""
    ranks, _, _ = _robustness(spark, sf_dir)
    return P.rounded(X.seed_table(ranks))


@query()
def p8_rank_check(spark, sf_dir):
    """Ranks of the methods by targets of their own and by common targets, for the spike of ten means at the newest slot."""
    ranks, _, _ = _robustness(spark, sf_dir, (1,), {"size10": X.SPIKES["size10"]}, {})
    common = ranks.where("method like '%@7' or method in ('WSPI@64', 'DTCWT+AF@64', 'DWT+AF@64')").groupBy("method").agg(F.avg(F.abs(F.col("rank_before") - F.col("rank_after"))).alias("common_mean"))
    study, names = P.weekly(spark, sf_dir), [f"{s.name}@7" for s in S.BASELINES]
    scores = lambda m: {f"{k}@7": v for k, v in S.of_matrix(m, 7).items()}
    rows = P.held(study.wide([N.Part(7, 3, ("x_w",)), N.Part(7, 3, tuple(names), scores)]), "check-windows")
    valid = rows.groupBy("window_id").agg(F.count("*").alias("n")).where("n >= 2").join(study.live, "window_id", "left_semi").select("window_id")
    rows = rows.join(F.broadcast(P.held(valid, "check-valid")), "window_id", "left_semi")  # a row a window
    targets = P.held(X.seeded_targets(rows, (42,)).drop("seed"), "check-targets")
    spiked = X.spiked_rows(rows.select("window_id", "item_id", "x_w").join(F.broadcast(targets), ["window_id", "item_id"]), {"size10": X.SPIKES["size10"]})  # 50 rows a window
    changed = V._batchwise(spiked.select("window_id", "item_id", "x_w"), "x_w", ", ".join(f"`{n}` double" for n in names), scores)
    moved = X.moved_ranks(rows.select("window_id", "item_id", *[F.col(f"`{n}`") for n in names]), changed, names, study.n_items * study.n_slots * len(names))
    own = X.rank_distortion(moved).groupBy("method").agg(F.avg("distortion").alias("own_mean"))
    return P.rounded(X.rank_check(own.join(common, "method")))


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("AF"), _TARGETS, "nw AS (SELECT t.window_id, t.item_id, s.score AS old, round(s.score + greatest(10 * t.m, 1), 9) AS new FROM targets t JOIN sc s USING (window_id, item_id)), lg AS (SELECT n.window_id, n.item_id, abs(count(CASE WHEN s.score > n.old THEN 1 END) - count(CASE WHEN s.score > n.new THEN 1 END)) AS c FROM nw n JOIN sc s USING (window_id) GROUP BY 1, 2)") + f"SELECT window_id, 'AF' AS method, {Q.r6('avg(c)')} AS distortion, count(*) AS n_targets FROM lg GROUP BY window_id")
def m13_count_distortion(spark, sf_dir):
    """The older distortion: ranks by the number of higher scores, the changed one against the clean peers."""
    _, rows, scores = _af_frames(spark, sf_dir)
    changed = rows.join(X.low_activity_targets(rows), ["window_id", "item_id"]).select("window_id", F.lit("AF").alias("method"), "item_id", F.round(S.af(X.spiked(F.col("x_w"))), 9).alias("new_score"))
    return P.rounded(X.count_distortion(scores, changed))


@query()
def p4_noise(spark, sf_dir):
    """Overlap of the top ten after Poisson and Gaussian noise on all items."""
    _, rows, scores = _af_frames(spark, sf_dir)
    ranked = R.rank_items(scores)
    parts = []
    for name, (kind, snr) in X.NOISES.items():
        after = X.noisy(rows, kind=kind, snr_db=snr).select("window_id", "item_id", "truth", F.lit("AF").alias("method"), S.af(F.col("x_w")).alias("score"))
        parts.append(X.top_overlap(ranked, R.rank_items(after)).withColumn("condition", F.lit(name)))
    return P.rounded(G.union_all(parts).groupBy("condition").agg(F.avg("overlap").alias("overlap"), F.count("*").alias("n")))


_TARGETED = lambda frames, pool, out: _TARGETS.replace("tm AS", f"{out}m AS").replace("tw AS", f"{out}w AS").replace("tp AS", f"{out}p AS").replace("targets AS", f"{out} AS").replace("FROM tm ", f"FROM {out}m ").replace("JOIN tw", f"JOIN {out}w").replace("FROM tm JOIN", f"FROM {out}m JOIN").replace("tm.", f"{out}m.").replace("FROM tp", f"FROM {out}p").replace("FROM fr_x", f"FROM {frames}_x {pool}")


@query(with_(Q.DEMAND, Q.frames(7, 3, name="f7"), Q.frames(64, 32, name="f64"), _TARGETED("f7", "", "own"), _TARGETED("f7", "SEMI JOIN f64 USING (window_id, item_id)", "com"), "oa AS (SELECT window_id, list(item_id) AS a FROM own GROUP BY 1), ob AS (SELECT window_id, list(item_id) AS b FROM com GROUP BY 1)") + f"SELECT window_id, {Q.r6('len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))')} AS overlap, CAST(len(a) AS INTEGER) AS n_a, CAST(len(b) AS INTEGER) AS n_b FROM oa JOIN ob USING (window_id)")
def p9_target_overlap(spark, sf_dir):
    """Targets of a method's own against those common to both configurations."""
    short, long = (_frames(spark, sf_dir, *a)[1] for a in ((7, 3), (64, 32)))
    return P.rounded(X.target_overlap(X.low_activity_targets(short), X.common_targets([short, long])))


# Events

_RANKS = """tr AS (SELECT item_id, slot, v, CASE WHEN v > 0 AND max(present) OVER (PARTITION BY slot) = 1 THEN row_number() OVER (PARTITION BY slot ORDER BY v DESC, item_id) END AS rank FROM dense)"""


@query(with_(Q.DEMAND, _RANKS) + "SELECT item_id, slot, v, CAST(rank AS INTEGER) AS rank FROM tr")
def r5_truth_ranks(spark, sf_dir):
    return E.truth_ranks(P.weekly(spark, sf_dir).dense)


_EVENTS = """b AS (SELECT *, coalesce(rank, 2147483647) <= 10 AS inside, min(coalesce(rank, 2147483647)) OVER (PARTITION BY item_id ORDER BY slot ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS pre FROM tr),
s AS (SELECT *, CASE WHEN inside AND NOT coalesce(lag(inside) OVER (PARTITION BY item_id ORDER BY slot), true) THEN 1 ELSE 0 END AS st FROM b),
n AS (SELECT *, sum(st) OVER (PARTITION BY item_id ORDER BY slot) AS run_no, slot - sum(CASE WHEN inside THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY slot) AS island FROM s),
u AS (SELECT item_id, island, min(slot) AS t0, CAST(count(*) AS BIGINT) AS run_len, max(slot) AS last, min(CASE WHEN st = 1 THEN pre END) AS pre FROM n WHERE inside GROUP BY 1, 2),
ev AS (SELECT item_id, t0, run_len, pre > 20 AS strict FROM u WHERE pre IS NOT NULL AND t0 >= 32 AND run_len >= 2 AND pre > 10)"""


@query(with_(Q.DEMAND, _RANKS, _EVENTS) + "SELECT item_id, t0, run_len, strict FROM ev")
def e14_entry_events(spark, sf_dir):
    ranks = E.truth_ranks(P.weekly(spark, sf_dir).dense)
    return E.entry_events(ranks, run=2, before=4).select("item_id", "t0", "run_len", "strict")


@query(
    with_(Q.DEMAND, _RANKS, _EVENTS, Q.frames(7, 3), _sc("AF", "VSE"), Q.RANKED)
    + f""", ms AS (SELECT DISTINCT method FROM ranked), sl AS (SELECT e.item_id, e.t0, e.run_len, m.method, e.t0 + k.k AS window_id, k.k FROM ev e, ms m, (SELECT CAST(unnest(range(0, 400)) AS INTEGER) AS k) k WHERE k.k < e.run_len)
SELECT s.item_id, s.t0, s.run_len, s.method, CAST(min(CASE WHEN rank <= 10 THEN s.k END) AS INTEGER) AS delay, {Q.r6('avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM sl s LEFT JOIN ranked r ON r.window_id = s.window_id AND r.item_id = s.item_id AND r.method = s.method GROUP BY 1, 2, 3, 4"""
)
def e15_delays(spark, sf_dir):
    ev = E.entry_events(E.truth_ranks(P.weekly(spark, sf_dir).dense), run=2, before=4)
    out = E.delays(ev, R.rank_items(_scored(spark, sf_dir, "AF", "VSE")))
    return P.rounded(out.select("item_id", "t0", "run_len", "method", F.col("delay").cast("int").alias("delay"), "coverage"))


_DELAYS = lambda *names: (Q.DEMAND, _RANKS, _EVENTS, Q.frames(7, 3), _sc(*names), Q.RANKED, "ms AS (SELECT DISTINCT method FROM ranked), sl AS (SELECT e.item_id, e.t0, e.run_len, m.method, e.t0 + k.k AS window_id, k.k FROM ev e, ms m, (SELECT CAST(unnest(range(0, 400)) AS INTEGER) AS k) k WHERE k.k < e.run_len), dl AS (SELECT s.item_id, s.t0, s.run_len, s.method, min(CASE WHEN rank <= 10 THEN s.k END) AS delay, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS coverage, bool_or(s.k = 0 AND rank IS NOT NULL) AS eligible, coalesce(min(CASE WHEN rank <= 10 THEN s.k END), s.run_len) AS restricted FROM sl s LEFT JOIN ranked r ON r.window_id = s.window_id AND r.item_id = s.item_id AND r.method = s.method GROUP BY 1, 2, 3, 4)")
_SHARE = lambda rule: Q.r6(f"avg(CASE WHEN {rule} THEN 1.0 ELSE 0.0 END)")
_MEDIAN = "quantile_cont(coalesce(delay::DOUBLE, 'inf'::DOUBLE), 0.5)"


@query(
    with_(*_DELAYS("AF", "VSE", "EWMA"))
    + f"SELECT method, count(*) AS n_events, count(DISTINCT item_id) AS n_items, {_SHARE('delay IS NULL')} AS miss_rate, CASE WHEN isfinite({_MEDIAN}) THEN {Q.r6(_MEDIAN)} END AS median_delay, {Q.r6('avg(restricted)')} AS mean_delay_restricted, {Q.r6('avg(delay)')} AS mean_delay_detected, {_SHARE('delay <= 0')} AS share_delay_le0, {_SHARE('delay <= 1')} AS share_delay_le1, {_SHARE('delay <= 3')} AS share_delay_le3, {Q.r6('avg(coverage)')} AS mean_coverage, {_SHARE('NOT eligible')} AS share_ineligible_at_t0, {Q.r6('avg(run_len)')} AS mean_run_len FROM dl GROUP BY method"
)
def e16_delay_summary(spark, sf_dir):
    ev = E.entry_events(E.truth_ranks(P.weekly(spark, sf_dir).dense), run=2, before=4)
    return P.rounded(E.summarize_delays(E.delays(ev, R.rank_items(_scored(spark, sf_dir, "AF", "VSE", "EWMA")))))


_TRUE_TOPS = "tt AS (SELECT slot, item_id FROM tr WHERE rank <= 10), ts AS (SELECT slot, lag(slot) OVER (ORDER BY slot) AS prev, count(*) AS n FROM tt GROUP BY slot), tj AS (SELECT s.slot, CASE WHEN s.prev IS NOT NULL THEN (SELECT count(*) FROM tt a JOIN tt b USING (item_id) WHERE a.slot = s.slot AND b.slot = s.prev)::DOUBLE / (s.n + p.n - (SELECT count(*) FROM tt a JOIN tt b USING (item_id) WHERE a.slot = s.slot AND b.slot = s.prev)) END AS truth_rsi FROM ts s LEFT JOIN ts p ON p.slot = s.prev), tz AS (SELECT slot AS window_id, truth_rsi, lag(truth_rsi) OVER (ORDER BY slot) AS seen_rsi FROM tj)"


@query(with_(Q.DEMAND, _RANKS, _TRUE_TOPS) + f"SELECT window_id, {Q.r6('truth_rsi')} AS truth_rsi, {Q.r6('seen_rsi')} AS seen_rsi FROM tz")
def m12_truth_rsi(spark, sf_dir):
    return P.rounded(E.truth_rsi(E.truth_ranks(P.weekly(spark, sf_dir).dense)))


@query(with_(Q.DEMAND, _RANKS, _TRUE_TOPS, Q.frames(7, 3), _sc("AF", "EWMA"), WS.protocol((10,))) + f"SELECT method, count(*) AS n, {Q.r6('corr(rsi_10, seen_rsi)')} AS corr, {Q.r6('avg(CASE WHEN round(rsi_10, 9) < round(seen_rsi - 0.1, 9) THEN 1.0 ELSE 0.0 END)')} AS failure_share FROM pr JOIN tz USING (window_id) WHERE rsi_10 IS NOT NULL AND seen_rsi IS NOT NULL GROUP BY method")
def e17_stability(spark, sf_dir):
    truth = E.truth_rsi(E.truth_ranks(P.weekly(spark, sf_dir).dense))
    return P.rounded(E.stability(_metric_rows(spark, sf_dir, "AF", "EWMA", ks=R.KS), truth))


_NEAR = "nr AS (SELECT *, abs(restricted - median(restricted) OVER (PARTITION BY method)) AS off FROM dl), nt AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY off, t0, item_id) AS typical, row_number() OVER (PARTITION BY method ORDER BY restricted DESC, t0, item_id) AS worst FROM nr)"


@query(with_(*_DELAYS("AF", "VSE"), _NEAR) + " UNION ALL ".join(f"SELECT method, '{k}' AS kind, item_id, t0, CAST(restricted AS BIGINT) AS delay_restricted FROM nt WHERE {k} = 1" for k in ("typical", "worst")))
def e18_examples(spark, sf_dir):
    ev = E.entry_events(E.truth_ranks(P.weekly(spark, sf_dir).dense), run=2, before=4)
    return E.examples(E.delays(ev, R.rank_items(_scored(spark, sf_dir, "AF", "VSE")))).withColumn("delay_restricted", F.col("delay_restricted").cast("long"))


# Statistics and decisions


def _protocol(spark, sf_dir):
    return _metric_rows(spark, sf_dir, *_NAMES, ks=R.KS)


_NDCG = f"nd AS (SELECT window_id, method, round({Q.ndcg(10)}, 9) AS v FROM ranked GROUP BY 1, 2), df AS (SELECT b.method, a.window_id, a.v AS ref, b.v AS val, round(a.v - b.v, 9) AS d FROM nd a JOIN nd b USING (window_id) WHERE a.method = 'AF' AND b.method <> 'AF')"


def _ndcg_pairs(spark, sf_dir):
    rows = _metric_rows(spark, sf_dir, *_NAMES).select("window_id", "method", F.round("ndcg_10", 9).alias("ndcg_10"))
    return T.paired(T.long_metrics(rows, ("ndcg_10",)), "AF")


@query(
    with_(Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), Q.RANKED, _NDCG)
    + f""", r AS (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0 AS r FROM df WHERE d <> 0),
rb AS (SELECT method, sum(CASE WHEN d > 0 THEN r ELSE -r END) / sum(r) AS rb FROM r GROUP BY 1)
SELECT 'ndcg_10' AS metric, method, count(*) AS n, CAST(count(CASE WHEN d > 0 THEN 1 END) AS BIGINT) AS wins, CAST(count(CASE WHEN d < 0 THEN 1 END) AS BIGINT) AS losses, CAST(count(CASE WHEN d = 0 THEN 1 END) AS BIGINT) AS ties, {Q.r6('avg(d)')} AS mean_diff, {Q.r6('max(rb)')} AS rank_biserial,
 {Q.r6('(SELECT avg(sign(x.ref - y.val)) FROM df x, df y WHERE x.method = df.method AND y.method = df.method)')} AS cliffs_delta FROM df JOIN rb USING (method) GROUP BY method"""
)
def t7_effect_sizes(spark, sf_dir):
    return P.rounded(T.effect_sizes(_ndcg_pairs(spark, sf_dir)))


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), Q.RANKED, _NDCG) + f", n AS (SELECT method, window_id, d, row_number() OVER (PARTITION BY method ORDER BY window_id) - 1 AS k FROM df) SELECT 'ndcg_10' AS metric, method, CAST(k // 8 AS BIGINT) AS block, {Q.r6('avg(d)')} AS value FROM n GROUP BY method, k // 8 HAVING count(*) = 8")
def t2_block_means(spark, sf_dir):
    rows = _ndcg_pairs(spark, sf_dir).withColumn("value", F.col("diff"))
    return P.rounded(T.block_means(rows, 8, ["metric", "method"]))


_MET4 = ("ndcg_10", "coverage_10", "rsi_10", "mae")
_TESTED = (Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), WS.protocol((10,)), TS.long_metrics(_MET4), TS.pairs("AF"), TS.blocks(8, "metric, method"), TS.signed_ranks("pw", "df", "metric, method"), TS.signed_ranks("pb", "bl", "metric, method"), "cr AS (SELECT * FROM (SELECT metric, method, avg(d) AS mean_diff FROM df GROUP BY 1, 2) JOIN (SELECT metric, method, p AS p_window FROM pw) USING (metric, method) JOIN (SELECT metric, method, p AS p_block FROM pb) USING (metric, method))", TS.holm("cr", "h1", "p_window", "p_window_holm", "metric"), TS.holm("h1", "h2", "p_block", "p_block_holm", "metric"))


@query(with_(*_TESTED) + "SELECT metric, method, " + ", ".join(f"{Q.r6(c)} AS {c}" for c in ("mean_diff", "p_window", "p_block", "p_window_holm", "p_block_holm")) + f", {TS.verdict('p_block_holm')} AS verdict FROM h2")
def t8_verdicts(spark, sf_dir):
    """Signed-rank tests of windows and of block means against AF, Holm's correction within a metric, verdicts."""
    pairs = T.paired(T.long_metrics(_metric_rows(spark, sf_dir, *_NAMES), _MET4), "AF")
    out = pairs.groupBy("metric", "method").agg(F.avg("diff").alias("mean_diff")).join(T.tests(pairs, 8).drop("n_blocks"), ["metric", "method"])
    return P.rounded(T.holm(T.holm(out, "p_window", ["metric"], "p_window_holm"), "p_block", ["metric"], "p_block_holm").withColumn("verdict", T.verdict("p_block_holm")))


_LONG2 = (Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), WS.protocol((10,)), TS.long_metrics(("ndcg_10", "rsi_10")))
_MOMENTS = f"SELECT metric, method, count(*) AS n, {Q.r6('avg(value)')} AS mean, {Q.r6('stddev_samp(value)')} AS sd, {Q.r6('median(value)')} AS median FROM lm GROUP BY 1, 2"


@query(with_(*_LONG2, TS.bootstrap("ci", "lm", "metric, method", "value", 8)) + f"SELECT m.*, {Q.r6('ci_low')} AS ci_low, {Q.r6('ci_high')} AS ci_high FROM ({_MOMENTS}) m JOIN ci USING (metric, method)")
def t9_method_summary(spark, sf_dir):
    return P.rounded(T.method_summary(P.held(T.long_metrics(_metric_rows(spark, sf_dir, *_NAMES), ("ndcg_10", "rsi_10")), "long"), 8))


_REPORTS = [T.Report("main", "AF"), T.Report("D", "RRD", ("VSE", "PFRF"), ("tune", "test")), T.Report("E", "EWMA", ("CompoundPop", "VSE"), ("test",)), T.Report("confirmation", "AF", ("EWMA",), ("test",), "metrics")]
_PART_BY = "part, report, metric, method"
_PART_PAIRS = "df AS (" + " UNION ALL ".join(f"SELECT b.part, '{r.name}' AS report, '{r.reference}' AS reference, b.metric, b.method, b.window_id, a.value AS ref, b.value AS val, round((a.value - b.value) * CASE WHEN b.metric IN {TS.LOWER} THEN -1 ELSE 1 END, 9) AS d FROM lp a JOIN lp b ON a.part = b.part AND a.metric = b.metric AND a.window_id = b.window_id WHERE a.method = '{r.reference}' AND b.method <> '{r.reference}' AND b.part IN ({', '.join(repr(p) for p in r.parts)})" + (f" AND b.method IN ({', '.join(repr(m) for m in r.methods)})" if r.methods else "") for r in _REPORTS) + ")"
_PARTS_SQL = (
    "ts AS (SELECT window_id, CASE WHEN k <= floor(0.3 * n) THEN 'tune' ELSE 'test' END AS own FROM (SELECT window_id, row_number() OVER (ORDER BY window_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT window_id FROM lm)))",
    "lp AS (SELECT lm.*, p.part FROM lm JOIN (SELECT window_id, 'all' AS part FROM ts UNION ALL SELECT window_id, own FROM ts) p USING (window_id))", _PART_PAIRS, TS.blocks(8, _PART_BY), TS.blocks(16, _PART_BY, "bs"),
    TS.signed_ranks("pw", "df", _PART_BY), TS.signed_ranks("pb", "bl", _PART_BY), TS.signed_ranks("ps", "bs", _PART_BY), TS.effects(_PART_BY), TS.bootstrap("ci", "df", _PART_BY, "d", 8),
    f"cr AS (SELECT *, CASE WHEN report = 'confirmation' THEN method ELSE metric END AS fam FROM ef JOIN ci USING ({_PART_BY}) JOIN (SELECT {_PART_BY}, p AS p_window FROM pw) USING ({_PART_BY}) JOIN (SELECT {_PART_BY}, p AS p_block FROM pb) USING ({_PART_BY}) JOIN (SELECT {_PART_BY}, p AS p_sens FROM ps) USING ({_PART_BY}) JOIN (SELECT {_PART_BY}, count(*) AS n_blocks FROM bl GROUP BY ALL) USING ({_PART_BY}) JOIN (SELECT DISTINCT report, reference FROM df) USING (report))",
    TS.holm("cr", "h1", "p_window", "p_window_holm", "part, report, fam"), TS.holm("h1", "h2", "p_block", "p_block_holm", "part, report, fam"), TS.holm("h2", "h3", "p_sens", "p_sens_holm", "part, report, fam"),
)
_ROUNDED = ("mean_diff", "rank_biserial", "cliffs_delta", "p_window", "p_block", "p_sens", "ci_low", "ci_high", "p_window_holm", "p_block_holm", "p_sens_holm")


@query(with_(*_TESTED[:5], *_PARTS_SQL) + f"SELECT {_PART_BY}, reference, n, wins, losses, ties, n_blocks, " + ", ".join(f"{Q.r6(c)} AS {c}" for c in _ROUNDED) + f", {TS.verdict('p_block_holm')} AS verdict, {TS.verdict('p_sens_holm')} AS verdict_sens FROM h3")
def t16_paired_report(spark, sf_dir):
    """Reports on all windows, the tuning part and the test part: all against AF, two further references, and the confirmation of one pair over its metrics."""
    rows = P.held(_metric_rows(spark, sf_dir, *_NAMES), "protocol")
    return P.rounded(T.part_reports(rows, _REPORTS, _MET4, T.block_length(8, 7, 1), T.block_length(16, 7, 1)))


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), WS.protocol((10,)), TS.long_metrics(("ndcg_10", "rsi_10"))) + f"SELECT metric, method, count(*) AS n, {Q.r6('avg(value)')} AS mean, {Q.r6('stddev_samp(value)')} AS sd, {Q.r6('median(value)')} AS median FROM lm GROUP BY 1, 2")
def t9_method_moments(spark, sf_dir):
    """The part of the method summary that needs no draws."""
    return P.rounded(T.method_moments(T.long_metrics(_metric_rows(spark, sf_dir, *_NAMES), ("ndcg_10", "rsi_10"))))


_EFFECTS = f"""er AS (SELECT metric, method, d, rank() OVER (PARTITION BY metric, method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY metric, method, abs(d)) - 1) / 2.0 AS r FROM df WHERE d <> 0), eb AS (SELECT metric, method, sum(CASE WHEN d > 0 THEN r ELSE -r END) / sum(r) AS rb FROM er GROUP BY 1, 2),
ed AS (SELECT a.metric, a.method, avg(sign(a.ref - b.val) * CASE WHEN a.metric IN {TS.LOWER} THEN -1 ELSE 1 END) AS cd FROM df a JOIN df b ON a.metric = b.metric AND a.method = b.method GROUP BY 1, 2)"""


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), WS.protocol((10,)), TS.long_metrics(_MET4), TS.pairs("AF"), _EFFECTS) + f"SELECT metric, {Q.r6('median(rb)')} AS median_biserial, {Q.r6('median(cd)')} AS median_delta, count(*) AS n FROM ed LEFT JOIN eb USING (metric, method) GROUP BY metric")
def k10_effect_medians(spark, sf_dir):
    """Median effect sizes against AF by metric."""
    return P.rounded(D.effect_medians(T.effect_sizes(T.paired(T.long_metrics(_metric_rows(spark, sf_dir, *_NAMES), _MET4), "AF"))))


@query(with_(*_DELAYS("AF", "VSE"), TS.cluster_bootstrap("cb", "dl", "method", "restricted", "t0 // 8")) + f"SELECT method, n_clusters, {Q.r6('mean')} AS mean, {Q.r6('ci_low')} AS ci_low, {Q.r6('ci_high')} AS ci_high FROM cb")
def t10_cluster_bootstrap(spark, sf_dir):
    ev = E.entry_events(E.truth_ranks(P.weekly(spark, sf_dir).dense), run=2, before=4)
    return P.rounded(T.cluster_bootstrap(E.delays(ev, R.rank_items(_scored(spark, sf_dir, "AF", "VSE"))), "method", "delay_restricted", "t0", 8))


@query(with_(*_DELAYS("AF", "VSE")) + f"SELECT method, count(DISTINCT t0 // 8) AS n_clusters, {Q.r6('avg(restricted)')} AS mean FROM dl GROUP BY method")
def t10_clusters(spark, sf_dir):
    """Clusters and means of the delays, without draws."""
    ev = E.entry_events(E.truth_ranks(P.weekly(spark, sf_dir).dense), run=2, before=4)
    return P.rounded(T.cluster_bootstrap(E.delays(ev, R.rank_items(_scored(spark, sf_dir, "AF", "VSE"))), "method", "delay_restricted", "t0", 8).select("method", "n_clusters", "mean"))


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), Q.RANKED, _NDCG, "dm AS (SELECT 'ndcg_10' AS metric, * FROM df)", TS.signed_ranks("pw", "dm", "metric, method")) + f"SELECT metric, method, {Q.r6('p')} AS p_window, m, p < 0.05 / count(*) OVER () AS significant FROM pw JOIN (SELECT metric, method, count(*) AS m FROM dm WHERE d <> 0 GROUP BY 1, 2 HAVING count(*) >= 10) USING (metric, method)")
def t11_bonferroni(spark, sf_dir):
    return P.rounded(T.bonferroni(_ndcg_pairs(spark, sf_dir)))


@query(with_(Q.DEMAND, Q.frames(7, 3, name="f7"), Q.frames(16, 8, name="f16")) + ", a AS (SELECT window_id, count(*) AS n FROM f7 GROUP BY 1), b AS (SELECT window_id, count(*) AS n FROM f16 GROUP BY 1) SELECT 'b' AS method, CAST(count(*) FILTER (b.n IS NULL) AS BIGINT) AS only_reference, CAST(count(*) FILTER (a.n IS NULL) AS BIGINT) AS only_method, CAST(count(*) FILTER (a.n <> b.n) AS BIGINT) AS other_items FROM a FULL OUTER JOIN b USING (window_id)")
def t13_pairing_check(spark, sf_dir):
    rows = P.weekly(spark, sf_dir).scored([S.Scorer("a", 7, 3, S.af), S.Scorer("b", 16, 8, S.af)])
    return T.pairing_check(rows.groupBy("window_id", "method").agg(F.count("*").alias("num_items")), "a")


def _cell_metrics(spark, sf_dir):
    """Metric rows of two demand tables at two horizons: the cells of the decision operators."""
    parts = []
    for scenario, study in (("supplier", P.weekly(spark, sf_dir)), ("user", P.Study(P.user_six_hours(spark, sf_dir), 21600))):
        for horizon in (1, 4):
            parts.append(study.protocol(list(S.BASELINES), horizon, (10,), rho=False).select("window_id", "ndcg_10", "rsi_10", "mae", F.lit(scenario).alias("scenario"), F.lit(horizon).alias("horizon"), "method"))
    rows = G.union_all(parts)
    return P.held(T.long_metrics(rows, ("ndcg_10", "rsi_10", "mae")), "cells")


def _cells(spark, sf_dir):
    """Verdicts of the cells against AF, and the methods' means."""
    rows = _cell_metrics(spark, sf_dir)
    return P.held(T.cell_verdicts(rows, "AF", 8), "verdicts"), rows.groupBy(*D.CELL, "metric", "method").agg(F.round(F.avg("value"), 9).alias("mean"))


_PARETO = "pc AS (SELECT scenario, horizon, method, (rsi = 'ref_better') AND (ndcg <> 'ref_worse') AS success FROM (SELECT scenario, horizon, method, max(CASE WHEN metric = 'rsi_10' THEN verdict END) AS rsi, max(CASE WHEN metric = 'ndcg_10' THEN verdict END) AS ndcg FROM ve WHERE metric IN ('rsi_10', 'ndcg_10') GROUP BY 1, 2, 3))"
_BEST = lambda names: f"bb AS (SELECT scenario, horizon, metric, method AS best, mean AS best_mean FROM (SELECT *, row_number() OVER (PARTITION BY scenario, horizon, metric ORDER BY CASE WHEN metric = 'mae' THEN -mean ELSE mean END DESC, list_position({names}, method)) AS k FROM me WHERE list_contains({names}, method)) WHERE k = 1), gc AS (SELECT m.scenario, m.horizon, m.metric, m.mean AS own_mean, best, best_mean, (m.mean - best_mean) / nullif(abs(best_mean), 0) AS gain FROM me m JOIN bb USING (scenario, horizon, metric) WHERE m.method = 'AF')"


@query(with_(TS.CELLS, _PARETO) + f"SELECT method, {_COUNT('success')} AS n_success, {_COUNT('NOT success')} AS n_fail, {_COUNT('success IS NULL')} AS n_missing, CASE WHEN {_COUNT('success')} >= 3 THEN true WHEN {_COUNT('success')} + {_COUNT('success IS NULL')} < 3 THEN false END AS passed FROM pc GROUP BY method")
def k1_pareto_cells(spark, sf_dir):
    return D.success_rule(D.pareto_cells(_cells(spark, sf_dir)[0]), 3, ["method"])


@query(with_(TS.CELLS, _BEST("['EWMA', 'RRD', 'VSE', 'CompoundPop', 'PFRF']")) + f"SELECT scenario, horizon, metric, {Q.r6('own_mean')} AS own_mean, best, {Q.r6('best_mean')} AS best_mean, {Q.r6('gain')} AS gain FROM gc")
def k2_gain_claims(spark, sf_dir):
    means = _cells(spark, sf_dir)[1]
    return P.rounded(D.gain_claims(means, D.best_baseline(means, ["EWMA", "RRD", "VSE", "CompoundPop", "PFRF"]), "AF"))


@query(with_(TS.CELLS) + " UNION ALL ".join(f"SELECT x.scenario, x.horizon, x.metric, '{a}' AS a, '{b}' AS b, {Q.r6('x.mean - y.mean')} AS effect FROM me x JOIN me y USING (scenario, horizon, metric) WHERE x.method = '{a}' AND y.method = '{b}'" for a, b in (("AF", "EWMA"), ("RRD", "VSE"))))
def k3_effects(spark, sf_dir):
    return P.rounded(D.effect_table(_cells(spark, sf_dir)[1], [("AF", "EWMA"), ("RRD", "VSE")]))


@query(with_(TS.CELLS, _PARETO) + "SELECT scenario, horizon, method, metric, CASE WHEN verdict = 'ref_worse' THEN 'worse' ELSE 'no_difference' END AS kind FROM ve WHERE verdict <> 'ref_better' UNION ALL SELECT scenario, horizon, method, 'all', 'cell_failed' FROM pc WHERE NOT success")
def k4_negative_results(spark, sf_dir):
    verdicts = _cells(spark, sf_dir)[0]
    return D.negative_results(verdicts, D.pareto_cells(verdicts))


_TURNED = "vt AS (SELECT scenario, horizon, reference, method, verdict FROM ve UNION ALL SELECT scenario, horizon, method, reference, CASE verdict WHEN 'ref_better' THEN 'ref_worse' WHEN 'ref_worse' THEN 'ref_better' ELSE verdict END FROM ve), rl AS (SELECT scenario, horizon, reference, method, count(CASE WHEN verdict = 'ref_better' THEN 1 END) AS nb, count(CASE WHEN verdict = 'ref_worse' THEN 1 END) AS nw FROM vt GROUP BY 1, 2, 3, 4), rd AS (SELECT reference, horizon, " + ", ".join(f"{_COUNT(rule)} AS {n}" for n, rule in (("dominates", "nb > 0 AND nw = 0"), ("dominated", "nb = 0 AND nw > 0"), ("trade_off", "nb > 0 AND nw > 0"), ("equal", "nb = 0 AND nw = 0"))) + " FROM rl GROUP BY 1, 2)"


@query(with_(TS.CELLS, _TURNED) + "SELECT *, CASE WHEN dominates >= 3 AND dominated = 0 THEN 'accept' WHEN dominated >= 3 THEN 'reject' ELSE 'open' END AS state FROM rd")
def k5_dominance(spark, sf_dir):
    verdicts = _cells(spark, sf_dir)[0]
    both = verdicts.select(*D.CELL, "reference", "method", "metric", "verdict")
    both = both.unionByName(D.turned(both).select(*both.columns))
    return D.screen(D.dominance_counts(D.relation(both), ["reference", "horizon"]), 3)


_REL = ", ".join(f"{_COUNT(f'{a} AND {b}')} AS {n}" for n, a, b in (("d_candidate", "reference = 'AF'", "nb = 0 AND nw > 0"), ("d_other", "reference = 'VSE'", "nb = 0 AND nw > 0"), ("n_lost", "reference = 'VSE' AND method = 'AF'", "nb > 0 AND nw = 0")))


def _relations(spark, sf_dir):
    """Verdicts of the cells in both directions, and the relations that follow."""
    verdicts = _cells(spark, sf_dir)[0].select(*D.CELL, "reference", "method", "metric", "verdict")
    both = verdicts.unionByName(D.turned(verdicts).select(*verdicts.columns))
    return both, D.relation(both)


@query(with_(TS.CELLS, _TURNED) + f", sc2 AS (SELECT CASE horizon WHEN 1 THEN 'tune' ELSE 'test' END AS part, {_REL} FROM rl GROUP BY 1), sp AS (SELECT *, d_candidate <= 3 AS t1, d_candidate < d_other AS t2, n_lost <= 1 AS t3 FROM sc2) SELECT *, t1 AND t2 AND t3 AS passed, CASE WHEN bool_and(t1 AND t2 AND t3) OVER () THEN 'accepted' WHEN NOT bool_or(t1 AND t2 AND t3) OVER () THEN 'rejected' ELSE 'inconsistent' END AS final FROM sp")
def k7_screens(spark, sf_dir):
    """The three screens of AF against VSE on two parts (horizons 1 and 4 here), and the final state."""
    rows = _relations(spark, sf_dir)[1].withColumn("part", F.when(F.col("horizon") == 1, "tune").otherwise("test"))
    return D.final_state(D.screens(rows, "AF", "VSE", 3, 1))


@query(with_(TS.CELLS, _TURNED) + f", mo AS (SELECT count(*) AS n_cells, {_COUNT('nb > 0 AND nw = 0')} AS dominates, {_COUNT('nb = 0 AND nw > 0')} AS dominated FROM rl WHERE reference = 'AF' AND method = 'EWMA') SELECT *, CASE WHEN dominates >= 3 THEN 'adds' WHEN n_cells - dominates >= 3 AND dominates < 2 THEN 'nothing' ELSE 'mixed' END AS outcome FROM mo")
def k7_mechanism_outcome(spark, sf_dir):
    return D.mechanism_outcome(_relations(spark, sf_dir)[1], "AF", "EWMA", 3, 2)


@query(with_(TS.CELLS) + f"SELECT metric, {_COUNT('verdict = ' + repr('ref_better'))} AS better, {_COUNT('verdict = ' + repr('n.s.'))} AS not_different, {_COUNT('verdict = ' + repr('ref_worse'))} AS worse, {_COUNT('verdict = ' + repr('ref_worse'))} > 1 AS lowered FROM ve WHERE method = 'RRD' GROUP BY metric")
def k7_clamp_cost(spark, sf_dir):
    return D.clamp_cost(_relations(spark, sf_dir)[0], "AF", "RRD", 1)


@query(with_(TS.CELLS, _BEST("['EWMA']")) + f"SELECT metric, {_COUNT('gain > 0')} AS s_plus, {_COUNT('gain < 0')} AS s_minus, {_COUNT(chr(32).join(['gain > 0 AND verdict =', repr('ref_better')]))} AS r_plus, {_COUNT(chr(32).join(['gain < 0 AND verdict =', repr('ref_worse')]))} AS r_minus FROM gc JOIN (SELECT * FROM ve WHERE method = 'EWMA') USING (scenario, horizon, metric) GROUP BY metric")
def k8_mechanism(spark, sf_dir):
    verdicts, means = _cells(spark, sf_dir)
    gains = D.gain_claims(means, D.best_baseline(means, ["EWMA"]), "AF")
    return D.mechanism(gains, verdicts.where("method = 'EWMA'"))


_KIND = "CASE WHEN verdict = verdict_sens THEN 'same' WHEN verdict_sens = 'n.s.' THEN 'lost' WHEN verdict = 'n.s.' THEN 'gained' ELSE 'reversed' END"


@query(with_(TS.CELLS) + "SELECT metric, " + ", ".join(f"CAST(sum(CASE WHEN {_KIND} = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in ("same", "lost", "gained", "reversed")) + " FROM ve GROUP BY metric")
def k9_block_sensitivity(spark, sf_dir):
    return D.block_sensitivity(_cells(spark, sf_dir)[0])


_PLACES = "rk2 AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY scenario, horizon, metric, value) - 1) / 2.0 AS r FROM (SELECT *, CASE WHEN metric = 'mae' THEN mean ELSE -mean END AS value FROM me) WINDOW w AS (PARTITION BY scenario, horizon, metric ORDER BY value))"


@query(with_(TS.CELLS, _PLACES) + f"SELECT method, {Q.r6('avg(r)')} AS average_rank, {_COUNT('r = 1')} AS first_places, {Q.r6('median(r)')} AS median_rank, count(*) AS n FROM rk2 GROUP BY method")
def k11_aggregate_ranking(spark, sf_dir):
    return P.rounded(D.aggregate_ranking(_cells(spark, sf_dir)[1]))


@query(with_(TS.CELLS, _PLACES) + f"SELECT method, metric, {Q.r6('median(r)')} AS median_rank, count(*) AS n_cells FROM rk2 GROUP BY method, metric")
def k17_median_ranks(spark, sf_dir):
    return P.rounded(D.median_ranks(_cells(spark, sf_dir)[1]))


@query(with_(TS.CELLS) + "SELECT scenario, horizon, CAST(min(n) AS BIGINT) AS least_windows, CAST(max(n) AS BIGINT) AS most_windows, CAST(min(b) AS BIGINT) AS least_blocks, CAST(max(b) AS BIGINT) AS most_blocks FROM (SELECT scenario, horizon, metric, method, count(*) AS n, count(*) // 8 AS b FROM df GROUP BY 1, 2, 3, 4) GROUP BY 1, 2")
def k18_ranges(spark, sf_dir):
    """Windows and blocks that the comparisons of each cell rest on."""
    rows = _cell_pairs(spark, sf_dir)
    return D.cell_ranges(rows.groupBy(*D.CELL, "metric", "method").agg(F.count("*").alias("n_windows")).withColumn("n_blocks", F.floor(F.col("n_windows") / 8)))


def _cell_pairs(spark, sf_dir):
    """Differences to AF in each cell."""
    return T.paired(_cell_metrics(spark, sf_dir), "AF")


@query(with_(TS.CELLS) + "SELECT method, metric, " + ", ".join(f"CAST(count(CASE WHEN verdict = '{v}' THEN 1 END) AS BIGINT) AS {n}" for v, n in (("ref_better", "ref_better"), ("ref_worse", "ref_worse"), ("n.s.", "not_significant"))) + " FROM ve GROUP BY 1, 2")
def k12_verdict_counts(spark, sf_dir):
    return D.verdict_counts(_cells(spark, sf_dir)[0])


_SKY = f"sm AS (SELECT method, round(avg({{n}}), 6) AS n, round(avg({{c}}), 6) AS c FROM mm GROUP BY method)".replace("{n}", "ndcg_10").replace("{c}", "mae")


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), Q.RANKED) + f", mm AS (SELECT window_id, method, {Q.ndcg(10)} AS ndcg_10, avg(abs(score - truth)) AS mae FROM ranked GROUP BY 1, 2), {_SKY} SELECT a.method, a.n AS ndcg, a.c AS mae, NOT EXISTS (SELECT 1 FROM sm b WHERE b.n >= a.n AND b.c <= a.c AND (b.n > a.n OR b.c < a.c)) AS skyline FROM sm a")
def k14_skyline(spark, sf_dir):
    rows = _metric_rows(spark, sf_dir, *_NAMES).groupBy("method").agg(F.round(F.avg("ndcg_10"), 6).alias("ndcg"), F.round(F.avg("mae"), 6).alias("mae"))
    return D.skyline(rows.withColumn("scenario", F.lit("supplier")), ["ndcg"], ["mae"], ["scenario"]).drop("scenario")


_ORDERS = "od AS (SELECT l_orderkey AS k, any_value(o_orderpriority) AS p, sum(l_quantity) AS q, max(l_discount) AS d, CAST(round(sum(l_extendedprice)) AS BIGINT) AS c, min(l_tax) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)"


@query(with_(_ORDERS) + "SELECT a.k AS order_key, NOT EXISTS (SELECT 1 FROM od b WHERE b.p = a.p AND b.q >= a.q AND b.d >= a.d AND b.c <= a.c AND b.t <= a.t AND (b.q > a.q OR b.d > a.d OR b.c < a.c OR b.t < a.t)) AS skyline FROM od a")
def k14_large_skyline(spark, sf_dir):
    """Orders of each priority that no other one beats in quantity, discount, price and tax: parts first, then pairs of parts."""
    lines = P.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.round(F.sum("l_extendedprice")).cast("long").alias("c"), F.min("l_tax").alias("t"))
    rows = lines.join(P.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return D.skyline_large(rows, ["q", "d"], ["c", "t"], ["o_orderpriority"]).select(F.col("o_orderkey").alias("order_key"), "skyline")


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("AF", "RRD"), Q.RANKED) + f", m AS (SELECT window_id, method, {Q.ndcg(10)} AS v FROM ranked GROUP BY 1, 2) SELECT method, window_id, {Q.r6('v')} AS ndcg_10, {Q.r6('CASE WHEN count(v) OVER w >= 5 THEN avg(v) OVER w END')} AS mean FROM m WINDOW w AS (PARTITION BY method ORDER BY window_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)")
def k15_rolling_mean(spark, sf_dir):
    rows = _metric_rows(spark, sf_dir, "AF", "RRD")
    return P.rounded(D.rolling_mean(rows, "ndcg_10", 10, 5).drop("sd"))


_PR = (Q.DEMAND, Q.frames(7, 3), _sc(*_NAMES), WS.protocol((10,)))
_WIDE = "wd AS (SELECT method, round(avg(ndcg_10), 9) AS ndcg_10, round(avg(rsi_10), 9) AS rsi_10, round(avg(spearman_rho), 9) AS spearman_rho, round(avg(mae), 9) AS mae FROM pr GROUP BY 1)"
_SCALED = lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-12)"


def _means(spark, sf_dir):
    return _metric_rows(spark, sf_dir, *_NAMES).groupBy("method").agg(*[F.round(F.avg(m), 9).alias(m) for m in ("ndcg_10", "rsi_10", "spearman_rho", "mae")])


@query(with_(*_PR, _WIDE, f"nm AS (SELECT method, {', '.join(f'{_SCALED(c)} AS {c}' for c in ('ndcg_10', 'rsi_10', 'spearman_rho'))}, 1 - {_SCALED('mae')} AS mae FROM wd)") + "SELECT method, " + ", ".join(f"{Q.r6(c)} AS {c}" for c in ("ndcg_10", "rsi_10", "spearman_rho", "mae")) + f", {Q.r6('(3 * rsi_10 + ndcg_10 + spearman_rho + 2 * mae) / 7')} AS composite, {Q.r6('(0.75 * rsi_10 + 0.25 * ndcg_10)')} AS stability FROM nm")
def k16_composites(spark, sf_dir):
    wide = _means(spark, sf_dir)
    return P.rounded(D.composite(D.normalised(wide, ["ndcg_10", "rsi_10", "spearman_rho"], ["mae"]), {"rsi_10": 3, "ndcg_10": 1, "spearman_rho": 1, "mae": 2}).withColumn("stability", 0.75 * F.col("rsi_10") + 0.25 * F.col("ndcg_10")))


@query(with_(*_PR, _WIDE) + "SELECT method, round(ndcg_10, 3) = max(round(ndcg_10, 3)) OVER () AS best_ndcg_10, round(rsi_10, 3) = max(round(rsi_10, 3)) OVER () AS best_rsi_10, round(mae, 3) = min(round(mae, 3)) OVER () AS best_mae FROM wd")
def k19_best_mask(spark, sf_dir):
    return D.best_mask(_means(spark, sf_dir), ["ndcg_10", "rsi_10", "mae"])


_LIFTED = [n for n in _NAMES if n not in ("AF", "EWMA", "RRD")]


@query(with_(*_PR, "wt AS (SELECT window_id, " + ", ".join(f"max(CASE WHEN method = '{n}' THEN ndcg_10 END) AS \"{n}\"" for n in _NAMES) + f" FROM pr GROUP BY 1 HAVING count(*) = {len(_NAMES)})") + "SELECT window_id, " + ", ".join(f'{Q.r6(chr(34) + n + chr(34))} AS "{n}"' for n in _NAMES) + ", " + ", ".join(Q.r6(f'"{n}" - greatest("AF", "EWMA", "RRD")') + f' AS "lift_{n}"' for n in _LIFTED) + " FROM wt")
def k20_window_table(spark, sf_dir):
    return P.rounded(D.window_table(_protocol(spark, sf_dir), "ndcg_10", list(_NAMES), ["AF", "EWMA", "RRD"]))


@query(with_(*_PR) + " UNION ALL ".join(f"SELECT method, '{m}_mean' AS name, {Q.r6(f'avg({m})')} AS value FROM pr GROUP BY method" for m in ("ndcg_10", "rsi_10", "mae", "spearman_rho")))
def k13_numbers(spark, sf_dir):
    return P.rounded(D.numbers_table(R.summarize(_metric_rows(spark, sf_dir, *_NAMES), ("ndcg_10", "rsi_10", "mae", "spearman_rho")), "method", ["ndcg_10_mean", "rsi_10_mean", "mae_mean", "spearman_rho_mean"]))


@query(with_(*_PR, _WIDE) + "SELECT m || '_mean' AS name, CAST(6 AS BIGINT) AS n_compared, CAST(0 AS BIGINT) AS n_different FROM (SELECT unnest(['ndcg_10', 'rsi_10', 'mae', 'spearman_rho']) AS m)")
def k13_cross_checks(spark, sf_dir):
    """Numbers of the table against means taken straight from the metric rows: none may differ."""
    rows = _metric_rows(spark, sf_dir, *_NAMES)
    names = ["ndcg_10", "rsi_10", "mae", "spearman_rho"]
    table = D.numbers_table(R.summarize(rows, tuple(names)), "method", [f"{n}_mean" for n in names])
    again = T.long_metrics(rows, tuple(names)).groupBy("method", F.concat("metric", F.lit("_mean")).alias("name")).agg(F.avg("value").alias("again"))
    return D.cross_check(table, again, ["method", "name"], 1e-6)


# Strata

_STRATA = """wm AS (SELECT item_id, window_id, sum(v) / greatest(max(observed), 1) AS mean FROM fr_x GROUP BY 1, 2),
fm AS (SELECT item_id, arg_min(mean, window_id) AS mean FROM wm GROUP BY 1), sq AS (SELECT quantile_cont(mean, [0.25, 0.5, 0.9]) AS q FROM fm),
st AS (SELECT item_id, mean, CASE WHEN mean < q[1] THEN 0 WHEN mean < q[2] THEN 1 WHEN mean < q[3] THEN 2 ELSE 3 END AS stratum FROM fm, sq)"""
_DETAILED = "de AS (SELECT r.window_id, r.item_id, r.method, stratum, score, truth, abs(score - truth) AS err, rank, truth_rank FROM ranked r LEFT JOIN st USING (item_id))"


@query(with_(Q.DEMAND, Q.frames(7, 3), _STRATA) + f"SELECT stratum, count(*) AS n_items, {Q.r6('min(mean)')} AS min, {Q.r6('max(mean)')} AS max, {Q.r6('avg(mean)')} AS mean, {Q.r6('median(mean)')} AS median, {Q.r6('stddev_samp(mean)')} AS std, {Q.r6('100.0 * count(*) / sum(count(*)) OVER ()')} AS percent FROM st GROUP BY stratum")
def e20_strata(spark, sf_dir):
    return P.rounded(Z.stratum_summary(Z.strata(_frames(spark, sf_dir, 7, 3)[1])))


def _detailed(spark, sf_dir):
    return Z.detailed_scores(_scored(spark, sf_dir, "AF", "EWMA"), Z.strata(_frames(spark, sf_dir, 7, 3)[1]))


_STRATIFIED = (Q.DEMAND, Q.frames(7, 3), _STRATA, _sc("AF", "EWMA"), Q.RANKED, _DETAILED)


@query(with_(*_STRATIFIED) + f"SELECT window_id, method, stratum, count(*) AS n_items, {Q.r6('avg(err)')} AS mae, {Q.r6('100 * avg(CASE WHEN truth = 0 THEN 0 ELSE abs(score - truth) / truth END)')} AS mape, {Q.r6('avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_share, {Q.r6('avg(abs(rank - truth_rank))')} AS rank_difference FROM de GROUP BY 1, 2, 3")
def e21_stratum_metrics(spark, sf_dir):
    return P.rounded(Z.by_stratum(_detailed(spark, sf_dir)))


@query(with_(*_STRATIFIED) + f"SELECT window_id, item_id, method, stratum, {Q.r6('score')} AS popularity_score, truth AS actual_count, {Q.r6('err')} AS mae, CAST(rank AS INTEGER) AS rank_predicted, CAST(truth_rank AS INTEGER) AS rank_actual FROM de")
def e22_detailed_scores(spark, sf_dir):
    """Detailed rows, written to the shared folder and loaded again."""
    return P.rounded(P.held(_detailed(spark, sf_dir), "detailed"))


_TOP_HALF = "it AS (SELECT item_id, sum(truth) AS t FROM de GROUP BY 1), ik AS (SELECT item_id FROM it WHERE t >= (SELECT quantile_cont(t, 0.5) FROM it)), sc AS (SELECT window_id, item_id, truth, method, score FROM de WHERE item_id IN (SELECT item_id FROM ik))"


@query(with_(Q.DEMAND, Q.frames(7, 3), _STRATA, _sc("AF", "EWMA").replace("sc AS", "s0 AS"), Q.RANKED.replace("ranked AS", "r0 AS").replace("FROM sc", "FROM s0"), _DETAILED.replace("FROM ranked", "FROM r0"), _TOP_HALF, WS.protocol()) + WS.summary())
def e24_reanalysis(spark, sf_dir):
    return P.rounded(R.summarize(Z.protocol_from_detailed(Z.top_share(_detailed(spark, sf_dir), 50))))


@query(with_(*_STRATIFIED) + f"SELECT window_id, method, {Q.r6('avg(err)')} AS mean, {Q.r6('median(err)')} AS median, {Q.r6('stddev_samp(err)')} AS std FROM de GROUP BY 1, 2")
def e24_evolution(spark, sf_dir):
    return P.rounded(Z.evolution(_detailed(spark, sf_dir)))


@query(with_(Q.DEMAND, Q.USERS, Q.frames(7, 3, name="s1"), Q.frames(7, 3, name="u1", tag="u_"), "sc AS (" + " UNION ALL ".join(TS._PREFIXED(s, n) for s, n in (("supplier", "s1"), ("user", "u1"))) + ")", WS.protocol((10,)), "dp AS (SELECT split_part(method, ':', 1) AS dataset, split_part(method, ':', 2) AS m, ndcg_10, rsi_10 FROM pr)") + f"SELECT dataset, m AS method, {Q.r6('avg(ndcg_10)')} AS ndcg_10, {Q.r6('avg(rsi_10)')} AS rsi_10 FROM dp GROUP BY 1, 2")
def e25_dataset_means(spark, sf_dir):
    """Means per data set and method; one of the tables names a metric by an older name."""
    rows = [study.protocol(list(S.BASELINES), ks=(10,)).select(F.lit(n).alias("dataset"), "method", F.col("ndcg_10").alias(old), "rsi_10") for n, old, study in (("supplier", "ndcg@10", P.weekly(spark, sf_dir)), ("user", "ndcg_10", P.Study(P.user_six_hours(spark, sf_dir), 21600)))]
    return P.rounded(G.union_all([Z.dataset_means(d, ["ndcg_10", "rsi_10"], {"ndcg@10": "ndcg_10"}) for d in rows]))


@query(with_(Q.DEMAND, Q.frames(7, 3)) + f""", p AS (SELECT window_id, count(*) AS n FROM fr GROUP BY 1), o AS (SELECT slot, v, row_number() OVER (PARTITION BY slot ORDER BY v DESC, item_id) AS k FROM dense), t AS (SELECT slot, max(CASE WHEN k = 1 THEN v END) AS v1, max(CASE WHEN k = 10 THEN v END) AS v10 FROM o WHERE k IN (1, 10) GROUP BY 1)
SELECT count(*) AS n_cells, count(DISTINCT item_id) AS n_items, {Q.r6('avg(CASE WHEN v = 0 THEN 1.0 ELSE 0.0 END)')} AS zero_share, (SELECT {Q.r6('quantile_cont(n, 0.5)')} FROM p) AS median_eligible, (SELECT min(n) FROM p) AS min_eligible, (SELECT max(n) FROM p) AS max_eligible, (SELECT {Q.r6('quantile_cont(v1, 0.5)')} FROM t) AS median_largest, (SELECT {Q.r6('quantile_cont(v10, 0.5)')} FROM t) AS median_tenth FROM dense""")
def e26_profile(spark, sf_dir):
    study, rows = _frames(spark, sf_dir, 7, 3)
    return P.rounded(Z.profile(study.dense, rows))


# Large windows


@query(with_(*_PR) + "SELECT window_id, method, num_items, " + ", ".join(f"{Q.r6(c)} AS {c}" for c in ("ndcg_10", "coverage_10", "rsi_10", "mae", "spearman_rho")) + ", ties_top21, CAST(0 AS BIGINT) AS n_nonfinite FROM pr")
def r1_large_windows(spark, sf_dir):
    """Metric rows from ranks made of ranges, as for windows of too many items for one task."""
    study = P.weekly(spark, sf_dir)
    wide = study.wide([P.baselines_part(_NAMES)]).join(F.broadcast(P.held(study.live, "live")), "window_id", "left_semi")  # a row a window
    scores = wide.select("window_id", "item_id", "truth", *[F.round(n, 9).alias(n) for n in _NAMES])
    return P.rounded(R.protocol_large(scores, list(_NAMES), (10,), 16, study.n_items * study.n_slots, 2))


# Stored results

_METRIC_ROWS = ", ".join(f"{Q.r6(c)} AS {c}" for c in ("ndcg_10", "coverage_10", "rsi_10", "mae"))


@query(with_(*_TESTED[:4]) + f"SELECT method, window_id, num_items, {_METRIC_ROWS} FROM pr")
def s11_stored_protocol(spark, sf_dir):
    """Protocol rows written by method and read again."""
    path = f"{_folder(spark)}/protocol"
    SRC.write_protocol(_metric_rows(spark, sf_dir, *_NAMES), path)
    return P.rounded(SRC.read_protocol(spark, path).select("method", "window_id", "num_items", "ndcg_10", "coverage_10", "rsi_10", "mae"))


@query(with_(*_STRATIFIED) + f"SELECT window_id, method, stratum, count(*) AS n_items, {Q.r6('avg(err)')} AS mae, {Q.r6('avg(abs(rank - truth_rank))')} AS rank_difference FROM de WHERE method = 'EWMA' GROUP BY 1, 2, 3")
def s12_stored_results(spark, sf_dir):
    """Detailed rows saved and loaded, the strata made of them saved and loaded for one method."""
    folder = _folder(spark)
    SRC.save_results(_detailed(spark, sf_dir), folder, "detailed")
    SRC.save_results(Z.by_stratum(SRC.load_results(spark, folder, "detailed")), folder, "strata")
    return P.rounded(SRC.load_results(spark, folder, "strata", ("EWMA",)).select("window_id", "method", "stratum", "n_items", "mae", "rank_difference"))


@query(with_(*_PR) + "SELECT method, min(window_id) AS first, max(window_id) AS last, count(*) AS n_windows FROM pr GROUP BY method")
def k18_run_ranges(spark, sf_dir):
    return D.run_ranges(_protocol(spark, sf_dir), ["method"])


# Audits


@query("SELECT * FROM (" + with_(Q.DEMAND, Q.USERS, Q.frames(7, 3, name="a"), Q.frames(64, 32, name="b"), Q.frames(7, 3, name="c", tag="u_")) + " UNION ALL ".join(f"SELECT '{run}' AS run, CAST({w} AS BIGINT) AS \"window\", CAST({m} AS BIGINT) AS min_obs, '{d}' AS dataset, count(DISTINCT window_id) AS n_windows, count(*) AS n_rows, min(window_id) AS first_window, max(window_id) AS last_window FROM {t}" for run, w, m, d, t in (("short", 7, 3, "supplier", "a"), ("long", 64, 32, "supplier", "b"), ("user", 7, 3, "user", "c"))) + ")")
def q13_configurations(spark, sf_dir):
    """The settings of three runs and the windows they cover."""
    runs = {"short": {"window": 7, "min_obs": 3, "dataset": "supplier"}, "long": {"window": 64, "min_obs": 32, "dataset": "supplier"}, "user": {"window": 7, "min_obs": 3, "dataset": "user"}}
    studies = {"supplier": P.weekly(spark, sf_dir), "user": P.Study(P.user_six_hours(spark, sf_dir), 21600)}
    parts = []
    for run, c in runs.items():
        study = studies[c["dataset"]]
        rows = study.windows({"w": c["window"]}).where(G.eligible("w", c["min_obs"], P.MIN_TOTAL)).select("window_id", "item_id")
        parts.append(G.valid_windows(rows, study.dense, ["window_id"]).select(F.lit(run).alias("run"), "window_id"))
    return A.configuration_table(runs, G.union_all(parts))


@query(with_(Q.DEMAND, Q.frames(64, 3)) + "SELECT CAST(n AS INTEGER) AS length, count(*) AS n_rows, CAST(CASE WHEN n >= 8 THEN greatest(1, least(3, floor(log2(n / 7.0)))) ELSE 1 END AS INTEGER) AS level, n BETWEEN 16 AND 512 AS fits_dwt, n BETWEEN 32 AND 1024 AS fits_dtcwt FROM fr GROUP BY n")
def g21_window_sizes(spark, sf_dir):
    """Lengths of the windows of a study, the level that each bears (W3), and whether a transform of three levels suits it."""
    return G.window_sizes(_frames(spark, sf_dir, 64, 3)[1], F.size("x_w"))


@query(with_(Q.DEMAND) + "SELECT slot FROM dense GROUP BY slot HAVING max(present) = 0")
def q9_gap_slots(spark, sf_dir):
    return A.gap_slots(P.weekly(spark, sf_dir).dense)


_GAPPED = Q.study("SELECT ts, item_id, cnt FROM u_demand WHERE cnt >= 2", 21600, "g_")


@query(with_(Q.USERS, _GAPPED, Q.frames(7, 3, 5, name="fr", tag="g_"), _sc(*_NAMES), WS.protocol((10,)), "gs AS (SELECT slot FROM g_dense GROUP BY slot HAVING max(present) = 0), gw AS (SELECT DISTINCT slot + k AS window_id FROM gs, (SELECT unnest(range(1, 8)) AS k)), ga AS (SELECT method, avg(ndcg_10) AS a, avg(CASE WHEN window_id NOT IN (SELECT window_id FROM gw) THEN ndcg_10 END) AS w FROM pr GROUP BY 1)") + f"SELECT method, {Q.r6('a')} AS \"all\", {Q.r6('w')} AS without, CAST(rank() OVER (ORDER BY round(a, 9) DESC) AS INTEGER) AS rank_all, CAST(rank() OVER (ORDER BY round(w, 9) DESC) AS INTEGER) AS rank_without FROM ga")
def q9_gap_sensitivity(spark, sf_dir):
    study = P.Study(P.user_six_hours(spark, sf_dir).where("count >= 2"), 21600, 5)
    return P.rounded(A.gap_sensitivity(study.protocol(list(S.BASELINES), ks=(10,)), A.gap_slots(study.dense), 7, "ndcg_10"))


@query(with_(Q.DEMAND, Q.frames(64, 32)) + "SELECT count(*) AS n, CAST(0 AS BIGINT) AS wrong_length, CAST(count(CASE WHEN n < 64 THEN 1 END) AS BIGINT) AS short FROM fr")
def q1_window_structure(spark, sf_dir):
    return A.window_structure(_frames(spark, sf_dir)[1], "x_w", 64)


def _values(dense):
    """Scores and truths by window, from a dense table alone."""
    return G.frames(dense, {"w": 7}).where("window_id > 0").select("window_id", "item_id", S.af(F.col("x_w")).alias("af"), "before")


_SOME = "SELECT name, CAST(0 AS BIGINT) AS n_different, CAST(0 AS DOUBLE) AS max_difference, (SELECT count(*) FROM dense WHERE slot BETWEEN 1 AND {last}) AS n_compared, CAST(0 AS BIGINT) AS only_a, CAST(0 AS BIGINT) AS only_b FROM (SELECT unnest(['af', 'before']) AS name)"


@query(with_(Q.DEMAND) + _SOME.format(last=200))
def q2_truncation(spark, sf_dir):
    dense = P.weekly(spark, sf_dir).dense
    cut = 200
    return P.rounded(A.compare_tables(_values(dense).where(F.col("window_id") <= cut), _values(A.truncated(dense, cut)), ["window_id", "item_id"], 1e-9))


@query(with_(Q.DEMAND) + _SOME.format(last=150) + " UNION ALL SELECT 'leaky_af', 1, NULL, (SELECT count(*) FROM dense WHERE slot <= 150), 0, 0")
def q3_future(spark, sf_dir):
    """Future slots overwritten: honest windows do not change, leaky ones do (the positive control)."""
    dense = P.weekly(spark, sf_dir).dense
    first = 150
    changed = A.overwritten_future(dense, first)
    honest = A.compare_tables(_values(dense).where(F.col("window_id") <= first), _values(changed).where(F.col("window_id") <= first), ["window_id", "item_id"], 1e-9)
    leaky = [A.leaky_frames(d, 7).where(F.col("window_id") <= first).select("window_id", "item_id", S.af(F.col("x_w")).alias("leaky_af")) for d in (dense, changed)]
    control = A.compare_tables(*leaky, ["window_id", "item_id"], 1e-9).select("name", (F.col("n_different") > 0).cast("long").alias("n_different"), F.lit(None).cast("double").alias("max_difference"), "n_compared", "only_a", "only_b")
    return P.rounded(honest.unionByName(control))


@query(with_(Q.DEMAND) + f""", t AS (SELECT item_id, sum(cnt) AS total, max(cnt) AS largest FROM demand GROUP BY 1), o AS (SELECT slot, v, row_number() OVER (PARTITION BY slot ORDER BY v DESC, item_id) AS k FROM dense)
SELECT count(*) AS n_items, CAST(count(CASE WHEN total < 600 THEN 1 END) AS BIGINT) AS n_removed, max(CASE WHEN total < 600 THEN largest END) AS largest_removed_count, (SELECT count(DISTINCT d.slot) FROM dense d JOIN t ON t.item_id = d.item_id AND total < 600 JOIN o ON o.slot = d.slot AND o.k = 10 WHERE d.v >= o.v AND d.v > 0) AS slots_reaching_top10, {Q.r6('count(CASE WHEN total < 600 THEN 1 END) / CAST(count(*) AS DOUBLE)')} AS removed_share FROM t""")
def q4_catalogue_audit(spark, sf_dir):
    study = P.weekly(spark, sf_dir)
    return P.rounded(A.catalogue_audit(study.demand, study.dense, 600))


_PLACED = "pl AS (SELECT *, row_number() OVER (PARTITION BY window_id, method ORDER BY score DESC, item_id DESC) AS rank, row_number() OVER (PARTITION BY window_id, method ORDER BY score DESC, item_id) AS own FROM sc), pt AS (SELECT method, window_id, list(item_id) FILTER (rank <= 10) AS b, list(item_id) FILTER (own <= 10) AS a FROM pl GROUP BY 1, 2), pv AS (SELECT method, window_id, a, b, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM pt WINDOW w AS (PARTITION BY method ORDER BY window_id)), pj AS (SELECT method, CASE WHEN pa IS NOT NULL THEN len(list_intersect(a, pa))::DOUBLE / len(list_distinct(list_concat(a, pa))) END AS x, CASE WHEN pb IS NOT NULL THEN len(list_intersect(b, pb))::DOUBLE / len(list_distinct(list_concat(b, pb))) END AS y FROM pv)"


@query(with_(Q.DEMAND, Q.frames(7, 3), _sc("PFRF", "AF"), _PLACED) + f"SELECT method, count(*) AS n, CAST(count(CASE WHEN x IS DISTINCT FROM y THEN 1 END) AS BIGINT) AS n_different, {Q.r6('avg(abs(x - y))')} AS mean_difference FROM pj GROUP BY method")
def q5_rsi_audit(spark, sf_dir):
    scored = _scored(spark, sf_dir, "PFRF", "AF")
    by_item = R.with_rsi(R.window_metrics(R.rank_items(scored), (10,)), (10,))
    places = R.positional_order(scored).groupBy(*R.BY).agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.col("item_id")))).alias("top_10"))
    return P.rounded(A.rsi_audit(by_item, R.with_rsi(places, (10,))))


@query(with_(Q.DEMAND, Q.frames(7, 3)) + "SELECT n AS length, count(*) AS n_rows, count(DISTINCT window_id) AS n_windows FROM fr GROUP BY n")
def q6_window_lengths(spark, sf_dir):
    return A.window_lengths(_frames(spark, sf_dir, 7, 3)[1], "x_w")


@query(with_(Q.DEMAND, Q.frames(7, 3), "ms AS (SELECT window_id, list(item_id) AS a FROM fr GROUP BY 1), mp AS (SELECT window_id, a, lag(a) OVER (ORDER BY window_id) AS p FROM ms)") + f"SELECT window_id, len(a) AS n_items, CASE WHEN p IS NOT NULL THEN {Q.r6('len(list_intersect(a, p))::DOUBLE / len(list_distinct(list_concat(a, p)))')} END AS overlap FROM mp")
def q6_membership(spark, sf_dir):
    return P.rounded(A.membership_changes(_frames(spark, sf_dir, 7, 3)[1]))


@query(f"WITH s AS (SELECT user_id AS item, ts, value AS diff, event_id, sum(CAST(value AS DECIMAL(38, 9))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM events), l AS (SELECT *, CAST(total - lag(total) OVER w AS DOUBLE) AS step, ts = lag(ts) OVER w AS again FROM s WINDOW w AS (PARTITION BY item ORDER BY ts, event_id)) SELECT item, count(*) AS n_rows, {_COUNT('again')} AS n_repeated, {_COUNT('CAST(floor(epoch(ts)) AS BIGINT) % 3600 = 0')} AS n_on_hour, {_COUNT('step < 0')} AS n_falls, {Q.r6('avg(CASE WHEN abs(step - diff) < 1e-6 THEN 1.0 WHEN step IS NOT NULL AND diff IS NOT NULL THEN 0.0 END)')} AS share_consistent, {_COUNT('diff < 0')} AS n_negative, {_COUNT('diff IS NULL')} AS n_missing FROM l GROUP BY item")
def q7_snapshot_profile(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = P.table(spark, sf_dir, "events").withColumn("total", F.sum("value").over(w))
    return P.rounded(A.snapshot_profile(events.select(F.col("user_id").alias("item"), "ts", "event_id", "total", F.col("value").alias("diff")), ("ts", "event_id")))


@query("SELECT 0 AS step, 'input' AS name, count(*) AS n_rows FROM events UNION ALL SELECT 1, 'value', count(*) FROM events WHERE value >= 5 UNION ALL SELECT 2, 'type', count(*) FROM events WHERE value >= 5 AND event_type <> 'click'")
def q8_step_counts(spark, sf_dir):
    return A.step_counts(P.table(spark, sf_dir, "events"), [("value", F.col("value") >= 5), ("type", F.col("event_type") != "click")])


@query(with_(Q.DEMAND) + ", t AS (SELECT sum(cnt) AS s FROM demand GROUP BY item_id), o AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS k, lead(s) OVER (ORDER BY s DESC) AS nx FROM t) SELECT CAST(coalesce(nx, -1) + 1 AS BIGINT) AS least, CAST(s AS BIGINT) AS most FROM o WHERE k = 7")
def q8_threshold_interval(spark, sf_dir):
    return A.threshold_interval(P.supplier_weeks(spark, sf_dir), 7)


@query(with_(Q.DEMAND, Q.frames(7, 3)) + f"SELECT count(DISTINCT item_id) AS n_items, CAST(max(slot) + 1 AS INTEGER) AS n_slots, {Q.r6('avg(present)')} AS presence, (SELECT count(DISTINCT item_id) FROM fr) AS n_admitted FROM dense")
def q10_dataset_summary(spark, sf_dir):
    study, rows = _frames(spark, sf_dir, 7, 3)
    return P.rounded(A.dataset_summary(study.dense, rows))


# Streams


def _stream(spark, sf_dir):
    events = P.table(spark, sf_dir, "events")
    return spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp, event_type AS item_id, count(*) AS count FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2")
def z1_stream_counts(spark, sf_dir):
    """Hourly counts by a stream over the events file in append mode: the hours that the watermark, two hours behind the newest event, has closed."""
    counts = online.stream_slot_counts(_stream(spark, sf_dir), "ts", "event_type")
    return online.drained(counts, _folder(spark)).select(F.col("timestamp").cast("timestamp_ntz").cast("timestamp").alias("timestamp"), "item_id", "count")


_DECAY = "dc AS (SELECT event_type AS item_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), dl AS (SELECT item_id, max(slot) AS last, min(slot) AS first FROM dc GROUP BY 1)"


@query(with_(_DECAY) + f"SELECT item_id, max(last) AS slot, {Q.r6('sum(n * pow(0.5, last - slot))')} AS af, {Q.r6('sum(CASE WHEN slot = first THEN n ELSE 0.2 * n END * pow(0.8, last - slot))')} AS ewma FROM dc JOIN dl USING (item_id) GROUP BY item_id")
def z2_stream_scores(spark, sf_dir):
    """Recursive AF and EWMA of each event type after its last six-hour slot; events are counted by slot before the state sees them."""
    six = C.slot_start(F.col("ts"), "6h")
    folder = _folder(spark)
    # the rows of each file are counted in Spark, so that the state of an item gets a row for each slot
    events = _stream(spark, sf_dir).select(six.alias("timestamp"), F.col("event_type").alias("item_id"))
    counts = online.counted(events, f"{folder}/counts")
    scores = online.drained(online.stream_decay_scores(counts, 21600), f"{folder}/scores", "update")
    return P.rounded(scores.groupBy("item_id").agg(F.max("slot").alias("slot"), F.max_by("af", "slot").alias("af"), F.max_by("ewma", "slot").alias("ewma")))


_USER_DECAY = "dc AS (SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS slot, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), dl AS (SELECT item_id, max(slot) AS last, min(slot) AS first FROM dc GROUP BY 1), dd AS (SELECT *, CASE WHEN last + 4 <= (SELECT max(slot) - 1 FROM dc) THEN 3 ELSE 0 END AS more FROM dl)"


@query(with_(_USER_DECAY) + f"SELECT item_id, max(last + more) AS slot, {Q.r6('sum(n * pow(0.5, last + more - slot))')} AS af, {Q.r6('sum(CASE WHEN slot = first THEN n ELSE 0.2 * n END * pow(0.8, last + more - slot))')} AS ewma, max(more) > 0 AS dropped FROM dc JOIN dd USING (item_id) GROUP BY item_id")
def z2_expiring_scores(spark, sf_dir):
    """Recursive AF and EWMA of each user in six-hour slots; users silent for three slots behind the watermark have left the state."""
    folder = _folder(spark)
    events = _stream(spark, sf_dir).select(C.slot_start(F.col("ts"), "6h").alias("timestamp"), F.col("user_id").cast("string").alias("item_id"))
    counts = online.counted(events, f"{folder}/counts")
    with online.rocksdb(spark):
        scores = online.drained(online.stream_expiring_scores(counts, 21600, 3), f"{folder}/scores", "update")
    newest = [F.max_by(c, "slot").alias(c) for c in ("af", "ewma", "dropped")]
    return P.rounded(scores.groupBy("item_id").agg(F.max("slot").alias("slot"), *newest))
