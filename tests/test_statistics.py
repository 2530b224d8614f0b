"""Statistics and decisions: hand examples and brute force."""

import hashlib
import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from slotwave.operators import decisions as D
from slotwave.operators import events as E
from slotwave.operators import ranking as R
from slotwave.operators import relation as L
from slotwave.operators import resampling as S
from slotwave.operators import statistics as T


def test_holm(spark):
    rows = [("m", i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.005, None))]
    got = {r.i: r.h for r in T.holm(spark.createDataFrame(rows, "f string, i int, p double"), "p", ["f"], "h").collect()}
    assert got[4] is None and [round(got[i], 10) for i in range(4)] == [0.03, 0.06, 0.06, 0.02]


def test_block_means(spark):
    rows = [("m", k, float(k)) for k in range(10)]
    got = sorted(r.value for r in T.block_means(spark.createDataFrame(rows, "method string, window_id int, value double"), 4, ["method"]).collect())
    assert got == [1.5, 5.5]


def test_wilcoxon_is_exact_for_small_samples():
    rng = np.random.default_rng(0)
    for n in (1, 3, 6, 9):
        d = rng.standard_normal(n)
        r = T._ranks(np.abs(d))
        low = min(r[d > 0].sum(), r[d < 0].sum())
        want = min(1.0, 2 * sum(sum(x for x, s in zip(r, signs, strict=True) if s) <= low for signs in itertools.product((0, 1), repeat=n)) / 2**n)
        assert math.isclose(T.wilcoxon(d), want)
    assert T.wilcoxon(np.zeros(5)) == 1.0


def drawn(n, *key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:12], 16) % n


def test_bootstrap_against_resampling(spark):
    """Block and cluster draws, in ranges of draws, against resampling one value after the other."""
    x = {"a": np.random.default_rng(1).standard_normal(23), "b": np.arange(4.0), "c": np.ones(1)}
    rows = spark.createDataFrame([(g, i, float(v)) for g, xs in x.items() for i, v in enumerate(xs)], "g string, window_id int, value double")
    draws, block = 1203, 5
    got = {r.g: (r.ci_low, r.ci_high) for r in S.block_intervals(rows, ["g"], "value", "window_id", block, draws, 7).collect()}
    for g, xs in x.items():
        n, b = len(xs), min(block, len(xs))
        means = [np.concatenate([xs[(drawn(n, 7, n, block, d, j) + np.arange(b)) % n] for j in range(-(-n // b))])[:n].mean() for d in range(draws)]
        assert np.allclose(got[g], np.percentile(means, [2.5, 97.5]))
    clusters = rows.withColumn("c", F.floor(F.col("window_id") / 3))
    got = {r.g: (r.n_clusters, r.ci_low, r.ci_high) for r in T.cluster_bootstrap(clusters, "g", "value", "window_id", 3, draws, 7).collect()}
    for g, xs in x.items():
        parts = [xs[i : i + 3] for i in range(0, len(xs), 3)]
        m = len(parts)
        means = [np.concatenate([parts[drawn(m, 7, m, d, j)] for j in range(m)]).mean() for d in range(draws)]
        assert got[g][0] == m and np.allclose(got[g][1:], np.percentile(means, [2.5, 97.5]))


def test_kendall():
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y = rng.integers(0, 5, 30).astype(float), rng.integers(0, 6, 30).astype(float)
        s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(30) for j in range(i))
        tied = lambda v: sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1])
        assert math.isclose(R.kendall_tau_b(x, y), s / math.sqrt((435 - tied(x)) * (435 - tied(y))))
    assert R.kendall_tau_b(np.ones(5), np.arange(5.0)) is None


def test_stable_rank_with_ties_and_nan(spark):
    rows = [(1, "m", str(i), s, 1.0) for i, s in enumerate((3.0, 5.0, 5.0, 1.0, 5.0, float("nan")))]
    got = R.rank_items(spark.createDataFrame(rows, "window_id int, method string, item_id string, score double, truth double")).orderBy("rank").collect()
    assert [int(r.item_id) for r in got] == [1, 2, 4, 0, 3, 5]


def test_correlation_of_what_does_not_vary(spark):
    """All scores tied, all scores non-finite, all truths tied: no correlation, and no error."""
    rows = [(w, "m", str(i), s(i), t(i)) for w, s, t in ((1, lambda i: 2.0, float), (2, lambda i: float("nan"), float), (3, float, lambda i: 1.0), (4, float, float), (5, lambda i: -float(i), float)) for i in range(12)]
    scores = spark.createDataFrame(rows, "window_id int, method string, item_id string, score double, truth double")
    got = {r.window_id: r.spearman_rho for r in R.protocol(scores).collect()}
    assert got[1] is None and got[2] is None and got[3] is None and math.isclose(got[4], 1.0) and math.isclose(got[5], -1.0)
    feats = L.within_window(scores.withColumn("z", F.lit(0.5)), ["score", "z"], "truth", "z").orderBy("window_id").collect()
    assert [r.spearman_z for r in feats] == [None] * 5 and feats[0].spearman_score is None and math.isclose(feats[3].pearson_score, 1.0)
    flat = spark.createDataFrame([(k, "m", 0.5) for k in range(5)], "window_id int, method string, rsi_10 double")
    seen = spark.createDataFrame([(k, 0.5, k / 10) for k in range(5)], "window_id int, truth_rsi double, seen_rsi double")
    assert E.stability(flat, seen).first()["corr"] is None


def test_planted_difference(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(96):
        noise = rng.standard_normal(3) * 0.01
        rows += [(k, m, float(base + e), 1.0) for m, base, e in zip("ABC", (0.6, 0.5, 0.6), noise, strict=True)]
    report = T.paired_report(spark.createDataFrame(rows, "window_id int, method string, ndcg_10 double, mae double"), "A", ("ndcg_10", "mae"), 8, 16, 500)
    got = {(r.metric, r.method): r.verdict for r in report.collect()}
    assert got == {("ndcg_10", "B"): "ref_better", ("ndcg_10", "C"): "n.s.", ("mae", "B"): "n.s.", ("mae", "C"): "n.s."}


def test_decisions(spark):
    rows = [("s", h, "A", m, k, v) for h, m, k, v in [(1, "B", "ndcg_10", "n.s."), (1, "B", "rsi_10", "ref_better"), (8, "B", "ndcg_10", "ref_worse"), (8, "B", "rsi_10", "ref_better"), (1, "C", "rsi_10", "ref_better")]]
    v = spark.createDataFrame(rows, "scenario string, horizon int, reference string, method string, metric string, verdict string")
    cells = {(r.horizon, r.method): r.success for r in D.pareto_cells(v).collect()}
    assert cells == {(1, "B"): True, (8, "B"): False, (1, "C"): None}
    rel = {(r.horizon, r.method): r.relation for r in D.relation(v).collect()}
    assert rel == {(1, "B"): "dominates", (8, "B"): "trade-off", (1, "C"): "dominates"}
    points = spark.createDataFrame([("s", "a", 1.0, 1.0), ("s", "b", 2.0, 2.0), ("s", "c", 1.0, 2.0), ("s", "d", 2.0, 2.0)], "scenario string, method string, up double, down double")
    assert {r.method: r.skyline for r in D.skyline(points, ["up"], ["down"], ["scenario"]).collect()} == {"a": True, "b": True, "c": False, "d": True}


def test_skyline_of_many_rows(spark):
    """Parts and pairs of parts against all pairs; ties, repeated rows, nulls, a group of one."""
    rng = np.random.default_rng(4)
    x = np.round(rng.random((3000, 4)), 2)
    rows = [(i, "a" if i % 3 else "b", *map(float, v)) for i, v in enumerate(x)] + [(5000 + i, "a", *map(float, x[1])) for i in range(3)] + [(6000, "c", 0.1, 0.1, 0.1, 0.1), (6001, "a", None, 2.0, 0.0, 0.0), (6002, "a", float("nan"), 2.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, g string, p double, q double, r double, s double")
    got = {r.id: r.skyline for parts in (1, 5) for r in D.skyline_large(df, ["p", "q"], ["r", "s"], ["g"], parts).collect()}
    for i, g, *v in rows:
        if i >= 6001:
            assert got[i]
            continue
        other = np.array([w for j, h, *w in rows if h == g and j < 6001]) * [1, 1, -1, -1]
        own = np.array(v) * [1, 1, -1, -1]
        assert got[i] == (not ((other >= own).all(1) & (other > own).any(1)).any())
