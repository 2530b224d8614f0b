"""Leaf-wise boosting: against plain best-first growth, on Spark, without leaks."""

import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwave.operators import boosting as B
from slotwave.operators import learned as L
from slotwave.operators import ranking as R
from slotwave.operators import wavelet as V
from slotwave.plans import popularity as P
from slotwave.plans import queries_study as Q

from .conftest import SMALL


def plain_tree(bins, g, s):
    """Best-first growth one leaf after the other, sums made anew for each leaf: the value of each row."""

    def best(rows):
        found = (0.0, 0, 0)
        for f in range(bins.shape[1]):
            for b in range(s.bins):
                left = rows[bins[rows, f] <= b]
                n, m = len(left), len(rows)
                if s.least_rows <= n <= m - s.least_rows:
                    a, t = g[left].sum(), g[rows].sum()
                    gain = a**2 / n + (t - a) ** 2 / (m - n) - t**2 / m
                    if gain > found[0] + 1e-9:
                        found = (gain, f, b)
        return found

    leaves = [(best(r), r) for r in [np.arange(len(g))]]
    while len(leaves) < s.leaves:
        k = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
        (gain, f, b), rows = leaves[k]
        if gain <= 1e-9:
            break
        below = bins[rows, f] <= b
        leaves[k : k + 1] = [(best(r), r) for r in (rows[below], rows[~below])]
    out = np.zeros(len(g))
    for _, rows in leaves:
        out[rows] = -s.rate * g[rows].mean()
    return out


def test_against_plain_growth():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = np.sin(3 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + rng.normal(size=400) / 10
    s = B.Settings(rounds=4, rate=0.3, leaves=9, bins=16, least_rows=10)
    edges = [np.unique(np.percentile(x[:, f], np.linspace(0, 100, 17)[1:-1])) for f in range(3)]
    bins, want = B.binned(x, edges), np.full(400, y.mean())
    for _ in range(s.rounds):
        want += plain_tree(bins, want - y, s)
    grower = B._Grower(bins, y, s)
    model = B.Model(["a", "b", "c"], edges, grower.base, [grower.tree() for _ in range(s.rounds)])
    assert np.allclose(model.predict(x), want) and max(sum(f < 0 for f in t.feature) for t in model.trees) <= s.leaves


def test_on_spark(spark):
    """Fits a function better than its mean, the same twice; nulls, an empty sample, odd names."""
    rows = spark.range(2000).select(F.col("id").alias("window_id"), F.lit("i").alias("item_id"), (F.rand(3) * 4).alias("a"), F.rand(4).alias("c")).withColumn("label", F.sin("a") + F.col("c"))
    rows = rows.withColumn("c", F.when(F.col("window_id") % 50 == 0, None).otherwise(F.col("c"))).withColumn("label", F.when(F.col("window_id") % 99 == 0, None).otherwise(F.col("label"))).cache()
    s = B.Settings(rounds=40, rate=0.2, leaves=8, bins=32)
    one, two = (B.fit(rows, {"one": ["a"], "two.": ["a", "c"]}, "label", ["window_id"], s) for _ in range(2))
    assert one["two."].trees == two["two."].trees and len(one["one"].trees) == 40
    out = B.predicted(rows, one).where("label is not null").toPandas()
    error = {m: ((out[m] - out.label) ** 2).mean() for m in ("one", "two.")}
    assert error["two."] < 0.02 < error["one"] < 0.12 < out.label.var()
    empty = B.fit(rows.limit(0), {"one": ["a"]}, "label", ["window_id"], B.Settings(rounds=2))
    assert B.predicted(rows, empty).where("one <> 0").isEmpty()
    with pytest.raises(ValueError, match="sample"):
        B.fit(rows, {"one": ["a"]}, "label", ["window_id"], s, most_rows=10)


def test_sample_and_split(spark):
    rows = spark.range(40000).select((F.col("id") % 100).alias("window_id"), F.col("id").cast("string").alias("item_id"), F.lit(1.0).alias("truth")).cache()
    assert L.first_test_window(rows) == 30
    got = L.training_rows(rows, 30, horizon=8, sample=1000)
    assert got.count() == 1000 and got.agg(F.max("window_id")).first()[0] <= 22
    all_ = rows.where("window_id + 7 < 30").withColumn("draw", L.sample_order()).orderBy("draw", "window_id", "item_id").limit(1000)
    assert {r.item_id for r in got.collect()} == {r.item_id for r in all_.collect()}
    assert L.training_rows(rows, 30, sample=10**6).count() == 12000


def test_no_leak(spark):
    """Truths from the first test window on do not change the model."""
    rows = spark.range(3000).select((F.col("id") % 100).alias("window_id"), F.col("id").cast("string").alias("item_id"), F.rand(1).alias("a"), F.col("id").cast("double").alias("truth")).cache()
    other = rows.withColumn("truth", F.when(F.col("window_id") >= 30, 1e6).otherwise(F.col("truth")))
    s = B.Settings(rounds=3)
    one, two = (L.fit_rankers(L.training_rows(r, L.first_test_window(r)), {"GBM": ["a"]}, s) for r in (rows, other))
    assert one["GBM"].trees == two["GBM"].trees and one["GBM"].base == two["GBM"].base


@pytest.mark.parametrize(("leaves", "walks"), [(1, False), (7, False), (31, False), (60, False), (90, True)])
def test_leaves_without_walking(monkeypatch, leaves, walks):
    """Leaves by masks are those of walking the trees, and sums are the same to the last digit; only trees of too many leaves are walked."""
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(3000, 4)), 1)
    x[rng.random(x.shape) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0] * x[:, 1]) + np.isnan(x[:, 2]) + rng.normal(size=3000) / 10
    edges = [B.percentiles(x[~np.isnan(x[:, f]), f], 40) for f in range(3)] + [np.array([])]
    grower = B._Grower(B.binned(x, edges), y, B.Settings(rounds=12, rate=0.3, leaves=leaves, bins=40, least_rows=3))
    model = B.Model(list("abcd"), edges, grower.base, [grower.tree() for _ in range(12)])
    assert max(t.feature.count(-1) for t in model.trees) == leaves
    want = np.full(3000, model.base)
    for tree in model.trees:
        want += tree.predict(B.binned(x, edges))
    monkeypatch.setattr(B, "ROWS", 700)
    if not walks:
        monkeypatch.setattr(B.Tree, "predict", None)
    assert (model.predict(x) == want).all() and model.predict(x[:0]).shape == (0,)


def test_edges_are_exact_percentiles(spark):
    values = [float(v) for v in np.round(np.random.default_rng(2).gamma(1.0, 3.0, 777), 1)]
    want = spark.createDataFrame([(v,) for v in values], "v double").agg(F.percentile("v", F.array(*[F.lit(i / 16) for i in range(1, 16)]))).first()[0]
    assert B.percentiles(np.array(values), 16).tolist() == sorted(set(want)) and B.percentiles(np.array([]), 16).tolist() == []


def test_features_of_matrix(spark):
    """Windows of 1 to 80 slots: features by matrix are those by columns."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 15, 16, 17, 64, 80):
        m = rng.poisson(0.7, (5, n)).astype(float)
        rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "i int, x array<double>")
        want = rows.select("i", *[c.alias(k) for k, c in L.window_features(F.col("x")).items()]).orderBy("i").toPandas()
        got = L.of_matrix(m)
        assert tuple(got) == L.FEATURES == tuple(want.columns[1:]) and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in got)


def test_ranker_without_arrays(spark, monkeypatch):
    """f19: the same as features of collected windows, one table of all features, and predictions over it; no window is collected, and no feature leaves its task."""
    study, rows = Q._frames(spark, SMALL)
    plain = rows.select("window_id", "item_id", "truth", *[c.alias(k) for k, c in L.window_features(F.col("x_w")).items()], "x_w")
    feats = V.wavelet_features(plain).drop("low", "energies", "x_w").cache()
    first = L.first_test_window(feats)
    models = L.fit_rankers(L.training_rows(feats, first), {"GBM": list(L.FEATURES), "GBM+W": [*L.FEATURES, "mu_l", "r", "w_e"]})
    wide = B.predicted(feats.where(F.col("window_id") >= first), models)
    want = P.rounded(R.summarize(R.protocol_wide(wide, L.scores(models), items=study.n_items))).orderBy("method").collect()
    for place, name in ((P.Study, "windows"), (P.Study, "dense"), (V, "wavelet_features"), (B, "predicted"), (B.Tree, "predict")):
        monkeypatch.setattr(place, name, None)
    assert len(want) == 2 and Q.f19_learned_ranker(spark, SMALL).orderBy("method").collect() == want


def test_feature_rows_without_arrays(spark, monkeypatch):
    """f17: features by matrix, no window collected."""
    rows = Q._bare(spark, SMALL)
    want = P.rounded(rows.select("window_id", "item_id", *[c.alias(k) for k, c in L.window_features(F.col("x_w")).items()])).cache()
    n = want.count()
    for name in ("windows", "dense"):
        monkeypatch.setattr(P.Study, name, None)
    got = Q.f17_ranker_features(spark, SMALL)
    assert n and got.columns == want.columns and got.count() == n and got.exceptAll(want).isEmpty()


def test_all_rows_are_trained_on(spark):
    """No row before the first test window is left out, however many there are."""
    rows = spark.range(300_000).select((F.col("id") % 100).cast("int").alias("window_id"), F.col("id").cast("string").alias("item_id"), (F.col("id") % 7).cast("double").alias("truth"), F.lit(0.5).alias("a"))
    train = L.training_rows(rows, 90)
    assert train.count() == 270_000
    model = L.fit_rankers(train, {"GBM": ["a"]}, B.Settings(rounds=1))["GBM"]
    assert abs(model.base - train.agg(F.avg("label")).first()[0]) < 1e-9


def test_tasks_together_grow_the_same_trees(spark):
    """Rows dealt over tasks, some with none: edges, trees and values are to the last digit those of one task that has all rows, where two features split alike too."""
    rows = spark.range(3000).select(F.col("id").alias("window_id"), F.lit("i").alias("item_id"), F.round(F.rand(3) * 4, 1).alias("a"), (F.rand(4) - 0.5).alias("c"), F.lit(1.0).alias("flat")).withColumn("label", F.sin("a") + F.col("c") + F.rand(5) / 10)
    rows = rows.withColumn("c", F.when(F.col("window_id") % 50 == 0, None).otherwise(F.col("c"))).withColumn("none", F.lit(None).cast("double")).withColumn("twin", -F.col("a")).cache()
    sets, s = {"one": ["a", "none"], "two.": ["twin", "a", "c", "flat"]}, B.Settings(rounds=12, rate=0.2, leaves=20, bins=40, least_rows=5)
    for part in (rows, rows.where("window_id < 2")):
        want, got = (B.fit(part, sets, "label", ["window_id"], s, alone=n) for n in (10**6, 1))
        for m in sets:
            assert [e.tolist() for e in want[m].edges] == [e.tolist() for e in got[m].edges] and len(got[m].trees) == 12
            assert want[m].base == got[m].base and want[m].trees == got[m].trees


def test_shared_percentiles():
    """Percentiles over the rows of several tasks are those of all rows."""
    rng = np.random.default_rng(8)
    parts = [[np.round(rng.normal(size=n), 2), rng.gamma(1.0, 3.0, n) * 1e5, np.zeros(0), np.full(n, -0.0)] for n in (0, 1, 50, 333)]
    todo = [B._ordered(np.concatenate([p[f] for p in parts])) for f in range(4)]
    assert all((np.diff(np.sort(np.concatenate([p[f] for p in parts]))) >= 0).all() and (np.sort(o) == o[np.argsort(np.concatenate([p[f] for p in parts]))]).all() for f, o in enumerate(todo))
    gate, sums = threading.Barrier(len(parts)), [None] * len(parts)

    def total(i):
        def run(x):
            sums[i] = x
            gate.wait()
            out = sum(sums)
            gate.wait()
            return out

        return run

    with ThreadPoolExecutor(len(parts)) as pool:
        found = list(pool.map(lambda i: B.shared_percentiles(parts[i], 40, total(i)), range(len(parts))))
    want = [B.percentiles(np.concatenate([p[f] for p in parts]), 40).tolist() for f in range(4)]
    assert all([e.tolist() for e in f] == want for f in found)
