"""Grid, causal windows, padding, and the leakage checks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwave.functions import scorers as S
from slotwave.functions import wavelets as W
from slotwave.operators import audit as A
from slotwave.operators import grid as G
from slotwave.plans.popularity import Study

START = datetime(2024, 1, 1)


def demand(spark):
    """Steady items, one that starts late, one with three rows in all; zero counts have no row."""
    rng = random.Random(3)
    rows = [(START + timedelta(hours=h), f"s{i}", rng.randint(1, 9)) for h in range(60) for i in range(4) if rng.random() < 0.8 or h in (0, 59)]
    rows += [(START + timedelta(hours=h), "late", 1) for h in range(30, 60)] + [(START + timedelta(hours=h), "tiny", 1) for h in (5, 6, 7)]
    return spark.createDataFrame(rows, "timestamp timestamp, item_id string, count long")


def brute(rows, window, min_obs, min_total, horizon):
    v, seen = {}, set()
    for r in rows:
        k = int((r.timestamp - START).total_seconds() // 3600)
        v[r.item_id, k] = r["count"]
        seen.add(k)
    items, last, out = sorted({i for i, _ in v}), max(seen), {}
    for k in range(1, last + 1):
        if k + horizon - 1 > last or k not in seen:
            continue
        ok = [i for i in items if sum((i, s) in v for s in range(max(0, k - window), k)) >= min_obs and sum(v.get((i, s), 0) for s in range(k)) >= min_total]
        if len(ok) >= 2:
            for i in ok:
                out[k, i] = ([float(v.get((i, s), 0)) for s in range(max(0, k - window), k)], float(sum(v.get((i, s), 0) for s in range(k, k + horizon))))
    return out


@pytest.mark.parametrize(("horizon", "chunk"), [(1, None), (4, None), (4, 16), (1, 5)])
def test_frames(spark, horizon, chunk):
    d = demand(spark)
    study = Study(d, None, 10)
    rows = study.windows({"w": 7}, horizon, chunk).where(G.eligible("w", 3, 10))
    got = {(r.window_id, r.item_id): (list(r.x_w), r.truth) for r in G.valid_windows(rows, study.dense, ["window_id"]).collect()}
    assert got == brute(d.collect(), 7, 3, 10, horizon)


def test_long_series(spark):
    """Series past the limit are cut without being asked; windows, totals and truths of all lengths stay the same."""
    whole, cut = (Study(demand(spark), None, 10, long_series=n) for n in (1000, 20))
    assert whole.chunk(7) is None and cut.chunk(3) == 20 and cut.chunk(7) == 28 and cut.chunk(7, 5) == 5
    for get in (lambda s: s.windows({"w": 7, "z": 3}, 4), lambda s: s.spans((3, 7), (1, 4)), lambda s: s.scored(S.BASELINES[:2])):
        a, b = (get(s) for s in (whole, cut))
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    plan = cut.spans((3, 7), (1, 4))._jdf.queryExecution().optimizedPlan().toString()
    assert all("chunk#" in x for x in plan.splitlines() if "collect_list" in x and "Window [" in x)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 9, 48, 64, 65])
def test_power_of_two(spark, n):
    target = spark.range(1).select(G.power_of_two(F.lit(n), 2)).first()[0]
    assert target == max(8, 2 ** int(np.ceil(np.log2(max(n, 2)))))


def test_late_and_tiny_items(spark):
    scored = Study(demand(spark), None, 10).scored([S.BASELINES[0]])
    by = {r.item_id: r.k for r in scored.groupBy("item_id").agg(F.min("window_id").alias("k")).collect()}
    assert by["late"] == 40 and "tiny" not in by


def test_off_grid_raises(spark):
    d = demand(spark).unionByName(spark.createDataFrame([(START + timedelta(minutes=7), "s0", 1)], "timestamp timestamp, item_id string, count long"))
    with pytest.raises(Exception, match="off the slot grid"):
        G.densify(d, G.infer_grid(d, 3600)).collect()


def test_leakage(spark):
    dense = Study(demand(spark), None, 10).dense
    changed = A.overwritten_future(dense, 30)
    value = lambda d: G.frames(d, {"w": 7}).where("window_id between 1 and 30").select("window_id", "item_id", S.af(F.col("x_w")).alias("af"), "before")
    assert {r.n_different for r in A.compare_tables(value(dense), value(changed), ["window_id", "item_id"]).collect()} == {0}
    leaky = [A.leaky_frames(d, 7).where("window_id <= 30").select("window_id", "item_id", S.af(F.col("x_w")).alias("af")) for d in (dense, changed)]
    assert A.compare_tables(*leaky, ["window_id", "item_id"]).first().n_different > 0


def test_padding(spark):
    x = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(x,)], "x array<double>")
    for how in G.PADS:
        got = df.select(G.pad_left(F.col("x"), 8, how).alias("p")).first().p
        assert got == W.pad_left(np.array([x]), 8, how)[0].tolist(), how
        mode = {"edge": "edge", "zero": "constant", "periodic": "wrap"}.get(how, how)
        assert got == np.pad(x, (5, 0), mode=mode).tolist(), how
