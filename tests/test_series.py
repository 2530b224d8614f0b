"""Windows made of whole series inside tasks: the same as those of arrays, errors, and how partitions follow the data."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwave.functions import scorers as S
from slotwave.operators import grid as G
from slotwave.operators import ranking as R
from slotwave.operators import series as N
from slotwave.operators import wavelet as V
from slotwave.plans import popularity as P
from slotwave.plans import queries_study as Q

from .conftest import SMALL
from .test_grid import START, demand

PARTS = [N.Part(7, 3, ("w",)), N.Part(16, 5, ("dt_af", "dt_mu_l"), V.sets_of({"dt": {"last": 16}})[1])]


def rows_of(df, digits=9):
    return sorted((tuple([round(x, digits) for x in v] if isinstance(v, list) else round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("horizon", "step", "together"), [(1, 1, False), (4, 1, True), (1, 3, True)])
def test_windows_of_series(spark, horizon, step, together):
    """One matrix of an item's slots gives what a frame of collected slots gives, whatever the size of blocks; long series take the other way."""
    study, long = (P.Study(demand(spark), 3600, 10, n) for n in (65536, 20))
    parts = PARTS if together else PARTS[1:]
    want = rows_of(long.wide(parts, horizon, step, together))
    got = study.wide(parts, horizon, step, together)
    assert want and rows_of(got) == want
    arrays = study.windows({"w": 7}, horizon).where(G.eligible("w", 3, 10)).where(F.col("window_id") % step == 0)
    assert rows_of(study.wide(PARTS[:1], horizon, step)) == rows_of(arrays.select("window_id", "item_id", "truth", F.col("x_w").alias("w")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan


def test_a_range_of_windows(spark):
    """Windows from one number on and before another, and rows without columns; names may need quotes."""
    study, long = (P.Study(demand(spark), 3600, 10, n) for n in (65536, 20))
    part = [N.Part(16, 5, ("a+b",), lambda m: {"a+b": m.sum(1)})]
    whole = study.wide(part)
    some = rows_of(whole.where("window_id between 20 and 29"))
    assert some and rows_of(study.wide(part, since=20, until=30)) == some == rows_of(long.wide(part, since=20, until=30))
    keys = whole.select("window_id", "item_id", "truth")
    assert all(s.wide([N.Part(16, 5, ())]).columns == keys.columns and rows_of(s.wide([N.Part(16, 5, ())])) == rows_of(keys) for s in (study, long))
    valid = G.valid_windows(keys, study.dense, ["window_id"]).select("window_id").distinct()
    assert rows_of(study.valid(keys)) == rows_of(valid)


def test_partitions_follow_the_data(spark, monkeypatch):
    """Neither the exchange of counts nor that by window keeps to a fixed number of tasks, nor does the demand."""
    monkeypatch.setattr(N, "CELLS", 50)
    monkeypatch.setattr(R, "TASK_CELLS", 100)
    study = P.Study(demand(spark), 3600, 10)
    wide = study.wide([P.baselines_part(("AF",))])
    assert wide.rdd.getNumPartitions() == -(-study.n_items * study.n_slots // 50)
    plan = study.measured(wide, {"AF": F.col("AF")})._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression [window_id#{plan.split('RepartitionByExpression [window_id#')[1].split(']')[0]}], {-(-study.n_items * study.n_slots * 6 // 100)}" in plan
    assert N.spread(spark.range(100).withColumn("item_id", F.col("id") % 7), "item_id", 10).rdd.getNumPartitions() == 10


def test_protocol_of_series(spark):
    """Metric rows of the baselines through matrices are those of their columns."""
    study = P.Study(demand(spark), 3600, 10)
    want = R.protocol(study.scored(list(S.BASELINES)).withColumn("score", F.round("score", 9)), (3,))
    assert rows_of(study.protocol(list(S.BASELINES), 1, (3,)).select(want.columns), 7) == rows_of(want, 7)  # means are sums in any order


def test_errors_of_series(spark):
    d = demand(spark)
    for more, what in ((START + timedelta(hours=1), "several rows"), (START + timedelta(minutes=7), "off the slot grid")):
        bad = d.unionByName(spark.createDataFrame([(more, "s0", 1), (more, "s0", 1)], d.schema))
        with pytest.raises(Exception, match=what):
            P.Study(bad, 3600, 10).wide(PARTS).collect()


def test_value_forecasters_of_matrices(spark):
    """Windows of 1 to 80 slots, sparse, constant and empty: forecasts by matrix are those by columns."""
    rng, horizons = np.random.default_rng(4), (1, 8, 24)
    columns = lambda x, h: {"Persistence": S.persistence(x, h), "Holt": S.holt(x, h), "ARYW": S.ar2(x, h)} | {f"{w}{n}": f(x, n, h) for w, f in (("SMA", S.moving_average), ("EWMA", S.ewma_equivalent)) for n in S.SPANS}
    names, work = S.forecasts_of(horizons)
    for n in (1, 2, 3, 4, 9, 40, 64, 80):
        m = np.concatenate([rng.poisson(0.3, (6, n)), rng.poisson(5.0, (6, n)), np.zeros((1, n)), np.full((1, n), 3.0)]).astype(float)
        rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "i int, x array<double>")
        got = work(m)
        assert set(got) == set(names)
        for h in horizons:
            want = rows.select("i", *[c.alias(k) for k, c in columns(F.col("x"), h).items()]).orderBy("i").toPandas()
            for k in want.columns[1:]:
                assert np.allclose(got[f"{k}_{h}"] if k in ("Holt", "ARYW") else got[k] * h, want[k], rtol=1e-9, atol=1e-9), (n, h, k)


def test_scores_of_several_horizons(spark):
    """Indices of all horizons from one matrix are those of columns, horizon by horizon; truths beyond the grid are null, in long series too."""
    horizons = (1, 8, 24)
    part = N.Part(64, 5, *V.scores_at(horizons))
    study, long = (P.Study(demand(spark), 3600, 10, n) for n in (65536, 20))
    got = study.ahead(part, horizons).cache()
    assert rows_of(got, 7) == rows_of(long.ahead(part, horizons), 7)
    for h in horizons:
        fore = study.wide([N.Part(64, 5, *V.forecasts_of(h, kappas=V.KAPPAS))], h)
        want = fore.select("window_id", "item_id", "truth", *[c.alias(n) for n, c in (V.forecast_scores() | V.skilled_scores() | {"WSPI": V.index()}).items()])
        own = got.where(f"truth_{h} is not null").select("window_id", "item_id", f"truth_{h}", *[F.col(f"`{n}_{h}`") for n in (*V.forecast_scores(), *V.skilled_scores())], "WSPI")
        assert want.count() and rows_of(own, 7) == rows_of(want, 7)


@pytest.mark.parametrize("cells", [R.CELLS, 1])
def test_a_truth_for_each_method(spark, cells):
    """Methods with truths of their own get the metric rows that each gets alone, by window and by ranges."""
    study = P.Study(demand(spark), 3600, 10)
    wide = study.ahead(N.Part(7, 3, *V.sets_of({"dt": {"last": 16}})), (1, 8))
    methods = {"near": F.col("dt_mu_l"), "far": F.col("dt_af"), "far+": F.col("dt_r")}
    got = study.measured(wide, methods, (3,), cells=cells, truths={"near": "truth_1", "far": "truth_8", "far+": "truth_8"})
    alone = [study.measured(study.wide([N.Part(7, 3, *V.sets_of({"dt": {"last": 16}}))], h), {n: methods[n] for n in names}, (3,)) for h, names in ((1, ["near"]), (8, ["far", "far+"]))]
    want = G.union_all(alone)
    assert want.count() and rows_of(got.select(want.columns), 7) == rows_of(want, 7)


def test_prediction_runs_without_arrays(spark, monkeypatch):
    """e19: no window is collected, and rows are exchanged by window once for all horizons."""
    for name in ("windows", "spans", "dense"):
        monkeypatch.setattr(P.Study, name, None)
    got = Q.e19_prediction_runs(spark, SMALL)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [window_id") == 1 and got.count()
