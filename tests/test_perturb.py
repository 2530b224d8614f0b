"""Ranks of perturbed windows by counting, a window a task, against sorts of all rows."""

from pyspark.sql import functions as F

from slotwave.operators import perturb as X
from slotwave.operators import ranking as R
from slotwave.operators import wavelet as V

KEYS = ["window_id", "item_id"]


def listed(df, *columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


def pool(spark):
    """Three windows, one of few items, with many equal series."""
    x = F.transform(F.sequence(F.lit(1), F.when(F.col("window_id") == 8, 12).otherwise(64)), lambda i: ((F.col("id") % 40 * i * 7) % 5 * ((F.col("id") + i) % 3 == 0).cast("int")).cast("double"))
    return spark.range(200).selectExpr("id", "int(case when id < 5 then 4 when id % 2 = 0 then 8 else 12 end) as window_id", "cast(id * 7919 % 1009 as string) as item_id").select(*KEYS, x.alias("x_w")).cache()


def test_moved_ranks(spark):
    """Ties, infinite scores and several changes of one item."""
    rows = spark.range(300).selectExpr("int(id % 3) as window_id", "cast(id * 7919 % 1009 as string) as item_id", "double(id * 31 % 23) as a", "case when id % 40 = 7 then double('inf') else 1.0D end as b").cache()
    changed = rows.where("conv(item_id, 10, 10) % 7 = 0").select(*KEYS, (F.col("a") + 3).alias("a"), F.lit(1.0).alias("b"))
    changed = changed.unionByName(changed.withColumn("a", F.lit(float("nan")))).cache()
    got = X.moved_ranks(rows, changed, ["a", "b"], 10**9)
    want = X.replaced_ranks(R.to_long(rows, ["a", "b"], KEYS), R.to_long(changed, ["a", "b"], KEYS).withColumnRenamed("score", "new_score"))
    columns = ("window_id", "method", "item_id", "rank_before", "rank_after")
    assert listed(got, *columns) == listed(want, *columns)
    assert "Window [" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_robust_windows(spark):
    """Spikes and noise as replaced_ranks, noisy and rank_items have them; no exchange or sort of the noised windows' scores."""
    rows, seeds, names = pool(spark), (1, 2), list(X.ROBUST)
    targets = X.seeded_targets(rows, seeds, n=6).cache()
    for s in seeds:
        assert listed(targets.where(F.col("seed") == s), *KEYS) == listed(X.low_activity_targets(rows, n=6, seed=s), *KEYS)
    schema = ", ".join(f"`{n}` double" for n in (*names, "mu", "power"))
    scored = lambda d: V._batchwise(d, "x_w", schema, X.robust_scores)
    long = lambda d, keep: R.to_long(d, names, keep).withColumn("score", F.round("score", 9)).withColumn("truth", F.lit(0.0))
    spikes = {n: X.SPIKES[n] for n in ("size10", "pos_random")}
    after = scored(X.spiked_rows(rows.join(targets, KEYS), spikes)).cache()
    noises = {n: X.NOISES[n] for n in ("noise_poisson", "noise_gauss_snr0")}
    made = X.robust_windows(rows, after.drop("mu", "power"), seeds, noises)
    assert "Window [" not in made._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    got = made.cache()
    base = long(scored(rows), KEYS)
    moved = X.replaced_ranks(base, long(after, [*KEYS, "seed", "condition"]).drop("truth").withColumnRenamed("score", "new_score"))
    columns = ("window_id", "method", "seed", "condition", "item_id", "rank_before", "rank_after")
    assert listed(got.where(F.col("condition").isin(*spikes)), *columns) == listed(moved, *columns)
    ranked = R.rank_items(base)
    for name, (kind, snr) in noises.items():
        for s in seeds:
            new = R.rank_items(long(scored(X.noisy(rows, kind=kind, snr_db=snr, seed=s)), KEYS).withColumn("seed", F.lit(s)))
            mine = got.where((F.col("condition") == name) & (F.col("seed") == s))
            want = new.join(targets, [*KEYS, "seed"]).select("window_id", "method", "item_id", F.col("rank").alias("rank_after")).join(ranked.select("window_id", "method", "item_id", F.col("rank").alias("rank_before")), ["window_id", "method", "item_id"])
            columns = ("window_id", "method", "item_id", "rank_before", "rank_after")
            assert listed(mine.where("item_id is not null"), *columns) == listed(want, *columns)
            assert listed(mine.where("item_id is null"), "window_id", "method", "top10") == listed(X.seeded_overlap(ranked, new, ["window_id", "method", "seed"]), "window_id", "method", "top10")
