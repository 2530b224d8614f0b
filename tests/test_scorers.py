"""Time-domain scorers against plain Python, on random, sparse, short and zero windows."""

import math
import random

from pyspark.sql import functions as F

from slotwave.functions import scorers as S


def windows():
    rng = random.Random(1)
    out = [[0.0] * 7, [5.0], [0.0, 0.0, 3.0, 0.0], [1.0, 2.0], [0.0, 5000.0]]
    out += [[float(rng.choice((0, 0, rng.randint(1, 40)))) for _ in range(rng.choice((3, 7, 16, 64)))] for _ in range(40)]
    return out


def since_last(x):
    return next((i for i, v in enumerate(reversed(x)) if v), None)


def plain(x):
    n, total, last = len(x), sum(x), since_last(x)
    e = x[0]
    for v in x[1:]:
        e = 0.2 * v + 0.8 * e
    first = next((i for i, v in enumerate(x) if v), None)
    recent = max(1, int(n * 0.2))
    return {
        "AF": sum(v * 0.5**i for i, v in enumerate(reversed(x))), "EWMA": e, "RRD": 0 if first is None else total / (n - first), "VSE": 0 if last is None else total / (last + 1),
        "CompoundPop": 0 if last is None else 0.5 * total / n + 0.3 * sum(x[-recent:]) / recent + 0.2 / (last + 1), "PFRF": math.prod(1.2 if v > 0 else 0.8 for v in x),
    }


def test_baselines(spark):
    rows = windows()
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<double>").select("i", *S.all_baselines(F.col("x"))).collect()
    for r in got:
        for name, want in plain(rows[r.i]).items():
            assert math.isclose(r[name], want, rel_tol=1e-9, abs_tol=1e-12), (name, rows[r.i])


def test_forecasts(spark):
    rows = windows()
    x = F.col("x")
    got = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, x array<double>").select("i", S.holt(x, 3).alias("holt"), S.persistence(x, 8).alias("p"), S.moving_average(x, 4, 2).alias("ma"), S.ar2(x, 3).alias("ar"), S.statistical(x).alias("st")).collect()
    for r in got:
        v = rows[r.i]
        assert r.p == 8 * max(v[-1], 0)
        assert math.isclose(r.ma, 2 * sum(v[-4:]) / len(v[-4:]), abs_tol=1e-12)
        assert r.ar >= 0 and math.isfinite(r.ar) and math.isfinite(r.st)
        if len(v) == 1:
            want = v[0] * 3
        else:
            level, trend = v[0], v[1] - v[0]
            for y in v[1:]:
                new = 0.3 * y + 0.7 * (level + trend)
                level, trend = new, 0.1 * (new - level) + 0.9 * trend
            want = sum(max(0.0, level + k * trend) for k in (1, 2, 3))
        assert math.isclose(r.holt, want, rel_tol=1e-9, abs_tol=1e-9)


def test_ar2_on_constant_and_short(spark):
    rows = [(0, [4.0] * 20), (1, [1.0, 2.0, 3.0])]
    got = {r.i: r.a for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", S.ar2(F.col("x"), 2).alias("a")).collect()}
    assert math.isclose(got[0], 8.0) and got[1] == 6.0


def test_validated(spark):
    rows = [(0, [1.0]), (1, []), (2, None), (3, [float("nan")]), (4, [None])]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, x array<double>").select("i", S.validated(F.col("x")).alias("v")).collect()}
    assert got == {0: [1.0], 1: None, 2: None, 3: None, 4: None}


def test_sql_functions(spark):
    """The registered SQL functions and the column expressions agree, on zeros and short windows too; registering twice is no error."""
    from slotwave.functions import sql_functions as SF

    SF.register(spark)
    SF.register(spark)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([[0.0, 2.0, 3.0, 0.0], [0.0, 0.0], [5.0], [1.0, 0.0, 0.0, 4.0, 2.0, 8.0, 1.0, 0.0, 0.0, 3.0, 1.0]])], "i int, x array<double>")
    rows.createOrReplaceTempView("sql_function_rows")
    got = {(r.i, r.method): r.score for r in spark.sql("SELECT i, s.* FROM sql_function_rows, LATERAL baseline_scores(x) s").collect()}
    want = rows.select("i", *[s.expr(F.col("x")).alias(s.name) for s in S.BASELINES]).collect()
    assert len(got) == 24 and all(abs(got[r.i, m] - r[m]) < 1e-12 for r in want for m in SF.METHODS)


def test_sketches_roll_up(spark):
    """Weeks from days equal weeks from rows; the error keeps its bound."""
    from slotwave.operators import cleaning as C

    rows = spark.range(60000).selectExpr("id * 7919 % 9001 as userId", "id % 3 as movieId", "timestamp_seconds(1700000000 + id % 40 * 43200) as timestamp")
    days, weeks = C.roll_up(C.distinct_sketches(rows, "1D"), "1W"), C.roll_up(C.distinct_sketches(rows, "1W"), "1W")
    key = ["timestamp", "item_id", "count", "user_count"]
    assert sorted(map(tuple, days.select(key).collect())) == sorted(map(tuple, weeks.select(key).collect()))
    exact = {(r.timestamp, r.item_id): r.user_count for r in C.rating_rows(rows.withColumn("rating", F.lit(1.0)), "1W").collect()}
    assert all(abs(r.user_count / exact[r.timestamp, r.item_id] - 1) < 0.05 for r in days.collect())


def test_scores_of_matrices(spark):
    """A sweep's scores of whole matrices are those of the columns, short and empty windows included."""
    from slotwave.operators import wavelet as V
    from slotwave.plans import popularity as P

    xs = [[0.0] * 9, [3.0], [0.0, 2.0], [0.0, 0.0, 5.0, 1.0, 0.0], [float(i * 7 % 5) for i in range(40)], [4.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x array<double>").coalesce(1)
    lengths = (7, 16)
    columns = [s.expr(P.G.newest("x", n)).cast("double").alias(f"{s.name}_{n}") for n in lengths for s in P.baselines_at(n)]
    want = {r.i: r.asDict() for r in rows.select("i", *columns).collect()}
    got = {r.i: r.asDict() for r in V.feature_sets(rows, {}, x="x", baselines=lengths).collect()}
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert got[i].keys() == r.keys() and all(math.isclose(got[i][c], v, rel_tol=1e-12, abs_tol=1e-15) for c, v in r.items()), i
