"""Quantiles by selection against the built-in exact ones."""

import math

import pytest
from pyspark.sql import functions as F

from slotwave.operators import selection

AT = {"least": 0.0, "q05": 0.05, "q25": 0.25, "median": 0.5, "again": 0.5, "q90": 0.9, "most": 1.0}


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isclose(a, b, rel_tol=1e-12) or (math.isnan(a) and math.isnan(b))))


def compare(rows, by, accuracy):
    got = {tuple(r[c] for c in by): r for r in selection.quantiles(rows, by, "v", AT, accuracy).collect()}
    want = {tuple(r[c] for c in by): r for r in rows.groupBy(*by).agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in AT.items()]).collect()}
    assert got.keys() == want.keys()
    assert all(same(got[g][n], want[g][n]) for g in want for n in AT)


@pytest.mark.parametrize("accuracy", [3, 20, 10000])
def test_groups(spark, accuracy):
    """A hot group with ties, small ones, nulls, a group of nulls, one row, infinities; coarse sketches only widen the brackets."""
    group = "case when id % 10 = 0 then id % 7 when id = 1 then 20 when id % 41 = 2 then 21 when id % 43 = 3 then null else 9 end as g"
    value = "case when id % 41 = 2 then null when id % 13 = 5 then null when id % 97 = 1 then double('inf') when id % 89 = 1 then double('-inf') when id % 3 = 0 then 4.0D else double(id * 7919 % 10007) / 8 end as v"
    rows = spark.range(6000).selectExpr(group, value, "'x' as `a.b`").cache()
    compare(rows, ["g"], accuracy)
    compare(rows, [], accuracy)


def test_few_rows(spark):
    empty = spark.createDataFrame([], "g int, v double")
    assert selection.quantiles(empty, ["g"], "v", AT).isEmpty()
    assert [tuple(r) for r in selection.quantiles(empty, [], "v", AT).collect()] == [(None,) * len(AT)]
    compare(spark.createDataFrame([(1, 2.0), (1, float("nan")), (1, 3.0), (2, 5.0), (2, None)], "g int, v double"), ["g"], 100)


def test_missed_bracket(spark, monkeypatch):
    """A sketch that is wrong everywhere costs time only: places are found on the other side of the bracket."""
    rows = spark.range(500).selectExpr("int(id % 3) as g", "double(id * 31 % 499) as v").cache()
    for cut in (0.0, 1.0):
        with monkeypatch.context() as m:
            m.setattr(selection.F, "percentile_approx", lambda c, cuts, accuracy, cut=cut: F.array(*[F.max(c) if cut else F.min(c) for _ in cuts]))
            compare(rows, ["g"], 50)
