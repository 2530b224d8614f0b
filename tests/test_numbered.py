"""Places in a global order without a window over all rows."""

import pytest
from pyspark.sql import functions as F

from slotwave.operators import audit, cleaning, ranking, relation
from slotwave.operators.ranking import numbered
from slotwave.sources import tables


@pytest.mark.parametrize("n", [0, 1, 30, 1003])
def test_numbered(spark, n):
    rows = spark.range(n).select((F.col("id") * 7919 % 1009 % 101).alias("v"), "id")
    got = sorted((r.nth, r.v, r.n_all) for r in numbered(rows, "v").collect())
    assert [x[0] for x in got] == list(range(n)) and [x[1] for x in got] == sorted(x[1] for x in got) and {x[2] for x in got} <= {n}


@pytest.mark.parametrize("n", [30, 1003])
def test_eta_squared(spark, n):
    f, t = [i * 7919 % 10007 for i in range(n)], [i * i % 97 for i in range(n)]
    order = sorted(range(n), key=f.__getitem__)
    sizes = [n // 50 + (b < n % 50) for b in range(50)]
    groups = [[t[i] for i in order[sum(sizes[:b]) : sum(sizes[: b + 1])]] for b in range(50)]
    mean = sum(t) / n
    want = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in groups if g) / sum((x - mean) ** 2 for x in t)
    got = relation.eta_squared(spark.createDataFrame(list(zip(f, t, strict=True)), "f long, t long"), "f", "t").first()[0]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_ranks_of_large_windows(spark, ranges):
    """Ranks made of ranges equal those of one sort a window, with ties, non-finite scores and a large window; no window holds a group alone."""
    rows = spark.range(700).selectExpr("int(case when id % 7 = 0 then id % 3 else 9 end) as window_id", "'m' as method", "cast(id * 7919 % 1009 as string) as item_id", "case when id % 50 = 3 then double('nan') when id % 60 = 5 then null when id % 70 = 6 then double('inf') else double(id * 31 % 23) end as score", "double(id % 11) as truth").cache()
    columns = ["window_id", "method", "item_id", "rank", "truth_rank", "n_items", "tied"]
    large = ranking.rank_large(rows, ranges=ranges)
    got, want = (sorted(map(tuple, df.select(columns).collect()), key=str) for df in (large, ranking.rank_items(rows)))
    assert got == want
    metrics = [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in ranking.protocol(rows.withColumn("score", F.when(~F.isnan("score"), F.col("score"))), (5,), ranges=n).collect()), key=str) for n in (None, ranges)]
    assert metrics[0] == metrics[1]
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(window_id#" in plan and not any("row_number" in x and "_range" not in x for x in plan.splitlines() if "Window [" in x)


@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_large_protocol_of_wide_rows(spark, ranges, monkeypatch):
    """Values that lie in several ranges, all equal ones too, keep their places; ranges follow the rows, and nothing is joined by value but by broadcast."""
    wide = spark.range(900).selectExpr("int(case when id % 9 = 0 then id % 4 else 9 end) as window_id", "cast(id * 7919 % 1009 as string) as item_id", "double(id * id % 97 % 3) as truth", "double(id * 31 % 23) as a", "1.0D as b", "case when id % 70 = 6 then double('inf') else double(id % 2) end as c").cache()
    want = ranking.protocol(ranking.to_long(wide, list("abc"), ["window_id", "item_id", "truth"]), (3, 10))
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(want.columns).collect()), key=str)
    assert plain(ranking.protocol_large(wide, list("abc"), (3, 10), ranges, 900)) == plain(want)
    seen = []
    monkeypatch.setattr(ranking, "RANGE_ROWS", 100)
    monkeypatch.setattr(ranking, "_ranked_by", lambda rows, by, value, place, mean, n, made=ranking._ranked_by: seen.append(n) or made(rows, by, value, place, mean, n))
    ranking.protocol_large(wide, list("abc"), (3,), ranges, 900)
    assert seen == [max(ranges, 9), max(ranges, 27)]


def test_no_window_over_all_rows(spark):
    """No exchange of rows to a single partition, but of counts or a few."""
    items = spark.range(1000).select(F.col("id").cast("string").alias("item_id"), F.col("id").alias("count"))
    for out in (cleaning.systematic_sample(items, 100, 700), tables.page_dictionary(items.withColumnRenamed("item_id", "page"))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [row_number() windowspecdefinition(_part" in plan and "windowspecdefinition(item_id" not in plan and "windowspecdefinition(page" not in plan
    out = audit.threshold_interval(items, 7)
    assert "GlobalLimit 8" in out._jdf.queryExecution().optimizedPlan().toString() and tuple(out.first()) == (993, 993)


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_kendall_by_blocks(spark, block):
    """Blocks of any size give what one sort a window gives: ties, non-finite scores, windows that do not vary, of one row and of many."""
    window = "int(case when id % 9 = 0 then id % 4 when id = 1 then 5 when id % 31 = 2 then 6 else 9 end) as window_id"
    rows = spark.range(600).selectExpr(window, "'m' as method", "cast(id * 7919 % 1009 as string) as item_id", "case when id % 50 = 3 then double('nan') when id % 60 = 5 then null when id % 70 = 6 then double('inf') when id % 31 = 2 then 1.0D else double(id * 31 % 23) end as score", "double(id * id % 97 % 11) as truth").cache()
    got, want = ({(r.window_id, r.method): r.kendall_tau for r in df.collect()} for df in (ranking.kendall_large(rows, ranges=5, block=block), ranking.kendall(rows)))
    assert got.keys() == want.keys() and None in want.values()
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or got[k] == pytest.approx(want[k])) for k in want)


def test_kendall_of_no_rows(spark):
    rows = spark.createDataFrame([], "window_id int, method string, item_id string, score double, truth double")
    assert ranking.kendall_large(rows).isEmpty()


@pytest.mark.parametrize("rho", [True, False])
def test_metrics_of_wide_rows(spark, rho):
    """One row an item gives what one row a method gives: ties, infinite scores, items without a score of a method, windows of one item."""
    wide = spark.range(900).selectExpr("int(case when id % 9 = 0 then id % 4 when id = 1 then 5 else 9 end) as window_id", "cast(id * 7919 % 1009 as string) as item_id", "double(id * id % 97 % 11) as truth", "double(id * 31 % 23) as a", "case when id % 5 > 0 then sqrt(id * 37 % 101) end as b", "case when id % 70 = 6 then double('inf') else 1.0D end as c").cache()
    methods = {"a": F.col("a"), "b+": F.col("b") / 3, "c": F.col("c")}
    named = wide.select("window_id", "item_id", "truth", *[c.alias(n) for n, c in methods.items()])
    long = ranking.to_long(named, list(methods), ["window_id", "item_id", "truth"]).where("score is not null").withColumn("score", F.round("score", 9))
    plain = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(columns).collect()), key=str)
    want = ranking.protocol(long, (3, 10))
    columns = [c for c in want.columns if rho or c != "spearman_rho"]
    assert plain(want) == plain(ranking.protocol_wide(wide, methods, (3, 10), rho=rho))
    live = spark.createDataFrame([(9,), (0,)], "window_id int")
    assert {r.window_id for r in ranking.protocol_wide(wide, methods, (3,), 2, live, rho=rho).collect()} == {0, 9}
    large = ranking.protocol_wide(wide, methods, (3, 10), items=900, cells=100, rho=rho)
    assert plain(large) == plain(want) and "unpivot" not in ranking.protocol_wide(wide, methods, rho=rho)._jdf.queryExecution().optimizedPlan().toString().lower() and "Expand" not in ranking.protocol_wide(wide, methods, rho=rho)._jdf.queryExecution().optimizedPlan().toString()


def test_cells_of_blocks_stay_below_the_rows(spark):
    """Small blocks of a large window: cells grow with its rows, not with their square."""
    rows = spark.range(4000).selectExpr("1 as g", "id + 1 as p", "id * 1601 % 4001 as i").selectExpr("g", "p", "row_number() over (order by i) as q").cache()
    out = ranking.inversions(rows, ["g"], 2)
    q = [r.q for r in rows.orderBy("p").collect()]
    assert out.first().swaps == sum(a > b for i, a in enumerate(q) for b in q[i + 1 :])
    last = ranking.blocks(rows, ["g"], 2).agg(F.max("_a"), F.max("_b")).first()
    assert (last[0] + 1) * (last[1] + 1) <= 4100
