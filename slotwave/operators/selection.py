"""Exact quantiles of groups of any size: a sketch brackets each order statistic, counts place it, selection finds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def quantiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """by and a column for each name of `at`: the quantile at that share, linear between its two order statistics.

    Three passes over (by, value): a mergeable sketch of a group names a bracket for each order
    statistic, the rows below, in and above it are counted, and the values of the part that holds
    the wanted place are put in order with their counts, some 4 rows in `accuracy` of a group, equal
    values once. A bracket that misses costs time and not rightness, since the place is then sought on
    its other side. Null values are passed over; a group of nulls only has null quantiles, no rows give
    no rows (one row of nulls without `by`). A null key is a group; NaN is above all other values.
    """
    shares = sorted(set(at.values()))
    ends = [(i, side) for i in range(len(shares)) for side in (0, 1)]
    data = stored(rows.select(*by, F.col(value).cast("double").alias("_v")), "selection")
    known = data.where("_v is not null")

    # bracket of a share, wide enough for the sketch's error; whole range where it reaches an end
    margin = 2 / accuracy
    cuts = [c for s in shares for c in (max(s - margin, 0.0), min(s + margin, 1.0))]
    sketch = known.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", cuts, accuracy).alias("_c"))
    lo = lambda i: F.col("_c")[2 * i] if shares[i] > margin else F.col("_min")
    hi = lambda i: F.col("_c")[2 * i + 1] if shares[i] < 1 - margin else F.col("_max")
    spans = sketch.select(*by, "_n", *[c for i in range(len(shares)) for c in (lo(i).alias(f"_lo{i}"), hi(i).alias(f"_hi{i}"))])

    def with_groups(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        if not by:
            return left.crossJoin(F.broadcast(right))  # right is one row
        keyed = right.withColumnsRenamed({c: f"_key{j}" for j, c in enumerate(by)})
        same = [F.col(c).eqNullSafe(F.col(f"_key{j}")) for j, c in enumerate(by)]
        return left.join(keyed, same, how).drop(*[f"_key{j}" for j in range(len(by))])

    marked = with_groups(known, spans)
    counts = marked.groupBy(*by).agg(
        F.first("_n").alias("_n"),
        *[F.first(f"_{e}{i}").alias(f"_{e}{i}") for i in range(len(shares)) for e in ("lo", "hi")],
        *[F.count(F.when(F.col("_v") < F.col(f"_lo{i}"), 1)).alias(f"_under{i}") for i in range(len(shares))],
        *[F.count(F.when(F.col("_v") <= F.col(f"_hi{i}"), 1)).alias(f"_upto{i}") for i in range(len(shares))],
    )

    def place(i: int, side: int) -> Column:
        exact = shares[i] * (F.col("_n") - 1)
        return (F.ceil(exact) if side else F.floor(exact)).cast("long")

    def target(i: int, side: int) -> Column:
        """Where order statistic (i, side) lies: part -1 below the bracket, 0 in it, 1 above, and its place from 0 there."""
        k, under, upto = place(i, side), F.col(f"_under{i}"), F.col(f"_upto{i}")
        part = F.when(k < under, -1).when(k < upto, 0).otherwise(1)
        return F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), part.alias("part"), (k - F.when(k < under, 0).when(k < upto, under).otherwise(upto)).alias("k"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"))

    targets = counts.select(*by, F.array(*[target(i, s) for i, s in ends]).alias("_t"))
    own = lambda t: F.when(F.col("_v") < t["lo"], -1).when(F.col("_v") <= t["hi"], 0).otherwise(1) == t["part"]
    wanted = with_groups(known, targets).select(*by, "_v", F.explode(F.filter("_t", own)).alias("_t"))
    values = wanted.groupBy(*by, "_t.i", "_t.side", "_t.k", "_v").agg(F.count("*").alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(*by, "i", "side").orderBy("_v"))
    found = values.withColumn("_run", run).where((F.col("_run") > F.col("k")) & (F.col("_run") - F.col("_c") <= F.col("k")))
    ordered = found.groupBy(*by).agg(*[F.max(F.when((F.col("i") == i) & (F.col("side") == s), F.col("_v"))).alias(f"_o{i}{s}") for i, s in ends])

    def between(i: int) -> Column:
        low, high, exact = F.col(f"_o{i}0"), F.col(f"_o{i}1"), shares[i] * (F.col("_n") - 1)
        return F.when(low == high, low).otherwise((F.ceil(exact) - exact) * low + (exact - F.floor(exact)) * high)

    columns = {name: between(shares.index(s)) for name, s in at.items()}
    sizes = data.groupBy(*by).agg(F.count("_v").alias("_n"))
    return with_groups(sizes, ordered, "left").select(*by, *[c.alias(n) for n, c in columns.items()])


def cuts(rows: DataFrame, value: str, at: tuple[float, ...]) -> DataFrame:
    """One row with q, the array of the quantiles at these shares over all rows."""
    names = {f"q{i}": s for i, s in enumerate(at)}
    return quantiles(rows, [], value, names).select(F.array(*names).alias("q"))
