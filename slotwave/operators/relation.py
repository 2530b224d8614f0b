"""How features of windows relate to scores and truth: correlations, dependence, densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection
from .ranking import average_rank, numbered, pearson


def within_window(rows: DataFrame, names: list[str], target: str, control: str | None = None) -> DataFrame:
    """Per window: Spearman and Pearson of each feature with the target, and the partial Spearman given a control feature.

    Fewer than ten rows give null. Partial correlations follow from the three pairwise ones.
    """
    ranked = rows.select("*", *[average_rank(c, ["window_id"]).alias(f"r_{c}") for c in {*names, target, *([control] if control else [])}])
    few = F.count("*") < 10

    def corr(a: str, b: str) -> Column:
        flat = (F.stddev_pop(a) < 1e-12) | (F.stddev_pop(b) < 1e-12)
        return F.when(~few & ~flat, pearson(a, b))

    columns = [F.count("*").alias("n")]
    for c in names:
        columns += [corr(f"r_{c}", f"r_{target}").alias(f"spearman_{c}"), corr(c, target).alias(f"pearson_{c}")]
        if control and c != control:
            ab, ac, bc = corr(f"r_{c}", f"r_{target}"), corr(f"r_{c}", f"r_{control}"), corr(f"r_{target}", f"r_{control}")
            columns.append(((ab - ac * bc) / F.nullif(F.sqrt((1 - ac * ac) * (1 - bc * bc)), F.lit(0.0))).alias(f"partial_{c}"))
    return ranked.groupBy("window_id").agg(*columns)


def quantiles(rows: DataFrame, names: list[str], at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    long = rows.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "name", "value")
    return selection.quantiles(long, ["name"], "value", {f"q{round(100 * q):02d}": q for q in at})


def eta_squared(rows: DataFrame, feature: str, target: str, bins: int = 50) -> DataFrame:
    """Share of the target's variance between equal-count bins of the feature."""
    # as ntile: the first `over` bins hold one row more
    nth, least, over = F.col("nth"), F.floor(F.col("n_all") / bins), F.col("n_all") % bins
    place = F.when(nth < over * (least + 1), F.floor(nth / (least + 1))).otherwise(over + F.floor((nth - over * (least + 1)) / F.greatest(least, F.lit(1))))
    binned = numbered(rows.select(F.col(target).alias("t"), F.col(feature).alias("f")), "f").select("t", place.alias("bin"))
    per = binned.groupBy("bin").agg(F.count("*").alias("n"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("t")).alias("ss"))
    n, s, ss = F.sum("n"), F.sum("s"), F.sum("ss")
    return per.agg(((F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n) / F.nullif(ss - s * s / n, F.lit(0.0))).alias("eta_squared"))


def density(rows: DataFrame, a: str, b: str, cells: int = 100) -> DataFrame:
    """Non-empty cells of a grid over two features in [0, 1] or scaled to their range: (i, j, n)."""
    lo = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in (a, b) for f in (F.min, F.max)])
    place = lambda c: F.least(F.floor((F.col(c) - F.col(f"min_{c}")) / (F.col(f"max_{c}") - F.col(f"min_{c}") + 1e-12) * cells), F.lit(cells - 1)).cast("int")
    return rows.crossJoin(F.broadcast(lo)).groupBy(place(a).alias("i"), place(b).alias("j")).agg(F.count("*").alias("n"))


def mutual_information(rows: DataFrame, a: str, b: str, cells: int = 20) -> DataFrame:
    """Mutual information in nats of two features over equal-width cells."""
    grid = density(rows, a, b, cells)
    total = grid.agg(F.sum("n").alias("all"))
    joint = grid.withColumn("ni", F.sum("n").over(Window.partitionBy("i"))).withColumn("nj", F.sum("n").over(Window.partitionBy("j"))).crossJoin(F.broadcast(total))
    return joint.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("ni") * F.col("nj")))).alias("mutual_information"))


def collinearity(rows: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Correlation of two features and the variance inflation 1 / (1 - r^2) that it means."""
    r = pearson(*names)
    return rows.agg(r.alias("r"), (1 / F.nullif(1 - r * r, F.lit(0.0))).alias("vif"), F.avg((F.col(names[0]) > 0.5).cast("double")).alias("share_above_half"))
