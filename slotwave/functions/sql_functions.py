"""The time-domain scorers as functions of Spark SQL, for queries written as text.

register() makes temporary scalar functions af(x), ewma(x), rrd(x), vse(x), compound_pop(x) and
pfrf(x) of an array of doubles, oldest to newest, and a table function baseline_scores(x) that
gives (method, score) rows in a lateral join. Their bodies are SQL, so they stay in the JVM and
the optimizer sees through them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_TOTAL = "aggregate(x, 0D, (a, v) -> a + v)"
#: Place of the first non-zero slot from the oldest, and from the newest; 0 without one.
_FIRST, _LAST = "array_position(transform(x, v -> v <> 0D), true)", "array_position(transform(reverse(x), v -> v <> 0D), true)"
_RECENT = "greatest(1, CAST(floor(size(x) * 0.2D) AS INT))"

BODIES = {
    "af": "aggregate(x, 0D, (a, v) -> a * 0.5D + v)",
    "ewma": "aggregate(slice(x, 2, greatest(size(x) - 1, 0)), element_at(x, 1), (e, v) -> 0.2D * v + 0.8D * e)",
    "rrd": f"CASE WHEN {_FIRST} > 0 THEN {_TOTAL} / (size(x) - {_FIRST} + 1) ELSE 0D END",
    "vse": f"CASE WHEN {_LAST} > 0 THEN {_TOTAL} / {_LAST} ELSE 0D END",
    "compound_pop": f"CASE WHEN {_LAST} > 0 THEN 0.5D * {_TOTAL} / size(x) + 0.3D * aggregate(slice(x, -{_RECENT}, {_RECENT}), 0D, (a, v) -> a + v) / {_RECENT} + 0.2D / {_LAST} ELSE 0D END",
    "pfrf": "aggregate(x, 1D, (a, v) -> a * CASE WHEN v > 0D THEN 1.2D ELSE 0.8D END)",
}
METHODS = {"AF": "af", "EWMA": "ewma", "RRD": "rrd", "VSE": "vse", "CompoundPop": "compound_pop", "PFRF": "pfrf"}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; those of an earlier call are replaced."""
    for name, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    rows = ", ".join(f"named_struct('method', '{m}', 'score', {BODIES[f]})" for m, f in METHODS.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION baseline_scores(x ARRAY<DOUBLE>) RETURNS TABLE (method STRING, score DOUBLE) RETURN SELECT s.method, s.score FROM (SELECT explode(array({rows})) AS s)")
