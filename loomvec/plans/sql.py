"""SQL functions of a session, so that assignment and distances can be written in SQL alone.

They are plain SQL: Spark expands them into the expressions of the query, with
no Python in its plan. A set of centroids is an array of ``named_struct('k', k,
'c', c)``, as a scalar subquery collects it; it travels with the plan, so it is
for sets that fit one row (larger ones go through ``assign``).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "vector_dot(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(x, y, (a, b) -> a * b), 0D, (s, v) -> s + v)",
    "squared_norm(x ARRAY<DOUBLE>) RETURNS DOUBLE": "vector_dot(x, x)",
    "squared_distance(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE": "greatest(vector_dot(x, x) + vector_dot(y, y) - 2D * vector_dot(x, y), 0D)",
    "nearest_centroid(x ARRAY<DOUBLE>, centroids ARRAY<STRUCT<k: INT, c: ARRAY<DOUBLE>>>) RETURNS INT": (
        "array_min(transform(centroids, s -> struct("
        "aggregate(zip_with(s.c, s.c, (a, b) -> a * b), 0D, (t, v) -> t + v) - 2D * aggregate(zip_with(x, s.c, (a, b) -> a * b), 0D, (t, v) -> t + v) AS d, s.k AS k))).k"
    ),
}


def register(spark: SparkSession) -> SparkSession:
    """Create the functions in the session; they replace earlier ones of their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return spark
