"""Quality queries on labels and centroids; each returns a DataFrame of few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import drawn
from .assign import assign


def _square(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def inertia(points: DataFrame, labels: DataFrame, centroids: DataFrame) -> DataFrame:
    """Sum of squared distances to the assigned centroid, the number of points, and the mean."""
    joined = points.join(labels, ["batch_id", "point_id"]).join(centroids.select("batch_id", F.col("k").alias("cluster_id"), "c"), ["batch_id", "cluster_id"])
    total = joined.agg(F.sum(_square(F.col("x"), F.col("c"))).alias("inertia"), F.count(F.lit(1)).alias("n_points"))
    return total.withColumn("per_point", F.col("inertia") / F.col("n_points"))


def sampled_inertia(points: DataFrame, centroids: DataFrame, sample: int | None = None, seed: int = 0, ids=None) -> DataFrame:
    """Sum of least squared distances over a sample of point ids, the same in every batch.

    ``ids`` is a condition that picks the sample; otherwise ``sample`` ids of least seeded draw are taken.
    """
    if ids is None:
        chosen = points.select("point_id").distinct().orderBy(drawn(seed, F.col("point_id")), "point_id").limit(sample)
        points = points.join(chosen, "point_id", "left_semi")
    else:
        points = points.filter(ids)
    return assign(points, centroids, with_points=True).agg(F.sum("distance").alias("inertia"), F.count(F.lit(1)).alias("n_points"))


def empty_clusters(labels: DataFrame, k: int) -> DataFrame:
    """Clusters 0..k-1 that no batch uses."""
    used = labels.select(F.col("cluster_id").cast("long").alias("k")).distinct()
    return labels.sparkSession.range(k).withColumnRenamed("id", "k").join(used, "k", "left_anti").agg(F.count(F.lit(1)).alias("n_empty"))


def label_disagreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """Share of points with different labels."""
    both = one.join(two.withColumnRenamed("cluster_id", "other"), ["batch_id", "point_id"])
    return both.agg(F.avg((F.col("cluster_id") != F.col("other")).cast("double")).alias("disagreement"), F.count(F.lit(1)).alias("n_points"))


def centroid_drift(one: DataFrame, two: DataFrame) -> DataFrame:
    """Relative Frobenius norm of the difference, and the mean and largest move."""
    both = one.join(two.withColumnRenamed("c", "d"), ["batch_id", "k"]).select(_square(F.col("c"), F.col("d")).alias("gap"), F.aggregate("d", F.lit(0.0), lambda s, v: s + v * v).alias("size"))
    return both.agg((F.sqrt(F.sum("gap")) / F.sqrt(F.sum("size"))).alias("rel_frobenius"), F.avg(F.sqrt("gap")).alias("mean_l2"), F.max(F.sqrt("gap")).alias("max_l2"))


def relative_delta(a, b):
    """(a - b) / b; null if b is 0."""
    return F.when(b != 0, (a - b) / b)


def off_fraction(one: DataFrame, two: DataFrame, atol: float, rtol: float) -> DataFrame:
    """Share of centroid components whose difference exceeds both the absolute and the relative bound."""
    both = one.join(two.withColumnRenamed("c", "d"), ["batch_id", "k"]).select(F.explode(F.arrays_zip("c", "d")).alias("z"))
    gap = F.abs(F.col("z.c") - F.col("z.d"))
    off = (gap > atol) & (gap > rtol * F.abs(F.col("z.d")))
    return both.agg(F.avg(off.cast("double")).alias("off_fraction"), F.count(F.lit(1)).alias("n_values"))


def label_summary(labels: DataFrame) -> DataFrame:
    """Distinct labels, their range, and the share of points that are their own label."""
    return labels.groupBy("batch_id").agg(F.count_distinct("cluster_id").alias("n_labels"), F.min("cluster_id").alias("least"), F.max("cluster_id").alias("most"), F.avg((F.col("cluster_id") == F.col("point_id")).cast("double")).alias("self_share"))


def flops(batches: int, n: int, k: int, dims: int, iters: int) -> int:
    """Floating-point operations of the distance products."""
    return 2 * batches * n * k * dims * iters
