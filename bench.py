"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import importlib
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "assign_raw", "assign_expression", "centroid_update_sums", "kmeans_iter1", "kmeans_centroids_5", "kmeans_batched", "inertia_final", "lineitem_kmeans", "lineitem_bounds", "kmeans_packed", "datagen_kmeans",
    "op1_url_filter", "op2_secret_scan", "op3_benchmark_decontamination", "op4_best_fit_packing", "op5_substring_dedup", "op6_language_id", "op7_embedding_near_dedup", "op8_quality_classifier", "op9_minhash_near_dedup", "op10_token_shards",
    "op11_toxicity", "op12_importance_resampling", "op13_conversation_repair",
)


#: Shapes with published figures: points, centroids, dimensions, and iterations of the longer of two runs.
SHAPES = {"med": (32768, 256, 128, 6), "big": (131072, 2048, 128, 3), "huge": (262144, 4096, 128, 2)}


def shape_seconds(spark: SparkSession, n: int, k: int, dims: int, iterations: int) -> float:
    """Seconds of one Lloyd iteration on generated points: a longer run less a run of one iteration, both warm."""
    from loomvec.operators.kmeans import kmeans
    from loomvec.sources.points import first_k, gaussian_points

    pts = gaussian_points(spark, 1, n, dims, 0).repartition(spark.sparkContext.defaultParallelism).persist()
    init = first_k(pts, k).persist()
    took = {}
    for count in (1, 1, iterations):
        began = time.perf_counter()
        kmeans(pts, k, count, init=init, check=False)
        took[count] = time.perf_counter() - began
    pts.unpersist()
    return (took[iterations] - took[1]) / (iterations - 1)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch)
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    seconds = {}
    for name in HEADLINE:
        if name in queries:
            best = float("inf")
            for _ in range(2):  # the second run has compiled code and warm workers
                began = time.perf_counter()
                queries[name](spark, sf).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - began)
            seconds[name] = round(best, 3)
    rate = {}
    for name, (n, k, dims, iterations) in SHAPES.items():
        took = shape_seconds(spark, n, k, dims, iterations)
        seconds[f"kmeans_{name}_iteration"], rate[name] = round(took, 4), round(2e-9 * n * k * dims / took, 1)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "gflops": rate, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
