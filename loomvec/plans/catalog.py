"""Registered queries of the clustering engine and their SQL.

Points are ``embeddings`` (64 dimensions; one batch, or a batch for each label)
and ``lineitem`` (3 dimensions). Initial centroids are the rows of least id.
Vectors come out in long form; sums of products are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import pack, unpack
from ..functions.vectors import FORMATS, dot, rounded, sq_norm
from ..operators import measures
from ..operators.assign import assign, brute_force, cross_products, rejected
from ..operators.kmeans import KMeans, kmeans
from ..operators.update import accumulate, centroid_finalize, centroid_update, centroid_update_sorted, gather, long_form
from ..sources.points import first_k, gaussian_points, gaussian_rows, points, random_rows, read_gaussian, read_points, vector, write_table
from ..streaming.accumulate import accumulate_stream, committed
from ..streaming.assign import assign_stream, write_labels
from .ordering import dense_index
from .scratch import fresh
from .sql import register

Query = Callable[[SparkSession, str], DataFrame]
K, DIMS = 16, 64


def _embeddings(spark: SparkSession, sf: str, batched: bool = False) -> DataFrame:
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    return points(table, "vec_id", "embedding", "label" if batched else None)


def _start(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """The k rows of least id; the filter on the id reaches the scan."""
    low = _embeddings(spark, sf).filter(F.col("point_id") < k)
    return low.select("batch_id", F.col("point_id").cast("int").alias("k"), F.col("x").alias("c"))


def _lineitem(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return points(spark.read.parquet(f"{sf}/lineitem.parquet"), key, vector("l_quantity", "l_extendedprice", "l_discount"))


def point_sq_norms(spark, sf):
    return _embeddings(spark, sf).select("point_id", F.round(sq_norm(F.col("x")), 6).alias("x_sq"))


def centroid_sq_norms(spark, sf):
    return _start(spark, sf).select("k", F.round(sq_norm(F.col("c")), 6).alias("c_sq"))


def cross_product_table(spark, sf):
    return cross_products(_embeddings(spark, sf), _start(spark, sf)).select("point_id", "k", F.round("product", 6).alias("product"))


def pairwise_sq_dist(spark, sf):
    return cross_products(_embeddings(spark, sf), _start(spark, sf)).select("point_id", "k", F.round("distance", 6).alias("distance"))


def _labels(df: DataFrame) -> DataFrame:
    return df.select("point_id", "cluster_id")


def assign_raw(spark, sf):
    return _labels(assign(_embeddings(spark, sf), _start(spark, sf), clamp=False))


def assign_clamped(spark, sf):
    return _labels(assign(_embeddings(spark, sf), _start(spark, sf)))


def assign_expression(spark, sf):
    return _labels(assign(_embeddings(spark, sf), _start(spark, sf), strategy="expression"))


def assign_brute_force(spark, sf):
    return _labels(brute_force(_embeddings(spark, sf), _start(spark, sf)))


def assign_batched(spark, sf):
    pts = _embeddings(spark, sf, True)
    return assign(pts, first_k(pts, 4))


def assign_k1(spark, sf):
    return _labels(assign(_embeddings(spark, sf), _start(spark, sf, 1)))


def assign_identity(spark, sf):
    """Whether each of the first 64 points maps to itself, among all points."""
    found = assign(_embeddings(spark, sf), _start(spark, sf, 64))
    return found.select("point_id", "cluster_id", (F.col("cluster_id") == F.col("point_id")).alias("is_self"))


def assign_duplicate_centroid_tie(spark, sf):
    """Every centroid twice: the lower number wins each tie."""
    one = _start(spark, sf)
    return _labels(assign(_embeddings(spark, sf), one.unionByName(one.withColumn("k", (F.col("k") + K).cast("int")))))


def assign_odd_d(spark, sf):
    cut = lambda df, c: df.withColumn(c, F.slice(c, 1, 7))
    return _labels(assign(cut(_embeddings(spark, sf), "x"), cut(_start(spark, sf), "c")))


def assign_k8192_doubled(spark, sf):
    """4096 generated centroids, each twice, so that equal ones lie in different blocks of the kernel."""
    return _labels(assign(_embeddings(spark, sf), _doubled(spark)))


def _doubled(spark):
    one = gaussian_points(spark, 1, 4096, DIMS, 5).select("batch_id", F.col("point_id").cast("int").alias("k"), F.col("x").alias("c"))
    return one.unionByName(one.withColumn("k", F.col("k") + 4096))


def assign_mapped_files(spark, sf):
    """As assign_k8192_doubled, from five files of centroids that workers map into memory."""
    return _labels(assign(_embeddings(spark, sf), _doubled(spark), strategy="file", block_bytes=1 << 20))


def assign_k_gt_n(spark, sf):
    """Five regions against twenty-five nations, by key."""
    regions = points(spark.read.parquet(f"{sf}/region.parquet"), "r_regionkey", vector("r_regionkey"))
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.lit(0).alias("batch_id"), F.col("n_nationkey").cast("int").alias("k"), vector("n_regionkey").alias("c"))
    return _labels(assign(regions, nations))


def assign_given_norms(spark, sf):
    """Given norms are used unverified: they bias centroids by their number."""
    biased = _start(spark, sf).withColumn("c_sq", F.lit(1.0) + F.col("k") * 0.03125)
    return _labels(assign(_embeddings(spark, sf), biased, clamp=False))


def _half(spark, sf, kind):
    pts = _embeddings(spark, sf).withColumn("x", rounded(F.col("x"), kind))
    low = pts.filter(F.col("point_id") < K).select("batch_id", F.col("point_id").cast("int").alias("k"), F.col("x").alias("c"))
    return _labels(assign(pts, low, clamp=False))


def assign_half(spark, sf):
    return _half(spark, sf, "half")


def assign_bfloat(spark, sf):
    return _half(spark, sf, "bfloat")


def d_sweep_disagreement(spark, sf):
    """Kernel against brute force for several lengths."""
    out = None
    for d in (1, 7, 16, 31, 64):
        pts = _embeddings(spark, sf).withColumn("x", F.slice("x", 1, d))
        start = _start(spark, sf).withColumn("c", F.slice("c", 1, d))
        row = measures.label_disagreement(assign(pts, start, strategy="arrow"), brute_force(pts, start)).select(F.lit(d).alias("d"), "disagreement", "n_points")
        out = row if out is None else out.unionByName(row)
    return out


def _assigned(spark, sf):
    return assign(_embeddings(spark, sf), _start(spark, sf))


def label_sort_permutation(spark, sf):
    placed = dense_index(_assigned(spark, sf), ["batch_id"], ["cluster_id", "point_id"], "position")
    return placed.select("position", "point_id", "cluster_id")


def label_runs_256(spark, sf):
    """Runs of equal labels in blocks of 256 sorted rows."""
    placed = label_sort_permutation(spark, sf).withColumn("block", F.floor(F.col("position") / 256).cast("long"))
    return placed.groupBy("block", "cluster_id").agg(F.min("position").alias("run_start"), F.count(F.lit(1)).alias("run_length"))


def _long_sums(df: DataFrame) -> DataFrame:
    return long_form(df, "sums").select("k", "dim", "value", "cnt")


def centroid_update_sums(spark, sf):
    return _long_sums(centroid_update(_embeddings(spark, sf), _assigned(spark, sf), K, DIMS))


def _shifted(spark, sf):
    """Labels some of which fall outside the range."""
    return _assigned(spark, sf).withColumn("cluster_id", F.when(F.col("cluster_id") == 3, -1).when(F.col("cluster_id") == 5, K).otherwise(F.col("cluster_id")).cast("int"))


def centroid_update_out_of_range(spark, sf):
    return _long_sums(centroid_update(_embeddings(spark, sf), _shifted(spark, sf), K, DIMS))


def centroid_update_accumulate(spark, sf):
    one = centroid_update(_embeddings(spark, sf), _assigned(spark, sf), K, DIMS)
    two = centroid_update(_embeddings(spark, sf), _shifted(spark, sf), K, DIMS)
    return _long_sums(accumulate(one, two))


def _gathered(spark, sf):
    """Points in label order: the permutation names each point by its number in id order."""
    numbered = dense_index(_assigned(spark, sf), ["batch_id"], ["point_id"], "at")
    order = dense_index(numbered.withColumnRenamed("at", "perm"), ["batch_id"], ["cluster_id", "point_id"], "position").select("batch_id", "position", "perm", "cluster_id")
    return gather(_embeddings(spark, sf), order, numbered)


def gather_by_permutation(spark, sf):
    return _gathered(spark, sf).select("position", "perm", "point_id", F.element_at("x", 1).alias("x_first"), F.element_at("x", DIMS).alias("x_last"))


def centroid_update_indexed(spark, sf):
    return _long_sums(centroid_update_sorted(_gathered(spark, sf), K, DIMS))


def _long(df: DataFrame) -> DataFrame:
    return long_form(df).select("k", "dim", "value")


def centroid_finalize_means(spark, sf):
    return _long(centroid_finalize(centroid_update(_embeddings(spark, sf), _assigned(spark, sf), K, DIMS), _start(spark, sf)))


def centroid_finalize_empty(spark, sf):
    """Clusters whose labels were out of range keep their old centroid."""
    return _long(centroid_finalize(centroid_update(_embeddings(spark, sf), _shifted(spark, sf), K, DIMS), _start(spark, sf)))


def _run(spark, sf, iters, tol=0.0, verbose=False):
    return kmeans(_embeddings(spark, sf), K, iters, tol, _start(spark, sf), verbose)


def kmeans_iter1(spark, sf):
    return _long(_run(spark, sf, 1).centroids)


def kmeans_labels_5(spark, sf):
    return _labels(_run(spark, sf, 5).labels)


def kmeans_centroids_5(spark, sf):
    return _long(_run(spark, sf, 5).centroids)


def kmeans_batched(spark, sf):
    pts = _embeddings(spark, sf, True)
    return long_form(kmeans(pts, 4, 3, init=first_k(pts, 4)).centroids).select("batch_id", "k", "dim", "value")


def kmeans_shift_history(spark, sf):
    shifts = _run(spark, sf, 5, verbose=True).shifts
    return spark.createDataFrame([(i + 1, round(s, 9)) for i, s in enumerate(shifts)], "iteration int, shift double")


def kmeans_tol_stop(spark, sf):
    """The run stops once the largest move is below the bound."""
    run = _run(spark, sf, 10, tol=0.12)
    return _long(run.centroids).withColumn("n_iters", F.lit(run.n_iters))


def _short(spark, sf, precision):
    """Three iterations whose points and centroids are rounded to a shorter format."""
    return _long(kmeans(_embeddings(spark, sf), K, 3, init=_start(spark, sf), precision=precision).centroids)


def kmeans_half(spark, sf):
    return _short(spark, sf, "half")


def kmeans_bfloat(spark, sf):
    return _short(spark, sf, "bfloat")


def kmeans_single(spark, sf):
    return _short(spark, sf, "single")


def fit_predict(spark, sf):
    pts = _embeddings(spark, sf)
    return _labels(KMeans(K, 3).fit(pts, _start(spark, sf)).predict(pts))


def kmeans_bounds(spark, sf):
    """Six iterations whose bounds skip products: labels as without."""
    return _labels(kmeans(_embeddings(spark, sf), K, 6, init=_start(spark, sf), bounds=True).labels)


def kmeans_resumed(spark, sf):
    """Three iterations, and two more from their log alone."""
    folder = fresh(spark, "log")
    kmeans(_embeddings(spark, sf), K, 3, init=_start(spark, sf), log=folder)
    return _long(kmeans(_embeddings(spark, sf), K, 5, log=folder).centroids)


def model_store(spark, sf):
    """A model fitted, saved, loaded and used."""
    folder = fresh(spark, "model")
    KMeans(K, 3).fit(_embeddings(spark, sf), _start(spark, sf)).save(folder)
    return _labels(KMeans.load(spark, folder).predict(_embeddings(spark, sf)))


def _packed(spark, sf):
    """All points as a table of two-byte vectors, written and read again."""
    path = fresh(spark, "packed")
    write_table(pack(_embeddings(spark, sf), "half"), path)
    return read_points(spark, path, "point_id", "x", "batch_id")


def assign_packed(spark, sf):
    pts = _packed(spark, sf)
    low = unpack(pts.filter(F.col("point_id") < K)).select("batch_id", F.col("point_id").cast("int").alias("k"), F.col("x").alias("c"))
    return _labels(assign(pts, low, clamp=False))


def kmeans_packed(spark, sf):
    """As kmeans_half, from packed points and with bounds."""
    return _long(kmeans(_packed(spark, sf), K, 3, init=_start(spark, sf), precision="half", bounds=True).centroids)


def assign_in_sql(spark, sf):
    """Assignment written in SQL alone."""
    register(spark)
    spark.read.parquet(f"{sf}/embeddings.parquet").createOrReplaceTempView("loomvec_embeddings")
    return spark.sql(f"""
        SELECT vec_id AS point_id, nearest_centroid(CAST(embedding AS ARRAY<DOUBLE>), (
          SELECT array_sort(collect_list(named_struct('k', CAST(vec_id AS INT), 'c', CAST(embedding AS ARRAY<DOUBLE>)))) FROM loomvec_embeddings WHERE vec_id < {K})) AS cluster_id
        FROM loomvec_embeddings""")


def source_noise(spark, sf):
    """All points with seeded noise, which is read from the generating data source."""
    pts = _embeddings(spark, sf)
    n = pts.agg(F.max("point_id") + 1).first()[0] or 0
    noise = read_gaussian(spark, rows=n, dims=3, seed=5).select("point_id", F.col("x").alias("noise"))
    moved = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda d: F.element_at("x", d) + F.element_at("noise", d) / 8)
    return pts.join(noise, "point_id").select("point_id", F.posexplode(moved).alias("dim", "value")).withColumn("value", F.round("value", 9))


def validation_counts(spark, sf):
    """What validation rejects in a damaged copy of the points."""
    x, kind = F.col("x"), F.col("point_id") % 10
    hole = F.concat(F.array(F.lit(None).cast("double")), F.slice("x", 2, DIMS))
    damaged = F.when(kind == 0, F.lit(None)).when(kind == 1, F.slice("x", 1, DIMS - 1)).when(kind == 2, hole).otherwise(x)
    return rejected(_embeddings(spark, sf).withColumn("x", damaged), DIMS)


def scan_points(spark, sf):
    """The scan of a Parquet table as points, by batch."""
    pts = read_points(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", "label")
    return pts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("point_id").alias("last"), F.sum(F.element_at("x", 1)).alias("total"))


def sink_labels(spark, sf):
    """Labels written as a table and read again."""
    path = fresh(spark, "labels")
    write_table(_assigned(spark, sf), path)
    return _labels(spark.read.parquet(path))


def stream_assign(spark, sf):
    """Labels of a stream of all points, appended to a table until the stream has nothing new."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/embeddings[.]parquet")  # a pattern may name one file
    path = fresh(spark, "stream")
    write_labels(assign_stream(points(stream, "vec_id", "embedding"), _start(spark, sf)), path, f"{path}-state").awaitTermination()
    return _labels(spark.read.schema("batch_id int, point_id long, cluster_id int").parquet(path))


def stream_accumulate(spark, sf):
    """Sums of a stream of all points by nearest centroid, committed batch by batch."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/embeddings[.]parquet")
    folder = fresh(spark, "sums")
    accumulate_stream(points(stream, "vec_id", "embedding"), _start(spark, sf), folder, f"{folder}-state", clamp=False).awaitTermination()
    return _long_sums(committed(spark, folder))


def reassign_final(spark, sf):
    return _labels(assign(_embeddings(spark, sf), _run(spark, sf, 3).centroids))


def inertia_final(spark, sf):
    run = _run(spark, sf, 3)
    pts = _embeddings(spark, sf)
    found = measures.inertia(pts, assign(pts, run.centroids), run.centroids)
    return found.select(F.round("inertia", 6).alias("inertia"), "n_points", F.round("per_point", 8).alias("per_point"))


def inertia_sampled(spark, sf):
    """Exact inertia over a sample of ids, which is what the operator is for."""
    found = measures.sampled_inertia(_embeddings(spark, sf), _run(spark, sf, 3).centroids, ids=F.pmod("point_id", F.lit(3)) == 0)
    return found.select(F.round("inertia", 6).alias("inertia"), "n_points")


def inertia_drawn(spark, sf):
    """Exact inertia over 200 drawn points."""
    found = measures.sampled_inertia(_embeddings(spark, sf), _run(spark, sf, 3).centroids, sample=200, seed=11)
    return found.select(F.round("inertia", 6).alias("inertia"), "n_points")


def inertia_delta(spark, sf):
    """Relative change of the inertia from one iteration to three."""
    pts = _embeddings(spark, sf)
    one, three = (measures.inertia(pts, assign(pts, c), c).select(F.col("inertia").alias(n)) for n, c in (("one", _run(spark, sf, 1).centroids), ("three", _run(spark, sf, 3).centroids)))
    return three.join(F.broadcast(one)).select(F.round(measures.relative_delta(F.col("three"), F.col("one")), 8).alias("delta"))


def empty_cluster_count(spark, sf):
    return measures.empty_clusters(_shifted(spark, sf), K)


def label_disagreement(spark, sf):
    return measures.label_disagreement(_assigned(spark, sf), reassign_final(spark, sf).withColumn("batch_id", F.lit(0))).select(F.round("disagreement", 9).alias("disagreement"), "n_points")


def centroid_drift(spark, sf):
    found = measures.centroid_drift(_run(spark, sf, 3).centroids, _start(spark, sf))
    return found.select(*(F.round(c, 8).alias(c) for c in found.columns))


def centroid_off_fraction(spark, sf):
    found = measures.off_fraction(_run(spark, sf, 3).centroids, _run(spark, sf, 1).centroids, 0.02, 0.5)
    return found.select(F.round("off_fraction", 9).alias("off_fraction"), "n_values")


def label_summary(spark, sf):
    return measures.label_summary(assign(_embeddings(spark, sf), _start(spark, sf, 64))).select("n_labels", "least", "most", F.round("self_share", 9).alias("self_share"))


def lineitem_kmeans(spark, sf):
    """Two iterations over all line items in three dimensions."""
    pts = _lineitem(spark, sf)
    k = F.col("id")
    start = spark.range(8).select(F.lit(0).alias("batch_id"), k.cast("int").alias("k"), F.array(3.0 + 6.0 * k, 5000.0 + 11000.0 * k, F.lit(0.05)).alias("c"))
    run = kmeans(pts, 8, 2, init=start, check=False)
    sizes = run.labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("cluster_id", "n")


def lineitem_bounds(spark, sf):
    """Six iterations over all line items whose bounds skip products."""
    pts, k = _lineitem(spark, sf), F.col("id")
    start = spark.range(8).select(F.lit(0).alias("batch_id"), k.cast("int").alias("k"), F.array(3.0 + 6.0 * k, 5000.0 + 11000.0 * k, F.lit(0.05)).alias("c"))
    run = kmeans(pts, 8, 6, init=start, bounds=True)
    return run.labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def init_random(spark, sf):
    pts = _embeddings(spark, sf, True)
    return long_form(random_rows(pts, 4, 7)).select("batch_id", "k", "dim", "value")


def datagen_kmeans(spark, sf):
    """Two batches of generated points, one of each for every row of the table."""
    rows = _embeddings(spark, sf).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("batch_id"), "point_id")
    pts = gaussian_rows(rows, 16, 3)
    found = long_form(kmeans(pts, 8, 2, init=first_k(pts, 8)).centroids)
    return found.select("batch_id", "k", "dim", F.round("value", 6).alias("value"))


def operation_counts(spark, sf):
    """Operations of five iterations over all embeddings."""
    n = _embeddings(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return n.select((F.col("n") * (2 * K * DIMS * 5)).alias("flops"))


def queries() -> dict[str, Query]:
    found = (
        point_sq_norms, centroid_sq_norms, cross_product_table, pairwise_sq_dist, assign_raw, assign_clamped, assign_expression, assign_brute_force, assign_batched, assign_k1,
        assign_identity, assign_duplicate_centroid_tie, assign_odd_d, assign_k_gt_n, assign_given_norms, assign_half, assign_bfloat, d_sweep_disagreement, label_sort_permutation,
        label_runs_256, centroid_update_sums, centroid_update_out_of_range, centroid_update_accumulate, centroid_update_indexed, centroid_finalize_means, centroid_finalize_empty,
        kmeans_iter1, kmeans_labels_5, kmeans_centroids_5, kmeans_batched, kmeans_shift_history, kmeans_tol_stop, reassign_final, inertia_final, inertia_sampled, inertia_delta,
        empty_cluster_count, label_disagreement, centroid_drift, centroid_off_fraction, label_summary, lineitem_kmeans, init_random, datagen_kmeans, operation_counts,
        assign_k8192_doubled, gather_by_permutation, kmeans_half, kmeans_bfloat, kmeans_single, fit_predict, validation_counts, scan_points, sink_labels, stream_assign, inertia_drawn,
        kmeans_bounds, lineitem_bounds, kmeans_resumed, model_store, stream_accumulate, assign_packed, kmeans_packed, assign_in_sql, source_noise, assign_mapped_files,
    )
    return {f.__name__: f for f in found}


# --- the same in SQL -------------------------------------------------------------------------------------------------------------

_P = "p AS MATERIALIZED (SELECT 0 AS b, vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)"


def _c0(k: int = K) -> str:
    return f"c0 AS MATERIALIZED (SELECT 0 AS b, id::INT AS k, x AS c FROM p WHERE id < {k})"


def _assign(name: str, cents: str, pts: str = "p", distance: str = "list_dot_product(c, c) - 2 * list_dot_product(x, c)") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT b, id, k FROM (SELECT {pts}.b, id, k, row_number() OVER (PARTITION BY {pts}.b, id ORDER BY {distance}, k) AS r FROM {pts} JOIN {cents} ON {pts}.b = {cents}.b) WHERE r = 1)"""


def _update(name: str, labels: str, cents: str, pts: str = "p") -> str:
    """Sums in long form for every cluster of ``cents``; 0 where a cluster has no point."""
    return f"""{name} AS MATERIALIZED (
  SELECT s.b, s.k, s.dim, coalesce(u.value, 0) AS value, coalesce(u.n, 0) AS n, s.c[s.dim + 1] AS old
  FROM (SELECT b, k, c, unnest(range(len(c))) AS dim FROM {cents}) s
  LEFT JOIN (SELECT b, k, dim, sum(v) AS value, count(*) AS n
    FROM (SELECT l.b, l.k, unnest(x) AS v, unnest(range(len(x))) AS dim FROM {pts} JOIN {labels} l ON {pts}.b = l.b AND {pts}.id = l.id) GROUP BY ALL) u
  ON s.b = u.b AND s.k = u.k AND s.dim = u.dim)"""


def _short_of(v: str, precision: str) -> str:
    """A value rounded to nearest, ties to even, in a shorter format."""
    if precision == "double":
        return v
    if precision == "single":
        return f"({v})::FLOAT::DOUBLE"
    bits, least = FORMATS[precision]
    v = _short_of(v, "single") if precision == "bfloat" else f"({v})"
    unit = f"pow(2.0, greatest(floor(log2(abs({v}))), {least}) - {bits})"
    return f"(CASE WHEN {v} = 0 THEN {v} ELSE round_even({v} / {unit}, 0) * {unit} END)"


def _short_points(precision: str) -> str:
    return f"p AS MATERIALIZED (SELECT 0 AS b, vec_id AS id, list_transform(embedding::DOUBLE[], lambda v: {_short_of('v', precision)}) AS x FROM embeddings)"


def _drawn(seed: int, *keys: str) -> str:
    """The seeded draw of integer keys."""
    h = f"{seed}::BIGINT"
    for key in keys:
        h = f"(({h} + {key} + 1013904223) * 747796405 % 4294967296)"
        h = f"(xor({h}, {h} >> 16) * 569420461 % 4294967296)"
        h = f"xor({h}, {h} >> 15)"
    return h


def _normal_points(name: str, batches: int, ids: str, dims: int, seed: int) -> str:
    one, two = (_drawn(seed, "b", "id", f"(2 * d + {k})") for k in (0, 1))
    value = f"sqrt(-2 * ln(({one} + 0.5) / 4294967296.0)) * cos({two} * (2 * pi() / 4294967296.0))"
    rows = f"FROM range({batches}) t(b), {ids} u(id), range({dims}) v(d)"
    return f"{name} AS MATERIALIZED (SELECT b, id, list(v ORDER BY d) AS x FROM (SELECT b, id, d, ({value})::DOUBLE AS v {rows}) GROUP BY b, id)"


def _final(name: str, sums: str, precision: str = "double") -> str:
    return f"{name} AS MATERIALIZED (SELECT b, k, list(CASE WHEN n > 0 THEN {_short_of('value / n', precision)} ELSE old END ORDER BY dim) AS c FROM {sums} GROUP BY b, k)"


def _lloyd(iters: int, pts: str = "p", precision: str = "double") -> str:
    steps = []
    for i in range(iters):
        steps += [_assign(f"a{i}", f"c{i}", pts), _update(f"u{i}", f"a{i}", f"c{i}", pts), _final(f"c{i + 1}", f"u{i}", precision)]
    return ", ".join(steps)


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


_FLAT = "SELECT k, dim::INT AS dim, c[dim + 1] AS value FROM (SELECT k, c, unnest(range(len(c))) AS dim FROM {})"
_SHIFT = f"s0 AS MATERIALIZED (SELECT b, id, (CASE k WHEN 3 THEN -1 WHEN 5 THEN {K} ELSE k END)::INT AS k FROM a0)"
_GAP = "list_sum(list_transform(list_zip(n.c, o.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _moves(i: int) -> str:
    return f"(SELECT max(sqrt({_GAP})) FROM c{i} o JOIN c{i + 1} n USING (b, k))"


def oracle_sql() -> dict[str, str]:
    base = (_P, _c0())
    labels = "SELECT id AS point_id, k AS cluster_id FROM {}"
    sums = "SELECT k, dim::INT AS dim, value, n::BIGINT AS cnt FROM {}"
    every = "FROM p JOIN c0 ON p.b = c0.b"
    distance = "list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c)"
    by_label = "p AS MATERIALIZED (SELECT label AS b, vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings)", "c0 AS MATERIALIZED (SELECT b, (r - 1)::INT AS k, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY id) AS r FROM p) WHERE r <= 4)"
    odd = _P.replace("embedding::DOUBLE[]", "(embedding::DOUBLE[])[1:7]")
    sorted_rows = "o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k, id) - 1 AS position, id AS point_id, k AS cluster_id FROM a0)"
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    total = f"SELECT sum({square}) AS inertia, count(*) AS n FROM p JOIN {{0}} l USING (b, id) JOIN {{1}} c ON c.b = l.b AND c.k = l.k"
    tol = []
    for i in range(10):
        tol.append(f"m{i} AS MATERIALIZED (SELECT {_moves(i)} AS m)")
    stop = "CASE " + " ".join(f"WHEN (SELECT m FROM m{i}) < 0.12 THEN {i + 1}" for i in range(10)) + " ELSE 10 END"
    line = "p AS MATERIALIZED (SELECT 0 AS b, row_number() OVER () AS id, [l_quantity, l_extendedprice, l_discount] AS x FROM lineitem)", "c0 AS MATERIALIZED (SELECT 0 AS b, r::INT AS k, [3.0::DOUBLE + 6 * r, 5000.0 + 11000 * r, 0.05] AS c FROM range(8) t(r))"
    plain = "(x[1]*x[1] + x[2]*x[2] + x[3]*x[3]) + (c[1]*c[1] + c[2]*c[2] + c[3]*c[3]) - 2 * (x[1]*c[1] + x[2]*c[2] + x[3]*c[3])"
    line_steps = [_assign("a0", "c0", distance=plain), _update("u0", "a0", "c0"), _final("c1", "u0"), _assign("a1", "c1", distance=plain)]
    steps, sweep = [], []
    for d in (1, 7, 16, 31, 64):
        steps += [f"p{d} AS MATERIALIZED (SELECT b, id, x[1:{d}] AS x FROM p)", f"c{d} AS MATERIALIZED (SELECT b, id::INT AS k, x AS c FROM p{d} WHERE id < {K})"]
        steps += [_assign(f"a{d}", f"c{d}", f"p{d}"), _assign(f"g{d}", f"c{d}", f"p{d}", square)]
        sweep.append(f"SELECT {d}::INT AS d, avg((a{d}.k <> g{d}.k)::INT)::DOUBLE AS disagreement, count(*) AS n_points FROM a{d} JOIN g{d} USING (b, id)")
    indexed = "m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY b ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY b) AS n FROM p)"
    every_dim = "SELECT b::INT AS batch_id, k::INT AS k, dim::INT AS dim, {} AS value FROM (SELECT b, k, c, unnest(range(len(c))) AS dim FROM {})"
    short = {precision: _with(_short_points(precision), _c0(), _lloyd(3, precision=precision)) + _FLAT.format("c3") for precision in ("half", "bfloat", "single")}
    line_more = list(line_steps)
    for i in range(1, 6):
        line_more += [_update(f"u{i}", f"a{i}", f"c{i}"), _final(f"c{i + 1}", f"u{i}"), _assign(f"a{i + 1}", f"c{i + 1}", distance=plain)]
    return {
        "point_sq_norms": _with(_P) + "SELECT id AS point_id, round(list_dot_product(x, x), 6) AS x_sq FROM p",
        "centroid_sq_norms": _with(*base) + "SELECT k, round(list_dot_product(c, c), 6) AS c_sq FROM c0",
        "cross_product_table": _with(*base) + f"SELECT id AS point_id, k, round(list_dot_product(x, c), 6) AS product {every}",
        "pairwise_sq_dist": _with(*base) + f"SELECT id AS point_id, k, round(greatest({distance}, 0), 6) AS distance {every}",
        "assign_raw": _with(*base, _assign("a0", "c0")) + labels.format("a0"),
        "assign_clamped": _with(*base, _assign("a0", "c0", distance=f"greatest({distance}, 0)")) + labels.format("a0"),
        "assign_expression": _with(*base, _assign("a0", "c0", distance=f"greatest({distance}, 0)")) + labels.format("a0"),
        "assign_brute_force": _with(*base, _assign("a0", "c0", distance=f"greatest({distance}, 0)")) + labels.format("a0"),
        "assign_batched": _with(*by_label, _assign("a0", "c0")) + "SELECT b AS batch_id, id AS point_id, k AS cluster_id FROM a0",
        "assign_k1": "SELECT vec_id AS point_id, 0::INT AS cluster_id FROM embeddings",
        "assign_identity": _with(_P, _c0(64), _assign("a0", "c0")) + "SELECT id AS point_id, k AS cluster_id, k = id AS is_self FROM a0",
        "assign_duplicate_centroid_tie": _with(*base, _assign("a0", "c0")) + labels.format("a0"),
        "assign_odd_d": _with(odd, _c0(), _assign("a0", "c0")) + labels.format("a0"),
        "assign_k_gt_n": "SELECT r_regionkey::BIGINT AS point_id, (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey)::INT AS cluster_id FROM region",
        "assign_given_norms": _with(*base, _assign("a0", "c0", distance="1.0 + k * 0.03125 - 2 * list_dot_product(x, c)")) + labels.format("a0"),
        "assign_half": _with(_short_points("half"), _c0(), _assign("a0", "c0")) + labels.format("a0"),
        "assign_bfloat": _with(_short_points("bfloat"), _c0(), _assign("a0", "c0")) + labels.format("a0"),
        "assign_k8192_doubled": _with(_P, _normal_points("g", 1, "range(4096)", DIMS, 5), "c0 AS MATERIALIZED (SELECT 0 AS b, id::INT AS k, x AS c FROM g)", _assign("a0", "c0", distance=distance)) + labels.format("a0"),
        "assign_mapped_files": _with(_P, _normal_points("g", 1, "range(4096)", DIMS, 5), "c0 AS MATERIALIZED (SELECT 0 AS b, id::INT AS k, x AS c FROM g)", _assign("a0", "c0", distance=distance)) + labels.format("a0"),
        "gather_by_permutation": _with(*base, _assign("a0", "c0"), sorted_rows) + f"SELECT position, (SELECT count(*) FROM p q WHERE q.id < o.point_id) AS perm, point_id, x[1] AS x_first, x[{DIMS}] AS x_last FROM o JOIN p ON p.id = o.point_id",
        "kmeans_half": short["half"],
        "kmeans_bfloat": short["bfloat"],
        "kmeans_single": short["single"],
        "fit_predict": _with(*base, _lloyd(3), _assign("a3", "c3")) + labels.format("a3"),
        "validation_counts": f"SELECT count(*) AS n_points, count(*) FILTER (x IS NULL) AS n_null, count(*) FILTER (len(x) <> {DIMS}) AS n_length, count(*) FILTER (len(x) = {DIMS} AND len(list_filter(x, lambda v: v IS NULL)) > 0) AS n_incomplete FROM (SELECT CASE vec_id % 10 WHEN 0 THEN NULL WHEN 1 THEN embedding[1:{DIMS - 1}] WHEN 2 THEN list_concat([NULL], embedding[2:{DIMS}]) ELSE embedding END AS x FROM embeddings)",
        "scan_points": "SELECT label AS batch_id, count(*) AS n, max(vec_id) AS last, sum(embedding[1]::DOUBLE) AS total FROM embeddings GROUP BY label",
        "sink_labels": _with(*base, _assign("a0", "c0")) + labels.format("a0"),
        "stream_assign": _with(*base, _assign("a0", "c0")) + labels.format("a0"),
        "inertia_drawn": _with(*base, _lloyd(3), _assign("a3", "c3")) + f"SELECT round(inertia, 6) AS inertia, n AS n_points FROM ({total.format('a3', 'c3')} WHERE id IN (SELECT id FROM p ORDER BY {_drawn(11, 'id')}, id LIMIT 200))",
        "init_random": _with(by_label[0], indexed, f"s AS (SELECT b, n, k, {_drawn(7, 'b', 'k')} % n AS pos FROM (SELECT DISTINCT b, n FROM m), range(4) t(k))", "c0 AS (SELECT b, k, x AS c FROM s JOIN m USING (b, pos))") + every_dim.format("c[dim + 1]", "c0"),
        "datagen_kmeans": _with(_normal_points("p", 2, "(SELECT vec_id FROM embeddings)", 16, 3), "c0 AS MATERIALIZED (SELECT b, id::INT AS k, x AS c FROM p WHERE id < 8)", _lloyd(2)) + every_dim.format("round(c[dim + 1], 6)", "c2"),
        "d_sweep_disagreement": _with(_P, *steps) + " UNION ALL ".join(sweep),
        "label_sort_permutation": _with(*base, _assign("a0", "c0"), sorted_rows) + "SELECT * FROM o",
        "label_runs_256": _with(*base, _assign("a0", "c0"), sorted_rows) + "SELECT position // 256 AS block, cluster_id, min(position) AS run_start, count(*) AS run_length FROM o GROUP BY ALL",
        "centroid_update_sums": _with(*base, _assign("a0", "c0"), _update("u0", "a0", "c0")) + sums.format("u0"),
        "centroid_update_indexed": _with(*base, _assign("a0", "c0"), _update("u0", "a0", "c0")) + sums.format("u0"),
        "centroid_update_out_of_range": _with(*base, _assign("a0", "c0"), _SHIFT, _update("u0", "s0", "c0")) + sums.format("u0"),
        "centroid_update_accumulate": _with(*base, _assign("a0", "c0"), _SHIFT, _update("u0", "a0", "c0"), _update("u1", "s0", "c0")) + "SELECT k, dim::INT AS dim, u0.value + u1.value AS value, (u0.n + u1.n)::BIGINT AS cnt FROM u0 JOIN u1 USING (b, k, dim)",
        "centroid_finalize_means": _with(*base, _lloyd(1)) + _FLAT.format("c1"),
        "centroid_finalize_empty": _with(*base, _assign("a0", "c0"), _SHIFT, _update("u0", "s0", "c0"), _final("c1", "u0")) + _FLAT.format("c1"),
        "kmeans_iter1": _with(*base, _lloyd(1)) + _FLAT.format("c1"),
        "kmeans_labels_5": _with(*base, _lloyd(5)) + labels.format("a4"),
        "kmeans_centroids_5": _with(*base, _lloyd(5)) + _FLAT.format("c5"),
        "kmeans_batched": _with(*by_label, _lloyd(3)) + "SELECT b AS batch_id, k, dim::INT AS dim, c[dim + 1] AS value FROM (SELECT b, k, c, unnest(range(len(c))) AS dim FROM c3)",
        "kmeans_shift_history": _with(*base, _lloyd(5)) + " UNION ALL ".join(f"SELECT {i + 1}::INT AS iteration, round({_moves(i)}, 9) AS shift" for i in range(5)),
        "kmeans_tol_stop": _with(*base, _lloyd(10), *tol, f"s AS MATERIALIZED (SELECT {stop} AS n)") + " UNION ALL ".join(f"SELECT *, {i}::INT AS n_iters FROM ({_FLAT.format(f'c{i}')}) WHERE (SELECT n FROM s) = {i}" for i in range(1, 11)),
        "reassign_final": _with(*base, _lloyd(3), _assign("a3", "c3")) + labels.format("a3"),
        "inertia_final": _with(*base, _lloyd(3), _assign("a3", "c3")) + f"SELECT round(inertia, 6) AS inertia, n AS n_points, round(inertia / n, 8) AS per_point FROM ({total.format('a3', 'c3')})",
        "inertia_sampled": _with(*base, _lloyd(3), _assign("a3", "c3")) + f"SELECT round(inertia, 6) AS inertia, n AS n_points FROM ({total.format('a3', 'c3')} WHERE id % 3 = 0)",
        "inertia_delta": _with(*base, _lloyd(3), _assign("a3", "c3")) + f"SELECT round((t.inertia - o.inertia) / o.inertia, 8) AS delta FROM ({total.format('a3', 'c3')}) t, ({total.format('a1', 'c1')}) o",
        "empty_cluster_count": _with(*base, _assign("a0", "c0"), _SHIFT) + f"SELECT {K} - count(DISTINCT k) AS n_empty FROM s0 WHERE k >= 0 AND k < {K}",
        "label_disagreement": _with(*base, _lloyd(3), _assign("a3", "c3")) + "SELECT round(avg((a0.k <> a3.k)::INT), 9) AS disagreement, count(*) AS n_points FROM a0 JOIN a3 USING (b, id)",
        "centroid_drift": _with(*base, _lloyd(3)) + f"SELECT round(sqrt(sum({_GAP})) / sqrt(sum(list_dot_product(o.c, o.c))), 8) AS rel_frobenius, round(avg(sqrt({_GAP})), 8) AS mean_l2, round(max(sqrt({_GAP})), 8) AS max_l2 FROM c3 n JOIN c0 o USING (b, k)",
        "centroid_off_fraction": _with(*base, _lloyd(3)) + "SELECT round(avg((abs(v - w) > 0.02 AND abs(v - w) > 0.5 * abs(w))::INT), 9) AS off_fraction, count(*) AS n_values FROM (SELECT unnest(n.c) AS v, unnest(o.c) AS w FROM c3 n JOIN c1 o USING (b, k))",
        "label_summary": _with(_P, _c0(64), _assign("a0", "c0")) + "SELECT count(DISTINCT k) AS n_labels, min(k) AS least, max(k) AS most, round(avg((k = id)::INT), 9) AS self_share FROM a0",
        "lineitem_kmeans": _with(*line, *line_steps) + "SELECT k AS cluster_id, count(*) AS n FROM a1 GROUP BY k",
        "kmeans_bounds": _with(*base, _lloyd(6)) + labels.format("a5"),
        "lineitem_bounds": _with(*line, *line_more) + "SELECT k AS cluster_id, count(*) AS n FROM a5 GROUP BY k",
        "kmeans_resumed": _with(*base, _lloyd(5)) + _FLAT.format("c5"),
        "assign_packed": _with(_short_points("half"), _c0(), _assign("a0", "c0")) + labels.format("a0"),
        "kmeans_packed": short["half"],
        "assign_in_sql": _with(*base, _assign("a0", "c0")) + labels.format("a0"),
        "source_noise": _with(_P, _normal_points("g", 1, "(SELECT vec_id FROM embeddings)", 3, 5)) + "SELECT point_id, dim, round(v, 9) AS value FROM (SELECT p.id AS point_id, unnest(range(3))::INT AS dim, unnest([p.x[1] + g.x[1] / 8, p.x[2] + g.x[2] / 8, p.x[3] + g.x[3] / 8]) AS v FROM p JOIN g ON p.id = g.id)",
        "model_store": _with(*base, _lloyd(3), _assign("a3", "c3")) + labels.format("a3"),
        "stream_accumulate": _with(*base, _assign("a0", "c0"), _update("u0", "a0", "c0")) + sums.format("u0"),
        "operation_counts": f"SELECT count(*) * {2 * K * DIMS * 5} AS flops FROM embeddings",
    }
