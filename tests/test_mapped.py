"""Centroid files that workers map, against NumPy and the other strategies."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.functions.packed import pack, unpack
from loomvec.operators import assign as assign_module
from loomvec.operators import kmeans as kmeans_module
from loomvec.operators import mapped
from loomvec.operators.assign import assign
from loomvec.operators.kmeans import kmeans
from loomvec.plans.scratch import shared_dir

POINTS = "batch_id int, point_id long, x array<double>"
CENTROIDS = "batch_id int, k int, c array<double>"


def rows(spark, arrays, schema):
    return spark.createDataFrame([(b, i, [float(v) for v in row]) for b, x in arrays.items() for i, row in enumerate(x)], schema)


def gold(x, c):
    return ((x[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()


def labels(df):
    return sorted(map(tuple, df.select("batch_id", "point_id", "cluster_id").collect()))


@pytest.mark.parametrize("point_bytes", [100, 1 << 25])
def test_files_match_numpy(spark, monkeypatch, point_bytes):
    monkeypatch.setattr(mapped, "POINT_BYTES", point_bytes)
    rng = np.random.default_rng(3)
    x = {0: rng.integers(-4, 5, (90, 5)), 1: rng.integers(-4, 5, (40, 5)), 7: rng.integers(-4, 5, (10, 5))}
    few = rng.integers(-4, 5, (20, 5))
    c = {0: np.vstack([few, few, few[::-1]]), 1: rng.integers(-4, 5, (7, 5)), 3: few}
    found = assign(rows(spark, x, POINTS), rows(spark, c, CENTROIDS), strategy="file", block_bytes=300, with_points=True)
    assert found.columns == ["batch_id", "point_id", "x", "distance", "cluster_id"]
    # batch 7 has no centroids and batch 3 no points
    assert labels(found) == [(b, i, k) for b in (0, 1) for i, k in enumerate(gold(x[b], c[b]))]
    assert all(r.distance == min(((np.array(r.x) - c[r.batch_id]) ** 2).sum(axis=1)) for r in found.collect())


@pytest.mark.parametrize("clamp", [True, False])
def test_values_that_are_not_finite(spark, clamp):
    x = {0: [[1.0, 2.0], [np.inf, 0.0], [np.nan, 1.0], [0.0, 0.0], [-3.0, 1e200]]}
    c = {0: [[np.nan, 1.0], [1.0, 2.0], [np.inf, 0.0], [1.0, 2.0], [0.0, 0.0], [-3.0, 1e200]]}
    pts, cs = rows(spark, x, POINTS), rows(spark, c, CENTROIDS)
    assert labels(assign(pts, cs, clamp, "file", block_bytes=40)) == labels(assign(pts, cs, clamp, "arrow"))


def test_empty_points_broken_points_and_packed_points(spark):
    rng = np.random.default_rng(4)
    pts, cs = rows(spark, {0: rng.normal(size=(60, 4))}, POINTS), rows(spark, {0: rng.normal(size=(9, 4))}, CENTROIDS)
    assert labels(assign(pts.limit(0), cs, strategy="file")) == []
    for bad in (F.lit(None).cast("array<double>"), F.slice("x", 1, 3), F.concat(F.slice("x", 1, 3), F.array(F.lit(None).cast("double")))):
        with pytest.raises(Exception, match="a vector is null"):
            assign(pts.withColumn("x", F.when(F.col("point_id") == 5, bad).otherwise(F.col("x"))), cs, strategy="file").collect()
    short = pack(pts, "half")
    assert labels(assign(short, cs, strategy="file", block_bytes=100)) == labels(assign(unpack(short), cs, strategy="expression"))


def test_large_sets_take_files_and_scan_points_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(50, 6)), rng.normal(size=(40, 6))
    pts, cs = rows(spark, {0: x}, POINTS), rows(spark, {0: c}, CENTROIDS)
    want = [(0, i, k) for i, k in enumerate(gold(x, c))]
    monkeypatch.setattr(assign_module, "BLOCK_BYTES", 7 * 64)
    written = []
    monkeypatch.setattr(assign_module, "keep", lambda df, name: written.append(name) or df.persist())
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    assert labels(assign(pts.mapInArrow(count, POINTS), cs)) == want
    assert seen.value == len(x) and not written
    # where workers cannot open the shared folder, blocks are sent one by one, and points written between them
    monkeypatch.setattr(assign_module, "reachable", lambda spark: False)
    assert labels(assign(pts, cs)) == want and written


def test_a_shared_store_is_opened_or_refused(spark, monkeypatch):
    assert mapped.reachable(spark)
    monkeypatch.setattr(mapped, "shared_dir", lambda spark: "viewfs://store/shared")
    assert not mapped.reachable(spark)


def test_iterations_from_files_scan_once_and_clean_up(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5))
    pts, cs = rows(spark, {0: x}, POINTS), rows(spark, {0: x[:12]}, CENTROIDS)
    plain = kmeans(pts, 12, 4, init=cs)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for module in (kmeans_module, assign_module):
        monkeypatch.setattr(module, "BLOCK_BYTES", 3 * 56)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomvec-{spark.sparkContext.applicationId}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = len(files.listStatus(path)) if files.exists(path) else 0
    run = kmeans(pts.mapInArrow(count, POINTS), 12, 4, init=cs)
    assert seen.value == 4 * len(x)
    # the last two sets of centroids and the files of the labels
    assert len(files.listStatus(path)) - before == 3
    assert labels(run.labels) == labels(plain.labels)
    got, want = (sorted((r.k, r.c) for r in r.centroids.collect()) for r in (run, plain))
    assert np.allclose([c for _, c in got], [c for _, c in want], rtol=1e-12, atol=1e-12)
