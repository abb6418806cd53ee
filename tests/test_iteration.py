"""Merging of sums, bounds, the iteration log, kept models and sums of streams, against NumPy and plain runs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.operators import bounds, update
from loomvec.operators import kmeans as kmeans_module
from loomvec.operators.assign import assign
from loomvec.operators.kmeans import KMeans, kmeans
from loomvec.operators.update import PARTIAL, accumulate, centroid_finalize, centroid_update_labelled, merge
from loomvec.plans.commits import Folder
from loomvec.sources.points import gaussian_points

POINTS = "batch_id int, point_id long, x array<double>"
CENTROIDS = "batch_id int, k int, c array<double>"


def frame(spark, x, batch=0):
    return spark.createDataFrame([(batch, i, [float(v) for v in row]) for i, row in enumerate(x)], POINTS)


def cents(spark, c, batch=0):
    return spark.createDataFrame([(batch, i, [float(v) for v in row]) for i, row in enumerate(c)], CENTROIDS)


def table(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def near(one, two):
    """The same centroids, up to the order in which tasks add points up."""
    one, two = table(one, "batch_id", "k", "c"), table(two, "batch_id", "k", "c")
    return [r[:2] for r in one] == [r[:2] for r in two] and np.allclose([r[2] for r in one], [r[2] for r in two], rtol=1e-12, atol=1e-12)


def test_counts_beyond_32_bits(spark):
    half = spark.createDataFrame([(0, 0, [1.5, 2.0], 2_000_000_000), (0, 1, [1.0, 1.0], 5)], PARTIAL)
    got = {r.k: (r.sums, r.cnt) for r in accumulate(half, half).collect()}
    assert got == {0: ([3.0, 4.0], 4_000_000_000), 1: ([2.0, 2.0], 10)}
    new = centroid_finalize(accumulate(half, half), cents(spark, [[0.0, 0.0], [9.0, 9.0]]))
    assert table(new, "k", "c")[0] == (0, [3.0 / 4e9, 4.0 / 4e9])


@pytest.mark.parametrize("groups", [1, 7])
def test_a_million_partial_rows(spark, groups):
    rows = spark.range(0, 1_000_000, 1, 16).select(F.lit(0).alias("batch_id"), (F.col("id") % groups).cast("int").alias("k"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("sums"), F.lit(3).cast("long").alias("cnt"))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        merged = merge(rows, groups)
        got = {r.k: (r.sums, r.cnt) for r in merged.collect()}
        plan = merged._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = np.arange(1_000_000)
    assert got == {k: ([float(ids[k::groups].sum()), float(len(ids[k::groups]))], 3 * len(ids[k::groups])) for k in range(groups)}
    assert ("salt" in plan) == (groups == 1)  # few clusters: a first level dealt by task


def test_merge_across_arrow_batches_and_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(int(b), int(k), [float(v), 1.0], int(n)) for b, k, v, n in zip(rng.integers(0, 3, 3000), rng.integers(0, 5, 3000), rng.integers(0, 99, 3000), rng.integers(0, 9, 3000))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.batch_id, r.k): (r.sums, r.cnt) for r in merge(spark.createDataFrame(rows, PARTIAL).repartition(9)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for b, k, s, n in rows:
        old = want.get((b, k), ([0.0, 0.0], 0))
        want[b, k] = [old[0][0] + s[0], old[0][1] + s[1]], old[1] + n
    assert got == want
    assert merge(spark.createDataFrame([], PARTIAL)).collect() == []


def test_partials_add_up_while_they_hold(monkeypatch):
    monkeypatch.setattr(update, "HELD_BYTES", 4000)
    held, x = update.Partials(3), np.random.default_rng(2).standard_normal((900, 4))
    label = np.arange(900) % 4 - 1  # -1 is left out
    out = [r for a in range(0, 900, 30) for r in held.add(np.zeros(30, int), x[a : a + 30], label[a : a + 30])] + [held.rows()]
    assert len(out) == 1 and out[0].column("k").to_pylist() == [0, 1, 2]
    assert np.allclose(out[0].column("sums").to_pylist(), [x[label == k].sum(0) for k in range(3)])


# --- bounds ----------------------------------------------------------------------------------------------------------------------


def same_run(points, k, iters, init, **more):
    plain, fast = kmeans(points, k, iters, init=init, **more), kmeans(points, k, iters, init=init, bounds=True, **more)
    assert table(plain.labels, "batch_id", "point_id", "cluster_id") == table(fast.labels, "batch_id", "point_id", "cluster_id")
    assert near(plain.centroids, fast.centroids)
    assert plain.n_iters == fast.n_iters and np.allclose(plain.shifts, fast.shifts) and len(fast.saved) == fast.n_iters
    return fast.saved


@pytest.mark.parametrize("clamp", [True, False])
def test_bounds_change_nothing_and_save_products(spark, clamp):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.standard_normal((300, 3)) + 12 * c for c in np.eye(3)])
    saved = same_run(frame(spark, x), 3, 8, cents(spark, x[[0, 299, 899]]), clamp=clamp, verbose=True)
    assert saved[0] == 0.0 and saved[-1] > 0.9


def test_bounds_with_batches_ties_doubles_and_values_that_are_not_finite(spark):
    rng = np.random.default_rng(8)
    grid = rng.integers(0, 4, (400, 2)).astype(float)  # many exact ties
    doubled = np.vstack([grid[:3], grid[:3], [[50.0, 50.0]]])
    points = frame(spark, grid).unionByName(frame(spark, grid * 2, 1)).unionByName(spark.createDataFrame([(7, 0, [1.0, 1.0])], POINTS))
    init = cents(spark, doubled).unionByName(cents(spark, doubled * 2, 1))
    same_run(points.filter("batch_id < 7"), 7, 7, init)
    odd = np.vstack([grid[:40], [[math.nan, 1.0], [math.inf, 0.0]]])
    for clamp in (True, False):
        plain, fast = (kmeans(frame(spark, odd), 2, 4, init=cents(spark, grid[:2]), clamp=clamp, bounds=b) for b in (False, True))
        assert table(plain.labels, "point_id", "cluster_id") == table(fast.labels, "point_id", "cluster_id")


@pytest.mark.parametrize("precision", ["half", "bfloat"])
def test_bounds_in_short_formats(spark, precision):
    x = np.random.default_rng(9).standard_normal((500, 4))
    same_run(frame(spark, x), 5, 6, cents(spark, x[:5]), precision=precision)


def test_bounds_hold_for_moved_centroids():
    rng = np.random.default_rng(10)
    for _ in range(30):
        x, c = rng.standard_normal((200, 5)) * 10 ** rng.uniform(-3, 3), rng.standard_normal((6, 5))
        now = c + rng.standard_normal((6, 5)) * 10 ** rng.uniform(-6, 0)
        gold = lambda cs: ((x[:, None] - cs[None]) ** 2).sum(-1)
        label = gold(c).argmin(1)
        upper, lower = bounds.bounds_of(x, c, label)
        each = np.sqrt(gold(c))
        assert (upper >= each[np.arange(200), label]).all()
        each[np.arange(200), label] = np.inf
        assert (lower <= each.min(1)).all()
        sure = bounds.unchanged(x, label, upper, lower, c, now)
        assert (gold(now).argmin(1) == label)[sure].all()
    upper, lower = bounds.bounds_of(x[:, :5], np.vstack([c[:1], c[:1]]), np.zeros(200, int))
    assert not bounds.unchanged(x, np.zeros(200, int), upper, lower, np.vstack([c[:1], c[:1]]), np.vstack([now[:1], c[:1]])).any()
    one = bounds.bounds_of(x, c[:1], np.zeros(200, int))
    assert bounds.unchanged(x, np.zeros(200, int), *one, c[:1], now[:1]).all()  # a single centroid


# --- log, models, streams --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [32 << 20, 64])
@pytest.mark.parametrize("with_bounds", [False, True])
def test_a_run_goes_on_from_its_log(spark, tmp_path, monkeypatch, block, with_bounds):
    monkeypatch.setattr(kmeans_module, "BLOCK_BYTES", block)
    x = np.random.default_rng(11).standard_normal((300, 4))
    points, init = frame(spark, x), cents(spark, x[:5])
    whole = kmeans(points, 5, 6, init=init, verbose=True)
    step, calls = kmeans_module.merge, []

    def dying(*a, **k):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("the driver is lost in iteration 4")
        return step(*a, **k)

    log = f"file://{tmp_path}/log"
    monkeypatch.setattr(kmeans_module, "merge", dying)
    monkeypatch.setattr(update, "merge", dying)
    with pytest.raises(RuntimeError, match="lost"):
        kmeans(points, 5, 6, init=init, log=log, bounds=with_bounds)
    monkeypatch.setattr(kmeans_module, "merge", step)
    monkeypatch.setattr(update, "merge", step)
    assert Folder(spark, log).numbers("iteration") == [0, 1, 2, 3]
    (tmp_path / "log" / ".draft-left").mkdir()  # what a driver left when it died while writing
    run = kmeans(points, 5, 6, log=log, bounds=with_bounds, verbose=True)
    assert near(run.centroids, whole.centroids) and table(run.labels, "point_id", "cluster_id") == table(whole.labels, "point_id", "cluster_id")
    assert run.n_iters == 6 and np.allclose(run.shifts, whole.shifts)
    again = kmeans(points, 5, 6, log=log)  # nothing is left to do
    assert table(again.labels, "point_id", "cluster_id") == table(whole.labels, "point_id", "cluster_id") and again.n_iters == 6
    with pytest.raises(ValueError, match="other parameters"):
        kmeans(points, 5, 6, log=log, precision="half")


def test_a_logged_run_that_has_stopped_stays_stopped(spark, tmp_path):
    x = np.random.default_rng(12).standard_normal((100, 2))
    one = kmeans(frame(spark, x), 3, 50, tol=0.05, init=cents(spark, x[:3]), log=f"file://{tmp_path}/log")
    two = kmeans(frame(spark, x), 3, 50, tol=0.05, log=f"file://{tmp_path}/log")
    assert 1 < one.n_iters == two.n_iters < 50 and table(one.labels, "point_id", "cluster_id") == table(two.labels, "point_id", "cluster_id")


def test_good_points_are_scanned_once_an_iteration(spark):
    """No scan of their own for validation: the job of an iteration is the only one that reads the points."""
    x = np.random.default_rng(13).standard_normal((50, 2))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    points = frame(spark, x).mapInArrow(count, POINTS)
    kmeans(points, 2, 3, init=cents(spark, x[:2]))
    assert seen.value == 3 * 50
    broken = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [1.0])], POINTS)
    with pytest.raises(ValueError, match="not of length 2"):
        kmeans(broken, 1, 1, init=cents(spark, [[0.0, 0.0]]), bounds=True)


def test_models_are_kept_as_versions(spark, tmp_path):
    points = gaussian_points(spark, 2, 200, 3, 4)
    folder = f"file://{tmp_path}/models"
    with pytest.raises(ValueError, match="no version"):
        KMeans.load(spark, folder)
    with pytest.raises(ValueError, match="fit first"):
        KMeans(2).save(folder)
    first, second = KMeans(4, 2, seed=1).fit(points), KMeans(4, 5, precision="half", seed=2).fit(points)
    assert (first.save(folder), second.save(folder)) == (1, 2)
    other = spark.newSession()
    for model, loaded in ((second, KMeans.load(other, folder)), (first, KMeans.load(other, folder, 1))):
        assert table(loaded.predict(points), "batch_id", "point_id", "cluster_id") == table(model.predict(points), "batch_id", "point_id", "cluster_id")
        assert (loaded.precision, loaded.max_iters, loaded.result.n_iters) == (model.precision, model.max_iters, model.result.n_iters)
    with pytest.raises(ValueError, match="no version 3"):
        KMeans.load(spark, folder, 3)


def test_sums_of_a_stream_count_each_batch_once(spark, tmp_path):
    from loomvec.streaming.accumulate import accumulate_stream, committed

    x = np.random.default_rng(14).standard_normal((100, 3))
    points, centroids = frame(spark, x), cents(spark, x[:4])
    want = table(centroid_update_labelled(assign(points, centroids, with_points=True), 4, 3), "batch_id", "k", "cnt")
    sums, state = f"file://{tmp_path}/sums", tmp_path / "state"
    source = tmp_path / "in"

    def run():
        stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        accumulate_stream(stream, centroids, sums, str(state), every=3).awaitTermination(300)

    for piece in range(5):
        points.filter(F.col("point_id") % 5 == piece).coalesce(1).write.mode("append").parquet(str(source))
        if piece in (2, 4):
            run()
    assert table(committed(spark, sums), "batch_id", "k", "cnt") == want
    assert Folder(spark, sums).numbers("base") == [2] and Folder(spark, sums).numbers("batch") == [3, 4]
    for name in ("4", ".4.crc"):  # the last batch's completion is forgotten: a restart runs it again
        (state / "commits" / name).unlink(missing_ok=True)
    run()
    got = {r.k: (r.sums, r.cnt) for r in committed(spark, sums).collect()}
    assert [(0, k, got[k][1]) for k in range(4)] == want
    label = ((x[:, None] - x[None, :4]) ** 2).sum(-1).argmin(1)
    assert all(np.allclose(got[k][0], x[label == k].sum(0)) for k in range(4))
