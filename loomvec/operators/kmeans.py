"""The Lloyd iteration.

Each iteration is one scan: a kernel assigns the points and adds them up over its
task, and one small shuffle adds up the tasks. Centroids are held by the
driver and sent to the workers while they fit ``assign.BLOCK_BYTES``; larger
ones stay in tables, and the same scan maps files of centroids (``mapped.py``),
with a table written for each new set of centroids.

As in the original operator, the labels returned are those against the centroids
before the last update; ``tol <= 0`` runs all iterations; otherwise the run stops
after an iteration whose largest centroid move over all batches is below ``tol``.

With ``bounds`` points whose label is proved unchanged are not multiplied (see
``bounds.py``); labels are the same, and centroids up to the order of sums. With ``log`` each iteration's
centroids are committed to a folder, from which the same call goes on after its
driver was lost (see ``journal.py``).
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.packed import is_packed, unpack
from ..functions.vectors import rounded, to_precision
from ..plans.scratch import discard, keep, release
from ..sources.points import random_rows
from .assign import BLOCK_BYTES, Block, assign, facts, packed_block, validate
from .bounds import SEEN, SKIPPED, Held, anchor_sums, anchored, bounded_sums
from .journal import Journal, load_version, save_version
from .kernel import matrix, nearest, squares
from .update import PARTIAL, Partials, centroid_finalize, merge, sums_of_labelled

log_ = logging.getLogger(__name__)


class Result(NamedTuple):
    """``saved`` has, for each iteration of this call with ``bounds``, the share of points that were not multiplied."""

    labels: DataFrame | None
    centroids: DataFrame
    n_iters: int
    shifts: list[float]
    saved: list[float] = []


def _table(points: DataFrame, held: Held) -> DataFrame:
    rows = [(b, k, [float(v) for v in c]) for b, cs in sorted(held.items()) for k, c in enumerate(cs)]
    return points.sparkSession.createDataFrame(rows, "batch_id int, k int, c array<double>")


def _block(held: Held) -> Block:
    which = np.concatenate([np.full(len(c), b) for b, c in held.items()])
    names = np.concatenate([np.arange(len(c)) for c in held.values()])
    everything = np.concatenate(list(held.values()))
    return packed_block(which, names, everything, squares(everything))


def _plain_sums(points: DataFrame, held: Held, dims: int, block: Block, clamp: bool) -> DataFrame:
    """One scan: each task's sums of the points by their nearest centroid."""
    most = max(map(len, held.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Partials(most)
        for batch in batches:
            if batch.num_rows:
                which = batch.column("batch_id").to_numpy(zero_copy_only=False)
                x = matrix(batch.column("x"), dims)
                label = np.full(len(x), -1, np.int32)
                for b, (numbers, c, c_sq) in block.items():
                    rows = np.flatnonzero(which == b)
                    if len(rows):
                        label[rows] = nearest(x[rows], c, c_sq, clamp, names=numbers)[1]
                yield from found.add(which, x, label)
        yield found.rows()

    return points.select("batch_id", "x").mapInArrow(run, PARTIAL)


def _next(sums: DataFrame, held: Held, dims: int, precision: str) -> tuple[Held, float]:
    """New centroids from the tasks' sums, and the share of points whose products were skipped."""
    found = merge(sums, sum(map(len, held.values()))).toArrow()
    b, k, n = (found.column(c).to_numpy() for c in ("batch_id", "k", "cnt"))
    total = matrix(found.column("sums"), dims) if len(found) else np.zeros((0, dims))
    new = {b: c.copy() for b, c in held.items()}
    for batch in new:
        mine = np.flatnonzero((b == batch) & (k >= 0))
        new[batch][k[mine]] = to_precision(total[mine] / n[mine, None], precision)
    return new, float(n[k == SKIPPED].sum()) / max(1, int(n[k == SEEN].sum()))


class _Bounds:
    """The anchor that the iterations share, and when the next one is due."""

    def __init__(self):
        self.table: DataFrame | None = None
        self.at: Held = {}
        self.move, self.saved, self.new = np.inf, 1.0, False

    def sums(self, points: DataFrame, held: Held, dims: int, block: Block, clamp: bool, move: float) -> DataFrame:
        self.new = self.table is None or (self.saved < 0.5 and move <= self.move / 2)
        if self.new:
            self.drop()
            self.table, self.at, self.move = anchored(points, held, dims, block, clamp), held, move
            return anchor_sums(self.table)
        return bounded_sums(self.table, self.at, held, dims, block, clamp)

    def drop(self) -> None:
        if self.table is not None:
            discard(self.table)
            self.table = None


def _move(old: Held, new: Held) -> float:
    return max(float(np.sqrt(((new[b] - old[b]) ** 2).sum(axis=1)).max()) for b in old)


def kmeans(points: DataFrame, n_clusters: int, max_iters: int = 100, tol: float = 0.0, init: DataFrame | None = None, verbose: bool = False, seed: int = 0, clamp: bool = True, check: bool = True, persist: bool = False, precision: str = "double", bounds: bool = False, log: str | None = None) -> Result:
    """Labels, centroids, the number of iterations, and the moves if ``tol`` or ``verbose`` asked for them.

    ``init`` has n_clusters centroids in each batch; without it, points are drawn with replacement by ``seed``. Labels are null
    if ``max_iters`` is 0. Vectors that are null, ragged or incomplete fail: the kernel refuses them as it scans, and ``check``
    only says which kind they are. ``persist`` caches the points for the iterations.
    ``precision`` (double, single, half or bfloat) is that of points, first centroids and each iteration's centroids; sums and
    distances of such numbers are taken in double; packed points stay in their own format. ``bounds`` skips products whose result is known; it has no effect on centroids
    above ``assign.BLOCK_BYTES``. ``log`` names a folder of this run in a file system that a new driver sees too; a folder that
    already has iterations is gone on from, and ``init`` and ``seed`` are then ignored.
    """
    points = _rounded(points, precision)
    journal = Journal(points.sparkSession, log, {"n_clusters": n_clusters, "clamp": clamp, "precision": precision}) if log else None
    done, shifts, centroids, before = journal.last() if journal else (0, [], None, None)
    if centroids is None:
        centroids = init if init is not None else random_rows(points, n_clusters, seed)
        centroids = unpack(centroids, "c") if is_packed(centroids, "c") else centroids
        centroids = keep(centroids.withColumn("c", rounded(F.col("c"), precision)), "centroids")
        before = centroids
        if journal:
            centroids = before = journal.write(0, centroids)
    seen = facts(centroids)
    dims = seen.dims
    if (seen.fewest, seen.most) != (n_clusters, n_clusters):
        raise ValueError(f"every batch needs {n_clusters} centroids")
    if check and done >= max_iters:
        validate(points, dims)
    if persist:
        points = points.persist()
    watched = tol > 0 or verbose
    small = seen.n * dims * 8 <= BLOCK_BYTES
    bounded, saved = _Bounds() if bounds and small else None, []
    held, last = _held(centroids, dims) if small else None, None
    move = np.inf
    stopped = tol > 0 and done > 0 and shifts[-1] < tol
    while done < max_iters and not stopped:
        done += 1
        try:
            if small:
                block = _block(held)
                sums = bounded.sums(points, held, dims, block, clamp, move) if bounded else _plain_sums(points, held, dims, block, clamp)
                new, share = _next(sums, held, dims, precision)
                if bounded:
                    bounded.saved = 1.0 if bounded.new else share
                    saved.append(share)
                last, held, move = held, new, _move(held, new)
            else:
                stale, before = before, centroids
                labelled = assign(points, before, clamp, "arrow", with_points=True)
                centroids = keep(centroid_finalize(sums_of_labelled(labelled, n_clusters, dims), before, precision), "centroids")
                release(labelled)
                if stale is not before:
                    release(stale)
                move = largest_move(before, centroids) if watched or journal else None
        except Exception:
            if check:
                validate(points, dims)
            raise
        if watched or journal:
            shifts.append(move)
        if journal:
            centroids = journal.write(done, _table(points, held) if small else centroids, move)
        if verbose:
            log_.warning("iteration %d: largest move %.6g", done, move)
        stopped = tol > 0 and move < tol
    if bounded:
        bounded.drop()
    if last is not None:
        before, centroids = _table(points, last), _table(points, held)
    if max_iters <= 0:
        labels = points.select("batch_id", "point_id", F.lit(None).cast("int").alias("cluster_id"))
    else:
        labels = assign(points, before, clamp, "arrow")
    return Result(labels, centroids, done, shifts if watched else [], saved)


def _rounded(points: DataFrame, precision: str) -> DataFrame:
    """Points in a shorter format; packed ones are in theirs already."""
    return points if is_packed(points, "x") else points.withColumn("x", rounded(F.col("x"), precision))


def _held(centroids: DataFrame, dims: int) -> Held:
    """Centroids that fit BLOCK_BYTES, by batch."""
    rows = centroids.orderBy("batch_id", "k").toArrow()
    which, values = rows.column("batch_id").to_numpy(), matrix(rows.column("c"), dims)
    return {int(b): values[which == b] for b in np.unique(which)}


def largest_move(old: DataFrame, new: DataFrame) -> float:
    """Largest Euclidean move of a centroid, over all batches."""
    both = old.select("batch_id", "k", F.col("c").alias("o")).join(new.select("batch_id", "k", "c"), ["batch_id", "k"])
    squares = F.aggregate(F.zip_with("c", "o", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return float(both.agg(F.max(F.sqrt(squares)).alias("m")).first().m or 0.0)


class KMeans:
    """fit and predict over the functions above."""

    def __init__(self, n_clusters: int, max_iters: int = 100, tol: float = 0.0, seed: int = 0, clamp: bool = True, precision: str = "double"):
        self.n_clusters, self.max_iters, self.tol, self.seed, self.clamp, self.precision = n_clusters, max_iters, tol, seed, clamp, precision
        self.result: Result | None = None

    def fit(self, points: DataFrame, init: DataFrame | None = None) -> KMeans:
        self.result = kmeans(points, self.n_clusters, self.max_iters, self.tol, init, seed=self.seed, clamp=self.clamp, precision=self.precision)
        return self

    def predict(self, points: DataFrame) -> DataFrame:
        if self.result is None:
            raise ValueError("fit first")
        return assign(_rounded(points, self.precision), self.result.centroids, self.clamp)

    def save(self, folder: str) -> int:
        """Commit the fitted model under a folder, as its next version, and say which that is."""
        if self.result is None:
            raise ValueError("fit first")
        names = ("n_clusters", "max_iters", "tol", "seed", "clamp", "precision")
        return save_version(self.result.centroids, folder, {n: getattr(self, n) for n in names} | {"n_iters": self.result.n_iters})

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int | None = None) -> KMeans:
        """A saved model, the latest unless a version is named; its result has centroids and no labels."""
        centroids, parameters = load_version(spark, folder, version)
        n_iters = parameters.pop("n_iters")
        model = cls(**parameters)
        model.result = Result(None, centroids, n_iters, [])
        return model
