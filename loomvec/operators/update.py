"""Grouped sums and counts of points by label, and new centroids from them.

accumulators: ``batch_id INT, k INT, sums ARRAY<DOUBLE>, cnt BIGINT``, dense over
0..K-1 for every batch. A task adds up all its points first, so the shuffle
carries one array for each task and cluster, whatever the number of points.
Where there are fewer clusters than shuffle partitions, the arrays of a cluster
are first dealt by their task too, so that a cluster's arrays are added by
several tasks, and the second shuffle carries one array for each of those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import rounded
from ..plans.scratch import width
from .kernel import matrix, partial_sums, run_sums

PARTIAL = "batch_id int, k int, sums array<double>, cnt long"
#: Bytes of sums that a task holds before it passes them on.
HELD_BYTES = 64 << 20


def _added(b: np.ndarray, k: np.ndarray, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal (b, k) added up, in the order of the rows."""
    if not len(b):
        return b, k, sums, n
    begin = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (k[1:] != k[:-1])))
    return b[begin], k[begin], np.add.reduceat(sums, begin, axis=0), np.add.reduceat(n, begin)


def _rows(b: np.ndarray, k: np.ndarray, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * sums.shape[1], pa.array(np.ascontiguousarray(sums, np.float64).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), lists, pa.array(n, pa.int64())], names=["batch_id", "k", "sums", "cnt"])


class Partials:
    """Sums and counts of one task, by batch and cluster: arrays of arrivals, added up whenever they hold HELD_BYTES."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, which: np.ndarray, x: np.ndarray, label: np.ndarray, sums: Callable = partial_sums) -> Iterator[pa.RecordBatch]:
        """Take the points of an Arrow batch; rows come out only when HELD_BYTES are full even of added ones."""
        for b in np.unique(which).tolist():
            rows = which == b
            names, total, n = sums(x[rows], label[rows], self.k)
            self.held.append((np.full(len(names), b), names.astype(np.int64), total, n))
            self.size += total.nbytes
        if self.size > HELD_BYTES:
            self._add_up()
            if self.size > HELD_BYTES // 2:
                yield self.rows()

    def _add_up(self) -> None:
        b, k, sums, n = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((k, b))
        self.held = [_added(b[order], k[order], sums[order], n[order])]
        self.size = self.held[0][2].nbytes

    def rows(self) -> pa.RecordBatch:
        if not self.held:
            return _rows(np.zeros(0, int), np.zeros(0, int), np.zeros((0, 1)), np.zeros(0, int))
        self._add_up()
        (found,), self.held, self.size = self.held, [], 0
        return _rows(*found)


def _partials(labelled: DataFrame, k: int, dims: int, sums: Callable = partial_sums) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Partials(k)
        for batch in batches:
            if batch.num_rows:
                label = batch.column("cluster_id").fill_null(-1).to_numpy(zero_copy_only=False)
                yield from held.add(batch.column("batch_id").to_numpy(zero_copy_only=False), matrix(batch.column("x"), dims), label, sums)
        yield held.rows()

    return labelled.select("batch_id", "x", F.col("cluster_id").cast("int").alias("cluster_id")).mapInArrow(run, PARTIAL)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (batch, k), each such group added up in its order; the last group of an Arrow batch waits for the next one."""
    wait: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sums = batch.column("sums")
        dims = len(sums.flatten()) // batch.num_rows
        now = [batch.column("batch_id").to_numpy(), batch.column("k").to_numpy(), matrix(sums, dims), batch.column("cnt").to_numpy()]
        b, k, x, n = now if wait is None else (np.concatenate(c) for c in zip(wait, now))
        b, k, x, n = _added(b, k, x, n)
        wait = b[-1:], k[-1:], x[-1:], n[-1:]
        yield _rows(b[:-1], k[:-1], x[:-1], n[:-1])
    if wait is not None:
        yield _rows(*wait)


def merge(partials: DataFrame, groups: int | None = None) -> DataFrame:
    """Add accumulators of equal (batch, k): arrays are shuffled and added, in the order of the partitions they come from.

    ``groups`` is the number of (batch, k) if it is known. With fewer of them than shuffle partitions a first level adds the
    arrays of each (batch, k) in as many parts as fill the partitions, dealt by the task that they come from.
    """
    placed = partials.select("batch_id", "k", "sums", F.col("cnt").cast("long").alias("cnt"), F.spark_partition_id().alias("part"))
    salts = width(partials.sparkSession) // max(1, groups or 1)
    if salts > 1:
        salted = placed.withColumn("salt", F.col("part") % salts)
        first = salted.repartition("batch_id", "k", "salt").sortWithinPartitions("salt", "batch_id", "k", "part", "cnt")
        # a task may have several salts of a group: each is a run of its own
        placed = first.select("batch_id", "k", "sums", "cnt").mapInArrow(_merged, PARTIAL).withColumn("part", F.spark_partition_id())
    ordered = placed.repartition("batch_id", "k").sortWithinPartitions("batch_id", "k", "part", "cnt").drop("part")
    return ordered.mapInArrow(_merged, PARTIAL)


def dense(found: DataFrame, batches: DataFrame, k: int, dims: int) -> DataFrame:
    """A row for each of 0..k-1 in every batch; zeros where nothing was found."""
    slots = batches.select("batch_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    zeros = F.array_repeat(F.lit(0.0), dims)
    return slots.join(found, ["batch_id", "k"], "left").select("batch_id", "k", F.coalesce("sums", zeros).alias("sums"), F.coalesce("cnt", F.lit(0).cast("long")).alias("cnt"))


def centroid_update(points: DataFrame, labels: DataFrame, k: int, dims: int) -> DataFrame:
    """Dense accumulators of the points by their labels; labels outside 0..k-1 are left out."""
    labelled = points.join(labels, ["batch_id", "point_id"])
    return dense(merge(_partials(labelled, k, dims), k), points, k, dims)


def centroid_update_labelled(labelled: DataFrame, k: int, dims: int) -> DataFrame:
    """As centroid_update, for a table that already has both ``x`` and ``cluster_id``: no join."""
    return dense(merge(_partials(labelled, k, dims), k), labelled, k, dims)


def sums_of_labelled(labelled: DataFrame, k: int, dims: int) -> DataFrame:
    """As centroid_update_labelled, of the clusters that have points: nothing but one scan of the labelled table."""
    return merge(_partials(labelled, k, dims), k)


def gather(points: DataFrame, order: DataFrame, numbered: DataFrame) -> DataFrame:
    """Points in the order of a permutation: row ``position`` is the point whose number is ``perm[position]``.

    ``order`` has batch_id, position and perm; ``numbered`` has each point's batch_id, point_id and number ``at``.
    """
    named = numbered.select("batch_id", "point_id", F.col("at").alias("perm"))
    return points.join(named, ["batch_id", "point_id"]).join(order, ["batch_id", "perm"])


def centroid_update_sorted(gathered: DataFrame, k: int, dims: int) -> DataFrame:
    """As centroid_update, for gathered points with ``position`` in label order: runs of one label are added as they lie.

    Positions are range-partitioned, so a cluster of many points is split among tasks and each adds one run.
    """
    lying = gathered.repartitionByRange("batch_id", "position").sortWithinPartitions("batch_id", "position")
    return dense(merge(_partials(lying, k, dims, run_sums), k), gathered, k, dims)


def accumulate(new: DataFrame, prior: DataFrame) -> DataFrame:
    """Add two accumulator tables."""
    columns = ["batch_id", "k", "sums", "cnt"]
    return merge(new.select(columns).unionByName(prior.select(columns)))


def centroid_finalize(accumulators: DataFrame, old: DataFrame, precision: str = "double") -> DataFrame:
    """Mean of each cluster, rounded to the precision; a cluster without points keeps its old centroid."""
    joined = old.select("batch_id", "k", "c").join(accumulators, ["batch_id", "k"], "left")
    mean = rounded(F.transform("sums", lambda s: s / F.col("cnt")), precision)
    return joined.select("batch_id", "k", F.when(F.col("cnt") > 0, mean).otherwise(F.col("c")).alias("c"))


def long_form(centroids: DataFrame, vector: str = "c") -> DataFrame:
    """One row for each component."""
    others = [c for c in centroids.columns if c != vector]
    return centroids.select(*others, F.posexplode(vector).alias("dim", "value"))
