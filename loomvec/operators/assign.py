"""Nearest-centroid assignment.

``expression``: the centroids of a batch are packed into one row and broadcast
to the points, which take the least (distance, k) of an array: a projection
after a broadcast join, no shuffle. ``arrow``: centroids go to the workers in
blocks, and a blocked matrix product keeps a running best. ``file``: the same
kernel, with centroids in files that workers map into memory (``mapped.py``), so
that points are scanned once however many there are; ``arrow`` becomes ``file``
above BLOCK_BYTES wherever workers can open the shared folder. ``auto`` takes the
kernel unless the centroids are few. All give the lowest k on ties. None
ever holds the point-by-centroid matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packed import is_packed
from ..functions.vectors import checked, clamped_distance, dot, raw_distance, sq_norm
from ..plans.scratch import keep
from .kernel import distinct, matrix, nearest
from .mapped import assign_mapped, reachable, write_centroids

LABELS = "batch_id int, point_id long, cluster_id int"
#: Largest centroid table that is broadcast, or sent to the workers at once.
BLOCK_BYTES = 32 << 20


class Facts(NamedTuple):
    """Length of the centroids, how many there are, the highest number, and the least and most of a batch."""

    dims: int
    n: int
    last: int
    fewest: int
    most: int


def facts(centroids: DataFrame) -> Facts:
    """One job: centroids must be one table of equal, complete vectors with ids 0..K-1 in each batch."""
    seen = centroids.groupBy("batch_id").agg(
        F.min(F.size("c")).alias("least"), F.max(F.size("c")).alias("most"), F.count(F.when(F.col("c").isNull() | F.exists("c", lambda v: v.isNull()), 1)).alias("broken"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("ids"), F.min("k").alias("first"), F.max("k").alias("last"),
    )
    odd = (F.col("n") != F.col("ids")) | (F.col("first") != 0) | (F.col("last") != F.col("n") - 1)
    s = seen.agg(
        F.min("least").alias("least"), F.max("most").alias("most"), F.sum("broken").alias("broken"), F.max(odd).alias("odd"),
        F.sum("n").alias("n"), F.max("last").alias("last"), F.min("n").alias("fewest"), F.max("n").alias("many"),
    ).first()
    if s.least is None or s.broken or s.least != s.most or s.odd:
        raise ValueError("centroids must be vectors of one length without nulls, numbered 0..K-1 in each batch")
    return Facts(s.least, s.n, s.last, s.fewest, s.many)


def rejected(points: DataFrame, dims: int) -> DataFrame:
    """One row: points in all, and those whose vector is null, of another length, or has a null component."""
    x, there, short = F.col("x"), F.col("x").isNotNull(), is_packed(points, "x")
    size = (F.octet_length("x") - 1) / 2 if short else F.size("x")
    hole = F.lit(False) if short else F.exists(x, lambda v: v.isNull())
    count = lambda c: F.count(F.when(c, 1))
    return points.agg(F.count(F.lit(1)).alias("n_points"), count(x.isNull()).alias("n_null"), count(there & (size != dims)).alias("n_length"), count(there & (size == dims) & hole).alias("n_incomplete"))


def validate(points: DataFrame, dims: int) -> None:
    """Fail on null, ragged or incomplete vectors: one scan, one row back."""
    found = rejected(points, dims).first()
    if found.n_null or found.n_length or found.n_incomplete:
        raise ValueError(f"a vector is null, has a null component, or is not of length {dims}")


def _with_norm(centroids: DataFrame) -> DataFrame:
    """Centroids with ``c_sq``: as given, computed where it is missing."""
    own = sq_norm(F.col("c"))
    return centroids.select("batch_id", "k", "c", (F.coalesce("c_sq", own) if "c_sq" in centroids.columns else own).alias("c_sq"))


Block = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def packed_block(which: np.ndarray, names: np.ndarray, c: np.ndarray, c_sq: np.ndarray) -> Block:
    """Batch to (numbers, vectors, norms); of equal centroids of a batch only the lowest is sent."""
    out = {}
    for b in np.unique(which).tolist():
        rows = np.flatnonzero(which == b)
        rows = rows[distinct(c[rows], c_sq[rows])]
        out[b] = names[rows].astype(np.int32), c[rows], c_sq[rows]
    return out


def _step(seen: Facts, block_bytes: int) -> int:
    """Numbers whose centroids, over all batches, are about block_bytes."""
    return max(1, int(block_bytes / (8 * (seen.dims + 2)) * (seen.last + 1) / seen.n))


def _blocks(centroids: DataFrame, seen: Facts) -> Iterator[Block]:
    """Blocks of k, about BLOCK_BYTES at once."""
    table, dims, step = _with_norm(centroids), seen.dims, _step(seen, BLOCK_BYTES)
    for first in range(0, seen.last + 1, step):
        rows = table.filter((F.col("k") >= first) & (F.col("k") < first + step)).orderBy("batch_id", "k").toArrow()
        batch = rows.column("batch_id").to_numpy()
        c = matrix(rows.column("c"), dims) if len(rows) else np.zeros((0, dims))
        yield packed_block(batch, rows.column("k").to_numpy(), c, rows.column("c_sq").to_numpy())


def _by_kernel(points: DataFrame, centroids: DataFrame, seen: Facts, clamp: bool) -> DataFrame:
    dims = seen.dims
    out = points.select("batch_id", "point_id", "x", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("cluster_id"))
    names = out.columns

    def step(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                which = batch.column("batch_id").to_numpy(zero_copy_only=False)
                x = matrix(batch.column("x"), dims)
                best = batch.column("distance").to_numpy(zero_copy_only=False).copy()
                best[np.isnan(best)] = np.inf
                label = np.nan_to_num(batch.column("cluster_id").to_numpy(zero_copy_only=False)).astype(np.int32)
                known = np.zeros(len(x), bool)
                for b, (numbers, c, c_sq) in block.items():
                    rows = np.flatnonzero(which == b)
                    known[rows] = True
                    if len(rows):
                        best[rows], label[rows] = nearest(x[rows], c, c_sq, clamp, best[rows], label[rows], numbers)
                mask = ~known & np.asarray(batch.column("cluster_id").is_null())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(best), pa.array(label, pa.int32(), mask=mask)], names=names)

        return run

    for number, block in enumerate(_blocks(centroids, seen)):
        # one block at a time on the driver and in a plan: the running best is written before the next block is read
        out = (keep(out, "nearest") if number else out).mapInArrow(step(block), out.schema)
    return out.filter(F.col("cluster_id").isNotNull())


def packed(centroids: DataFrame) -> DataFrame:
    """One row a batch: its centroids, norms included, ordered by k."""
    return _with_norm(centroids).groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("k", "c", "c_sq"))).alias("cs"))


def small(centroids: DataFrame, seen: Facts) -> DataFrame:
    """The packed centroids, to be broadcast if they fit BLOCK_BYTES; else Spark joins them as it finds best."""
    rows = packed(centroids)
    return F.broadcast(rows) if seen.n * (seen.dims + 2) * 8 <= BLOCK_BYTES else rows


def _by_expression(points: DataFrame, centroids: DataFrame, seen: Facts, clamp: bool) -> DataFrame:
    joined = points.join(small(centroids, seen), "batch_id").withColumn("x", checked(F.col("x"), seen.dims))
    joined = joined.withColumn("x_sq", sq_norm(F.col("x")) if clamp else F.lit(0.0))

    def candidate(s):
        product = dot(F.col("x"), s["c"])
        d = clamped_distance(F.col("x_sq"), s["c_sq"], product) if clamp else raw_distance(s["c_sq"], product)
        return F.struct(d.alias("d"), s["k"].alias("k"))

    best = F.array_min(F.transform("cs", candidate))
    return joined.withColumn("best", best).select("batch_id", "point_id", "x", F.col("best.d").alias("distance"), F.col("best.k").alias("cluster_id"))


def assign(points: DataFrame, centroids: DataFrame, clamp: bool = True, strategy: str = "auto", with_points: bool = False, block_bytes: int | None = None) -> DataFrame:
    """Label of every point whose batch has centroids; with_points keeps ``x`` and adds the least ``distance``.

    Packed points (``functions/packed.py``) go to the kernel. ``block_bytes`` is the size of a file of centroids (BLOCK_BYTES).
    """
    seen = facts(centroids)
    large = seen.n * seen.dims * 8 > BLOCK_BYTES
    if strategy != "file" and is_packed(points, "x"):
        strategy = "arrow"
    if strategy == "auto":
        strategy = "expression" if seen.n * seen.dims <= 64 else "arrow"
    if large and strategy in ("arrow", "expression"):
        strategy = "file" if reachable(points.sparkSession) else "arrow"
    if strategy == "file":
        files = write_centroids(_with_norm(centroids), seen.dims, _step(seen, block_bytes or BLOCK_BYTES))
        return assign_mapped(points, files, clamp, with_points)
    out = {"arrow": _by_kernel, "expression": _by_expression}[strategy](points, centroids, seen, clamp)
    return out if with_points else out.select("batch_id", "point_id", "cluster_id")


def cross_products(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Every point's product with every centroid of its batch, and the clamped squared distance."""
    each = points.join(small(centroids, facts(centroids)), "batch_id").select("batch_id", "point_id", "x", F.explode("cs").alias("s"))
    product = dot(F.col("x"), F.col("s.c"))
    each = each.select("batch_id", "point_id", F.col("s.k").alias("k"), product.alias("product"), sq_norm(F.col("x")).alias("x_sq"), F.col("s.c_sq").alias("c_sq"))
    return each.withColumn("distance", clamped_distance(F.col("x_sq"), F.col("c_sq"), F.col("product")))


def brute_force(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """Reference assignment: all distances, then the least (distance, k) of each point."""
    best = cross_products(points, centroids).groupBy("batch_id", "point_id").agg(F.min(F.struct("distance", "k")).alias("best"))
    return best.select("batch_id", "point_id", F.col("best.k").alias("cluster_id"))
