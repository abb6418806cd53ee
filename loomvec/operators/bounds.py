"""Distance bounds that prove a label unchanged, so that the point's products with all centroids are skipped.

An anchor is a set of centroids together with a table of the points in which each
point has its label against them, an upper bound of its distance to that
centroid and a lower bound of its distance to every other one. While centroids
have moved from the anchor's by m (of its own) and by at most M (of any other),
the label stands as long as ``upper + m < lower - M``. All other points are
multiplied as ever, so labels are those of the plain iteration: bounds carry the
rounding error of the product, and near ties fail the test.

The table is written in the scan that also adds the points up by label, as rows
of the same file, so an anchor costs that write and no shuffle or join. It
serves until more than half of the points had to be multiplied while the largest
move has at least halved since; then the next iteration writes a new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.packed import is_packed
from ..plans.scratch import keep
from .kernel import TILE, matrix, nearest, squares
from .update import PARTIAL, Partials

#: Relative rounding error of a squared distance by products.
ERROR = 1e-12
#: Cluster numbers of the two rows that count skipped points and all points.
SKIPPED, SEEN = -1, -2
Held = dict[int, np.ndarray]


def _second(x: np.ndarray, x_sq: np.ndarray, c: np.ndarray, c_sq: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Least squared distance to a centroid other than the label's."""
    out = np.full(len(x), np.inf)
    height = max(1, TILE // max(1, len(c)))
    with np.errstate(invalid="ignore", over="ignore"):
        for a in range(0, len(x), height):
            rows = slice(a, a + height)
            d = c_sq[None] - 2.0 * (x[rows] @ c.T) + x_sq[rows, None]
            d[np.arange(len(d)), label[rows]] = np.inf
            low = np.fmin.reduce(d, axis=1)
            out[rows] = np.where(np.isnan(d).any(axis=1), 0.0, low)  # a NaN distance proves nothing
    return out


def bounds_of(x: np.ndarray, c: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bound of each point's distance to its centroid, lower bound of that to any other; NaN where nothing is known."""
    x_sq, c_sq = squares(x), squares(c)
    with np.errstate(invalid="ignore", over="ignore"):
        error = ERROR * (x_sq + c_sq.max(initial=0.0) + 1.0)
        own = c_sq[label] - 2.0 * (x * c[label]).sum(axis=1) + x_sq
        return np.sqrt(np.maximum(own, 0.0) + error), np.sqrt(np.maximum(_second(x, x_sq, c, c_sq, label) - error, 0.0))


def unchanged(x: np.ndarray, label: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Points whose label against ``before`` is proved to be that against ``now``; anything not finite proves nothing."""
    with np.errstate(invalid="ignore", over="ignore"):
        moved = np.sqrt(squares(now - before)) * (1 + ERROR)
        far = int(np.argmax(np.where(np.isnan(moved), np.inf, moved))) if len(moved) else 0
        rest = np.delete(moved, far)
        other = np.where(label == far, rest.max(initial=0.0), moved[far])
        high, low = upper + moved[label], lower - other
        return (low > 0) & (high * high + 2 * ERROR * (squares(x) + squares(now).max(initial=0.0) + 1.0) < low * low)


def _out(k: np.ndarray, b: int, n: int, dims: int) -> tuple:
    return np.full(len(k), b), k, np.zeros((len(k), dims)), np.full(len(k), n)


def anchored(points: DataFrame, held: Held, dims: int, block, clamp: bool) -> DataFrame:
    """One scan, written: every point with label and bounds, and between them the rows of its task's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Partials(max(map(len, held.values())))
        for batch in batches:
            if not batch.num_rows:
                continue
            which = batch.column("batch_id").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("x"), dims)
            label, bound = np.full(len(x), -1, np.int32), np.full((2, len(x)), np.nan)
            for b, (numbers, c, c_sq) in block.items():
                rows = np.flatnonzero(which == b)
                if len(rows):
                    label[rows] = nearest(x[rows], c, c_sq, clamp, names=numbers)[1]
                    bound[:, rows] = bounds_of(x[rows], held[b], label[rows])
            yield from map(sums, found.add(which, x, label))
            none = pa.nulls(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("batch_id"), batch.column("x"), pa.array(label), pa.array(bound[0]), pa.array(bound[1]), none.cast(pa.int32()), none.cast(pa.list_(pa.float64())), none.cast(pa.int64())], names=names)
        yield sums(found.rows())

    def sums(rows: pa.RecordBatch) -> pa.RecordBatch:
        none = pa.nulls(rows.num_rows)
        return pa.RecordBatch.from_arrays([rows.column("batch_id"), none.cast(x_type), none.cast(pa.int32()), none.cast(pa.float64()), none.cast(pa.float64()), *rows.columns[1:]], names=names)

    short = is_packed(points, "x")
    x_type = pa.binary() if short else pa.list_(pa.float64())
    names = ["batch_id", "x", "cluster_id", "upper", "lower", "k", "sums", "cnt"]
    schema = f"batch_id int, x {'binary' if short else 'array<double>'}, cluster_id int, upper double, lower double, k int, sums array<double>, cnt long"
    return keep(points.select("batch_id", "x").mapInArrow(run, schema), "anchor")


def anchor_sums(anchor: DataFrame) -> DataFrame:
    """The sums that the anchor's scan made; the points' columns are not read."""
    return anchor.select("batch_id", "k", "sums", "cnt").filter(F.col("k").isNotNull())


def bounded_sums(anchor: DataFrame, at: Held, held: Held, dims: int, block, clamp: bool) -> DataFrame:
    """Sums of the points by their label against ``held``: those whose bounds prove the label they have at ``at`` are not multiplied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Partials(max(map(len, held.values())))
        count = {b: np.zeros(2, np.int64) for b in held}
        for batch in batches:
            if not batch.num_rows:
                continue
            which = batch.column("batch_id").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("x"), dims)
            label, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster_id", "upper", "lower"))
            for b, (numbers, c, c_sq) in block.items():
                rows = np.flatnonzero(which == b)
                if len(rows):
                    sure = unchanged(x[rows], label[rows], upper[rows], lower[rows], at[b], held[b])
                    todo = rows[~sure]
                    if len(todo):
                        label[todo] = nearest(x[todo], c, c_sq, clamp, names=numbers)[1]
                    count[b] += sure.sum(), len(rows)
            yield from found.add(which, x, label)
        for b, (skipped, seen) in count.items():
            found.held += [_out(np.array([SKIPPED]), b, skipped, dims), _out(np.array([SEEN]), b, seen, dims)]
        yield found.rows()

    rows = anchor.filter(F.col("k").isNull()).select("batch_id", "x", "cluster_id", "upper", "lower")
    return rows.mapInArrow(run, PARTIAL)
