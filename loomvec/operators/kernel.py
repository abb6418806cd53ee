"""Array kernels of assignment and partial sums, run on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.packed import decode

#: Distances that are held at once: few enough to stay in a core's cache.
TILE = 1 << 18


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column, or one of packed vectors, as rows x dims; fails on nulls and on vectors of another length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        if column.null_count or (np.diff(offsets) != 1 + 2 * dims).any():
            raise ValueError(f"a vector is null, has a null component, or is not of length {dims}")
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        return decode(data.reshape(len(column), 1 + 2 * dims))
    values = column.flatten()
    if column.null_count or values.null_count or len(values) != len(column) * dims or (np.diff(column.offsets.to_numpy()) != dims).any():
        raise ValueError(f"a vector is null, has a null component, or is not of length {dims}")
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), dims)


def squares(x: np.ndarray) -> np.ndarray:
    """Squared norm of each row, summed in the one order that all decisions use."""
    return (x * x).sum(axis=1)


def distinct(c: np.ndarray, c_sq: np.ndarray) -> np.ndarray:
    """The first of each group of equal centroids, ascending: no other one ever wins."""
    _, first = np.unique(np.column_stack([c, c_sq]), axis=0, return_index=True)
    return np.sort(first)


def _exact(x: np.ndarray, x_sq: np.ndarray, c: np.ndarray, c_sq: np.ndarray, row: np.ndarray, k: np.ndarray, clamp: bool) -> np.ndarray:
    """Distances of pairs (row, k), each product summed in one fixed order."""
    out = np.empty(len(row))
    step = max(1, TILE // max(1, x.shape[1]))
    for a in range(0, len(row), step):
        r, q = row[a : a + step], k[a : a + step]
        d = c_sq[q] - 2.0 * (x[r] * c[q]).sum(axis=1)
        if clamp:
            d += x_sq[r]
            out[a : a + step] = np.where(d > 0, d, 0.0)
        else:
            out[a : a + step] = np.where(np.isnan(d), np.inf, d)
    return out


def nearest(x: np.ndarray, c: np.ndarray, c_sq: np.ndarray, clamp: bool, best: np.ndarray | None = None, label: np.ndarray | None = None, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Least distance and its lowest centroid, block by block with a running best; ``names`` are the centroids' numbers, ascending.

    The product is a matrix multiplication. The least of a block, and all that are within its rounding error, are decided again by
    sums in one fixed order, and only those sums are compared between blocks: equal centroids tie exactly and the lowest wins.
    """
    n = len(x)
    best = np.full(n, np.inf) if best is None else best.copy()
    label = np.zeros(n, np.int32) if label is None else label.copy()
    names = np.arange(len(c), dtype=np.int32) if names is None else names
    width = max(1, min(len(c), 4096))
    height = max(1, TILE // width)
    with np.errstate(invalid="ignore", over="ignore"):
        x_sq, scaled, top = squares(x), c * -2.0, np.abs(c_sq[np.isfinite(c_sq)]).max(initial=0.0)
        for a in range(0, n, height):
            rows = slice(a, a + height)
            each = np.arange(len(x[rows]))
            for b in range(0, len(c), width):
                block, block_sq = c[b : b + width], c_sq[b : b + width]
                d = x[rows] @ scaled[b : b + width].T
                d += block_sq
                at = d.argmin(axis=1)
                low = d[each, at]
                if np.isfinite(low).all():
                    # a clamped distance is 0 only within this error, so ties of clamped ones are among the near
                    near = d <= (low + 1e-12 * (np.abs(low) + 2 * x_sq[rows] + 1.0 + top))[:, None]
                else:
                    at, near = _odd(d, x_sq[rows], top, clamp)
                if np.count_nonzero(near) == len(each):
                    low = _exact(x[rows], x_sq[rows], block, block_sq, each, at, clamp)
                else:
                    r, k = np.nonzero(near)
                    exact = _exact(x[rows], x_sq[rows], block, block_sq, r, k, clamp)
                    low = np.minimum.reduceat(exact, np.searchsorted(r, each))
                    won = np.flatnonzero(exact == low[r])
                    at = k[won[np.searchsorted(r[won], each)]]
                better = low < best[rows]
                best[rows] = np.where(better, low, best[rows])
                label[rows] = np.where(better, names[b + at], label[rows])
    return best, label


def _odd(d: np.ndarray, x_sq: np.ndarray, top: float, clamp: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least entry and those near it where some are not finite: NaN counts as 0 if clamped, else it never wins."""
    if clamp:
        d = d + x_sq[:, None]
        d = np.where(d > 0, d, 0.0)
    else:
        d = np.where(np.isnan(d), np.inf, d)
    at = d.argmin(axis=1)
    low = d[np.arange(len(d)), at]
    slack = np.where(np.isfinite(low), 1e-12 * (np.abs(low) + x_sq + 1.0 + top), -np.inf)
    near = d <= (low + slack)[:, None]
    near[np.arange(len(d)), at] = True
    return at, near


def partial_sums(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters that occur (0 <= label < k), their sums and counts."""
    inside = (label >= 0) & (label < k)
    x, label = x[inside], label[inside]
    order = np.argsort(label, kind="stable")
    names, begin = np.unique(label[order], return_index=True)
    if not len(names):
        return names, np.zeros((0, x.shape[1])), np.zeros(0, np.int64)
    return names, np.add.reduceat(x[order], begin, axis=0), np.diff(np.append(begin, len(order)))


def run_sums(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As partial_sums, for rows that already lie in runs of equal labels; a cluster occurs once a run."""
    inside = (label >= 0) & (label < k)
    x, label = x[inside], label[inside]
    begin = np.flatnonzero(np.diff(label, prepend=-1))
    if not len(begin):
        return label, np.zeros((0, x.shape[1])), np.zeros(0, np.int64)
    return label[begin], np.add.reduceat(x, begin, axis=0), np.diff(np.append(begin, len(label)))
