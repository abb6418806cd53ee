"""Centroid sets too large to be sent whole: files of centroids that workers map into memory.

Spark writes the centroids as one Arrow file for each range of numbers, in the
folder that the driver and all executors share. A task takes some POINT_BYTES of
its points at once and carries their running best over the files in ascending
order, so points are scanned once whatever the number of centroids, and neither
a worker nor the driver ever holds more than one file. Workers of a machine share
the pages of a mapped file; from a store that cannot be mapped a file is read
where it is needed, which is little beside the products it is needed for.

A file has a name of its own for each attempt, and only finished attempts are
named in the list that the driver keeps: repeated tasks do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import attach, fresh, shared_dir
from .kernel import distinct, matrix, nearest

#: Points that meet the centroids at once, as doubles.
POINT_BYTES = 32 << 20


class CentroidFiles(NamedTuple):
    """A folder, its files by ascending centroid numbers, and the centroids' length."""

    folder: str
    names: list[str]
    dims: int


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def reachable(spark: SparkSession) -> bool:
    """Whether workers can open the shared folder themselves; some stores are read by Spark only."""
    try:
        _place(shared_dir(spark))
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def _schema(dims: int) -> pa.Schema:
    return pa.schema([("batch_id", pa.int32()), ("k", pa.int32()), ("c_sq", pa.float64()), ("c", pa.list_(pa.float64(), dims))])


def write_centroids(centroids: DataFrame, dims: int, step: int) -> CentroidFiles:
    """Files of ``step`` numbers each from (batch_id, k, c, c_sq); of equal centroids of a batch and file only the lowest is written."""
    folder = fresh(centroids.sparkSession, "centroid-files")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("batch_id", "ascending"), ("k", "ascending")])
        which, k, c_sq = (table.column(n).to_numpy() for n in ("batch_id", "k", "c_sq"))
        c = matrix(table.column("c"), dims)
        begin = np.flatnonzero(np.diff(which, prepend=which[0] - 1))
        rows = np.concatenate([a + distinct(c[a:b], c_sq[a:b]) for a, b in zip(begin, np.append(begin[1:], len(which)))])
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(c[rows].ravel()), dims)
        out = pa.RecordBatch.from_arrays([pa.array(which[rows], pa.int32()), pa.array(k[rows], pa.int32()), pa.array(c_sq[rows]), vectors], schema=_schema(dims))
        files, path = _place(folder)
        files.create_dir(path, recursive=True)
        block = table.column("block")[0].as_py()
        name = f"{block:08d}-{uuid.uuid4().hex}.arrow"
        with files.open_output_stream(f"{path}/{name}") as sink, pa.ipc.new_file(sink, out.schema) as writer:
            writer.write_batch(out)
        return pa.table({"block": pa.array([block], pa.int32()), "name": [name]})

    placed = centroids.select("batch_id", "k", "c", "c_sq", F.floor(F.col("k") / step).cast("int").alias("block"))
    found = placed.groupBy("block").applyInArrow(run, "block int, name string").toArrow().sort_by("block")
    return CentroidFiles(folder, found.column("name").to_pylist(), dims)


def _read(held: CentroidFiles, name: str) -> pa.RecordBatch:
    from pyarrow import fs

    files, path = _place(held.folder)
    local = isinstance(files, fs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(f"{path}/{name}") if local else files.open_input_file(f"{path}/{name}")).get_batch(0)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``rows`` rows or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def assign_mapped(points: DataFrame, held: CentroidFiles, clamp: bool, with_points: bool) -> DataFrame:
    """(batch_id, point_id, cluster_id), or with ``x`` and ``distance``, of the points whose batch has centroids; the files go when the result is released."""
    names = ["batch_id", "point_id", *(["x", "distance"] if with_points else []), "cluster_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, max(1, POINT_BYTES // (8 * held.dims))):
            which = batch.column("batch_id").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("x"), held.dims)
            mine = {b: np.flatnonzero(which == b) for b in np.unique(which).tolist()}
            best, label = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
            known = np.zeros(len(x), bool)
            for name in held.names:
                block = _read(held, name)
                batch_of, k, c_sq = (block.column(n).to_numpy() for n in ("batch_id", "k", "c_sq"))
                c = block.column("c").flatten().to_numpy().reshape(len(k), held.dims)
                for b, rows in mine.items():
                    span = slice(*np.searchsorted(batch_of, [b, b + 1]))
                    if span.start < span.stop:
                        known[rows] = True
                        best[rows], label[rows] = nearest(x[rows], c[span], c_sq[span], clamp, best[rows], label[rows], k[span])
            found = {n: batch.column(n) for n in batch.schema.names} | {"distance": pa.array(best), "cluster_id": pa.array(label, pa.int32())}
            yield pa.RecordBatch.from_arrays([found[n] for n in names], names=names).filter(pa.array(known))

    kinds = dict(points.dtypes) | {"distance": "double", "cluster_id": "int"}
    out = points.select("batch_id", "point_id", "x").mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))
    return attach(out, held.folder)
