"""Vectors of two bytes a component: one binary value, its format's letter and then the components, little-endian.

``half`` is IEEE binary16, ``bfloat`` the upper half of binary32; both round to
nearest, ties to even, and make values beyond their range infinite. All kernels
read such a column as it is, so a scan moves a quarter of the bytes of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import to_precision

LETTERS = {"half": ord("h"), "bfloat": ord("b")}


def encode(x: np.ndarray, kind: str) -> np.ndarray:
    """Rows of bytes from rows of doubles."""
    with np.errstate(over="ignore"):
        if kind == "half":
            words = to_precision(x, "half").astype("<f2").view("<u2")
        else:
            single = to_precision(x, "bfloat").astype("<f4")  # beyond the range: infinite
            words = (single.view("<u4") >> 16).astype("<u2")
    out = np.empty((len(x), 1 + 2 * x.shape[1]), np.uint8)
    out[:, 0] = LETTERS[kind]
    out[:, 1:] = np.ascontiguousarray(words).view(np.uint8).reshape(len(x), -1)
    return out


def decode(rows: np.ndarray) -> np.ndarray:
    """Rows of doubles from rows of bytes of one format."""
    words = np.ascontiguousarray(rows[:, 1:]).view("<u2")
    if not len(rows) or (rows[:, 0] == LETTERS["half"]).all():
        return words.view("<f2").astype(np.float64)
    if (rows[:, 0] == LETTERS["bfloat"]).all():
        return (words.astype("<u4") << 16).view("<f4").astype(np.float64)
    raise ValueError("packed vectors of one column must have one format")


def is_packed(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.BinaryType)


def _replaced(df: DataFrame, column: str, kind: T.DataType, turn) -> DataFrame:
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = turn(columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, kind) if f.name == column else f for f in df.schema.fields]))


def pack(df: DataFrame, kind: str, column: str = "x") -> DataFrame:
    """``df`` with an array column packed; all other columns stay. Vectors must be complete and of one length in each Arrow batch."""
    from ..operators.kernel import matrix

    def turn(lists: pa.Array) -> pa.Array:
        if not len(lists):
            return pa.array([], pa.binary())
        rows = encode(matrix(lists, len(lists[0]) if lists[0].is_valid else 0), kind)
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.py_buffer(rows)])

    return _replaced(df.withColumn(column, F.col(column).cast("array<double>")), column, T.BinaryType(), turn)


def unpack(df: DataFrame, column: str = "x") -> DataFrame:
    """``df`` with a packed column as an array of doubles."""
    from ..operators.kernel import matrix

    def turn(rows: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], pa.list_(pa.float64()))
        values = matrix(rows, (len(rows[0].as_py()) - 1) // 2 if rows[0].is_valid else 0)
        return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))

    return _replaced(df, column, T.ArrayType(T.DoubleType()), turn)
