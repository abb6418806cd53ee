"""Vector expressions, and rounding to shorter floating-point formats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits after the first one of a significand, and the least exponent of a normal number.
FORMATS = {"half": (10, -14), "bfloat": (7, -126), "single": (23, -126)}


def dot(x: Column, y: Column) -> Column:
    """Left-to-right sum of products in double precision."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def sq_norm(x: Column) -> Column:
    return dot(x, x)


def raw_distance(c_sq: Column, product: Column) -> Column:
    """Squared distance without the point's own norm; NaN never wins."""
    d = c_sq - F.lit(2.0) * product
    return F.when(F.isnan(d), float("inf")).otherwise(d)


def clamped_distance(x_sq: Column, c_sq: Column, product: Column) -> Column:
    """Squared distance, at least 0; NaN counts as 0."""
    d = x_sq + c_sq - F.lit(2.0) * product
    return F.when(~F.isnan(d) & (d > 0), d).otherwise(F.lit(0.0))


def checked(x: Column, dims: int) -> Column:
    """``x`` if it has ``dims`` components and none is null; else the query fails."""
    good = x.isNotNull() & (F.size(x) == dims) & ~F.exists(x, lambda v: v.isNull())
    return F.when(good, x).otherwise(F.raise_error(F.lit(f"a vector is null, has a null component, or is not of length {dims}")).cast("array<double>"))


def to_precision(values: np.ndarray, precision: str) -> np.ndarray:
    """Doubles rounded to nearest, ties to even, in a shorter format; values beyond its range stay as they are."""
    if precision == "double":
        return values
    bits, least = FORMATS[precision]
    if precision == "bfloat":
        values = to_precision(values, "single")
    with np.errstate(divide="ignore", invalid="ignore"):
        unit = np.exp2(np.maximum(np.frexp(values)[1] - 1, least) - bits)
        return np.where(np.isfinite(values) & (values != 0), np.rint(values / unit) * unit, values)


def rounded(x: Column, precision: str) -> Column:
    """``x`` with every component rounded as by to_precision: JVM expressions only."""
    if precision == "double":
        return x
    if precision == "single":
        return x.cast("array<float>").cast("array<double>")
    bits, least = FORMATS[precision]
    x = rounded(x, "single") if precision == "bfloat" else x

    def turn(v: Column) -> Column:
        unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(least)) - bits)
        return F.when((v == 0) | F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(F.rint(v / unit) * unit)

    return F.transform(x, turn)


def drawn(seed: int, *keys: Column) -> Column:
    """A number below 2**32 that depends on the seed and integer keys below 2**32 alone: integer arithmetic that any SQL engine can repeat."""

    def step(h: Column, key: Column) -> Column:
        h = (h + key + 1013904223) * 747796405 % (1 << 32)
        h = h.bitwiseXOR(F.shiftright(h, 16)) * 569420461 % (1 << 32)
        return h.bitwiseXOR(F.shiftright(h, 15))

    return F.aggregate(F.array(*(key.cast("long") for key in keys)), F.lit(seed).cast("long"), step)


def drawn_array(seed: int, *keys: np.ndarray) -> np.ndarray:
    """The same numbers as ``drawn``, from arrays."""
    h = np.uint64(seed)
    for key in keys:
        h = (h + key.astype(np.uint64) + np.uint64(1013904223)) * np.uint64(747796405) % np.uint64(1 << 32)
        h = (h ^ h >> np.uint64(16)) * np.uint64(569420461) % np.uint64(1 << 32)
        h = h ^ h >> np.uint64(15)
    return h
