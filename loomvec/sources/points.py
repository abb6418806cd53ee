"""Points and centroids as DataFrames.

points: ``batch_id INT, point_id BIGINT, x ARRAY<DOUBLE>``, one row a point.
centroids: ``batch_id INT, k INT, c ARRAY<DOUBLE>`` and optionally ``c_sq``.
labels: ``batch_id INT, point_id BIGINT, cluster_id INT``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.vectors import drawn, drawn_array


def points(df: DataFrame, id_col: str | Column, vector_col: str | Column, batch_col: str | Column | None = None) -> DataFrame:
    """Any table with an identifier and a vector (an array of numbers, or packed) as points; one batch unless named."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    x = as_col(vector_col)
    if df.select(x.alias("x")).dtypes[0][1] != "binary":
        x = x.cast("array<double>")
    batch = F.lit(0) if batch_col is None else as_col(batch_col).cast("int")
    return df.select(batch.alias("batch_id"), as_col(id_col).cast("long").alias("point_id"), x.alias("x"))


def vector(*columns: str) -> Column:
    """Numeric columns as one vector, in order."""
    return F.array(*(F.col(c).cast("double") for c in columns))


def read_points(spark: SparkSession, path: str, id_col: str, vector_col: str, batch_col: str | None = None, source: str = "parquet", **options: str) -> DataFrame:
    """Points from any source Spark reads; only the named columns are scanned."""
    return points(spark.read.format(source).options(**options).load(path), id_col, vector_col, batch_col)


def write_table(df: DataFrame, path: str, source: str = "parquet", mode: str = "errorifexists") -> None:
    """Labels, centroids or metrics to any sink Spark writes."""
    df.write.format(source).mode(mode).save(path)


def gaussian_points(spark: SparkSession, batches: int, n: int, dims: int, seed: int = 0) -> DataFrame:
    """Seeded standard normal points; a value depends on the seed, batch, point and dimension alone."""
    rows = spark.range(batches * n).select((F.col("id") / n).cast("int").alias("batch_id"), (F.col("id") % n).alias("point_id"))
    return gaussian_rows(rows, dims, seed)


def gaussian_rows(rows: DataFrame, dims: int, seed: int = 0) -> DataFrame:
    """``rows`` (batch_id and point_id, from any table) with the seeded standard normal point of each."""

    def normal(d: Column) -> Column:
        one, two = (drawn(seed, F.col("batch_id"), F.col("point_id"), 2 * d + k) for k in (0, 1))
        return F.sqrt(-2.0 * F.log((one + 0.5) / 2.0**32)) * F.cos(two * (2.0 * math.pi / 2.0**32))

    return rows.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), normal))


class GaussianSource(DataSource):
    """``spark.read.format("gaussian_points")``: the same points as gaussian_points, as a table that tasks generate.

    Options: rows (a batch), dims, batches (1), seed (0) and partitions (8); values do not depend on the last.
    """

    @classmethod
    def name(cls) -> str:
        return "gaussian_points"

    def schema(self) -> str:
        return "batch_id int, point_id long, x array<double>"

    def reader(self, schema) -> DataSourceReader:
        return GaussianReader({"batches": 1, "seed": 0, "partitions": 8} | {k: int(v) for k, v in self.options.items()})


class GaussianReader(DataSourceReader):
    ROWS = 4096

    def __init__(self, options: dict[str, int]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        total, parts = self.options["batches"] * self.options["rows"], max(1, self.options["partitions"])
        return [InputPartition((total * p // parts, total * (p + 1) // parts)) for p in range(parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        (begin, end), o = partition.value, self.options
        dims = np.arange(o["dims"])
        for a in range(begin, end, self.ROWS):
            number = np.arange(a, min(a + self.ROWS, end))
            batch, point = number // o["rows"], number % o["rows"]
            one, two = (drawn_array(o["seed"], batch[:, None], point[:, None], 2 * dims[None] + k) for k in (0, 1))
            x = np.sqrt(-2.0 * np.log((one + 0.5) / 2.0**32)) * np.cos(two * (2.0 * math.pi / 2.0**32))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * o["dims"], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.int32()), pa.array(point, pa.int64()), lists], names=["batch_id", "point_id", "x"])


def read_gaussian(spark: SparkSession, **options: int) -> DataFrame:
    """The generated points as a table."""
    spark.dataSource.register(GaussianSource)
    return spark.read.format("gaussian_points").options(**options).load()


def first_k(pts: DataFrame, k: int) -> DataFrame:
    """The k points of least id of each batch as centroids.

    Each part of the input ranks its own ids first, so the last ranking of a batch sees k ids a part, however many points it has.
    """
    ids = pts.select("batch_id", "point_id", F.spark_partition_id().alias("part"))
    for group in (["batch_id", "part"], ["batch_id"]):
        ids = ids.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy("point_id"))).filter(F.col("rank") <= k)
    low = ids.select("batch_id", "point_id", (F.col("rank") - 1).cast("int").alias("k"))
    return pts.join(low, ["batch_id", "point_id"]).select("batch_id", "k", F.col("x").alias("c"))


def random_rows(pts: DataFrame, k: int, seed: int) -> DataFrame:
    """k points of each batch drawn with replacement: seeded draws of the batch's dense row index."""
    from ..plans.ordering import dense_index

    indexed = dense_index(pts, ["batch_id"], ["point_id"], "at")
    sizes = indexed.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    slots = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    draws = slots.withColumn("at", drawn(seed, F.col("batch_id"), F.col("k")) % F.col("n"))
    return draws.join(indexed, ["batch_id", "at"]).select("batch_id", "k", F.col("x").alias("c"))
