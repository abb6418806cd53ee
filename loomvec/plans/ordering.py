"""Dense positions in a global order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import keep, width


def dense_index(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` and each row's position (from 0) in its group by ``order``, which must be unique within the group.

    Rows are range-partitioned by group and order, numbered inside their partition, and shifted by the sizes of the partitions
    before; only one row for each partition and group is windowed as a whole.
    """
    spark = df.sparkSession
    keys = [*groups, *order]
    placed = df.repartitionByRange(width(spark), *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    placed = keep(placed, "ordered")
    local = W.partitionBy("_part", *groups).orderBy(*order)
    numbered = placed.withColumn("_local", F.row_number().over(local))
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"))
    shifts = sizes.select("_part", *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    out = numbered.join(shifts, ["_part", *groups])
    return out.select(*df.columns, (F.col("_shift") + F.col("_local") - 1).alias(name))
