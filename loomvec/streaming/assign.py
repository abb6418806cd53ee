"""Assignment of a stream of points to fixed centroids: stateless, so it runs on a streaming DataFrame as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.assign import assign


def assign_stream(points: DataFrame, centroids: DataFrame, clamp: bool = True) -> DataFrame:
    """Streaming labels; ``points`` may come from any streaming source."""
    return assign(points, centroids, clamp, "arrow")


def write_labels(labels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append labels as Parquet, exactly once, and end when the source's present rows are done."""
    return labels.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
