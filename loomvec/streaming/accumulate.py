"""Sums and counts of a stream by nearest centroid, each micro-batch once.

A micro-batch's sums are committed as a table named by the batch's number. When
a restarted query runs a batch again, its table is there already and stays as it
is, so every point counts once. Every ``every`` batches the tables so far are
added up into one base table, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.assign import assign, facts
from ..operators.update import PARTIAL, centroid_update_labelled, merge
from ..plans.commits import Folder


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """Accumulators of all committed batches: batch_id, k, sums, cnt."""
    return merge(_tables(Folder(spark, folder)))


def _tables(place: Folder, upto: int | None = None) -> DataFrame:
    base = ([n for n in place.numbers("base") if upto is None or n <= upto] or [-1])[-1]
    out = place.read("base", base, PARTIAL) if base >= 0 else place.spark.createDataFrame([], PARTIAL)
    for n in place.numbers("batch"):
        if n > base and (upto is None or n <= upto):
            out = out.unionByName(place.read("batch", n, PARTIAL))
    return out


def _compact(place: Folder, number: int) -> None:
    """One base table in place of all batches up to a number; an interrupted call leaves tables that the base outdates."""
    place.commit("base", number, merge(_tables(place, number)))
    for kind, last in (("batch", number), ("base", number - 1)):
        for n in place.numbers(kind):
            if n <= last:
                place.drop(kind, n)


def accumulate_stream(points: DataFrame, centroids: DataFrame, folder: str, checkpoint: str, clamp: bool = True, every: int = 50, **options: str) -> StreamingQuery:
    """Start adding up a stream of points by nearest centroid, until what its source has now is done."""
    seen = facts(centroids)

    def add(batch: DataFrame, number: int) -> None:
        place = Folder(batch.sparkSession, folder)
        done = place.numbers("base")
        if (done and done[-1] >= number) or number in place.numbers("batch"):
            return
        labelled = assign(batch, centroids, clamp, "arrow", with_points=True)
        place.commit("batch", number, centroid_update_labelled(labelled, seen.most, seen.dims))
        if number % every == every - 1:
            _compact(place, number)

    return points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
