"""The log of a clustering run: one committed table of centroids for each iteration.

``<folder>/iteration=00007`` holds the centroids after iteration 7, with the
largest move that led to them and the run's parameters. A driver that dies
leaves whole iterations only. Models are kept the same way, as versions.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.commits import Folder

SCHEMA = "batch_id int, k int, c array<double>, move double, parameters string"


def _rows(centroids: DataFrame, move: float | None, parameters: dict) -> DataFrame:
    rows = centroids.select(F.col("batch_id").cast("int").alias("batch_id"), F.col("k").cast("int").alias("k"), "c")
    return rows.withColumns({"move": F.lit(move).cast("double"), "parameters": F.lit(json.dumps(parameters, sort_keys=True))})


class Journal:
    def __init__(self, spark: SparkSession, folder: str, parameters: dict):
        self.folder, self.parameters = Folder(spark, folder), parameters

    def _table(self, iteration: int) -> DataFrame:
        return self.folder.read("iteration", iteration, SCHEMA)

    def write(self, iteration: int, centroids: DataFrame, move: float | None = None) -> DataFrame:
        """Commit an iteration's centroids and read them back."""
        if not self.folder.commit("iteration", iteration, _rows(centroids, move, self.parameters)):
            raise OSError(f"iteration {iteration} is there already: another run writes to {self.folder.path}")
        return self._table(iteration).select("batch_id", "k", "c")

    def last(self) -> tuple[int, list[float], DataFrame | None, DataFrame | None]:
        """The last committed iteration, the moves up to it, its centroids and those before it; nothing was committed: no centroids."""
        there = self.folder.numbers("iteration")
        if not there:
            return 0, [], None, None
        heads = [self._table(i).select("move", "parameters").first() for i in there]
        if any(json.loads(h.parameters) != self.parameters for h in heads):
            raise ValueError(f"{self.folder.path} is the log of a run with other parameters: {heads[0].parameters}")
        tables = [self._table(i).select("batch_id", "k", "c") for i in (there[-1], max(there[-1] - 1, 0))]
        return there[-1], [h.move for h in heads[1:]], *tables


def save_version(centroids: DataFrame, folder: str, parameters: dict) -> int:
    """Commit a model's centroids and parameters as the next version; two writers get different ones."""
    place = Folder(centroids.sparkSession, folder)
    version = (place.numbers("version") or [0])[-1] + 1
    while not place.commit("version", version, _rows(centroids, None, parameters)):
        version += 1
    return version


def load_version(spark: SparkSession, folder: str, version: int | None = None) -> tuple[DataFrame, dict]:
    """Centroids and parameters of a version, or of the latest one."""
    place = Folder(spark, folder)
    there = place.numbers("version")
    if not there or (version is not None and version not in there):
        raise ValueError(f"{folder} has no version {'at all' if version is None else version}")
    rows = place.read("version", there[-1] if version is None else version, SCHEMA)
    return rows.select("batch_id", "k", "c"), json.loads(rows.select("parameters").first().parameters)
