"""Folders of tables that are there as a whole or not at all: written beside their place, then renamed into it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """Named tables under a path of any file system that Spark writes to and that renames in one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def numbers(self, kind: str) -> list[int]:
        """Of the committed tables named ``<kind>=<number>``, the numbers, ascending."""
        if not self._files.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(""))]
        return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}="))

    def read(self, kind: str, number: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}={number:05d}")

    def commit(self, kind: str, number: int, df: DataFrame) -> bool:
        """Write a table; false, and nothing changed, if there is one of that name already."""
        draft, place = self._at(f".draft-{uuid.uuid4().hex}"), self._at(f"{kind}={number:05d}")
        if self._files.exists(place):
            return False
        df.write.parquet(draft.toString())
        done = not self._files.exists(place) and self._files.rename(draft, place)
        if not done:
            self._files.delete(draft, True)
        return done

    def drop(self, kind: str, number: int) -> None:
        self._files.delete(self._at(f"{kind}={number:05d}"), True)
