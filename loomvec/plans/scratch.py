"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tempfile.TemporaryDirectory] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_FOLDERS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset in a local run, a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.TemporaryDirectory(prefix="loomvec-"))
        atexit.register(_OWN[0].cleanup)
    return f"file://{_OWN[0].name}"


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, which goes when the process ends."""
    folder = f"{shared_dir(spark)}/loomvec-{spark.sparkContext.applicationId}"
    _FOLDERS.setdefault(folder, spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@atexit.register
def _clear() -> None:
    """Intermediate tables hold parts of the inputs; those that are left go with the process."""
    for folder, spark in _FOLDERS.items():
        with suppress(Exception):  # the JVM may be gone already
            _delete(spark, folder)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends here, and a lost executor costs no recomputation."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[kept] = path
    return kept


def discard(kept: DataFrame) -> None:
    """Delete a kept table; nothing that is still to run may read it."""
    _delete(kept.sparkSession, _PATHS.pop(kept))


def attach(df: DataFrame, path: str) -> DataFrame:
    """Note that ``df`` reads a path of the application's folder, which goes when ``df`` is released."""
    _PATHS[df] = path
    return df


def release(df: DataFrame) -> None:
    """As discard, for a table that may be one of the caller's own, which stays."""
    if df in _PATHS:
        discard(df)


def width(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
