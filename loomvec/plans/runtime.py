"""What a session needs before workers can run this package's kernels."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the package to the workers, once an application, unless their PYTHONPATH has it."""
    package = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    on_path = str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not on_path and context.applicationId not in _SHIPPED and package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="loomvec-ship-")) / "loomvec.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
    return spark
