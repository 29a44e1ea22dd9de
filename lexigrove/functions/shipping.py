"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import contextlib
import ctypes
import io
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.writestr(str(path.relative_to(top.parent)), path.read_bytes())
    target = os.path.join(tempfile.mkdtemp(prefix="lexigrove-"), f"{top.name}.zip")
    Path(target).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(target)  # the driver serves it to every executor, later ones too
    _shipped.add(app)


def release() -> None:
    """Give memory that a task no longer needs back to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""

    def run(stream):
        yield from function(stream)
        release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
