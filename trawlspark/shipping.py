"""Python stages run on executors that need not have this package installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset: a temporary one if all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='trawl-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Bytes of rows that a task hands to Python at a time, about (a longer row is a batch of its own). Spark's own bound is 64 MB, of which the
#: JVM holds up to three copies outside its heap and the worker one more.
ARROW_BYTES = 4 << 20
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each Spark application, and bound the session's Arrow batches (a lower bound stays)."""
    if not 0 < int(spark.conf.get(_ARROW_SETTING).rstrip("b")) <= ARROW_BYTES:
        spark.conf.set(_ARROW_SETTING, ARROW_BYTES)
    context = spark.sparkContext
    if getattr(context, "_trawlspark_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="trawlspark-"))
    path = os.path.join(folder, "trawlspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(path)
    context._trawlspark_shipped = True


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, and so would the task's peak."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow on executors that have this package."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)
