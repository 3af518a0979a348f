"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names.

A table ends lineage, so a lost executor costs a re-read and not a recomputation.  While one is
written, two settings hold and are then put back: smaller Arrow batches, which bound what a
Python task holds, and removal of the write's shuffle files, which nothing reads once the table
is there.  ``drop`` deletes tables that are no longer needed; the rest go when Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_left: dict[str, SparkSession] = {}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """``values`` hold inside; what was set before holds after."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where it is unset, a local session gets a
    temporary one; a cluster's executors would not share that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="slotgram-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when Python ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    spark = df.sparkSession
    path = new_path(spark, what)
    with settings(spark, SETTINGS):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written``; other DataFrames and None are passed by."""
    for table in tables:
        path = getattr(table, "scratch_path", None) if table is not None else None
        if path and _left.pop(path, None):
            delete(table.sparkSession, path)


@atexit.register
def _drop_left() -> None:
    for path, spark in list(_left.items()):
        with contextlib.suppress(Py4JError, Py4JNetworkError, OSError, AttributeError, TypeError):  # the JVM may be gone
            delete(spark, path)
