"""Files in the folder that all executors share, opened by any address the Arrow file systems know."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from pressroom.session import cut_lineage, shared_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, kind: str) -> str:
    """Address of a folder of its own below the shared folder."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def split_uri(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return fs.LocalFileSystem(), uri[5:]
    return fs.FileSystem.from_uri(uri)


def create(folder: str, suffix: str):
    """A new file under a name no other attempt of the task uses: its address and an open stream.

    The rows a task returns name its files, so files of attempts that failed are never read.
    """
    system, path = split_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def read_at(uri: str):
    """An open file for range reads."""
    system, path = split_uri(uri)
    return system.open_input_file(path)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, read it from there, and free the shuffles that made it.

    What follows depends on the written table alone, so the local shuffle files serve nobody any more;
    without this they stay until the driver's garbage collector finds them.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send whole texts to Python that many at a time: a task's Arrow buffers, which lie outside the executor's
    heap, hold a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def tidy() -> None:
    """Give the memory that a finished task's arrays have left free back to the system.

    Python workers live on for later tasks, beside other workers and the executor's own heap.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
