"""What an application sets up once: the shared folder, this package on Python workers, batch sizes."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_sent: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all runs on one
    machine, as in tests, a local folder is chosen.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "stopwise-shared")
    return f"{base.rstrip('/')}/stopwise/{spark.sparkContext.applicationId}"


def hadoop_path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder."""
    fs, path = hadoop_path(spark, shared_dir(spark))
    fs.delete(path, True)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, for plans that read it several times."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_heaps(spark: SparkSession) -> None:
    """Let the executors' JVMs collect garbage, after which they give back what their heaps don't need.

    For jobs of several stages: a heap that shuffles have filled up to its bound keeps that memory, and a later stage whose work
    is in Python workers finds too little beside it. Takes a task for each core and a full collection of each heap.
    """
    tasks = 2 * spark.sparkContext.defaultParallelism
    collected = spark.range(0, tasks, 1, tasks).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("x"))
    collected.write.format("noop").mode("overwrite").save()


def sources() -> bytes:
    """This package as a zip file."""
    here, held = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.join("stopwise", os.path.relpath(file, here)))
    return held.getvalue()


def ship(spark: SparkSession) -> None:
    """Put the package's sources into the shared folder, once, for the application's Python workers.

    Arrow batches are held to 4 MB unless the session sets a size: rows here may be whole texts or
    lines of pixels, and a default batch of them takes a good part of an executor's memory.
    """
    if spark.conf.get(BATCH_BYTES, None) == "67108864b":
        spark.conf.set(BATCH_BYTES, "4m")
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    _sent.add(app)
    name = f"{shared_dir(spark)}/stopwise_sources.zip"
    fs, path = hadoop_path(spark, name)
    out = fs.create(path, True)
    out.write(sources())
    out.close()
    spark.sparkContext.addPyFile(name)


def tidied(work):
    """``work`` on Arrow batches, after which the worker gives free memory back.

    Workers stay for later tasks; what a library's allocator keeps for itself would add up over stages.
    """

    def run(batches):
        yield from work(batches)
        release()

    return run


def release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
