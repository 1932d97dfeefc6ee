"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may go without the setting: a temporary folder is then
    used. On a cluster a machine-local folder would break recovery, so a missing
    setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_rangeloom_scratch", None)
        if base is None:
            base = spark._rangeloom_scratch = "file://" + tempfile.mkdtemp(prefix="rangeloom-")
            atexit.register(_remove_local, base)
    return f"{base.rstrip('/')}/rangeloom-{spark.sparkContext.applicationId}"


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared scratch folder; the reread table and its path."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Let the driver notice that earlier steps are over, so that executors delete
    their shuffle files; otherwise these stay until it happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink_executors(spark: SparkSession) -> None:
    """Have executors collect their garbage, so that their heaps shrink between heavy
    steps. Some executors may be missed; that costs nothing but their memory."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def give_back_memory() -> None:
    """Return what a reused worker holds from earlier steps to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the C library that has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def local_path(uri: str) -> str:
    """The mounted path of a ``file:`` folder (workers open model files by path)."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri} is not mounted as a file system; use a file: folder that all executors share")
    return uri


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
