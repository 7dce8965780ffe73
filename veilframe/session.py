"""Session settings and where jobs may keep shared files."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veilframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VEILFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stacked(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns a part lacks are null.

    Spark 4.1 lets a union keep its inputs' partitioning. When adaptive execution re-plans the inputs, that has
    been seen to repeat rows now and then, so it is switched off for the session before a union is made.
    """
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder in the cluster's shared one: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Where neither is set, a local session uses a temporary folder; a cluster's executors would each write to a disk
    of their own, so there it is an error. Folders of one application lie together and go when its JVM ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context._conf.get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder()
    own = f"{base.rstrip('/')}/veilframe-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{purpose}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="veilframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def materialize(df: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once, to ``folder`` or the shared folder, and go on from the files.

    For results that several later steps read: they are computed once, and survive lost executors.
    """
    folder = folder or shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def small_rows(spark: SparkSession) -> Iterator[None]:
    """For jobs that send very many small rows to Python: batches are bounded by their rows alone.

    Spark 4.1 measures a whole batch after each row, to keep it within ``maxBytesPerBatch``. For rows of a hundred bytes that takes
    several times as long as writing them, and ten thousand of them are far below that bound.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
