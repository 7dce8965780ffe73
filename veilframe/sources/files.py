"""Files in and out."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import PDF_MIME
from ..functions.names import anonymized_name
from .batches import delete_folder, paths_like

SUFFIX_OF_MIME = {"pdf": PDF_MIME}


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Columns for ``intake_triage``. File contents are not read: only the listed columns reach the scan."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    mimes = F.create_map(*[F.lit(v) for item in SUFFIX_OF_MIME.items() for v in item])
    return found.select(
        "path",
        F.element_at(mimes, suffix).alias("mime"),
        "length",
        F.lit(False).alias("needs_password"),
        F.lit(None).cast("boolean").alias("password_ok"),
        F.lit(0).alias("attempts"),
    )


def write_anonymized(pages: DataFrame, path: str, name: str = "name", partition_by: str | None = None) -> None:
    """Write masked pages as parquet, each with the name its output is saved under."""
    out = pages.withColumn("file_name", anonymized_name(F.col(name)))
    writer = out.write.mode("overwrite")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


_COMMIT = "batch string, version bigint, attempt string, pages bigint"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """The attempt of each batch that counts: of its commits the last."""
    if not paths_like(spark, f"{path}/commits"):
        return spark.createDataFrame([], _COMMIT)
    done = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    return done.groupBy("batch").agg(F.max(F.struct("version", "attempt", "pages")).alias("c")).select("batch", "c.*")


def write_anonymized_batch(pages: DataFrame, path: str, batch: str, name: str = "name") -> None:
    """Write masked pages as batch ``batch`` of an output that takes many, whole or not at all.

    Pages go to a folder of this attempt, and one row in a table of commits makes them the batch's. Before that row, readers
    have the batch's earlier pages, or none; a run that fails leaves those, and one that is repeated takes their place.
    One writer a batch at a time; different batches may be written at once.
    """
    spark, attempt = pages.sparkSession, uuid.uuid4().hex
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError("a batch is named by letters, digits and _.-")
    if {"batch", "attempt"} & {c.lower() for c in pages.columns}:
        raise ValueError("pages have no columns batch and attempt of their own")
    folder = f"{path}/pages/batch={batch}/attempt={attempt}"
    write_anonymized(pages, folder, name)
    n = spark.read.parquet(folder).count()
    version = _commits(spark, path).where(F.col("batch") == batch).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
    # One row is one file, which the job's end renames into place.
    commit = spark.createDataFrame([(batch, version, attempt, n)], _COMMIT).coalesce(1)
    commit.write.mode("append").parquet(f"{path}/commits")


def read_anonymized_batches(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the committed attempt of each batch, with the column ``batch``. Other attempts' folders aren't read.

    Columns that some batches lack are null there. An output that no batch was written to is an error, as its columns
    aren't known.
    """
    attempts = {r.attempt for r in _commits(spark, path).collect()}
    folders = [f for f in paths_like(spark, f"{path}/pages/batch=*/attempt=*") if f.rpartition("=")[2] in attempts]
    if not folders:
        raise FileNotFoundError(f"no committed batch in {path}")
    reader = spark.read.option("basePath", f"{path}/pages")
    schema = reader.option("mergeSchema", "true").parquet(*folders).drop("batch", "attempt").schema
    # With types given, a batch named 007 isn't taken for a number.
    return reader.schema(schema.add("batch", "string").add("attempt", "string")).parquet(*folders).drop("attempt")


def drop_replaced_attempts(spark: SparkSession, path: str) -> int:
    """Delete folders of attempts that failed or were replaced; to be called while nobody writes. Returns how many."""
    kept = {r.attempt for r in _commits(spark, path).collect()}
    gone = [f for f in paths_like(spark, f"{path}/pages/batch=*/attempt=*") if f.rpartition("=")[2] not in kept]
    for folder in gone:
        delete_folder(spark, folder)
    return len(gone)
