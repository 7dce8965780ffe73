"""What several operators share: word pattern, row keys, learning folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(*cols: Column | str) -> tuple[Column, Column]:
    """128 bits for a row's content, nulls told from values; rows equal in ``cols`` share their key."""
    parts = [x for c in cols for x in (F.isnull(c), F.col(c) if isinstance(c, str) else c)]
    return F.xxhash64(*parts), F.xxhash64(F.lit(7919), *parts)


def held_out(doc_id: Column | str) -> Column:
    """Rows of the test fold: crc32 of the id as text leaves 1 modulo 3. A null id counts as the text ''."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 3 == 1
