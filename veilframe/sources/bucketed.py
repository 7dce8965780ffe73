"""Tables dealt into buckets when they are written, so that later joins and groups on the keys move none of their rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.glyph_runs import packed
from ..session import shared_folder, small_rows
from .tables import LINE_KEY

PAGE_KEY = ("doc_id", "page_index")


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int | None = None, name: str | None = None, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in buckets of ``keys``, sorted within each, and go on from it.

    ``folder`` (the shared folder where not given) keeps the files; with ``name`` and a catalog that outlives the session
    the table can be opened again by its name. ``buckets`` should make one some 100 MB, and be no fewer than there are shuffle
    partitions (as many where not given): a table of fewer is dealt anew by Spark, which wants as many tasks.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out beforehand, a bucket is one file; else each task would write a file for each of them.
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", folder or shared_folder(spark, "bucketed")).saveAsTable(name)
    return spark.table(name)


def bucketed_pages(pages: DataFrame, **given) -> DataFrame:
    """Pages by (doc_id, page_index): masking joins them with spans where they lie."""
    return bucketed(pages, PAGE_KEY, **given)


def bucketed_glyphs(glyphs: DataFrame, **given) -> DataFrame:
    """Packed runs of glyphs (``operators.glyph_runs``) by line: dropping what is covered stays where they lie."""
    with small_rows(glyphs.sparkSession):
        return bucketed(packed(glyphs.select(*LINE_KEY, "char_no", "ch", "quad")), LINE_KEY, **given)
