"""Text tables: pages (doc_id, page_index, text) and the lines in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_KEY = ("doc_id", "page_index", "line_no")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """``rows`` dealt over all tasks by a hash of ``keys``.

    A scan has no more tasks than its files have row groups, so narrow rows that much work follows on are dealt out first.
    Two tasks a core at least, and as many as a shuffle has.
    """
    spark = rows.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(tasks, *keys)


def pages_from_documents(documents: DataFrame) -> DataFrame:
    """One page per document."""
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).alias("page_index"), F.col("text")
    )


def pages_from_conversations(conversations: DataFrame) -> DataFrame:
    """One document per conversation, one page per turn."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("doc_id"), F.col("turn").cast("int").alias("page_index"), "text"
    )


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def lines_of(pages: DataFrame) -> DataFrame:
    """Lines of every page, empty ones included (they are needed to put a page together again)."""
    return pages.select("doc_id", "page_index", F.posexplode(split_lines(F.col("text"))).alias("line_no", "text"))
