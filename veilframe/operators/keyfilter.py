"""A filter of fixed size over keys, so that rows without a partner need not be shuffled to find that out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 15
BITS = 64 * WORDS


def _place(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def with_maybe(rows: DataFrame, partners: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` and ``maybe``: false only where no row of ``partners`` has the same keys.

    The filter is two million bits in at most 32,768 rows, half a megabyte however many partners there are, so it is
    broadcast. With more than a million partners or so it fills up and says true more often; nothing is lost by that.
    """
    at = partners.select(_place(keys).alias("p"))
    word, bit = F.floor(F.col("p") / 64).cast("int").alias("_word"), F.expr("shiftleft(1L, int(p % 64))").alias("b")
    filled = at.select(word, bit).groupBy("_word").agg(F.bit_or("b").alias("_bits"))
    placed = rows.withColumn("_p", _place(keys)).withColumn("_word", F.floor(F.col("_p") / 64).cast("int"))
    tested = placed.join(F.broadcast(filled), "_word", "left")
    maybe = F.coalesce(F.getbit(F.col("_bits"), (F.col("_p") % 64).cast("int")) == 1, F.lit(False))
    return tested.select(*rows.columns, maybe.alias("maybe"))
