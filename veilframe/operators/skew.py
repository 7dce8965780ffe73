"""Look-ups in narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def lookup(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 1, spread_by: list[str] | None = None) -> DataFrame:
    """Left join to a narrow table with at most one row per key.

    Adaptive execution splits a key that holds a large share of the left rows by measured size. Where it can't (it is
    switched off, or the join's result feeds an aggregate by the same keys), ``salts`` deals left rows of one key
    to that many partitions by ``spread_by`` and repeats each right row for each of them.
    """
    if salts <= 1:
        return left.join(right, keys, "left")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*(spread_by or left.columns)), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")
