"""Checks on what is about to be published."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ABSOLUTE_URL, ALLOWED_URL_PREFIXES, SIZE_BUDGET_BYTES
from ..functions.dialect import to_java

_MIB = 1024 * 1024


def external_urls(text: Column, allowed: tuple[str, ...] = ALLOWED_URL_PREFIXES) -> Column:
    """array<string> of the absolute URLs that start with no allowed prefix."""
    found = F.regexp_extract_all(text, F.lit(to_java(ABSOLUTE_URL)), F.lit(0))
    if allowed:
        found = F.filter(found, lambda u: ~reduce(or_, [u.startswith(a) for a in allowed]))
    return F.when(text.contains("http"), found)


def external_url_audit(
    df: DataFrame, key: str, texts: list[str], allowed: tuple[str, ...] = ALLOWED_URL_PREFIXES
) -> DataFrame:
    """key, field, url: one row per violation in any of the text columns."""
    empty = F.array().cast("array<string>")

    def in_field(name: str) -> Column:
        urls = F.coalesce(external_urls(F.col(name), allowed), empty)
        return F.transform(urls, lambda u: F.struct(F.lit(name).alias("field"), u.alias("url")))

    return df.select(key, F.inline(F.concat(*[in_field(t) for t in texts])))


def size_budget(df: DataFrame, key: str, size: str, budget: int = SIZE_BUDGET_BYTES) -> DataFrame:
    """key, size_mib, budget_mib, over_budget; exactly the budget is within it."""
    bytes_ = F.col(size)
    return df.select(
        key,
        F.round(bytes_ / _MIB, 2).alias("size_mib"),
        F.lit(round(budget / _MIB, 2)).alias("budget_mib"),
        (bytes_ > budget).alias("over_budget"),
    )
