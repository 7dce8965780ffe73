"""Output names and short references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import ANONYMIZED_SUFFIX, DEFAULT_BASE_NAME
from .dialect import SPACE_CHARS


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE_CHARS}]+|[{SPACE_CHARS}]+\\z", "")


def anonymized_name(name: Column) -> Column:
    base = trimmed(F.coalesce(name, F.lit("")))
    stem = F.when(base == "", F.lit(DEFAULT_BASE_NAME)).otherwise(F.regexp_replace(base, r"(?i)\.pdf\z", ""))
    return F.concat(stem, F.lit(f"{ANONYMIZED_SUFFIX}.pdf"))


def short_ref(box_id: Column) -> Column:
    return F.right(box_id, F.lit(6))
