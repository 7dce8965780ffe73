"""What happens before detection: which files are taken, and how large their pages are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LARGE_FILE_BYTES, MAX_PASSWORD_RETRIES, PDF_MIME
from ..functions.geometry import normalize_rotation


def intake_triage(files: DataFrame) -> DataFrame:
    """Adds accepted, large, size_mb, status and reason to path, mime, length, needs_password, password_ok, attempts.

    ``password_ok`` is null where none was given; ``attempts`` counts failed tries. Where there are columns
    ``cancelled`` (the password was asked for and not given) and ``open_error`` (what else went wrong on opening), they
    lead to status ``error``; ``reason`` says why.
    """
    given = lambda name, kind: F.col(name) if name in files.columns else F.lit(None).cast(kind)
    cancelled, open_error = F.coalesce(given("cancelled", "boolean"), F.lit(False)), given("open_error", "string")
    locked = F.coalesce(F.col("needs_password"), F.lit(False))
    accepted = F.coalesce(F.col("mime") == PDF_MIME, F.lit(False))
    shut = locked & ~F.coalesce(F.col("password_ok"), F.lit(False))
    reason = (
        F.when(~accepted, None)
        .when(open_error.isNotNull(), open_error)
        .when(shut & (F.col("attempts") > MAX_PASSWORD_RETRIES), "too many attempts")
        .when(shut & cancelled, "cancelled")
    )
    status = (
        F.when(~accepted, "rejected")
        .when(reason.isNotNull(), "error")
        .when(locked & F.col("password_ok").isNull(), "PASSWORD_REQUIRED")
        .when(locked & ~F.col("password_ok"), "PASSWORD_WRONG")
        .otherwise("ready")
    )
    return files.withColumns(
        {
            "accepted": accepted,
            "large": F.col("length") > LARGE_FILE_BYTES,
            "size_mb": F.floor(F.col("length") / (1024 * 1024) + 0.5).cast("bigint"),
            "status": status,
            "reason": reason,
        }
    )


def page_meta(bounds: DataFrame) -> DataFrame:
    """doc_id, page_index, width_pt, height_pt, rotation from page bounds and the raw rotation."""
    return bounds.select(
        "doc_id",
        "page_index",
        (F.col("x1") - F.col("x0")).alias("width_pt"),
        (F.col("y1") - F.col("y0")).alias("height_pt"),
        normalize_rotation(F.col("rotate_raw")).alias("rotation"),
    )
