"""A review log computed from the events table: user_id is the document, event_id the position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DISPLAY_ORDER
from ..operators.replay import LOG_TYPES

# Operation by event_id % 16; every 97th event resets and every 41st rescans a page.
OPS = (
    "add_auto",
    "add_manual",
    "toggle_box",
    "update_box",
    "toggle_category",
    "undo",
    "add_text_select",
    "select",
    "undo",
    "add_auto",
    "redo",
    "focus",
    "delete_box",
    "undo",
    "rescan_box",
    "redo",
)
RESET_EVERY, RESCAN_EVERY, N_BOXES, N_PAGES = 97, 41, 10, 3


def review_log(events: DataFrame) -> DataFrame:
    k = F.col("event_id").cast("bigint")
    op: Column = F.element_at(F.array(*[F.lit(o) for o in OPS]), (k % len(OPS) + 1).cast("int"))
    op = F.when(k % RESET_EVERY == 0, "reset").when(k % RESCAN_EVERY == 0, "rescan").otherwise(op)
    categories = F.array(*[F.lit(c) for c in DISPLAY_ORDER])
    base = events.select(
        F.col("user_id").cast("bigint").alias("doc_id"), k.alias("seq"), op.alias("op"), k.alias("k")
    )
    drawn = F.col("op").isin("add_auto", "add_manual", "add_text_select", "rescan_box") | (
        (F.col("op") == "update_box") & (F.col("k") % 4 == 3)
    )
    left, top = (F.col("k") % 50).cast("double"), (F.col("k") % 70).cast("double")
    values = {
        "box_id": F.when(
            ~F.col("op").isin("undo", "redo", "reset", "rescan", "toggle_category"),
            F.concat(F.lit("b"), (F.col("k") * 7 % N_BOXES).cast("string")),
        ),
        "category": F.when(
            F.col("op").isin("add_auto", "rescan_box", "toggle_category"),
            F.element_at(categories, (F.col("k") * 3 % len(DISPLAY_ORDER) + 1).cast("int")),
        ),
        "page_index": F.col("k") % N_PAGES,
        "x0": F.when(drawn, left),
        "y0": F.when(drawn, top),
        "x1": F.when(drawn, left + 20),
        "y1": F.when(drawn, top + 10),
        "label": F.when(F.col("op").isin("add_manual", "update_box"), F.concat(F.lit("l"), (F.col("k") % 5).cast("string"))),
        "enabled": F.when((F.col("op") == "update_box") & (F.col("k") % 3 == 0), F.col("k") % 2 == 0),
    }
    return base.select(*[values.get(n, F.col(n) if n in base.columns else F.lit(None)).cast(t).alias(n) for n, t in LOG_TYPES.items()])
