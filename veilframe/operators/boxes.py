"""Review boxes: made from candidates or gestures, filtered, toggled, edited, replaced.

A box is doc_id, id, page_index, x0..y1, source, category, label, enabled, and for boxes made by detection
the line_no, start and end they came from. Boxes never carry the text they cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import MIN_DRAW_PX, MIN_EDIT_PX
from ..functions.geometry import XY, box_of, canvas_to_pdf, larger_than, move, normalized, pdf_to_canvas, resize
from ..session import stacked
from .detect import candidate_id
from .skew import lookup
from .spatial import text_select_boxes

AUTO, MANUAL_RECT, TEXT_SELECT = "auto", "manual-rect", "text-select"
BOX_TYPES = {
    "doc_id": "bigint",
    "id": "string",
    "page_index": "int",
    "x0": "double",
    "y0": "double",
    "x1": "double",
    "y1": "double",
    "source": "string",
    "category": "string",
    "label": "string",
    "enabled": "boolean",
    "line_no": "int",
    "start": "int",
    "end": "int",
}
BOX_COLUMNS = tuple(BOX_TYPES)


def as_boxes(df: DataFrame, **values: Column) -> DataFrame:
    """Box columns from ``values``, else from ``df``, else null."""

    def column(name: str, kind: str) -> Column:
        if name in values:
            value = values[name]
        else:
            value = F.col(name) if name in df.columns else F.lit(None)
        return value.cast(kind).alias(name)

    return df.select(*[column(n, k) for n, k in BOX_TYPES.items()])


def boxes_from_candidates(candidates: DataFrame, policy: DataFrame | Column | None = None) -> DataFrame:
    """Auto boxes, enabled as the document's policy for their category says (on where it says nothing).

    The policy is a table, or, where it follows from a candidate's own columns, a condition that needs no join.
    """
    if isinstance(policy, Column):
        return as_boxes(candidates, source=F.lit(AUTO), enabled=F.coalesce(policy, F.lit(True)))
    if policy is None:
        return as_boxes(candidates, source=F.lit(AUTO), enabled=F.lit(True))
    off = policy.where(~F.col("enabled")).select("doc_id", "category").distinct().withColumn("off", F.lit(True))
    joined = lookup(candidates, off, ["doc_id", "category"])
    return as_boxes(joined, source=F.lit(AUTO), enabled=F.col("off").isNull())


def replace_auto_boxes(boxes: DataFrame, fresh: DataFrame, rescanned: DataFrame) -> DataFrame:
    """The auto boxes of the rescanned (doc_id, page_index) give way to the fresh ones; others stay."""
    marks = rescanned.select("doc_id", "page_index").distinct().withColumn("again", F.lit(True))
    marked = lookup(boxes, marks, ["doc_id", "page_index"])
    gone = (F.col("source") == AUTO) & F.col("again").isNotNull()
    return stacked(as_boxes(marked.where(~gone)), as_boxes(fresh))


def drawn_rectangles(selections: DataFrame) -> DataFrame:
    """Selections in page points; those of 3 canvas pixels or less in width or height are ignored."""
    drawn = normalized(box_of())
    page = canvas_to_pdf(drawn, F.col("scale"))
    return selections.where(larger_than(drawn, MIN_DRAW_PX)).select(
        *[c for c in selections.columns if c not in XY], *[v.alias(k) for k, v in page.items()]
    )


def _selection_box_id(source: str) -> Column:
    return candidate_id(F.col("doc_id"), F.col("page_index"), F.lit(source), F.col("selection_id"))


def manual_boxes(selections: DataFrame) -> DataFrame:
    rects = drawn_rectangles(selections.where(F.col("mode") == "rect"))
    return as_boxes(
        rects, id=_selection_box_id(MANUAL_RECT), source=F.lit(MANUAL_RECT), enabled=F.lit(True)
    )


def selected_text_boxes(selections: DataFrame, spans: DataFrame) -> DataFrame:
    rects = drawn_rectangles(selections.where(F.col("mode") == "text"))
    around = text_select_boxes(spans, rects)
    return as_boxes(
        around, id=_selection_box_id(TEXT_SELECT), source=F.lit(TEXT_SELECT), enabled=F.lit(True)
    )


def toggle_boxes(boxes: DataFrame, toggles: DataFrame) -> DataFrame:
    """Flip the named (doc_id, id) once for each time they are named; unknown ones are ignored."""
    flips = toggles.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("flips"))
    joined = boxes.join(flips, ["doc_id", "id"], "left")
    odd = F.coalesce(F.col("flips"), F.lit(0)) % 2 == 1
    return as_boxes(joined, enabled=F.col("enabled") != odd)


def toggle_policy(policy: DataFrame, toggles: DataFrame) -> DataFrame:
    """The policy after flipping the named (doc_id, category); what it says nothing about is on."""
    named = toggles.select("doc_id", "category").distinct()
    rows = stacked(
        policy.select("doc_id", "category", "enabled", F.lit(0).alias("flip")),
        named.select("doc_id", "category", F.lit(1).alias("flip")),
    )
    merged = rows.groupBy("doc_id", "category").agg(
        F.coalesce(F.bool_and("enabled"), F.lit(True)).alias("was"), F.max("flip").alias("flip")
    )
    return merged.select("doc_id", "category", (F.col("was") != (F.col("flip") == 1)).alias("enabled"))


def toggle_category(boxes: DataFrame, policy: DataFrame, toggles: DataFrame) -> DataFrame:
    """Auto boxes of each toggled (doc_id, category) take the category's new policy."""
    named = toggles.select("doc_id", "category").distinct()
    after = toggle_policy(policy, toggles).join(named, ["doc_id", "category"], "left_semi")
    after = after.withColumnRenamed("enabled", "now")
    joined = lookup(boxes, after, ["doc_id", "category"])
    affected = (F.col("source") == AUTO) & F.col("now").isNotNull()
    return as_boxes(joined, enabled=F.when(affected, F.col("now")).otherwise(F.col("enabled")))


def edit_boxes(boxes: DataFrame, gestures: DataFrame) -> DataFrame:
    """Move or resize boxes by one gesture each: doc_id, id, kind, handle, dx, dy (canvas pixels), scale.

    Of several gestures for one box the last counts, by ``seq`` where there is one. A result of 1 canvas pixel or
    less in width or height is not taken over. A box that has moved no longer is where it was found: its offsets
    go, and it reaches the text by its rectangle.
    """
    fields = ("kind", "handle", "dx", "dy", "scale")
    order = ["seq", *fields] if "seq" in gestures.columns else fields
    last = gestures.groupBy("doc_id", "id").agg(F.max(F.struct(*order)).alias("last"))
    joined = boxes.join(last.select("doc_id", "id", *[F.col(f"last.{f}") for f in fields]), ["doc_id", "id"], "left")
    shown = pdf_to_canvas(box_of(), F.col("scale"))
    moved = move(shown, F.col("dx"), F.col("dy"))
    resized = resize(shown, F.col("handle"), F.col("dx"), F.col("dy"))
    pending = {k: F.when(F.col("kind") == "move", moved[k]).otherwise(resized[k]) for k in XY}
    taken = F.col("kind").isNotNull() & larger_than(pending, MIN_EDIT_PX)
    page = canvas_to_pdf(pending, F.col("scale"))
    edited = {k: F.when(taken, page[k]).otherwise(F.col(k)) for k in XY}
    return as_boxes(joined, **edited, **{k: F.when(~taken, F.col(k)) for k in ("line_no", "start", "end")})


def delete_boxes(boxes: DataFrame, deletions: DataFrame) -> DataFrame:
    return boxes.join(deletions.select("doc_id", "id"), ["doc_id", "id"], "left_anti").select(boxes.columns)


def boxes_for_page(boxes: DataFrame, page_index: int) -> DataFrame:
    return boxes.where(F.col("page_index") == page_index)


def enabled_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.where("enabled")


def last_write_wins(writes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest ``order`` of each key; combined before the shuffle, so hot keys stay small."""
    rest = [c for c in writes.columns if c not in keys]
    newest = writes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row"))
    return newest.select(*keys, "row.*").select(writes.columns)


def newest_scans(scans: DataFrame) -> DataFrame:
    """doc_id, page_index and the highest scan_seq of each page."""
    return scans.groupBy("doc_id", "page_index").agg(F.max("scan_seq").alias("scan_seq"))


def latest_scan_wins(results: DataFrame, scans: DataFrame) -> DataFrame:
    """Results (doc_id, page_index, scan_seq, ...) of the newest scan of each page.

    ``scans`` (doc_id, page_index, scan_seq) has every scan, also those that found nothing: a page whose newest
    scan is empty has no results. It holds no text, so the newest scans are known without any detection.
    """
    return results.join(newest_scans(scans), ["doc_id", "page_index", "scan_seq"], "left_semi").select(results.columns)
