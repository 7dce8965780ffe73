"""Masking text and checking what is left."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import METADATA_KEYS
from ..functions.matching import mask_spans
from ..functions.sqltext import let
from ..session import stacked
from ..sources.tables import LINE_KEY
from .detect import detect_pages
from .keyfilter import with_maybe
from .rules import ALL_RULES, AnyRule
from .spatial import Layout, offsets_from_geometry


def merge_spans(spans: DataFrame) -> DataFrame:
    """Union of the spans of each line as disjoint spans; spans that touch become one.

    Spans are first reduced to one per start, combined before the shuffle, so that a line contributes at
    most as many rows as it has characters, however many copies of a span there are.
    """
    furthest = spans.where(F.col("start") < F.col("end")).groupBy(*LINE_KEY, "start").agg(F.max("end").alias("end"))
    in_order = Window.partitionBy(*LINE_KEY).orderBy("start")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    marked = furthest.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    island = F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        marked.withColumn("island", island)
        .groupBy(*LINE_KEY, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def placeable(with_lines: bool) -> Column:
    """Whether a box can be found in the text: by its offsets, or by its rectangle where lines have geometry."""
    by_offsets = F.col("start").isNotNull() & F.col("line_no").isNotNull()
    return by_offsets | F.col("x0").isNotNull() if with_lines else by_offsets


def text_spans(boxes: DataFrame, lines: DataFrame | None = None, layout: Layout | None = None) -> DataFrame:
    """Where enabled boxes fall in the text. Drawn and moved boxes need ``lines``; see ``offsets_from_geometry``.

    Boxes that are not ``placeable`` have no span; who masks by these spans has to say how many those are.
    """
    enabled = boxes.where("enabled")
    direct = enabled.where(F.col("start").isNotNull()).select(*LINE_KEY, "start", "end")
    if lines is None:
        return direct
    return stacked(direct, offsets_from_geometry(lines, enabled, layout))


def _page_with_masks(text: str, entries: str) -> str:
    """SQL. ``entries`` are (line_no, spans) in line order. Lines between them are copied in slices."""
    inside = f"filter({entries}, _e -> _e.line_no >= 0 AND _e.line_no < size(_ls))"
    before = "if(_j = 0, 0, _es[_j - 1].line_no + 1)"
    clear = f"slice(_ls, {before} + 1, _e.line_no - {before})"
    masked = let("_line", "_ls[_e.line_no]", mask_spans("_line", "_e.spans"))
    done = f"flatten(transform(_es, (_e, _j) -> concat({clear}, array({masked}))))"
    rest = "slice(_ls, coalesce(element_at(_es, -1).line_no, -1) + 2, size(_ls))"
    page = f"array_join(concat({done}, {rest}), '\\n')"
    page = let("_es", inside, f"if(size(_es) = 0, {text}, {page})")
    return let("_ls", f"split({text}, '\\n', -1)", page)


def redact_text(pages: DataFrame, spans: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Pages with every character the spans cover replaced by the mask; offsets stay valid.

    Spans are merged and gathered per page, which bounds what a page gathers by its own text. Pages and
    gathered spans meet in one join with unique keys on both sides. ``touched`` (doc_id, page_index of all spans, as a
    table that costs little to read) lets pages without a span pass where they lie; only the others are shuffled.
    """
    if touched is not None:
        marked = with_maybe(pages, touched, ["doc_id", "page_index"])
        rest, some = (marked.where(c).drop("maybe") for c in ("NOT maybe", "maybe"))
        return stacked(rest, redact_text(some, spans))
    per_line = merge_spans(spans).groupBy(*LINE_KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    per_page = per_line.groupBy("doc_id", "page_index").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "spans"))).alias("entries")
    )
    joined = pages.join(per_page, ["doc_id", "page_index"], "left")
    text = F.when(F.col("entries").isNull(), F.col("text")).otherwise(F.expr(_page_with_masks("text", "entries")))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in pages.columns])


def clear_metadata(documents: DataFrame) -> DataFrame:
    """Blank the known information fields that exist."""
    return documents.withColumns({k: F.lit("") for k in METADATA_KEYS if k in documents.columns})


def post_check(pages: DataFrame, rules: Iterable[AnyRule] = ALL_RULES) -> DataFrame:
    """doc_id, leaks: how much all rules still find, for every document that has a page."""
    found = detect_pages(pages, rules).select("doc_id", F.lit(1).alias("n"))
    both = stacked(found, pages.select("doc_id", F.lit(0).alias("n")))
    return both.groupBy("doc_id").agg(F.sum("n").alias("leaks"))
