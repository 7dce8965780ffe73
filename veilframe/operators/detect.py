"""Detection: pages or lines in, candidates out, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import XY
from ..functions.sqltext import let
from ..sources.tables import LINE_KEY, lines_of
from .rules import ALL_RULES, AnyRule, all_matches, any_possible


def candidate_id(*parts: Column) -> Column:
    """The same for the same match however often a task runs."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def union_box(char_boxes: str, start: str, end: str) -> str:
    """SQL for the box around characters start..end; null when there are none."""

    edges = ", ".join(f"'{k}', array_{'min' if k in ('x0', 'y0') else 'max'}(transform(_bs, _b -> _b.{k}))" for k in XY)
    covered = f"slice({char_boxes}, {start} + 1, greatest({end} - {start}, 0))"
    return let("_bs", covered, f"if(size(_bs) > 0, named_struct({edges}), null)")


def run_detectors(lines: DataFrame, rules: Iterable[AnyRule] = ALL_RULES) -> DataFrame:
    """doc_id, page_index, line_no, category, start, end, matched, confidence, id [, x0, y0, x1, y1].

    One pass over the lines and one explode, whatever the number of rules. Matches of different rules may
    overlap and all are kept. Where the lines carry ``char_bboxes``, candidates get the box around their
    characters, and a match without characters is dropped.
    """
    rules = tuple(rules)
    boxed = "char_bboxes" in lines.columns
    possible = lines.where(any_possible("text", rules))
    if boxed:
        # Boxes are found before matches become rows, so no row carries its line's characters.
        box = union_box("char_bboxes", "_m.start", "_m.end")
        placed = f"filter(transform(_found, _m -> named_struct('m', _m, 'box', {box})), _p -> _p.box IS NOT NULL)"
        found = possible.withColumn("_found", all_matches("text", rules)).select(*LINE_KEY, F.expr(f"inline({placed})"))
    else:
        found = possible.select(*LINE_KEY, F.explode(all_matches("text", rules)).alias("m"))
    key = [F.col(k) for k in LINE_KEY]
    columns = [
        *key,
        F.col("m.category"),
        F.col("m.start"),
        F.col("m.end"),
        F.col("m.matched"),
        F.col("m.confidence"),
        candidate_id(*key, F.col("m.category"), F.col("m.start")).alias("id"),
    ]
    return found.select(*columns, *([F.col(f"box.{k}") for k in XY] if boxed else []))


def detect_pages(pages: DataFrame, rules: Iterable[AnyRule] = ALL_RULES) -> DataFrame:
    """Candidates of whole pages. Pages no rule can match are left out before they are split into lines."""
    rules = tuple(rules)
    return run_detectors(lines_of(pages.where(any_possible("text", rules))), rules)


def detect_page(pages: DataFrame, page_index: int, rules: Iterable[AnyRule] = ALL_RULES) -> DataFrame:
    """Candidates of one page of every document; the filter reaches the scan."""
    return detect_pages(pages.where(F.col("page_index") == page_index), rules)
