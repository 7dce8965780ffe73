"""A grid layout: every character of a line is one cell of fixed width and height.

It places text that comes without geometry, and stands in for a page-layout extractor in tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import LINE_KEY

ADVANCE = 6.0
LINE_HEIGHT = 12.0


def grid_lines(lines: DataFrame) -> DataFrame:
    """Adds ``char_bboxes``: one box per character."""
    box = (
        f"named_struct('x0', _i * {ADVANCE}D, 'y0', line_no * {LINE_HEIGHT}D, "
        f"'x1', (_i + 1) * {ADVANCE}D, 'y1', (line_no + 1) * {LINE_HEIGHT}D)"
    )
    positions = "if(length(text) > 0, sequence(0, length(text) - 1), cast(array() AS array<int>))"
    return lines.withColumn("char_bboxes", F.expr(f"transform({positions}, _i -> {box})"))


def grid_spans(lines: DataFrame) -> DataFrame:
    """Text and box of each non-empty line, without laying out its characters."""
    return lines.where("length(text) > 0").selectExpr(
        *LINE_KEY,
        "text",
        "0D AS x0",
        f"line_no * {LINE_HEIGHT}D AS y0",
        f"length(text) * {ADVANCE}D AS x1",
        f"(line_no + 1) * {LINE_HEIGHT}D AS y1",
    )


def grid_glyphs(lines: DataFrame) -> DataFrame:
    """doc_id, page_index, line_no, char_no, ch, quad (corners as x, y pairs)."""
    chars = F.regexp_extract_all(F.col("text"), F.lit("(?s)."), F.lit(0))
    glyphs = lines.select(*LINE_KEY, F.posexplode(chars).alias("char_no", "ch"))
    left, right = f"char_no * {ADVANCE}D", f"(char_no + 1) * {ADVANCE}D"
    top, bottom = f"line_no * {LINE_HEIGHT}D", f"(line_no + 1) * {LINE_HEIGHT}D"
    quad = F.expr(f"array({left}, {top}, {right}, {top}, {left}, {bottom}, {right}, {bottom})")
    return glyphs.withColumn("quad", quad)
