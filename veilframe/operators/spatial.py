"""Joining boxes on a page by overlap.

Lines and drawn rectangles are assigned to horizontal strips of the page, and only those that share a strip meet; so
a crowded page is split over its strips and no page is compared all against all. A rectangle is first cut to where the
page has lines, so it covers no more strips than these do, however large it is. Characters never meet rectangles in
a join of their own: each line gathers the rectangles over it, and its characters are tried in place.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions.geometry import XY, box_of, intersects, overlaps
from ..session import materialize
from ..sources.tables import LINE_KEY
from .extract import edges_of, spans_of_lines
from .glyph_runs import glyph_fields, one_array, over_glyphs, packed_once

STRIP = 64.0
AT_ONCE = 1 << 20  # pairs of a glyph and an area that are tried at a time
PAGE = ("doc_id", "page_index")
GLYPH = StructType([StructField("char_no", IntegerType()), StructField("ch", StringType()), StructField("quad", ArrayType(DoubleType()))])
Layout = Callable[[DataFrame], DataFrame]


def strips(top: str, bottom: str) -> Column:
    """array<bigint> of the strips from ``top`` to ``bottom``; empty where ``bottom`` is above ``top``."""
    first, last = f"bigint(floor({top} / {STRIP}))", f"bigint(floor({bottom} / {STRIP}))"
    return F.expr(f"if({bottom} >= {top}, sequence({first}, {last}), cast(array() AS array<bigint>))")


def _met(boxes: DataFrame, rects: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``boxes`` (page, x0..y1) and ``rects`` (page, dx0..dy1) that share a strip and fulfil the condition."""
    extent = boxes.groupBy(*PAGE).agg(F.min("y0").alias("_top"), F.max("y1").alias("_bottom"))
    cut = rects.join(extent, list(PAGE)).withColumn("strip", F.explode(strips("greatest(dy0, _top)", "least(dy1, _bottom)")))
    striped = boxes.withColumn("strip", F.explode(strips("y0", "y1"))).hint("merge")  # not told by the size of the text's files
    return striped.join(cut.drop("_top", "_bottom"), [*PAGE, "strip"]).where(condition)


def text_select_boxes(spans: DataFrame, drawn: DataFrame) -> DataFrame:
    """One box per drawn rectangle that touches text: the box around the spans it touches.

    ``drawn`` is doc_id, page_index, selection_id and a rectangle in page points. Equal rectangles and equal
    span boxes are matched once. A pair may meet in several strips; minimum and maximum do not mind.
    """
    rect = [f"d{k}" for k in XY]
    drawn = drawn.select(*PAGE, "selection_id", *[F.col(k).alias(f"d{k}") for k in XY])
    met = _met(spans.select(*PAGE, *XY).distinct(), drawn.select(*PAGE, *rect).distinct(), intersects(box_of(), box_of("d")))
    around = met.groupBy(*PAGE, *rect).agg(*[(F.min if k in ("x0", "y0") else F.max)(k).alias(k) for k in XY])
    return drawn.join(around, [*PAGE, *rect]).select(*PAGE, "selection_id", *XY)


def _line_areas(line_boxes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Line key and ``areas``, the distinct rectangles of enabled boxes over the line, of lines that have any."""
    areas = boxes.where(F.col("enabled") & F.col("x0").isNotNull())
    rects = areas.select(*PAGE, *[F.col(k).alias(f"d{k}") for k in XY]).distinct()
    met = _met(line_boxes.select(*LINE_KEY, *XY), rects, overlaps(box_of(), box_of("d")))
    area = F.struct(*[F.col(f"d{k}").alias(k) for k in XY])
    return met.groupBy(*LINE_KEY).agg(F.collect_set(area).alias("areas"))


def _covered(box: dict[str, Column], areas: Column) -> Column:
    return F.exists(areas, lambda a: overlaps(box, {k: a[k] for k in XY}))


def _boxes_of(quads: pa.Array) -> list[pa.Array]:
    """x0, y0, x1, y1 as ``quad_to_box`` has them: corners that are missing don't count, NaN is the largest number."""
    n, sizes = len(quads), pc.list_value_length(quads)
    if quads.null_count or quads.flatten().null_count or n and pc.min(sizes).as_py() < 8:
        rows = [([*(q or ()), *[None] * 8])[:8] for q in quads.to_pylist()]
        corners = [pa.array([q[i] for q in rows], pa.float64()) for i in range(8)]
    else:
        firsts = quads.offsets.to_numpy()[:-1]
        values = quads.values.to_numpy(zero_copy_only=False)
        corners = [pa.array(values[firsts + i]) for i in range(8)]
    order = [pc.if_else(pc.is_nan(c), np.inf, c) for c in corners]  # for the least; the greatest keeps NaN
    out = []
    for least, at in ((True, 0), (True, 1), (False, 0), (False, 1)):
        some = (order if least else corners)[at::2]
        if least:
            edge = pc.min_element_wise(*some)
            all_nan = reduce(pc.and_, [pc.fill_null(pc.is_nan(c), True) for c in corners[at::2]])
            out.append(pc.if_else(pc.and_(all_nan, edge.is_valid()), np.nan, edge))
        else:
            any_nan = reduce(pc.or_, [pc.fill_null(pc.is_nan(c), False) for c in some])
            out.append(pc.if_else(any_nan, np.nan, pc.max_element_wise(*some)))
    return out


def _for_test(boxes: Sequence[pa.Array]) -> list[np.ndarray]:
    """Coordinates as numbers that compare as Spark's do: NaN is the largest, and a null fails no comparison."""
    return [np.nan_to_num(b.fill_null(-np.inf if k < 2 else np.inf).to_numpy(zero_copy_only=False), nan=np.inf, posinf=np.inf, neginf=-np.inf) for k, b in enumerate(boxes)]


def _uncovered(lines: pa.RecordBatch, glyphs: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    """The glyphs that no area of their line overlaps, each with its line's key."""
    stays, areas = np.ones(len(glyphs), bool), lines.column("areas")
    struct = areas.flatten()
    tested = _for_test([struct.field(k) for k in XY])
    sizes = pc.list_value_length(areas).fill_null(0).to_numpy(zero_copy_only=False)
    last = np.cumsum(sizes)
    starts = np.concatenate([[0], ends[:-1]])
    under = np.flatnonzero(sizes)
    x0, y0, x1, y1 = _for_test(_boxes_of(one_array(glyphs["quad"]))) if len(under) else (None,) * 4
    for i in under.tolist():
        g, step = slice(starts[i], ends[i]), max(1, AT_ONCE // int(ends[i] - starts[i]))
        for a in range(last[i] - sizes[i], last[i], step):
            ax0, ay0, ax1, ay1 = (t[a : min(a + step, last[i]), None] for t in tested)
            stays[g] &= ~((x0[g] < ax1) & (ax0 < x1[g]) & (y0[g] < ay1) & (ay0 < y1[g])).any(axis=0)
    line = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[stays]
    left = glyphs if stays.all() else glyphs.filter(pa.array(stays)).combine_chunks()
    return pa.RecordBatch.from_arrays([*[lines.column(k).take(pa.array(line)) for k in LINE_KEY], *map(one_array, left.columns)], names=[*LINE_KEY, *left.column_names])


def _extents(runs: pa.RecordBatch, glyphs: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    edges = edges_of(_boxes_of(one_array(glyphs["quad"])), ends)
    return pa.RecordBatch.from_arrays([*[runs.column(k) for k in LINE_KEY], *edges.values()], names=[*LINE_KEY, *edges])


def redact_glyphs(glyphs: DataFrame, boxes: DataFrame, in_buckets: bool = False) -> DataFrame:
    """Glyphs that no enabled box overlaps. Glyphs that only touch a box stay.

    What meets the areas over a line are its packed runs of glyphs. With ``in_buckets`` the runs come from a table in buckets by
    line (``sources.bucketed.bucketed_glyphs``), and none is moved at all.
    """
    fields = GLYPH if in_buckets else glyph_fields(glyphs)
    runs = glyphs if in_buckets else packed_once(glyphs)
    keys = [glyphs.schema[k] for k in LINE_KEY]
    alone = runs.select(*LINE_KEY, F.array("run").alias("runs"))
    extents = over_glyphs(alone, fields, _extents, StructType([*keys, *[StructField(k, DoubleType()) for k in XY]]))
    edges = [(F.min if k in ("x0", "y0") else F.max)(k).alias(k) for k in XY]
    line_boxes = materialize(extents.groupBy(*LINE_KEY).agg(*edges), "line-boxes")  # read twice
    joined = runs.join(_line_areas(line_boxes, boxes), list(LINE_KEY), "left")
    left = over_glyphs(joined.select(*LINE_KEY, "areas", F.array("run").alias("runs")), fields, _uncovered, StructType([*keys, *fields]))
    return left if in_buckets else left.select(*glyphs.columns)


def offsets_from_geometry(lines: DataFrame, boxes: DataFrame, layout: Layout | None = None) -> DataFrame:
    """line key, start, end of every run of characters that enabled boxes without offsets overlap.

    This is how drawn and moved boxes reach the text. ``lines`` carry ``char_bboxes``; or, with ``layout``, their own box
    alone, and ``layout`` adds ``char_bboxes`` to those lines that are under some rectangle. A line's characters are
    tried in place, and only what is hit becomes rows, one for each run. Lines are never broadcast: Spark goes by the size of
    their compressed files, and with a box per character they take many times that.
    """
    boxed = spans_of_lines(lines) if layout is None else lines.where(F.col("x0").isNotNull())
    under = lines.hint("merge").join(_line_areas(boxed, boxes.where(F.col("start").isNull())), list(LINE_KEY))
    under = under if layout is None else layout(under)
    hit = F.transform("char_bboxes", lambda b: _covered({k: b[k] for k in XY}, F.col("areas")))
    tried = under.select(*LINE_KEY, hit.alias("hit")).where("exists(hit, h -> h)")
    edge = "filter(sequence(0, size(hit) - 1), i -> hit[i] AND NOT coalesce(get(hit, i {step}), false))"
    starts, ends = (edge.format(step=step) for step in ("- 1", "+ 1"))
    ended = tried.selectExpr(*LINE_KEY, f"{starts} AS starts", f"{ends} AS ends")
    return ended.selectExpr(*LINE_KEY, "inline(transform(starts, (s, i) -> named_struct('start', s, 'end', ends[i] + 1)))")
