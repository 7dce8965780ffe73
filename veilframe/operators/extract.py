"""Glyphs to lines and spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StringType, StructField, StructType

from ..functions.geometry import XY, columns, quad_to_box
from ..sources.tables import LINE_KEY
from .glyph_runs import Work, glyph_fields, one_array, over_glyphs, packed_once, string_parts, strings


def glyph_boxes(glyphs: DataFrame) -> DataFrame:
    """The upright box around each glyph's four corners, in place of the corners."""
    return glyphs.select(*LINE_KEY, "char_no", "ch", *columns(quad_to_box(F.col("quad"))))


BOXES = ArrayType(StructType([StructField(k, DoubleType()) for k in XY]))


def _in_order(glyphs: pa.Table, ends: np.ndarray) -> pa.Table:
    """Glyphs of each line by number, and those of one number by character and box. Mostly they come so."""
    numbers, starts = one_array(glyphs["char_no"]), ends[:-1]
    n = numbers.fill_null(-1).to_numpy(zero_copy_only=False)
    rising = n[1:] > n[:-1]
    rising[starts - 1] = True
    if rising.all() and not numbers.null_count:
        return glyphs
    line = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    by = {"line": pa.array(line), "char_no": glyphs["char_no"], "ch": glyphs["ch"]}
    for k in XY:  # NaN is the largest
        by |= {f"{k}_nan": pc.cast(pc.is_nan(glyphs[k]), pa.int8()), k: glyphs[k]}
    order = pc.sort_indices(pa.table(by), sort_keys=[(k, "ascending") for k in by], null_placement="at_start")
    return glyphs.take(order).combine_chunks()


def _text(glyphs: pa.Table, ends: np.ndarray) -> pa.Array:
    edges, data = string_parts(one_array(glyphs["ch"]).fill_null(""))
    return strings((edges - edges[0])[np.concatenate([[0], ends])], bytes(data[edges[0] : edges[-1]]))


def _keyed(lines: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[lines.column(k) for k in LINE_KEY], *columns.values()], names=[*LINE_KEY, *columns])


def _with_boxes(lines: pa.RecordBatch, glyphs: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    glyphs = _in_order(glyphs, ends)
    lengths = pc.utf8_length(one_array(glyphs["ch"])).fill_null(0).to_numpy(zero_copy_only=False)
    if (lengths != 1).any():
        boxes = glyphs.take(pa.array(np.repeat(np.arange(len(lengths)), lengths))).combine_chunks()
        at = np.cumsum(lengths)[ends - 1]
    else:
        boxes, at = glyphs, ends
    boxes = pa.StructArray.from_arrays([one_array(boxes[k]) for k in XY], names=list(XY))
    boxes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at]), pa.int32()), boxes)
    return _keyed(lines, {"text": _text(glyphs, ends), "char_bboxes": boxes})


def _with_edges(lines: pa.RecordBatch, glyphs: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    glyphs = _in_order(glyphs, ends)
    return _keyed(lines, {"text": _text(glyphs, ends)} | edges_of([one_array(glyphs[k]) for k in XY], ends))


def edges_of(boxes: list[pa.Array], ends: np.ndarray) -> dict[str, pa.Array]:
    """The box around the boxes (x0, y0, x1, y1) of each line. Nulls don't count, NaN is the largest number."""
    starts, out = np.concatenate([[0], ends[:-1]]), {}
    for k, column in zip(XY, boxes):
        there = column.is_valid().to_numpy(zero_copy_only=False)
        low = k in ("x0", "y0")
        values = column.fill_null(np.inf if low else -np.inf).to_numpy(zero_copy_only=False)
        edge = (np.fmin if low else np.maximum).reduceat(values, starts)
        if low:  # an infinity that stands for null is not to hide a line of NaN
            edge = np.where(np.logical_and.reduceat(np.isnan(values) | ~there, starts), np.nan, edge)
        out[k] = pa.array(edge, mask=~np.logical_or.reduceat(there, starts))
    return out


def _of_lines(glyphs: DataFrame, work: Work, **columns: DataType) -> DataFrame:
    """``work`` on each line's glyphs. What is moved are packed runs of glyphs."""
    boxed = glyph_boxes(glyphs)
    runs = packed_once(boxed).groupBy(*LINE_KEY).agg(F.collect_list("run").alias("runs"))
    out = StructType([*[glyphs.schema[k] for k in LINE_KEY], *[StructField(c, kind) for c, kind in columns.items()]])
    return over_glyphs(runs, glyph_fields(boxed), work, out)


def extract_lines(glyphs: DataFrame) -> DataFrame:
    """Text and ``char_bboxes`` of each non-empty line; a group never holds more than one line of text.

    A glyph of several characters gives its box to each of them.
    """
    lines = _of_lines(glyphs, _with_boxes, text=StringType(), char_bboxes=BOXES)
    return lines.where((F.length("text") > 0) & (F.size("char_bboxes") == F.length("text")))


def extract_spans(glyphs: DataFrame) -> DataFrame:
    """Text of each non-empty line with the box around it."""
    spans = _of_lines(glyphs, _with_edges, text=StringType(), **{k: DoubleType() for k in XY})
    return spans.where(F.length("text") > 0)


def spans_of_lines(lines: DataFrame) -> DataFrame:
    """As ``extract_spans`` for lines that already carry ``char_bboxes``; needs no shuffle."""

    def edge(name: str) -> Column:
        pick = F.array_min if name in ("x0", "y0") else F.array_max
        return pick(F.transform("char_bboxes", lambda b: b[name])).alias(name)

    return lines.where(F.length("text") > 0).select(*LINE_KEY, "text", *[edge(k) for k in XY])
