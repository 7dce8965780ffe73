"""Boxes are four doubles x0, y0, x1, y1 in page points, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import HANDLES

XY = ("x0", "y0", "x1", "y1")
Box = dict[str, Column]


def box_of(prefix: str = "") -> Box:
    return {k: F.col(f"{prefix}{k}") for k in XY}


def normalized(box: Box) -> Box:
    return {
        "x0": F.least(box["x0"], box["x1"]),
        "y0": F.least(box["y0"], box["y1"]),
        "x1": F.greatest(box["x0"], box["x1"]),
        "y1": F.greatest(box["y0"], box["y1"]),
    }


def pdf_to_canvas(box: Box, scale: Column) -> Box:
    return {k: v * scale for k, v in box.items()}


def canvas_to_pdf(box: Box, scale: Column) -> Box:
    return {k: v / scale for k, v in box.items()}


def intersects(a: Box, b: Box) -> Column:
    """Closed test: boxes that only touch do intersect."""
    return ~((a["x1"] < b["x0"]) | (b["x1"] < a["x0"]) | (a["y1"] < b["y0"]) | (b["y1"] < a["y0"]))


def overlaps(a: Box, b: Box) -> Column:
    """Open test: boxes that only touch do not overlap."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def move(box: Box, dx: Column, dy: Column) -> Box:
    return {"x0": box["x0"] + dx, "y0": box["y0"] + dy, "x1": box["x1"] + dx, "y1": box["y1"] + dy}


def resize(box: Box, handle: Column, dx: Column, dy: Column) -> Box:
    """``handle`` is an index into HANDLES; each edge follows the handles that carry its letter."""

    def edge(name: str, letter: str, delta: Column) -> Column:
        followers = [i for i, h in enumerate(HANDLES) if letter in h]
        return F.when(handle.isin(followers), box[name] + delta).otherwise(box[name])

    return normalized(
        {
            "x0": edge("x0", "W", dx),
            "y0": edge("y0", "N", dy),
            "x1": edge("x1", "E", dx),
            "y1": edge("y1", "S", dy),
        }
    )


def larger_than(box: Box, pixels: float) -> Column:
    return ((box["x1"] - box["x0"]) > pixels) & ((box["y1"] - box["y0"]) > pixels)


def quad_to_box(quad: Column) -> Box:
    """``quad`` holds the corners as x, y pairs: upper left, upper right, lower left, lower right."""
    xs = [F.get(quad, F.lit(i)) for i in (0, 2, 4, 6)]
    ys = [F.get(quad, F.lit(i)) for i in (1, 3, 5, 7)]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def normalize_rotation(raw: Column) -> Column:
    turned = F.pmod(raw, F.lit(360.0))
    return F.coalesce(F.when(turned.isin(90.0, 180.0, 270.0), turned.cast("int")), F.lit(0))


def columns(box: Box) -> list[Column]:
    return [v.alias(k) for k, v in box.items()]
