"""Expressions over boxes; a box is a struct or columns of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x", "y", "width", "height")


def iou(a: dict[str, Column] | Column, b: dict[str, Column] | Column) -> Column:
    """Intersection over union; 0 without overlap or area."""
    width = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    shared = width * height
    union = a["width"] * a["height"] + b["width"] * b["height"] - shared
    return F.when((width <= 0) | (height <= 0) | (union <= 0), 0.0).otherwise(shared / union)


def to_pixels(box: Column | dict, image_width: Column, image_height: Column) -> dict[str, Column]:
    """left, top, width, height in whole pixels inside the image, one at least."""
    left = F.greatest(F.lit(0), F.least((box["x"] * image_width).cast("int"), image_width - 1))
    top = F.greatest(F.lit(0), F.least((box["y"] * image_height).cast("int"), image_height - 1))
    width = F.greatest(F.lit(1), F.least((box["width"] * image_width).cast("int"), image_width - left))
    height = F.greatest(F.lit(1), F.least((box["height"] * image_height).cast("int"), image_height - top))
    return {"left": left, "top": top, "width": width, "height": height}


def to_fractions(left: Column, top: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> dict[str, Column]:
    return {"x": left / image_width, "y": top / image_height, "width": width / image_width, "height": height / image_height}


def clamped(box: dict[str, Column] | Column, least: float = 0.01) -> dict[str, Column]:
    """The box moved and cut to lie in the unit square, ``least`` wide and high."""
    width = F.least(F.greatest(box["width"], F.lit(least)), F.lit(1.0))
    height = F.least(F.greatest(box["height"], F.lit(least)), F.lit(1.0))
    return {"x": F.greatest(F.lit(0.0), F.least(box["x"], 1 - width)), "y": F.greatest(F.lit(0.0), F.least(box["y"], 1 - height)), "width": width, "height": height}


def resized(box: dict[str, Column] | Column, handle: str, dx: Column, dy: Column, least: float = 0.01) -> dict[str, Column]:
    """A box whose ``handle`` (n, ne, e, ...) was dragged; the opposite side stays where it is."""
    left, top = box["x"], box["y"]
    right, bottom = left + box["width"], top + box["height"]
    if "w" in handle:
        left = F.greatest(F.lit(0.0), F.least(left + dx, right - least))
    if "e" in handle:
        right = F.least(F.lit(1.0), F.greatest(right + dx, left + least))
    if "n" in handle:
        top = F.greatest(F.lit(0.0), F.least(top + dy, bottom - least))
    if "s" in handle:
        bottom = F.least(F.lit(1.0), F.greatest(bottom + dy, top + least))
    return {"x": left, "y": top, "width": right - left, "height": bottom - top}


def polygon_box(polygon: Column) -> dict[str, Column]:
    """Whole-number bounds of an array of (x, y) arrays."""
    side = lambda k, f: f(F.transform(polygon, lambda p: p[k])).cast("int")
    left, top = side(0, F.array_min), side(1, F.array_min)
    return {"left": left, "top": top, "width": side(0, F.array_max) - left, "height": side(1, F.array_max) - top}


def sub_box(left: Column, width: Column, text: Column, start: Column, size: Column, least: int = 20) -> dict[str, Column]:
    """The part of a text block that a match takes, in proportion to its characters; most of the block counts as all."""
    n = F.length(text)
    share = size / n
    part = (n > 0) & (share <= 0.8)
    return {"left": F.when(part, (left + start / n * width).cast("int")).otherwise(left), "width": F.when(part, F.greatest((share * width).cast("int"), F.lit(least))).otherwise(width)}


def effect_size(strength: Column, width: Column, height: Column) -> dict[str, Column]:
    """Mosaic block and blur radius in pixels for a strength of 1 to 100."""
    block = F.greatest(F.lit(2), (2 + strength / 100 * F.floor(F.least(width, height) / 8)).cast("int"))
    return {"block": block, "radius": F.greatest(F.lit(1), (1 + strength / 100 * 24).cast("int"))}


def from_raw(x1: Column, y1: Column, x2: Column, y2: Column, image_width: Column, image_height: Column) -> dict[str, Column]:
    """Corners of a reader in pixels or fractions (none over 1.5), in any order, as a box in the unit square."""
    fractions = F.greatest(x1, y1, x2, y2) <= 1.5
    scale = lambda v, n: F.least(F.greatest(F.when(fractions, v).otherwise(v / n), F.lit(0.0)), F.lit(1.0))
    left, right = scale(F.least(x1, x2), image_width), scale(F.greatest(x1, x2), image_width)
    top, bottom = scale(F.least(y1, y2), image_height), scale(F.greatest(y1, y2), image_height)
    return {"x": left, "y": top, "width": right - left, "height": bottom - top}
