"""Rectangles as ``struct<x1,y1,x2,y2>``: half-open, areas floored at 1. Anything about a null box is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# When two boxes may be the same block, and the weights of the match score.
GATE_IOU, GATE_HEIGHTS = 0.15, 2.5
WEIGHTS = {"iou": 0.45, "center": 0.25, "size": 0.15, "lang": 0.10, "text": 0.05}


def _known(value: Column, *boxes: Column) -> Column:
    """The value, or null where a box or one of its edges is null; ``greatest`` and ``least`` would skip it."""
    edges = [b[e] for b in boxes for e in ("x1", "y1", "x2", "y2")]
    whole = edges[0].isNotNull()
    for e in edges[1:]:
        whole = whole & e.isNotNull()
    return F.when(whole, value)


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return _known(F.greatest(F.lit(1), width(b) * height(b)), b)


def intersection_area(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return _known(F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h), a, b)


def iou(a: Column, b: Column) -> Column:
    i = intersection_area(a, b)
    return F.when(i > 0, i / (area(a) + area(b) - i)).when(i == 0, 0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection by the smaller area."""
    return intersection_area(a, b) / F.least(area(a), area(b))


def size_ratio(a: Column, b: Column) -> Column:
    return F.least(area(a), area(b)) / F.greatest(area(a), area(b))


def overlaps(a: Column, b: Column, pad: int = 0) -> Column:
    """Edges that touch overlap."""
    return (a["x1"] - pad <= b["x2"]) & (b["x1"] <= a["x2"] + pad) & (a["y1"] - pad <= b["y2"]) & (b["y1"] <= a["y2"] + pad)


def contains(a: Column, b: Column) -> Column:
    return (a["x1"] <= b["x1"]) & (a["y1"] <= b["y1"]) & (a["x2"] >= b["x2"]) & (a["y2"] >= b["y2"])


def union(a: Column, b: Column) -> Column:
    return _known(F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2")), a, b)


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle; null where there is none."""
    box = F.struct(F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"), F.least(a["x2"], b["x2"]).alias("x2"), F.least(a["y2"], b["y2"]).alias("y2"))
    return F.when(intersection_area(a, b) > 0, box)


def expanded(b: Column, pad: int) -> Column:
    return F.struct((b["x1"] - pad).alias("x1"), (b["y1"] - pad).alias("y1"), (b["x2"] + pad).alias("x2"), (b["y2"] + pad).alias("y2"))


def moved(b: Column, dx: int = 0, dy: int = 0) -> Column:
    return F.struct((b["x1"] + dx).alias("x1"), (b["y1"] + dy).alias("y1"), (b["x2"] + dx).alias("x2"), (b["y2"] + dy).alias("y2"))


def scaled_down(b: Column, scale: int) -> Column:
    return F.struct(*(F.floor(b[k] / scale).cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")))


def distance(a: Column, b: Column) -> Column:
    """Distance of the nearest points; 0 for boxes that touch."""
    dx = F.greatest(F.lit(0), a["x1"] - b["x2"], b["x1"] - a["x2"])
    dy = F.greatest(F.lit(0), a["y1"] - b["y2"], b["y1"] - a["y2"])
    return _known(F.sqrt((dx * dx + dy * dy).cast("double")), a, b)


def center_distance(a: Column, b: Column) -> Column:
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2.0
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2.0
    return F.sqrt(dx * dx + dy * dy)


def center_offset(a: Column, b: Column, least: float = 8.0) -> Column:
    """Distance of the centres in half perimeters of the first box, which is at least ``least``."""
    return _known(center_distance(a, b) / F.greatest(F.lit(least), (width(a) + height(a)) / 2.0), a, b)


def mean_height(a: Column, b: Column) -> Column:
    return _known(F.greatest(F.lit(1.0), (F.greatest(F.lit(1), height(a)) + F.greatest(F.lit(1), height(b))) / 2.0), a, b)


def may_be_same(a: Column, b: Column) -> Column:
    return (iou(a, b) >= GATE_IOU) | (center_distance(a, b) <= GATE_HEIGHTS * mean_height(a, b))


def match_score(a: Column, b: Column, same_lang: Column, text_likeness: Column) -> Column:
    near = F.greatest(F.lit(0.0), 1.0 - center_distance(a, b) / (GATE_HEIGHTS * mean_height(a, b)))
    return WEIGHTS["iou"] * iou(a, b) + WEIGHTS["center"] * near + WEIGHTS["size"] * size_ratio(a, b) + WEIGHTS["lang"] * F.when(same_lang, 1.0).otherwise(0.0) + WEIGHTS["text"] * text_likeness
