"""Box geometry as column expressions. A box is four flat double columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of size bins in native pixels; the last bin is open.
SIZE_EDGES = (0, 16, 32, 64, 96, 128)


def bbox(points: Column) -> list[Column]:
    """x1, y1, x2, y2 of an array of [x, y] points."""
    axis = lambda k: F.transform(points, lambda p: p[k])
    return [F.array_min(axis(0)).alias("x1"), F.array_min(axis(1)).alias("y1"), F.array_max(axis(0)).alias("x2"), F.array_max(axis(1)).alias("y2")]


def corners(xywh: Column) -> list[Column]:
    """x1, y1, x2, y2 of [x, y, width, height]."""
    x, y, w, h = (xywh[k].cast("double") for k in range(4))
    return [x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")]


def width(p: str = "") -> Column:
    return F.col(f"{p}x2") - F.col(f"{p}x1")


def height(p: str = "") -> Column:
    return F.col(f"{p}y2") - F.col(f"{p}y1")


def area(p: str = "") -> Column:
    return width(p) * height(p)


def side_min(p: str = "") -> Column:
    return F.least(width(p), height(p))


def side_max(p: str = "") -> Column:
    return F.greatest(width(p), height(p))


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    h = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def size_bin(side: Column, edges: tuple[float, ...] = SIZE_EDGES) -> Column:
    """The lower edge of the bin [edge, next edge); null below the first, so that such rows are in no bin."""
    out = F.lit(None).cast("int")
    for e in edges:
        out = F.when(side >= e, F.lit(int(e))).otherwise(out)
    return out


def bucket(x: Column, bounds: list[float]) -> Column:
    """How many of the ascending bounds are at or below x."""
    return sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))


def first_best(p: Column) -> Column:
    """Index from 0 of the greatest element; the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def yolo(tile: tuple[Column, Column, Column, Column]) -> list[Column]:
    """Centre and size of the box relative to a tile (x1, y1, x2, y2)."""
    tx1, ty1, tx2, ty2 = tile
    w, h = tx2 - tx1, ty2 - ty1
    return [
        (((F.col("x1") + F.col("x2")) / 2 - tx1) / w).alias("cx"), (((F.col("y1") + F.col("y2")) / 2 - ty1) / h).alias("cy"),
        (width() / w).alias("w"), (height() / h).alias("h"),
    ]
