"""Tile arithmetic: starts, seams, boxes in tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx


def snapped_starts(n: int | Column, tile: int, overlap: float) -> Column:
    """Starts every tile - int(overlap * tile) while a tile fits; if the next start still lies inside, one more tile that ends at the edge."""
    n, step = (F.lit(n) if isinstance(n, int) else n).cast("long"), tile - int(overlap * tile)
    fit = F.when(n >= tile, F.floor((n - tile) / F.lit(step)) + 1).otherwise(F.lit(0).cast("long"))
    plain = F.when(fit > 0, F.transform(F.sequence(F.lit(0).cast("long"), fit - 1), lambda i: i * step)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(plain, F.when((n > 0) & (fit * step < n), F.array(F.greatest(n - tile, F.lit(0).cast("long")))).otherwise(F.array().cast("array<bigint>")))


def spread_starts(n: int | Column, tile: int, overlap: float) -> Column:
    """Starts every int(tile * (1 - overlap)) below n - tile, then n - tile; one start if a tile holds all."""
    n, step = (F.lit(n) if isinstance(n, int) else n), int(tile * (1 - overlap))
    inner = F.sequence(F.lit(0).cast("long"), F.floor((n - tile - 1) / F.lit(step)))
    return F.when(n <= tile, F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.transform(inner, lambda i: i * step), F.array((n - tile).cast("long"))))


def seams(starts: Column, tile: int) -> Column:
    """(start of tile i + 1, end of tile i) for each two tiles."""
    pairs = F.arrays_zip(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))).alias("start"), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))).alias("prev"))
    return F.transform(pairs, lambda p: F.struct(p["start"].alias("start"), (p["prev"] + tile).alias("end")))


def in_tiles(boxes: DataFrame, width: Column, height: Column, tile: int, overlap: float, part: float) -> DataFrame:
    """Boxes with the tiles (tx, ty) that they meet, cut to these: cx1..cy2, share of their area inside, kept (share >= part) or a stub. Tiles come from the box's own frame, so there is no join."""
    at = boxes.withColumn("tx", F.explode(spread_starts(width, tile, overlap))).withColumn("ty", F.explode(spread_starts(height, tile, overlap)))
    cut = at.withColumns({"cx1": F.greatest("x1", "tx"), "cy1": F.greatest("y1", "ty"), "cx2": F.least("x2", F.col("tx") + tile), "cy2": F.least("y2", F.col("ty") + tile)})
    cut = cut.where((F.col("cx2") > F.col("cx1")) & (F.col("cy2") > F.col("cy1")))
    share = (F.col("cx2") - F.col("cx1")) * (F.col("cy2") - F.col("cy1")) / F.greatest(bx.area(), F.lit(1e-6))
    return cut.withColumn("share", share).withColumn("kept", F.col("share") >= part)
