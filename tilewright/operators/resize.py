"""Area resize of maps given as pixel rows.

A target pixel is the mean of the source area under it: a source pixel weighs by the overlap of its
square with the target's, which is the product of the overlaps along x and y. Overlaps are whole numbers
when a source pixel is ``target size`` units wide and a target pixel ``source size``, so sums of whole
pixel values are exact, and every target pixel weighs the same in all. Smaller and larger targets alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _targets(k: str, source: int, target: int) -> Column:
    """The target pixels that a source pixel's side overlaps."""
    at = F.col(k).cast("bigint")
    return F.sequence(F.floor(at * target / source), F.floor(((at + 1) * target - 1) / source))


def _overlap(k: str, to: str, source: int, target: int) -> Column:
    at, t = F.col(k).cast("bigint"), F.col(to)
    return F.least((at + 1) * target, (t + 1) * source) - F.greatest(at * target, t * source)


def area_resize(pixels: DataFrame, size: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(img, c, y, x, v) maps of ``size`` (height, width) at ``target`` size; missing pixels count as 0.

    Along x first, then along y; both sums are grouped within an image, and partial sums are made before the shuffle.
    """
    (h, w), (th, tw) = size, target
    if min(h, w, th, tw) < 1:
        raise ValueError("sizes must be positive")
    along_x = pixels.select("img", "c", "y", "x", "v", F.explode(_targets("x", w, tw)).alias("tx"))
    along_x = along_x.groupBy("img", "c", "y", "tx").agg(F.sum(F.col("v") * _overlap("x", "tx", w, tw)).alias("v"))
    along_y = along_x.select("img", "c", "y", "tx", "v", F.explode(_targets("y", h, th)).alias("ty"))
    out = along_y.groupBy("img", "c", "ty", "tx").agg(F.sum(F.col("v") * _overlap("y", "ty", h, th)).alias("v"))
    return out.select("img", "c", F.col("ty").cast("int").alias("y"), F.col("tx").cast("int").alias("x"), (F.col("v") / (h * w)).alias("v"))
