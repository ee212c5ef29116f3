"""Boxes as struct columns with x1, y1, x2, y2, conf, cls, tile_id, rank: areas, overlaps, duplicate rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig

BOX = "struct<neg_conf:double,tile_id:int,x1:double,y1:double,x2:double,y2:double,conf:double,rank:int,cls:int>"


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def width(b: Column) -> Column:
    """P3."""
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    """P3."""
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def area(b: Column) -> Column:
    """P3."""
    return width(b) * height(b)


def overlap_1d(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))


def intersection(a: Column, b: Column) -> Column:
    """P4."""
    return overlap_1d(a["x1"], a["x2"], b["x1"], b["x2"]) * overlap_1d(a["y1"], a["y2"], b["y1"], b["y2"])


def iou(a: Column, b: Column) -> Column:
    """P5: intersection over union; 0 for a union without area."""
    both = intersection(a, b)
    return _ratio(both, area(a) + area(b) - both)


def ios(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 if that is 0."""
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def axis_overlap(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals as a share of the shorter."""
    return _ratio(overlap_1d(a1, a2, b1, b2), F.least(F.greatest(F.lit(0.0), a2 - a1), F.greatest(F.lit(0.0), b2 - b1)))


def axis_gap(a1: Column, a2: Column, b1: Column, b2: Column, scale: Column) -> Column:
    """Gap between two intervals as a share of ``scale``."""
    return _ratio(F.greatest(F.lit(0.0), F.greatest(a1, b1) - F.least(a2, b2)), scale)


def _center_distances(a: Column, b: Column) -> tuple[Column, Column]:
    def distance(lo: str, hi: str, scale: Column) -> Column:
        return _ratio(F.abs((a[lo] + a[hi]) * 0.5 - (b[lo] + b[hi]) * 0.5), scale)
    return distance("x1", "x2", F.greatest(width(a), width(b))), distance("y1", "y2", F.greatest(height(a), height(b)))


def near_camera_duplicate(cfg: DetectionConfig, a: Column, b: Column, frame_width: Column, frame_height: Column) -> Column:
    """two parts of one large object on both sides of a tile border."""
    if not cfg.duplicate_near_camera:
        return F.lit(False)
    fw, fh = F.greatest(F.lit(1), frame_width).cast("double"), F.greatest(F.lit(1), frame_height).cast("double")
    min_w, min_h = F.least(width(a), width(b)), F.least(height(a), height(b))
    large = (F.greatest(area(a), area(b)) / (fw * fh) >= cfg.duplicate_large_area_ratio) | (
        F.greatest(width(a), width(b)) / fw >= 0.35) | (F.greatest(height(a), height(b)) / fh >= 0.45)
    ndx, ndy = _center_distances(a, b)
    ox, oy = axis_overlap(a["x1"], a["x2"], b["x1"], b["x2"]), axis_overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    gx, gy = axis_gap(a["x1"], a["x2"], b["x1"], b["x2"], min_w), axis_gap(a["y1"], a["y2"], b["y1"], b["y2"], min_h)
    c, g, o = cfg.duplicate_center, cfg.duplicate_gap, cfg.duplicate_axis_overlap
    beside = (oy >= o) & (gx <= g) & (ndy <= c)
    above = (ox >= o) & (gy <= g) & (ndx <= c)
    close = (ndx <= c) & (ndy <= c) & ((ox > 0.05) | (oy > 0.05) | (gx <= g) | (gy <= g))
    return (a["tile_id"] != b["tile_id"]) & (min_w > 0) & (min_h > 0) & large & (beside | above | close)


def duplicate(cfg: DetectionConfig, a: Column, b: Column, frame_width: Column | None = None, frame_height: Column | None = None) -> Column:
    """whether two boxes of a frame show one object."""
    fw = F.lit(cfg.width) if frame_width is None else frame_width
    fh = F.lit(cfg.height) if frame_height is None else frame_height
    same = iou(a, b) >= cfg.iou
    if cfg.duplicate_ios > 0:
        same = same | (ios(a, b) >= cfg.duplicate_ios)
    if cfg.duplicate_near_camera:
        same = same | near_camera_duplicate(cfg, a, b, fw, fh)
    return (a["cls"] == b["cls"]) & same


def temporal_match(cfg: DetectionConfig, a: Column, b: Column) -> Column:
    """whether a box may be the object of a box one frame earlier."""
    ndx, ndy = _center_distances(a, b)
    ox, oy = axis_overlap(a["x1"], a["x2"], b["x1"], b["x2"]), axis_overlap(a["y1"], a["y2"], b["y1"], b["y2"])
    sized = (F.greatest(width(a), width(b)) > 0) & (F.greatest(height(a), height(b)) > 0)
    near = sized & (ndx <= cfg.live_temporal_center) & (ndy <= cfg.live_temporal_center) & ((ox > 0.10) | (oy > 0.10))
    return (a["cls"] == b["cls"]) & ((iou(a, b) >= 0.15) | (ios(a, b) >= cfg.live_temporal_ios) | near)


def merged(a: Column, b: Column) -> Column:
    """The box around both, with all else from the surer one; ties go to ``a``."""
    first = a["conf"] >= b["conf"]

    def pick(name: str) -> Column:
        return F.when(first, a[name]).otherwise(b[name]).alias(name)
    return F.struct(
        F.least(a["neg_conf"], b["neg_conf"]).alias("neg_conf"), pick("tile_id"), F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"),
        F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"), F.greatest(a["conf"], b["conf"]).alias("conf"), pick("rank"), pick("cls"))


def box() -> Column:
    """A box struct from flat columns; its leading fields are the order of suppression."""
    return F.struct((-F.col("conf")).alias("neg_conf"), F.col("tile_id").cast("int").alias("tile_id"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "conf")],
                    F.col("rank").cast("int").alias("rank"), F.col("cls").cast("int").alias("cls"))
