"""Per-frame post-processing: ownership, greedy suppression with merging, anchors, pairs, counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.config import DetectionConfig
from tilewright.functions import folds
from tilewright.functions.geometry import BOX, box, duplicate, merged

EPS = 1e-6


def quantized(boxes: DataFrame) -> DataFrame:
    """P10: coordinates and confidences as they are after a text with four decimals."""
    return boxes.withColumns({c: F.round(F.col(c), 4) for c in ("x1", "y1", "x2", "y2", "conf")})


def owned(cfg: DetectionConfig, tile_id: Column, x1: Column, y1: Column, x2: Column, y2: Column, frame_width: Column | None = None, frame_height: Column | None = None) -> Column:
    """Whether a box's centre lies in the core of its tile; the last column and row own their far border."""
    cols, rows = cfg.grid
    if not cfg.tile_owner_filter or cols * rows <= 1:
        return F.lit(True)

    def inside(center: Column, k: Column, total: Column, parts: int) -> Column:
        low, high = F.round(k * total / F.lit(float(parts)), 0), F.round((k + 1) * total / F.lit(float(parts)), 0)
        return (center + EPS >= low) & F.when(k == parts - 1, center <= high + EPS).otherwise(center < high - EPS)
    fw = F.lit(cfg.width) if frame_width is None else frame_width
    fh = F.lit(cfg.height) if frame_height is None else frame_height
    return (tile_id < 0) | (tile_id >= cols * rows) | (inside((x1 + x2) * 0.5, tile_id % cols, fw, cols) & inside((y1 + y2) * 0.5, F.floor(tile_id / cols), fh, rows))


def owner_filter(cfg: DetectionConfig, boxes: DataFrame) -> DataFrame:
    return boxes.where(owned(cfg, *[F.col(c) for c in ("tile_id", "x1", "y1", "x2", "y2")]))


def suppressed(cfg: DetectionConfig, boxes: Column, frame_width: Column | None = None, frame_height: Column | None = None) -> Column:
    """Array of boxes after greedy suppression.

    Boxes go by falling confidence, then tile and coordinates. Each meets the boxes kept so far as they have
    grown; the first that it duplicates takes it in (or drops it, without ``duplicate_merge``).
    """
    def step(kept: Column, new: Column) -> Column:
        first = F.array_position(F.transform(kept, lambda k: duplicate(cfg, new, k, frame_width, frame_height)), True)

        def placed(at: Column) -> Column:
            grown = F.transform(kept, lambda k, i: F.when(i == at - 1, merged(k, new)).otherwise(k)) if cfg.duplicate_merge else kept
            return F.when(at == 0, F.concat(kept, F.array(new))).otherwise(grown)
        return F.transform(F.array(first), placed)[0]
    return F.aggregate(F.sort_array(boxes), F.array().cast(f"array<{BOX}>"), step)


def frame_boxes(boxes: DataFrame) -> DataFrame:
    """A2: one row per frame with its boxes as an array."""
    return boxes.groupBy("frame_id").agg(F.collect_list(box()).alias("boxes"))


def suppress(cfg: DetectionConfig, boxes: DataFrame, *, own: bool = False) -> DataFrame:
    """A9 over all frames, in parallel by frame: one shuffle, then a fold over the frames of an Arrow batch side by side.

    The fold is sequential inside a frame; as nested higher-order functions (``suppressed``) it takes several times as long.
    ``own`` applies the ownership filter (F2) in the fold: as a filter, Spark works out the boxes' coordinates again for each of its comparisons.
    """
    step = folds.merged if own else folds.suppressed

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            kept = step(cfg, folds.from_arrow(batch.column(1), np.full(n, cfg.width), np.full(n, cfg.height)))
            yield pa.RecordBatch.from_arrays([batch.column(0), folds.to_arrow(kept, batch.schema.field(1).type)], ["frame_id", "boxes"])

    frames = frame_boxes(boxes)
    kept = frames.mapInArrow(fold, frames.schema).select("frame_id", F.explode("boxes").alias("b"))
    return kept.select("frame_id", *[F.col(f"b.{c}") for c in ("tile_id", "rank", "x1", "y1", "x2", "y2", "conf", "cls")])


def merge_frame(cfg: DetectionConfig, boxes: Column, frame_width: Column | None = None, frame_height: Column | None = None) -> Column:
    """L2: ownership, then suppression, of one frame's array of boxes."""
    own = F.filter(boxes, lambda b: owned(cfg, b["tile_id"], b["x1"], b["y1"], b["x2"], b["y2"], frame_width, frame_height))
    return suppressed(cfg, own, frame_width, frame_height)


def with_anchors(cfg: DetectionConfig, anchors: Column, tiles: Column, frame_width: Column | None = None, frame_height: Column | None = None) -> Column:
    """Anchors alone, anchors unless there are none, or anchors and the tile boxes that none of them covers."""
    alone = merge_frame(cfg, anchors, frame_width, frame_height)
    if cfg.live_anchor_policy == "anchor-only":
        return alone
    if cfg.live_anchor_policy == "anchor-gate":
        return F.when(F.size(anchors) > 0, alone).otherwise(merge_frame(cfg, tiles, frame_width, frame_height))
    uncovered = F.filter(tiles, lambda t: ~F.exists(anchors, lambda a: duplicate(cfg, t, a, frame_width, frame_height)))
    return merge_frame(cfg, F.concat(anchors, uncovered), frame_width, frame_height)


def uncovered(cfg: DetectionConfig, tiles: DataFrame, anchors: DataFrame) -> DataFrame:
    """J6 as a join: tile boxes of which no anchor of the frame is a duplicate."""
    a = anchors.select(F.col("frame_id").alias("a_frame"), box().alias("anchor"))
    t = tiles.withColumn("box", box())
    return t.join(a, (F.col("frame_id") == F.col("a_frame")) & duplicate(cfg, F.col("box"), F.col("anchor")), "left_anti").drop("box")


def duplicate_pairs(cfg: DetectionConfig, boxes: DataFrame) -> DataFrame:
    """(frame_id, a, b) of all pairs of a frame's boxes that are duplicates, a < b by det_id.

    The join is by frame, class and cell, so distant boxes never meet; a pair that shares several cells counts in
    its first. Boxes stand in levels by their longer side, cells of a level are as large as its boxes, and a box
    goes to the few cells of its reach in its own level and all coarser ones, where the larger box of a pair is.
    Reach is the box itself; with near-camera rules it is wider by the share of its sides that those rules allow.
    """
    if cfg.iou <= 0:
        raise ValueError("an iou of 0 makes duplicates of all boxes of a class")
    rows = boxes.select("frame_id", "det_id", *FLAT)
    cells = cells_of(cfg, rows, rows.agg(F.coalesce(F.max(_side()), F.lit(1.0)).alias("size")))
    left = cells.select(*[F.col(c).alias(f"l_{c}") for c in cells.columns])
    one, two = (F.struct(*[F.col(p + c).alias(c) for c in FLAT]) for p in ("", "l_"))
    return left.join(cells, met_in_cells() & (F.col("l_det_id") < F.col("det_id")) & duplicate(cfg, one, two)).select("frame_id", F.col("l_det_id").alias("a"), F.col("det_id").alias("b"))


FLAT = ["x1", "y1", "x2", "y2", "conf", "tile_id", "rank", "cls"]


def _side() -> Column:
    """The longer side of a box, at least 1."""
    return F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))


def cells_of(cfg: DetectionConfig, boxes: DataFrame, size: DataFrame) -> DataFrame:
    """``boxes`` with level, at, cx and cy, a row for each cell of their reach in their own level and all coarser ones up to that of ``size`` (one row: the largest side)."""
    reach = max(cfg.duplicate_gap, cfg.duplicate_center) if cfg.duplicate_near_camera else 0.0
    level = lambda side: F.greatest(F.lit(0), F.ceil(F.log2(side)) - 5).cast("int")
    wide, high = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")), F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    rows = boxes.select("*", level(_side()).alias("level"), (wide * reach).alias("mx"), (high * reach).alias("my"))
    # a coarser level costs a box a cell or four
    rows = rows.crossJoin(F.broadcast(size.select(level(F.col("size")).alias("top")))).select("*", F.explode(F.sequence("level", F.greatest("level", "top"))).alias("at"))
    edge = F.pow(F.lit(2.0), F.col("at") + 5)
    lo = lambda k, m: F.floor((F.col(f"{k}1") - F.col(m)) / edge)
    hi = lambda k, m: F.floor((F.greatest(f"{k}1", f"{k}2") + F.col(m)) / edge)
    spans = rows.select(*boxes.columns, "level", "at", lo("x", "mx").alias("x0"), lo("y", "my").alias("y0"), hi("y", "my").alias("yb"), F.explode(F.sequence(lo("x", "mx"), hi("x", "mx"))).alias("cx"))
    return spans.select(*boxes.columns, "level", "at", "x0", "y0", "cx", F.explode(F.sequence("y0", "yb")).alias("cy"))


def met_in_cells() -> Column:
    """Whether rows of ``cells_of``, one side's columns with l_ in front, meet: same frame and class, in the level of the larger box, in the first cell that both have there."""
    same = (F.col("at") == F.greatest("l_level", "level")) & (F.col("cx") == F.greatest("l_x0", "x0")) & (F.col("cy") == F.greatest("l_y0", "y0"))
    for key in ("frame_id", "cls", "at", "cx", "cy"):
        same = (F.col(f"l_{key}") == F.col(key)) & same
    return same


def ranked(boxes: DataFrame) -> DataFrame:
    """Place of each box in its frame's order of suppression."""
    order = Window.partitionBy("frame_id").orderBy(F.desc("conf"), "tile_id", "x1", "y1", "x2", "y2")
    return boxes.withColumn("place", F.row_number().over(order))


def frame_spine(spark: SparkSession, start: int, frames: int) -> DataFrame:
    return spark.range(start, start + frames).select(F.col("id").cast("int").alias("frame_id"))


def counts_on_spine(spine: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes per frame of ``spine``; frames without any have 0."""
    counts = boxes.groupBy("frame_id").agg(F.count("*").alias("person_count"))
    return spine.join(counts, "frame_id", "left").select("frame_id", F.coalesce("person_count", F.lit(0)).cast("bigint").alias("person_count"))


def remapped(boxes: DataFrame, work: DataFrame) -> DataFrame:
    """Tile-local boxes moved by the origin of their tile.

    ``work`` has the tiles of one frame (all frames have the same: a join on tile_id) or of each (on frame_id too).
    """
    keys = [c for c in ("frame_id", "tile_id") if c in work.columns]
    moved = boxes.join(work.select(*keys, F.col("x1").alias("tx"), F.col("y1").alias("ty")), keys)
    return moved.withColumns({"x1": F.col("x1") + F.col("tx"), "x2": F.col("x2") + F.col("tx"), "y1": F.col("y1") + F.col("ty"), "y2": F.col("y2") + F.col("ty")}).drop("tx", "ty")
