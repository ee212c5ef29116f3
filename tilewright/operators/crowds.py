"""A9 for crowded frames: a frame's boxes in many tasks, with the result of the fold over the whole frame.

Boxes that can never meet need not wait for each other. A box goes to all blocks of its frame that it reaches
into. In each block boxes are put into parts, first by duplicate pairs (J5), and every part is folded by itself;
where any state of a kept box could have taken in a box of another part, the two are joined and folded again.
A part that reaches out of no block is done there: all that could meet it was in that block. Only the others
move: they are joined by the boxes that they share, folded, and their kept boxes held against the boxes of all
other parts, in the same way. When no such pair is left, no box could have met a box of another part at any time
of the serial fold, so the parts' folds together are that fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.functions import folds, geometry, parts
from tilewright.functions.geometry import box
from tilewright.operators.duplicates import FLAT, suppress
from tilewright.shared import staged

#: A block is as wide as this many boxes, so that few boxes are in several.
WIDE = 16
#: Boxes of the blocks that are put into parts side by side, about.
MANY = 50_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node that edges reach.

    Each round a node takes the least label of its neighbours, and then the label of that label, so paths halve.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("b", "seen"), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "seen").alias("new"))
        jump = labels.toDF("at", "further")
        new = staged(least.join(jump, F.col("new") == F.col("at"), "left").select("node", F.col("label").alias("old"), F.least("new", "further").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _folded(cfg: DetectionConfig, rows: DataFrame) -> DataFrame:
    """(frame_id, part, least, boxes...) of the boxes that each part keeps; ``least`` is the area of its smallest box."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            kept = folds.suppressed(cfg, folds.from_arrow(batch.column(3), np.full(n, cfg.width), np.full(n, cfg.height)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], folds.to_arrow(kept, batch.schema.field(3).type)], batch.schema.names)

    lists = rows.groupBy("frame_id", "part").agg(F.min("area").alias("least"), F.collect_list(box()).alias("boxes"))
    return lists.mapInArrow(fold, lists.schema).select("frame_id", "part", "least", F.explode("boxes").alias("k")).select("frame_id", "part", "least", *[F.col(f"k.{c}").alias(c) for c in FLAT])


def _reach(cfg: DetectionConfig) -> tuple[Column, Column, Column, Column]:
    """The reach of a box, as ``parts.reach`` has it."""
    by = max(cfg.duplicate_gap, cfg.duplicate_center) if cfg.duplicate_near_camera else 0.0
    mx, my = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * by, F.greatest(F.lit(0.0), F.col("y2") - F.col("y1")) * by
    return F.col("x1") - mx, F.col("y1") - my, F.greatest("x1", "x2") + mx, F.greatest("y1", "y2") + my


def _in_blocks(cfg: DetectionConfig, boxes: DataFrame, edge: DataFrame, share: int = 1) -> DataFrame:
    """``boxes`` with edge, bx and by, a row for each block that they reach into; ``edge`` is one row, blocks are a ``share`` of it wide."""
    rows = boxes.crossJoin(F.broadcast(edge.select((F.col("edge") / share).alias("edge"))))
    x1, y1, x2, y2 = (F.coalesce(F.floor(c / F.col("edge")), F.lit(0)) for c in _reach(cfg))
    rows = rows.select("*", y1.alias("_y1"), y2.alias("_y2"), F.explode(F.sequence(x1, x2)).alias("bx"))
    return rows.select("*", F.explode(F.sequence("_y1", "_y2")).alias("by")).drop("_y1", "_y2")


def _parted(cfg: DetectionConfig, rows: DataFrame, edge: DataFrame) -> DataFrame:
    """(frame_id, part, stays, kept, first, shared, det_id, boxes...) of every box in each of its blocks, and of the boxes that parts keep which stay in theirs.

    A part is named by the det_id of one of its boxes. ``first`` is true in one of a box's blocks, ``shared`` if it has several.
    """
    names = [*FLAT, "det_id"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(np.asarray(batch.column(5).value_lengths()))
            cuts = [0, *(np.unique(np.searchsorted(sizes, np.arange(MANY, sizes[-1] if len(sizes) else 0, MANY))) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    yield one(batch.slice(lo, hi - lo))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(5)
        of = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
        n = np.full(batch.num_rows, 0)
        c, det_id = folds.from_arrow(lists, n, n).cols, np.asarray(lists.flatten().field("det_id"))
        labels, kept, home = parts.closed(cfg, c, of)
        side, bx, by = (np.asarray(batch.column(k)) for k in (2, 3, 4))

        def spans(cols: dict, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Whether a box reaches out of its block, and whether the block is the first that it reaches into."""
            x1, y1, x2, y2 = (np.floor(np.nan_to_num(v / side[at], nan=0.0)) for v in parts.reach(cfg, cols))
            return (x1 != x2) | (y1 != y2), (x1 == bx[at]) & (y1 == by[at])

        shared, first = spans(c, of)
        stays = np.ones(len(of), bool)
        stays[labels[shared]] = False
        stays[home[spans(kept, of[home])[0]]] = False
        done = stays[home]
        count, extra = len(of), int(done.sum())
        cols = {k: np.concatenate([c[k], kept[k][done]]) for k in FLAT}
        part_of = np.concatenate([labels, home[done]])
        out = {"frame_id": batch.column(0).take(pa.array(of[part_of])), "part": det_id[part_of], "stays": stays[part_of], "kept": np.arange(count + extra) >= count,
               "first": np.concatenate([first, np.ones(extra, bool)]), "shared": np.concatenate([shared, np.zeros(extra, bool)]), "det_id": np.concatenate([det_id, np.zeros(extra, np.int64)]), **cols}
        return pa.RecordBatch.from_arrays([pa.array(v).cast(kinds.get(k, pa.array(v).type)) for k, v in out.items()], list(out))

    kinds = dict.fromkeys(("tile_id", "rank", "cls"), pa.int32())
    blocks = _in_blocks(cfg, rows, edge).groupBy("frame_id", "cls", "edge", "bx", "by").agg(F.collect_list(F.struct(*names)).alias("boxes"))
    kind = f"frame_id {rows.schema['frame_id'].dataType.simpleString()}, part long, stays boolean, kept boolean, first boolean, shared boolean, det_id long, x1 double, y1 double, x2 double, y2 double, conf double, tile_id int, rank int, cls int"
    return blocks.mapInArrow(part, kind)


def _could_meet(cfg: DetectionConfig) -> Column:
    """Whether any state of a part's kept box, columns with l_ in front, could have taken in a box."""
    if cfg.duplicate_near_camera:
        return (F.col("l_rx1") <= F.col("rx2")) & (F.col("rx1") <= F.col("l_rx2")) & (F.col("l_ry1") <= F.col("ry2")) & (F.col("ry1") <= F.col("l_ry2"))
    a, b = (F.struct(*[F.col(p + c).alias(c) for c in ("x1", "y1", "x2", "y2")]) for p in ("", "l_"))
    over = geometry.intersection(a, b)
    # a kept box was never smaller than the part's smallest box, nor did it ever cover more than now
    return (over > 0) & (over >= parts.share(cfg) * F.least(geometry.area(a), "l_least") * (1 - 1e-9))


def _meeting(cfg: DetectionConfig, kept: DataFrame, boxes: DataFrame, edge: DataFrame) -> DataFrame:
    """(a, b) of parts of ``kept`` and parts of ``boxes`` that could have met, in small blocks of both."""
    corners = dict(zip(("rx1", "ry1", "rx2", "ry2"), _reach(cfg))) if cfg.duplicate_near_camera else {}
    keys, own = ["frame_id", "cls", "bx", "by"], ["part", "x1", "y1", "x2", "y2", *corners]
    mine = _in_blocks(cfg, boxes.withColumns(corners).select("frame_id", "cls", *own), edge, 4).select(*keys, *own)
    theirs = _in_blocks(cfg, kept.withColumns(corners).select("frame_id", "cls", "least", *own), edge, 4).select(*[F.col(c).alias(f"l_{c}") for c in (*keys, "least", *own)])
    same = F.col("l_frame_id").eqNullSafe(F.col("frame_id")) & (F.col("l_cls") == F.col("cls")) & (F.col("l_bx") == F.col("bx")) & (F.col("l_by") == F.col("by"))
    return theirs.join(mine, same).where((F.col("l_part") != F.col("part")) & _could_meet(cfg)).select(F.col("l_part").alias("a"), F.col("part").alias("b")).distinct()


def suppress_crowds(cfg: DetectionConfig, boxes: DataFrame) -> DataFrame:
    """What ``suppress`` gives for (frame_id, tile_id, rank, x1, y1, x2, y2, conf, cls) rows, for frames of any number of boxes."""
    if cfg.iou <= 0:
        return suppress(cfg, boxes)
    out = ["frame_id", "tile_id", "rank", "x1", "y1", "x2", "y2", "conf", "cls"]
    flat = [F.col(c).cast("int" if c in ("tile_id", "rank", "cls") else "double").alias(c) for c in FLAT]
    rows = staged(boxes.select("frame_id", *flat).withColumn("det_id", F.monotonically_increasing_id()), "crowd")
    x1, y1, x2, y2 = _reach(cfg)
    side = F.greatest(F.lit(1.0), x2 - x1, y2 - y1)
    # one row; by the mean square, so that all boxes together are in few more blocks than there are boxes
    edge = staged(rows.agg((WIDE * F.pow(F.lit(2.0), F.ceil(F.log2(F.coalesce(F.sqrt(F.avg(side * side)), F.lit(1.0)))))).alias("edge")), "edge")
    placed = staged(_parted(cfg, rows, edge), "placed")
    every = placed.where("first and not kept")
    moving = every.where("not stays")
    links = placed.where("shared and not kept").groupBy("det_id").agg(F.collect_set("part").alias("of")).select(F.array_min("of").alias("a"), F.explode("of").alias("b"))
    labels = components(links.unionByName(moving.select(F.col("part").alias("a"), F.col("part").alias("b"))).distinct())
    fresh, kept, gone = labels, None, None
    while True:
        # parts that are new or joined: at first all that move, later few
        again = (moving if kept is None else every).join(fresh, F.col("part") == F.col("node")).select("frame_id", F.col("label").alias("part"), *FLAT)
        one = F.struct(*[F.col(c) for c in FLAT])
        folded = staged(_folded(cfg, again.withColumn("area", geometry.area(one))), "folded")
        met = _meeting(cfg, folded, every, edge).join(labels.toDF("b", "label"), "b", "left").select("a", "b", F.coalesce("label", "b").alias("to"))
        met = staged(met.where("a <> to"), "meeting")
        kept = folded if kept is None else kept.unionByName(folded)
        gone = met.select(F.col("b").alias("part")) if gone is None else gone.unionByName(met.select(F.col("b").alias("part")))
        if met.isEmpty():
            stay = placed.where("kept").join(gone, "part", "left_anti")
            return stay.select(*out).unionByName(kept.select(*out))
        joined = components(met.select("a", F.col("to").alias("b")))
        known = labels.unionByName(met.where("b = to").select(F.col("b").alias("node"), F.col("to").alias("label"))).distinct()
        labels = staged(known.join(joined.toDF("label", "new"), "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
        fresh = labels.join(joined.select("label").distinct(), "label", "left_semi").select("node", "label")
        kept = staged(kept.join(joined.select(F.col("node").alias("part")), "part", "left_anti"), "kept")
