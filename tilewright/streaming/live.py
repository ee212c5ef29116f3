"""Live mode: frames with nested tile boxes, per-frame merging, and state from the frame before.

Merging a frame needs no state (L2, L4). Temporal de-duplication (A10) needs the last frame's boxes of the
camera: as a stream in ``streaming.frames``, with typed state (L3). ``dedup_frames`` is the same fold over a whole table, in pieces that are folded at
once and corrected where the frame before was another. The rules on plain boxes are in ``functions.boxes``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.config import DetectionConfig
from tilewright.functions import folds
from tilewright.functions.boxes import around, matches, suppressed_boxes
from tilewright.functions.geometry import BOX
from tilewright.operators.duplicates import counts_on_spine, suppress
from tilewright.shared import staged

FRAME = f"camera string, frame_id int, frame_width int, frame_height int, capture_ms double, tiles array<{BOX}>, anchors array<{BOX}>"
EVENT = "camera string, frame_id int, person_count int, tasks int, capture_ms double, latency_ms double, boxes array<struct<tile_id:int,rank:int,x1:double,y1:double,x2:double,y2:double,conf:double,cls:int>>"
#: Frame ids in a piece of a camera that ``dedup_frames`` folds at a time.
PIECE = 256
#: Frames of an Arrow batch whose boxes are in Python's memory at a time.
STEP = 1_000
#: Times that ``dedup_runs`` folds frames side by side.
ROUNDS = 4


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(k, STEP) for k in range(0, batch.num_rows, STEP))


def dedup(cfg: DetectionConfig, now: list[dict], before: list[dict], width: int | None = None, height: int | None = None) -> list[dict]:
    """A10: boxes of a frame that match one box of the frame before are one; each box is used once, in order of the boxes before."""
    if not cfg.live_temporal_dedup or len(now) < 2 or not before:
        return now
    free, out = list(now), []
    for old in before:
        found = [b for b in free if matches(cfg, b, old)]
        if len(found) > 1:
            free = [b for b in free if not any(b is f for f in found)]
            one = found[0]
            for other in found[1:]:
                one = around(one, other)
            out.append(one)
    return suppressed_boxes(cfg, out + free, width or cfg.width, height or cfg.height)


def dedup_runs(cfg: DetectionConfig, now: folds.Frames, first: np.ndarray) -> folds.Frames:
    """A10 over runs of frames in order; nothing comes before the frames ``first``.

    All frames are folded side by side with the boxes that the frame before has so far, and those whose frame
    before has changed once more, up to ``ROUNDS`` times; what is left then is folded one by one.
    """
    if not cfg.live_temporal_dedup or not len(now):
        return now
    boxes = now.parts()
    out, left = list(boxes), np.flatnonzero(~first)
    for _ in range(ROUNDS):
        new = folds.dedup(cfg, [boxes[k] for k in left], [out[k - 1] for k in left], now.width[left], now.height[left])
        changed = [k for k, n in zip(left, new) if not np.array_equal(n, out[k])]
        for k, n in zip(left, new):
            out[k] = n
        left = np.array([k + 1 for k in changed if k + 1 < len(first) and not first[k + 1]], np.int64)
    again = set(left.tolist())
    for k in range(min(again, default=len(first)), len(first)):
        if k in again:
            new = folds.dedup(cfg, [boxes[k]], [out[k - 1]], now.width[k:k + 1], now.height[k:k + 1])[0]
            if not np.array_equal(new, out[k]) and k + 1 < len(first) and not first[k + 1]:
                again.add(k + 1)
            out[k] = new
    return folds.Frames.of_parts(out, now.width, now.height)


def merged_frames(cfg: DetectionConfig, frames: DataFrame) -> DataFrame:
    """Each frame (FRAME) with ``boxes`` after merging its tiles, and its anchors if there is an anchor pass, and ``tasks``; ``STEP`` frames side by side."""
    kind = frames.schema["tiles"].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            width, height = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("frame_width", "frame_height"))
            tiles, anchors = (folds.from_arrow(batch.column(k), width, height) for k in ("tiles", "anchors"))
            boxes, tasks = folds.with_anchors(cfg, tiles, anchors)
            yield pa.RecordBatch.from_arrays([*batch.columns, folds.to_arrow(boxes, batch.schema.field("tiles").type), pa.array(tasks, pa.int32())], [*batch.schema.names, "boxes", "tasks"])

    return frames.mapInArrow(merge, frames.withColumn("boxes", F.lit(None).cast(kind)).withColumn("tasks", F.lit(0)).schema)


_FRAME_COLUMNS = ("camera", "frame_id", "frame_width", "frame_height", "capture_ms", "tasks", "boxes")


def event_lines(events: DataFrame) -> DataFrame:
    """K6: the live event table as texts with four decimals."""
    return events.select("camera", "frame_id", "person_count", "tasks", *[F.format_string("%.4f", c).alias(c) for c in ("capture_ms", "latency_ms")])


def _fold(cfg: DetectionConfig):
    """Arrow batches of rows by camera, piece and frame, with ``boxes`` as merged, to those rows with ``out``, the boxes after the temporal pass.

    A piece may begin with a row without a frame, whose boxes are those of the frame before it; then ``out`` has
    what an earlier round found, and rows come back only until the boxes are again what that round had: from
    there on nothing can differ.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, before, met = None, [], False
        for batch in _steps(batches):
            rows, outs, took = [], [], []
            for k, r in enumerate(batch.select(["camera", "piece", "frame_id", "frame_width", "frame_height", "boxes", "out"]).to_pylist()):
                if (r["camera"], r["piece"]) != piece:
                    piece, before, met = (r["camera"], r["piece"]), [], False
                if r["frame_id"] is None:
                    before = r["boxes"]
                elif not met:
                    began = time.perf_counter()
                    before = dedup(cfg, r["boxes"], before, r["frame_width"], r["frame_height"])
                    met = r["out"] is not None and before == r["out"]
                    if not met:
                        rows.append(k)
                        outs.append(before)
                        took.append((time.perf_counter() - began) * 1000)
            same = batch.select([n for n in batch.schema.names if n not in ("out", "latency_ms")]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*same.columns, pa.array(outs, batch.schema.field("boxes").type), pa.array(took, pa.float64())], [*same.schema.names, "out", "latency_ms"])

    return fold


def dedup_frames(cfg: DetectionConfig, frames: DataFrame) -> DataFrame:
    """A10, W5, J7 over a table: EVENT rows, each camera's frames folded in order, all pieces of all cameras in parallel.

    A camera is cut into pieces of ``PIECE`` frame ids. First every piece is folded as if nothing came before it.
    Then a piece whose frame before (in the piece before) has other boxes than it was folded with is folded again
    from those, but only until its boxes are what they were: mostly a few frames. That goes on until no piece's
    start differs, so the result is that of the fold from the first frame to the last. One row a piece, with its
    last boxes, says which pieces are left.
    """
    kind = frames.schema["tiles"].dataType.simpleString()
    keys = ["camera", "piece"]
    merged = merged_frames(cfg, frames).select(*_FRAME_COLUMNS, F.floor(F.col("frame_id") / PIECE).alias("piece"))
    # as many tasks as a shuffle has: a row is small for the time that it takes
    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = {"out": F.lit(None).cast(kind), "latency_ms": F.lit(None).cast("double")}

    def folded(rows: DataFrame, name: str) -> DataFrame:
        return staged(rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.asc_nulls_first("frame_id")).mapInArrow(_fold(cfg), rows.schema), name)

    base = folded(merged.withColumns(empty), "pieces")
    order = Window.partitionBy("camera").orderBy("piece")
    ends = base.groupBy(*keys).agg(F.max("frame_id").alias("last"), F.max_by("out", "frame_id").alias("end"))
    ends = staged(ends.withColumn("prior", F.lag("piece").over(order)).withColumn("used", F.array().cast(kind)), "ends")
    patches = None
    while True:
        before = ends.select(F.col("camera").alias("b_camera"), F.col("piece").alias("b_piece"), F.col("end").alias("start"))
        left = ends.join(before, F.col("camera").eqNullSafe(F.col("b_camera")) & (F.col("prior") == F.col("b_piece"))).where("not (start <=> used)").select("camera", "piece", "start")
        left = staged(left, "differing")
        if left.isEmpty():
            break
        wanted = left.select(F.col("camera").alias("b_camera"), F.col("piece").alias("b_piece"))
        rows = base.join(wanted, F.col("camera").eqNullSafe(F.col("b_camera")) & (F.col("piece") == F.col("b_piece")), "left_semi")
        rows = rows if patches is None else _patched(rows, patches)
        starts = left.select("camera", F.lit(None).cast("int").alias("frame_id"), *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in _FRAME_COLUMNS[2:-1]], F.col("start").alias("boxes"), "piece", *[v.alias(k) for k, v in empty.items()])
        new = folded(rows.unionByName(starts), "patches").select("camera", "frame_id", "piece", "out", "latency_ms")
        # boxes at the end of a piece, where the new fold got so far, and what each piece was folded with
        late = new.groupBy(*keys).agg(F.max("frame_id").alias("n_last"), F.max_by("out", "frame_id").alias("n_end")).toDF("n_camera", "n_piece", "n_last", "n_end")
        used = left.toDF("u_camera", "u_piece", "start")
        ends = ends.join(used, F.col("camera").eqNullSafe(F.col("u_camera")) & (F.col("piece") == F.col("u_piece")), "left").join(late, F.col("camera").eqNullSafe(F.col("n_camera")) & (F.col("piece") == F.col("n_piece")), "left")
        ends = staged(ends.select("camera", "piece", "last", F.when(F.col("n_last") == F.col("last"), F.col("n_end")).otherwise(F.col("end")).alias("end"), "prior", F.coalesce("start", "used").alias("used")), "ends")
        patches = new if patches is None else staged(new.unionByName(patches.join(new.select(F.col("camera").alias("b_camera"), F.col("frame_id").alias("b_frame")), F.col("camera").eqNullSafe(F.col("b_camera")) & (F.col("frame_id") == F.col("b_frame")), "left_anti")), "patches")
    out = base if patches is None else _patched(base, patches)
    plain = F.transform("out", lambda b: F.struct(*[b[c].alias(c) for c in ("tile_id", "rank", "x1", "y1", "x2", "y2", "conf", "cls")]))
    return out.select("camera", "frame_id", F.size("out").alias("person_count"), F.col("tasks").cast("int").alias("tasks"), "capture_ms", "latency_ms", plain.alias("boxes"))


def _patched(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """``rows`` with the boxes that ``patches`` has for their frames."""
    new = patches.select(F.col("camera").alias("p_camera"), F.col("frame_id").alias("p_frame"), F.col("out").alias("p_out"), F.col("latency_ms").alias("p_latency"))
    met = rows.join(new, F.col("camera").eqNullSafe(F.col("p_camera")) & (F.col("frame_id") == F.col("p_frame")), "left")
    return met.withColumns({"out": F.coalesce("p_out", "out"), "latency_ms": F.coalesce("p_latency", "latency_ms")}).select(*rows.columns)


def final_counts(cfg: DetectionConfig, spine: DataFrame, events: DataFrame) -> DataFrame:
    """Counts per frame after one more ownership filter and suppression of all events' boxes, by the configured size."""
    boxes = events.select("frame_id", F.explode("boxes").alias("b")).select("frame_id", "b.*")
    return counts_on_spine(spine, suppress(cfg, boxes, own=True))


def nested_frames(boxes: DataFrame, cameras: int, width: int, height: int) -> DataFrame:
    """FRAME rows from flat boxes: frame f of camera f mod ``cameras``; boxes of rank 0 are also its anchors, with tile -1."""
    from tilewright.functions.geometry import box

    anchor = F.when(F.col("rank") == 0, box().withField("tile_id", F.lit(-1)))
    return boxes.groupBy("frame_id").agg(F.array_sort(F.collect_list(box())).alias("tiles"), F.array_sort(F.collect_list(anchor)).alias("anchors")).select(
        F.concat(F.lit("cam"), (F.col("frame_id") % cameras).cast("string")).alias("camera"), "frame_id", F.lit(width).alias("frame_width"), F.lit(height).alias("frame_height"), F.lit(0.0).alias("capture_ms"), "tiles", "anchors")
