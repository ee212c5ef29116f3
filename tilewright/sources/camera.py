"""Live sources: paced frames with their tiles (S4, L7), files of a tree (S10), lines for a viewer (K9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.sources.tasks import tile_bounds


def paced_frames(spark: SparkSession, fps: int) -> DataFrame:
    """A stream of (frame_id, captured), ``fps`` frames a second, from Spark's rate source."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", fps).load()
    return ticks.select(F.col("value").cast("int").alias("frame_id"), F.col("timestamp").alias("captured"))


def frame_tiles(cfg: DetectionConfig, frames: DataFrame) -> DataFrame:
    """The tiles of every frame, bounds rounded to even as the camera does; for streams and tables alike."""
    per_frame = cfg.grid[0] * cfg.grid[1]
    tiles = frames.select("*", F.explode(F.sequence(F.lit(0), F.lit(per_frame - 1))).alias("tile_id"))
    return tiles.select("*", (F.col("frame_id").cast("bigint") * per_frame + F.col("tile_id")).alias("task_id"), *tile_bounds(cfg, F.col("tile_id"), half_even=True))


def located(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, length, content) of the files below ``root`` whose name fits the glob ``pattern``; Spark lists and reads them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length", "content")


def viewer_lines(events: DataFrame) -> DataFrame:
    """K9: (camera, frame_id, place, line) of what a viewer is sent: a FRAME line, a BOX line for each box, an END_FRAME line."""
    head = F.array(F.format_string("FRAME %d %d", "frame_id", "person_count"))
    body = F.transform("boxes", lambda b: F.format_string("BOX %.4f %.4f %.4f %.4f %.4f", b["x1"], b["y1"], b["x2"], b["y2"], b["conf"]))
    lines = F.concat(head, body, F.array(F.format_string("END_FRAME %d", "frame_id")))
    return events.select("camera", "frame_id", F.posexplode(lines).alias("place", "line"))
