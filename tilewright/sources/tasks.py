"""Work items: frames x tiles (S1, S2, P1, J1), assignment to ranks (F8), hosts of ranks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.shared import numbered


def parse_grid(grid: Column) -> tuple[Column, Column]:
    """(columns, rows) of texts like 4x3; anything else, zeros too, is an error."""
    parts = [F.regexp_extract(F.lower(grid), r"^(\d+)x(\d+)$", k) for k in (1, 2)]
    good = (parts[0] != "") & (parts[0].try_cast("int") > 0) & (parts[1].try_cast("int") > 0)
    return tuple(F.when(good, p.try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("bad tile grid: "), grid)).cast("int")) for p in parts)


def tile_bounds(cfg: DetectionConfig, tile_id: Column, *, half_even: bool = False) -> list[Column]:
    """x1, y1, x2, y2 of a tile with its overlap; halves round up, or to even as the camera source does."""
    cols, rows = cfg.grid
    rounded = F.bround if half_even else F.round
    col, row = tile_id % cols, F.floor(tile_id / cols)

    def edge(k: Column, total: int, parts: int) -> Column:
        return rounded(k * total / F.lit(float(parts)), 0).cast("int")
    return [
        F.greatest(F.lit(0), edge(col, cfg.width, cols) - cfg.overlap).alias("x1"), F.greatest(F.lit(0), edge(row, cfg.height, rows) - cfg.overlap).alias("y1"),
        F.least(F.lit(cfg.width), edge(col + 1, cfg.width, cols) + cfg.overlap).alias("x2"), F.least(F.lit(cfg.height), edge(row + 1, cfg.height, rows) + cfg.overlap).alias("y2")]


def plain_tile_bounds(cfg: DetectionConfig, width: int, height: int) -> list[tuple[int, int, int, int]]:
    """P1, T6 on plain numbers: bounds of all tiles of a frame as a camera cuts them, halves to even."""
    cols, rows = cfg.grid
    edges = lambda total, parts: [round(k * total / parts) for k in range(parts + 1)]
    xs, ys = edges(width, cols), edges(height, rows)
    return [(max(0, xs[c] - cfg.overlap), max(0, ys[r] - cfg.overlap), min(width, xs[c + 1] + cfg.overlap), min(height, ys[r + 1] + cfg.overlap)) for r in range(rows) for c in range(cols)]


def tasks(spark: SparkSession, cfg: DetectionConfig) -> DataFrame:
    """One row per frame and tile with a dense task_id (W3); a range, so no join and no numbering pass."""
    per_frame = cfg.grid[0] * cfg.grid[1]
    rows = spark.range(cfg.frames * per_frame).select(
        F.col("id").alias("task_id"), (F.floor(F.col("id") / per_frame) + cfg.start_frame).cast("int").alias("frame_id"), (F.col("id") % per_frame).cast("int").alias("tile_id"))
    return rows.select("*", *tile_bounds(cfg, F.col("tile_id")))


def frame_tasks(cfg: DetectionConfig, frames: DataFrame) -> DataFrame:
    """S1, J1 over given frames: one row per frame_id and tile, task_id by arithmetic."""
    per_frame = cfg.grid[0] * cfg.grid[1]
    rows = frames.select(F.col("frame_id").cast("int").alias("frame_id"), F.explode(F.sequence(F.lit(0), F.lit(per_frame - 1))).alias("tile_id"))
    return rows.select((F.col("frame_id").cast("bigint") * per_frame + F.col("tile_id")).alias("task_id"), "frame_id", "tile_id", *tile_bounds(cfg, F.col("tile_id")))


def assigned(work: DataFrame, ranks: int, chunk: int = 1) -> DataFrame:
    """Block-cyclic rank of every task."""
    return work.withColumn("rank", (F.floor(F.col("task_id") / chunk) % ranks).cast("int"))


def placed_ranks(hosts: DataFrame, policy: str = "slot") -> DataFrame:
    """(rank, host) from (seq, host, slots). slot: fill hosts one by one; node: one rank per host in turn."""
    slots = hosts.select("seq", "host", F.explode(F.sequence(F.lit(1), F.col("slots").cast("int"))).alias("slot"))
    order = ("seq", "slot") if policy == "slot" else ("slot", "seq")
    return numbered(slots, list(order), "rank").select(F.col("rank").cast("int").alias("rank"), "host")


def checked_settings(settings: DataFrame) -> DataFrame:
    """F1 over a table of runs: ``settings`` with ``problem``, what DetectionConfig says of a row's columns that it knows; null if it takes them."""
    known = [f.name for f in fields(DetectionConfig) if f.init]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            problems = []
            for row in batch.to_dict("records"):
                try:
                    DetectionConfig(**{k: v for k, v in row.items() if k in known})
                    problems.append(None)
                except ValueError as error:
                    problems.append(str(error))
            yield batch.assign(problem=problems)

    return settings.mapInPandas(check, settings.withColumn("problem", F.lit(None).cast("string")).schema)
