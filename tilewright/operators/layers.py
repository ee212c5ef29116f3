"""Layer and rank times of convolution runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import most_square_rows
from tilewright.operators.metrics import share


def wall_times(rank_layers: DataFrame) -> DataFrame:
    """A layer takes what its slowest rank takes."""
    return rank_layers.groupBy("layer_id").agg(*[F.max(c).alias(c) for c in ("scatter_ms", "halo_ms", "compute_ms", "gather_ms")])


def last_repeat(rank_layers: DataFrame) -> DataFrame:
    """Layer times are those of the last repeat alone."""
    last = rank_layers.agg(F.max("repeat_no").alias("last"))
    return rank_layers.join(F.broadcast(last), F.col("repeat_no") == F.col("last")).drop("last")


def rank_times(rank_layers: DataFrame) -> DataFrame:
    """Sums over layers and repeats, total, and idle against the slowest compute."""
    sums = rank_layers.groupBy("rank").agg(*[F.sum(c).alias(c) for c in ("scatter_ms", "halo_ms", "compute_ms", "gather_ms")])
    top = sums.agg(F.max("compute_ms").alias("top"))
    return sums.join(F.broadcast(top)).select("rank", "scatter_ms", "halo_ms", "compute_ms", "gather_ms", (F.col("scatter_ms") + F.col("halo_ms") + F.col("compute_ms") + F.col("gather_ms")).alias("total_ms"),
                                              (F.col("top") - F.col("compute_ms")).alias("idle_ms"))


def breakdown_of_largest(runs: DataFrame) -> DataFrame:
    """Sums per layer of each mode's run with the most processes."""
    top = runs.groupBy("halo_mode").agg(F.max("p").alias("p"))
    return runs.join(F.broadcast(top), ["halo_mode", "p"]).groupBy("halo_mode", "p", "layer_id").agg(*[F.sum(c).alias(c) for c in ("scatter_ms", "halo_ms", "compute_ms", "gather_ms")])


def run_totals(runs: DataFrame) -> DataFrame:
    """Times of all layers of a run together; distributed_ms is their sum."""
    sums = runs.groupBy("halo_mode", "p").agg(*[F.sum(c).alias(c) for c in ("scatter_ms", "halo_ms", "compute_ms", "gather_ms")])
    return sums.withColumn("distributed_ms", F.col("scatter_ms") + F.col("halo_ms") + F.col("compute_ms") + F.col("gather_ms"))


def halo_share(totals: DataFrame) -> DataFrame:
    """Share of the halo in a run's time; 0 for a run without time."""
    return totals.withColumn("halo_ratio", share(F.col("halo_ms"), F.col("distributed_ms")))


def conv_summary(runs: DataFrame, errors: DataFrame, *, profile: str, height: int, width: int, conv_layers: int = 8) -> DataFrame:
    """K7: a row per run (halo_mode, p) with its grid, times and the error of its result; serial_ms is the run of one process in that mode."""
    totals = run_totals(runs)
    serial = totals.where("p = 1").select("halo_mode", F.col("distributed_ms").alias("serial_ms"))
    rows = most_square_rows(F.col("p"))
    return totals.join(serial, "halo_mode", "left").join(F.broadcast(errors)).select(
        F.lit(profile).alias("profile"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.col("p").alias("world_size"), rows.cast("int").alias("grid_rows"), (F.col("p") / rows).cast("int").alias("grid_cols"),
        F.lit(conv_layers).alias("conv_layers"), "halo_mode", "distributed_ms", "serial_ms", "max_abs_error", "mean_abs_error", "correct")


def image_table(images: DataFrame, times: DataFrame, errors: DataFrame) -> DataFrame:
    """K7: a row per image from (image_index, path, height, width), its times (image_index, distributed_ms, serial_ms) and its errors (img, max_abs_error, mean_abs_error)."""
    return images.join(times, "image_index").join(errors, F.col("image_index") == F.col("img")).select(
        "image_index", F.col("path").alias("image_path"), "height", "width", "distributed_ms", "serial_ms", "max_abs_error", "mean_abs_error", F.when(F.col("max_abs_error") < 1e-3, "YES").otherwise("NO").alias("correct"))
