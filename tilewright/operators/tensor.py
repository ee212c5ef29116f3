"""Feature maps as rows (img, c, y, x, v): convolution, ReLU, pooling, blocks with halos, stacks and errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.text import split_end, split_index, split_start
from tilewright.operators import blocks as B
from tilewright.shared import bucketed

#: E9, fixed values: output channels of the layers of each profile, and the layers after which pooling follows.
PROFILES = {"tiny": (4, 8, 8, 8, 8, 8, 8, 8), "small": (16, 32, 64, 64, 128, 128, 128, 128), "full": (64, 128, 256, 256, 512, 512, 512, 512)}
POOL_AFTER = (1, 2, 4, 6, 8)


def layers(profile: str) -> list[tuple[int, int, bool]]:
    """(layer, output channels, whether pooling follows)."""
    return [(k, n, k in POOL_AFTER) for k, n in enumerate(PROFILES[profile], 1)]


def synthetic_map(spark: SparkSession, channels: int, height: int, width: int, img: int = 0) -> DataFrame:
    """sin(0.013 ((c + 1) 17 + 3 y + x))."""
    i = F.col("id")
    rows = spark.range(channels * height * width).select((F.floor(i / (height * width))).cast("int").alias("c"), (F.floor(i / width) % height).cast("int").alias("y"), (i % width).cast("int").alias("x"))
    return rows.select(F.lit(img).alias("img"), "c", "y", "x", F.sin(0.013 * ((F.col("c") + 1) * 17 + 3 * F.col("y") + F.col("x"))).alias("v"))


def synthetic_weights(spark: SparkSession, layer: int, inputs: int, outputs: int) -> DataFrame:
    """(oc, ic, ky, kx, w, b) with w = 0.035 sin(0.007 (i + 101 (layer + 1))), i over oc, ic, ky, kx; b = 0.01 cos(0.11 (layer + oc))."""
    i = F.col("id")
    rows = spark.range(outputs * inputs * 9).select("id", F.floor(i / (inputs * 9)).cast("int").alias("oc"), (F.floor(i / 9) % inputs).cast("int").alias("ic"), (F.floor(i / 3) % 3).cast("int").alias("ky"), (i % 3).cast("int").alias("kx"))
    return rows.select("oc", "ic", "ky", "kx", (0.035 * F.sin(0.007 * (i + 101 * (layer + 1)))).alias("w"), (0.01 * F.cos(0.11 * (layer + F.col("oc")))).alias("b"))


def _gathered(pixels: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """Every pixel goes to the nine places that it counts for, meets its weights and is summed there.

    Spark broadcasts the weights (E12) up to its own limit of size; those of larger layers are joined by shuffle. Partial sums are made before the shuffle.
    """
    spread = pixels.select(*keys, "c", "y", "x", "v", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"))
    spread = spread.select(*keys, F.col("c").alias("s_ic"), (F.col("y") + 1 - F.floor(F.col("k") / 3)).cast("int").alias("y"), (F.col("x") + 1 - F.col("k") % 3).cast("int").alias("x"), "v", "k")
    met = spread.join(weights, (F.col("s_ic") == F.col("ic")) & (F.col("k") == F.col("ky") * 3 + F.col("kx")))
    return met.groupBy(*keys, F.col("oc").alias("c"), "y", "x").agg((F.sum(F.col("v") * F.col("w")) + F.first("b")).alias("v"))


def conv3x3(pixels: DataFrame, weights: DataFrame, height: int, width: int, channels: int = 1) -> DataFrame:
    """3x3 convolution with zero border; same height and width, missing pixels are 0 (E2). In blocks of a bounded size, a matrix product each."""
    return conv3x3_blocks(pixels, weights, channels, B.grid_for(channels, height, width))


def conv3x3_joined(pixels: DataFrame, weights: DataFrame, height: int, width: int) -> DataFrame:
    """E8 as a join of pixels and weights by channel and offset, for weights of any size."""
    out = _gathered(pixels, ["img"], weights)
    return out.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def relu(pixels: DataFrame) -> DataFrame:
    """P18."""
    return pixels.withColumn("v", F.greatest(F.lit(0.0), F.col("v")))


def max_pool(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """2x2 maximum; odd edges fall away, maps thinner than 2 stay as they are."""
    if height < 2 or width < 2:
        return pixels
    inner = pixels.where((F.col("y") < height // 2 * 2) & (F.col("x") < width // 2 * 2))
    return inner.groupBy("img", "c", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.max("v").alias("v"))


def blocks(spark: SparkSession, height: int, width: int, rows: int, cols: int) -> DataFrame:
    """(block, br, bc, y0, y1, x0, x1) of a rows x cols grid, half-open, row-major."""
    one = spark.range(1).select(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(rows).alias("rows"), F.lit(cols).alias("cols"))
    return blocks_of(one).drop("height", "width", "rows", "cols")


def blocks_of(grids: DataFrame) -> DataFrame:
    """P14, P15, J14 for a table of grids (height, width, rows, cols, and any other columns): a row for each block of each grid."""
    at = lambda f, total, parts, k: f(F.col(total), F.col(parts), F.col(k)).cast("int").alias
    rows = grids.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)).alias("block"))
    rows = rows.select("*", F.floor(F.col("block") / F.col("cols")).cast("int").alias("br"), (F.col("block") % F.col("cols")).cast("int").alias("bc"))
    return rows.select("*", at(split_start, "height", "rows", "br")("y0"), at(split_end, "height", "rows", "br")("y1"), at(split_start, "width", "cols", "bc")("x0"), at(split_end, "width", "cols", "bc")("x1"))


def with_halo(pixels: DataFrame, height: int, width: int, rows: int, cols: int, halo: int = 1) -> DataFrame:
    """Every pixel once for each block of a rows x cols grid whose range, wider by ``halo``, has it. A pixel's blocks follow from its place, without a join."""
    def near(k: str, total: int, parts: int) -> Column:
        return F.sequence(split_index(total, parts, F.greatest(F.lit(0), F.col(k) - halo)), split_index(total, parts, F.least(F.lit(total - 1), F.col(k) + halo)))
    spread = pixels.withColumn("br", F.explode(near("y", height, rows))).withColumn("bc", F.explode(near("x", width, cols)))
    return spread.select("img", (F.col("br") * cols + F.col("bc")).cast("int").alias("block"), "c", "y", "x", "v")


def conv3x3_blocks(pixels: DataFrame, weights: DataFrame, channels: int, grid: B.Grid, mode: str = "strips", relu: bool = False) -> DataFrame:
    """The pixels of a convolution by blocks of ``grid``, whose borders meet as ``mode`` says; weights beyond B.WEIGHT_BYTES are joined instead."""
    dense = B.dense_weights(weights, channels)
    if dense is None:
        out = conv3x3_joined(pixels, weights, grid.height, grid.width)
        return out.withColumn("v", F.greatest(F.lit(0.0), F.col("v"))) if relu else out
    blocks = B.pack(pixels, grid)
    if grid.rows * grid.cols == 1:
        met = blocks.select("img", "block", "v", F.array().cast("array<int>").alias("sides"), F.array().cast("array<double>").alias("borders"))
    else:
        # strips and cores are two reads of the blocks, so those are written, in buckets by block
        met = B.with_strips(bucketed(blocks, ["img", "block"], "blocks"), grid, mode)
    return B.unpack(B.convolved(met, grid, dense, relu), B.Grid(len(dense[1]), grid.height, grid.width, grid.rows, grid.cols))


def stack(spark: SparkSession, pixels: DataFrame, channels: int, height: int, width: int, profile: str, depth: int = 8, grid: tuple[int, int] | None = None, save=None, mode: str = "strips") -> DataFrame:
    """``depth`` layers of convolution, ReLU and pooling; by blocks of ``grid``, or of a bounded size without one.

    ``save`` (DataFrame -> DataFrame) cuts the lineage after every second layer, for instance by a written table.
    """
    for layer, outputs, pool in layers(profile)[:depth]:
        weights = synthetic_weights(spark, layer - 1, channels, outputs)
        dealt = B.grid_for(max(channels, outputs), height, width) if grid is None else B.Grid(channels, height, width, min(height, grid[0]), min(width, grid[1]))
        pixels = conv3x3_blocks(pixels, weights, channels, B.Grid(channels, height, width, dealt.rows, dealt.cols), mode, relu=True)
        channels = outputs
        if pool and height >= 2 and width >= 2:
            pixels, height, width = max_pool(pixels, height, width), height // 2, width // 2
        if save and layer % 2 == 0:
            pixels = save(pixels)
    return pixels


def tensor_error(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Largest and mean absolute difference and whether the largest is below 1e-3; a pixel of one side only is an error."""
    keys = ["img", "c", "y", "x"]
    both = expected.select(*keys, F.col("v").alias("a")).join(actual.select(*keys, F.col("v").alias("b")), keys, "full_outer")
    diff = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("shapes differ")).cast("double")).otherwise(F.abs(F.col("a") - F.col("b")))
    return both.agg(F.coalesce(F.max(diff), F.lit(0.0)).alias("max_abs_error"), F.coalesce(F.avg(diff), F.lit(0.0)).alias("mean_abs_error")).withColumn("correct", F.when(F.col("max_abs_error") < 1e-3, "YES").otherwise("NO"))


def image_set_error(per_image: DataFrame) -> DataFrame:
    """The largest of the largest, the mean of the means."""
    return per_image.agg(F.count("*").alias("images"), F.max("max_abs_error").alias("max_abs_error"), F.avg("mean_abs_error").alias("mean_abs_error"))


def image_errors(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A22 per image."""
    keys = ["img", "c", "y", "x"]
    both = expected.select(*keys, F.col("v").alias("a")).join(actual.select(*keys, F.col("v").alias("b")), keys)
    return both.groupBy("img").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_error"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_error"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
