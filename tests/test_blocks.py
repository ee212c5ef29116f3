"""Convolution on block rows: against the join of pixels and weights, in both modes, and what moves."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.operators import blocks, tensor
from tilewright.shared import bucketed


def pixels(spark, channels, height, width, images=2, missing=0.0, seed=1):
    rng = random.Random(seed)
    rows = [(i, c, y, x, float(rng.randint(-9, 9))) for i in range(images) for c in range(channels) for y in range(height) for x in range(width) if rng.random() >= missing]
    return spark.createDataFrame(rows, "img int, c int, y int, x int, v double")


def weights(spark, inputs, outputs, seed=2):
    rng = random.Random(seed)
    return spark.createDataFrame([(o, i, k // 3, k % 3, float(rng.randint(-3, 3)), float(o)) for o in range(outputs) for i in range(inputs) for k in range(9)], "oc int, ic int, ky int, kx int, w double, b double")


def placed(df):
    rows = {(r.img, r.c, r.y, r.x): r.v for r in df.collect()}
    assert len(rows) == df.count()
    return rows


@pytest.mark.parametrize(("height", "width", "grid"), [(7, 5, (3, 2)), (6, 6, (1, 1)), (4, 9, (4, 9)), (1, 3, (1, 2)), (5, 5, (2, 1))])
@pytest.mark.parametrize("mode", ["replicate", "strips"])
def test_blocks_equal_the_join(spark, height, width, grid, mode):
    maps, w = pixels(spark, 3, height, width), weights(spark, 3, 2)
    want = placed(tensor.conv3x3_joined(maps, w, height, width))
    assert placed(tensor.conv3x3_blocks(maps, w, 3, blocks.Grid(3, height, width, *grid), mode)) == want and len(want) == 2 * 2 * height * width
    assert placed(tensor.conv3x3(maps, w, height, width, 3)) == want


@pytest.mark.parametrize("mode", ["replicate", "strips"])
def test_missing_pixels_and_blocks_count_as_zeros(spark, mode):
    maps, w = pixels(spark, 1, 8, 8, missing=0.6).where("not (y < 4 and x < 4) and y <> 7"), weights(spark, 1, 1)
    got, want = placed(tensor.conv3x3_blocks(maps, w, 1, blocks.Grid(1, 8, 8, 4, 4), mode)), placed(tensor.conv3x3_joined(maps, w, 8, 8))
    assert {k: got[k] for k in want} == want and all(v == 0.0 for k, v in got.items() if k not in want)  # a bias of 0
    assert tensor.conv3x3_blocks(maps.limit(0), w, 1, blocks.Grid(1, 8, 8, 2, 2), mode).count() == 0


def test_weights_beyond_the_bound_are_joined(spark, monkeypatch):
    maps, w = pixels(spark, 2, 4, 4), weights(spark, 2, 3)
    want = placed(tensor.conv3x3(maps, w, 4, 4, 2))
    monkeypatch.setattr(blocks.dense_weights, "__defaults__", (100,))
    assert blocks.dense_weights(w, 2) is None
    assert placed(tensor.conv3x3(maps, w, 4, 4, 2)) == want


def test_strips_move_no_core(spark):
    grid = blocks.Grid(2, 12, 12, 3, 3)
    cores = bucketed(blocks.pack(pixels(spark, 2, 12, 12, 3), grid), ["img", "block"], "cores")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        plan = {mode: blocks.with_strips(cores, grid, mode)._jdf.queryExecution().executedPlan().toString() for mode in ("strips", "replicate")}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # cores come from their buckets on both sides; the one exchange is that of the strips
    assert plan["strips"].count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan["strips"]
    moved = blocks.strips(cores, grid).select(F.sum(F.size("v")).alias("n")).first().n
    assert moved == 3 * 2 * sum(s.size for b in range(9) for k in range(8) if grid.neighbour(b, k) is not None for s in [grid.strip(np.zeros((1, 4, 4)), k)])
    assert moved < 3 * 2 * 144


def test_grids_hold_their_bound():
    for c, h, w in ((1, 8, 8), (64, 224, 224), (512, 14, 14), (3, 5000, 2)):
        g = blocks.grid_for(c, h, w)
        sizes = [(y1 - y0) * (x1 - x0) for y0, y1, x0, x1 in map(g.bounds, range(g.rows * g.cols))]
        assert sum(sizes) == h * w and (max(sizes) * c <= 2 * blocks.BLOCK_VALUES or max(sizes) == 1)


def test_a_batch_is_worked_through_in_steps_of_bounded_size(monkeypatch):
    shapes, real = [], blocks.product
    monkeypatch.setattr(blocks, "product", lambda e, w, b: shapes.append(e.shape) or real(e, w, b))
    w, bias = np.random.default_rng(1).integers(-3, 4, (2, 1, 3, 3)).astype(float), np.array([1.0, -1.0])
    maps = np.random.default_rng(2).integers(-9, 10, (5000, 64)).astype(float)
    none = pa.array([[]] * 5000, pa.list_(pa.int32()))
    out = blocks.batch_convolved(blocks.Grid(1, 8, 8), (w, bias), False, pa.array([0] * 5000, pa.int32()), pa.array(list(maps), pa.list_(pa.float64())), none, none.cast(pa.list_(pa.float64())))
    assert 1 < len(shapes) < 100 and max(s[0] for s in shapes) * 9 * 64 <= blocks.STEP_VALUES
    padded = np.pad(maps.reshape(-1, 8, 8), ((0, 0), (1, 1), (1, 1)))
    want = sum(w[:, 0, y, x][None, :, None, None] * padded[:, None, y:y + 8, x:x + 8] for y in range(3) for x in range(3)) + bias[None, :, None, None]
    assert np.array_equal(np.array(out.to_pylist()), want.reshape(5000, -1))
