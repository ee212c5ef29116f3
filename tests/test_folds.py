"""The folds over many frames, and over a crowded one, against the columns and the plain fold."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.functions import boxes, folds
from tilewright.functions.geometry import BOX
from tilewright.operators import duplicates
from tilewright.streaming import live

FIELDS = ("neg_conf", "tile_id", "x1", "y1", "x2", "y2", "conf", "rank", "cls")
KIND = pa.list_(pa.struct([(f, pa.float64() if f in ("neg_conf", *folds.FLOATS) else pa.int32()) for f in FIELDS]))


def box(rng, tiles=12, span=600, side=300):
    x, y, c = rng.randint(0, span), rng.randint(0, span // 2), rng.choice([0.3, 0.5, 0.9])
    return (-c, rng.randint(-1, tiles), float(x), float(y), float(x + rng.randint(-3, side)), float(y + rng.randint(-3, side)), c, rng.randint(0, 2), rng.randint(0, 1))


def frames_of(rows, width=1280, height=720):
    return folds.from_arrow(pa.array([[dict(zip(FIELDS, b)) for b in r] for r in rows], KIND), np.full(len(rows), width), np.full(len(rows), height))


CONFIGS = [DetectionConfig(tile_grid="4x3"), DetectionConfig(tile_grid="4x3", duplicate_near_camera=True), DetectionConfig(tile_grid="4x3", duplicate_merge=False, duplicate_ios=0.0, iou=0.3), DetectionConfig(tile_grid="4x3", iou=0.0)]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_frames_side_by_side_equal_columns_and_plain_fold(spark, cfg):
    rng = random.Random(1)
    rows = [[box(rng) for _ in range(rng.choice([0, 1, 2, 7, 19]))] for _ in range(80)]
    got = folds.to_arrow(folds.merged(cfg, frames_of(rows)), KIND).to_pylist()
    table = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, b array<{BOX}>")
    columns = {r.k: [b.asDict() for b in r.kept] for r in table.select("k", duplicates.merge_frame(cfg, F.col("b")).alias("kept")).collect()}
    assert {k: g for k, g in enumerate(got)} == columns
    plain = [boxes.merged_boxes(cfg, [dict(zip(FIELDS, b)) for b in r], [], 1280, 720)[0] for r in rows]
    assert [[{**b, "neg_conf": -b["conf"]} for b in p] for p in plain] == got


@pytest.mark.parametrize("cfg", CONFIGS)
def test_a_crowded_frame_equals_the_plain_fold(cfg, monkeypatch):
    rng = random.Random(2)
    rows = [[box(rng, span=2000, side=rng.choice([20, 60, 900])) for _ in range(250)], [box(rng)] * 3, [(-0.5, 0, 0.0, 0.0, 1e7, 1e7, 0.5, 0, 0), *[box(rng) for _ in range(60)]]]
    want = folds.to_arrow(folds.suppressed(cfg, frames_of(rows, 2000, 1000)), KIND).to_pylist()
    monkeypatch.setattr(folds, "CROWD", 40)
    assert folds.to_arrow(folds.suppressed(cfg, frames_of(rows, 2000, 1000)), KIND).to_pylist() == want


@pytest.mark.parametrize("policy", ["merge", "anchor-gate", "anchor-only"])
def test_anchors_equal_the_columns(spark, policy):
    rng = random.Random(3)
    cfg = DetectionConfig(tile_grid="4x3", live=True, live_anchor_full_frame=True, live_anchor_policy=policy)
    rows = [("c", k, 1280, 720, 0.0, [box(rng) for _ in range(rng.randint(0, 9))], [(b[0], -1, *b[2:]) for b in (box(rng) for _ in range(rng.randint(0, 3)))]) for k in range(60)]
    table = spark.createDataFrame(rows, live.FRAME)
    w, h = F.col("frame_width"), F.col("frame_height")
    columns = table.select("frame_id", duplicates.with_anchors(cfg, duplicates.merge_frame(cfg, F.col("anchors"), w, h), duplicates.merge_frame(cfg, F.col("tiles"), w, h), w, h).alias("boxes"))
    assert {r.frame_id: r.boxes for r in live.merged_frames(cfg, table).collect()} == {r.frame_id: r.boxes for r in columns.collect()}


def test_a_frame_of_many_boxes_takes_no_square_of_time():
    import time

    rng = np.random.default_rng(4)
    n = 20_000
    x, y = rng.uniform(0, 20_000, n), rng.uniform(0, 20_000, n)
    cols = {"x1": x, "y1": y, "x2": x + 60, "y2": y + 120, "conf": rng.uniform(0.3, 1, n), "tile_id": np.zeros(n, np.int64), "rank": np.zeros(n, np.int64), "cls": np.zeros(n, np.int64)}
    begun = time.perf_counter()
    out = folds.suppressed(DetectionConfig(), folds.Frames(cols, np.array([0, n]), np.array([20_000]), np.array([20_000])))
    assert 15_000 < out.offsets[-1] < n and time.perf_counter() - begun < 20


@pytest.mark.parametrize("near", [False, True])
def test_pairs_of_any_size_meet_in_cells(spark, near):
    rng = random.Random(5)
    cfg = DetectionConfig(tile_grid="4x3", duplicate_near_camera=near, duplicate_large_area_ratio=0.001, iou=0.2)
    rows = [(k % 3, k, *box(rng, side=rng.choice([8, 40, 900]))[1:]) for k in range(240)]
    table = spark.createDataFrame(rows, "frame_id int, det_id int, tile_id int, x1 double, y1 double, x2 double, y2 double, conf double, rank int, cls int")
    got = sorted(tuple(r) for r in duplicates.duplicate_pairs(cfg, table).collect())
    plain = [(r[0], r[1], dict(zip(FIELDS, (-r[6], *r[2:])))) for r in rows]
    want = sorted((f, i, j) for f, i, a in plain for g, j, b in plain if f == g and i < j and boxes.same_object(cfg, b, a, 1280, 720))
    assert got == want and len(want) > 50
    assert duplicates.duplicate_pairs(cfg, table.limit(0)).count() == 0


@pytest.mark.parametrize("cfg", CONFIGS)
def test_a_frame_folded_by_components_equals_the_whole_fold(spark, cfg):
    from tilewright.operators import crowds

    rng = random.Random(6)
    # chains of boxes that grow into each other, and far ones
    rows = [(k % 2, 0, *box(rng, span=1500, side=rng.choice([30, 120, 500]))[1:]) for k in range(300)]
    rows += [(2, 0, k % 12, 40.0 * k, 0.0, 40.0 * k + 100, 100.0, [0.9, 0.5, 0.7][k % 3], 0, 0) for k in range(25)] + rows[:5]
    table = spark.createDataFrame(rows, "frame_id int, det_id int, tile_id int, x1 double, y1 double, x2 double, y2 double, conf double, rank int, cls int")
    got, want = (sorted(tuple(r) for r in f(cfg, table).collect()) for f in (crowds.suppress_crowds, duplicates.suppress))
    assert got == want and len(want) < len(rows)
    assert crowds.suppress_crowds(cfg, table.limit(0)).count() == 0


@pytest.mark.parametrize("cfg", CONFIGS)
def test_parts_that_reach_out_of_their_blocks_equal_the_whole_fold(spark, cfg, monkeypatch):
    from tilewright.operators import crowds

    monkeypatch.setattr(crowds, "WIDE", 0.5)
    rng = random.Random(7)
    # twelve frames, from sparse to dense, in blocks smaller than their larger boxes; and chains that run through many blocks
    rows = [(k % 12, 0, *box(rng, span=500 + 400 * (k % 12), side=rng.choice([20, 60, 150, 400]))[1:]) for k in range(1200)]
    rows += [(20 + s, 0, k % 12, 40.0 * k, 11.0 * k * s, 40.0 * k + 100, 11.0 * k * s + 100, [0.9, 0.5, 0.7][k % 3], 0, k // 30) for s in range(2) for k in range(60)]
    table = spark.createDataFrame(rows, "frame_id int, det_id int, tile_id int, x1 double, y1 double, x2 double, y2 double, conf double, rank int, cls int")
    got, want = (sorted(tuple(r) for r in f(cfg, table).collect()) for f in (crowds.suppress_crowds, duplicates.suppress))
    assert got == want and len(want) < len(rows)


def test_parts_that_stay_in_a_block_are_staged_once(spark, monkeypatch):
    from tilewright.operators import crowds

    counts = []

    def counted(df, name):
        out = staged(df, name)
        counts.append(out.count())
        return out

    staged = crowds.staged
    monkeypatch.setattr(crowds, "staged", counted)
    # pairs of duplicates far from each other
    rows = [(f, 0, 300.0 * k + d, 10.0, 300.0 * k + d + 50, 110.0, 0.9 - d / 10, 0, 0) for f in range(20) for k in range(40) for d in range(2)]
    table = spark.createDataFrame(rows, "frame_id int, tile_id int, x1 double, y1 double, x2 double, y2 double, conf double, rank int, cls int")
    assert crowds.suppress_crowds(DetectionConfig(), table).count() == len(rows) // 2
    assert sum(counts) < 3.5 * len(rows)


def test_parts_of_many_boxes_at_one_place_take_no_list_of_their_pairs():
    import tracemalloc

    from tilewright.functions import parts

    n = 5_000
    c = {k: np.full(n, v) for k, v in {"x1": 10.0, "y1": 10.0, "x2": 60.0, "y2": 110.0, "tile_id": 0, "rank": 0, "cls": 0}.items()} | {"conf": np.linspace(0.1, 0.9, n)}
    tracemalloc.start()
    labels, kept, part = parts.closed(DetectionConfig(), c, np.zeros(n, np.int64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (labels == 0).all() and kept["conf"].tolist() == [0.9] and part.tolist() == [0] and most < 300e6


def test_components_of_chains(spark):
    from tilewright.operators import crowds

    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (105, 101), (200, 200)]
    out = {r.node: r.label for r in crowds.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 105: 100, 200: 200}
