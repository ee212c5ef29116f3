"""Duplicate rules, ownership and suppression: hand-made cases and a plain fold as the measure."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.functions import geometry as g
from tilewright.operators import detect, duplicates
from tilewright.sources import tasks

BOXES = "frame_id int, det_id int, tile_id int, rank int, x1 double, y1 double, x2 double, y2 double, conf double, cls int"
CFG = DetectionConfig(tile_grid="4x3")


def frame(spark, rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], BOXES)


def kept(spark, rows, cfg=CFG):
    out = duplicates.suppress(cfg, frame(spark, rows)).collect()
    return sorted((r.x1, r.y1, r.x2, r.y2, r.conf, r.tile_id) for r in out)


def plain_fold(cfg, rows):
    def overlap(a, b):
        w = max(0.0, min(a[4], b[4]) - max(a[2], b[2]))
        h = max(0.0, min(a[5], b[5]) - max(a[3], b[3]))
        size = lambda r: max(0.0, r[4] - r[2]) * max(0.0, r[5] - r[3])
        both, union, small = w * h, size(a) + size(b) - w * h, min(size(a), size(b))
        return (both / union if union > 0 else 0) >= cfg.iou or (both / small if small > 0 else 0) >= cfg.duplicate_ios
    out = []
    for r in sorted(rows, key=lambda r: (-r[6], r[0], *r[2:6])):
        for k, o in enumerate(out):
            if o[7] == r[7] and overlap(r, o):
                out[k] = (o[0], o[1], min(o[2], r[2]), min(o[3], r[3]), max(o[4], r[4]), max(o[5], r[5]), o[6], o[7])
                break
        else:
            out.append(r)
    return sorted((*r[2:6], r[6], r[0]) for r in out)


def test_ties_have_one_survivor_in_either_order(spark):
    a, b = (0, 0, 0.0, 0.0, 10.0, 10.0, 0.5, 0), (1, 0, 0.0, 0.0, 10.0, 10.0, 0.5, 0)
    assert kept(spark, [a, b]) == kept(spark, [b, a]) == [(0.0, 0.0, 10.0, 10.0, 0.5, 0)]


def test_chain_goes_through_the_grown_box(spark):
    a, b, c = (0, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (0, 0, 3.0, 0.0, 13.0, 10.0, 0.8, 0), (0, 0, 6.0, 0.0, 12.5, 10.0, 0.7, 0)
    # c overlaps a by 4 of 6.5, less than the limit, and lies wholly in the grown box
    assert kept(spark, [a, c]) != kept(spark, [a, b, c])
    assert kept(spark, [a, b, c]) == [(0.0, 0.0, 13.0, 10.0, 0.9, 0)]


def test_only_the_first_match_takes_a_box_in(spark):
    a, b, c = (0, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (0, 0, 11.0, 0.0, 21.0, 10.0, 0.8, 0), (0, 0, 0.0, 0.0, 21.0, 10.0, 0.7, 0)
    assert kept(spark, [a, b, c]) == [(0.0, 0.0, 21.0, 10.0, 0.9, 0), (11.0, 0.0, 21.0, 10.0, 0.8, 0)]


def test_without_merging_boxes_stay_as_they_are(spark):
    a, b = (0, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (0, 0, 1.0, 0.0, 12.0, 10.0, 0.8, 0)
    assert kept(spark, [a, b], DetectionConfig(tile_grid="4x3", duplicate_merge=False)) == [(0.0, 0.0, 10.0, 10.0, 0.9, 0)]


def test_classes_and_empty_boxes_never_match(spark):
    a, b = (0, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 0), (0, 0, 0.0, 0.0, 10.0, 10.0, 0.8, 1)
    flat, turned = (0, 0, 5.0, 5.0, 5.0, 9.0, 0.7, 0), (0, 0, 9.0, 9.0, 1.0, 1.0, 0.6, 0)
    assert len(kept(spark, [a, b, flat, turned])) == 4


@pytest.mark.parametrize("seed", range(4))
def test_suppression_equals_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        rows.append((rng.randint(0, 5), rng.randint(0, 2), float(x), float(y), float(x + rng.randint(0, 40)), float(y + rng.randint(0, 40)), rng.randint(35, 60) / 100, rng.randint(0, 1)))
    got, want = kept(spark, rows), plain_fold(CFG, rows)
    assert got == want and len(want) < 60


def test_owner_filter_borders(spark):
    def owned(tile, cx, cy, cfg=CFG):
        rows = frame(spark, [(tile, 0, cx - 1, cy - 1, cx + 1, cy + 1, 0.5, 0)])
        return duplicates.owner_filter(cfg, rows).count() == 1
    assert owned(0, 319.0, 100.0) and not owned(0, 320.0, 100.0) and owned(1, 320.0, 100.0)
    assert owned(11, 1280.0, 720.0) and not owned(10, 1280.0, 720.0)
    assert owned(-1, 5.0, 5.0) and owned(12, 5.0, 5.0)
    assert owned(3, 5.0, 5.0, DetectionConfig(tile_grid="4x3", tile_owner_filter=False)) and owned(0, 900.0, 5.0, DetectionConfig())


def test_near_camera_branches(spark):
    cfg = DetectionConfig(tile_grid="2x2", duplicate_near_camera=True)

    def near(a, b, tiles=(0, 1), cfg=cfg):
        rows = spark.createDataFrame([(tiles[0], *a, tiles[1], *b)], "ta int, ax1 double, ay1 double, ax2 double, ay2 double, tb int, bx1 double, by1 double, bx2 double, by2 double")
        box = lambda p: F.struct(F.col(f"t{p}").alias("tile_id"), *[F.col(f"{p}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0.5).alias("conf"), F.lit(0).alias("cls"))
        return rows.select(g.near_camera_duplicate(cfg, box("a"), box("b"), F.lit(1280), F.lit(720))).first()[0]
    left, right = (300.0, 100.0, 640.0, 700.0), (645.0, 100.0, 980.0, 700.0)
    assert near(left, right) and not near(left, right, tiles=(0, 0)) and not near(left, right, cfg=DetectionConfig())
    upper, lower = (300.0, 0.0, 900.0, 355.0), (300.0, 360.0, 900.0, 720.0)
    assert near(upper, lower)
    assert near((300.0, 100.0, 900.0, 700.0), (320.0, 120.0, 880.0, 680.0))
    assert not near((0.0, 0.0, 40.0, 40.0), (41.0, 0.0, 80.0, 40.0))


def test_pairs_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [(0, 0, float(x), float(y), float(x + rng.randint(20, 300)), float(y + rng.randint(20, 300)), 0.5, 0) for x, y in [(rng.randint(-50, 900), rng.randint(-50, 600)) for _ in range(60)]]
    boxes = frame(spark, rows)
    a, b = (boxes.select("det_id", g.box().alias("box")).alias(n) for n in "ab")
    want = a.crossJoin(b).where((F.col("a.det_id") < F.col("b.det_id")) & g.duplicate(CFG, F.col("a.box"), F.col("b.box"))).select("a.det_id", "b.det_id").collect()
    got = [(r.a, r.b) for r in duplicates.duplicate_pairs(CFG, boxes).collect()]
    assert sorted(got) == sorted(tuple(r) for r in want) and got


def test_frames_without_boxes_count_zero(spark):
    spine = duplicates.frame_spine(spark, 0, 3)
    out = {r.frame_id: r.person_count for r in duplicates.counts_on_spine(spine, frame(spark, [(0, 0, 0.0, 0.0, 1.0, 1.0, 0.5, 0)])).collect()}
    assert out == {0: 1, 1: 0, 2: 0}


def test_mock_detector_totals(spark):
    for grid, total, first in (("1x1", 39, 1), ("2x2", 159, 7), ("4x3", 480, 24), ("5x4", 800, 39)):
        cfg = DetectionConfig(tile_grid=grid)
        boxes = detect.detect(cfg, tasks.tasks(spark, cfg))
        assert boxes.count() == total and boxes.where("frame_id = 0").count() == first


def test_command_detector_skips_comments_and_failures(spark):
    cfg = DetectionConfig(tile_grid="2x2", frames=1, detector="command", detector_command="test {tile_id} -ne 2 && printf '# x\\n1,2,3,4,0.5\\nbad\\n'")
    out = detect.detect(cfg, tasks.tasks(spark, cfg)).orderBy("tile_id").collect()
    assert [r.tile_id for r in out] == [0, 1, 3]
    assert (out[1].x1, out[1].y1) == (1.0 + 576, 2.0)


def test_worker_detector_loads_once_and_filters(spark):
    import pandas as pd

    def load():
        return lambda batch: pd.DataFrame({"task_id": batch.task_id.repeat(2), "frame_id": batch.frame_id.repeat(2), "tile_id": batch.tile_id.repeat(2), "x1": 1.0, "y1": 1.0, "x2": 2.0, "y2": 2.0, "conf": [0.9, 0.1] * len(batch), "cls": 0})
    cfg = DetectionConfig(tile_grid="2x2", frames=2, detector="worker")
    out = detect.detect(cfg, tasks.tasks(spark, cfg), load)
    assert out.count() == 8 and {r.conf for r in out.collect()} == {0.9}


@pytest.mark.parametrize("bad", [{"tile_grid": "0x3"}, {"tile_grid": "4"}, {"frames": 0}, {"schedule": "x"}, {"detector": "command"}, {"iou": 2}, {"live": True, "detector": "command", "detector_command": "x"}, {"duplicate_gap": -1}])
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        DetectionConfig(**bad)


def test_commands_share_a_shell_but_nothing_else():
    lines = ["echo a; x=1; exit 0", "echo ${x-none}", "cat; echo \"it's\"", "echo b; false", "if", "printf 'c\\n1'", "echo d; kill -9 $$", "(sleep 0.2; echo late) & echo e", "echo f >&2"] * 3
    got = list(detect._printed(lines))
    assert [t and t.strip() for t in got] == ["a", "none", "it's", None, None, "c\n1", None, "e\nlate", ""] * 3


def test_programs_and_models_run_in_many_tasks(spark):
    cfg = DetectionConfig(tile_grid="4x3", detector="command", detector_command="echo 1,2,3,4,0.5")
    frames = spark.range(200).select(F.floor(F.col("id") / 2).alias("frame_id")).distinct()
    out = detect.detect(cfg, tasks.frame_tasks(cfg, frames)).withColumn("part", F.spark_partition_id())
    assert out.count() == 1200 and out.select("part").distinct().count() == 4
