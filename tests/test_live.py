"""Temporal de-duplication: hand-made cases, table against stream, policies, and the closing pass."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.functions import boxes
from tilewright.functions.geometry import BOX, duplicate, near_camera_duplicate, temporal_match
from tilewright.operators.duplicates import frame_spine
from tilewright.streaming import frames as live_frames
from tilewright.streaming import live

CFG = DetectionConfig(tile_grid="1x1", live=True, live_temporal_dedup=True)


def box(x1, y1, x2, y2, conf=0.5, tile=0, cls=0):
    return {"neg_conf": -conf, "tile_id": tile, "x1": float(x1), "y1": float(y1), "x2": float(x2), "y2": float(y2), "conf": conf, "rank": 0, "cls": cls}


def test_no_history_or_one_box_changes_nothing():
    two = [box(0, 0, 10, 10), box(100, 0, 110, 10)]
    assert live.dedup(CFG, two, []) == two and live.dedup(CFG, two[:1], two) == two[:1]
    assert live.dedup(DetectionConfig(), two, two) == two


def test_two_and_three_matches_are_one_and_used_boxes_stay_used():
    old = box(0, 0, 100, 100)
    parts = [box(0, 0, 60, 100), box(50, 0, 100, 100), box(20, 0, 80, 100)]
    one = live.dedup(CFG, parts, [old])
    assert len(one) == 1 and (one[0]["x1"], one[0]["x2"]) == (0.0, 100.0)
    assert live.dedup(CFG, parts, [old, old]) == one
    lone = live.dedup(CFG, [box(0, 0, 100, 100), box(500, 0, 600, 100)], [old])
    assert len(lone) == 2


def test_other_class_does_not_match():
    assert len(live.dedup(CFG, [box(0, 0, 60, 100, cls=1), box(50, 0, 100, 100, cls=1)], [box(0, 0, 100, 100)])) == 2


def frames(spark, policy="merge"):
    rows = []
    for f in range(12):
        tiles = [tuple(box(10 + f, 0, 70 + f, 100, 0.6).values()), tuple(box(60 + f, 0, 110 + f, 100, 0.5).values()), tuple(box(400, 0, 450, 90, 0.4).values())]
        rows.append((f"cam{f % 2}", f, 1280, 720, 1.0, tiles, [tuple(box(10 + f, 0, 112 + f, 100, 0.9, -1).values())] if f % 3 else []))
    return spark.createDataFrame(rows, live.FRAME)


@pytest.mark.parametrize(("policy", "counts"), [("merge", {0: 3, 1: 2}), ("anchor-gate", {0: 3, 1: 1}), ("anchor-only", {0: 0, 1: 1})])
def test_anchor_policies(spark, policy, counts):
    cfg = DetectionConfig(tile_grid="1x1", live=True, live_anchor_full_frame=True, live_anchor_policy=policy)
    out = {r.frame_id: (len(r.boxes), r.tasks) for r in live.merged_frames(cfg, frames(spark)).collect()}
    assert {f: out[f][0] for f in counts} == counts
    assert out[1][1] == 1


def test_stream_equals_table_and_plain_fold(spark, tmp_path):
    cfg = DetectionConfig(tile_grid="1x1", live=True, live_temporal_dedup=True)
    table = {(r.camera, r.frame_id): [b.asDict() for b in r.boxes] for r in live.dedup_frames(cfg, frames(spark)).collect()}
    rows = frames(spark)
    for k in range(3):
        rows.where(f"frame_id div 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with live_frames.typed_state(spark):
        live_frames.run_through(live_frames.live_frames(cfg, live_frames.protocol_rows(stream, 2)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")))
    streamed = {(r.camera, r.frame_id): [b.asDict() for b in r.boxes] for r in spark.read.schema(live_frames.EVENT).parquet(str(tmp_path / "out")).collect()}
    assert streamed == table and len(table) == 12
    before, want = {}, {}
    for r in sorted(live.merged_frames(cfg, rows).collect(), key=lambda r: r.frame_id):
        before[r.camera] = live.dedup(cfg, [b.asDict() for b in r.boxes], before.get(r.camera, []))
        want[r.camera, r.frame_id] = [{k: v for k, v in b.items() if k != "neg_conf"} for b in before[r.camera]]
    assert want == table


def test_closing_pass_can_lose_a_box_whose_grown_centre_left_its_tile(spark):
    cfg = DetectionConfig(tile_grid="4x3", live=True)
    event = [("cam", 0, 1, 12, 1.0, 2.0, [(0, 0, 300.0, 10.0, 400.0, 90.0, 0.5, 0)])]
    events = spark.createDataFrame(event, live.EVENT)
    assert live.final_counts(cfg, frame_spine(spark, 0, 1), events).first().person_count == 0


def random_boxes(rng, n, cls=1):
    out = []
    for k in range(n):
        x, y = rng.randint(0, 600), rng.randint(0, 300)
        out.append(box(x, y, x + rng.randint(-5, 700), y + rng.randint(-5, 400), rng.choice([0.3, 0.5, 0.9]), rng.randint(0, 3), rng.randint(0, cls)))
    return out


def test_plain_rules_equal_the_column_rules(spark):
    rng = random.Random(1)
    cfg = DetectionConfig(tile_grid="4x3", live=True, live_temporal_dedup=True, duplicate_near_camera=True)
    pairs = [(a, b) for a, b in zip(random_boxes(rng, 400), random_boxes(rng, 400))]
    rows = spark.createDataFrame([(k, tuple(a.values()), tuple(b.values())) for k, (a, b) in enumerate(pairs)], f"k int, a {BOX}, b {BOX}")
    a, b = F.col("a"), F.col("b")
    out = {r.k: tuple(r)[1:] for r in rows.select("k", temporal_match(cfg, a, b), near_camera_duplicate(cfg, a, b, F.lit(1280), F.lit(720)), duplicate(cfg, a, b)).collect()}
    want = {k: (boxes.matches(cfg, a, b), boxes.near_camera(cfg, a, b, 1280, 720), boxes.same_object(cfg, a, b, 1280, 720)) for k, (a, b) in enumerate(pairs)}
    assert out == want and all(0 < sum(w[k] for w in want.values()) < 400 for k in range(3))


def test_near_camera_parts_are_one_after_the_temporal_pass():
    cfg = DetectionConfig(tile_grid="2x1", live=True, live_temporal_dedup=True, duplicate_near_camera=True)
    halves = [box(300, 0, 640, 700, 0.8, 0), box(640, 0, 980, 700, 0.7, 1)]
    old = [box(1100, 0, 1200, 50)]
    assert len(live.dedup(cfg, halves, old, 1280, 720)) == 1
    assert len(live.dedup(DetectionConfig(tile_grid="2x1", live=True, live_temporal_dedup=True), halves, old, 1280, 720)) == 2


@pytest.mark.parametrize(("piece", "sizes"), [(7, [0, 1, 2, 4]), (4, [6, 7, 8]), (1, [3, 5]), (256, [2, 5])])
def test_pieces_give_what_the_whole_sequence_gives(spark, monkeypatch, piece, sizes):
    monkeypatch.setattr(live, "PIECE", piece)
    rng = random.Random(2)
    cfg = DetectionConfig(tile_grid="1x1", live=True, live_temporal_dedup=True)
    # boxes that are wide and alike: what a frame becomes depends on many frames before; frame ids have gaps
    rows = [(f"cam{f % 2}" if f % 2 else None, 3 * f + 40 * (f > 30), 1280, 720, 1.0, [tuple(b.values()) for b in random_boxes(rng, rng.choice(sizes), 0)], []) for f in range(60)]
    table = spark.createDataFrame(rows, live.FRAME)
    before, want = {}, {}
    for r in sorted(live.merged_frames(cfg, table).collect(), key=lambda r: r.frame_id):
        before[r.camera] = live.dedup(cfg, [b.asDict() for b in r.boxes], before.get(r.camera, []))
        want[r.camera, r.frame_id] = [{k: v for k, v in b.items() if k != "neg_conf"} for b in before[r.camera]]
    got = live.dedup_frames(cfg, table).collect()
    assert {(r.camera, r.frame_id): [b.asDict() for b in r.boxes] for r in got} == want and len(got) == 60 and all(r.latency_ms >= 0 and r.person_count == len(r.boxes) for r in got)
    assert live.event_lines(spark.createDataFrame(got[:1], live.EVENT)).first().capture_ms == "1.0000"


def test_pieces_of_no_frames(spark):
    assert live.dedup_frames(CFG, spark.createDataFrame([], live.FRAME)).count() == 0


def test_frames_are_merged_and_folded_in_steps(spark, monkeypatch):
    sizes, real, cfg = [], live.folds.from_arrow, DetectionConfig(tile_grid="1x1", live=True, live_temporal_dedup=True)
    kind = live.merged_frames(cfg, frames(spark)).schema
    monkeypatch.setattr(live.folds, "from_arrow", lambda boxes, w, h: sizes.append(len(boxes)) or real(boxes, w, h))
    batch = frames(spark).coalesce(1).toArrow().combine_chunks().to_batches()[0]
    caught = []

    class Rows:
        schema = frames(spark).schema

        def withColumn(self, *_):
            return type("R", (), {"schema": kind, "withColumn": lambda s, *_: s})()

        def mapInArrow(self, f, _):
            caught.append(f)
    live.merged_frames(cfg, Rows())
    whole = [r for b in caught[0](iter([batch])) for r in b.to_pylist()]
    assert sizes == [12, 12]
    monkeypatch.setattr(live, "STEP", 5)
    sizes.clear()
    assert [r for b in caught[0](iter([batch])) for r in b.to_pylist()] == whole and sizes == [5, 5, 5, 5, 2, 2]
