"""The live path as streams: camera source, frame state, viewer; restarts, disorder, late rows, times."""

from __future__ import annotations

import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.functions import folds
from tilewright.functions.boxes import merged_boxes
from tilewright.functions.geometry import BOX
from tilewright.sinks import viewer
from tilewright.sources import camera_source, recordings
from tilewright.streaming import frames, live

CFG = DetectionConfig(tile_grid="2x1", overlap=1, live=True, live_temporal_dedup=True)


@pytest.fixture
def recording(spark, tmp_path):
    """Seven frames of camera a, three of b: 6 x 2 gray pixels that count up."""
    rows = [(c, k, 10 * k, 6, 2, bytes(range(k, k + 12)), None) for c, n in (("a", 7), ("b", 3)) for k in range(n)]
    recordings.write_recording(spark.createDataFrame(rows, recordings.RECORDED), str(tmp_path / "rec"))
    return str(tmp_path / "rec")


def read_through(spark, path, out, **options):
    lines = camera_source.camera_stream(spark, path, CFG, **options)
    frames.run_through(lines.writeStream.format("parquet").option("path", f"{out}/lines").option("checkpointLocation", f"{out}/log"))
    return sorted((r.camera, r.seq, r.kind, r.tile_id or 0, r.frame_id, r.task_id, r.x1, r.x2, r.tiles, bytes(r.image or b"")) for r in spark.read.parquet(f"{out}/lines").collect())


def test_rows_of_a_recording(spark, recording, tmp_path):
    rows = read_through(spark, recording, tmp_path)
    assert [r[2] for r in rows].count("TILE") == 20 and len(rows) == 10 * 4 + 4
    assert [r for r in rows if r[:2] == ("b", 3)] == [("b", 3, "END_STREAM", 0, None, None, None, None, 3, b"")]
    tiles = [r for r in rows if r[:3] == ("a", 2, "TILE")]
    assert [(r[5], r[6], r[7], r[9]) for r in tiles] == [(4, 0, 4, bytes([2, 3, 4, 5, 8, 9, 10, 11])), (5, 2, 6, bytes([4, 5, 6, 7, 10, 11, 12, 13]))]


def test_a_query_that_stops_goes_on_with_the_same_rows(spark, recording, tmp_path):
    whole = read_through(spark, recording, tmp_path / "one")
    part = str(tmp_path / "two")
    for _ in range(2):  # each run takes one batch of two frames a camera
        lines = camera_source.camera_stream(spark, recording, CFG, frames_per_trigger=2, progress=f"{part}-progress")
        lines.writeStream.format("parquet").option("path", f"{part}/lines").option("checkpointLocation", f"{part}/log").trigger(availableNow=True).start().awaitTermination()
    some = spark.read.parquet(f"{part}/lines").where("kind = 'FRAME'")
    assert some.count() == 4 + 3 and some.distinct().count() == 7
    assert read_through(spark, recording, part, frames_per_trigger=2, progress=f"{part}-progress") == whole


def test_pacing_bounds_and_options(recording, tmp_path):
    def reader(**options):
        return camera_source.CameraReader({"path": recording, "tile_grid": "2x1", **options})

    assert reader().latestOffset() == {"": 0, "a": 8, "b": 4}
    paced = reader(fps="2", began=str(time.time() - 1.1))
    assert paced.latestOffset() == {"": 0, "a": 2, "b": 2}
    assert reader(fps="100", began=str(time.time() - 60)).latestOffset() == {"": 0, "a": 8, "b": 4}
    bounded = reader(frames="2", start_frame="1")
    end = bounded.latestOffset()
    assert end == {"": 0, "a": 4, "b": 4}
    parts = bounded.partitions({"": 0}, end)
    assert [(p.camera, p.start, p.end, p.last) for p in parts] == [("a", 1, 3, True), ("b", 1, 3, True)]
    kinds = [r["kind"] for batch in bounded.read(parts[0]) for r in batch.to_pylist()]
    assert kinds == ["READY", "FRAME", "TILE", "TILE", "END_FRAME", "FRAME", "TILE", "TILE", "END_FRAME", "END_STREAM"]
    assert bounded.partitions(end, end) == []
    small = reader(chunk="3")
    assert [(p.start, p.end, p.last) for p in small.partitions({"": 0, "a": 1}, {"": 0, "a": 8})] == [(1, 4, False), (4, 7, True)]
    assert [(p.start, p.end, p.last) for p in small.partitions({"": 0, "a": 7}, {"": 0, "a": 8})] == [(7, 7, True)]
    for bad in ({"fps": "2"}, {"fps": "-1"}, {"frames_per_trigger": "2"}, {"chunk": "0"}):
        with pytest.raises(ValueError):
            reader(**bad)
    assert camera_source.CameraReader({"path": str(tmp_path / "none")}).latestOffset() == {"": 0}


def box(rng, tile):
    x, y = rng.randint(0, 500), rng.randint(0, 300)
    return (-0.5, tile, float(x), float(y), float(x + rng.randint(20, 300)), float(y + rng.randint(20, 300)), 0.5, 0, 0)


LINE = f"camera string, kind string, seq bigint, frame_id int, width int, height int, captured_ms double, capture_ms double, tile_id int, tiles int, boxes array<{BOX}>"


def protocol(seed, n=12, camera="c"):
    """Rows of n frames in order, by frame."""
    rng, out = random.Random(seed), []
    for k in range(n):
        same = (camera, k, 5 * k, 1280, 720, time.time() * 1000 - 50, 1.5)
        line = lambda kind, tile=None, tiles=None, boxes=None, same=same: (same[0], kind, *same[1:], tile, tiles, boxes)
        out.append([line("FRAME", boxes=[])] + [line("TILE", t, boxes=[box(rng, t) for _ in range(rng.randint(0, 3))]) for t in (0, 1)] + [line("END_FRAME", tiles=2)])
    return out


def ready(camera="c"):
    return (camera, "READY", 0, *[None] * 6, 2, None)


def streamed(spark, tmp_path, batches, cfg=CFG, hold_ms=3_600_000):
    """Events of micro-batches of protocol rows, one list each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, LINE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with frames.typed_state(spark):
        frames.run_through(frames.live_frames(cfg, stream, hold_ms).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")))
    return spark.read.schema(frames.EVENT).parquet(str(tmp_path / "out")).collect()


def fold(cfg, rows):
    """The plain fold over frames in order."""
    before, out = [], {}
    for frame in rows:
        boxes = [dict(zip(frames._FIELDS, b)) for line in frame for b in line[-1] or []]
        before = live.dedup(cfg, merged_boxes(cfg, boxes, [], 1280, 720)[0], before, 1280, 720)
        out[frame[0][2]] = [{f: b[f] for f in frames._OUT} for b in before]
    return out


def test_rows_in_any_order_give_the_fold_in_order(spark, tmp_path):
    rows, rng = protocol(1), random.Random(2)
    lines = [line for frame in rows for line in frame]
    rng.shuffle(lines)
    cuts = [[ready()], *[lines[k::4] for k in range(4)]]
    out = streamed(spark, tmp_path, cuts)
    assert {r.seq: [b.asDict() for b in r.boxes] for r in out} == fold(CFG, rows) and len(out) == 12
    assert {r.status for r in out} == {"whole"} and all(r.latency_ms >= 50 and r.capture_ms == 1.5 and r.frame_id == 5 * r.seq and r.person_count == len(r.boxes) for r in out)


def test_gaps_wait_late_rows_are_told_and_the_end_of_the_stream_lets_all_go(spark, tmp_path):
    rows = protocol(3, 5)
    batches = [[ready(), *rows[0], *rows[2]], rows[1], [rows[0][1], rows[1][3]], [*rows[4][:2], ("c", "END_STREAM", 5, *[None] * 6, 5, None)]]
    out = sorted(streamed(spark, tmp_path, batches), key=lambda r: (r.seq, r.status))
    assert [(r.seq, r.status) for r in out] == [(0, "late"), (0, "whole"), (1, "late"), (1, "whole"), (2, "whole"), (4, "partial")]
    want = fold(CFG, [rows[0], rows[1], rows[2], rows[4][:2]])
    assert {r.seq: [b.asDict() for b in r.boxes] for r in out if r.status != "late"} == want
    assert all(r.boxes == [] and r.person_count is None for r in out if r.status == "late")


class Cell:
    """State variables and a handle in plain Python."""

    def __init__(self):
        self.kept, self.timers = {}, set()

    def getValueState(self, name, schema):
        return Cell()

    getListState = getValueState

    def getMapState(self, name, key, value):
        return Cell()

    def exists(self):
        return bool(self.kept)

    def get(self):
        return self.kept["x"]

    def update(self, value):
        self.kept["x"] = value

    put = update

    def updateValue(self, key, value):
        self.kept[key] = value

    def iterator(self):
        return iter(self.kept.items())

    def clear(self):
        self.kept.clear()

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentProcessingTimeInMs(self):
        return self.at


def test_a_timer_lets_frames_go_that_have_waited_too_long(spark):
    rows = protocol(4, 4)
    lines = [r for batch in spark.createDataFrame([ready(), *rows[1], *rows[2][:2]], LINE).collect() for r in [batch]]
    one = frames.FrameProcessor(CFG, 1000)
    handle = Cell()
    one.init(handle)
    assert list(one.handleInputRows(("c",), iter(lines), Now(5000))) == [] and handle.timers == {6000}
    more = spark.createDataFrame(rows[3], LINE).collect()
    assert list(one.handleInputRows(("c",), iter(more), Now(5500))) == [] and handle.timers == {6000}
    out = list(one.handleExpiredTimer(("c",), Now(6000), None))
    # frame 0 never came and is skipped, 2 lacks a tile, 3 follows it and is whole
    assert [(r.seq, r.status) for r in out] == [(1, "whole"), (2, "partial"), (3, "whole")] and not handle.timers


@pytest.mark.parametrize("policy", ["merge", "anchor-gate", "anchor-only"])
def test_plain_merging_equals_the_columns(spark, policy):
    rng = random.Random(7)
    cfg = DetectionConfig(tile_grid="4x3", live=True, live_anchor_full_frame=True, live_anchor_policy=policy, duplicate_near_camera=True)
    rows = [("c", k, 1280, 720, 0.0, [box(rng, rng.randint(-1, 13)) for _ in range(rng.randint(0, 9))], [box(rng, -1) for _ in range(rng.randint(0, 2))]) for k in range(60)]
    for r in live.merged_frames(cfg, spark.createDataFrame(rows, live.FRAME)).collect():
        plain = merged_boxes(cfg, [b.asDict() for b in r.tiles], [b.asDict() for b in r.anchors], 1280, 720)
        assert ([b.asDict() for b in r.boxes], r.tasks) == ([{**b, "neg_conf": -b["conf"]} for b in plain[0]], plain[1])


def events(spark, n):
    return spark.createDataFrame([("c", k, k, 64, 48, 1, 2, 0.0, 1.0, "whole" if k % 5 else "late", [(0, 0, 1.0, 2.0, 3.0, 4.0, 0.5, 0)]) for k in range(n)], frames.EVENT)


def test_a_viewer_gets_each_frame_once(spark, tmp_path):
    path = str(tmp_path / "viewer")
    writer = viewer.ViewerWriter(path)
    rows = events(spark, 10).collect()
    first, lost = writer.write(iter(rows[:6])), writer.write(iter(rows[:6]))
    writer.abort([lost, None], 0)  # a batch that failed
    writer.commit([first, writer.write(iter([])), None], 0)
    writer.commit([writer.write(iter(rows[:6]))], 0)  # the same batch again after a restart
    writer.commit([writer.write(iter(rows[6:]))], 1)
    writer.write(iter(rows))  # a task whose batch was never committed
    got = sorted((r.frame_id, r.place, r.line) for r in viewer.viewed(spark, path).collect())
    assert got == [(k, p, line) for k in range(10) if k % 5 for p, line in enumerate((f"FRAME {k} 64 48 1", "BOX 1.0000 2.0000 3.0000 4.0000 0.5000", f"END_FRAME {k}"))]


def test_a_viewer_query_that_lost_its_log_delivers_no_frame_twice(spark, tmp_path):
    for k in range(3):
        events(spark, 10).where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(frames.EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        viewer.to_viewer(stream, str(tmp_path / "viewer"), str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()

    run()
    for name in ("2", ".2.crc"):
        (tmp_path / "log" / "commits" / name).unlink()
    run()
    assert viewer.viewed(spark, str(tmp_path / "viewer")).count() == 8 * 3


def test_rows_of_a_frame_reach_the_state_as_one(spark):
    rows = protocol(5, 6)
    lines = [line for frame in rows for line in frame]
    some = spark.createDataFrame([ready(), *lines], LINE).coalesce(1)
    found = some.mapInArrow(frames.packed, frames.PACKED).collect()
    assert [r.kind for r in found] == ["READY", *["PART"] * 6]
    one, plain = frames.FrameProcessor(CFG, 1000), frames.FrameProcessor(CFG, 1000)
    for p in (one, plain):
        p.init(Cell())
    want = [(r.seq, r.frame_id, r.status, r.boxes) for r in plain.handleInputRows(("c",), iter(some.collect()), Now(5000))]
    assert [(r.seq, r.frame_id, r.status, r.boxes) for r in one.handleInputRows(("c",), iter(found), Now(5000))] == want and len(want) == 6


def test_images_of_tiles_are_made_once_each(spark):
    rows = [(f, t, 0.5, float(k), 1.0, float(k + 5), 9.0, 0.5, t % 2, 0) for f in (0, 1) for k, t in enumerate((5, 0, 1, 1, -1))]
    made = recordings.with_tile_images(spark.createDataFrame(rows, "frame_id int, tile_id int, neg_conf double, x1 double, y1 double, x2 double, y2 double, conf double, rank int, cls int"), 2, 64, 48, 3, "rank = 0")
    assert "filter(" not in made._jdf.queryExecution().optimizedPlan().toString()
    for r in made.collect():
        images = [[(b["tile_id"], b["x1"]) for b in json.loads(bytes(i))] for i in r.tile_images]
        assert images == [[(-1, 4.0), (0, 1.0), (5, 0.0)], [(1, 2.0), (1, 3.0)], []] and [b["x1"] for b in json.loads(bytes(r.image))] == [1.0]


def test_a_trigger_over_a_folder_takes_a_bounded_number_of_frames(spark, monkeypatch):
    from pathlib import Path

    from tilewright.plans import detection
    from tilewright.shared import staging_dir

    monkeypatch.setattr(detection, "TRIGGER", 12, raising=False)
    got = detection.l3_live_stream(spark, "/root/testdata/sf0.001")
    want = detection.a10_temporal_dedup(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    last = max(Path(staging_dir(spark)).glob("live-*"), key=lambda p: p.stat().st_mtime)
    assert len(list((last / "state" / "commits").glob("[0-9]*"))) >= 4


def as_runs(spark, cfg, *batches):
    """RUNS rows of batches of protocol rows."""
    return [r for rows in batches for r in spark.createDataFrame(rows, LINE).coalesce(1).mapInArrow(lambda b: frames.runs(cfg, frames.packed(b)), frames.RUNS).collect()]


def told(found):
    """(seq, frame, size, tasks, status, boxes) of what the state sends."""
    def plain(r):
        v = r.asDict()
        return {**v, "boxes": bytes(v["boxes"])}
    names = [f.partition(" ")[0] for f in frames.PACKED_EVENT.split(", ")]
    kinds = {"camera": "string", "status": "string", "boxes": "binary", "seqs": "binary", "seq": "int64", "capture_ms": "float64", "latency_ms": "float64"}
    batch = pa.RecordBatch.from_pylist([plain(r) for r in found], schema=pa.schema([(n, kinds.get(n, "int32")) for n in names]))
    return sorted((r["seq"], r["frame_id"], r["width"], r["height"], r["person_count"], r["tasks"], r["status"], r["capture_ms"], [tuple(b.values()) for b in r["boxes"]]) for b in frames.unpacked(iter([batch])) for r in b.to_pylist())


def processor(cfg, hold_ms=1000):
    one = frames.FrameProcessor(cfg, hold_ms)
    one.init(Cell())
    return one


@pytest.mark.parametrize("policy", [None, "merge", "anchor-gate", "anchor-only"])
@pytest.mark.parametrize("near", [False, True])
def test_runs_give_what_single_rows_give(spark, policy, near):
    rng = random.Random(11)
    cfg = DetectionConfig(tile_grid="2x1", overlap=1, live=True, live_temporal_dedup=True, duplicate_near_camera=near, live_anchor_full_frame=policy is not None, live_anchor_policy=policy or "merge")
    rows = protocol(6, 40)
    for frame in rows[::3]:  # anchors, some of them in a tile that they may not belong to
        frame[0] = (*frame[0][:-1], [box(rng, rng.choice([-1, 0])) for _ in range(rng.randint(0, 2))])
    wide = [(*line[:-1], line[-1] and [(*b[:4], b[4] + 400.0, b[5] + 200.0, rng.choice([0.3, 0.5, 0.9]), *b[7:]) for b in line[-1]]) for frame in rows for line in frame]
    batches = [[ready(), *wide[:60]], wide[60:101], wide[101:]]
    runs, plain = processor(cfg), processor(cfg)
    made = [as_runs(spark, cfg, b) for b in batches]
    assert [[r.kind for r in m] for m in made] == [["READY", "RUN"], ["PART", "RUN"], ["PART", "RUN"]] and len(made[0][1].seqs) == 15 * frames._SEQS.itemsize
    for m, b in zip(made, batches):
        assert told(runs.handleInputRows(("c",), iter(m), Now(5000))) == told(plain.handleInputRows(("c",), iter(spark.createDataFrame(b, LINE).collect()), Now(5000)))
    assert runs.done.get() == plain.done.get() == (39,) and runs.before.kept == plain.before.kept


def test_runs_with_gaps_late_frames_and_rows_that_come_twice(spark):
    rows = protocol(7, 20)
    lines = lambda low, high: [line for frame in rows[low:high] for line in frame]
    more = (*rows[13][1][:8], 1, None, [(-0.9, 1, 5.0, 5.0, 900.0, 700.0, 0.9, 0, 0)])
    end = ("c", "END_STREAM", 20, *[None] * 6, 20, None)
    # a run of frames that wait, the frames before them, a run that is late, one with a frame that has rows elsewhere, the end after a gap
    triggers = [[[ready(), *lines(4, 8)]], [lines(0, 4)], [lines(2, 6)], [lines(6, 10)], [[more], lines(10, 16)], [lines(18, 20)], [[end]]]
    runs, plain = processor(CFG), processor(CFG)
    seen = []
    for k, t in enumerate(triggers):
        got = told(runs.handleInputRows(("c",), iter(as_runs(spark, CFG, *t)), Now(5000 + k)))
        assert got == told(plain.handleInputRows(("c",), iter([r for b in t for r in spark.createDataFrame(b, LINE).collect()]), Now(5000 + k))) and runs.handle.timers == plain.handle.timers
        seen += [(g[0], g[6]) for g in got]
    assert [s for s, status in seen if status == "whole"] == [*range(16), 18, 19] and sorted(s for s, status in seen if status == "late") == [2, 3, 4, 5, 6, 7]


def test_the_state_folds_only_the_frames_of_a_run_that_differ(spark, monkeypatch):
    rows = protocol(8, 60)
    batches = [[ready(), *[line for frame in rows[:30] for line in frame]], [line for frame in rows[30:] for line in frame]]
    want, calls, real = fold(CFG, rows), [], frames.dedup
    made = [as_runs(spark, CFG, b) for b in batches]
    monkeypatch.setattr(frames, "dedup", lambda *a: calls.append(1) or real(*a))
    one, got = processor(CFG), {}
    for m in made:
        got.update({t[0]: [dict(zip(frames._OUT, b)) for b in t[-1]] for t in told(one.handleInputRows(("c",), iter(m), Now(5000)))})
    assert got == want and len(calls) <= 12


def test_frames_side_by_side_are_folded_as_one_by_one():
    rng = random.Random(9)
    for near in (False, True):
        cfg = DetectionConfig(tile_grid="2x1", live=True, live_temporal_dedup=True, duplicate_near_camera=near)
        rows = [[dict(zip(frames._FIELDS, (-c, rng.randint(0, 1), x, y, x + rng.randint(-5, 700), y + rng.randint(-5, 400), c, 0, rng.randint(0, 1)))) for x, y, c in [(float(rng.randint(0, 600)), float(rng.randint(0, 300)), rng.choice([0.3, 0.5, 0.9])) for _ in range(rng.choice([0, 1, 2, 5, 9]))]] for _ in range(120)]
        first = np.array([k % 37 == 0 for k in range(120)])
        parts = [np.array([[b[n] for n in folds.NAMES] for b in r], float).reshape(-1, len(folds.NAMES)) for r in rows]
        got = live.dedup_runs(cfg, folds.Frames.of_parts(parts, np.full(120, 1280), np.full(120, 720)), first).parts()
        before = []
        for k, r in enumerate(rows):
            before = live.dedup(cfg, r, [] if first[k] else before, 1280, 720)
            assert got[k].tolist() == [[float(b[n]) for n in folds.NAMES] for b in before]


def test_the_state_has_no_more_tasks_than_cameras_need(spark, tmp_path):
    spark.createDataFrame([ready(), *[line for frame in protocol(10, 4) for line in frame]], LINE).coalesce(1).write.parquet(str(tmp_path / "in"))
    with frames.typed_state(spark, 1):
        frames.run_through(frames.live_frames(CFG, spark.readStream.schema(LINE).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert sorted(p.name for p in (tmp_path / "log" / "state" / "0").glob("[0-9]*")) == ["0", "1"]


def test_frames_of_one_camera_reach_the_viewer_in_several_tasks(spark, tmp_path):
    events(spark, 40).where("status <> 'late'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.EVENT).parquet(str(tmp_path / "in"))
    viewer.to_viewer(stream, str(tmp_path / "viewer"), str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert viewer.viewed(spark, str(tmp_path / "viewer")).count() == 32 * 3 and len(list((tmp_path / "viewer" / "files").glob("*.txt"))) > 1


BOXES = "frame_id int, tile_id int, neg_conf double, x1 double, y1 double, x2 double, y2 double, conf double, rank int, cls int"


def test_boxes_of_a_recording_move_once(spark, tmp_path):
    rows = [(f, t, -0.5, float(k), 1.0, float(k + 5), 9.0, 0.5, k % 2, 0) for f in range(40) for k, t in enumerate((5, None, 1, 1, -1, 2))]
    made = recordings.with_tile_images(spark.createDataFrame(rows, BOXES), 2, 64, 48, 3, "rank = 0")
    assert made.sortWithinPartitions("camera", "seq")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    recordings.write_recording(made, str(tmp_path / "rec"), placed=True)
    again = recordings.Recording(str(tmp_path / "rec"))
    assert again.counts() == {"cam0": 20, "cam1": 20}
    # a partition has one camera's frames, but for those at a camera's ends
    assert len(list((tmp_path / "rec").glob("*/*.parquet"))) <= 4 + 1
    got = [f for batch in again.frames(again.parts("cam1", 3, 9), 3, 9) for f in batch.to_pylist()]
    assert sorted(f["seq"] for f in got) == [*range(3, 9)] and all(f["frame_id"] == 2 * f["seq"] + 1 for f in got)
    # boxes without a tile are in the whole frame's image only
    images = [[(b["tile_id"], b["x1"]) for b in json.loads(i)] for i in got[0]["tile_images"]]
    assert images == [[(-1, 4.0), (5, 0.0)], [(1, 2.0), (1, 3.0)], [(2, 5.0)]] and [(b["tile_id"], b["x1"]) for b in json.loads(got[0]["image"])] == [(-1, 0.0), (-1, 2.0), (-1, 4.0)]


def test_files_of_a_closed_recording_are_listed_once(recording, monkeypatch):
    one, asked = recordings.Recording(recording), []
    one.counts()
    monkeypatch.setattr(recordings.pafs, "FileSelector", lambda *a, **k: asked.append(a))
    assert one.counts() == {"a": 7, "b": 3} and one.parts("a", 0, 7) and not asked


def test_frames_of_several_sizes_and_with_few_tile_images(recording):
    reader = camera_source.CameraReader({"path": recording, "tile_grid": "2x1", "overlap": "1", "start_frame": "1"})
    frame = pa.schema([("seq", pa.int64()), ("frame_id", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("image", pa.binary()), ("tile_images", pa.list_(pa.binary()))])
    batch = pa.RecordBatch.from_pylist([dict(seq=1, frame_id=10, width=6, height=2, image=bytes(range(12)), tile_images=[b"x"]), dict(seq=2, frame_id=None, width=4, height=1, image=b"opaque", tile_images=None),
                                        dict(seq=3, frame_id=12, width=4, height=1, image=None, tile_images=[b"l", None, b"more"])], schema=frame)
    rows = reader._lines("a", batch, 2.5).to_pylist()
    assert [(r["kind"], r["seq"], r["frame_id"], r["task_id"], r["tile_id"], r["x1"], r["x2"], r["tiles"], r["image"]) for r in rows] == [
        ("FRAME", 1, 10, None, None, None, None, None, bytes(range(12))), ("TILE", 1, 10, 0, 0, 0, 4, None, b"x"), ("TILE", 1, 10, 1, 1, 2, 6, None, bytes([2, 3, 4, 5, 8, 9, 10, 11])), ("END_FRAME", 1, 10, None, None, None, None, 2, None),
        ("FRAME", 2, None, None, None, None, None, None, b"opaque"), ("TILE", 2, None, 2, 0, 0, 3, None, None), ("TILE", 2, None, 3, 1, 1, 4, None, None), ("END_FRAME", 2, None, None, None, None, None, 2, None),
        ("FRAME", 3, 12, None, None, None, None, None, None), ("TILE", 3, 12, 4, 0, 0, 3, None, b"l"), ("TILE", 3, 12, 5, 1, 1, 4, None, None), ("END_FRAME", 3, 12, None, None, None, None, 2, None)]
    assert all(r["capture_ms"] == 2.5 and r["captured_ms"] > 0 for r in rows)
