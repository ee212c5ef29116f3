"""Queries of the detection dataflow, and their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.functions import geometry as g
from tilewright.functions.text import PLACEHOLDERS, fill_template
from tilewright.operators import crowds, detect, duplicates
from tilewright.shared import numbered, staged, staged_path
from tilewright.sinks import viewer
from tilewright.sources import adapters, camera, camera_source, files, recordings, tasks
from tilewright.streaming import frames, live

CFG = DetectionConfig(tile_grid="4x3")
NEAR = DetectionConfig(tile_grid="4x3", duplicate_near_camera=True, duplicate_large_area_ratio=0.02)
MOCK = DetectionConfig(tile_grid="4x3", sleep_ms=3)
LIVE = DetectionConfig(tile_grid="4x3", live=True, live_anchor_full_frame=True, live_temporal_dedup=True)
#: Cameras that the frames of ``events`` are dealt to.
CAMERAS = 4
DET = adapters.ansi(adapters.DET)


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.relation(spark, sf_dir, adapters.DET)


def frames_of(boxes: DataFrame) -> DataFrame:
    return boxes.select("frame_id").distinct()


# SQL texts of the same formulas, written out for any two aliases

def _w(a: str) -> str:
    return f"greatest(0.0, {a}.x2 - {a}.x1)"


def _h(a: str) -> str:
    return f"greatest(0.0, {a}.y2 - {a}.y1)"


def _one(a: str, b: str, k: str) -> str:
    return f"greatest(0.0, least({a}.{k}2, {b}.{k}2) - greatest({a}.{k}1, {b}.{k}1))"


def _inter(a: str, b: str) -> str:
    return f"({_one(a, b, 'x')} * {_one(a, b, 'y')})"


def _div(x: str, y: str) -> str:
    return f"(case when {y} > 0 then {x} / {y} else 0.0 end)"


def _iou(a: str, b: str) -> str:
    return _div(_inter(a, b), f"({_w(a)} * {_h(a)} + {_w(b)} * {_h(b)} - {_inter(a, b)})")


def _ios(a: str, b: str) -> str:
    return _div(_inter(a, b), f"least({_w(a)} * {_h(a)}, {_w(b)} * {_h(b)})")


def _axis(a: str, b: str, k: str) -> str:
    return _div(_one(a, b, k), f"least(greatest(0.0, {a}.{k}2 - {a}.{k}1), greatest(0.0, {b}.{k}2 - {b}.{k}1))")


def _gap(a: str, b: str, k: str) -> str:
    side = _w if k == "x" else _h
    return _div(f"greatest(0.0, greatest({a}.{k}1, {b}.{k}1) - least({a}.{k}2, {b}.{k}2))", f"least({side(a)}, {side(b)})")


def _far(a: str, b: str, k: str) -> str:
    side = _w if k == "x" else _h
    return _div(f"abs(({a}.{k}1 + {a}.{k}2) * 0.5 - ({b}.{k}1 + {b}.{k}2) * 0.5)", f"greatest({side(a)}, {side(b)})")


def _dup(a: str, b: str) -> str:
    return f"({a}.cls = {b}.cls and ({_iou(a, b)} >= {CFG.iou} or {_ios(a, b)} >= {CFG.duplicate_ios}))"


def _near(a: str, b: str) -> str:
    c, gap, o, large = NEAR.duplicate_center, NEAR.duplicate_gap, NEAR.duplicate_axis_overlap, NEAR.duplicate_large_area_ratio
    size = f"(greatest({_w(a)} * {_h(a)}, {_w(b)} * {_h(b)}) / (1280.0 * 720.0) >= {large} or greatest({_w(a)}, {_w(b)}) / 1280.0 >= 0.35 or greatest({_h(a)}, {_h(b)}) / 720.0 >= 0.45)"
    beside = f"({_axis(a, b, 'y')} >= {o} and {_gap(a, b, 'x')} <= {gap} and {_far(a, b, 'y')} <= {c})"
    above = f"({_axis(a, b, 'x')} >= {o} and {_gap(a, b, 'y')} <= {gap} and {_far(a, b, 'x')} <= {c})"
    close = f"({_far(a, b, 'x')} <= {c} and {_far(a, b, 'y')} <= {c} and ({_axis(a, b, 'x')} > 0.05 or {_axis(a, b, 'y')} > 0.05 or {_gap(a, b, 'x')} <= {gap} or {_gap(a, b, 'y')} <= {gap}))"
    return f"({a}.tile_id <> {b}.tile_id and least({_w(a)}, {_w(b)}) > 0 and least({_h(a)}, {_h(b)}) > 0 and {size} and ({beside} or {above} or {close}))"


def _temporal(a: str, b: str) -> str:
    c = LIVE.live_temporal_center
    near = f"(greatest({_w(a)}, {_w(b)}) > 0 and greatest({_h(a)}, {_h(b)}) > 0 and {_far(a, b, 'x')} <= {c} and {_far(a, b, 'y')} <= {c} and ({_axis(a, b, 'x')} > 0.1 or {_axis(a, b, 'y')} > 0.1))"
    return f"({a}.cls = {b}.cls and ({_iou(a, b)} >= 0.15 or {_ios(a, b)} >= {LIVE.live_temporal_ios} or {near}))"


def _owned(a: str) -> str:
    def side(lo: str, k: str, total: int, parts: int) -> str:
        center = f"(({a}.{lo}1 + {a}.{lo}2) * 0.5)"
        low, high = f"round({k} * {total} / {parts}.0)", f"round(({k} + 1) * {total} / {parts}.0)"
        return f"({center} + 1e-6 >= {low} and case when {k} = {parts - 1} then {center} <= {high} + 1e-6 else {center} < {high} - 1e-6 end)"
    return f"({a}.tile_id < 0 or {a}.tile_id >= 12 or ({side('x', f'({a}.tile_id % 4)', 1280, 4)} and {side('y', f'({a}.tile_id // 4)', 720, 3)}))"


_BOX = "struct_pack(neg_conf := -conf, tile_id := tile_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf, rank := rank, cls := cls)"
_GROWN = ("struct_pack(neg_conf := least(k.neg_conf, n[1].neg_conf), tile_id := case when k.conf >= n[1].conf then k.tile_id else n[1].tile_id end, x1 := least(k.x1, n[1].x1), y1 := least(k.y1, n[1].y1), "
          "x2 := greatest(k.x2, n[1].x2), y2 := greatest(k.y2, n[1].y2), conf := greatest(k.conf, n[1].conf), rank := case when k.conf >= n[1].conf then k.rank else n[1].rank end, cls := case when k.conf >= n[1].conf then k.cls else n[1].cls end)")


def _folded(singles: str) -> str:
    """Suppression as a list fold: every list element is a list of one box, so that the folded value is a list of boxes."""
    return f"""list_reduce({singles}, lambda kept, n: list_transform([list_position(list_transform(kept, lambda k: {_dup('n[1]', 'k')}), true)], lambda spot:
    case when coalesce(spot, 0) = 0 then list_append(kept, n[1]) else list_transform(kept, lambda k, i: case when i = spot then {_GROWN} else k end) end)[1])"""


def kept_lists_sql(boxes: str) -> str:
    """(frame_id, kept) of suppression, as a list."""
    return f"select frame_id, {_folded('bs')} as kept from (select frame_id, list([{_BOX}] order by conf desc, tile_id, x1, y1, x2, y2) as bs from ({boxes}) group by frame_id)"


def kept_sql(boxes: str) -> str:
    return f"select frame_id, unnest(kept) as b from ({kept_lists_sql(boxes)})"


OWNED = f"select d.* from ({DET}) d where {_owned('d')}"
FLAT = "b.tile_id as tile_id, b.rank as rank, b.x1 as x1, b.y1 as y1, b.x2 as x2, b.y2 as y2, b.conf as conf, b.cls as cls"
TASKS_SQL = """
select cast(id as bigint) as task_id, cast(id // 12 as int) as frame_id, cast(t as int) as tile_id,
 cast(greatest(0, round((t % 4) * 1280 / 4.0) - 64) as int) as x1, cast(greatest(0, round((t // 4) * 720 / 3.0) - 64) as int) as y1,
 cast(least(1280, round((t % 4 + 1) * 1280 / 4.0) + 64) as int) as x2, cast(least(720, round((t // 4 + 1) * 720 / 3.0) + 64) as int) as y2
from (select range as id, range % 12 as t from range({n}))
"""
#: The tiles of all frames of ``events``.
TASKS = TASKS_SQL.replace("select range as id, range % 12 as t from range({n})", f"select frame_id * 12 + t as id, t from (select distinct frame_id from ({DET})), (select range as t from range(12))")


def work(spark, sf_dir, cfg: DetectionConfig = MOCK) -> DataFrame:
    """The tiles of all frames of ``events``."""
    return tasks.frame_tasks(cfg, frames_of(det(spark, sf_dir)))


def s1_tasks(spark, sf_dir):
    """Work items of all frames in 4x3 tiles."""
    return work(spark, sf_dir)


def f8_static_assignment(spark, sf_dir):
    """Tasks and frames of each of 7 ranks, dealt in chunks of 5."""
    return tasks.assigned(work(spark, sf_dir), 7, 5).groupBy("rank").agg(F.count("*").alias("tasks_done"), F.count_if(F.col("tile_id") == 0).alias("frames_done"))


F8_SQL = f"select cast(task_id // 5 % 7 as int) as rank, count(*) as tasks_done, count(*) filter (tile_id = 0) as frames_done from ({TASKS}) group by 1"


def x1_mock_boxes(spark, sf_dir):
    """Boxes of the mock detector, at four decimals."""
    return duplicates.quantized(detect.detect(MOCK, work(spark, sf_dir)))


MOCK_SQL = f"""
select task_id, frame_id, tile_id, round(greatest(0, cx - bw / 2), 4) as x1, round(greatest(0, cy - bh / 2), 4) as y1, round(cx + bw / 2, 4) as x2, round(cy + bh / 2, 4) as y2, round(0.92 - cast(0.03 as double) * i, 4) as conf, 0 as cls
from (select *, x1 + (cast(0.22 as double) + cast(0.22 as double) * i + cast(0.03 as double) * (frame_id % 5)) * (x2 - x1) as cx, y1 + (cast(0.28 as double) + cast(0.17 as double) * i + cast(0.02 as double) * (tile_id % 4)) * (y2 - y1) as cy,
   greatest(24, cast(0.12 as double) * (x2 - x1)) as bw, greatest(48, cast(0.24 as double) * (y2 - y1)) as bh
  from (select *, unnest(range(1 + (frame_id + tile_id) % 3)) as i from ({TASKS})))
"""


COMMAND = DetectionConfig(tile_grid="4x3", detector="command", detector_command="echo '# {tile_id}'; echo 1,2,{tile_id}.5,4,0.5; echo 3,4,5,6,0.25; echo broken; test {tile_id} -lt 11")
WORKER = DetectionConfig(tile_grid="4x3", detector="worker", conf=0.4)


def x2_command_boxes(spark, sf_dir):
    """Boxes that an outside program prints for each tile of every frame; it fails on a frame's last tile."""
    return duplicates.quantized(detect.detect(COMMAND, work(spark, sf_dir, COMMAND)))


X2_SQL = f"""select task_id, frame_id, tile_id, x1 + a as x1, y1 + b as y1, x1 + c as x2, y1 + d as y2, s as conf, 0 as cls from ({TASKS}),
 (select unnest([true, false]) as one), lateral (select case when one then 1e0 else 3e0 end as a, case when one then 2e0 else 4e0 end as b, case when one then tile_id + 5e-1 else 5e0 end as c, case when one then 4e0 else 6e0 end as d, case when one then 5e-1 else 25e-2 end as s) where tile_id < 11"""


def _loaded():
    """A stand-in for a network, built once for each task of Spark: two boxes a tile."""
    def model(batch):
        parts = [batch[["task_id", "frame_id", "tile_id"]].assign(x1=10.0 * k, y1=5.0, x2=10.0 * k + batch["tile_id"], y2=50.0, conf=(batch["frame_id"] % 10) / 10, cls=k) for k in (0, 1)]
        return pd.concat(parts, ignore_index=True)

    return model


def x3_worker_boxes(spark, sf_dir):
    """Boxes of a loaded model for each tile, persons of enough confidence only."""
    return duplicates.quantized(detect.detect(WORKER, work(spark, sf_dir, WORKER), _loaded))


X3_SQL = f"select task_id, frame_id, tile_id, cast(x1 as double) as x1, y1 + 5e0 as y1, cast(x1 + tile_id as double) as x2, y1 + 50e0 as y2, round(frame_id % 10 / 10, 4) as conf, 0 as cls from ({TASKS}) where frame_id % 10 >= 4"


def x5_costs(spark, sf_dir):
    """Said cost of the tasks of each rank."""
    return detect.with_cost(MOCK, tasks.assigned(work(spark, sf_dir), 4)).groupBy("rank").agg(F.sum("cost_ms").alias("cost_ms"))


X5_SQL = f"select cast(task_id % 4 as int) as rank, cast(sum(3 + (frame_id + tile_id) % 5) as bigint) as cost_ms from ({TASKS}) group by 1"


def p2_remapped_boxes(spark, sf_dir):
    """Boxes taken as tile-local, moved by their tile's origin."""
    boxes = det(spark, sf_dir)
    frames = DetectionConfig(tile_grid="4x3", frames=1)
    tiles = tasks.tasks(spark, frames).select("tile_id", "x1", "y1")
    return duplicates.remapped(boxes, tiles).select("det_id", "frame_id", "x1", "y1", "x2", "y2")


P2_SQL = f"select det_id, frame_id, d.x1 + t.x1 as x1, d.y1 + t.y1 as y1, d.x2 + t.x1 as x2, d.y2 + t.y1 as y2 from ({DET}) d join (select tile_id, x1, y1 from ({TASKS_SQL.format(n=12)})) t using (tile_id)"


def _neighbours(spark, sf_dir, step: int) -> DataFrame:
    """Every box with the box ``step`` ids on, as structs."""
    rows = det(spark, sf_dir).select("det_id", "frame_id", g.box().alias("a"))
    return rows.join(rows.select((F.col("det_id") - step).alias("det_id"), F.col("a").alias("b")), "det_id")


def p5_box_geometry(spark, sf_dir):
    """Areas, overlaps and gaps of each box and the next but eleven."""
    a, b = F.col("a"), F.col("b")
    six = lambda c: F.round(c, 6)
    return _neighbours(spark, sf_dir, 12).select(
        "det_id", six(g.area(a)).alias("area"), six(g.intersection(a, b)).alias("intersection"), six(g.iou(a, b)).alias("iou"), six(g.ios(a, b)).alias("ios"),
        six(g.axis_overlap(a["x1"], a["x2"], b["x1"], b["x2"])).alias("axis_overlap_x"), six(g.axis_gap(a["y1"], a["y2"], b["y1"], b["y2"], F.least(g.height(a), g.height(b)))).alias("axis_gap_y"))


def _pairs_sql(step: int, columns: str) -> str:
    return f"select a.det_id, {columns} from ({DET}) a join ({DET}) b on b.det_id = a.det_id + {step}"


P5_SQL = _pairs_sql(12, f"round({_w('a')} * {_h('a')}, 6) as area, round({_inter('a', 'b')}, 6) as intersection, round({_iou('a', 'b')}, 6) as iou, round({_ios('a', 'b')}, 6) as ios, round({_axis('a', 'b', 'x')}, 6) as axis_overlap_x, round({_gap('a', 'b', 'y')}, 6) as axis_gap_y")


def f3_pair_rules(spark, sf_dir):
    """What the duplicate rules say of each box and the next but eleven, and the box around both."""
    a, b = F.col("a"), F.col("b")
    m = g.merged(a, b)
    return _neighbours(spark, sf_dir, 12).select(
        "det_id", g.near_camera_duplicate(NEAR, a, b, F.lit(1280), F.lit(720)).alias("near_camera"), g.duplicate(CFG, a, b).alias("duplicate"), g.temporal_match(LIVE, a, b).alias("temporal"),
        *[m[c].alias(f"m_{c}") for c in ("x1", "y1", "x2", "y2", "conf", "tile_id")])


F3_SQL = _pairs_sql(12, f"{_near('a', 'b')} as near_camera, {_dup('a', 'b')} as duplicate, {_temporal('a', 'b')} as temporal, least(a.x1, b.x1) as m_x1, least(a.y1, b.y1) as m_y1, greatest(a.x2, b.x2) as m_x2, greatest(a.y2, b.y2) as m_y2, greatest(a.conf, b.conf) as m_conf, case when a.conf >= b.conf then a.tile_id else b.tile_id end as m_tile_id")


def f2_owner_filter(spark, sf_dir):
    """boxes whose centre lies in the core of their tile."""
    return duplicates.owner_filter(CFG, det(spark, sf_dir)).select("det_id", "frame_id", "tile_id")


def j5_duplicate_pairs(spark, sf_dir):
    """All pairs of duplicates inside a frame."""
    return duplicates.duplicate_pairs(CFG, det(spark, sf_dir))


J5_SQL = f"select a.frame_id, a.det_id as a, b.det_id as b from ({DET}) a join ({DET}) b on a.frame_id = b.frame_id and a.det_id < b.det_id where {_dup('a', 'b')}"


def a9_suppressed_boxes(spark, sf_dir):
    """Boxes after quantising, ownership and greedy suppression with merging."""
    return duplicates.suppress(CFG, duplicates.quantized(det(spark, sf_dir)), own=True)


#: Forty frames as one picture of 8 x 5 of them.
MOSAIC = "select cast(frame_id // 40 as int) as frame_id, tile_id, rank, x1 + frame_id % 8 * 1280 as x1, y1 + frame_id % 40 // 8 * 720 as y1, x2 + frame_id % 8 * 1280 as x2, y2 + frame_id % 40 // 8 * 720 as y2, conf, cls from ({det})"


def a9_crowded_frames(spark, sf_dir):
    """A9 on frames of a thousand boxes: mosaics of forty frames each, folded by components."""
    at = F.col("frame_id")
    dx, dy = at % 8 * 1280, F.floor(at % 40 / 8) * 720
    boxes = det(spark, sf_dir).select(F.floor(at / 40).cast("int").alias("frame_id"), "tile_id", "rank", *[(F.col(c) + d).alias(c) for c, d in (("x1", dx), ("y1", dy), ("x2", dx), ("y2", dy))], "conf", "cls")
    return crowds.suppress_crowds(CFG, boxes)


def a1_people_count(spark, sf_dir):
    """People per frame; the flagship query."""
    boxes = det(spark, sf_dir)
    return duplicates.counts_on_spine(frames_of(boxes), duplicates.suppress(CFG, duplicates.quantized(boxes), own=True))


A1_SQL = f"select f.frame_id, coalesce(n, 0) as person_count from (select distinct frame_id from ({DET})) f left join (select frame_id, count(*) as n from ({kept_sql(OWNED)}) group by frame_id) k on f.frame_id = k.frame_id"


def w7_order_in_frame(spark, sf_dir):
    """Place of each box in its frame's order of suppression."""
    return duplicates.ranked(det(spark, sf_dir)).select("det_id", "frame_id", F.col("place").cast("long").alias("place"))


def k2_bbox_table(spark, sf_dir):
    """K2: kept boxes as texts with four decimals."""
    from tilewright.sinks.tables import fixed_decimals

    return fixed_decimals(a9_suppressed_boxes(spark, sf_dir))


K2_SQL = f"select frame_id, b.tile_id as tile_id, b.rank as rank, {', '.join(f'printf(chr(37) || chr(46) || chr(52) || chr(102), b.{c}) as {c}' for c in ('x1', 'y1', 'x2', 'y2', 'conf'))}, b.cls as cls from ({kept_sql(OWNED)})"


def j6_uncovered_boxes(spark, sf_dir):
    """Boxes of ranks 1 and 2 that no box of rank 0 in their frame covers."""
    boxes = det(spark, sf_dir)
    return duplicates.uncovered(CFG, boxes.where("rank <> 0"), boxes.where("rank = 0")).select("det_id", "frame_id")


J6_SQL = f"select t.det_id, t.frame_id from ({DET}) t where t.rank <> 0 and not exists (select 1 from ({DET}) a where a.frame_id = t.frame_id and a.rank = 0 and {_dup('t', 'a')})"


def s8_payload_lines(spark, sf_dir):
    """Detections written as tagged lines and read again."""
    lines = det(spark, sf_dir).select(F.format_string("DET,%d,%d,%d,%.4f,%.4f,%.4f,%.4f,%.4f,%d", "frame_id", "tile_id", "rank", "x1", "y1", "x2", "y2", "conf", "cls").alias("value"))
    return files.payload(lines.unionByName(lines.sparkSession.createDataFrame([("MET,0,host,1,1,2,0,1,1,0",), ("noise",)], "value string")))[0]


S8_SQL = f"select frame_id, tile_id, rank, round(x1, 4) as x1, round(y1, 4) as y1, round(x2, 4) as x2, round(y2, 4) as y2, round(conf, 4) as conf, cls from ({DET})"


def s2_tile_grids(spark, sf_dir):
    """Columns and rows of grid texts, one per supplier."""
    rows = adapters.relation(spark, sf_dir, "select s_suppkey, concat(cast(1+s_suppkey%7 as varchar(3)), case when s_suppkey%2=0 then 'x' else 'X' end, cast(1+s_suppkey%5 as varchar(3))) as grid from {supplier}")
    cols, lines = tasks.parse_grid(F.col("grid"))
    return rows.select("s_suppkey", cols.alias("cols"), lines.alias("rows"))


def s5_camera_lines(spark, sf_dir):
    """Tiles of all frames as a camera's lines with base64 images, read again."""
    tiles = work(spark, sf_dir)
    image = F.base64(F.concat(F.lit("tile "), F.col("task_id").cast("string")).cast("binary"))
    tile = tiles.select(F.concat(F.format_string("TILE %d %d %d %d %d %d %d ", "task_id", "frame_id", "tile_id", "x1", "y1", "x2", "y2"), image).alias("value"))
    frame = tiles.where("tile_id = 0").select(F.format_string("FRAME %d 1280 720 1.5 eA==", "frame_id").alias("value"))
    found = files.camera_lines(tile.unionByName(frame))[1]
    return found.withColumn("image", F.decode("image", "UTF-8"))


def s4_camera_tiles(spark, sf_dir):
    """Tiles of frames as the camera cuts them, halves to even, on a 1001 x 502 frame."""
    cfg = DetectionConfig(tile_grid="4x4", width=1001, height=502, overlap=32)
    return camera.frame_tiles(cfg, frames_of(det(spark, sf_dir)))


S4_SQL = f"""select frame_id, cast(t as int) as tile_id, cast(frame_id as bigint) * 16 + t as task_id, cast(greatest(0, round_even((t % 4) * 1001 / 4.0, 0) - 32) as int) as x1, cast(greatest(0, round_even((t // 4) * 502 / 4.0, 0) - 32) as int) as y1,
 cast(least(1001, round_even((t % 4 + 1) * 1001 / 4.0, 0) + 32) as int) as x2, cast(least(502, round_even((t // 4 + 1) * 502 / 4.0, 0) + 32) as int) as y2
from (select distinct frame_id from ({DET})) cross join (select unnest(range(16)) as t)"""


def k9_viewer_lines(spark, sf_dir):
    """K9: lines of a viewer for every live event."""
    return camera.viewer_lines(live.dedup_frames(LIVE, _frames(spark, sf_dir)))


def p11_commands(spark, sf_dir):
    """A command line per box from a template."""
    template = "detect {source} --tile {tile_id} --frame {frame_id} --box {x1},{y1},{x2},{y2} --conf {conf} {unknown}"
    values = {n: F.col(n).cast("int") if n in ("x1", "y1", "x2", "y2") else F.col(n) for n in PLACEHOLDERS if n in ("frame_id", "tile_id", "x1", "y1", "x2", "y2")}
    return det(spark, sf_dir).select("det_id", fill_template(F.lit(template), {**values, "source": F.lit("cam"), "conf": F.lit("0.35")}).alias("command"))


P11_SQL = f"select det_id, concat('detect cam --tile ', tile_id, ' --frame ', frame_id, ' --box ', cast(trunc(x1) as int), ',', cast(trunc(y1) as int), ',', cast(trunc(x2) as int), ',', cast(trunc(y2) as int), ' --conf 0.35 {{unknown}}') as command from ({DET})".replace("{{", "{").replace("}}", "}")


def _frames(spark, sf_dir) -> DataFrame:
    return live.nested_frames(det(spark, sf_dir), CAMERAS, LIVE.width, LIVE.height)


def l4_anchor_policies(spark, sf_dir):
    """People and tasks per frame under each anchor policy."""
    out = None
    for policy in ("merge", "anchor-gate", "anchor-only"):
        cfg = DetectionConfig(tile_grid="4x3", live=True, live_anchor_full_frame=True, live_anchor_policy=policy)
        one = live.merged_frames(cfg, _frames(spark, sf_dir)).select(F.lit(policy).alias("policy"), "frame_id", F.size("boxes").alias("person_count"), "tasks")
        out = one if out is None else out.unionByName(one)
    return out


def a10_temporal_dedup(spark, sf_dir):
    """Boxes per camera and frame after matching with the frame before."""
    return live.dedup_frames(LIVE, _frames(spark, sf_dir)).select("camera", "frame_id", "person_count", "tasks")


def l10_final_counts(spark, sf_dir):
    """Counts after the closing pass over all events' boxes."""
    boxes = det(spark, sf_dir)
    return live.final_counts(LIVE, frames_of(boxes), live.dedup_frames(LIVE, _frames(spark, sf_dir)))


#: Frames that a trigger of the stream over a folder takes, about: the state's tasks hold the rows of that many.
TRIGGER = 32_000


def l3_live_stream(spark, sf_dir):
    """The live pass as a stream over a folder of frames, several files a trigger, in the shared folder."""
    shared = staged_path(spark, "live")
    nested = _frames(spark, sf_dir)
    placed = staged(numbered(nested, ["frame_id"]), "placed")
    for low in range(0, placed.agg(F.coalesce(F.max("place") + 1, F.lit(1))).first()[0], TRIGGER):
        # a folder's files are read by the time they were written
        placed.where((F.col("place") >= low) & (F.col("place") < low + TRIGGER)).select(*nested.columns).repartition(4, "frame_id").sortWithinPartitions("frame_id").write.mode("append").parquet(f"{shared}/frames")
    stream = spark.readStream.schema(nested.schema).option("maxFilesPerTrigger", 4).parquet(f"{shared}/frames")
    with frames.typed_state(spark, CAMERAS):
        frames.run_through(frames.live_frames(LIVE, frames.protocol_rows(stream, CAMERAS)).writeStream.format("parquet").option("path", f"{shared}/events").option("checkpointLocation", f"{shared}/state"))
    return spark.read.schema(frames.EVENT).parquet(f"{shared}/events").select("camera", "frame_id", "person_count", "tasks")


def _camera(spark, sf_dir) -> tuple[DataFrame, str]:
    """The frames of ``events`` as a recording of four cameras, replayed as a stream of protocol rows; and the run's folder."""
    shared = staged_path(spark, "camera")
    recordings.write_recording(recordings.with_tile_images(det(spark, sf_dir), CAMERAS, LIVE.width, LIVE.height, 12, "rank = 0"), f"{shared}/recording", placed=True)
    return camera_source.camera_stream(spark, f"{shared}/recording", LIVE, frames_per_trigger=2000, progress=f"{shared}/progress"), shared


def s4_camera_stream(spark, sf_dir):
    """All rows that the camera source sends for the frames of ``events``, with the boxes that their images show."""
    lines, shared = _camera(spark, sf_dir)
    rows = lines.withColumn("boxes", frames.decoded_boxes()).withColumn("n_boxes", F.when(F.col("kind").isin("FRAME", "TILE"), F.size("boxes"))).drop("image", "boxes", "captured_ms", "capture_ms")
    frames.run_through(rows.writeStream.format("parquet").option("path", f"{shared}/lines").option("checkpointLocation", f"{shared}/log"))
    return spark.read.schema(rows.schema).parquet(f"{shared}/lines")


S4_STREAM_SQL = f"""
with d as ({DET}), f as (select distinct frame_id, 'cam' || (frame_id % 4) as camera, cast(frame_id // 4 as bigint) as seq from d), n as (select camera, max(seq) + 1 as n from f group by 1),
 t as (select cast(range as int) as tile_id from range(12)), b as (select x.tile_id, x1, y1, x2, y2 from ({TASKS_SQL.format(n=12)}) x)
select camera, 'READY' as kind, 0 as seq, null as frame_id, null as width, null as height, null as task_id, null as tile_id, null as x1, null as y1, null as x2, null as y2, 12 as tiles, null as n_boxes from n
union all select camera, 'FRAME', seq, frame_id, 1280, 720, null, null, null, null, null, null, null, (select count(*) from d where d.frame_id = f.frame_id and rank = 0) from f
union all select camera, 'TILE', seq, frame_id, 1280, 720, seq * 12 + tile_id, tile_id, x1, y1, x2, y2, null, (select count(*) from d where d.frame_id = f.frame_id and d.tile_id = b.tile_id) from f, b
union all select camera, 'END_FRAME', seq, frame_id, 1280, 720, null, null, null, null, null, null, 12, null from f
union all select camera, 'END_STREAM', n, null, null, null, null, null, null, null, null, null, n, null from n
"""


def l6_live_camera(spark, sf_dir):
    """Events of the live run over the camera source, with the signs of their times: capture, and capture to result."""
    lines, shared = _camera(spark, sf_dir)
    with frames.typed_state(spark, CAMERAS):
        frames.run_through(frames.live_frames(LIVE, frames.decoded(lines)).writeStream.format("parquet").option("path", f"{shared}/events").option("checkpointLocation", f"{shared}/log"))
    rows = spark.read.schema(frames.EVENT).parquet(f"{shared}/events")
    return rows.select("camera", "seq", "frame_id", "person_count", "tasks", "status", (F.col("capture_ms") >= 0).alias("captured"), (F.col("latency_ms") > 0).alias("timed"))


def k9_viewer_frames(spark, sf_dir):
    """K9: what a viewer gets of the live run over the camera source: the lines of every frame, once."""
    lines, shared = _camera(spark, sf_dir)
    with frames.typed_state(spark, CAMERAS):
        frames.run_through(viewer.to_viewer(frames.live_frames(LIVE, frames.decoded(lines)), f"{shared}/viewer", f"{shared}/log"))
    return viewer.viewed(spark, f"{shared}/viewer")


#: Tiles and anchors of a frame are merged apart first, then together.
ANCHORS = f"select frame_id, {FLAT} from ({kept_sql(f'select frame_id, cast(-1 as int) as tile_id, rank, x1, y1, x2, y2, conf, cls from ({DET}) where rank = 0')})"
TILES = f"select frame_id, {FLAT} from ({kept_sql(OWNED)})"
MERGED = f"select d.* from (select * from anchors union all select * from tiles t where not exists (select 1 from anchors a where a.frame_id = t.frame_id and {_dup('t', 'a')})) d where {_owned('d')}"
_PARTS = f"frames as (select distinct frame_id from ({DET})), anchors as materialized ({ANCHORS}), tiles as materialized ({TILES})"
_COUNT = "select frame_id, len(kept) as n from"
L4_SQL = f"""
with {_PARTS}, gate as ({_COUNT} ({kept_lists_sql('select * from anchors')}))
select policy, frame_id, cast(coalesce(n, 0) as int) as person_count, tasks from (
 select 'merge' as policy, frame_id, n, 12 as tasks from frames left join ({_COUNT} ({kept_lists_sql(MERGED)})) using (frame_id)
 union all select 'anchor-gate', frame_id, coalesce(a.n, t.n), case when a.n is null then 12 else 1 end from frames left join gate a using (frame_id)
  left join ({_COUNT} ({kept_lists_sql(f"select d.* from tiles d where {_owned('d')}")})) t using (frame_id)
 union all select 'anchor-only', frame_id, n, 1 from frames left join gate using (frame_id))"""
#: The temporal pass frame by frame: a recursion over each camera's frames, whose step folds over the boxes before.
_STEP = f"""list_transform([list_filter(s.free, lambda x: {_temporal('x', "e['old']")})], lambda f: case when len(f) < 2 then s else
   struct_pack(free := list_filter(s.free, lambda x: not {_temporal('x', "e['old']")}), outs := list_append(s.outs, list_reduce(f, lambda k, n: {_GROWN.replace('n[1]', 'n')})), old := s.old) end)[1]"""
LIVE_SQL = f"""
with recursive {_PARTS}, m as (select f.frame_id, coalesce(kept, []) as now from frames f left join ({kept_lists_sql(MERGED)}) k on f.frame_id = k.frame_id),
q as (select *, 'cam' || (frame_id % 4) as camera, row_number() over (partition by frame_id % 4 order by frame_id) as seq from m),
r as (select camera, seq, frame_id, now as kept from q where seq = 1
 union all select camera, seq, frame_id, case when len(now) < 2 or len(before) = 0 then now else {_folded('list_transform(list_sort(list_concat(fold.outs, fold.free)), lambda x: [x])')} end
 from (select q.*, r.kept as before, list_reduce(list_concat([struct_pack(free := q.now, outs := q.now[1:0], old := q.now[1])], list_transform(r.kept, lambda b: struct_pack(free := q.now[1:0], outs := q.now[1:0], old := b))), lambda s, e: {_STEP}) as fold
  from r join q on q.camera = r.camera and q.seq = r.seq + 1))
"""
A10_SQL = f"{LIVE_SQL} select camera, frame_id, cast(len(kept) as int) as person_count, 12 as tasks from r"
K9_SQL = f"""{LIVE_SQL} select camera, frame_id, cast(place - 1 as int) as place, line from (select camera, frame_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as place from (
 select camera, frame_id, list_concat(list_concat(['FRAME ' || frame_id || ' ' || len(kept)], list_transform(kept, lambda b: 'BOX ' || {" || ' ' || ".join(f"printf(chr(37) || chr(46) || chr(52) || chr(102), b.{c})" for c in ("x1", "y1", "x2", "y2", "conf"))})), ['END_FRAME ' || frame_id]) as lines from r))"""
L6_SQL = f"{LIVE_SQL} select camera, cast(frame_id // 4 as bigint) as seq, frame_id, cast(len(kept) as int) as person_count, 12 as tasks, 'whole' as status, true as captured, true as timed from r"
K9_FRAMES_SQL = f"select camera, frame_id, place, case when place = 0 then replace(line, 'FRAME ' || frame_id, 'FRAME ' || frame_id || ' 1280 720') else line end as line from ({K9_SQL})"
_EVENTS = f"select frame_id, {FLAT} from (select frame_id, unnest(kept) as b from r)"
L10_SQL = f"""{LIVE_SQL} select f.frame_id, coalesce(len(kept), 0) as person_count from (select distinct frame_id from ({DET})) f left join ({kept_lists_sql(f"select d.* from ({_EVENTS}) d where {_owned('d')}")}) k on f.frame_id = k.frame_id"""


QUERIES = {
    "a1_people_count": (a1_people_count, A1_SQL),
    "s1_tasks": (s1_tasks, TASKS),
    "f8_static_assignment": (f8_static_assignment, F8_SQL),
    "x1_mock_boxes": (x1_mock_boxes, MOCK_SQL),
    "x2_command_boxes": (x2_command_boxes, X2_SQL),
    "x3_worker_boxes": (x3_worker_boxes, X3_SQL),
    "x5_costs": (x5_costs, X5_SQL),
    "p2_remapped_boxes": (p2_remapped_boxes, P2_SQL),
    "p5_box_geometry": (p5_box_geometry, P5_SQL),
    "f3_pair_rules": (f3_pair_rules, F3_SQL),
    "f2_owner_filter": (f2_owner_filter, f"select det_id, frame_id, tile_id from ({OWNED})"),
    "j5_duplicate_pairs": (j5_duplicate_pairs, J5_SQL),
    "a9_suppressed_boxes": (a9_suppressed_boxes, f"select frame_id, {FLAT} from ({kept_sql(OWNED)})"),
    "a9_crowded_frames": (a9_crowded_frames, f"select frame_id, {FLAT} from ({kept_sql(MOSAIC.format(det=DET))})"),
    "w7_order_in_frame": (w7_order_in_frame, f"select det_id, frame_id, row_number() over (partition by frame_id order by conf desc, tile_id, x1, y1, x2, y2) as place from ({DET})"),
    "k2_bbox_table": (k2_bbox_table, K2_SQL),
    "j6_uncovered_boxes": (j6_uncovered_boxes, J6_SQL),
    "s8_payload_lines": (s8_payload_lines, S8_SQL),
    "s2_tile_grids": (s2_tile_grids, "select s_suppkey, cast(1 + s_suppkey % 7 as int) as cols, cast(1 + s_suppkey % 5 as int) as rows from supplier"),
    "s5_camera_lines": (s5_camera_lines, f"select cast(task_id as int) as task_id, frame_id, tile_id, x1, y1, x2, y2, 'tile ' || task_id as image from ({TASKS})"),
    "s4_camera_tiles": (s4_camera_tiles, S4_SQL),
    "k9_viewer_lines": (k9_viewer_lines, K9_SQL),
    "p11_commands": (p11_commands, P11_SQL),
    "l4_anchor_policies": (l4_anchor_policies, L4_SQL),
    "a10_temporal_dedup": (a10_temporal_dedup, A10_SQL),
    "l10_final_counts": (l10_final_counts, L10_SQL),
    "l3_live_stream": (l3_live_stream, A10_SQL),
    "s4_camera_stream": (s4_camera_stream, S4_STREAM_SQL),
    "l6_live_camera": (l6_live_camera, L6_SQL),
    "k9_viewer_frames": (k9_viewer_frames, K9_FRAMES_SQL),
}
