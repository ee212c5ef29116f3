"""Queries of the reporting layer, and their SQL."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig
from tilewright.functions import text
from tilewright.operators import layers, metrics, topology
from tilewright.plans import convolution
from tilewright.shared import before_sums, staged_path
from tilewright.sinks import tables
from tilewright.sources import adapters, files, tasks
from tilewright.sources.adapters import ansi, relation

SERIAL, PARALLEL, GT, RANKS, ROWS, SWEEP, MOT, HOSTS, LAYERS = map(ansi, (
    adapters.COUNT_SERIAL, adapters.COUNT_PARALLEL, adapters.GT, adapters.RANK_METRICS, adapters.METRIC_ROWS, adapters.SWEEP_RUNS, adapters.MOT_GT, adapters.HOST_LINES, adapters.LAYER_RUNS))


def six(table: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles at ``digits`` decimals, so that engines agree on them."""
    return table.select(*[F.round(n, digits).alias(n) if t == "double" else F.col(n) for n, t in table.dtypes])


def a3_metrics_by_rank(spark, sf_dir):
    """A3, T24."""
    return metrics.by_rank(relation(spark, sf_dir, adapters.METRIC_ROWS))


A3_SQL = f"select rank, coalesce(min(case when hostname <> '' then hostname end), '') as hostname, cast(sum(tasks_done) as bigint) as tasks_done, cast(sum(frames_done) as bigint) as frames_done, sum(compute_ms) as compute_ms, sum(io_ms) as io_ms, sum(yolo_ms) as yolo_ms, sum(comm_ms) as comm_ms from ({ROWS}) group by rank"


def k3_rank_table(spark, sf_dir):
    """W1, K3, O2, T9."""
    return metrics.with_idle(relation(spark, sf_dir, adapters.RANK_METRICS)).select("rank", "hostname", "tasks_done", "compute_ms", "idle_ms")


K3_SQL = f"select rank, hostname, tasks_done, compute_ms, greatest(0.0, max(compute_ms) over () - compute_ms) as idle_ms from ({RANKS})"


def a4_run_summary(spark, sf_dir):
    """A4, A5, K4, F9, T10, T11."""
    return six(metrics.run_summary(relation(spark, sf_dir, adapters.RANK_METRICS)))


A4_SQL = f"""select round(max(compute_ms), 6) as total_ms_without_comm, round(max(compute_ms), 6) as compute_ms_max, round(avg(compute_ms), 6) as compute_ms_avg, round(sum(comm_ms), 6) as comm_ms_total,
 round(sum(io_ms), 6) as io_ms_total, round(sum(yolo_ms), 6) as yolo_ms_total, round(sum(idle), 6) as idle_ms_total, round(max(compute_ms) filter (tasks_done > 0) / avg(compute_ms) filter (tasks_done > 0), 6) as load_imbalance
from (select *, greatest(0.0, max(compute_ms) over () - compute_ms) as idle from ({RANKS}))"""


N_FRAMES = f"(select cast(count(distinct frame_id) as int) from ({adapters.ansi(adapters.DET)}))"


def _run(spark, sf_dir, **settings) -> DetectionConfig:
    """The settings of a run over all frames of ``events``."""
    frames = relation(spark, sf_dir, adapters.DET).select("frame_id").distinct().count()
    return DetectionConfig(tile_grid="4x3", frames=frames, **settings)


def k4_summary_table(spark, sf_dir):
    """K4, A4: the whole one-row summary of a run."""
    return six(metrics.summary_row(_run(spark, sf_dir), relation(spark, sf_dir, adapters.RANK_METRICS), relation(spark, sf_dir, adapters.COUNT_SERIAL), run_id="run-1", model="mock"))


K4_SQL = f"""select 'run-1' as run_id, 'PySpark' as language, 'mock' as detector, 'mock' as model, 'cpu' as device, 640 as imgsz, {N_FRAMES} as frames, '4x3' as tile_grid, 12 * {N_FRAMES} as num_tasks, 64 as overlap, 1 as tile_owner_filter,
 cast(0.7 as double) as dedup_ios, cast(0.3 as double) as dedup_center, cast(0.7 as double) as dedup_axis_overlap, cast(0.08 as double) as dedup_gap, 0 as dedup_near_camera, cast(0.12 as double) as dedup_large_area_ratio, 1 as dedup_merge,
 'static' as schedule, 1 as chunk_size, 1 as master_compute, w.world_size, 1280 as video_width, 720 as video_height, w.total_ms_with_comm, s.*, c.avg_count, '' as correctness_pass
from ({A4_SQL}) s, (select cast(count(*) as int) as world_size, round(max(compute_ms + comm_ms), 6) as total_ms_with_comm from ({RANKS})) w, (select round(coalesce(sum(person_count), 0) / {N_FRAMES}, 6) as avg_count from ({SERIAL})) c"""


def a11_host_rollup(spark, sf_dir):
    """A11, W2, O3."""
    return six(metrics.host_rollup(relation(spark, sf_dir, adapters.RANK_METRICS), "uniform"))


HOST_SQL = f"""select 'uniform' as label, hostname, count(*) as rank_count, cast(sum(tasks_done) as bigint) as tasks_done, round(sum(tasks_done) / sum(sum(tasks_done)) over (), 6) as task_share, cast(sum(frames_done) as bigint) as frames_done,
 round(sum(compute_ms) / 1000, 6) as compute_s, round(sum(comm_ms) / 1000, 6) as comm_s, round(sum(idle) / 1000, 6) as idle_s, round(sum(yolo_ms) / 1000, 6) as yolo_s
from (select *, greatest(0.0, max(compute_ms) over () - compute_ms) as idle from ({RANKS})) group by hostname"""


def a12_rank_summary(spark, sf_dir):
    """A12, F9."""
    return six(metrics.rank_summary(relation(spark, sf_dir, adapters.RANK_METRICS), "4x3"))


A12_SQL = f"""select '4x3' as label, rank_count, total_tasks, round(hi, 6) as compute_s_max, round(lo, 6) as compute_s_min, round(mid, 6) as compute_s_avg, round(comm, 6) as comm_s_total, round(idle, 6) as idle_s_total,
 round(case when hi > 0 then gap / hi else 0 end, 6) as idle_gap_ratio, case when case when hi > 0 then gap / hi else 0 end <= 0.25 then 'YES' else 'NO' end as load_balance_pass
from (select count(*) as rank_count, cast(sum(tasks_done) as bigint) as total_tasks, max(compute_ms) filter (tasks_done > 0) / 1000 as hi, min(compute_ms) filter (tasks_done > 0) / 1000 as lo, avg(compute_ms) filter (tasks_done > 0) / 1000 as mid,
  sum(comm_ms) / 1000 as comm, sum(idle) / 1000 as idle, (max(idle) filter (tasks_done > 0) - min(idle) filter (tasks_done > 0)) / 1000 as gap
 from (select *, greatest(0.0, max(compute_ms) over () - compute_ms) as idle from ({RANKS})))"""


def j10_host_distribution(spark, sf_dir):
    """P19, J10."""
    return metrics.host_distribution(metrics.host_rollup(relation(spark, sf_dir, adapters.RANK_METRICS), "uniform"))


J10_SQL = f"""select label, string_agg(printf('%s ranks=%d tasks=%d share=%.3f', hostname, rank_count, tasks_done, share), '; ' order by hostname) as host_task_distribution
from (select 'uniform' as label, hostname, count(*) as rank_count, cast(sum(tasks_done) as bigint) as tasks_done, cast(sum(tasks_done) / sum(sum(tasks_done)) over () as double) as share from ({RANKS}) group by hostname) group by label"""


def j12_host_change(spark, sf_dir):
    """Tasks of each host in one placement and another, 0 where a host isn't in one."""
    rows = relation(spark, sf_dir, adapters.RANK_METRICS)
    one = rows.where("rank % 3 <> 0").groupBy("hostname").agg(F.sum("tasks_done").alias("uniform_tasks"))
    two = rows.where("rank % 4 <> 1").groupBy("hostname").agg(F.sum("tasks_done").alias("weighted_tasks"))
    return one.join(two, "hostname", "full_outer").select("hostname", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("uniform_tasks", "weighted_tasks")])


J12_SQL = f"select hostname, cast(coalesce(a, 0) as bigint) as uniform_tasks, cast(coalesce(b, 0) as bigint) as weighted_tasks from (select hostname, sum(tasks_done) as a from ({RANKS}) where rank % 3 <> 0 group by 1) x full join (select hostname, sum(tasks_done) as b from ({RANKS}) where rank % 4 <> 1 group by 1) y using (hostname)"


def _compared(spark, sf_dir):
    return metrics.compared_counts(relation(spark, sf_dir, adapters.COUNT_SERIAL), relation(spark, sf_dir, adapters.COUNT_PARALLEL))


def j2_count_comparison(spark, sf_dir):
    """J2, U1, T12; a side without a frame is an empty text, as in the tables of the reports."""
    return _compared(spark, sf_dir).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("serial_count", "mpi_count")})


J2_SQL = f"""select frame_id, coalesce(cast(serial_count as varchar), '') as serial_count, coalesce(cast(mpi_count as varchar), '') as mpi_count, error, abs(error) as abs_error, case when error = 0 then 'YES' else 'NO' end as match from (
 select frame_id, s.person_count as serial_count, m.person_count as mpi_count, cast(case when s.person_count is null or m.person_count is null then 1 else m.person_count - s.person_count end as bigint) as error
 from ({SERIAL}) s full join ({PARALLEL}) m using (frame_id))"""


def a6_correctness(spark, sf_dir):
    """A6."""
    return metrics.correctness(_compared(spark, sf_dir))


A6_SQL = f"select case when max(abs_error) = 0 then 'YES' else 'NO' end as correctness_pass, count(*) as frames_compared, count(*) filter (error <> 0) as mismatched_frames, max(abs_error) as max_abs_error, round(avg(abs_error), 6) as mean_abs_error from ({J2_SQL})"


def k5_correctness_text(spark, sf_dir):
    """K5."""
    return tables.correctness_text(metrics.correctness(_compared(spark, sf_dir)).select("correctness_pass", "frames_compared", "mismatched_frames", "max_abs_error"))


K5_SQL = f"select unnest(['CORRECTNESS_PASS=' || correctness_pass, 'FRAMES_COMPARED=' || frames_compared, 'MISMATCHED_FRAMES=' || mismatched_frames, 'MAX_ABS_ERROR=' || max_abs_error]) as value from ({A6_SQL})"


def _errors(spark, sf_dir):
    return metrics.against_truth(relation(spark, sf_dir, adapters.COUNT_SERIAL), relation(spark, sf_dir, adapters.GT))


def j3_truth_comparison(spark, sf_dir):
    """J3, U2, T13, T15."""
    return _errors(spark, sf_dir)


J3_SQL = f"""select frame_id, gt_count, person_count as pred_count, person_count - gt_count as error, abs(person_count - gt_count) as abs_error, (person_count - gt_count) * (person_count - gt_count) as squared_error,
 case when gt_count <> 0 then round(abs(person_count - gt_count) / cast(gt_count as double), 6) end as absolute_percentage_error from ({GT}) join ({SERIAL}) using (frame_id)"""


def a7_accuracy(spark, sf_dir):
    """A7."""
    return metrics.accuracy(_errors(spark, sf_dir))


A7_SQL = f"""select count(*) as frames_compared, round(avg(abs_error), 6) as mae, round(sqrt(avg(squared_error)), 6) as rmse, round(avg(abs_error / cast(gt_count as double)) filter (gt_count <> 0), 6) as mean_abs_percentage_error,
 round(avg(case when error = 0 then 1.0 else 0.0 end), 6) as exact_match_rate, round(avg(gt_count), 6) as mean_gt_count, round(avg(pred_count), 6) as mean_pred_count from ({J3_SQL})"""


def a8_truth_counts(spark, sf_dir):
    """Visible people per ground-truth frame, from its lines."""
    lines = relation(spark, sf_dir, adapters.MOT_GT).select(F.concat_ws(",", "mot_frame", "track_id", F.lit("0,0,0,0"), F.col("conf").cast("int"), "class_id", "visibility").alias("value"))
    boxes = files.ground_truth(lines.unionByName(lines.sparkSession.createDataFrame([("1,2,3",)], "value string")))
    spine = spark.range(1, 321).select(F.col("id").cast("int").alias("mot_frame"))
    return metrics.truth_counts(spine, boxes, 0.25)


A8_SQL = f"select cast(f as int) as mot_frame, cast(f - 1 as int) as frame_id, coalesce(n, 0) as person_count from (select unnest(range(1, 321)) as f) left join (select mot_frame, count(*) as n from ({MOT}) where conf > 0 and class_id = 1 and visibility >= 0.25 group by 1) on f = mot_frame"


def _speedups(spark, sf_dir):
    runs = relation(spark, sf_dir, adapters.SWEEP_RUNS).withColumn("run_seq", F.col("p_idx"))
    return metrics.speedup(runs, ["label", "repeat_no"])


def a13_speedup(spark, sf_dir):
    """Two labelled sweeps, each against its first run."""
    return six(_speedups(spark, sf_dir).drop("run_seq", "p_idx"))


SPEED = f"""select label, repeat_no, world_size, total_ms_with_comm, total_ms_without_comm,
 first(total_ms_with_comm) over w / total_ms_with_comm as sw, first(total_ms_without_comm) over w / total_ms_without_comm as so
from ({SWEEP}) window w as (partition by label, repeat_no order by p_idx rows between unbounded preceding and unbounded following)"""
A13_SQL = f"select label, repeat_no, world_size, total_ms_with_comm, total_ms_without_comm, round(sw, 6) as speedup_with_comm, round(so, 6) as speedup_without_comm, round(sw / world_size, 6) as efficiency_with_comm, round(so / world_size, 6) as efficiency_without_comm from ({SPEED})"


def a15_repeats(spark, sf_dir):
    """A15, T17."""
    return six(metrics.repeats(_speedups(spark, sf_dir)), 4)


A15_SQL = f"select label, world_size, count(*) as repeats, round(avg(total_ms_with_comm), 4) as mean_total_ms_with_comm, round(coalesce(stddev_samp(total_ms_with_comm), 0), 4) as stdev_total_ms_with_comm, round(avg(sw), 4) as mean_speedup_with_comm, round(avg(sw / world_size), 4) as mean_efficiency_with_comm from ({SPEED}) group by 1, 2"


def f13_find_frames(spark, sf_dir):
    """The smallest input that takes two to three minutes."""
    runs = relation(spark, sf_dir, adapters.SWEEP_RUNS).select((F.col("world_size") * 100 + F.col("repeat_no")).alias("frames"), (F.col("total_ms_without_comm") % 300000).alias("total_ms_with_comm"))
    return metrics.find_frames(runs)


F13_SQL = f"select min(world_size * 100 + repeat_no) as frames from ({SWEEP}) where total_ms_without_comm % 300000 / 1000 between 120 and 180"


def j9_scheduler_comparison(spark, sf_dir):
    """A run's summary with its rank summary, per schedule."""
    rows = relation(spark, sf_dir, adapters.RANK_METRICS)
    out = None
    for schedule, keep in (("static", "true"), ("dynamic", "rank % 2 = 0")):
        part = rows.where(keep)
        cfg = _run(spark, sf_dir, schedule=schedule)
        one = metrics.summary_row(cfg, part, relation(spark, sf_dir, adapters.COUNT_SERIAL), run_id=schedule).select("schedule", "world_size", "frames", "tile_grid", "num_tasks", "total_ms_with_comm", "total_ms_without_comm", "load_imbalance").join(
            metrics.rank_summary(part, schedule).select(F.col("label").alias("schedule"), "comm_s_total", "idle_s_total", "idle_gap_ratio", "load_balance_pass"), "schedule")
        out = one if out is None else out.unionByName(one)
    return six(out)


def _j9(schedule: str, keep: str) -> str:
    return f"""select '{schedule}' as schedule, cast(count(*) as int) as world_size, {N_FRAMES} as frames, '4x3' as tile_grid, 12 * {N_FRAMES} as num_tasks, round(max(compute_ms + comm_ms), 6) as total_ms_with_comm, round(max(compute_ms), 6) as total_ms_without_comm, round(max(compute_ms) filter (tasks_done > 0) / avg(compute_ms) filter (tasks_done > 0), 6) as load_imbalance, round(sum(comm_ms) / 1000, 6) as comm_s_total,
 round(sum(idle) / 1000, 6) as idle_s_total, round((max(idle) filter (tasks_done > 0) - min(idle) filter (tasks_done > 0)) / max(compute_ms) filter (tasks_done > 0), 6) as idle_gap_ratio,
 case when (max(idle) filter (tasks_done > 0) - min(idle) filter (tasks_done > 0)) / max(compute_ms) filter (tasks_done > 0) <= 0.25 then 'YES' else 'NO' end as load_balance_pass
from (select *, greatest(0.0, max(compute_ms) over () - compute_ms) as idle from ({RANKS}) where {keep})"""


J9_SQL = f"{_j9('static', 'true')} union all {_j9('dynamic', 'rank % 2 = 0')}"


def _layer_runs(spark, sf_dir):
    return relation(spark, sf_dir, adapters.LAYER_RUNS)


def a14_mode_speedup(spark, sf_dir):
    """Layer sums per run, speedup against one process per halo mode."""
    return six(metrics.speedup_by_mode(layers.run_totals(_layer_runs(spark, sf_dir))))


TOTALS = f"select halo_mode, p, sum(scatter_ms) as scatter_ms, sum(halo_ms) as halo_ms, sum(compute_ms) as compute_ms, sum(gather_ms) as gather_ms, sum(scatter_ms + halo_ms + compute_ms + gather_ms) as distributed_ms from ({LAYERS}) group by 1, 2"
A14_SQL = f"select *, round(max(distributed_ms) filter (p = 1) over (partition by halo_mode) / distributed_ms, 6) as speedup, round(max(distributed_ms) filter (p = 1) over (partition by halo_mode) / distributed_ms / p, 6) as efficiency from ({TOTALS})"


def a16_layer_breakdown(spark, sf_dir):
    """A16, W8, O6."""
    return layers.breakdown_of_largest(_layer_runs(spark, sf_dir))


A16_SQL = f"select halo_mode, p, layer_id, sum(scatter_ms) as scatter_ms, sum(halo_ms) as halo_ms, sum(compute_ms) as compute_ms, sum(gather_ms) as gather_ms from (select *, max(p) over (partition by halo_mode) as top from ({LAYERS})) where p = top group by 1, 2, 3"


def a17_layer_wall_times(spark, sf_dir):
    """The slowest rank per layer, of the last repeat; p stands for the rank, halo mode for the repeat."""
    rows = _layer_runs(spark, sf_dir).withColumn("repeat_no", F.when(F.col("halo_mode") == "blocking", 0).otherwise(1))
    return layers.wall_times(layers.last_repeat(rows))


A17_SQL = f"select layer_id, max(scatter_ms) as scatter_ms, max(halo_ms) as halo_ms, max(compute_ms) as compute_ms, max(gather_ms) as gather_ms from ({LAYERS}) where halo_mode = 'nonblocking' group by 1"


def a18_rank_times(spark, sf_dir):
    """Sums over layers and repeats per rank, with idle times."""
    return layers.rank_times(_layer_runs(spark, sf_dir).withColumnRenamed("p", "rank"))


A18_SQL = f"""select rank, scatter_ms, halo_ms, compute_ms, gather_ms, scatter_ms + halo_ms + compute_ms + gather_ms as total_ms, max(compute_ms) over () - compute_ms as idle_ms
from (select p as rank, sum(scatter_ms) as scatter_ms, sum(halo_ms) as halo_ms, sum(compute_ms) as compute_ms, sum(gather_ms) as gather_ms from ({LAYERS}) group by 1)"""


def a27_halo_share(spark, sf_dir):
    """Share of the halo in each run."""
    return six(layers.halo_share(layers.run_totals(_layer_runs(spark, sf_dir))).select("halo_mode", "p", "halo_ratio"))


A27_SQL = f"select halo_mode, p, round(case when distributed_ms > 0 then halo_ms / distributed_ms else 0 end, 6) as halo_ratio from ({TOTALS})"


def w6_displacements(spark, sf_dir):
    """Where each rank's payload begins."""
    rows = relation(spark, sf_dir, adapters.RANK_METRICS).select("rank", F.col("tasks_done").alias("size"))
    return before_sums(rows, ["rank"], "size", "displacement")


W6_SQL = f"select rank, tasks_done as size, cast(coalesce(sum(tasks_done) over (order by rank rows between unbounded preceding and 1 preceding), 0) as bigint) as displacement from ({RANKS})"


def f10_readiness(spark, sf_dir):
    """F10, J16."""
    ranks = relation(spark, sf_dir, adapters.RANK_METRICS)
    summary = spark.createDataFrame([("spark", "mock", 12, 48)], "language string, detector string, world_size int, num_tasks int")
    hosts = files.host_slots(relation(spark, sf_dir, adapters.HOST_LINES))
    return metrics.readiness(summary, ranks, relation(spark, sf_dir, adapters.DET), hosts, ["Supplier#000000001", "nowhere"])


def _slots_sql() -> str:
    return f"select line_no, regexp_extract(trim(line), '^(\\S+)', 1) as host, cast(case when regexp_extract(line, 'slots=([0-9]+)', 1) = '' then '1' else regexp_extract(line, 'slots=([0-9]+)', 1) end as int) as slots from ({HOSTS}) where trim(line) <> '' and trim(line) not like '#%'"


F10_SQL = f"""
with act as (select coalesce(string_agg(cast(rank as varchar), ',' order by cast(rank as varchar)), 'none') as names, count(*) as n, bool_or(rank = 0) as zero from ({RANKS}) where tasks_done > 0), hs as ({_slots_sql()})
select 'PASS' as status, 'parallel language' as "check", 'spark' as detail union all select 'WARN', 'detector', 'mock' union all select 'PASS', 'world_size', '12' union all select 'PASS', 'num_tasks', '48'
union all select case when n > 0 then 'PASS' else 'WARN' end, 'bboxes', 'rows=' || n from (select count(*) as n from events)
union all select case when n > 0 then 'PASS' else 'FAIL' end, 'active ranks', names from act union all select case when zero then 'PASS' else 'FAIL' end, 'master rank compute', names from act
union all select case when sum(slots) > 0 then 'PASS' else 'FAIL' end, 'host slots', cast(sum(slots) as varchar) from hs
union all select case when r in (select host from hs) then 'PASS' else 'FAIL' end, 'required host ' || r, '' from (select unnest(['Supplier#000000001', 'nowhere']) as r)
"""


def f12_gate(spark, sf_dir):
    """Correctness over the union of three tables of runs."""
    rows = relation(spark, sf_dir, adapters.LAYER_RUNS).select(F.when(F.col("p") < 12, "YES").otherwise("NO").alias("correct"), F.when(F.col("layer_id") == 3, "n/a").otherwise((F.col("halo_ms") % 7 / 10000).cast("string")).alias("max_abs_error"), "layer_id")
    parts = [rows.where(F.col("layer_id") % 3 == k).drop("layer_id") for k in range(3)]
    return metrics.gate(parts[0].unionByName(parts[1]).unionByName(parts[2]))


F12_SQL = f"select 'NO,YES' as correct_values, max(case when layer_id <> 3 then halo_ms % 7 / 10000 end) as max_error, 'FAIL' as status from ({LAYERS})"


def s15_host_slots(spark, sf_dir):
    """S15."""
    return files.host_slots(relation(spark, sf_dir, adapters.HOST_LINES))


def a25_slot_totals(spark, sf_dir):
    """A25."""
    return files.host_slots(relation(spark, sf_dir, adapters.HOST_LINES)).agg(F.count("*").alias("hosts"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"))


def _placed(spark, sf_dir, policy):
    return tasks.placed_ranks(files.host_slots(relation(spark, sf_dir, adapters.HOST_LINES)).withColumnRenamed("line_no", "seq"), policy)


def d3_placement(spark, sf_dir):
    """Host of each rank under either policy."""
    return _placed(spark, sf_dir, "slot").withColumnRenamed("host", "by_slot").join(_placed(spark, sf_dir, "node").withColumnRenamed("host", "by_node"), "rank")


SLOT_RANKS = "select cast(row_number() over (order by {order}) - 1 as int) as rank, host from (select line_no, host, unnest(range(1, slots + 1)) as slot from (" + _slots_sql() + "))"
D3_SQL = f"select a.rank, a.host as by_slot, b.host as by_node from ({SLOT_RANKS.format(order='line_no, slot')}) a join ({SLOT_RANKS.format(order='slot, line_no')}) b using (rank)"


def _cells(spark, sf_dir):
    return topology.mesh(_placed(spark, sf_dir, "slot"), 6)


def a19_topology(spark, sf_dir):
    """Edges of a mesh six ranks wide."""
    return topology.edge_counts(topology.edges(_cells(spark, sf_dir)))


CELLS = f"select rank, host, rank // 6 as r, rank % 6 as c from ({SLOT_RANKS.format(order='line_no, slot')})"
A19_SQL = f"""select count(*) as total_edges, count(*) filter (a.host = b.host) as intra_machine_edges, count(*) filter (a.host <> b.host) as inter_machine_edges, round(count(*) filter (a.host <> b.host) / count(*), 6) as inter_machine_edge_ratio,
 count(*) filter (a.r = b.r or a.c = b.c) as cardinal_edges, count(*) filter (a.r <> b.r and a.c <> b.c) as diagonal_edges
from ({CELLS}) a join ({CELLS}) b on (b.r = a.r and b.c = a.c + 1) or (b.r = a.r + 1 and b.c between a.c - 1 and a.c + 1)"""


def k8_mesh_lines(spark, sf_dir):
    """The mesh as lines of text."""
    return topology.ascii_grid(_cells(spark, sf_dir))


K8_SQL = f"select cast(r as int) as r, string_agg(printf('%d@%s', rank, split_part(host, '.', 1)), ' | ' order by c) as line from ({CELLS}) group by r"


def s16_manifest(spark, sf_dir):
    """key=value lines; the last of a key holds."""
    lines = relation(spark, sf_dir, "select s_suppkey as seq, concat('key', cast(s_suppkey%7 as varchar(4)), case when s_suppkey%5=0 then '' else '=' end, s_name, '=x') as value from {supplier}")
    return files.manifest(lines)


S16_SQL = "select split_part(v, '=', 1) as key, max_by(v[strpos(v, '=') + 1:], s) as value from (select s_suppkey as s, concat('key', s_suppkey%7, case when s_suppkey%5=0 then '' else '=' end, s_name, '=x') as v from supplier) group by 1"


def s7_counts_fallback(spark, sf_dir):
    """Counts from the first known column, half to even, last row of a frame."""
    rows = relation(spark, sf_dir, "select event_id as seq, cast(floor(event_id/3) as int) as frame_id, cast(cast(event_id%9 as double)/2 as string) as person_count from {events}")
    return files.counts_with_fallback(rows)


S7_SQL = "select frame_id, cast(round_even(v, 0) as bigint) as person_count from (select cast(floor(event_id/3) as int) as frame_id, max_by(cast(event_id%9 as double)/2, event_id) as v from events group by 1)"


def s11_image_list(spark, sf_dir):
    """The first 50 paths of a list with blanks and comments."""
    lines = relation(spark, sf_dir, adapters.HOST_LINES).select(F.col("line_no").alias("seq"), F.col("line").alias("value"))
    return files.image_list(lines, limit=50, base="/data")


S11_SQL = f"select cast(row_number() over (order by line_no) - 1 as int) as image_index, '/data/' || trim(line) as path from ({HOSTS}) where trim(line) <> '' and trim(line) not like '#%' qualify row_number() over (order by line_no) <= 50"


def p13_formatted(spark, sf_dir):
    """Numbers at three decimals, other texts as they are; flags."""
    rows = relation(spark, sf_dir, "select s_suppkey, case when s_suppkey%4=0 then 'n/a' else cast(cast(s_suppkey as double)/8 as string) end as v, case s_suppkey%5 when 0 then '1' when 1 then 'true' when 2 then 'yes' when 3 then 'True' else 'no' end as f from {supplier}")
    return rows.select("s_suppkey", text.fixed(F.col("v"), 3).alias("v"), text.flag(F.col("f")).alias("f"))


P13_SQL = "select s_suppkey, case when s_suppkey%4=0 then 'n/a' else printf('%.3f', cast(s_suppkey as double)/8) end as v, s_suppkey%5 < 3 as f from supplier"


def p16_grids(spark, sf_dir):
    """The most square grid of one process more than each supplier's key says, and the second part of 1,000 dealt into as many."""
    p = F.col("s_suppkey").cast("bigint") + 1
    rows = text.most_square_rows(p)
    return relation(spark, sf_dir, "select s_suppkey from {supplier}").select(p.alias("processes"), rows.alias("rows"), F.floor(p / rows).alias("cols"), text.split_start(F.lit(1000), p, F.lit(1)).alias("start"), text.split_end(F.lit(1000), p, F.lit(1)).alias("end"))


P16_SQL = """select p as processes, r as rows, p // r as cols, 1000 // p + least(1, 1000 % p) as start, 2 * (1000 // p) + least(2, 1000 % p) as "end"
from (select p, list_max(list_filter(range(1, p + 1), lambda d: p % d = 0 and d * d <= p)) as r from (select cast(s_suppkey + 1 as bigint) as p from supplier))"""


def k10_markdown(spark, sf_dir):
    """The host roll-up as a Markdown table."""
    rows = metrics.host_rollup(relation(spark, sf_dir, adapters.RANK_METRICS), "a|b").select("label", "hostname", "rank_count", "tasks_done")
    return tables.markdown(rows, ["hostname"])


K10_SQL = f"""select 0 as seq, '| label | hostname | rank_count | tasks_done |' as line union all select 1, '| --- | --- | --- | --- |'
union all select row_number() over (order by hostname) + 1, '| a/b | ' || hostname || ' | ' || n || ' | ' || t || ' |' from (select hostname, count(*) as n, cast(sum(tasks_done) as bigint) as t from ({RANKS}) group by 1)"""


def k13_first_frames(spark, sf_dir):
    """The first 30 frames of two sources in turn."""
    rows = relation(spark, sf_dir, adapters.COUNT_SERIAL).select(F.col("frame_id").alias("seq"), "person_count")
    return tables.first_frames([rows.where("seq < 20"), rows.where("seq >= 20")], 30).select("part", "seq", "person_count")


K13_SQL = f"select cast(frame_id >= 20 as int) as part, frame_id as seq, person_count from ({SERIAL}) order by 1, 2 limit 30"


def s17_keyed_files(spark, sf_dir):
    """Rows counted by a key from their file's path."""
    table = spark.read.parquet(f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet")
    keyed = files.with_path_key(table, r"/(nation|region)\.parquet", "source")
    return keyed.groupBy("source").agg(F.count("*").alias("n"))


S17_SQL = "select 'nation' as source, count(*) as n from nation union all select 'region', count(*) from region"

def d7_accuracy_overview(spark, sf_dir):
    """The accuracy table of a suite of four sequences."""
    return metrics.accuracy(_errors(spark, sf_dir).withColumn("sequence", F.concat(F.lit("seq-"), (F.col("frame_id") % 4).cast("string"))), ("sequence",))


D7_SQL = f"""select 'seq-' || (frame_id % 4) as sequence, count(*) as frames_compared, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse, round(coalesce(avg(case when g <> 0 then abs(e) / g end), 0), 6) as mean_abs_percentage_error,
 round(avg(case when e = 0 then 1 else 0 end), 6) as exact_match_rate, round(avg(g), 6) as mean_gt_count, round(avg(p), 6) as mean_pred_count
from (select frame_id, gt_count as g, person_count as p, person_count - gt_count as e from ({GT}) t join ({SERIAL}) s using (frame_id)) group by 1"""


def d7_sweep_overview(spark, sf_dir):
    """Granularity and speedup of all grids and process counts as one table."""
    return six(metrics.sweep_overview(relation(spark, sf_dir, adapters.GRID_RANKS)))


D7_SWEEP_SQL = f"""
with m as (select * from ({ansi(adapters.GRID_RANKS)})), i as (select *, greatest(0.0, max(compute_ms) over (partition by tile_grid, world_size) - compute_ms) as idle from m),
r as (select tile_grid, world_size, cast(sum(tasks_done) as bigint) as total_tasks, coalesce(max(compute_ms) filter (tasks_done > 0), 0) / 1000 as hi, coalesce(min(compute_ms) filter (tasks_done > 0), 0) / 1000 as lo, coalesce(avg(compute_ms) filter (tasks_done > 0), 0) / 1000 as mid,
 sum(comm_ms) / 1000 as comm, sum(idle) / 1000 as idle, max(compute_ms + comm_ms) as tw, max(compute_ms) as tc, coalesce(max(idle) filter (tasks_done > 0) - min(idle) filter (tasks_done > 0), 0) / 1000 as gap from i group by 1, 2),
b as (select *, first(tw) over w / tw as sw, first(tc) over w / tc as sc, case when hi > 0 then gap / hi else 0 end as ratio from r window w as (partition by tile_grid order by world_size rows between unbounded preceding and unbounded following))
select tile_grid, world_size, total_tasks, round(hi, 6) as compute_s_max, round(lo, 6) as compute_s_min, round(mid, 6) as compute_s_avg, round(comm, 6) as comm_s_total, round(idle, 6) as idle_s_total, tw as total_ms_with_comm, tc as total_ms_without_comm,
 round(ratio, 6) as idle_gap_ratio, case when ratio <= 0.25 then 'YES' else 'NO' end as load_balance_pass, round(sw, 6) as speedup_with_comm, round(sw / world_size, 6) as efficiency_with_comm, round(sc, 6) as speedup_without_comm, round(sc / world_size, 6) as efficiency_without_comm from b
"""


def d7_placement_overview(spark, sf_dir):
    """Two placements of the ranks side by side."""
    rows = relation(spark, sf_dir, adapters.RANK_METRICS)
    return six(metrics.placement_overview(_run(spark, sf_dir), {"uniform_24": rows, "weighted_24": rows.where("rank % 3 <> 0")}, relation(spark, sf_dir, adapters.COUNT_SERIAL)))


def _placement_sql(label: str, keep: str) -> str:
    return f"""select '{label}' as label, s.world_size, {N_FRAMES} as frames, '4x3' as tile_grid, s.total_ms_with_comm, s.total_ms_without_comm, s.load_imbalance, h.host_task_distribution
 from (select cast(count(*) as int) as world_size, round(max(compute_ms + comm_ms), 6) as total_ms_with_comm, round(max(compute_ms), 6) as total_ms_without_comm, round(max(compute_ms) filter (tasks_done > 0) / avg(compute_ms) filter (tasks_done > 0), 6) as load_imbalance from ({RANKS}) where {keep}) s,
 (select string_agg(printf('%s ranks=%d tasks=%d share=%.3f', hostname, rank_count, tasks_done, share), '; ' order by hostname) as host_task_distribution from (select hostname, count(*) as rank_count, cast(sum(tasks_done) as bigint) as tasks_done, cast(sum(tasks_done) / sum(sum(tasks_done)) over () as double) as share from ({RANKS}) where {keep} group by hostname)) h"""


D7_PLACEMENT_SQL = f"{_placement_sql('uniform_24', 'true')} union all {_placement_sql('weighted_24', 'rank % 3 <> 0')}"


def k7_conv_summary(spark, sf_dir):
    """K7: the summary of convolution runs, with the error of blocks against the whole over the maps of ``embeddings``."""
    errors = convolution.a22_tensor_error(spark, sf_dir)
    return layers.conv_summary(_layer_runs(spark, sf_dir), errors, profile="tiny", height=32, width=32)


K7_SQL = f"""select 'tiny' as profile, 32 as height, 32 as width, p as world_size, cast(case p when 4 then 2 when 12 then 3 else 1 end as int) as grid_rows, cast(case p when 2 then 2 when 4 then 2 when 12 then 4 else 1 end as int) as grid_cols, 8 as conv_layers,
 halo_mode, distributed_ms, max(distributed_ms) filter (p = 1) over (partition by halo_mode) as serial_ms, e.max_abs_error, e.mean_abs_error, e.correct from ({TOTALS}), ({convolution.A22_SQL}) e"""


def k7_image_table(spark, sf_dir):
    """Times and errors of each image of a list."""
    rows = relation(spark, sf_dir, "select s_suppkey from {supplier}")
    images = files.image_list(rows.select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("img"), F.col("s_suppkey").cast("string"), F.lit(".ppm")).alias("value")), base="data").withColumns({"height": F.lit(32), "width": F.lit(48)})
    times = images.select("image_index", (F.col("image_index") % 7 + 1.5).alias("distributed_ms"), (F.col("image_index") % 11 + 2.5).alias("serial_ms"))
    errors = images.select(F.col("image_index").alias("img"), (F.col("image_index") % 3 * 0.0005).alias("max_abs_error"), (F.col("image_index") % 3 * 0.0001).alias("mean_abs_error"))
    return six(layers.image_table(images, times, errors))


K7_IMAGE_SQL = """select cast(i as int) as image_index, 'data/img' || s_suppkey || '.ppm' as image_path, 32 as height, 48 as width, i % 7 + 15e-1 as distributed_ms, i % 11 + 25e-1 as serial_ms, round(i % 3 * 5e-4, 6) as max_abs_error, round(i % 3 * 1e-4, 6) as mean_abs_error,
 case when i % 3 < 2 then 'YES' else 'NO' end as correct from (select s_suppkey, row_number() over (order by s_suppkey) - 1 as i from supplier)"""


def _zipped(batches):
    for batch in batches:
        contents = []
        for k in batch["s_suppkey"]:
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as archive:
                archive.writestr("readme.txt", "none")
                if k % 3:
                    archive.writestr(f"MOT17/train/Seq-{k}/GT/gt.txt", f"1,{k},3")
                archive.writestr("other/gt.txt.bak", "x")
            contents.append(data.getvalue())
        yield pd.DataFrame({"path": "z" + batch["s_suppkey"].astype(str), "content": contents})


def s10_zip_members(spark, sf_dir):
    """The ground truth inside an archive per supplier; one in three has none."""
    archives = relation(spark, sf_dir, "select s_suppkey from {supplier}").mapInPandas(_zipped, "path string, content binary")
    return files.zip_members(archives, "gt\\GT.txt").select("path", "member", F.col("content").cast("string").alias("content"))


S10_SQL = "select 'z' || s_suppkey as path, case when s_suppkey % 3 <> 0 then 'MOT17/train/Seq-' || s_suppkey || '/GT/gt.txt' end as member, case when s_suppkey % 3 <> 0 then '1,' || s_suppkey || ',3' end as content from supplier"


def f11_report_readiness(spark, sf_dir):
    """what a report per supplier lacks."""
    rows = relation(spark, sf_dir, "select s_suppkey as k from {supplier}")
    reports = rows.select(
        F.col("k").alias("report"), F.expr("concat(if(k % 2 = 0, 'Static scheduling ', ''), if(k % 5 = 0, '<ID>', ''), repeat('![f](a.png) ', int(k % 7)))").alias("text"),
        F.expr("if(k % 11 = 0, null, concat(repeat('<table>', int(k % 10)), repeat('data:image/png ', int(k % 6))))").alias("html"),
        F.expr("cast(if(k % 3 = 0, concat('/Count 3 /Count ', k % 30), repeat('/Type /Page ', int(k % 25))) as binary)").alias("pdf"))
    out = metrics.report_readiness(reports, ["Static scheduling"], "<ID>")
    return out.select("report", F.concat_ws("; ", "failures").alias("failures"), "ready")


F11_SQL = """
with r as (select s_suppkey as report, s_suppkey as k, (case when s_suppkey % 2 = 0 then 'Static scheduling ' else '' end) || (case when s_suppkey % 5 = 0 then '<ID>' else '' end) as words, s_suppkey % 7 as figures,
  case when s_suppkey % 3 = 0 then greatest(3, s_suppkey % 30) else s_suppkey % 25 end as pages from supplier),
f as (select report, list_filter([
  case when words = '' and figures = 0 then 'missing text' end, case when k % 11 = 0 or (k % 10 = 0 and k % 6 = 0) then 'missing html' end, case when k % 3 <> 0 and k % 25 = 0 then 'missing pdf' end,
  case when k % 5 = 0 then 'placeholders in text' end, case when k % 2 <> 0 then 'missing phrase: Static scheduling' end, case when figures < 5 then 'figures in text: ' || figures end,
  case when k % 11 <> 0 and k % 6 < 5 then 'figures in html' end, case when k % 11 <> 0 and k % 10 < 8 then 'tables in html' end, case when pages not between 10 and 20 then 'pages: ' || pages end], lambda x: x is not null) as l from r)
select report, array_to_string(l, '; ') as failures, case when len(l) = 0 then 'YES' else 'NO' end as ready from f"""


def f1_checked_settings(spark, sf_dir):
    """settings of a run per supplier, and what is wrong with them."""
    rows = relation(spark, sf_dir, "select s_suppkey as k from {supplier}")
    settings = rows.select("k", F.expr("concat(k % 4, if(k % 2 = 0, 'x', 'X'), k % 5)").alias("tile_grid"), F.expr("cast((k % 13) / 10 as double)").alias("iou"), F.expr("cast(k % 6 as int)").alias("chunk_size"),
                           F.expr("if(k % 7 = 0, 'guided', 'dynamic')").alias("schedule"), F.expr("if(k % 8 = 0, 'command', 'mock')").alias("detector"))
    return tasks.checked_settings(settings).select("k", "problem")


F1_SQL = """select s_suppkey as k, case when s_suppkey % 4 = 0 or s_suppkey % 5 = 0 then 'tile_grid must be COLSxROWS, both positive: ' || (s_suppkey % 4) || (case when s_suppkey % 2 = 0 then 'x' else 'X' end) || (s_suppkey % 5)
 when s_suppkey % 6 = 0 then 'frames, width, height and chunk_size must be positive' when s_suppkey % 7 = 0 then 'schedule must be static or dynamic' when s_suppkey % 8 = 0 then 'detector command needs detector_command'
 when s_suppkey % 13 > 10 then 'a duplicate or temporal threshold is out of range' end as problem from supplier"""


def s6_csv_scan(spark, sf_dir):
    """Counts written as CSV files with a header, read again by the declared columns."""
    path = staged_path(spark, "csv")
    relation(spark, sf_dir, adapters.COUNT_SERIAL).select("frame_id", "person_count").write.csv(path, header=True)
    return files.read_csv(spark, path, "frame_id int, person_count bigint")


def s12_ppm_pixels(spark, sf_dir):
    """A 2x1 image in P6 and one in P3 per supplier, decoded to levels of each channel."""
    rows = relation(spark, sf_dir, "select s_suppkey from {supplier}")
    level = lambda k: f"(s_suppkey * 37 + {k} * 11) % 256"
    binary = F.expr(f"concat(cast('P6\\n# two pixels\\n2 1\\n255\\n' as binary), unhex(concat({', '.join(f'lpad(hex({level(k)}), 2, 0)' for k in range(6))})))")
    plain = F.expr(f"cast(concat('P3 2 1 255\\n', concat_ws(' ', {', '.join(level(k) for k in range(6))})) as binary)")
    images = rows.select(F.concat(F.lit("p6/"), "s_suppkey").alias("path"), binary.alias("content")).unionByName(rows.select(F.concat(F.lit("p3/"), "s_suppkey").alias("path"), plain.alias("content")))
    pixels = files.ppm_pixels(images).select("path", "c", "height", "width", F.posexplode("values").alias("x", "value"))
    return pixels.select("path", "c", "height", "width", "x", F.round(F.col("value") * 255).cast("int").alias("level"))


S12_SQL = """select kind || s_suppkey as path, cast(c as int) as c, 1 as height, 2 as width, cast(x as int) as x, cast((s_suppkey * 37 + (3 * x + c) * 11) % 256 as int) as level
from supplier, (select unnest(['p6/', 'p3/']) as kind), (select unnest(range(3)) as c), (select unnest(range(2)) as x)"""


QUERIES = {
    "k4_summary_table": (k4_summary_table, K4_SQL),
    "f1_checked_settings": (f1_checked_settings, F1_SQL),
    "d7_accuracy_overview": (d7_accuracy_overview, D7_SQL),
    "d7_sweep_overview": (d7_sweep_overview, D7_SWEEP_SQL), "d7_placement_overview": (d7_placement_overview, D7_PLACEMENT_SQL),
    "k7_conv_summary": (k7_conv_summary, K7_SQL),
    "k7_image_table": (k7_image_table, K7_IMAGE_SQL),
    "s10_zip_members": (s10_zip_members, S10_SQL),
    "f11_report_readiness": (f11_report_readiness, F11_SQL),
    "s6_csv_scan": (s6_csv_scan, f"select cast(frame_id as int) as frame_id, cast(person_count as bigint) as person_count from ({SERIAL})"),
    "s12_ppm_pixels": (s12_ppm_pixels, S12_SQL),
    "a3_metrics_by_rank": (a3_metrics_by_rank, A3_SQL), "k3_rank_table": (k3_rank_table, K3_SQL), "a4_run_summary": (a4_run_summary, A4_SQL), "a11_host_rollup": (a11_host_rollup, HOST_SQL),
    "a12_rank_summary": (a12_rank_summary, A12_SQL), "j10_host_distribution": (j10_host_distribution, J10_SQL), "j12_host_change": (j12_host_change, J12_SQL), "j2_count_comparison": (j2_count_comparison, J2_SQL),
    "a6_correctness": (a6_correctness, A6_SQL), "k5_correctness_text": (k5_correctness_text, K5_SQL), "j3_truth_comparison": (j3_truth_comparison, J3_SQL), "a7_accuracy": (a7_accuracy, A7_SQL), "a8_truth_counts": (a8_truth_counts, A8_SQL),
    "a13_speedup": (a13_speedup, A13_SQL), "a15_repeats": (a15_repeats, A15_SQL), "f13_find_frames": (f13_find_frames, F13_SQL), "j9_scheduler_comparison": (j9_scheduler_comparison, J9_SQL), "a14_mode_speedup": (a14_mode_speedup, A14_SQL),
    "a16_layer_breakdown": (a16_layer_breakdown, A16_SQL), "a17_layer_wall_times": (a17_layer_wall_times, A17_SQL), "a18_rank_times": (a18_rank_times, A18_SQL), "a27_halo_share": (a27_halo_share, A27_SQL), "w6_displacements": (w6_displacements, W6_SQL),
    "f10_readiness": (f10_readiness, F10_SQL), "f12_gate": (f12_gate, F12_SQL), "s15_host_slots": (s15_host_slots, _slots_sql()), "a25_slot_totals": (a25_slot_totals, f"select count(*) as hosts, cast(coalesce(sum(slots), 0) as bigint) as slots from ({_slots_sql()})"),
    "d3_placement": (d3_placement, D3_SQL), "a19_topology": (a19_topology, A19_SQL), "k8_mesh_lines": (k8_mesh_lines, K8_SQL), "s16_manifest": (s16_manifest, S16_SQL), "s7_counts_fallback": (s7_counts_fallback, S7_SQL),
    "s11_image_list": (s11_image_list, S11_SQL), "p13_formatted": (p13_formatted, P13_SQL), "p16_grids": (p16_grids, P16_SQL), "k10_markdown": (k10_markdown, K10_SQL), "k13_first_frames": (k13_first_frames, K13_SQL), "s17_keyed_files": (s17_keyed_files, S17_SQL),
}
