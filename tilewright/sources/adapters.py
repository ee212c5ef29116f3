"""Relations of the detection and convolution dataflows, derived from the star-schema tables in exact arithmetic.

Each text is plain SQL that any engine runs; ``relation`` runs it on DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DET = """
select cast(floor(event_id/25) as int) as frame_id,
 cast(case when event_id % 4 = 0 then greatest(0, floor(cx*4/1280)+4*floor(cy*3/720)-1) else floor(cx*4/1280)+4*floor(cy*3/720) end as int) as tile_id,
 cast(event_id as int) as det_id, cast(user_id % 3 as int) as rank,
 cast(cx as double)-cast(w as double)/2 as x1, cast(cy as double)-cast(h as double)/2 as y1,
 cast(cx as double)+cast(w as double)/2 as x2, cast(cy as double)+cast(h as double)/2 as y2,
 cast(35+(event_id*29)%60 as double)/100 as conf, cast(0 as int) as cls
 from (select event_id, user_id, ((user_id%12)*97)%1100+60+(event_id*7)%31-15 as cx, ((user_id%12)*61)%600+60+(event_id*13)%23-11 as cy,
  60+(event_id*11)%50 as w, 120+(event_id*17)%90 as h from {events}) q
"""
GT = "select frame_id, cast(count(*) as bigint) as gt_count from (select distinct cast(floor(event_id/25) as int) as frame_id, user_id%12 as obj from {events} where event_type <> 'error') q group by frame_id"
COUNT_SERIAL = f"select frame_id, cast(count(*) as bigint) as person_count from ({DET}) d where frame_id%97<>0 group by frame_id"
COUNT_PARALLEL = f"select frame_id, cast(count(*) as bigint) as person_count from ({DET}) d where frame_id%89<>1 and not (frame_id%10=3 and det_id%25=0) group by frame_id"
RANK_METRICS = """
select cast(l.l_suppkey%12 as int) as rank, min(n.n_name) as hostname, cast(count(*) as bigint) as tasks_done,
 cast(sum(case when l.l_linenumber=1 then 1 else 0 end) as bigint) as frames_done,
 cast(sum(cast(l.l_quantity as bigint)) as double) as compute_ms, cast(0 as double) as io_ms,
 cast(sum(cast(l.l_quantity as bigint))-count(*) as double) as yolo_ms,
 cast(sum(cast(floor(l.l_tax*100+0.5) as bigint)) as double) as comm_ms
 from {lineitem} l join {supplier} s on l.l_suppkey=s.s_suppkey join {nation} n on s.s_nationkey=n.n_nationkey group by cast(l.l_suppkey%12 as int)
 union all select 12, 'coordinator', cast(0 as bigint), cast(0 as bigint), cast(0 as double), cast(0 as double), cast(0 as double), cast(7 as double)
"""
#: Metric rows before they meet by rank: one per rank and line number, and a coordinator row that counts for rank 0.
METRIC_ROWS = """
select cast(l.l_suppkey%12 as int) as rank, concat('host', cast(l.l_suppkey%3 as varchar(4))) as hostname, cast(count(*) as bigint) as tasks_done,
 cast(sum(case when l.l_linenumber=1 then 1 else 0 end) as bigint) as frames_done, cast(sum(cast(l.l_quantity as bigint)) as double) as compute_ms, cast(0 as double) as io_ms,
 cast(sum(cast(l.l_quantity as bigint))-count(*) as double) as yolo_ms, cast(sum(cast(floor(l.l_tax*100+0.5) as bigint)) as double) as comm_ms
 from {lineitem} l group by cast(l.l_suppkey%12 as int), concat('host', cast(l.l_suppkey%3 as varchar(4))), l.l_linenumber
 union all select 0, '', cast(0 as bigint), cast(0 as bigint), cast(0 as double), cast(0 as double), cast(0 as double), cast(7 as double)
"""
#: Rank rows of a sweep over three tile grids and four process counts.
GRID_RANKS = """
select case l_orderkey%3 when 0 then '1x1' when 1 then '2x2' else '4x3' end as tile_grid,
 cast(case floor(l_orderkey/3)%4 when 0 then 1 when 1 then 2 when 2 then 4 else 12 end as int) as world_size,
 cast(l_suppkey%(case floor(l_orderkey/3)%4 when 0 then 1 when 1 then 2 when 2 then 4 else 12 end) as int) as rank, cast(count(*) as bigint) as tasks_done,
 cast(sum(cast(l_quantity as bigint)) as double) as compute_ms, cast(sum(cast(floor(l_tax*100+0.5) as bigint)) as double) as comm_ms from {lineitem} group by 1, 2, 3
"""
SWEEP_RUNS = """
select case when o_custkey%2=0 then 'local_only' else 'cluster' end as label, cast(o_orderkey%5 as int) as p_idx,
 cast(case o_orderkey%5 when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 8 else 12 end as int) as world_size,
 cast(floor(o_orderkey/5)%3 as int) as repeat_no, cast(sum(cast(floor(o_totalprice) as bigint)) as double) as total_ms_with_comm,
 cast(max(cast(floor(o_totalprice) as bigint)) as double) as total_ms_without_comm from {orders} group by 1,2,3,4
"""
MOT_GT = """
select cast(l_orderkey%300+1 as int) as mot_frame, cast(l_linenumber as int) as track_id, cast(case when l_returnflag='R' then 0 else 1 end as double) as conf,
 cast(1+l_partkey%3 as int) as class_id, cast(l_suppkey%100 as double)/100 as visibility from {lineitem}
"""
HOST_LINES = """
select s_suppkey as line_no, case when s_suppkey%7=0 then '# comment' when s_suppkey%5=0 then s_name when s_suppkey%11=0 then '' else concat(s_name, ' slots=', cast(1+s_suppkey%8 as varchar(10))) end as line from {supplier}
"""
#: Layer times of convolution runs: halo mode x processes x layer, and one row per run.
LAYER_RUNS = """
select case when o_orderkey%2=0 then 'blocking' else 'nonblocking' end as halo_mode,
 cast(case floor(o_orderkey/2)%4 when 0 then 1 when 1 then 2 when 2 then 4 else 12 end as int) as p, cast(floor(o_orderkey/8)%8 as int) as layer_id,
 cast(sum(cast(floor(o_totalprice) as bigint)%1000) as double) as compute_ms, cast(sum(cast(floor(o_totalprice) as bigint)%97) as double) as halo_ms,
 cast(sum(cast(floor(o_totalprice) as bigint)%31) as double) as scatter_ms, cast(sum(cast(floor(o_totalprice) as bigint)%29) as double) as gather_ms
 from {orders} group by 1, 2, 3
"""
FEATURE_MAP_SPARK = """
select cast(vec_id as int) as img, cast(0 as int) as c, cast(floor(pos/8) as int) as y, cast(pos%8 as int) as x, round(cast(v as double)*100,0) as v
 from {embeddings} lateral view posexplode(embedding) t as pos, v
"""
FEATURE_MAP_ANSI = """
select cast(vec_id as int) as img, cast(0 as int) as c, cast(floor(pos/8) as int) as y, cast(pos%8 as int) as x, round(cast(v as double)*100,0) as v
 from (select vec_id, unnest(embedding) as v, unnest(range(len(embedding))) as pos from embeddings)
"""
TABLES = ("events", "lineitem", "supplier", "nation", "orders", "embeddings")


def relation(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the Parquet tables in ``sf_dir``."""
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text})


def ansi(text: str) -> str:
    """``text`` with plain table names."""
    return text.format(**{t: t for t in TABLES})
