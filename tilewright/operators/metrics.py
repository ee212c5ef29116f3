"""Metrics of runs: by rank, by host, load balance, accuracy, correctness, speedup, repeats, readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.config import DetectionConfig

MEASURES = ("compute_ms", "io_ms", "yolo_ms", "comm_ms")


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def by_rank(rows: DataFrame) -> DataFrame:
    """Metric rows summed per rank; the host is the least that isn't empty."""
    return rows.groupBy("rank").agg(
        F.coalesce(F.min(F.when(F.col("hostname") != "", F.col("hostname"))), F.lit("")).alias("hostname"),
        *[F.sum(c).alias(c) for c in ("tasks_done", "frames_done", *MEASURES)])


def with_idle(ranks: DataFrame) -> DataFrame:
    """idle_ms is what the slowest of all ranks computes longer. The maximum is one row, joined, not a window over all rows."""
    top = ranks.agg(F.max("compute_ms").alias("top"))
    return ranks.join(F.broadcast(top)).withColumn("idle_ms", F.greatest(F.lit(0.0), F.col("top") - F.col("compute_ms"))).drop("top")


def load_imbalance() -> Column:
    """Largest over mean compute of the ranks with tasks."""
    active = F.when(F.col("tasks_done") > 0, F.col("compute_ms"))
    return F.coalesce(share(F.max(active), F.avg(active)), F.lit(0.0))


def run_summary(ranks: DataFrame) -> DataFrame:
    """One row of totals; without communication means the slowest rank's compute."""
    return with_idle(ranks).agg(
        F.max("compute_ms").alias("total_ms_without_comm"), F.max("compute_ms").alias("compute_ms_max"), F.avg("compute_ms").alias("compute_ms_avg"),
        *[F.sum(c).alias(f"{c}_total") for c in ("comm_ms", "io_ms", "yolo_ms", "idle_ms")], load_imbalance().alias("load_imbalance"))


def summary_row(cfg: DetectionConfig, ranks: DataFrame, counts: DataFrame, *, run_id: str, model: str = "", device: str = "cpu", image_size: int = 640, total_ms: Column | None = None, verdict: str = "") -> DataFrame:
    """K4, A4: the one-row summary of a run with its settings.

    ``counts`` has a row per frame with people (person_count); frames without any count as 0 in avg_count. ``total_ms``
    is an aggregate over the ranks; without it, the slowest rank's compute with its communication. verdict is
    empty for a run that was not checked.
    """
    total = F.max(F.col("compute_ms") + F.col("comm_ms")) if total_ms is None else total_ms
    parts = ranks.agg(F.count("*").cast("int").alias("world_size"), total.alias("total_ms_with_comm"))
    people = counts.agg((F.coalesce(F.sum("person_count"), F.lit(0)) / max(1, cfg.frames)).alias("avg_count"))
    tiles = cfg.grid[0] * cfg.grid[1]
    settings = {
        "run_id": run_id, "language": "PySpark", "detector": cfg.detector, "model": model, "device": device, "imgsz": image_size, "frames": cfg.frames, "tile_grid": cfg.tile_grid, "num_tasks": cfg.frames * tiles, "overlap": cfg.overlap,
        "tile_owner_filter": int(cfg.tile_owner_filter), "dedup_ios": cfg.duplicate_ios, "dedup_center": cfg.duplicate_center, "dedup_axis_overlap": cfg.duplicate_axis_overlap, "dedup_gap": cfg.duplicate_gap,
        "dedup_near_camera": int(cfg.duplicate_near_camera), "dedup_large_area_ratio": cfg.duplicate_large_area_ratio, "dedup_merge": int(cfg.duplicate_merge), "schedule": cfg.schedule, "chunk_size": cfg.chunk_size,
        "master_compute": int(cfg.master_compute), "video_width": cfg.width, "video_height": cfg.height}
    row = run_summary(ranks).join(F.broadcast(parts)).join(F.broadcast(people))
    order = [*list(settings)[:21], "world_size", "video_width", "video_height", "total_ms_with_comm", "total_ms_without_comm", "compute_ms_max", "compute_ms_avg", "comm_ms_total", "io_ms_total", "yolo_ms_total", "idle_ms_total", "load_imbalance", "avg_count"]
    return row.select(*[F.lit(settings[c]).alias(c) if c in settings else F.col(c) for c in order], F.lit(verdict).alias("correctness_pass"))


def host_rollup(ranks: DataFrame, label: str) -> DataFrame:
    """Sums per host in seconds, and the host's share of all tasks."""
    hosts = with_idle(ranks).groupBy("hostname").agg(F.count("*").alias("rank_count"), *[F.sum(c).alias(c) for c in ("tasks_done", "frames_done", "compute_ms", "comm_ms", "idle_ms", "yolo_ms")])
    total = hosts.agg(F.sum("tasks_done").alias("all_tasks"))
    return hosts.join(F.broadcast(total)).select(
        F.lit(label).alias("label"), "hostname", "rank_count", "tasks_done", share(F.col("tasks_done"), F.col("all_tasks")).alias("task_share"), "frames_done",
        *[(F.col(f"{c}_ms") / 1000).alias(f"{c}_s") for c in ("compute", "comm", "idle", "yolo")])


def rank_summary(ranks: DataFrame, label: str, limit: float = 0.25) -> DataFrame:
    """Extremes over ranks with tasks, totals over all; balanced if the idle gap is at most ``limit``."""
    active = F.col("tasks_done") > 0
    rows = with_idle(ranks).agg(
        F.count("*").alias("rank_count"), F.sum("tasks_done").alias("total_tasks"), *[F.coalesce(f(F.when(active, F.col("compute_ms") / 1000)), F.lit(0.0)).alias(f"compute_s_{n}") for n, f in (("max", F.max), ("min", F.min), ("avg", F.avg))],
        (F.sum("comm_ms") / 1000).alias("comm_s_total"), (F.sum("idle_ms") / 1000).alias("idle_s_total"),
        F.coalesce((F.max(F.when(active, F.col("idle_ms"))) - F.min(F.when(active, F.col("idle_ms")))) / 1000, F.lit(0.0)).alias("gap"))
    ratio = share(F.col("gap"), F.col("compute_s_max"))
    return rows.select(F.lit(label).alias("label"), *[c for c in rows.columns if c != "gap"], ratio.alias("idle_gap_ratio"), F.when(ratio <= limit, "YES").otherwise("NO").alias("load_balance_pass"))


def host_distribution(hosts: DataFrame) -> DataFrame:
    """(label, host_task_distribution) text from host roll-ups."""
    one = F.format_string("%s ranks=%d tasks=%d share=%.3f", "hostname", "rank_count", "tasks_done", "task_share")
    return hosts.groupBy("label").agg(F.concat_ws("; ", F.transform(F.array_sort(F.collect_list(F.struct("hostname", one.alias("text")))), lambda x: x["text"])).alias("host_task_distribution"))


def compared_counts(serial: DataFrame, parallel: DataFrame) -> DataFrame:
    """All frames of either side; a frame on one side only has error 1."""
    rows = serial.select("frame_id", F.col("person_count").alias("serial_count")).join(parallel.select("frame_id", F.col("person_count").alias("mpi_count")), "frame_id", "full_outer")
    error = F.when(F.col("serial_count").isNull() | F.col("mpi_count").isNull(), F.lit(1)).otherwise(F.col("mpi_count") - F.col("serial_count")).cast("bigint")
    return rows.withColumn("error", error).withColumn("abs_error", F.abs("error")).withColumn("match", F.when(F.col("error") == 0, "YES").otherwise("NO"))


def correctness(compared: DataFrame) -> DataFrame:
    """Frames, mismatches, largest and mean error, and whether all match."""
    return compared.agg(
        F.when(F.coalesce(F.max("abs_error"), F.lit(0)) == 0, "YES").otherwise("NO").alias("correctness_pass"), F.count("*").alias("frames_compared"),
        F.count_if(F.col("error") != 0).alias("mismatched_frames"), F.coalesce(F.max("abs_error"), F.lit(0)).alias("max_abs_error"), F.round(F.coalesce(F.avg("abs_error"), F.lit(0.0)), 6).alias("mean_abs_error"))


def against_truth(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Frames of both sides with errors; no percentage where the truth is 0."""
    rows = truth.select("frame_id", "gt_count").join(predicted.select("frame_id", F.col("person_count").alias("pred_count")), "frame_id")
    rows = rows.withColumn("error", F.col("pred_count") - F.col("gt_count")).withColumn("abs_error", F.abs("error")).withColumn("squared_error", F.col("error") * F.col("error"))
    return rows.withColumn("absolute_percentage_error", F.when(F.col("gt_count") != 0, F.round(F.col("abs_error") / F.col("gt_count"), 6)))


def accuracy(errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, MAPE, share of exact frames, mean counts; six decimals; of each group of ``by``, as of the sequences of a suite."""
    def six(c: Column) -> Column:
        return F.round(F.coalesce(c, F.lit(0.0)), 6)
    return errors.groupBy(*by).agg(F.count("*").alias("frames_compared"), six(F.avg("abs_error")).alias("mae"), six(F.sqrt(F.avg("squared_error"))).alias("rmse"), six(F.avg(F.when(F.col("gt_count") != 0, F.col("abs_error") / F.col("gt_count")))).alias("mean_abs_percentage_error"),
                      six(F.avg((F.col("error") == 0).cast("int"))).alias("exact_match_rate"), six(F.avg("gt_count")).alias("mean_gt_count"), six(F.avg("pred_count")).alias("mean_pred_count"))


def truth_counts(spine: DataFrame, boxes: DataFrame, visibility: float) -> DataFrame:
    """Visible people (class 1) per frame of the spine (mot_frame), 0 without any."""
    kept = boxes.where((F.col("conf") > 0) & (F.col("class_id") == 1) & (F.col("visibility") >= visibility)).groupBy("mot_frame").agg(F.count("*").alias("n"))
    return spine.join(kept, "mot_frame", "left").select("mot_frame", (F.col("mot_frame") - 1).alias("frame_id"), F.coalesce("n", F.lit(0)).alias("person_count"))


def speedup(runs: DataFrame, by: list[str]) -> DataFrame:
    """Speedup and efficiency against the first run (run_seq) of each group."""
    first = Window.partitionBy(*by).orderBy("run_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = runs
    for c in ("with_comm", "without_comm"):
        out = out.withColumn(f"speedup_{c}", share(F.first(f"total_ms_{c}").over(first), F.col(f"total_ms_{c}"))).withColumn(f"efficiency_{c}", share(F.col(f"speedup_{c}"), F.col("world_size")))
    return out


def speedup_by_mode(runs: DataFrame, by: str = "halo_mode") -> DataFrame:
    """Speedup against the run with p = 1 of each mode; 0 without one."""
    base = runs.groupBy(by).agg(F.max(F.when(F.col("p") == 1, F.col("distributed_ms"))).alias("base"))
    gain = F.coalesce(share(F.col("base"), F.col("distributed_ms")), F.lit(0.0))
    return runs.join(base, by).withColumn("speedup", gain).withColumn("efficiency", share(gain, F.col("p"))).drop("base")


def sweep_overview(ranks: DataFrame, limit: float = 0.25) -> DataFrame:
    """One row per tile_grid and world_size from the rank rows of all runs of a sweep.

    Balance as in ``rank_summary``, over each run's own ranks; speedup and efficiency against the smallest run of
    the same grid, with communication (the slowest rank's compute and communication) and without.
    """
    run, active = ["tile_grid", "world_size"], F.col("tasks_done") > 0
    most = ranks.groupBy(*run).agg(F.max("compute_ms").alias("run_max"))
    rows = ranks.join(most, run).withColumn("idle_ms", F.greatest(F.lit(0.0), F.col("run_max") - F.col("compute_ms")))
    runs = rows.groupBy(*run).agg(
        F.sum("tasks_done").alias("total_tasks"), *[F.coalesce(f(F.when(active, F.col("compute_ms") / 1000)), F.lit(0.0)).alias(f"compute_s_{n}") for n, f in (("max", F.max), ("min", F.min), ("avg", F.avg))],
        (F.sum("comm_ms") / 1000).alias("comm_s_total"), (F.sum("idle_ms") / 1000).alias("idle_s_total"), F.max(F.col("compute_ms") + F.col("comm_ms")).alias("total_ms_with_comm"), F.max("compute_ms").alias("total_ms_without_comm"),
        F.coalesce((F.max(F.when(active, F.col("idle_ms"))) - F.min(F.when(active, F.col("idle_ms")))) / 1000, F.lit(0.0)).alias("gap"))
    ratio = share(F.col("gap"), F.col("compute_s_max"))
    runs = runs.select(*[c for c in runs.columns if c != "gap"], ratio.alias("idle_gap_ratio"), F.when(ratio <= limit, "YES").otherwise("NO").alias("load_balance_pass"))
    return speedup(runs.withColumn("run_seq", F.col("world_size")), ["tile_grid"]).drop("run_seq")


def repeats(runs: DataFrame) -> DataFrame:
    """Repeated runs per label and size; one run has a deviation of 0."""
    return runs.groupBy("label", "world_size").agg(
        F.count("*").alias("repeats"), F.avg("total_ms_with_comm").alias("mean_total_ms_with_comm"), F.coalesce(F.stddev_samp("total_ms_with_comm"), F.lit(0.0)).alias("stdev_total_ms_with_comm"),
        F.avg("speedup_with_comm").alias("mean_speedup_with_comm"), F.avg("efficiency_with_comm").alias("mean_efficiency_with_comm"))


def find_frames(runs: DataFrame, low_s: float = 120.0, high_s: float = 180.0) -> DataFrame:
    """the least number of frames whose run takes between two and three minutes."""
    return runs.where((F.col("total_ms_with_comm") / 1000).between(low_s, high_s)).agg(F.min("frames").alias("frames"))


def readiness(summary: DataFrame, ranks: DataFrame, boxes: DataFrame, hosts: DataFrame, required: list[str]) -> DataFrame:
    """(status, check, detail) rows of the readiness rules; every input is one small relation of a run."""
    def one(rows: DataFrame, check: str, good: Column, detail: Column, bad: str = "FAIL") -> DataFrame:
        return rows.select(F.when(good, "PASS").otherwise(bad).alias("status"), F.lit(check).alias("check"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))
    run = summary.limit(1)
    active = ranks.where("tasks_done > 0").agg(F.array_sort(F.collect_set(F.col("rank").cast("string"))).alias("r"))
    names = F.coalesce(F.nullif(F.concat_ws(",", "r"), F.lit("")), F.lit("none"))
    out = one(run, "parallel language", F.col("language") == "spark", F.col("language")).unionByName(one(run, "detector", F.col("detector") == "worker", F.col("detector"), "WARN"))
    out = out.unionByName(one(run, "world_size", F.col("world_size") > 0, F.col("world_size"))).unionByName(one(run, "num_tasks", F.col("num_tasks") > 0, F.col("num_tasks")))
    out = out.unionByName(one(boxes.agg(F.count("*").alias("n")), "bboxes", F.col("n") > 0, F.concat(F.lit("rows="), F.col("n").cast("string")), "WARN"))
    out = out.unionByName(one(active, "active ranks", F.size("r") > 0, names)).unionByName(one(active, "master rank compute", F.array_contains("r", "0"), names))
    out = out.unionByName(one(hosts.agg(F.count("*").alias("n"), F.sum("slots").alias("s")), "host slots", F.coalesce(F.col("s"), F.lit(0)) > 0, F.coalesce(F.col("s"), F.lit(0))))
    wanted = hosts.sparkSession.createDataFrame([(x,) for x in required], "host string")
    have = wanted.join(hosts.select("host", F.lit(True).alias("there")).distinct(), "host", "left")
    return out.unionByName(have.select(F.when(F.col("there"), "PASS").otherwise("FAIL").alias("status"), F.concat(F.lit("required host "), F.col("host")).alias("check"), F.lit("").alias("detail")))


def placement_overview(cfg: DetectionConfig, runs: dict[str, DataFrame], counts: DataFrame) -> DataFrame:
    """A row per placement (label -> ranks): sizes, times, balance and what each host has done."""
    rows = []
    for label, ranks in runs.items():
        row = summary_row(cfg, ranks, counts, run_id=label).select(F.col("run_id").alias("label"), "world_size", "frames", "tile_grid", "total_ms_with_comm", "total_ms_without_comm", "load_imbalance")
        rows.append(row.join(host_distribution(host_rollup(ranks, label)), "label"))
    return reduce(DataFrame.unionByName, rows)


def report_readiness(reports: DataFrame, phrases: list[str], placeholder: str, *, figures: int = 5, tables: int = 8, pages: tuple[int, int] = (10, 20)) -> DataFrame:
    """(report, failures, ready) from (report, text, html, pdf): what each report still lacks, in order of the rules.

    Placeholders by a pattern, phrases that must be there, figures and tables by number, and the page count,
    the largest /Count of the PDF or else its /Page entries. A missing part fails by its name.
    """
    count = lambda c, pattern: F.size(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0)))
    counts = F.transform(F.regexp_extract_all(F.decode("pdf", "ISO-8859-1"), F.lit(r"/Count\s+(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    leaves = F.size(F.regexp_extract_all(F.decode("pdf", "ISO-8859-1"), F.lit(r"/Type\s*/Page\b"), F.lit(0)))
    n_pages = F.coalesce(F.array_max(counts), leaves)
    rules = [
        *[(F.col(c).isNull() | (F.length(c) == 0), F.lit(f"missing {c}")) for c in ("text", "html", "pdf")],
        (count("text", placeholder) > 0, F.lit("placeholders in text")), *[(~F.contains(F.col("text"), F.lit(x)), F.lit(f"missing phrase: {x}")) for x in phrases],
        (count("text", r"!\[[^\]]*\]\([^)]+\)") < figures, F.concat(F.lit("figures in text: "), count("text", r"!\[[^\]]*\]\([^)]+\)").cast("string"))),
        (count("html", placeholder) > 0, F.lit("placeholders in html")), (count("html", "data:image/") < figures, F.lit("figures in html")), (count("html", "<table>") < tables, F.lit("tables in html")),
        (~n_pages.between(*pages), F.concat(F.lit("pages: "), n_pages.cast("string")))]
    failures = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), said) for bad, said in rules]), lambda x: x.isNotNull())
    return reports.select("report", failures.alias("failures")).withColumn("ready", F.when(F.size("failures") == 0, "YES").otherwise("NO"))


def gate(table: DataFrame, limit: float = 1e-3) -> DataFrame:
    """Whether every row is correct and no error exceeds the limit, from (correct, max_abs_error) texts."""
    worst = F.coalesce(F.max(F.col("max_abs_error").try_cast("double")), F.lit(0.0))
    return table.agg(F.concat_ws(",", F.array_sort(F.collect_set("correct"))).alias("correct_values"), worst.alias("max_error"),
                     F.when(F.coalesce(F.bool_and(F.col("correct") == "YES"), F.lit(False)) & (worst <= limit), "PASS").otherwise("FAIL").alias("status"))
