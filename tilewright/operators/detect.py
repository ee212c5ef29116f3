"""Detectors as table functions: mock (X1), command (X2), loaded worker (X3); chosen by name (X4), with a cost column."""

from __future__ import annotations

import re
import shlex
import subprocess
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.config import DetectionConfig

#: Command lines that one shell runs.
LINES = 512
BOXES = "task_id bigint, frame_id int, tile_id int, x1 double, y1 double, x2 double, y2 double, conf double, cls int"


def mock(cfg: DetectionConfig, work: DataFrame) -> DataFrame:
    """One to three boxes per tile by a fixed formula, in frame coordinates."""
    n = 1 + (F.col("frame_id") + F.col("tile_id")) % 3
    rows = work.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    cx = F.col("x1") + (0.22 + 0.22 * F.col("i") + 0.03 * (F.col("frame_id") % 5)) * F.col("w")
    cy = F.col("y1") + (0.28 + 0.17 * F.col("i") + 0.02 * (F.col("tile_id") % 4)) * F.col("h")
    bw, bh = F.greatest(F.lit(24.0), 0.12 * F.col("w")), F.greatest(F.lit(48.0), 0.24 * F.col("h"))
    return rows.select("task_id", "frame_id", "tile_id", F.greatest(F.lit(0.0), cx - bw / 2).alias("x1"), F.greatest(F.lit(0.0), cy - bh / 2).alias("y1"),
                       (cx + bw / 2).alias("x2"), (cy + bh / 2).alias("y2"), (0.92 - 0.03 * F.col("i")).cast("double").alias("conf"), F.lit(0).alias("cls"))


def _dealt(work: DataFrame) -> DataFrame:
    """As many tasks as a shuffle has: a row is small for the time that it takes, so adaptive execution would put all of them into one."""
    return work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task_id")


def _local_boxes(text: str) -> list[tuple[float, ...]]:
    """Five numbers a line; comments and malformed lines are skipped."""
    out = []
    for line in text.splitlines():
        fields = line.split(",")
        if line.startswith("#") or len(fields) != 5:
            continue
        try:
            out.append(tuple(map(float, fields)))
        except ValueError:
            continue
    return out


def _printed(lines: list[str]) -> Iterator[str | None]:
    """What each command line prints; None for one that fails.

    Every line is run by a fork of one shell, which costs far less than a new one; a line that ends that shell itself is run again, alone, and another shell goes on behind it.
    """
    mark, at = uuid.uuid4().hex, 0
    while at < len(lines):
        some = lines[at:at + LINES]
        script = "".join(f"o=$(eval {shlex.quote(line)} 2>/dev/null </dev/null); r=$?\nprintf '%s\\n{mark} %s\\n' \"$o\" $r\n" for line in some)
        done = subprocess.run(["/bin/sh"], input=script, capture_output=True, text=True)
        found = re.split(rf"\n{mark} (\d+)\n", done.stdout)
        yield from (text if code == "0" else None for text, code in zip(found[:-1:2], found[1::2]))
        at += len(found) // 2
        if len(found) // 2 < len(some):
            alone = subprocess.run(lines[at], shell=True, capture_output=True, text=True)  # noqa: S602  the command is the user's own setting
            yield alone.stdout if alone.returncode == 0 else None
            at += 1


def command(cfg: DetectionConfig, work: DataFrame) -> DataFrame:
    """An outside program per task; its template takes {frame_id}, {tile_id}, {x1}, {y1}, {x2}, {y2}. A failing program gives no boxes."""
    names = ("frame_id", "tile_id", "x1", "y1", "x2", "y2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            work, lines, rows = list(batch.itertuples(index=False)), [], []
            for t in work:
                line = cfg.detector_command
                for name in names:
                    line = line.replace("{" + name + "}", str(getattr(t, name)))
                lines.append(line)
            for t, text in zip(work, _printed(lines)):
                rows += [(t.task_id, t.frame_id, t.tile_id, t.x1 + a, t.y1 + b, t.x1 + c, t.y1 + d, s, 0) for a, b, c, d, s in _local_boxes(text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BOXES.split(", ")])

    return _dealt(work).mapInPandas(run, BOXES)


def worker(cfg: DetectionConfig, work: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """``load`` builds a model once per task of Spark; the model maps a batch of tasks to BOXES in tile coordinates. F6: class 0 and conf apply."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            found = model(batch)
            origin = batch.set_index("task_id")
            for lo, hi, at in (("x1", "x2", "x1"), ("y1", "y2", "y1")):
                shift = found["task_id"].map(origin[at])
                found = found.assign(**{lo: found[lo] + shift, hi: found[hi] + shift})
            yield found[(found["cls"] == 0) & (found["conf"] >= cfg.conf)]

    return _dealt(work).mapInPandas(run, BOXES)


def detect(cfg: DetectionConfig, work: DataFrame, load: Callable | None = None) -> DataFrame:
    """Boxes of every task by the detector that ``cfg`` names."""
    if cfg.detector == "mock":
        return mock(cfg, work)
    return command(cfg, work) if cfg.detector == "command" else worker(cfg, work, load)


def with_cost(cfg: DetectionConfig, work: DataFrame) -> DataFrame:
    """What a task is said to take, in ms; 0 if sleep_ms is."""
    cost = cfg.sleep_ms + (F.col("frame_id") + F.col("tile_id")) % 5 if cfg.sleep_ms > 0 else F.lit(0)
    return work.withColumn("cost_ms", cost.cast("bigint"))
