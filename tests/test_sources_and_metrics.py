"""Readers, metrics and tensors on small inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tilewright.config import ConvConfig, DetectionConfig, truth
from tilewright.functions import text
from tilewright.operators import layers, metrics, tensor, topology
from tilewright.sinks import tables
from tilewright.sources import files, tasks


def lines(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "seq int, value string")


def test_grid_texts(spark):
    rows = spark.createDataFrame([("4x3",), ("5X4",)], "g string")
    assert [tuple(r) for r in rows.select(*tasks.parse_grid(F.col("g"))).collect()] == [(4, 3), (5, 4)]
    for bad in ("0x3", "4", "x", "4x3x2"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "g string").select(*tasks.parse_grid(F.col("g"))).collect()


def test_halves_of_tile_bounds(spark):
    cfg = DetectionConfig(tile_grid="2x1", width=5, height=4, overlap=0, frames=1)
    one = spark.range(2).select(*tasks.tile_bounds(cfg, F.col("id"))).collect()
    even = spark.range(2).select(*tasks.tile_bounds(cfg, F.col("id"), half_even=True)).collect()
    assert (one[0].x2, one[1].x1, even[0].x2, even[1].x1) == (3, 3, 2, 2)


def test_payload_lines(spark):
    det, met = files.payload(lines(spark, "DET,1,2,0,1.5,2,3,4,0.5,0", "MET,0,h,1,1,5,0,4,1,0", "x", "DET,1"))
    assert det.first().x1 == 1.5 and det.count() == 1 and met.first().hostname == "h"


def test_camera_lines(spark):
    frame, tile = files.camera_lines(lines(spark, "READY", "FRAME 3 640 480 1.5 YWI=", "TILE 7 3 0 0 0 10 10 YWI=", "END_FRAME 3 1", "END_STREAM"))
    assert frame.first().image == b"ab" and tile.first().task_id == 7
    with pytest.raises(PySparkException):
        files.camera_lines(lines(spark, "ERROR lost"))[0].count() or files.camera_lines(lines(spark, "ERROR lost"))[0].collect()


def test_missing_csv_is_an_empty_table(spark, tmp_path):
    assert files.read_csv(spark, str(tmp_path / "none.csv"), "a int, b string").count() == 0
    tables.write_csv(spark.createDataFrame([(2, 0.5), (1, 0.25)], "a int, b double"), str(tmp_path / "out"), ["a"])
    back = files.read_csv(spark, str(tmp_path / "out"), "a int, b string")
    assert [tuple(r) for r in back.collect()] == [(1, "0.2500"), (2, "0.5000")]


def test_counts_without_a_known_column(spark):
    with pytest.raises(ValueError):
        files.counts_with_fallback(spark.createDataFrame([(0, 1, 2)], "seq int, frame_id int, x int"))


def test_manifest_and_images(spark):
    got = {r.key: r.value for r in files.manifest(lines(spark, "a=1", "b=x=y", "a=2", "none")).collect()}
    assert got == {"a": "2", "b": "x=y"}
    assert [r.path for r in files.image_list(lines(spark, "a.ppm", "", "# c", "/b.ppm", "c.ppm"), 2, "/d").collect()] == ["/d/a.ppm", "/b.ppm"]


def test_ppm(spark, tmp_path):
    data = bytes(range(12))
    (tmp_path / "a.ppm").write_bytes(b"P6\n# note\n2 2\n255\n" + data)
    (tmp_path / "b.ppm").write_bytes(b"P3 2 2 255 " + " ".join(map(str, data)).encode())
    rows = files.ppm_pixels(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path", "c").collect()
    assert len(rows) == 6 and rows[0]["values"] == rows[3]["values"]
    assert np.allclose(rows[1]["values"], np.array([1, 4, 7, 10]) / 255)
    for bad in (b"P6 2 2 255 " + data[:5], b"P5 2 2 255 " + data, b"P6 2 2 100 " + data, b"P6 2"):
        with pytest.raises(ValueError):
            files.decode_ppm(bad)


def test_published_speedups_come_out(spark):
    runs = [(1, 345.677), (2, 276.155), (4, 244.747), (8, 200.770), (12, 178.306)]
    rows = spark.createDataFrame([("a", i, p, t, t) for i, (p, t) in enumerate(runs)], "label string, run_seq int, world_size int, total_ms_with_comm double, total_ms_without_comm double")
    got = [round(r.speedup_with_comm, 3) for r in metrics.speedup(rows, ["label"]).orderBy("run_seq").collect()]
    assert got == [1.0, 1.252, 1.412, 1.722, 1.939]


def test_one_repeat_has_no_deviation(spark):
    rows = spark.createDataFrame([("a", 1, 5.0, 1.0, 1.0)], "label string, world_size int, total_ms_with_comm double, speedup_with_comm double, efficiency_with_comm double")
    assert metrics.repeats(rows).first().stdev_total_ms_with_comm == 0.0


def test_counts_of_one_side_only(spark):
    a = spark.createDataFrame([(0, 5), (1, 2)], "frame_id int, person_count long")
    b = spark.createDataFrame([(0, 5), (2, 9)], "frame_id int, person_count long")
    out = metrics.correctness(metrics.compared_counts(a, b)).first()
    assert (out.correctness_pass, out.frames_compared, out.mismatched_frames, out.max_abs_error) == ("NO", 3, 2, 1)
    empty = metrics.correctness(metrics.compared_counts(a.limit(0), b.limit(0))).first()
    assert (empty.correctness_pass, empty.frames_compared) == ("YES", 0)


def test_percentages_leave_out_zero_truth(spark):
    gt = spark.createDataFrame([(0, 0), (1, 4)], "frame_id int, gt_count long")
    pred = spark.createDataFrame([(0, 3), (1, 3)], "frame_id int, person_count long")
    assert metrics.accuracy(metrics.against_truth(pred, gt)).first().mean_abs_percentage_error == 0.25
    assert metrics.accuracy(metrics.against_truth(pred, gt.where("gt_count = 0"))).first().mean_abs_percentage_error == 0.0


def test_topology_golden(spark):
    hosts = spark.createDataFrame([(0, "master.local", 4), (1, "node1", 6), (2, "node2", 2)], "seq int, host string, slots int")
    cells = topology.mesh(tasks.placed_ranks(hosts), 4)
    out = topology.edge_counts(topology.edges(cells)).first()
    assert tuple(out) == (29, 13, 16, 0.551724, 17, 12)
    assert topology.ascii_grid(cells).orderBy("r").first().line.startswith("0@master | 1@master")


def test_splits_and_grids(spark):
    rows = spark.range(4).select(text.split_start(F.lit(10), F.lit(4), F.col("id")), text.split_end(F.lit(10), F.lit(4), F.col("id"))).collect()
    assert [tuple(r) for r in rows] == [(0, 3), (3, 6), (6, 8), (8, 10)]
    grids = spark.createDataFrame([(1,), (2,), (7,), (12,)], "p int").select(text.most_square_rows(F.col("p")).alias("r")).collect()
    assert [r.r for r in grids] == [1, 1, 1, 3]


def test_flags_and_settings():
    assert [truth(x) for x in ("1", "true", "TRUE", "yes", "True", "0", "")] == [True] * 4 + [False] * 3
    for bad in ({"height": 0}, {"halo_mode": "x"}, {"profile": "x"}):
        with pytest.raises(ValueError):
            ConvConfig(**bad)


def numpy_stack(x, depth, profile):
    for layer, outputs, pool in tensor.layers(profile)[:depth]:
        c, h, w = x.shape
        i = np.arange(outputs * c * 9)
        k = (0.035 * np.sin(0.007 * (i + 101 * layer))).reshape(outputs, c, 3, 3)
        b = 0.01 * np.cos(0.11 * (layer - 1 + np.arange(outputs)))
        p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
        y = sum(np.einsum("oi,ihw->ohw", k[:, :, a, e], p[:, a:a + h, e:e + w]) for a in range(3) for e in range(3)) + b[:, None, None]
        x = np.maximum(0, y)
        if pool and h >= 2 and w >= 2:
            x = x[:, :h // 2 * 2, :w // 2 * 2].reshape(outputs, h // 2, 2, w // 2, 2).max(axis=(2, 4))
    return x


@pytest.mark.parametrize(("side", "grid"), [((9, 7), None), ((9, 7), (2, 3)), ((3, 3), (3, 1))])
def test_stack_equals_numpy(spark, side, grid):
    h, w = side
    c, y, x = np.meshgrid(np.arange(3), np.arange(h), np.arange(w), indexing="ij")
    want = numpy_stack(np.sin(0.013 * ((c + 1) * 17 + 3 * y + x)), 3, "tiny")
    out = tensor.stack(spark, tensor.synthetic_map(spark, 3, h, w), 3, h, w, "tiny", depth=3, grid=grid, save=lambda d: d.cache())
    got = np.full(want.shape, np.nan)
    for r in out.collect():
        got[r.c, r.y, r.x] = r.v
    assert np.allclose(got, want, atol=1e-9)


def test_tensor_shapes_must_agree(spark):
    a = tensor.synthetic_map(spark, 1, 2, 2)
    assert tensor.tensor_error(a, a).first().correct == "YES"
    with pytest.raises(PySparkException):
        tensor.tensor_error(a, a.where("x = 0")).collect()


def test_layer_times(spark):
    rows = spark.createDataFrame([(0, 1, 0, 1.0, 2.0, 3.0, 4.0), (0, 1, 1, 5.0, 1.0, 9.0, 1.0), (1, 1, 0, 2.0, 2.0, 2.0, 2.0)], "repeat_no int, layer_id int, rank int, scatter_ms double, halo_ms double, compute_ms double, gather_ms double")
    assert layers.wall_times(layers.last_repeat(rows)).first().compute_ms == 2.0
    out = {r.rank: (r.total_ms, r.idle_ms) for r in layers.rank_times(rows).collect()}
    assert out == {0: (18.0, 4.0), 1: (16.0, 0.0)}


def test_first_frames_must_suffice(spark):
    part = spark.createDataFrame([(0,), (1,)], "seq int")
    assert [(r.part, r.seq) for r in tables.first_frames([part, part], 3).orderBy("part", "seq").collect()] == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(PySparkException):
        tables.first_frames([part], 3).collect()


def test_grids_of_large_counts_try_few_rows(spark):
    counts = [1, 2, 3, 4, 12, 97, 99, 100, 10_000_019, 10_000 * 10_000, 99_990_001, 2 * 49_999_991]
    rows = spark.createDataFrame([(p,) for p in counts * 20], "p bigint").select("p", text.most_square_rows(F.col("p")).alias("rows")).distinct()
    expected = {p: max(d for d in range(1, int(p**0.5) + 1) if p % d == 0) for p in counts}
    assert dict(map(tuple, rows.collect())) == expected
