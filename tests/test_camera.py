"""Live sources on small inputs."""

from __future__ import annotations

from tilewright.config import DetectionConfig
from tilewright.sources import camera
from tilewright.streaming import live


def test_frames_are_tiled_in_streams_and_tables(spark):
    cfg = DetectionConfig(tile_grid="2x1", width=5, height=4, overlap=1)
    table = camera.frame_tiles(cfg, spark.range(2).selectExpr("cast(id as int) as frame_id"))
    assert [tuple(r) for r in table.orderBy("task_id").collect()] == [(0, 0, 0, 0, 0, 3, 4), (0, 1, 1, 1, 0, 5, 4), (1, 0, 2, 0, 0, 3, 4), (1, 1, 3, 1, 0, 5, 4)]
    stream = camera.frame_tiles(cfg, camera.paced_frames(spark, 50))
    query = stream.writeStream.format("memory").queryName("paced").start()
    while spark.table("paced").count() == 0:
        query.processAllAvailable()
    query.stop()
    assert spark.table("paced").count() % 2 == 0


def test_files_are_found_below_a_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "gt.txt").write_bytes(b"x")
    (tmp_path / "a" / "other.csv").write_bytes(b"y")
    assert [r.content for r in camera.located(spark, str(tmp_path), "gt*.txt").collect()] == [b"x"]


def test_viewer_lines(spark):
    events = spark.createDataFrame([("c", 3, 1, 4, 0.0, 0.5, [(0, 0, 1.0, 2.0, 3.0, 4.0, 0.5, 0)])], live.EVENT)
    assert [r.line for r in camera.viewer_lines(events).orderBy("place").collect()] == ["FRAME 3 1", "BOX 1.0000 2.0000 3.0000 4.0000 0.5000", "END_FRAME 3"]
