"""Uncompressed video: headers, ranges, bytes that are read, the frame that is kept; resize against plain means."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.fs as pafs
import pytest

from tilewright.config import DetectionConfig
from tilewright.operators.resize import area_resize
from tilewright.sources import camera_source, recordings, video
from tilewright.streaming import frames


def planes(k, w, h, pixels):
    chroma = {"mono": 0, "420": 2 * -(-w // 2) * -(-h // 2), "422": 2 * -(-w // 2) * h, "444": 2 * w * h}[pixels]
    return bytes((k + i) % 256 for i in range(w * h)), bytes((100 + k + i) % 256 for i in range(chroma))


def y4m(path, n, w=6, h=4, pixels="420jpeg", first=0, tail=b""):
    kind = "mono" if pixels == "mono" else pixels[:3]
    body = b"".join(b"FRAME\n" + b"".join(planes(first + k, w, h, kind)) for k in range(n))
    path.write_bytes(f"YUV4MPEG2 W{w} H{h} F30000:1001 Ip A1:1 C{pixels}\n".encode() + body + tail)


@pytest.mark.parametrize("pixels", ["420jpeg", "422", "444", "mono"])
def test_frames_and_probe(spark, tmp_path, pixels):
    folder = tmp_path / "v"
    folder.mkdir()
    y4m(folder / "b.y4m", 3, 5, 3, pixels, first=7)
    y4m(folder / "a.y4m", 7, 5, 3, pixels, tail=b"FRAME\ncut off")
    (folder / "_hidden").write_bytes(b"x")
    kind = "mono" if pixels == "mono" else pixels[:3]
    rows = video.read_video(spark, str(folder), frames_per_task=2).orderBy("frame_id").collect()
    assert [(r.frame_id, r.width, r.height, bytes(r.luma), bytes(r.chroma)) for r in rows] == [(k, 5, 3, *planes(k, 5, 3, kind)) for k in range(10)]
    some = video.read_video(spark, str(folder), "luma binary, frame_id bigint", start=5, frames=4).collect()
    assert sorted((r.frame_id, bytes(r.luma)) for r in some) == [(k, planes(k, 5, 3, kind)[0]) for k in range(5, 9)]
    probe = [tuple(r) for r in video.probe(spark, str(folder)).orderBy("part").collect()]
    assert [r[:3] + r[4:5] for r in probe] == [("a.y4m", 5, 3, 7), ("b.y4m", 5, 3, 3)] and abs(probe[0][3] - 29.97) < 0.01
    assert probe[1][5].startswith('{"fps":29.97') and probe[1][5].endswith('"frames":3,"height":3,"width":5}')


def test_raw_video_and_bad_files(spark, tmp_path):
    (tmp_path / "raw").write_bytes(b"".join(planes(k, 4, 2, "mono")[0] for k in range(5)))
    rows = video.read_video(spark, str(tmp_path / "raw"), width=4, height=2, pixels="mono").collect()
    assert sorted((r.frame_id, bytes(r.luma)) for r in rows) == [(k, planes(k, 4, 2, "mono")[0]) for k in range(5)]
    with pytest.raises(ValueError):
        video.parts_of(str(tmp_path / "raw"))
    with pytest.raises(FileNotFoundError):
        video.parts_of(str(tmp_path / "none"))
    y4m(tmp_path / "ten", 1, pixels="420p10")
    with pytest.raises(ValueError):
        video.parts_of(str(tmp_path / "ten"))


class Counted:
    """A file that notes where it was read."""

    def __init__(self, file):
        self.file, self.read_at = file, []

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        self.read_at.append((self.file.tell(), n))
        return self.file.read(n)


def test_only_the_bytes_of_a_frame_are_read_and_once(tmp_path):
    y4m(tmp_path / "v.y4m", 9)
    part = video.parts_of(str(tmp_path / "v.y4m"))[0]
    one = video.FrameFile(pafs.LocalFileSystem(), part)
    one.file = Counted(one.file)
    for _ in range(3):
        assert one.planes(5)[0] == planes(5, 6, 4, "420")[0]
    assert one.file.read_at == [(part.header + 5 * part.stride, 6), (part.header + 5 * part.stride + 6, 24), (part.header + 5 * part.stride + 30, 12)]
    one.file.read_at.clear()
    assert one.planes(2, luma=False) == (None, planes(2, 6, 4, "420")[1]) and sum(n for _, n in one.file.read_at) == 18
    for bad in (-1, 9):
        with pytest.raises(IndexError):
            one.planes(bad)


def test_written_video_comes_back_and_feeds_the_camera(spark, tmp_path):
    rows = [(k, 6, 4, bytes(range(k, k + 24))) for k in range(40)]
    path = str(tmp_path / "made")
    video.write_video(spark.createDataFrame(rows, "place bigint, width int, height int, luma binary").repartition(3), path, 25)
    back = video.read_video(spark, path)
    assert sorted((r.frame_id, bytes(r.luma)) for r in back.collect()) == [(k, luma) for k, _, _, luma in rows]
    cfg = DetectionConfig(tile_grid="2x2", overlap=1, live=True)
    tiles = video.tile_pixels(video.video_tasks(cfg, back, 6, 4), path).collect()
    want = {(k, t): b"".join(luma[y * 6 + x1: y * 6 + x2] for y in range(y1, y2)) for k, _, _, luma in rows for t, (x1, y1, x2, y2) in enumerate([(0, 0, 4, 3), (2, 0, 6, 3), (0, 1, 4, 4), (2, 1, 6, 4)])}
    assert {(t.frame_id, t.tile_id): bytes(t.pixels) for t in tiles} == want
    recordings.write_recording(video.recorded(back, "front"), str(tmp_path / "rec"))
    lines = camera_source.camera_stream(spark, str(tmp_path / "rec"), cfg)
    frames.run_through(lines.writeStream.format("parquet").option("path", str(tmp_path / "lines")).option("checkpointLocation", str(tmp_path / "log")))
    sent = spark.read.parquet(str(tmp_path / "lines")).where("kind = 'TILE'").collect()
    assert {(r.frame_id, r.tile_id): bytes(r.image) for r in sent} == want


@pytest.mark.parametrize(("size", "target"), [((8, 8), (5, 3)), ((4, 6), (2, 3)), ((3, 2), (7, 5)), ((5, 5), (5, 5)), ((1, 9), (1, 1))])
def test_area_resize_equals_means_over_a_fine_grid(spark, size, target):
    rng = random.Random(4)
    (h, w), (th, tw) = size, target
    maps = {(i, c): np.array([[rng.randint(0, 255) for _ in range(w)] for _ in range(h)], float) for i in range(2) for c in range(2)}
    rows = [(i, c, y, x, float(m[y, x])) for (i, c), m in maps.items() for y in range(h) for x in range(w)]
    out = {(r.img, r.c, r.y, r.x): r.v for r in area_resize(spark.createDataFrame(rows, "img int, c int, y int, x int, v double"), size, target).collect()}
    for (i, c), m in maps.items():
        fine = np.kron(m, np.ones((th, tw))).reshape(th, h, tw, w).mean(axis=(1, 3))
        for y in range(th):
            for x in range(tw):
                assert abs(out[i, c, y, x] - fine[y, x]) < 1e-9
    assert len(out) == 4 * th * tw
    with pytest.raises(ValueError):
        area_resize(spark.createDataFrame(rows, "img int, c int, y int, x int, v double"), size, (0, 1))


def test_pixels_are_rounded_in_the_type_of_the_values(spark, tmp_path):
    import duckdb

    from tilewright.plans.convolution import S3_SQL, s3_video_tiles

    rows = [(k, [float(v) for v in np.float32([0.105, -0.105, 0.115, 0.3 + k / 100] * 16)]) for k in range(3)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as db:
        db.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        expected = db.execute(S3_SQL).fetchall()
    assert sorted(map(tuple, s3_video_tiles(spark, str(tmp_path)).collect())) == sorted(expected)
