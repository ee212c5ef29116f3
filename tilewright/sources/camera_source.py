"""A camera as a streaming data source, ``tilewright_camera``.

The source replays a recording (``sources.recordings``) as the rows of a camera's protocol: READY once,
then for each frame a FRAME row with the whole image, a TILE row for each tile and an END_FRAME row with
their count, and END_STREAM after the last frame. Offsets are frames of each camera, so a batch that
fails or a query that restarts reads the very same frames again; frames of a batch are read in parallel,
``chunk`` at a time.

Options: ``path``; ``tile_grid``, ``overlap``; ``fps`` and ``began`` (seconds since 1970): a frame is
there when its time has come, at 0 all are; ``frames``: bound for each camera, 0 for none;
``frames_per_trigger``: most frames of a camera in a batch, 0 for all, and with it ``progress``, a file in
the shared folder for the offsets that were planned last; ``start_frame``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tilewright.config import DetectionConfig
from tilewright.sources.recordings import Recording, opened
from tilewright.sources.tasks import plain_tile_bounds

LINES = "camera string, kind string, seq bigint, frame_id int, width int, height int, captured_ms double, capture_ms double, task_id bigint, tile_id int, x1 int, y1 int, x2 int, y2 int, tiles int, image binary"
_ARROW = pa.schema([("camera", pa.string()), ("kind", pa.string()), ("seq", pa.int64()), ("frame_id", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("captured_ms", pa.float64()), ("capture_ms", pa.float64()),
                    ("task_id", pa.int64()), ("tile_id", pa.int32()), ("x1", pa.int32()), ("y1", pa.int32()), ("x2", pa.int32()), ("y2", pa.int32()), ("tiles", pa.int32()), ("image", pa.binary())])


@dataclass
class Frames(InputPartition):
    """Frames ``start`` to ``end`` - 1 of a camera in the files ``parts``; ``last`` if the stream ends behind them."""

    camera: str
    start: int
    end: int
    last: bool
    parts: tuple[str, ...] = ()


class CameraReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.cfg = DetectionConfig(tile_grid=options.get("tile_grid", "1x1"), overlap=int(options.get("overlap", "64")), live=True)
        self.fps, self.began = float(options.get("fps", "0")), float(options.get("began", "0"))
        self.first, self.bound = int(options.get("start_frame", "0")), int(options.get("frames", "0"))
        self.step, self.chunk = int(options.get("frames_per_trigger", "0")), int(options.get("chunk", "256"))
        if self.fps < 0 or self.bound < 0 or self.step < 0 or self.chunk < 1 or self.first < 0:
            raise ValueError("fps, frames, frames_per_trigger and start_frame must not be negative, chunk must be positive")
        if self.fps and not self.began:
            raise ValueError("fps needs began, so that a restarted query goes on by the same clock")
        if self.step and "progress" not in options:
            raise ValueError("frames_per_trigger needs progress, since Spark doesn't say where a restarted query is")
        self.recording = Recording(self.path)
        self.progress = opened(options["progress"]) if self.step else None
        #: Offsets that were planned last; a batch that is planned later never ends before them.
        self.at: dict[str, int] = {}
        if self.progress and self.progress[0].get_file_info(self.progress[1]).type == pafs.FileType.File:
            with self.progress[0].open_input_stream(self.progress[1]) as kept:
                self.at = json.loads(kept.read())

    def _limits(self) -> dict[str, int]:
        """Frames of each camera up to its bound."""
        return {c: min(n, self.first + self.bound) if self.bound else n for c, n in self.recording.counts().items()}

    def _ended(self, camera: str, limit: int) -> bool:
        return self.recording.closed() or bool(self.bound and limit == self.first + self.bound)

    def initialOffset(self) -> dict:
        return {"": 0}

    def latestOffset(self) -> dict:
        due = self.first + max(0, int((time.time() - self.began) * self.fps)) if self.fps else None
        out = {"": 0}
        for camera, limit in self._limits().items():
            known = self.at.get(camera, self.first)
            ends = limit + 1 if self._ended(camera, limit) else limit  # the end of the stream counts as one frame more
            at = ends if due is None else min(ends, max(due, self.first))
            out[camera] = max(known, min(at, known + self.step) if self.step else at)
        return out

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        self.at = {c: max(self.at.get(c, 0), at) for c, at in end.items()}
        if self.progress:
            files, path = self.progress
            with files.open_output_stream(f"{path}.new") as kept:
                kept.write(json.dumps(self.at).encode())
            files.move(f"{path}.new", path)
        limits, out = self._limits(), []
        for camera in sorted(end.keys() - {""}):
            at, stop = start.get(camera, self.first), end[camera]
            ended = stop > limits[camera]
            stop = min(stop, limits[camera])
            while at < stop:
                upto = min(stop, at + self.chunk)
                out.append(Frames(camera, at, upto, ended and upto == stop, self.recording.parts(camera, at, upto)))
                at += self.chunk
            if ended and start.get(camera, self.first) >= stop and start.get(camera, self.first) <= limits[camera]:
                out.append(Frames(camera, stop, stop, True))
        return out

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        cols, rows = self.cfg.grid
        at = partition.start
        if at == self.first and at < partition.end:
            yield self._rows([dict(camera=partition.camera, kind="READY", seq=at, tiles=cols * rows)])
        if at < partition.end:
            began = time.perf_counter()
            for batch in self.recording.frames(partition.parts, at, partition.end):
                if len(batch):
                    yield self._lines(partition.camera, batch.sort_by("seq"), (time.perf_counter() - began) * 1000 / len(batch))
                began = time.perf_counter()
        if partition.last:
            yield self._rows([dict(camera=partition.camera, kind="END_STREAM", seq=partition.end, tiles=partition.end - self.first)])

    def _lines(self, camera: str, frames: pa.RecordBatch, took: float) -> pa.RecordBatch:
        """The rows of all ``frames``; reading one of them took ``took`` ms."""
        tiles, bounds, images = self.cfg.grid[0] * self.cfg.grid[1], {}, []
        sizes = list(zip(frames.column("width").to_pylist(), frames.column("height").to_pylist()))
        for w, h in set(sizes):
            bounds[w, h] = plain_tile_bounds(self.cfg, w, h)
        for (w, h), image, parts in zip(sizes, frames.column("image").to_pylist(), frames.column("tile_images").to_pylist()):
            images += [image, *(parts or ())[:tiles]]
            images += [cut(image, w, h, *b) for b in bounds[w, h][len(parts or ()):]]
            images.append(None)
        n, rows = len(frames), tiles + 2
        of, place = np.repeat(np.arange(n), rows), np.tile(np.arange(rows), n)
        no_tile = (place == 0) | (place == rows - 1)
        edges = np.zeros((n, rows, 4), np.int32)
        edges[:, 1:-1] = [bounds[s] for s in sizes]
        seq = np.asarray(frames.column("seq"))
        columns = {"camera": pa.array([camera] * (n * rows)), "kind": pa.array(["FRAME", *["TILE"] * tiles, "END_FRAME"] * n), **{c: frames.column(c).take(pa.array(of)) for c in ("seq", "frame_id", "width", "height")},
                   "captured_ms": pa.array(np.full(n * rows, time.time() * 1000)), "capture_ms": pa.array(np.full(n * rows, took)),
                   "task_id": pa.array((seq[of] - self.first) * tiles + place - 1, mask=no_tile), "tile_id": pa.array(place - 1, pa.int32(), mask=no_tile),
                   **{c: pa.array(edges[:, :, k].ravel(), mask=no_tile) for k, c in enumerate(("x1", "y1", "x2", "y2"))}, "tiles": pa.array(np.full(n * rows, tiles, np.int32), mask=place < rows - 1), "image": pa.array(images, pa.binary())}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in _ARROW], schema=_ARROW)

    @staticmethod
    def _rows(rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(list(rows), schema=_ARROW)


def cut(image: bytes | None, width: int, height: int, x1: int, y1: int, x2: int, y2: int) -> bytes | None:
    """A tile of raw 8-bit gray pixels; None for an image of another kind."""
    if image is None or len(image) != width * height:
        return None
    return b"".join(image[y * width + x1: y * width + x2] for y in range(y1, y2))


class CameraSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilewright_camera"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: StructType) -> CameraReader:
        return CameraReader(self.options)


def camera_stream(spark: SparkSession, path: str, cfg: DetectionConfig, **options) -> DataFrame:
    """The rows of LINES of all cameras of the recording at ``path``, as a stream."""
    spark.dataSource.register(CameraSource)
    return spark.readStream.format("tilewright_camera").option("path", path).option("tile_grid", cfg.tile_grid).option("overlap", str(cfg.overlap)).options(**{k: str(v) for k, v in options.items()}).load()
