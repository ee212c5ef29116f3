"""Uncompressed video as a data source, ``tilewright_video``: YUV4MPEG2 files, or raw planes.

A path is one file or a folder of them, which are the parts of one video in the order of their names. The
reader deals frames into ranges; a task seeks to the bytes of its range and reads no other ones, of
planes too only those that the schema asks for.
``probe`` tells size, rate and number of frames from headers and file sizes alone.

Options: ``path``; ``width``, ``height``, ``fps`` and ``pixels`` (mono, 420, 422, 444) for raw files;
``start`` and ``frames`` (which to read, by number); ``frames_per_task``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tilewright.config import DetectionConfig
from tilewright.sources.recordings import opened
from tilewright.sources.tasks import plain_tile_bounds

FRAME = "frame_id bigint, width int, height int, luma binary, chroma binary"
_MAGIC, _MARK = b"YUV4MPEG2", b"FRAME\n"
#: What share of the luma plane's width and height each of the two chroma planes has.
_CHROMA = {"mono": None, "420": (2, 2), "422": (2, 1), "444": (1, 1)}


@dataclass(frozen=True)
class Part:
    """A file of a video: where its frames begin, how large they are, and how many there are."""

    path: str
    width: int
    height: int
    fps: float
    pixels: str
    header: int
    mark: int
    frames: int

    @property
    def luma(self) -> int:
        return self.width * self.height

    @property
    def chroma(self) -> int:
        cut = _CHROMA[self.pixels]
        return 2 * -(-self.width // cut[0]) * -(-self.height // cut[1]) if cut else 0

    @property
    def stride(self) -> int:
        return self.mark + self.luma + self.chroma


def _header(line: bytes) -> tuple[int, int, float, str]:
    fields = {f[:1]: f[1:] for f in line.decode("ascii").split(" ")[1:] if f}
    over, _, under = fields.get("F", "0:1").partition(":")
    pixels = fields.get("C", "420")
    kind = "mono" if pixels.startswith("mono") else pixels[:3]
    if kind not in _CHROMA or "p1" in pixels or pixels == "mono16" or "W" not in fields or "H" not in fields:
        raise ValueError(f"no 8-bit YUV4MPEG2 header: {line!r}")
    return int(fields["W"]), int(fields["H"]), int(over) / int(under) if int(under or 0) else 0.0, kind


def probe_file(files: pafs.FileSystem, info: pafs.FileInfo, options: dict[str, str]) -> Part:
    """A file's Part, from its first bytes and its size; a last frame that is cut off doesn't count."""
    with files.open_input_file(info.path) as f:
        first = f.read(256)
    if first.startswith(_MAGIC):
        line = first.partition(b"\n")[0]
        if len(line) == len(first):
            raise ValueError(f"header without an end: {info.path}")
        size, header, mark = _header(line), len(line) + 1, len(_MARK)
    elif "width" in options and "height" in options:
        size, header, mark = (int(options["width"]), int(options["height"]), float(options.get("fps", "0")), options.get("pixels", "420")), 0, 0
    else:
        raise ValueError(f"neither YUV4MPEG2 nor raw with width and height: {info.path}")
    one = Part(info.path, *size, header, mark, 0)
    return Part(info.path, *size, header, mark, max(0, info.size - header) // one.stride if one.luma else 0)


def parts_of(path: str, options: dict[str, str] | None = None) -> list[Part]:
    """The parts of a video in order; they must have one size."""
    files, root = opened(path)
    info = files.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else sorted((f for f in files.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
    out = [probe_file(files, f, options or {}) for f in found if f.size]
    if len({(p.width, p.height, p.pixels) for p in out}) > 1:
        raise ValueError("the parts of a video differ in size")
    return out


class FrameFile:
    """S3: frames of an open file by number; the one that was read last is kept, so the tiles of a frame cost one read."""

    def __init__(self, files: pafs.FileSystem, part: Part):
        self.part, self.file, self.at, self.last = part, files.open_input_file(part.path), None, None

    def planes(self, k: int, luma: bool = True, chroma: bool = True) -> tuple[bytes | None, bytes | None]:
        p = self.part
        if not 0 <= k < p.frames:
            raise IndexError(f"cannot read frame {k} of {p.path}")
        if self.at == (k, luma, chroma):
            return self.last
        start = p.header + k * p.stride
        if p.mark:
            self.file.seek(start)
            if self.file.read(p.mark) != _MARK:
                raise ValueError(f"frame {k} of {p.path} has parameters of its own")
        if luma:
            self.file.seek(start + p.mark)
        first = self.file.read(p.luma) if luma else None
        if chroma and not luma:
            self.file.seek(start + p.mark + p.luma)
        self.at, self.last = (k, luma, chroma), (first, self.file.read(p.chroma) if chroma else None)
        return self.last


@dataclass
class Range(InputPartition):
    """Frames ``start`` to ``end`` - 1 of a part, whose first frame has number ``first`` in the video."""

    part: Part
    first: int
    start: int
    end: int


@dataclass
class VideoReader(DataSourceReader):
    options: dict[str, str]
    columns: list[str]

    def partitions(self) -> list[Range]:
        step, low, out, first = int(self.options.get("frames_per_task", "256")), int(self.options.get("start", "0")), [], 0
        high = low + int(self.options["frames"]) if "frames" in self.options else 2**62
        if step < 1 or low < 0 or high < low:
            raise ValueError("frames_per_task must be positive, start and frames must not be negative")
        for part in parts_of(self.options["path"], self.options):
            start, end = max(0, low - first), min(part.frames, high - first)
            out += [Range(part, first, k, min(end, k + step)) for k in range(start, end, step)]
            first += part.frames
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        files, _ = opened(self.options["path"])
        frames, part = FrameFile(files, partition.part), partition.part
        luma, chroma = "luma" in self.columns, "chroma" in self.columns
        for k in range(partition.start, partition.end):
            planes = frames.planes(k, luma, chroma) if luma or chroma else (None, None)
            row = {"frame_id": partition.first + k, "width": part.width, "height": part.height, "luma": planes[0], "chroma": planes[1]}
            yield tuple(row[c] for c in self.columns)


class VideoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilewright_video"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> VideoReader:
        return VideoReader(dict(self.options), [f.name for f in schema.fields])


def read_video(spark: SparkSession, path: str, columns: str = FRAME, **options) -> DataFrame:
    """The frames of a video. ``columns`` (any of FRAME, with types) are all that is read, ``start`` and ``frames`` which frames."""
    spark.dataSource.register(VideoSource)
    return spark.read.format("tilewright_video").schema(columns).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def probe(spark: SparkSession, path: str, **options) -> DataFrame:
    """(part, width, height, fps, frames, info) of each file of a video; info is JSON with its fields by name."""
    rows = [(p.path.rpartition("/")[2], p.width, p.height, p.fps, p.frames) for p in parts_of(path, {k: str(v) for k, v in options.items()})]
    table = spark.createDataFrame(rows, "part string, width int, height int, fps double, frames bigint")
    return table.withColumn("info", F.to_json(F.struct("fps", "frames", "height", "width")))


def tile_pixels(work: DataFrame, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """S3: ``work`` (task_id, frame_id, tile_id, x1, y1, x2, y2) with ``pixels``, the tile cut out of its frame's luma plane.

    Tasks are dealt by ranges of frames and sorted, so that every frame is read once for all its tiles. A frame that the video lacks is an error.
    """
    parts = parts_of(path, options)
    firsts = [sum(p.frames for p in parts[:k]) for k in range(len(parts))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(path)
        open_: tuple[int, FrameFile] | None = None
        for batch in batches:
            out = []
            for t in batch.select(["frame_id", "x1", "y1", "x2", "y2"]).to_pylist():
                at = next((k for k in range(len(parts)) if firsts[k] <= t["frame_id"] < firsts[k] + parts[k].frames), None)
                if at is None:
                    raise IndexError(f"cannot read frame {t['frame_id']} of {path}")
                if open_ is None or open_[0] != at:
                    open_ = (at, FrameFile(files, parts[at]))
                luma, w = open_[1].planes(t["frame_id"] - firsts[at], chroma=False)[0], parts[at].width
                out.append(b"".join(luma[y * w + t["x1"]: y * w + t["x2"]] for y in range(t["y1"], t["y2"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "pixels"])

    dealt = work.repartitionByRange("frame_id").sortWithinPartitions("frame_id", "tile_id")
    return dealt.mapInArrow(cut, work.withColumn("pixels", F.lit(b"")).schema)


def write_video(frames: DataFrame, path: str, fps: int) -> None:
    """(place, width, height, luma) rows as a mono video: a file for each range of ``place``, in order of their names, put in place when it is whole."""
    import uuid

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        out = name = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(root, recursive=True)
                    name, hidden = f"{root}/{row['place']:015d}.y4m", f"{root}/_{uuid.uuid4().hex}"
                    out = files.open_output_stream(hidden)
                    out.write(b"%s W%d H%d F%d:1 Ip A1:1 Cmono\n" % (_MAGIC, row["width"], row["height"], fps))
                if len(row["luma"]) != row["width"] * row["height"]:
                    raise ValueError(f"frame {row['place']} has {len(row['luma'])} pixels")
                out.write(_MARK + row["luma"])
        if out is not None:
            out.close()
            files.move(hidden, name)
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], ["file"])

    frames.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()


def recorded(frames: DataFrame, camera: str) -> DataFrame:
    """RECORDED rows of a video's frames, for the live source: raw gray images, whose tiles the source cuts."""
    return frames.select(F.lit(camera).alias("camera"), F.col("frame_id").alias("seq"), F.col("frame_id").cast("int").alias("frame_id"), "width", "height", F.col("luma").alias("image"), F.lit(None).cast("array<binary>").alias("tile_images"))


def video_tasks(cfg: DetectionConfig, frames: DataFrame, width: int, height: int) -> DataFrame:
    """The tiles of every frame of a video, as ``tile_pixels`` takes them."""
    bounds = F.array(*[F.struct(F.lit(t).alias("tile_id"), *[F.lit(v).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), b)]) for t, b in enumerate(plain_tile_bounds(cfg, width, height))])
    rows = frames.select("frame_id", F.explode(bounds).alias("t")).select("frame_id", "t.*")
    return rows.select((F.col("frame_id") * (cfg.grid[0] * cfg.grid[1]) + F.col("tile_id")).alias("task_id"), "frame_id", "tile_id", "x1", "y1", "x2", "y2")
