"""Recorded cameras: folders of frames that a live source replays, and the files below a shared path."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORDED = "camera string, seq bigint, frame_id int, width int, height int, image binary, tile_images array<binary>"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def write_recording(frames: DataFrame, path: str, placed: bool = False) -> None:
    """RECORDED rows as a recording: a folder for each camera, whose files have ranges of ``seq``, the camera's own count of frames from 0.

    ``image`` is the whole frame as the camera encodes it; ``tile_images`` the same of its tiles in order, or null.
    ``placed``: the partitions of ``frames`` have such ranges already.
    """
    rows = frames if placed else frames.repartitionByRange("camera", "seq")
    rows.sortWithinPartitions("camera", "seq").write.partitionBy("camera").option("parquet.block.size", 8 << 20).parquet(path)


class Recording:
    """What a reader needs of a recording: its cameras, how many frames each has so far, and ranges of frames."""

    def __init__(self, path: str):
        self.files, self.root = opened(path)
        self._spans: dict[str, tuple[int, int]] = {}
        #: Folders of the cameras, and files of the folders, of a recording that is closed.
        self._folders: dict[str, str] = {}
        self._files: dict[str, list[str]] = {}

    def closed(self) -> bool:
        """Whether no frames will be added."""
        return self.files.get_file_info(f"{self.root}/_SUCCESS").type == pafs.FileType.File

    def cameras(self) -> dict[str, str]:
        """Folder of each camera by its name."""
        if self._folders:
            return self._folders
        closed = self.closed()
        found = self.files.get_file_info(pafs.FileSelector(self.root, allow_not_found=True))
        folders = {f.base_name.removeprefix("camera="): f.path for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.Directory and f.base_name.startswith("camera=")}
        if closed:
            self._folders = folders
        return folders

    def _parts(self, folder: str) -> list[str]:
        if folder in self._files:
            return self._files[folder]
        closed = self.closed()
        parts = sorted(f.path for f in self.files.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
        if closed:
            self._files[folder] = parts
        return parts

    def _span(self, part: str) -> tuple[int, int]:
        """First ``seq`` of a file and one more than its last, from its footer; a file never changes."""
        if part not in self._spans:
            footer = pq.ParquetFile(part, filesystem=self.files).metadata
            at = footer.schema.to_arrow_schema().get_field_index("seq")
            found = [footer.row_group(k).column(at).statistics for k in range(footer.num_row_groups)]
            self._spans[part] = (min([s.min for s in found], default=0), max([s.max + 1 for s in found], default=0))
        return self._spans[part]

    def counts(self) -> dict[str, int]:
        """Frames of each camera."""
        return {name: max([0, *(self._span(p)[1] for p in self._parts(folder))]) for name, folder in self.cameras().items()}

    def parts(self, camera: str, start: int, end: int) -> tuple[str, ...]:
        """The files that have any of the frames ``start`` to ``end`` - 1."""
        return tuple(p for p in self._parts(self.cameras()[camera]) if self._span(p)[0] < end and self._span(p)[1] > start)

    def frames(self, parts: tuple[str, ...], start: int, end: int) -> pa.RecordBatchReader:
        """Batches of the frames ``start`` to ``end`` - 1 by ``seq`` from these files; row groups outside are not read."""
        columns = ["seq", "frame_id", "width", "height", "image", "tile_images"]
        data = ds.dataset(list(parts), format="parquet", filesystem=self.files)
        seq = ds.field("seq")
        return data.scanner(columns=columns, filter=(seq >= start) & (seq < end), batch_size=64, use_threads=False).to_reader()


def with_tile_images(boxes: DataFrame, cameras: int, width: int, height: int, tiles: int, anchor: str) -> DataFrame:
    """RECORDED rows from flat boxes, with the JSON of boxes as the opaque images that a detector decodes.

    Frame f belongs to camera f mod ``cameras``. A tile's image has its boxes; the frame's image those that fit ``anchor``, as tile -1.
    Partitions have ranges of a camera's frames.
    """
    from tilewright.functions.geometry import box

    # every tile of a frame has an image; boxes of a tile id outside the grid go with the first tile's, those without one are the whole frame's only
    slot = F.when(F.col("tile_id").between(0, tiles - 1), F.col("tile_id")).when(F.col("tile_id").isNull(), F.lit(-1)).otherwise(F.lit(0))
    one, whole = F.struct(F.col("tile_id").alias("t"), box().alias("b")), F.when(F.expr(anchor), box().withField("tile_id", F.lit(-1)))
    # boxes move once, as they are: groups and files need not move them again
    camera = F.concat(F.lit("cam"), (F.col("frame_id") % cameras).cast("string"))
    placed = boxes.withColumns({"camera": camera, "slot": slot}).repartitionByRange("camera", "frame_id")
    parts = placed.groupBy("camera", "frame_id", "slot").agg(F.sort_array(F.collect_list(one)).alias("part"), F.collect_list(whole).alias("anchors"))
    entry = F.struct("slot", F.to_json(F.col("part.b")).cast("binary").alias("image"))
    rows = parts.groupBy("camera", "frame_id").agg(F.map_from_entries(F.collect_list(entry)).alias("found"), F.to_json(F.sort_array(F.flatten(F.collect_list("anchors")))).cast("binary").alias("image"))
    images = F.transform(F.sequence(F.lit(0), F.lit(tiles - 1)), lambda k: F.coalesce(F.try_element_at("found", k), F.lit(b"[]")))
    return rows.select(
        "camera", F.floor(F.col("frame_id") / cameras).alias("seq"), "frame_id", F.lit(width).alias("width"), F.lit(height).alias("height"),
        "image", images.alias("tile_images"))
