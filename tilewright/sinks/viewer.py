"""K9: a viewer as a streaming sink, ``tilewright_viewer``: each frame's lines are delivered once.

Tasks write the lines of their frames to new files in the shared folder. When all tasks of a batch are
through, one manifest named after the batch lists its files, put in place by a rename; a batch that has
its manifest already, because a query failed between this and its own log, is not delivered again. Files
that no manifest lists are never read, and an aborted batch deletes its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tilewright.sources.recordings import opened


@dataclass
class Written(WriterCommitMessage):
    """A task's file, or none."""

    file: str | None
    frames: int


def frame_lines(frame: Row) -> Iterator[str]:
    """FRAME with its size and number of boxes, a BOX line for each, END_FRAME."""
    yield f"FRAME {frame.frame_id} {frame.width} {frame.height} {len(frame.boxes)}"
    for b in frame.boxes:
        yield "BOX " + " ".join(f"{v:.4f}" for v in (b.x1, b.y1, b.x2, b.y2, b.conf))
    yield f"END_FRAME {frame.frame_id}"


class ViewerWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = opened(self.path)
        name, count, out = f"{uuid.uuid4().hex}.txt", 0, None
        for frame in iterator:
            if frame.status == "late":
                continue
            if out is None:
                files.create_dir(f"{root}/files", recursive=True)
                out = files.open_output_stream(f"{root}/files/{name}")
            out.write("".join(f"{frame.camera}\t{frame.frame_id}\t{place}\t{line}\n" for place, line in enumerate(frame_lines(frame))).encode())
            count += 1
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, count)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        files, root = opened(self.path)
        files.create_dir(f"{root}/batches", recursive=True)
        manifest = f"{root}/batches/{batchId:012d}.json"
        if files.get_file_info(manifest).type == pafs.FileType.File:
            self.abort(messages, batchId)
            return
        hidden = f"{root}/batches/_{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            out.write("".join(json.dumps({"batch": batchId, "file": m.file, "frames": m.frames}) + "\n" for m in messages if m and m.file).encode())
        files.move(hidden, manifest)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        files, root = opened(self.path)
        for m in messages:
            if m and m.file:
                files.delete_file(f"{root}/files/{m.file}")


class ViewerSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilewright_viewer"

    def streamWriter(self, schema: StructType, overwrite: bool) -> ViewerWriter:
        return ViewerWriter(self.options["path"])


def to_viewer(events: DataFrame, path: str, checkpoint: str):
    """A stream writer of EVENT rows to the viewer at ``path``; ``start()`` runs it. Frames are dealt to as many tasks as there are cores, not to one for each camera."""
    spark = events.sparkSession
    spark.dataSource.register(ViewerSink)
    return events.repartition(spark.sparkContext.defaultParallelism, "camera", "seq").writeStream.format("tilewright_viewer").option("path", path).option("checkpointLocation", checkpoint)


def viewed(spark: SparkSession, path: str) -> DataFrame:
    """(camera, frame_id, place, line) of all that has been delivered."""
    lines = spark.read.text(f"{path}/files").select("value", F.col("_metadata.file_name").alias("name"))
    sent = spark.read.schema("batch bigint, file string, frames bigint").json(f"{path}/batches").select("file").distinct()
    part = F.split("value", "\t", 4)
    rows = lines.join(sent, F.col("name") == F.col("file"), "left_semi")
    return rows.select(part[0].alias("camera"), part[1].cast("int").alias("frame_id"), part[2].cast("int").alias("place"), part[3].alias("line"))
