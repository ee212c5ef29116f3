"""Readers of the text formats: tagged payloads, CSV, ground truth, hosts, manifests, image lists, PPM, camera lines.

None of them opens a file outside Spark's readers.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.shared import numbered

DETECTION_FIELDS = (("frame_id", "int"), ("tile_id", "int"), ("rank", "int"), ("x1", "double"), ("y1", "double"), ("x2", "double"), ("y2", "double"), ("conf", "double"), ("cls", "int"))
METRIC_FIELDS = (("rank", "int"), ("hostname", "string"), ("tasks_done", "bigint"), ("frames_done", "bigint"), ("compute_ms", "double"), ("io_ms", "double"), ("yolo_ms", "double"), ("comm_ms", "double"), ("idle_ms", "double"))


def payload(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections and metrics from the lines (column value) of a job's payload; other lines are skipped."""
    def table(tag: str, fields: tuple) -> DataFrame:
        parts = F.split("value", ",")
        rows = lines.where(F.col("value").startswith(tag + ",") & (F.size(parts) == len(fields) + 1))
        return rows.select(*[parts[k + 1].cast(kind).alias(name) for k, (name, kind) in enumerate(fields)])
    return table("DET", DETECTION_FIELDS), table("MET", METRIC_FIELDS)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file or glob with a header; without any file an empty table of that schema."""
    try:
        return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    except Exception as error:  # Spark's readers tell a missing path by this condition alone
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def counts_with_fallback(table: DataFrame, preferred: tuple[str, ...] = ("count", "people_count")) -> DataFrame:
    """(frame_id, person_count) from the first column there is; of a frame's rows the last (seq) holds."""
    name = next((c for c in (*preferred, "person_count") if c in table.columns), None)
    if name is None:
        raise ValueError("no column with counts")
    rows = table.groupBy(F.col("frame_id").cast("int").alias("frame_id")).agg(F.max_by(F.col(name), "seq").alias("count"))
    return rows.select("frame_id", F.bround(F.col("count").cast("double"), 0).cast("bigint").alias("person_count"))


def ground_truth(lines: DataFrame) -> DataFrame:
    """(mot_frame, conf, class_id, visibility) from comma lines of nine fields or more; others are skipped."""
    parts = F.split(F.trim("value"), ",")
    return lines.where(F.size(parts) >= 9).select(
        parts[0].cast("double").cast("int").alias("mot_frame"), parts[6].cast("double").alias("conf"), parts[7].cast("double").cast("int").alias("class_id"), parts[8].cast("double").alias("visibility"))


def host_slots(lines: DataFrame) -> DataFrame:
    """(line_no, host, slots) without blank and comment lines; slots is 1 where none are given."""
    text = F.trim("line")
    rows = lines.where((text != "") & ~text.startswith("#"))
    found = F.regexp_extract(text, r"slots=(\d+)", 1)
    return rows.select("line_no", F.regexp_extract(text, r"^(\S+)", 1).alias("host"), F.when(found == "", 1).otherwise(found.try_cast("int")).alias("slots"))


def manifest(lines: DataFrame) -> DataFrame:
    """(key, value) of key=value lines (columns seq, value); cut at the first =, the last of a key holds."""
    parts = F.split("value", "=", 2)
    rows = lines.where(F.col("value").contains("=")).select("seq", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))
    return rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def image_list(lines: DataFrame, limit: int = 0, base: str = "") -> DataFrame:
    """(image_index, path) in order of seq; blank and comment lines are skipped, relative paths get ``base``."""
    text = F.trim("value")
    rows = lines.where((text != "") & ~text.startswith("#")).select("seq", F.when(text.startswith("/") | (F.lit(base) == ""), text).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), text)).alias("path"))
    rows = numbered(rows, ["seq"], "image_index").withColumn("image_index", F.col("image_index").cast("int"))
    return (rows.where(F.col("image_index") < limit) if limit else rows).select("image_index", "path").orderBy("image_index")


def with_path_key(table: DataFrame, pattern: str, name: str) -> DataFrame:
    """``name`` from the path of each row's file."""
    return table.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def decode_ppm(data: bytes) -> np.ndarray:
    """(3, height, width) float32 in 0..1 from a P6 or P3 image with 255 levels."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(data) and data[at:at + 1].isspace():
            at += 1
        if data[at:at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while end < len(data) and not data[end:end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("the image ends in its header")
        fields.append(data[at:end])
        at = end
    kind, width, height, levels = fields[0], *map(int, fields[1:])
    if kind not in (b"P6", b"P3") or levels != 255 or min(width, height) <= 0:
        raise ValueError("only P6 and P3 images with 255 levels are read")
    n = width * height * 3
    values = np.frombuffer(data, np.uint8, -1, at + 1)[:n] if kind == b"P6" else np.array(data[at:].split()[:n], np.uint16)
    if len(values) < n:
        raise ValueError("the image is cut short")
    return (values.reshape(height, width, 3).transpose(2, 0, 1) / np.float32(255)).astype(np.float32)


def ppm_pixels(images: DataFrame) -> DataFrame:
    """(path, c, height, width, values) per channel from Spark's binaryFile rows (path, content)."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                image = decode_ppm(content)
                yield pa.RecordBatch.from_pydict({"path": [path] * 3, "c": pa.array(range(3), pa.int32()), "height": pa.array([image.shape[1]] * 3, pa.int32()), "width": pa.array([image.shape[2]] * 3, pa.int32()),
                                                  "values": pa.array([x.ravel() for x in image], pa.list_(pa.float32()))})

    return images.select("path", "content").mapInArrow(decode, "path string, c int, height int, width int, values array<float>")


def zip_members(archives: DataFrame, suffix: str) -> DataFrame:
    """(path, member, content) of the first member of each zip archive (path, content) whose name ends with ``suffix``, letters in either case.

    An archive without such a member gives a null member. One archive is one row's work.
    """
    wanted = suffix.lower().replace("\\", "/")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, contents = [], []
            for content in batch.column(1).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    name = next((n for n in archive.namelist() if n.lower().endswith(wanted)), None)
                    members.append(name)
                    contents.append(None if name is None else archive.read(name))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(members, pa.string()), pa.array(contents, pa.binary())], ["path", "member", "content"])

    return archives.select("path", "content").mapInArrow(find, "path string, member string, content binary")


def camera_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames and tiles from protocol lines; END lines, READY and blank lines carry no rows, ERROR lines are an error."""
    checked = lines.withColumn("value", F.when(F.col("value").startswith("ERROR"), F.raise_error(F.col("value")).cast("string")).otherwise(F.col("value")))
    parts = F.split("value", " ")
    frame = checked.where(F.col("value").startswith("FRAME ")).select(
        parts[1].cast("int").alias("frame_id"), parts[2].cast("int").alias("frame_width"), parts[3].cast("int").alias("frame_height"), parts[4].cast("double").alias("capture_ms"), F.unbase64(parts[5]).alias("image"))
    tile = checked.where(F.col("value").startswith("TILE ")).select(
        *[parts[k + 1].cast("int").alias(n) for k, n in enumerate(("task_id", "frame_id", "tile_id", "x1", "y1", "x2", "y2"))], F.unbase64(parts[8]).alias("image"))
    return frame, tile
