"""A camera's protocol rows become frames, frames become events; state in typed variables.

Rows of a camera come in any order within and across micro-batches. A frame is held in state until its
END_FRAME row and as many tiles as that says are there and the frame before it is done (the first one is
that of READY, or 0); then its tiles
and anchors are merged, matched with the boxes of the frame before, and an event is sent. A frame that
holds up the others for longer than ``hold_ms`` is done with what has come (``partial``), or skipped if
nothing has; END_STREAM does the same at once for all frames that are left. Rows of a frame that is
done already change nothing: each such frame of a batch is reported once, as ``late``.

``latency_ms`` is the time from the end of a frame's capture to its result, with all waiting, merging
and matching in it; reading the frame itself is ``capture_ms``.

Rows reach the state packed: those of a frame that are in one Arrow batch are one row, with their boxes as
plain doubles. Whole frames that follow each other in a batch are one row, a RUN, with what the fold makes
of them if no frame comes before the first. That work is done in as many tasks as there are rows to read;
the few tasks that have state, one a camera, fold the first frames of a run again from the boxes that really
come before, until they get what the run has: from there on nothing can differ. Its events leave them as
one row again. A run that can't be let go at once is kept as the frames that it is made of.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tilewright.config import DetectionConfig
from tilewright.functions import folds
from tilewright.functions.boxes import merged_boxes
from tilewright.functions.geometry import BOX
from tilewright.streaming.live import dedup, dedup_runs

EVENT = "camera string, seq bigint, frame_id int, width int, height int, person_count int, tasks int, capture_ms double, latency_ms double, status string, boxes array<struct<tile_id:int,rank:int,x1:double,y1:double,x2:double,y2:double,conf:double,cls:int>>"
PACKED = "camera string, kind string, seq bigint, frame_id int, width int, height int, captured_ms double, capture_ms double, tiles int, head boolean, ids array<int>, counts array<int>, boxes binary"
RUNS = f"{PACKED}, seqs binary, outs binary"
PACKED_EVENT = EVENT.partition("boxes ")[0] + "boxes binary, seqs binary"
_ARROW = pa.schema([("camera", pa.string()), ("kind", pa.string()), ("seq", pa.int64()), ("frame_id", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("captured_ms", pa.float64()), ("capture_ms", pa.float64()),
                    ("tiles", pa.int32()), ("head", pa.bool_()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("boxes", pa.binary())])
_RUN_ARROW = pa.schema([*_ARROW, ("seqs", pa.binary()), ("outs", pa.binary())])
_HEAD = ("frame_id", "width", "height", "captured_ms", "capture_ms")
#: A frame of a RUN and of its events; ``lists`` and ``held`` are its parts and their boxes, ``person_count`` the boxes that the fold leaves.
_SEQS = np.dtype([("seq", "i8"), ("frame_id", "i4"), ("width", "i4"), ("height", "i4"), ("tiles", "i4"), ("lists", "i4"), ("held", "i4"), ("person_count", "i4"), ("tasks", "i4"), ("captured_ms", "f8"), ("capture_ms", "f8"), ("latency_ms", "f8")])
_FIELDS = ("neg_conf", "tile_id", "x1", "y1", "x2", "y2", "conf", "rank", "cls")
_OUT = ("tile_id", "rank", "x1", "y1", "x2", "y2", "conf", "cls")
_WHOLE = ("tile_id", "rank", "cls")
#: Bytes of a packed box.
_SIZE = 8 * len(_FIELDS)
#: Boxes of a RUN, about: they are one value.
RUN_BOXES = 1 << 16
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(boxes) -> list[dict]:
    return [b if isinstance(b, dict) else b.asDict() for b in boxes or ()]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PACKED rows of protocol rows: a PART row for all rows of a frame in a batch, whose whole-frame boxes have tile -1; of equal rows the last holds."""
    for batch in batches:
        plain = pc.invert(pc.is_in(batch.column("kind"), pa.array(["FRAME", "TILE", "END_FRAME"])))
        lone = batch.filter(plain).select([n for n in _ARROW.names if n in batch.schema.names and n != "boxes"]).to_pylist()
        if lone:
            yield pa.RecordBatch.from_pylist(lone, schema=_ARROW)
        batch = batch.filter(pc.invert(plain))
        if not len(batch):
            continue
        kind, camera = (batch.column(n).dictionary_encode(null_encoding="encode") for n in ("kind", "camera"))
        kinds = np.array(kind.dictionary.to_pylist())[np.asarray(kind.indices)]
        frame, tile = kinds == "FRAME", kinds == "TILE"
        if batch.column("tile_id").filter(pa.array(tile)).null_count:
            raise ValueError("a TILE row has no tile_id")
        _, of = np.unique(np.column_stack([np.asarray(camera.indices), np.asarray(batch.column("seq"))]), axis=0, return_inverse=True)
        of, rows = of.ravel(), np.arange(len(batch))

        def last(which: np.ndarray) -> np.ndarray:
            """The last such row of each frame, -1 for none."""
            found = np.full(of.max() + 1, -1)
            np.maximum.at(found, of[which], rows[which])
            return found
        heads, ends = last(frame), last(kinds == "END_FRAME")
        head = batch.take(pa.array(np.where(heads >= 0, heads, last(rows >= 0))))
        part = np.where(frame, -1, np.asarray(batch.column("tile_id").fill_null(-1)))
        order = rows[frame | tile]
        order = order[np.lexsort((order, part[order], of[order]))]
        order = order[np.append((np.diff(of[order]) != 0) | (np.diff(part[order]) != 0), np.ones(min(1, len(order)), bool))]
        lists = batch.column("boxes")
        sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
        flat, starts = lists.flatten(), np.cumsum(sizes) - sizes
        counts = sizes[order]
        at = np.repeat(starts[order] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        values = np.column_stack([np.asarray(flat.field(f), np.float64) for f in _FIELDS])[at] if len(at) else np.empty((0, len(_FIELDS)))
        parts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of[order], minlength=len(heads)))]), pa.int32())
        spans = np.concatenate([[0], np.cumsum(np.bincount(of[order], counts, minlength=len(heads)))]).astype(np.int64) * _SIZE
        columns = {"kind": pa.array(["PART"] * len(heads)), **{n: head.column(n) for n in ("camera", "seq", *_HEAD)}, "tiles": batch.column("tiles").take(pa.array(ends, mask=ends < 0)), "head": pa.array(heads >= 0),
                   "ids": pa.ListArray.from_arrays(parts, pa.array(part[order], pa.int32())), "counts": pa.ListArray.from_arrays(parts, pa.array(counts, pa.int32())),
                   "boxes": pa.Array.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(spans.tobytes()), pa.py_buffer(values.tobytes())])}
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in _ARROW], schema=_ARROW)


def runs(cfg: DetectionConfig, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS rows of PACKED rows: the whole frames of a batch are merged side by side, and those that follow each other are a RUN row; all other rows stay."""
    for batch in batches:
        rows = batch.to_pylist()
        found = sorted((k for k, r in enumerate(rows) if _can_run(r)), key=lambda k: (rows[k]["camera"] or "", rows[k]["camera"] is not None, rows[k]["seq"]))
        whole = [rows[k] for k in found]
        taken = set(found)
        out = [r for k, r in enumerate(rows) if k not in taken]
        if whole:
            values = np.frombuffer(b"".join(r["boxes"] for r in whole)).reshape(-1, len(_FIELDS))
            held = np.array([sum(r["counts"]) for r in whole], np.int64)
            block = np.cumsum(held) // RUN_BOXES
            first = [k == 0 or r["camera"] != whole[k - 1]["camera"] or r["seq"] != whole[k - 1]["seq"] + 1 or block[k] != block[k - 1] for k, r in enumerate(whole)]
            boxes, tasks = _merged(cfg, whole, values, held)
            boxes = dedup_runs(cfg, boxes, np.array(first))
            seqs = np.zeros(len(whole), _SEQS)
            for n in ("seq", "tiles", *_HEAD):
                seqs[n] = [r[n] for r in whole]
            seqs["lists"], seqs["held"], seqs["person_count"], seqs["tasks"] = [len(r["ids"]) for r in whole], held, np.diff(boxes.offsets), tasks
            plain = np.column_stack([boxes.cols[n] for n in _OUT]).astype(np.float64)
            starts = np.flatnonzero(first).tolist()
            for low, high in zip(starts, [*starts[1:], len(whole)]):
                part = whole[low:high]
                out.append({"camera": part[0]["camera"], "kind": "RUN", "seq": part[0]["seq"], "ids": [t for r in part for t in r["ids"]], "counts": [n for r in part for n in r["counts"]], "boxes": b"".join(r["boxes"] for r in part),
                            "seqs": seqs[low:high].tobytes(), "outs": plain[boxes.offsets[low]:boxes.offsets[high]].tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=_RUN_ARROW)


def _can_run(r: dict) -> bool:
    """Whether a PACKED row is all of a frame, and plain: nothing of it is null or no number, and one list at most is the whole frame's."""
    if r["kind"] != "PART" or not r["head"] or r["tiles"] is None or r["tiles"] < 0 or any(r[n] is None for n in _HEAD):
        return False
    lists = sum(t >= 0 for t in r["ids"])
    return lists >= r["tiles"] and len(r["ids"]) - lists <= 1 and bool(np.isfinite(np.frombuffer(r["boxes"])).all())


def _merged(cfg: DetectionConfig, whole: list[dict], values: np.ndarray, held: np.ndarray) -> tuple[folds.Frames, np.ndarray]:
    """The merged boxes of frames, and their tasks."""
    width, height = (np.array([r[n] for r in whole], np.int64) for n in ("width", "height"))
    anchor = np.repeat(np.array([t < 0 for r in whole for t in r["ids"]], bool), np.array([n for r in whole for n in r["counts"]], np.int64))
    cols = {n: values[:, _FIELDS.index(n)].astype(np.int64 if n in _WHOLE else np.float64) for n in folds.NAMES}
    every = folds.Frames(cols, np.concatenate([[0], np.cumsum(held)]), width, height)
    tiles, anchors = every.taken(np.flatnonzero(~anchor)), every.taken(np.flatnonzero(anchor))
    boxes, tasks = folds.with_anchors(cfg, tiles, anchors)
    if cfg.live_anchor_full_frame and cfg.live_anchor_policy == "anchor-gate":  # anchors may have tiles here, and so be dropped by ownership
        tasks = np.where(np.diff(folds.merged(cfg, anchors).offsets) > 0, 1, cfg.grid[0] * cfg.grid[1])
    return boxes, tasks


def _of_run(r: Row) -> Iterator[Row]:
    """The PART rows that a RUN row is made of."""
    lists = boxes = 0
    for f in np.frombuffer(r.seqs, _SEQS):
        head = {n: f[n].item() for n in ("seq", "tiles", *_HEAD)}
        yield Row(camera=r.camera, kind="PART", head=True, **head, ids=r.ids[lists:lists + f["lists"]], counts=r.counts[lists:lists + f["lists"]], boxes=r.boxes[boxes:boxes + f["held"] * _SIZE])
        lists, boxes = lists + int(f["lists"]), boxes + int(f["held"]) * _SIZE


def _parts(ids: list[int], counts: list[int], boxes: bytes) -> Iterator[tuple[int, list[dict]]]:
    """(tile, boxes) of a PART row."""
    values, at = np.frombuffer(boxes).reshape(-1, len(_FIELDS)).tolist(), 0
    for tile, n in zip(ids, counts):
        found = [dict(zip(_FIELDS, v)) for v in values[at:at + n]]
        for b in found:
            b.update((f, int(b[f])) for f in _WHOLE)
        yield tile, found
        at += n


def _out_bytes(boxes: list[dict]) -> bytes:
    """Boxes as an event has them."""
    return np.array([[b[f] for f in _OUT] for b in boxes], np.float64).tobytes()


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """EVENT rows of PACKED_EVENT rows."""
    for batch in batches:
        run = batch.column("seqs").is_valid()
        lone, many = batch.filter(pc.invert(run)), batch.filter(run)
        texts = lone.column("boxes").to_pylist()
        yield _events(lone.columns[:-2], [len(t) // (8 * len(_OUT)) for t in texts], b"".join(texts), lone.schema.names[:-2])
        if len(many):
            parts = [np.frombuffer(t, _SEQS) for t in many.column("seqs").to_pylist()]
            seqs = np.concatenate(parts)
            kinds = {f.name: f.type for f in many.schema}
            columns = [many.column(n).take(pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))) if n in ("camera", "status") else pa.array(np.ascontiguousarray(seqs[n])).cast(kinds[n]) for n in many.schema.names[:-2]]
            yield _events(columns, seqs["person_count"], b"".join(many.column("boxes").to_pylist()), many.schema.names[:-2])


def _events(columns: list[pa.Array], sizes: list[int] | np.ndarray, boxes: bytes, names: list[str]) -> pa.RecordBatch:
    """EVENT rows of their plain columns and the numbers of their boxes."""
    fields = [pa.field(f, pa.int32() if f in _WHOLE else pa.float64()) for f in _OUT]
    values = np.frombuffer(boxes).reshape(-1, len(_OUT))
    found = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, k])).cast(f.type) for k, f in enumerate(fields)], fields=fields)
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), found)], [*names, "boxes"])


class Held:
    """What has come of a frame: its head, its tiles and whole-frame boxes, how many tiles it has (-1: unknown), and since when it waits."""

    __slots__ = ("anchors", "began", "head", "parts", "tiles")

    def __init__(self, began: int):
        self.head, self.tiles, self.began, self.anchors, self.parts = None, -1, began, [], {}

    def whole(self) -> bool:
        return self.head is not None and self.tiles >= 0 and len(self.parts) >= self.tiles


class FrameProcessor(StatefulProcessor):
    """State of a camera: the last frame that is done and its boxes; of frames that wait, heads and tiles."""

    def __init__(self, cfg: DetectionConfig, hold_ms: int):
        self.cfg, self.hold_ms = cfg, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "seq bigint")
        self.before = handle.getListState("before", "neg_conf double, tile_id int, x1 double, y1 double, x2 double, y2 double, conf double, rank int, box_class int")
        self.heads = handle.getMapState("heads", "seq bigint", "frame_id int, width int, height int, captured_ms double, capture_ms double, tiles int, began bigint")
        self.parts = handle.getMapState("parts", "seq bigint, tile_id int", "neg_conf array<double>, box_tile array<int>, x1 array<double>, y1 array<double>, x2 array<double>, y2 array<double>, conf array<double>, rank array<int>, box_class array<int>")

    def close(self) -> None:
        pass

    def _load(self) -> dict[int, Held]:
        waiting: dict[int, Held] = {}
        for (seq,), (frame_id, width, height, captured, capture, tiles, began) in self.heads.iterator():
            held = waiting[seq] = Held(began)
            held.head = None if frame_id is None else (frame_id, width, height, captured, capture)
            held.tiles = tiles
        for (seq, tile), columns in self.parts.iterator():
            boxes = [dict(zip(_FIELDS, b)) for b in zip(*columns)]
            if tile < 0:
                waiting[seq].anchors = boxes
            else:
                waiting[seq].parts[tile] = boxes
        return waiting

    def _store(self, waiting: dict[int, Held]) -> None:
        self.heads.clear()
        self.parts.clear()
        for seq, held in waiting.items():
            self.heads.updateValue((seq,), (*(held.head or (None,) * 5), held.tiles, held.began))
            for tile, boxes in [(-1, held.anchors), *held.parts.items()]:
                if boxes or tile >= 0:
                    self.parts.updateValue((seq, tile), tuple([b[f] for b in boxes] for f in _FIELDS))

    @staticmethod
    def _take(held: Held, r: Row) -> None:
        """A row of a frame joins what has come of it."""
        if r.kind == "PART":
            if r.head:
                held.head = (r.frame_id, r.width, r.height, r.captured_ms, r.capture_ms)
            for tile, boxes in _parts(r.ids, r.counts, r.boxes):
                if tile < 0:
                    held.anchors = boxes
                else:
                    held.parts[tile] = boxes
            if r.tiles is not None:
                held.tiles = r.tiles
        elif r.kind == "FRAME":
            held.head, held.anchors = (r.frame_id, r.width, r.height, r.captured_ms, r.capture_ms), _plain(r.boxes)
        elif r.kind == "TILE":
            held.parts[r.tile_id] = _plain(r.boxes)
        elif r.kind == "END_FRAME":
            held.tiles = r.tiles

    @staticmethod
    def _lone_runs(rows: list[Row], waiting: dict[int, Held], done: int | None) -> Iterator[Row]:
        """The rows as they came, but RUN rows with a frame that other rows have too, or that may be done, as their PART rows."""
        least = max((r.seq for r in rows if r.kind == "READY"), default=0) if done is None else done + 1
        seen, twice = set(waiting), set()
        for r in rows:
            if r.kind not in ("READY", "END_STREAM"):
                seqs = np.frombuffer(r.seqs, _SEQS)["seq"].tolist() if r.kind == "RUN" else [r.seq]
                twice.update(seen.intersection(seqs))
                seen.update(seqs)
        for r in rows:
            if r.kind == "RUN" and (r.seq < least or not twice.isdisjoint(np.frombuffer(r.seqs, _SEQS)["seq"].tolist())):
                yield from _of_run(r)
            else:
                yield r

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        waiting = self._load()
        done = self.done.get()[0] if self.done.exists() else None
        late, ready, ended = {}, {}, False
        for r in self._lone_runs(list(rows), waiting, done):
            if r.kind == "READY":
                done = r.seq - 1 if done is None else done
            elif r.kind == "END_STREAM":
                ended = True
            elif r.kind == "RUN":
                ready[r.seq] = r
            elif done is not None and r.seq <= done:
                late[r.seq] = r.frame_id
            else:
                self._take(waiting.setdefault(r.seq, Held(int(now))), r)
        for seq in sorted(late):
            yield Row(camera=key[0], seq=seq, frame_id=late[seq], width=None, height=None, person_count=None, tasks=None, capture_ms=None, latency_ms=None, status="late", boxes=b"", seqs=None)
        yield from self._released(key[0], waiting, done, now, ended, ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._released(key[0], self._load(), self.done.get()[0] if self.done.exists() else None, timerValues.getCurrentProcessingTimeInMs(), False, {})

    def _folded_run(self, r: Row, before: list[dict]) -> tuple[np.ndarray, bytes, list[dict]]:
        """The frames and boxes of a RUN after the boxes ``before``, and the boxes of its last frame."""
        frames = np.frombuffer(r.seqs, _SEQS).copy()
        ends = np.concatenate([[0], np.cumsum(frames["person_count"])]) * (8 * len(_OUT))
        new = []
        for k, part in enumerate(_of_run(r)):
            held = Held(0)
            self._take(held, part)
            boxes, _ = merged_boxes(self.cfg, [b for t in sorted(held.parts) for b in held.parts[t]], held.anchors, part.width, part.height)
            before = dedup(self.cfg, boxes, before, part.width, part.height)
            out = _out_bytes(before)
            if out == r.outs[ends[k]:ends[k + 1]]:  # all that follows is right
                last = np.frombuffer(r.outs[ends[-2]:]).reshape(-1, len(_OUT)).tolist()
                before = [{**dict(zip(_OUT, v)), "neg_conf": -v[_OUT.index("conf")], **{f: int(v[_OUT.index(f)]) for f in _WHOLE}} for v in last]
                return frames, b"".join([*new, r.outs[ends[k]:]]), before
            new.append(out)
            frames["person_count"][k] = len(before)
        return frames, b"".join(new), before

    def _released(self, camera: str | None, waiting: dict[int, Held], done: int | None, now: float, ended: bool, ready: dict[int, Row]) -> Iterator[Row]:
        before = None
        for seq in sorted([*waiting, *ready]):
            held, run = waiting.get(seq), ready.get(seq)
            next_ = seq == (-1 if done is None else done) + 1
            if not (ended or (next_ and (run or held.whole())) or now - (now if run else held.began) >= self.hold_ms):
                break
            before = [dict(zip(_FIELDS, b)) for b in self.before.get()] if before is None and self.before.exists() else before or []
            if run:
                frames, boxes, before = self._folded_run(run, before)
                frames["latency_ms"] = time.time() * 1000 - frames["captured_ms"]
                yield Row(camera=camera, seq=seq, frame_id=None, width=None, height=None, person_count=None, tasks=None, capture_ms=None, latency_ms=None, status="whole", boxes=boxes, seqs=frames.tobytes())
                done = int(frames["seq"][-1])
                del ready[seq]
                continue
            frame_id, width, height, captured, capture = held.head or (None, self.cfg.width, self.cfg.height, None, None)
            boxes, tasks = merged_boxes(self.cfg, [b for t in sorted(held.parts) for b in held.parts[t]], held.anchors, width, height)
            before = dedup(self.cfg, boxes, before, width, height)
            latency = None if captured is None else time.time() * 1000 - captured
            yield Row(camera=camera, seq=seq, frame_id=frame_id, width=width, height=height, person_count=len(before), tasks=tasks, capture_ms=capture, latency_ms=latency,
                      status="whole" if held.whole() else "partial", boxes=_out_bytes(before), seqs=None)
            done = seq
            del waiting[seq]
        if done is not None:
            self.done.update((done,))
        if before is not None:
            self.before.clear()
            if before:
                self.before.put([tuple(-b["conf"] if f == "neg_conf" else b[f] for f in _FIELDS) for b in before])
        for run in ready.values():
            for r in _of_run(run):
                self._take(waiting.setdefault(r.seq, Held(int(now))), r)
        self._store(waiting)
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if waiting:
            self.handle.registerTimer(int(max(now + 1, min(h.began for h in waiting.values()) + self.hold_ms)))


def decoded_boxes() -> Column:
    """The boxes that a recording's image shows, from its JSON."""
    return F.from_json(F.decode("image", "UTF-8"), f"array<{BOX}>")


def decoded(lines: DataFrame, decode: Column | None = None) -> DataFrame:
    """The detector step: protocol rows with ``boxes`` in place of images; ``decode`` makes an array of boxes of an image, by default ``decoded_boxes``."""
    boxes = F.when(F.col("kind").isin("FRAME", "TILE"), decoded_boxes() if decode is None else decode)
    return lines.select("camera", "kind", "seq", "frame_id", "width", "height", "captured_ms", "capture_ms", "tile_id", "tiles", boxes.alias("boxes"))


def live_frames(cfg: DetectionConfig, found: DataFrame, hold_ms: int = 10_000) -> DataFrame:
    """EVENT rows, as a stream, from a stream of ``decoded`` rows. The session's state store must be ``PROVIDER``."""
    events = found.mapInArrow(lambda batches: runs(cfg, packed(batches)), RUNS).groupBy("camera").transformWithState(FrameProcessor(cfg, hold_ms), PACKED_EVENT, "append", "ProcessingTime")
    return events.mapInArrow(unpacked, EVENT)


def protocol_rows(frames: DataFrame, cameras: int = 1) -> DataFrame:
    """The rows that a camera sends for frames with nested boxes (``live.FRAME``), boxes in place of images; frame f is the (f div ``cameras``)-th of its camera."""
    head = ["camera", F.floor(F.col("frame_id") / cameras).alias("seq"), "frame_id", F.col("frame_width").alias("width"), F.col("frame_height").alias("height"), (F.unix_micros(F.current_timestamp()) / 1000).alias("captured_ms"), "capture_ms"]
    ids = F.array_sort(F.array_distinct(F.transform("tiles", lambda b: b["tile_id"])))
    row = lambda kind, tile, tiles, boxes: F.struct(F.lit(kind).alias("kind"), tile.cast("int").alias("tile_id"), tiles.cast("int").alias("tiles"), boxes.alias("boxes"))
    null = F.lit(None)
    of_tiles = F.transform(ids, lambda t: row("TILE", t, null, F.filter("tiles", lambda b: b["tile_id"] == t)))
    rows = F.concat(F.array(row("FRAME", null, null, F.col("anchors"))), of_tiles, F.array(row("END_FRAME", null, F.size(ids), null.cast(f"array<{BOX}>"))))
    out = frames.select(*head, F.explode(rows).alias("r")).select("camera", "seq", "frame_id", "width", "height", "captured_ms", "capture_ms", "r.*")
    return out.select("camera", "kind", "seq", "frame_id", "width", "height", "captured_ms", "capture_ms", "tile_id", "tiles", "boxes")


@contextmanager
def typed_state(spark: SparkSession, cameras: int | None = None) -> Iterator[None]:
    """Settings under which streaming queries with ``live_frames`` start; the session's own come back afterwards.

    Without batches for timers alone, a replay that has read all its frames stands still, and its caller can tell.
    Of about ``cameras`` cameras, the state has at most twice as many tasks: a task without a camera costs as much
    as one with it, in every batch.
    """
    names = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    if cameras:
        names["spark.sql.shuffle.partitions"] = str(min(2 * cameras, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_through(writer) -> None:
    """Start a stream writer, let it process all that its sources have, batch by batch, and stop it."""
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
