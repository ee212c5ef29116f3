"""A9, L2, L4 on batches of frames: the suppression of many frames at once on padded arrays.

A batch has flat columns of boxes and the offsets of its frames. Frames of about one size are put side by
side; the k-th boxes of all of them meet the boxes kept so far in one step, so a batch takes as many steps
as its largest frame has boxes. A frame of more than ``CROWD`` boxes is folded by itself with an index
of cells: a box meets only kept boxes whose cells it touches (with near-camera rules, cells within the
rules' reach), so the work grows with the boxes and not with their square. The rules are those of
``functions.geometry``; tests hold both folds against the columns.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from tilewright.config import DetectionConfig
from tilewright.functions.boxes import EPS, around, same_object

FLOATS = ("x1", "y1", "x2", "y2", "conf")
INTS = ("tile_id", "rank", "cls")
NAMES = FLOATS + INTS
CROWD = 2_000
#: Padded values of a step at most, as frames x kept boxes.
STEP = 1 << 20


class Frames:
    """Boxes of frames: ``cols`` by name, flat, and ``offsets``; with each frame's width and height."""

    def __init__(self, cols: dict[str, np.ndarray], offsets: np.ndarray, width: np.ndarray, height: np.ndarray):
        self.cols, self.offsets, self.width, self.height = cols, offsets, width, height

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self) -> np.ndarray:
        """The frame of each box."""
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def taken(self, rows: np.ndarray) -> Frames:
        """Only these boxes, in the same frames; ``rows`` go by frame."""
        counts = np.bincount(self.of()[rows], minlength=len(self))
        return Frames({k: v[rows] for k, v in self.cols.items()}, np.concatenate([[0], np.cumsum(counts)]), self.width, self.height)

    def parts(self) -> list[np.ndarray]:
        """The boxes of each frame, with NAMES as columns."""
        return np.split(np.column_stack([self.cols[k] for k in NAMES]).astype(np.float64), self.offsets[1:-1]) if len(self) else []

    @classmethod
    def of_parts(cls, parts: list[np.ndarray], width: np.ndarray, height: np.ndarray) -> Frames:
        """The opposite of ``parts``."""
        flat = np.concatenate([np.empty((0, len(NAMES))), *parts])
        cols = {n: flat[:, k].astype(np.float64 if n in FLOATS else np.int64) for k, n in enumerate(NAMES)}
        return cls(cols, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64), width, height)

    def joined(self, other: Frames) -> Frames:
        """The boxes of both, this one's first in each frame."""
        order = np.argsort(np.concatenate([self.of(), other.of()]), kind="stable")
        cols = {k: np.concatenate([self.cols[k], other.cols[k]])[order] for k in NAMES}
        return Frames(cols, self.offsets + other.offsets, self.width, self.height)


def from_arrow(boxes: pa.ListArray, width: np.ndarray, height: np.ndarray) -> Frames:
    """Frames of a list column of box structs; a null list has no boxes."""
    sizes = np.asarray(boxes.value_lengths().fill_null(0))
    flat = boxes.flatten()
    cols = {k: np.asarray(flat.field(k), np.float64 if k in FLOATS else np.int64) for k in NAMES} if len(flat) else {k: np.empty(0, np.float64 if k in FLOATS else np.int64) for k in NAMES}
    return Frames(cols, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), width, height)


def to_arrow(frames: Frames, kind: pa.ListType) -> pa.ListArray:
    """A list column of box structs of type ``kind``, neg_conf too if that has it."""
    fields = list(kind.value_type)
    cols = {**frames.cols, "neg_conf": -frames.cols["conf"]}
    return pa.ListArray.from_arrays(pa.array(frames.offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(cols[f.name]).cast(f.type) for f in fields], fields=fields)).cast(kind)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


def _side(b: dict, k: str) -> np.ndarray:
    return np.maximum(0.0, b[f"{k}2"] - b[f"{k}1"])


def _over(a: dict, b: dict, k: str) -> np.ndarray:
    return np.maximum(0.0, np.minimum(a[f"{k}2"], b[f"{k}2"]) - np.maximum(a[f"{k}1"], b[f"{k}1"]))


def duplicates(cfg: DetectionConfig, a: dict, b: dict, width: np.ndarray, height: np.ndarray) -> np.ndarray:
    """F3, F4 on arrays that broadcast."""
    wa, ha, wb, hb = _side(a, "x"), _side(a, "y"), _side(b, "x"), _side(b, "y")
    ox, oy = _over(a, b, "x"), _over(a, b, "y")
    both, area, other = ox * oy, wa * ha, wb * hb
    same = _ratio(both, area + other - both) >= cfg.iou
    if cfg.duplicate_ios > 0:
        same |= _ratio(both, np.minimum(area, other)) >= cfg.duplicate_ios
    if cfg.duplicate_near_camera:
        w, h = np.maximum(1, width), np.maximum(1, height)
        min_w, min_h, max_w, max_h = np.minimum(wa, wb), np.minimum(ha, hb), np.maximum(wa, wb), np.maximum(ha, hb)
        large = (np.maximum(area, other) / (w * h) >= cfg.duplicate_large_area_ratio) | (max_w / w >= 0.35) | (max_h / h >= 0.45)
        dx = _ratio(np.abs((a["x1"] + a["x2"]) * 0.5 - (b["x1"] + b["x2"]) * 0.5), max_w)
        dy = _ratio(np.abs((a["y1"] + a["y2"]) * 0.5 - (b["y1"] + b["y2"]) * 0.5), max_h)
        rx, ry = _ratio(ox, min_w), _ratio(oy, min_h)
        gx = _ratio(np.maximum(0.0, np.maximum(a["x1"], b["x1"]) - np.minimum(a["x2"], b["x2"])), min_w)
        gy = _ratio(np.maximum(0.0, np.maximum(a["y1"], b["y1"]) - np.minimum(a["y2"], b["y2"])), min_h)
        c, g, o = cfg.duplicate_center, cfg.duplicate_gap, cfg.duplicate_axis_overlap
        met = ((ry >= o) & (gx <= g) & (dy <= c)) | ((rx >= o) & (gy <= g) & (dx <= c)) | ((dx <= c) & (dy <= c) & ((rx > 0.05) | (ry > 0.05) | (gx <= g) | (gy <= g)))
        same |= (a["tile_id"] != b["tile_id"]) & (min_w > 0) & (min_h > 0) & large & met
    return (a["cls"] == b["cls"]) & same


def temporal(cfg: DetectionConfig, now: dict, before: dict) -> np.ndarray:
    """F5 on arrays that broadcast."""
    wa, ha, wb, hb = _side(now, "x"), _side(now, "y"), _side(before, "x"), _side(before, "y")
    ox, oy = _over(now, before, "x"), _over(now, before, "y")
    both, area, other = ox * oy, wa * ha, wb * hb
    same = (_ratio(both, area + other - both) >= 0.15) | (_ratio(both, np.minimum(area, other)) >= cfg.live_temporal_ios)
    w, h, far = np.maximum(wa, wb), np.maximum(ha, hb), cfg.live_temporal_center
    dx = _ratio(np.abs((now["x1"] + now["x2"]) / 2 - (before["x1"] + before["x2"]) / 2), w)
    dy = _ratio(np.abs((now["y1"] + now["y2"]) / 2 - (before["y1"] + before["y2"]) / 2), h)
    near = (w > 0) & (h > 0) & (dx <= far) & (dy <= far) & ((_ratio(ox, np.minimum(wa, wb)) > 0.10) | (_ratio(oy, np.minimum(ha, hb)) > 0.10))
    return (now["cls"] == before["cls"]) & (same | near)


def owned(cfg: DetectionConfig, frames: Frames) -> Frames:
    """the boxes whose centre lies in the core of their tile."""
    cols, rows = cfg.grid
    if not cfg.tile_owner_filter or cols * rows <= 1:
        return frames
    c, of = frames.cols, frames.of()
    tile = c["tile_id"]

    def inside(center: np.ndarray, k: np.ndarray, total: np.ndarray, parts: int) -> np.ndarray:
        low, high = np.floor(k * total / parts + 0.5), np.floor((k + 1) * total / parts + 0.5)
        return (center + EPS >= low) & np.where(k == parts - 1, center <= high + EPS, center < high - EPS)
    ok = inside((c["x1"] + c["x2"]) * 0.5, tile % cols, frames.width[of], cols) & inside((c["y1"] + c["y2"]) * 0.5, tile // cols, frames.height[of], rows)
    return frames.taken(np.flatnonzero((tile < 0) | (tile >= cols * rows) | ok))


def _grown(cfg: DetectionConfig, kept: dict[str, np.ndarray], at: tuple, new: dict[str, np.ndarray]) -> None:
    """Kept boxes ``at`` take in the new ones; ties go to the kept."""
    if not cfg.duplicate_merge:
        return
    sure = kept["conf"][at] >= new["conf"]
    for k in ("tile_id", "rank", "cls", "conf"):
        kept[k][at] = np.where(sure, kept[k][at], new[k])
    for k in ("x1", "y1"):
        kept[k][at] = np.minimum(kept[k][at], new[k])
    for k in ("x2", "y2"):
        kept[k][at] = np.maximum(kept[k][at], new[k])


def suppressed(cfg: DetectionConfig, frames: Frames) -> Frames:
    """A9, T1, T2 of every frame."""
    c, of = frames.cols, frames.of()
    # as the columns sort them: by neg_conf, tile_id, x1, y1, x2, y2, conf, rank, cls
    order = np.lexsort((c["cls"], c["rank"], c["y2"], c["x2"], c["y1"], c["x1"], c["tile_id"], -c["conf"], of))
    c = {k: v[order] for k, v in c.items()}
    sizes = np.diff(frames.offsets)
    parts: list[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]] = []
    by_size = [f for f in np.argsort(sizes, kind="stable") if sizes[f]]
    at = 0
    while at < len(by_size):
        first, n = at, 0
        while at < len(by_size):
            n = max(1, int(sizes[by_size[at]]))
            if at > first and (n > CROWD or (at - first + 1) * n > STEP):
                break
            at += 1
            if n > CROWD:
                break
        group = np.array(by_size[first:at])
        parts.append(_crowd(cfg, c, frames, int(group[0])) if sizes[group[-1]] > CROWD else _side_by_side(cfg, c, frames, group, sizes[group]))
    if not parts:
        return frames.taken(np.empty(0, np.int64))
    of, place = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((place, of))
    cols = {k: np.concatenate([p[2][k] for p in parts])[order] for k in NAMES}
    return Frames(cols, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(frames)))]), frames.width, frames.height)


def _side_by_side(cfg: DetectionConfig, c: dict[str, np.ndarray], frames: Frames, group: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(frame, place, columns) of the boxes kept in the frames ``group``, whose sizes rise."""
    n, starts = int(sizes[-1]), frames.offsets[group]
    kept = {k: np.zeros((len(group), n), v.dtype) for k, v in c.items()}
    count = np.zeros(len(group), np.int64)
    width, height = frames.width[group][:, None], frames.height[group][:, None]
    for step in range(n):
        live = np.arange(np.searchsorted(sizes, step, side="right"), len(group))  # frames that have such a box
        new = {k: v[starts[live] + step] for k, v in c.items()}
        most = int(count[live].max())
        hit = np.zeros(len(live), bool)
        if most:
            seen = {k: v[live, :most] for k, v in kept.items()}
            match = duplicates(cfg, {k: v[:, None] for k, v in new.items()}, seen, width[live], height[live]) & (np.arange(most) < count[live][:, None])
            hit = match.any(axis=1)
            spot = (live[hit], match.argmax(axis=1)[hit])
            _grown(cfg, kept, spot, {k: v[hit] for k, v in new.items()})
        fresh = live[~hit]
        for k, v in kept.items():
            v[fresh, count[fresh]] = new[k][~hit]
        count[fresh] += 1
    row = np.repeat(np.arange(len(group)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return group[row], place, {k: v[row, place] for k, v in kept.items()}


def _crowd(cfg: DetectionConfig, c: dict[str, np.ndarray], frames: Frames, frame: int) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The same of one crowded frame, with an index of the kept boxes' cells.

    A box can only duplicate a kept box that it overlaps (or, near the camera, one within a share of either's sides), since all
    thresholds are above 0; cells are about as large as the boxes. Without such a bound the frame is one cell.
    """
    rows = slice(int(frames.offsets[frame]), int(frames.offsets[frame + 1]))
    lists = {k: v[rows].tolist() for k, v in c.items()}
    boxes = [dict(zip(lists, values)) for values in zip(*lists.values())]
    width, height = int(frames.width[frame]), int(frames.height[frame])
    indexed = cfg.iou > 0
    cell = max(1.0, float(np.median([max(b["x2"] - b["x1"], b["y2"] - b["y1"], 0.0) for b in boxes])))
    reach = max(cfg.duplicate_gap, cfg.duplicate_center) if cfg.duplicate_near_camera else 0.0

    def cells(b: dict) -> list[tuple[int, int]] | None:
        """The cells within a box's reach; None for a box that is so large that it is compared with all."""
        if not indexed:
            return None
        mx, my = reach * max(0.0, b["x2"] - b["x1"]), reach * max(0.0, b["y2"] - b["y1"])
        xs = range(math.floor((min(b["x1"], b["x2"]) - mx) / cell), math.floor((max(b["x1"], b["x2"]) + mx) / cell) + 1)
        ys = range(math.floor((min(b["y1"], b["y2"]) - my) / cell), math.floor((max(b["y1"], b["y2"]) + my) / cell) + 1)
        return [(x, y) for x in xs for y in ys] if len(xs) * len(ys) <= 1024 else None

    kept: list[dict] = []
    index: dict[tuple[int, int], list[int]] = {}
    held: list[set] = []
    large: set[int] = set()
    for new in boxes:
        spots = cells(new)
        near = range(len(kept)) if spots is None else sorted(large.union(*(index.get(spot, ()) for spot in spots)))
        at = next((k for k in near if same_object(cfg, new, kept[k], width, height)), None)
        if at is None:
            at = len(kept)
            kept.append(new)
            held.append(set())
        elif cfg.duplicate_merge:
            kept[at] = around(kept[at], new)
        else:
            continue
        spots = cells(kept[at])
        if spots is None:
            large.add(at)
        for spot in spots or ():
            if spot not in held[at]:
                held[at].add(spot)
                index.setdefault(spot, []).append(at)
    return np.full(len(kept), frame), np.arange(len(kept)), {k: np.array([b[k] for b in kept], c[k].dtype) for k in NAMES}


def merged(cfg: DetectionConfig, frames: Frames) -> Frames:
    """L2: ownership, then suppression."""
    return suppressed(cfg, owned(cfg, frames))


def with_anchors(cfg: DetectionConfig, tiles: Frames, anchors: Frames) -> tuple[Frames, np.ndarray]:
    """The merged boxes of every frame under the anchor policy, and its tasks."""
    whole = np.full(len(tiles), cfg.grid[0] * cfg.grid[1])
    if not cfg.live_anchor_full_frame:
        return merged(cfg, tiles), whole
    found = merged(cfg, anchors)
    if cfg.live_anchor_policy == "anchor-only":
        return merged(cfg, found), np.ones(len(tiles), np.int64)
    own = merged(cfg, tiles)
    if cfg.live_anchor_policy == "anchor-gate":
        first = np.diff(found.offsets) > 0
        chosen = found.joined(own.taken(np.flatnonzero(~first[own.of()])))
        # tasks follow the anchors that were found before merging, as ownership drops none of them
        return merged(cfg, chosen), np.where(np.diff(anchors.offsets) > 0, 1, whole)
    return merged(cfg, found.joined(own.taken(np.flatnonzero(~_covered(cfg, own, found))))), whole


def dedup(cfg: DetectionConfig, now: list[np.ndarray], before: list[np.ndarray], width: np.ndarray, height: np.ndarray) -> list[np.ndarray]:
    """A10 of frames (``Frames.parts``), each with the boxes of its frame before: boxes that match one box before are one, then suppression; side by side, in steps over the boxes before."""
    out = list(now)
    rows = [k for k, (a, b) in enumerate(zip(now, before)) if len(a) > 1 and len(b)]
    rows.sort(key=lambda k: len(now[k]) * len(before[k]))
    at = 0
    while at < len(rows):
        first, most, wide = at, 0, 0
        while at < len(rows):
            most, wide = max(most, len(before[rows[at]])), max(wide, len(now[rows[at]]))
            if at > first and (at - first + 1) * most * wide > STEP // 4:
                break
            at += 1
        group = np.array(rows[first:at])
        wide, high = (np.where(v[group] == 0, least, v[group]) for v, least in ((width, cfg.width), (height, cfg.height)))
        for k, boxes in zip(group, suppressed(cfg, _joined_by(cfg, [now[k] for k in group], [before[k] for k in group], wide, high)).parts()):
            out[k] = boxes
    return out


def _joined_by(cfg: DetectionConfig, now: list[np.ndarray], before: list[np.ndarray], width: np.ndarray, height: np.ndarray) -> Frames:
    """The boxes ``now`` of every frame, those that match one box before as one; each is used once, in order of the boxes before."""
    def padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in parts])
        there = np.arange(sizes.max()) < sizes[:, None]
        values = np.zeros((*there.shape, len(NAMES)))
        values[there] = np.concatenate(parts)
        return values, there

    (boxes, free), (old, there) = padded(now), padded(before)
    match = temporal(cfg, {n: boxes[:, None, :, k] for k, n in enumerate(NAMES)}, {n: old[:, :, None, k] for k, n in enumerate(NAMES)}) & there[:, :, None]
    of, made = [], []
    for k in range(old.shape[1]):
        found = match[:, k] & free
        hit = np.flatnonzero(found.sum(axis=1) > 1)
        if len(hit):
            found, some = found[hit], boxes[hit]
            one = some[np.arange(len(hit)), np.where(found, some[:, :, NAMES.index("conf")], -np.inf).argmax(axis=1)]
            for n, pick, none in (("x1", np.min, np.inf), ("y1", np.min, np.inf), ("x2", np.max, -np.inf), ("y2", np.max, -np.inf)):
                one[:, NAMES.index(n)] = pick(np.where(found, some[:, :, NAMES.index(n)], none), axis=1)
            free[hit] &= ~found
            of.append(hit)
            made.append(one)
    of, made = np.concatenate([*of, np.nonzero(free)[0]]), np.concatenate([*made, boxes[free]])
    made = made[np.argsort(of, kind="stable")]
    return Frames.of_parts(np.split(made, np.cumsum(np.bincount(of, minlength=len(now)))[:-1]), width, height)


def _covered(cfg: DetectionConfig, tiles: Frames, anchors: Frames) -> np.ndarray:
    """Whether any anchor of its frame is a duplicate of a tile box, in steps over the anchors of the frames."""
    of, out = tiles.of(), np.zeros(len(tiles.cols["conf"]), bool)
    counts = np.diff(anchors.offsets)[of]
    for k in range(int(counts.max(initial=0))):
        rows = np.flatnonzero((counts > k) & ~out)
        a = {n: v[anchors.offsets[of[rows]] + k] for n, v in anchors.cols.items()}
        out[rows] = duplicates(cfg, {n: v[rows] for n, v in tiles.cols.items()}, a, tiles.width[of[rows]], tiles.height[of[rows]])
    return out
