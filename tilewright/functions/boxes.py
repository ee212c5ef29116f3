"""The duplicate rules on plain boxes (dicts), for folds over the few boxes of a frame; a test holds them against ``functions.geometry``."""

from __future__ import annotations

import math

from tilewright.config import DetectionConfig

EPS = 1e-6


def _area(b: dict) -> float:
    return max(0.0, b["x2"] - b["x1"]) * max(0.0, b["y2"] - b["y1"])


def _span(lo: float, hi: float, lo2: float, hi2: float) -> float:
    return max(0.0, min(hi, hi2) - max(lo, lo2))


def _overlaps(a: dict, b: dict) -> tuple[float, float]:
    """Intersection over union and over the smaller area."""
    both = _span(a["x1"], a["x2"], b["x1"], b["x2"]) * _span(a["y1"], a["y2"], b["y1"], b["y2"])
    union, small = _area(a) + _area(b) - both, min(_area(a), _area(b))
    return both / union if union > 0 else 0.0, both / small if small > 0 else 0.0


def matches(cfg: DetectionConfig, now: dict, before: dict) -> bool:
    """F5 on plain boxes."""
    if now["cls"] != before["cls"]:
        return False
    ax1, ay1, ax2, ay2, bx1, by1, bx2, by2 = now["x1"], now["y1"], now["x2"], now["y2"], before["x1"], before["y1"], before["x2"], before["y2"]
    aw, ah, bw, bh = max(0.0, ax2 - ax1), max(0.0, ay2 - ay1), max(0.0, bx2 - bx1), max(0.0, by2 - by1)
    ox, oy = max(0.0, min(ax2, bx2) - max(ax1, bx1)), max(0.0, min(ay2, by2) - max(ay1, by1))
    both = ox * oy
    union, small = aw * ah + bw * bh - both, min(aw * ah, bw * bh)
    if union > 0 and both / union >= 0.15 or (both / small if small > 0 else 0.0) >= cfg.live_temporal_ios:
        return True
    w, h, far = max(aw, bw), max(ah, bh), cfg.live_temporal_center
    if w <= 0 or h <= 0 or abs((ax1 + ax2) / 2 - (bx1 + bx2) / 2) / w > far or abs((ay1 + ay2) / 2 - (by1 + by2) / 2) / h > far:
        return False
    narrow, low = min(aw, bw), min(ah, bh)
    return (narrow > 0 and ox / narrow > 0.10) or (low > 0 and oy / low > 0.10)


def around(a: dict, b: dict) -> dict:
    sure = a if a["conf"] >= b["conf"] else b
    return {**sure, "x1": min(a["x1"], b["x1"]), "y1": min(a["y1"], b["y1"]), "x2": max(a["x2"], b["x2"]), "y2": max(a["y2"], b["y2"])}


def near_camera(cfg: DetectionConfig, a: dict, b: dict, width: int, height: int) -> bool:
    """F3 on plain boxes."""
    if not cfg.duplicate_near_camera or a["tile_id"] == b["tile_id"]:
        return False
    sides = {k: [max(0.0, x[f"{k}2"] - x[f"{k}1"]) for x in (a, b)] for k in "xy"}
    if min(sides["x"]) <= 0 or min(sides["y"]) <= 0:
        return False
    width, height = max(1, width), max(1, height)
    if max(_area(a), _area(b)) / (width * height) < cfg.duplicate_large_area_ratio and max(sides["x"]) / width < 0.35 and max(sides["y"]) / height < 0.45:
        return False
    shared, gap, apart = {}, {}, {}
    for k in "xy":
        lo, hi = f"{k}1", f"{k}2"
        shared[k] = _span(a[lo], a[hi], b[lo], b[hi]) / min(sides[k])
        gap[k] = max(0.0, max(a[lo], b[lo]) - min(a[hi], b[hi])) / min(sides[k])
        apart[k] = abs((a[lo] + a[hi]) * 0.5 - (b[lo] + b[hi]) * 0.5) / max(sides[k])
    center, most, least = cfg.duplicate_center, cfg.duplicate_gap, cfg.duplicate_axis_overlap
    for along, across in ("yx", "xy"):
        if shared[along] >= least and gap[across] <= most and apart[along] <= center:
            return True
    return max(apart.values()) <= center and (max(shared.values()) > 0.05 or min(gap.values()) <= most)


def same_object(cfg: DetectionConfig, a: dict, b: dict, width: int, height: int) -> bool:
    """F4 on plain boxes."""
    if a["cls"] != b["cls"]:
        return False
    if cfg.iou > 0 and not cfg.duplicate_near_camera and (min(a["x2"], b["x2"]) <= max(a["x1"], b["x1"]) or min(a["y2"], b["y2"]) <= max(a["y1"], b["y1"])):
        return False  # no common area
    union, small = _overlaps(a, b)
    return union >= cfg.iou or (cfg.duplicate_ios > 0 and small >= cfg.duplicate_ios) or near_camera(cfg, a, b, width, height)


def suppressed_boxes(cfg: DetectionConfig, boxes: list[dict], width: int, height: int) -> list[dict]:
    """A9, T1, T2 on the few boxes of one frame: by falling confidence, then tile and coordinates; each joins the first kept box that it duplicates, as that has grown."""
    kept: list[dict] = []
    for new in sorted(boxes, key=lambda b: (-b["conf"], b["tile_id"], b["x1"], b["y1"], b["x2"], b["y2"], b["rank"], b["cls"])):
        for k, old in enumerate(kept):
            if same_object(cfg, new, old, width, height):
                kept[k] = around(old, new) if cfg.duplicate_merge else old
                break
        else:
            kept.append(new)
    return kept


def owned(cfg: DetectionConfig, b: dict, width: int, height: int) -> bool:
    """F2, T7, T8 on a plain box."""
    cols, rows = cfg.grid
    tile = b["tile_id"]
    if not cfg.tile_owner_filter or cols * rows <= 1 or not 0 <= tile < cols * rows:
        return True

    def inside(center: float, k: int, total: int, parts: int) -> bool:
        low, high = math.floor(k * total / parts + 0.5), math.floor((k + 1) * total / parts + 0.5)
        return center + EPS >= low and (center <= high + EPS if k == parts - 1 else center < high - EPS)
    return inside((b["x1"] + b["x2"]) * 0.5, tile % cols, width, cols) and inside((b["y1"] + b["y2"]) * 0.5, tile // cols, height, rows)


def merged_boxes(cfg: DetectionConfig, tiles: list[dict], anchors: list[dict], width: int, height: int) -> tuple[list[dict], int]:
    """L2, L4, L5 on the boxes of one frame: what ``operators.duplicates`` makes of its tiles and its anchors, and the tasks that took."""
    def merge(boxes: list[dict]) -> list[dict]:
        return suppressed_boxes(cfg, [b for b in boxes if owned(cfg, b, width, height)], width, height)

    whole = cfg.grid[0] * cfg.grid[1]
    if not cfg.live_anchor_full_frame:
        return merge(tiles), whole
    found, policy = merge(anchors), cfg.live_anchor_policy
    if policy == "anchor-only" or (policy == "anchor-gate" and found):
        return merge(found), 1
    own = merge(tiles)
    if policy == "anchor-gate":
        return merge(own), whole
    return merge(found + [t for t in own if not any(same_object(cfg, t, a, width, height) for a in found)]), whole
