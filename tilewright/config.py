"""Settings of the two dataflows, checked before any plan is built (F1)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


def truth(text: str) -> bool:
    """Booleans as the tools write them: 1, true, TRUE and yes; everything else is false."""
    return text in ("1", "true", "TRUE", "yes")


@dataclass(frozen=True)
class DetectionConfig:
    """Tiled detection: frames, tiles, duplicate rules, scheduling and live mode."""

    tile_grid: str = "1x1"
    overlap: int = 64
    width: int = 1280
    height: int = 720
    frames: int = 20
    start_frame: int = 0
    conf: float = 0.35
    iou: float = 0.50
    tile_owner_filter: bool = True
    duplicate_ios: float = 0.70
    duplicate_center: float = 0.30
    duplicate_axis_overlap: float = 0.70
    duplicate_gap: float = 0.08
    duplicate_near_camera: bool = False
    duplicate_large_area_ratio: float = 0.12
    duplicate_merge: bool = True
    schedule: str = "static"
    chunk_size: int = 1
    master_compute: bool = True
    detector: str = "mock"
    detector_command: str = ""
    sleep_ms: int = 0
    live: bool = False
    live_anchor_full_frame: bool = False
    live_anchor_policy: str = "merge"
    live_temporal_dedup: bool = False
    live_temporal_center: float = 0.55
    live_temporal_ios: float = 0.35
    grid: tuple[int, int] = field(init=False, default=(1, 1))

    def __post_init__(self) -> None:
        match = re.fullmatch(r"(\d+)[xX](\d+)", self.tile_grid)
        if not match or 0 in (int(match[1]), int(match[2])):
            raise ValueError(f"tile_grid must be COLSxROWS, both positive: {self.tile_grid}")
        object.__setattr__(self, "grid", (int(match[1]), int(match[2])))
        if min(self.frames, self.width, self.height, self.chunk_size) <= 0:
            raise ValueError("frames, width, height and chunk_size must be positive")
        if self.schedule not in ("static", "dynamic"):
            raise ValueError("schedule must be static or dynamic")
        if self.detector not in ("mock", "worker", "command"):
            raise ValueError("detector must be mock, worker or command")
        if self.detector == "command" and not self.detector_command:
            raise ValueError("detector command needs detector_command")
        if self.live and self.detector == "command":
            raise ValueError("live mode takes the mock or the worker detector")
        if self.live_anchor_policy not in ("merge", "anchor-gate", "anchor-only"):
            raise ValueError("live_anchor_policy must be merge, anchor-gate or anchor-only")
        shares = (self.iou, self.duplicate_ios, self.duplicate_axis_overlap, self.live_temporal_ios)
        if any(not 0 <= x <= 1 for x in shares) or min(self.duplicate_center, self.duplicate_gap, self.duplicate_large_area_ratio, self.live_temporal_center) < 0:
            raise ValueError("a duplicate or temporal threshold is out of range")


@dataclass(frozen=True)
class ConvConfig:
    """Block-partitioned convolution stack."""

    height: int = 32
    width: int = 32
    profile: str = "tiny"
    processes: int = 1
    grid: str = "auto"
    halo_mode: str = "blocking"
    repeats: int = 1

    def __post_init__(self) -> None:
        if min(self.height, self.width, self.processes) <= 0:
            raise ValueError("height, width and processes must be positive")
        if self.halo_mode not in ("blocking", "nonblocking"):
            raise ValueError("halo_mode must be blocking or nonblocking")
        if self.profile not in ("tiny", "small", "full"):
            raise ValueError("profile must be tiny, small or full")
