"""Parts of a block's boxes that never meet, on flat arrays for all blocks of a batch; a block's boxes have its number.

Two boxes can only meet where their reaches overlap: a reach is the box itself, wider with near-camera rules by
the share of its sides that those rules allow. Pairs are found in cells as ``operators.duplicates`` does it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from tilewright.config import DetectionConfig
from tilewright.functions import folds

Reach = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Pairs that are held against the rules at once.
STEP = 1 << 20


def share(cfg: DetectionConfig) -> float:
    """How much of the smaller of two boxes they share at least, if they are duplicates by their overlap."""
    return min(cfg.iou, cfg.duplicate_ios) if cfg.duplicate_ios > 0 else cfg.iou


def reach(cfg: DetectionConfig, c: dict[str, np.ndarray]) -> Reach:
    by = max(cfg.duplicate_gap, cfg.duplicate_center) if cfg.duplicate_near_camera else 0.0
    mx, my = np.maximum(0.0, c["x2"] - c["x1"]) * by, np.maximum(0.0, c["y2"] - c["y1"]) * by
    return c["x1"] - mx, c["y1"] - my, np.maximum(c["x1"], c["x2"]) + mx, np.maximum(c["y1"], c["y2"]) + my


def area(c: dict[str, np.ndarray]) -> np.ndarray:
    return np.maximum(0.0, c["x2"] - c["x1"]) * np.maximum(0.0, c["y2"] - c["y1"])


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``labels`` (of each row a row of its part, the same for all of them) after the parts of rows ``a`` and ``b`` are joined."""
    labels = labels.copy()
    while len(a):
        one, two = labels[a], labels[b]
        apart = one != two
        a, b = a[apart], b[apart]
        np.minimum.at(labels, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def _cells(r: Reach, of: np.ndarray, rows: np.ndarray, edge: float) -> tuple[np.ndarray, ...]:
    """(key, row, x0, y0, cx, cy) of each cell of ``rows``; cells of one key may differ."""
    if np.isfinite(edge):
        x0, y0, xb, yb = (np.floor(v[rows] / edge).astype(np.int64) for v in r)
    else:
        x0 = y0 = xb = yb = np.zeros(len(rows), np.int64)
    high = yb - y0 + 1
    n = (xb - x0 + 1) * high
    k = np.repeat(np.arange(len(rows)), n)
    p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cx, cy = x0[k] + p // high[k], y0[k] + p % high[k]
    key = (of[rows][k] * 0x2545F4914F6CDD1D) ^ (cx * 0x1B873593CC9E2D51) ^ (cy * 0x5851F42D4C957F2D)
    return key, rows[k], x0[k], y0[k], cx, cy


def met(a: Reach, a_of: np.ndarray, b: Reach, b_of: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of ``a``, j of ``b``) of one block with overlapping reaches for which ``test`` holds, about STEP pairs at a time."""
    def levels(r: Reach) -> np.ndarray:
        return np.maximum(0.0, np.ceil(np.log2(np.maximum(1.0, np.maximum(r[2] - r[0], r[3] - r[1])))) - 5)

    la, lb = levels(a), levels(b)
    if not all(np.isfinite(v).all() for v in (*a, *b)):
        la, lb = np.full(len(la), np.inf), np.full(len(lb), np.inf)  # one cell
    for at in np.unique(np.concatenate([la, lb])):
        # the larger box of a pair is of this level
        for left, right in ((la == at, lb <= at), (la < at, lb == at)):
            ka, ia, *ca = _cells(a, a_of, np.flatnonzero(left), 2.0 ** (at + 5))
            kb, ib, *cb = _cells(b, b_of, np.flatnonzero(right), 2.0 ** (at + 5))
            order = np.argsort(kb, kind="stable")
            low = np.searchsorted(kb[order], ka, "left")
            n = np.searchsorted(kb[order], ka, "right") - low
            ends = np.cumsum(n)
            cuts = [0, *np.unique(np.searchsorted(ends, np.arange(STEP, ends[-1] if len(ends) else 0, STEP), "right") + 1).tolist(), len(ka)]
            for lo, hi in zip(cuts, cuts[1:]):
                some = n[lo:hi]
                p = np.repeat(np.arange(lo, hi), some)
                q = order[low[p] + np.arange(len(p)) - np.repeat(np.cumsum(some) - some, some)]
                # in the first cell that both have
                same = (ca[2][p] == cb[2][q]) & (ca[3][p] == cb[3][q]) & (ca[2][p] == np.maximum(ca[0][p], cb[0][q])) & (ca[3][p] == np.maximum(ca[1][p], cb[1][q]))
                i, j = ia[p[same]], ib[q[same]]
                same = a_of[i] == b_of[j]
                i, j = i[same], j[same]
                ok = test(i, j)
                if ok.any():
                    yield i[ok], j[ok]


def closed(cfg: DetectionConfig, c: dict[str, np.ndarray], of: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """(part of each box, kept boxes, their part) of boxes in blocks ``of``; a part is named by one of its rows.

    Parts are first what duplicate pairs (J5) join. Each is folded; where any state of a kept box could have taken in
    a box of another part, the two are joined and folded again, until there is no such pair.
    """
    def rows_of(cols: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
        return {k: v[at] for k, v in cols.items()}

    reaches, size = reach(cfg, c), area(c)
    labels = np.arange(len(of))

    def pair(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = (i < j) & (labels[i] != labels[j])
        ok[ok] = folds.duplicates(cfg, rows_of(c, i[ok]), rows_of(c, j[ok]), cfg.width, cfg.height)
        return ok

    for i, j in met(reaches, of, reaches, of, pair):
        labels = joined(labels, i, j)
    kept, part = rows_of(c, np.empty(0, np.int64)), np.empty(0, np.int64)
    new = np.ones(len(of), bool)
    while True:
        rows = np.flatnonzero(new)
        rows = rows[np.argsort(labels[rows], kind="stable")]
        parts, starts, counts = np.unique(labels[rows], return_index=True, return_counts=True)
        frames = folds.suppressed(cfg, folds.Frames(rows_of(c, rows), np.append(starts, len(rows)), np.full(len(parts), cfg.width), np.full(len(parts), cfg.height)))
        at = np.repeat(np.arange(len(parts)), np.diff(frames.offsets))
        least = np.minimum.reduceat(size[rows], starts)[at] if len(rows) else size
        still = ~new[part]
        kept, part = {k: np.concatenate([v[still], frames.cols[k]]) for k, v in kept.items()}, np.concatenate([part[still], parts[at]])

        def could(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            k, b = rows_of(frames.cols, i), rows_of(c, j)
            apart = labels[parts[at[i]]] != labels[j]
            if cfg.duplicate_near_camera:
                one, two = reach(cfg, k), reach(cfg, b)
                return apart & np.logical_and.reduce([one[0] <= two[2], two[0] <= one[2], one[1] <= two[3], two[1] <= one[3]])
            over = np.maximum(0.0, np.minimum(k["x2"], b["x2"]) - np.maximum(k["x1"], b["x1"])) * np.maximum(0.0, np.minimum(k["y2"], b["y2"]) - np.maximum(k["y1"], b["y1"]))
            # a kept box was never smaller than the part's smallest box, nor did it ever cover more than now
            return apart & (over > 0) & (over >= share(cfg) * np.minimum(size[j], least[i]) * (1 - 1e-9))

        before = labels
        for i, j in met(reach(cfg, frames.cols), of[parts[at]], reaches, of, could):
            labels = joined(labels, parts[at[i]], j)
        if (labels == before).all():
            return labels, kept, part
        new = np.isin(labels, labels[labels != before])
