"""Convolution on blocks as array rows, one matrix product a block.

A block row (img, block, v) has the core of one block of a map, channels x height x width, as one array of
doubles; missing pixels count as 0. The grid is dealt as ``split_1d`` has it (P14). A block meets the
border of its eight neighbours in one of two ways (E3, E4), which give the same pixels:

* ``replicate``: blocks with copies of their border strips for the neighbours are grouped by block, so all
  pixels move;
* ``strips``: blocks stay in their partition and only strips move, to a join with the blocks' own
  partitioning.

The convolution gathers the 3x3 surroundings of each core pixel as columns of a matrix and multiplies by
the weights, outputs x (inputs * 9). Weights up to ``WEIGHT_BYTES`` are sent to the tasks as a broadcast
variable; larger ones are for the caller to join by shuffle (``tensor.conv3x3_joined``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import split_index

#: Bound of the weights of a layer that are broadcast, and of the values of a block that ``grid_for`` deals out.
WEIGHT_BYTES = 64 << 20
BLOCK_VALUES = 1 << 18
#: Values of a step over the blocks of a batch, about; one block at least.
STEP_VALUES = 1 << 18
#: Neighbours by number: row and column steps.
STEPS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


@dataclass(frozen=True)
class Grid:
    """A map of ``channels`` x ``height`` x ``width`` in ``rows`` x ``cols`` blocks, row-major."""

    channels: int
    height: int
    width: int
    rows: int = 1
    cols: int = 1

    def bounds(self, block: int) -> tuple[int, int, int, int]:
        """y0, y1, x0, x1 of a block, half-open."""
        def span(total: int, parts: int, k: int) -> tuple[int, int]:
            start = lambda i: i * (total // parts) + min(i, total % parts)
            return start(k), start(k + 1)
        return *span(self.height, self.rows, block // self.cols), *span(self.width, self.cols, block % self.cols)

    def core(self, block: int, values: np.ndarray, channels: int | None = None) -> np.ndarray:
        y0, y1, x0, x1 = self.bounds(block)
        return values.reshape(channels or self.channels, y1 - y0, x1 - x0)

    def neighbour(self, block: int, side: int) -> int | None:
        """E5: the block on a side; None behind the border."""
        r, c = block // self.cols + STEPS[side][0], block % self.cols + STEPS[side][1]
        return r * self.cols + c if 0 <= r < self.rows and 0 <= c < self.cols else None

    def strip(self, core: np.ndarray, side: int) -> np.ndarray:
        """The border of a core that its neighbour on a side needs."""
        dy, dx = STEPS[side]
        rows = slice(0, 1) if dy < 0 else slice(-1, None) if dy > 0 else slice(None)
        cols = slice(0, 1) if dx < 0 else slice(-1, None) if dx > 0 else slice(None)
        return core[:, rows, cols]

    def block_of(self) -> Column:
        return (split_index(self.height, self.rows, F.col("y")) * self.cols + split_index(self.width, self.cols, F.col("x"))).cast("int")


def grid_for(channels: int, height: int, width: int, most: int = BLOCK_VALUES) -> Grid:
    """The fewest blocks of at most ``most`` values, about square."""
    rows = min(height, max(1, math.ceil(math.sqrt(channels * height * width / most))))
    cols = min(width, max(1, math.ceil(channels * width * math.ceil(height / rows) / most)))
    return Grid(channels, height, width, rows, cols)


def _flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of a list column, and each row's size and start in them; null lists are empty."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return values.flatten().to_numpy(zero_copy_only=False), sizes, np.cumsum(sizes) - sizes


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list<double> array of flat values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.float64()))


def _alike(*keys: np.ndarray, values: int = 1) -> Iterator[np.ndarray]:
    """The rows of a batch with equal keys, in pieces of about ``STEP_VALUES`` where a row takes ``values``."""
    order = np.lexsort(keys)
    new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    for rows in np.split(order, np.flatnonzero(new) + 1):
        step = max(1, STEP_VALUES // values)
        yield from (rows[k: k + step] for k in range(0, len(rows), step))


def _spots(starts: np.ndarray, size: int) -> np.ndarray:
    return starts[:, None] + np.arange(size)


def pack(pixels: DataFrame, grid: Grid) -> DataFrame:
    """Block rows of pixels (img, c, y, x, v), by one shuffle; a block without any pixel has no row. Of equal places one pixel counts."""
    @F.arrow_udf("array<double>")
    def dense(block: pa.Array, places: pa.Array, values: pa.Array) -> pa.Array:
        b = block.to_numpy(zero_copy_only=False)
        (at, counts, _), v = _flat(places), _flat(values)[0]
        which, back = np.unique(b, return_inverse=True)
        y0, y1, x0, x1 = np.array([grid.bounds(int(k)) for k in which], np.int64).reshape(-1, 4).T[:, back]
        sizes = grid.channels * (y1 - y0) * (x1 - x0)
        row = np.repeat(np.arange(len(b)), counts)
        c, rest = np.divmod(at, grid.height * grid.width)
        y, x = np.divmod(rest, grid.width)
        out = np.zeros(sizes.sum())
        out[(np.cumsum(sizes) - sizes)[row] + (c * (y1 - y0)[row] + y - y0[row]) * (x1 - x0)[row] + x - x0[row]] = v
        return _lists(out, sizes)

    place = F.struct(((F.col("c").cast("bigint") * grid.height + F.col("y")) * grid.width + F.col("x")).alias("at"), F.col("v").cast("double").alias("v"))
    keyed = pixels.where("v is not null").select("img", grid.block_of().alias("block"), place.alias("p"))
    found = keyed.groupBy("img", "block").agg(F.collect_list("p").alias("p"))
    return found.select("img", "block", dense("block", F.col("p.at"), F.col("p.v")).alias("v"))


def unpack(blocks: DataFrame, grid: Grid) -> DataFrame:
    """The pixels of block rows; each comes once, as cores don't overlap."""
    r, c = F.floor(F.col("block") / grid.cols).cast("int"), (F.col("block") % grid.cols).cast("int")

    def span(total: int, parts: int, k: Column) -> tuple[Column, Column]:
        size, more = total // parts, total % parts
        return (k * size + F.least(k, F.lit(more))).cast("int"), (F.lit(size) + F.when(k < more, 1).otherwise(0)).cast("int")
    (y0, h), (x0, w) = span(grid.height, grid.rows, r), span(grid.width, grid.cols, c)
    rows = blocks.select("img", y0.alias("y0"), h.alias("h"), x0.alias("x0"), w.alias("w"), F.posexplode("v").alias("at", "v"))
    return rows.select("img", F.floor(F.col("at") / (F.col("h") * F.col("w"))).cast("int").alias("c"), (F.col("y0") + F.floor(F.col("at") / F.col("w")) % F.col("h")).cast("int").alias("y"), (F.col("x0") + F.col("at") % F.col("w")).cast("int").alias("x"), "v")


def strips(blocks: DataFrame, grid: Grid) -> DataFrame:
    """(img, block, side, v): the border strips of all blocks at the neighbours that they are for; side as the neighbour sees it."""
    @F.arrow_udf("array<struct<block:int,side:int,v:array<double>>>")
    def cut(block: pa.Array, values: pa.Array) -> pa.Array:
        b = block.to_numpy(zero_copy_only=False)
        v, sizes, starts = _flat(values)
        of = {int(k): [(side, other) for side in range(8) if (other := grid.neighbour(int(k), side)) is not None] for k in np.unique(b)}
        items = np.array([len(of[k]) for k in b.tolist()], np.int64) * (sizes > 0)
        first = np.cumsum(items) - items
        to, side_of, lengths = (np.zeros(items.sum(), np.int64) for _ in range(3))
        cores: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in _alike(b, sizes, values=int(sizes.max(initial=1)) + 1):
            k = int(b[rows[0]])
            if not items[rows[0]]:
                continue
            y0, y1, x0, x1 = grid.bounds(k)
            core = v[_spots(starts[rows], int(sizes[rows[0]]))].reshape(-1, y1 - y0, x1 - x0)
            parts = [grid.strip(core, side).reshape(len(rows), -1) for side, _ in of[k]]
            spots = _spots(first[rows], len(parts))
            to[spots], side_of[spots], lengths[spots] = [other for _, other in of[k]], [7 - side for side, _ in of[k]], [p.shape[1] for p in parts]
            cores.append((rows, np.concatenate(parts, axis=1)))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(ends[-1])
        for rows, strip in cores:
            out[_spots(ends[first[rows]], strip.shape[1])] = strip
        found = pa.StructArray.from_arrays([pa.array(to, pa.int32()), pa.array(side_of, pa.int32()), _lists(out, lengths)], ["block", "side", "v"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(items)]), pa.int32()), found)

    return blocks.select("img", F.explode(cut("block", "v")).alias("s")).select("img", "s.block", "s.side", "s.v")


def with_strips(blocks: DataFrame, grid: Grid, mode: str = "strips") -> DataFrame:
    """(img, block, v, sides, borders): each block with the strips of its neighbours; ``mode`` says what moves."""
    if mode == "replicate":
        both = blocks.select("img", "block", F.lit(-1).alias("side"), "v").unionByName(strips(blocks, grid))
        met = both.groupBy("img", "block").agg(F.sort_array(F.collect_list(F.struct("side", "v"))).alias("s"))
        core, rest = F.get(F.filter("s", lambda x: x["side"] < 0), F.lit(0))["v"], F.filter("s", lambda x: x["side"] >= 0)
        # a block whose own pixels are all missing takes part as zeros
        return met.select("img", "block", core.alias("v"), F.transform(rest, lambda x: x["side"]).alias("sides"), F.flatten(F.transform(rest, lambda x: x["v"])).alias("borders"))
    if mode != "strips":
        raise ValueError("mode must be replicate or strips")
    halo = strips(blocks, grid).groupBy("img", "block").agg(F.sort_array(F.collect_list(F.struct("side", "v"))).alias("s"))
    halo = halo.select("img", "block", F.col("s.side").alias("sides"), F.flatten("s.v").alias("borders"))
    return blocks.hint("merge").join(halo, ["img", "block"], "full_outer" if grid.rows * grid.cols > 1 else "left")


def extended(grid: Grid, block: int, v: np.ndarray, sides: list[int], borders: np.ndarray) -> np.ndarray:
    """Cores of one block of several maps with one pixel of their surroundings on each side, 0 behind the border; a map is a row of ``v`` and of ``borders``."""
    y0, y1, x0, x1 = grid.bounds(block)
    h, w, at = y1 - y0, x1 - x0, 0
    out = np.zeros((len(v), grid.channels, h + 2, w + 2))
    if v.size:
        out[:, :, 1:-1, 1:-1] = v.reshape(len(v), grid.channels, h, w)
    for side in sides:
        dy, dx = STEPS[side]
        rows = slice(0, 1) if dy < 0 else slice(h + 1, h + 2) if dy > 0 else slice(1, h + 1)
        cols = slice(0, 1) if dx < 0 else slice(w + 1, w + 2) if dx > 0 else slice(1, w + 1)
        shape = out[:, :, rows, cols].shape
        size = math.prod(shape[1:])
        out[:, :, rows, cols] = borders[:, at: at + size].reshape(shape)
        at += size
    return out


def product(extended_: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The 3x3 surroundings of each map as columns, times weights (outputs x inputs x 3 x 3), plus bias; a row for each map."""
    n, c, h, w = extended_.shape[0], extended_.shape[1], extended_.shape[2] - 2, extended_.shape[3] - 2
    columns = np.lib.stride_tricks.sliding_window_view(extended_, (3, 3), axis=(2, 3)).transpose(0, 1, 4, 5, 2, 3).reshape(n, c * 9, h * w)
    return (weights.reshape(len(weights), c * 9) @ columns + bias[:, None]).reshape(n, -1)


def dense_weights(weights: DataFrame, inputs: int, most: int = WEIGHT_BYTES) -> tuple[np.ndarray, np.ndarray] | None:
    """(outputs x inputs x 3 x 3, bias) of the rows (oc, ic, ky, kx, w, b); None if they take more than ``most`` bytes."""
    outputs = (weights.agg(F.max("oc").alias("oc")).first().oc or 0) + 1
    if outputs * inputs * 72 > most:
        return None
    table = weights.toArrow()
    w, b = np.zeros((outputs, inputs, 3, 3)), np.zeros(outputs)
    oc, ic, ky, kx = (table[k].to_numpy() for k in ("oc", "ic", "ky", "kx"))
    w[oc, ic, ky, kx] = table["w"].to_numpy()
    b[oc] = table["b"].to_numpy()
    return w, b


def batch_convolved(grid: Grid, weights: tuple[np.ndarray, np.ndarray], relu: bool, block: pa.Array, v: pa.Array, sides: pa.Array, borders: pa.Array) -> pa.Array:
    """E6, A20, P18 on a batch of blocks: those of one kind side by side, in steps of bounded size."""
    (w, bias), b = weights, block.to_numpy(zero_copy_only=False)
    (core, n_core, at_core), (side, n_side, at_side), (border, n_border, at_border) = _flat(v), _flat(sides), _flat(borders)
    # a row's sides as the bits of one number; they come in rising order
    met_ = np.bincount(np.repeat(np.arange(len(b)), n_side), weights=1 << side.astype(np.int64), minlength=len(b)).astype(np.int64)
    which, back = np.unique(b, return_inverse=True)
    spans = np.array([grid.bounds(int(k)) for k in which], np.int64).reshape(-1, 4)
    pixels = ((spans[:, 1] - spans[:, 0]) * (spans[:, 3] - spans[:, 2]))[back]
    sizes = len(w) * pixels
    out, starts = np.empty(sizes.sum()), np.cumsum(sizes) - sizes
    for rows in _alike(b, met_, n_core, values=9 * grid.channels * int(pixels.max(initial=1)) + 1):
        k = rows[0]
        one = extended(grid, int(b[k]), core[_spots(at_core[rows], int(n_core[k]))], [s for s in range(8) if met_[k] >> s & 1], border[_spots(at_border[rows], int(n_border[k]))])
        found = product(one, w, bias)
        out[_spots(starts[rows], int(sizes[k]))] = np.maximum(found, 0.0) if relu else found
    return _lists(out, sizes)


def convolved(met: DataFrame, grid: Grid, weights: tuple[np.ndarray, np.ndarray], relu: bool = False) -> DataFrame:
    """Block rows of the outputs, from ``with_strips`` rows."""
    sent = met.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def conv(block: pa.Array, v: pa.Array, sides: pa.Array, borders: pa.Array) -> pa.Array:
        return batch_convolved(grid, sent.value, relu, block, v, sides, borders)

    return met.select("img", "block", conv("block", "v", "sides", "borders").alias("v"))
