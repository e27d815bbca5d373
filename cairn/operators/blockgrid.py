"""Operators on blocks that move pixels: clip, resample, mosaic and overviews. Only blocks and parts of blocks are shuffled.

A source block works out which pixels of which target blocks it has a part in, and sends each of them that part: a rectangle of values,
or of weighted sums and weights. A target block is put together from the parts it gets, in any order. Blocks are those of
``chunks``; operators say the same as those of their names on pixel rows, in single precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.chunks import COLUMNS
from cairn.operators.raster import MOSAIC, _need, clip_window, mosaic_grid, resample_meta, shifted
from cairn.plans.groups import spread_groups
from cairn.plans.ranks import numbered
from cairn.plans.storage import materialise

Part = tuple[int, int, np.ndarray, np.ndarray | None]  # column and row of the target raster, values, weights
AT_ONCE = 16  # rasters whose parts of a block meet in one task
HELD = 1 << 20  # values of parts that are sent as one batch, beyond a single part
_PARTS = "raster_id string, band int, cx int, cy int, x int, y int, w int, h int, width int, height int, seq long, a binary, b binary"
_NAMES = [p.split()[0] for p in _PARTS.split(", ")]
_ARROW = [pa.string(), *[pa.int32()] * 9, pa.int64(), pa.binary(), pa.binary()]


def _parts(blocks: DataFrame, size: int, kernel: Callable[..., Iterator[Part]], *parameters: str) -> DataFrame:
    """The parts of target blocks that kernel(values of a block, its left, its top, parameters ...) gives, cut at the blocks' borders.

    ``blocks`` have the target's width and height, and seq, beside their own columns.
    """
    columns = ("raster_id", "band", "cx", "cy", "w", "h", "width", "height", "seq", "size", "data", *parameters)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                raster, band, cx, cy, w, h, width, height, seq, own = (batch.column(k)[i].as_py() for k in range(10))
                values = batch.column(10)[i].values.cast(pa.float32()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(h, w)
                for left, top, a, b in kernel(values, cx * own, cy * own, *(batch.column(k)[i].as_py() for k in range(11, len(columns)))):
                    for y in range(top - top % size, top + a.shape[0], size):
                        for x in range(left - left % size, left + a.shape[1], size):
                            box = slice(max(y - top, 0), y + size - top), slice(max(x - left, 0), x + size - left)
                            cut = a[box]
                            rows.append((raster, band, x // size, y // size, max(left - x, 0), max(top - y, 0), cut.shape[1], cut.shape[0], width, height, seq, cut.astype(float).tobytes(), None if b is None else b[box].astype(float).tobytes()))
                            held += cut.size
                            if held > HELD:
                                yield batch_of(rows)
                                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return blocks.select(*(F.col(c) for c in columns)).mapInArrow(run, _PARTS)


def _united(held: pa.Table, size: int, how: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(values or sums, weights, w, h) of a target block from its parts; NaN or weight 0 where no part has a value."""
    width, height, cx, cy = (held[c][0].as_py() for c in ("width", "height", "cx", "cy"))
    w, h = min(size, width - cx * size), min(size, height - cy * size)
    a, b = np.full((h, w), 0.0 if how == "mean" else np.nan), np.zeros((h, w))
    for k in np.argsort(held["seq"].fill_null(0).to_numpy(), kind="stable").tolist():
        x, y, pw, ph = (held[c][k].as_py() for c in ("x", "y", "w", "h"))
        new = np.frombuffer(held["a"][k].as_py()).reshape(ph, pw)
        weights = held["b"][k].as_py()
        box = slice(y, y + ph), slice(x, x + pw)
        old = a[box]
        if how == "mean":
            a[box] = old + np.where(np.isnan(new), 0.0, new)
            b[box] += ~np.isnan(new) if weights is None else np.frombuffer(weights).reshape(ph, pw)
        elif how == "first":
            a[box] = np.where(np.isnan(old), new, old)
        elif how == "overwrite":
            a[box] = np.where(np.isnan(new), old, new)
        else:
            a[box] = (np.fmax if how == "max" else np.fmin)(old, new)
    return a, b, w, h


def _gathered(parts: DataFrame, size: int, how: str = "overwrite") -> DataFrame:
    """Blocks put together from their parts."""

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        a, b, w, h = _united(held, size, how)
        if how == "mean":
            with np.errstate(divide="ignore", invalid="ignore"):
                a = np.where(b > 0, a / b, np.nan)
        data = a.astype(np.float32).ravel()
        heads = [pa.array([k.as_py()], t) for k, t in zip(key, (pa.string(), *[pa.int32()] * 3), strict=True)]
        return pa.table([*heads, pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([pa.array(data, mask=np.isnan(data))], pa.list_(pa.float32())), pa.array([size], pa.int32())], names=list(COLUMNS))

    return spread_groups(parts, "raster_id", "band", "cx", "cy").applyInArrow(run, "raster_id string, band int, cx int, cy int, w int, h int, data array<float>, size int")


def _side(chunks: DataFrame, size: int | None) -> int:
    """The side of the blocks, which are all of one size."""
    return size or chunks.select("size").first()[0]


def _ready(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"band": F.col("band").cast("int"), "seq": F.lit(0).cast("long")})


# ---------------------------------------------------------------- clip


def _clip(chunks: DataFrame, meta: DataFrame, window: DataFrame, size: int | None) -> tuple[DataFrame, DataFrame]:
    """Blocks of a window of each raster: the ranges of blocks that all windows lie in are a filter of the scan."""
    side = _side(chunks, size)
    ends = window.agg(*(f(F.col(c)) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1")))).first()
    new = meta.join(window, "raster_id").withColumns({"width": F.col("x1") - F.col("x0") + 1, "height": F.col("y1") - F.col("y0") + 1, "gt": shifted(F.col("gt"), F.col("x0"), F.col("y0"))})
    x0, x1, y0, y1 = (0, -1, 0, -1) if ends[0] is None else (int(v) // side for v in ends)
    near = chunks.filter(F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1))
    near = near.join(new.select("raster_id", "width", "height", *(F.col(c).cast("int").alias(c) for c in ("x0", "y0"))), "raster_id")

    def kernel(values: np.ndarray, left: int, top: int, x: int, y: int, width: int, height: int) -> Iterator[Part]:
        a, b = max(x - left, 0), max(y - top, 0)
        cut = values[b : max(y + height - top, 0), a : max(x + width - left, 0)]
        if cut.size:
            yield left + a - x, top + b - y, cut, None

    parts = _parts(_ready(near).withColumns({"tw": F.col("width"), "th": F.col("height")}), side, kernel, "x0", "y0", "tw", "th")
    return _gathered(parts, side), new.select(meta.columns)


def clip_bbox(chunks: DataFrame, meta: DataFrame, bbox: tuple[float, float, float, float], size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks and meta inside (min_x, min_y, max_x, max_y); the pixel that holds the far corner belongs to it."""
    return _clip(chunks, meta, clip_window(meta, *bbox), size)


def clip_pixels(chunks: DataFrame, meta: DataFrame, x0: int, y0: int, width: int, height: int, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks and meta of an exact window; rasters that do not hold it whole are absent."""
    _need(x0 >= 0 and y0 >= 0 and width > 0 and height > 0, "bad window")
    holds = meta.filter((F.col("width") >= x0 + width) & (F.col("height") >= y0 + height))
    return _clip(chunks, meta, holds.select("raster_id", F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x0 + width - 1).alias("x1"), F.lit(y0 + height - 1).alias("y1")), size)


# ---------------------------------------------------------------- resample


def _axis(first: int, n: int, source: int, target: int, method: str) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """(first target place, [(place in the block, weight) ...] of each target place) of the places that source places first .. first + n serve."""
    scale = source / target
    low = max(0, math.floor((first - 1) / scale) - 2)
    at = np.arange(low, min(target, math.ceil((first + n + 1) / scale) + 2))
    place = (at + 0.5) * scale - 0.5
    if method == "nearest":
        whole = np.clip(np.floor(np.abs(place) + 0.5) * np.sign(place), 0, source - 1).astype(np.int64)
        ways = [(whole, np.ones(len(at)))]
    else:
        floor = np.floor(place)
        x0 = np.maximum(0, floor).astype(np.int64)
        ways = [(x0, 1 - (place - floor)), (np.minimum(source - 1, x0 + 1), place - floor)]
    mine = [(k - first, np.where((k >= first) & (k < first + n), weight, 0.0), (k >= first) & (k < first + n)) for k, weight in ways]
    served = np.flatnonzero(np.any([m for _, _, m in mine], axis=0))
    if not len(served):
        return 0, []
    keep = slice(served[0], served[-1] + 1)
    return int(at[keep][0]), [(np.clip(k[keep], 0, n - 1), weight[keep]) for k, weight, _ in mine]


def resample(chunks: DataFrame, meta: DataFrame, width: int | Column, height: int | Column, method: str = "nearest", size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every raster at a new size, by ``nearest`` or ``bilinear``: a block serves the target pixels that its own pixels have a weight in."""
    for side in (width, height):
        _need(isinstance(side, Column) or side > 0, "target size must be positive")
    _need(method in ("nearest", "bilinear"), f"unknown method {method}")
    w, h = (s if isinstance(s, Column) else F.lit(s) for s in (width, height))
    side, new = _side(chunks, size), resample_meta(meta, w, h)
    sizes = meta.select("raster_id", F.col("width").alias("sw"), F.col("height").alias("sh")).join(new.select("raster_id", "width", "height"), "raster_id")

    def kernel(values: np.ndarray, left: int, top: int, sw: int, sh: int, tw: int, th: int) -> Iterator[Part]:
        x, across = _axis(left, values.shape[1], sw, tw, method)
        y, down = _axis(top, values.shape[0], sh, th, method)
        if not across or not down:
            return
        valid, filled = ~np.isnan(values), np.nan_to_num(values.astype(float))
        n, m = len(down[0][0]), len(across[0][0])
        for i in range(0, n, side):  # a target block at a time
            for j in range(0, m, side):
                a, b = np.zeros((min(side, n - i), min(side, m - j))), np.zeros((min(side, n - i), min(side, m - j)))
                for ky, wy in down:
                    for kx, wx in across:
                        weight = wy[i : i + side, None] * wx[None, j : j + side]
                        spot = np.ix_(ky[i : i + side], kx[j : j + side])
                        a += weight * filled[spot]
                        b += weight * valid[spot]
                yield x + j, y + i, a, b

    blocks = _ready(chunks.join(sizes, "raster_id")).withColumns({"tw": F.col("width"), "th": F.col("height")})
    return _gathered(_parts(blocks, side, kernel, "sw", "sh", "tw", "th"), side, "mean"), new


def resample_to_resolution(chunks: DataFrame, meta: DataFrame, resolution: float, method: str = "bilinear", size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Resample so that a pixel measures ``resolution``; a zero pixel size counts as 1."""
    _need(resolution > 0, "resolution must be positive")
    pixel = F.abs(F.col("gt")[1])
    scale = F.when(pixel == 0, 1.0).otherwise(pixel) / resolution
    new = lambda c: F.greatest(F.lit(1), F.round(F.col(c) * scale).cast("int"))
    return resample(chunks, meta, new("width"), new("height"), method, size)


# ---------------------------------------------------------------- mosaic, overviews


def mosaic(chunks: DataFrame, meta: DataFrame, strategy: str = "first", order: str = "raster_id", size: int | None = None) -> DataFrame:
    """Blocks of one raster, ``mosaic``, over the union grid; where rasters overlap the strategy decides by ``order`` (a column of meta).

    A block lies over at most four target blocks. Of many rasters over one block, AT_ONCE are united in a task, and what
    they leave is united in turn.
    """
    _need(strategy in MOSAIC, f"unknown strategy {strategy}")
    side, grid = _side(chunks, size), mosaic_grid(meta, order).select(F.struct("*")).scalar()
    placed = meta.select("raster_id", F.col("gt"), F.col(order).alias("_o"), grid.alias("g"), F.lit(0).alias("_all"))
    dx, dy = F.round((F.col("gt")[0] - F.col("g.min_x")) / F.col("g.px")), F.round((F.col("g.max_y") - F.col("gt")[3]) / F.col("g.py"))
    placed = placed.select("_all", "_o", "raster_id", dx.cast("int").alias("dx"), dy.cast("int").alias("dy"), F.col("g.width").alias("width"), F.col("g.height").alias("height"))
    placed = materialise(numbered(placed, ["_all"], ["_o", "raster_id"], "seq").drop("_all", "_o"))

    def kernel(values: np.ndarray, left: int, top: int, dx: int, dy: int, width: int, height: int) -> Iterator[Part]:
        x, y = left + dx, top + dy
        cut = values[max(-y, 0) : max(height - y, 0), max(-x, 0) : max(width - x, 0)]
        if cut.size:
            yield max(x, 0), max(y, 0), cut, None

    blocks = chunks.withColumn("band", F.col("band").cast("int")).join(placed, "raster_id").withColumns({"raster_id": F.lit("mosaic"), "tw": F.col("width"), "th": F.col("height")})
    parts, many = _parts(blocks, side, kernel, "dx", "dy", "tw", "th"), placed.count()

    def unite(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        a, b, w, h = _united(held, side, strategy)
        row = (key[0].as_py(), key[1].as_py(), key[2].as_py(), key[3].as_py(), 0, 0, w, h, held["width"][0].as_py(), held["height"][0].as_py(), key[4].as_py(), a.tobytes(), b.tobytes() if strategy == "mean" else None)
        return pa.table([pa.array([v], t) for v, t in zip(row, _ARROW, strict=True)], names=_NAMES)

    while many > AT_ONCE:
        parts = spread_groups(parts.withColumn("seq_", F.floor(F.col("seq") / AT_ONCE).cast("long")), "raster_id", "band", "cx", "cy", "seq_").applyInArrow(unite, _PARTS)
        many = -(-many // AT_ONCE)
    return _gathered(parts, side, strategy)


def build_overviews(chunks: DataFrame, meta: DataFrame, min_dim: int = 512, size: int | None = None) -> DataFrame:
    """Blocks with ``level``: factors 2, 4, 8, ... while the larger side, halved each time, exceeds ``min_dim``; a cell is its top left pixel.

    Each level is made of the one before, a quarter of its size.
    """
    side = _side(chunks, size)
    _need(side % 2 == 0, "blocks must have an even side")
    now, level, out = chunks, 1, None
    sizes = meta.select("raster_id", "width", "height", F.greatest("width", "height").alias("most"))

    def kernel(values: np.ndarray, left: int, top: int) -> Iterator[Part]:
        yield left // 2, top // 2, values[::2, ::2], None

    while True:
        sizes = sizes.filter(F.floor(F.col("most") / level) > min_dim).withColumns({c: F.ceil(F.col(c) / 2).cast("int") for c in ("width", "height")})
        if sizes.isEmpty():
            return chunks.limit(0).withColumn("level", F.lit(0)) if out is None else out
        level *= 2
        now = materialise(_gathered(_parts(_ready(now.join(sizes, "raster_id")), side, kernel), side))
        mine = now.withColumn("level", F.lit(level))
        out = mine if out is None else out.unionByName(mine)
