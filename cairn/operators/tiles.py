"""Overlapping tiles, tensors, class scores and blending.

Tile pixels: raster_id, tile_id, band, tx, ty, v (tx, ty from the tile's corner). Tiles: raster_id, tile_id, src_x, src_y, src_w,
src_h. Scores: raster_id, tile_id, class, px, py, and a value.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.raster import SAME

#: Channel means and deviations that the usual image models are fed with (fixed values).
IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def tile_offsets(length: Column, tile: int, stride: int) -> Column:
    """{k * stride : it fits} and the last possible offset; {0} where the axis is no longer than a tile."""
    last = F.greatest(length - tile, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def _clamped(tile: int, stride: int) -> int:
    return tile if stride <= 0 or stride > tile else stride


def tile_grid(meta: DataFrame, tile: int, stride: int) -> DataFrame:
    """Tiles of every raster, numbered row by row."""
    stride = _clamped(tile, stride)
    offsets = meta.select("raster_id", "width", "height", tile_offsets(F.col("width"), tile, stride).alias("xs"), tile_offsets(F.col("height"), tile, stride).alias("ys"))
    rows = offsets.select("raster_id", "width", "height", "xs", F.posexplode("ys").alias("_r", "src_y"))
    cells = rows.select("raster_id", "width", "height", "_r", "src_y", F.size("xs").alias("_n"), F.posexplode("xs").alias("_c", "src_x"))
    size = lambda whole, at: F.least(F.lit(tile), F.col(whole) - F.col(at)).alias("src_w" if whole == "width" else "src_h")
    return cells.select("raster_id", (F.col("_r") * F.col("_n") + F.col("_c")).cast("long").alias("tile_id"), "src_x", "src_y", size("width", "src_x"), size("height", "src_y"))


def _covering(at: Column, length: Column, tile: int, stride: int) -> Column:
    """(number, offset) of the offsets whose tile covers a place, found by arithmetic rather than by trying all."""
    last = F.greatest(length - tile, F.lit(0))
    whole = F.floor(last / stride)  # number of the last regular offset
    low = F.greatest(F.lit(0), F.ceil((at - (tile - 1)) / F.lit(stride))).cast("int")
    high = F.least(F.floor(at / F.lit(stride)), whole).cast("int")
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: F.struct(k.alias("k"), (k * stride).alias("o")))).otherwise(F.array().cast("array<struct<k:int,o:int>>"))
    edge = F.when((last % stride != 0) & (at >= last), F.array(F.struct((whole + 1).cast("int").alias("k"), last.cast("int").alias("o")))).otherwise(F.array().cast("array<struct<k:int,o:int>>"))
    return F.concat(regular, edge)


def tile_raster(px: DataFrame, meta: DataFrame, tile: int, stride: int) -> tuple[DataFrame, DataFrame]:
    """(tiles, tile pixels). A pixel goes to every tile that covers it; what a tile lacks of the image is absent."""
    stride = _clamped(tile, stride)
    sized = px.join(meta.select("raster_id", "width", "height"), "raster_id")
    columns = F.size(tile_offsets(F.col("width"), tile, stride))
    spread = sized.withColumn("_y", F.explode(_covering(F.col("y"), F.col("height"), tile, stride))).withColumn("_x", F.explode(_covering(F.col("x"), F.col("width"), tile, stride)))
    cells = spread.select("raster_id", (F.col("_y.k") * columns + F.col("_x.k")).cast("long").alias("tile_id"), "band", (F.col("x") - F.col("_x.o")).cast("int").alias("tx"), (F.col("y") - F.col("_y.o")).cast("int").alias("ty"), "v")
    return tile_grid(meta, tile, stride), cells


def skip_nodata_tiles(tiles: DataFrame, tile_px: DataFrame, nodata: float = 0.0) -> DataFrame:
    """Tiles with some pixel in some band that is neither missing nor ``nodata``."""
    solid = tile_px.filter(F.col("v").isNotNull() & (F.abs(F.col("v") - nodata) >= SAME)).select("raster_id", "tile_id").distinct()
    return tiles.join(solid, ["raster_id", "tile_id"], "left_semi")


# ---------------------------------------------------------------- tensors

NORMALIZE = ("none", "imagenet", "minmax", "zscore", "custom")


def tensor_of(grids: dict[int, np.ndarray], mode: str, width: int, height: int, channels: int, bytes_in: bool = False, mean=IMAGENET_MEAN, std=IMAGENET_STD) -> np.ndarray:
    """channels x height x width from the values of each band, missing ones NaN; see ``to_tensors``."""
    out = np.zeros((channels, height, width), np.float32)
    for k, grid in grids.items():
        if not 0 <= k < channels:
            continue
        rows, columns = (np.minimum(n - 1, np.floor(np.arange(target, dtype=np.float32) * (np.float32(n) / np.float32(target))).astype(np.int64)) for n, target in zip(grid.shape, (height, width), strict=True))
        value, there = np.nan_to_num(grid)[rows[:, None], columns[None, :]], grid[~np.isnan(grid)]
        if mode in ("minmax", "zscore"):
            if not len(there):
                continue
            spread = there.max() - there.min()
            if mode == "minmax":
                value = (value - there.min()) / spread if spread > 1e-6 else np.zeros_like(value)
            else:
                value = (value - there.mean()) / (there.std() if there.std() > 1e-6 else 1.0)
        elif mode in ("imagenet", "custom"):
            value = value / 255.0 if bytes_in else value
            value = (value - mean[k]) / std[k] if k < 3 else value
        out[k] = value
    return out


def to_tensors(
    tile_px: DataFrame, tiles: DataFrame, mode: str = "none", width: int = 512, height: int = 512, channels: int = 3, mean=IMAGENET_MEAN, std=IMAGENET_STD, bytes_in: bool = False
) -> DataFrame:
    """raster_id, tile_id, tensor (channel, row, column order), shape [1, channels, height, width].

    The nearest source pixel is min(size - 1, int(i * size / target)) in single precision. Missing values become 0 before
    normalising; channels beyond the bands are 0. ``minmax`` and ``zscore`` use the statistics of the tile's own band.
    A tensor has channels * height * width values and a tile as many pixels, so a tile is one bounded group, filled as one array.
    """
    if mode not in NORMALIZE:
        raise ValueError(f"unknown mode {mode}")
    keys = ["raster_id", "tile_id"]

    def build(key, tile, cells):
        if not tile.num_rows:
            return pa.table([pa.nulls(0, pa.string()), pa.nulls(0, pa.int64()), pa.nulls(0, pa.list_(pa.float32()))], names=[*keys, "tensor"])
        w, h = tile["src_w"][0].as_py(), tile["src_h"][0].as_py()
        band, tx, ty = (cells[c].to_numpy().astype(np.int64) for c in ("band", "tx", "ty"))
        v = cells["v"].fill_null(np.nan).to_numpy().astype(float)
        inside, grids = (tx >= 0) & (tx < w) & (ty >= 0) & (ty < h), {}
        for k in np.unique(band).tolist():
            here = inside & (band == k)
            grids[k] = np.full((h, w), np.nan)
            grids[k][ty[here], tx[here]] = v[here]
        out = tensor_of(grids, mode, width, height, channels, bytes_in, mean, std)
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([out.ravel()], pa.list_(pa.float32()))], names=[*keys, "tensor"])

    sides = tiles.select("raster_id", F.col("tile_id").cast("long").alias("tile_id"), "src_w", "src_h")
    cells = tile_px.select("raster_id", F.col("tile_id").cast("long").alias("tile_id"), "band", "tx", "ty", F.col("v").cast("double").alias("v"))
    made = sides.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(build, "raster_id string, tile_id long, tensor array<float>")
    return made.withColumn("shape", F.array(*(F.lit(n).cast("long") for n in (1, channels, height, width))))


def band_to_tensor(px: DataFrame, meta: DataFrame, band: int, width: int = 512, height: int = 512) -> DataFrame:
    """One band of each raster at the target size, not normalised; missing gives 0."""
    whole = meta.select("raster_id", F.lit(0).cast("long").alias("tile_id"), F.lit(0).alias("src_x"), F.lit(0).alias("src_y"), F.col("width").alias("src_w"), F.col("height").alias("src_h"))
    one = px.filter(F.col("band") == band).select("raster_id", F.lit(0).cast("long").alias("tile_id"), F.lit(0).alias("band"), F.col("x").alias("tx"), F.col("y").alias("ty"), "v")
    return to_tensors(one, whole, "none", width, height, 1).drop("tile_id")


# ---------------------------------------------------------------- classes and blending


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def threshold_mask(c: Column, threshold: float = 0.5) -> Column:
    return (c >= threshold).cast("int")


def mask_to_raster(mask: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pixels and meta of a one-band Byte raster on the place of ``meta``."""
    one = F.array(F.struct(F.lit("Byte").alias("dtype"), F.lit(None).cast("float").alias("nodata")))
    return mask.select("raster_id", F.lit(0).alias("band"), "x", "y", F.col("v").cast("double").alias("v")), meta.withColumns({"band_count": F.lit(1), "bands": one})


def argmax_class(value: Column, klass: Column) -> Column:
    """Class of the largest value of a group; the lowest class wins ties."""
    return F.max_by(klass, F.struct(value, -klass))


def sigmoid_argmax(logits: DataFrame, keys: tuple[str, ...] = ("raster_id", "tile_id", "px", "py"), value: str = "logit", binary: bool = False) -> DataFrame:
    """Class with the largest sigmoid for each pixel; with one class always 0, or with ``binary`` whether it reaches 0.5."""
    p = sigmoid(F.col(value))
    if binary:
        return logits.select(*keys, threshold_mask(p).alias("class"))
    return logits.groupBy(*keys).agg(argmax_class(p, F.col("class")).alias("class"))


def argmax_of(values: Column) -> Column:
    """Place of the first maximum of an array."""
    return F.array_position(values, F.array_max(values)) - 1


def blend_weights(tile: int, overlap: int, mode: str = "linear", sigma: float = 0.5) -> list[float]:
    """Weight of each place along one side of a tile.

    A place counts by its distance d from an end of the tile, if it lies in that end's overlap; where it lies in both, by the larger
    one, and where in none its weight is 1. linear: (d + 1) / (overlap + 1). gaussian: 1 - exp(-x^2 / 2s^2), x = overlap - d being
    what is left to the inner end and s = max(1, sigma * overlap), so it falls from the edge inwards; that is kept so that results agree.
    """
    if mode not in ("none", "linear", "gaussian"):
        raise ValueError(f"unknown mode {mode}")
    at = np.arange(tile)
    ends = np.stack([at, at[::-1]])
    d = np.where(ends < overlap, ends, -1).max(0)
    if mode == "none":
        return [1.0] * tile
    rise = (d + 1) / (overlap + 1) if mode == "linear" else -np.expm1(-(((overlap - d) / max(1.0, sigma * overlap)) ** 2) / 2)
    return np.where(d >= 0, rise, 1.0).tolist()


def blend_tiles(probs: DataFrame, tiles: DataFrame, tile: int, stride: int, mode: str = "linear", sigma: float = 0.5, value: str = "p") -> DataFrame:
    """raster_id, class, x, y, score from overlapping tiles; pixels off the image are left out.

    none: the last tile by number wins. Else the weighted mean with the product of both sides' weights.
    """
    stride = _clamped(tile, stride)
    placed = probs.join(tiles, ["raster_id", "tile_id"]).filter((F.col("px") < F.col("src_w")) & (F.col("py") < F.col("src_h")))
    placed = placed.select("raster_id", "class", (F.col("src_x") + F.col("px")).alias("x"), (F.col("src_y") + F.col("py")).alias("y"), "px", "py", "tile_id", value)
    if mode == "none":
        return placed.groupBy("raster_id", "class", "x", "y").agg(F.max_by(value, "tile_id").alias("score"))
    weights = F.array(*(F.lit(w) for w in blend_weights(tile, tile - stride, mode, sigma)))
    w = F.get(weights, F.col("px")) * F.get(weights, F.col("py"))
    return placed.groupBy("raster_id", "class", "x", "y").agg((F.sum(F.col(value) * w) / F.sum(w)).alias("score"))


def pixel_grid(meta: DataFrame) -> DataFrame:
    """All pixels of all rasters: raster_id, x, y."""
    rows = meta.select("raster_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    return rows.repartition("raster_id", "y").select("raster_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), "y")


def final_mask(scores: DataFrame, meta: DataFrame, threshold: float = 0.5) -> DataFrame:
    """raster_id, x, y, v: the class with the best score, 0 below ``threshold`` and where no tile scored."""
    best = scores.groupBy("raster_id", "x", "y").agg(argmax_class(F.col("score"), F.col("class")).alias("class"), F.max("score").alias("_best"))
    mask = pixel_grid(meta).join(best, ["raster_id", "x", "y"], "left")
    return mask.select("raster_id", "x", "y", F.when(F.col("_best") >= threshold, F.col("class")).otherwise(0).alias("v"))


def class_counts(mask: DataFrame) -> DataFrame:
    """raster_id, class, n; taken before nodata is stamped."""
    return mask.groupBy("raster_id", F.col("v").alias("class")).agg(F.count("*").alias("n"))
