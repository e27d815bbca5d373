"""Raster operators on pixel tables.

``px``: raster_id, band, x, y, v (null: missing). ``meta``: raster_id, width, height, band_count, gt, crs, bands (dtype, nodata).
The meta table has a row for each raster and may grow with the data, so it is joined without a broadcast hint; Spark
broadcasts it where it is small. Parameter errors are raised at once; conditions on data give an error only with ``strict``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.affine import geo_to_pixel, shifted

SAME = 1e-6  # two values within this are the same nodata value

#: Smallest and largest value of each type on disk.
RANGES = {"Byte": (0, 255), "UInt16": (0, 65535), "Int16": (-32768, 32767), "UInt32": (0, 4294967295), "Int32": (-2147483648, 2147483647)}


def is_nodata(v: Column, nodata: Column) -> Column:
    """Missing, or the band's nodata value; a NaN nodata value means missing."""
    return v.isNull() | F.coalesce(F.abs(v - nodata) < SAME, F.lit(False))


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def _one_band(px: DataFrame, meta: DataFrame, band: int, strict: bool) -> DataFrame:
    _need(band >= 0, "band must not be negative")
    if strict:
        _need(meta.filter(F.col("band_count") <= band).isEmpty(), f"some raster has no band {band}")
    return px.filter(F.col("band") == band).join(meta.select("raster_id", F.get(F.col("bands"), F.lit(band))["nodata"].alias("_nodata")), "raster_id")


def raster_threshold(px: DataFrame, meta: DataFrame, threshold: float = 128.0, band: int = 0, strict: bool = False) -> DataFrame:
    """1 where the value, compared as float, reaches the threshold, else 0; missing and nodata give 0."""
    one = _one_band(px, meta, band, strict)
    over = F.col("v").cast("float") >= F.lit(threshold).cast("float")
    return one.select("raster_id", F.lit(0).alias("band"), "x", "y", F.when(is_nodata(F.col("v"), F.col("_nodata")), 0).when(over, 1).otherwise(0).alias("v"))


def raster_threshold_range(px: DataFrame, meta: DataFrame, low: float, high: float, band: int = 0, strict: bool = False) -> DataFrame:
    """1 where low <= value <= high, compared as float, else 0; missing and nodata give 0."""
    _need(low <= high, "low must not exceed high")
    one = _one_band(px, meta, band, strict)
    inside = F.col("v").cast("float").between(F.lit(low).cast("float"), F.lit(high).cast("float"))
    return one.select("raster_id", F.lit(0).alias("band"), "x", "y", F.when(is_nodata(F.col("v"), F.col("_nodata")), 0).when(inside, 1).otherwise(0).alias("v"))


def raster_normalize_range(px: DataFrame, low: float, high: float) -> DataFrame:
    """(clamp(v) - low) / (high - low); missing stays missing."""
    _need(high > low, "high must exceed low")
    return px.withColumn("v", F.when(F.col("v").isNotNull(), (F.least(F.greatest(F.col("v"), F.lit(float(low))), F.lit(float(high))) - low) / (high - low)))


def band_stats(px: DataFrame, keys: tuple[str, ...] = ("raster_id", "band")) -> DataFrame:
    """n, min, max, mean and population standard deviation of the values that are there."""
    return px.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def raster_normalize(px: DataFrame) -> DataFrame:
    """Min-max over each band; a range below 1e-10 gives 0, missing stays missing."""
    stats = px.groupBy("raster_id", "band").agg(F.min("v").alias("_min"), F.max("v").alias("_max"))
    spread = F.col("_max") - F.col("_min")
    scaled = F.when(F.col("v").isNull(), None).when(spread < 1e-10, 0.0).otherwise((F.col("v") - F.col("_min")) / spread)
    return px.join(stats, ["raster_id", "band"]).select("raster_id", "band", "x", "y", scaled.alias("v"))


def cast_raster(px: DataFrame, dtype: str) -> DataFrame:
    """Values as a type on disk holds them: clamped and rounded for integers, float32 or float64 else; missing stays missing."""
    if dtype in ("Float32", "Float64"):
        return px.withColumn("v", F.col("v").cast("float").cast("double") if dtype == "Float32" else F.col("v").cast("double"))
    _need(dtype in RANGES, f"unknown type {dtype}")
    low, high = RANGES[dtype]
    return px.withColumn("v", F.when(F.col("v").isNotNull(), F.least(F.greatest(F.round("v"), F.lit(float(low))), F.lit(float(high)))))


def apply_nodata_mask(mask: DataFrame, px: DataFrame, meta: DataFrame, fill: int = 255) -> DataFrame:
    """``fill`` wherever any band has band 0's nodata value; rasters without one are unchanged. mask: raster_id, x, y, v."""
    sentinel = meta.select("raster_id", F.get(F.col("bands"), F.lit(0))["nodata"].alias("_nodata")).filter("_nodata is not null")
    hit = F.when(F.isnan("_nodata"), F.col("v").isNull()).otherwise(F.coalesce(F.abs(F.col("v") - F.col("_nodata")) < SAME, F.lit(False)))
    void = px.join(sentinel, "raster_id").groupBy("raster_id", "x", "y").agg(F.bool_or(hit).alias("_void"))
    return mask.join(void, ["raster_id", "x", "y"], "left").withColumn("v", F.when(F.coalesce("_void", F.lit(False)), F.lit(fill)).otherwise(F.col("v"))).drop("_void")


# ---------------------------------------------------------------- windows


def clip_window(meta: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """raster_id and the pixel window (x0, y0, x1, y1, last ones included) of a ground box; rasters that it misses are absent."""
    gt = F.col("gt")
    ax, ay = geo_to_pixel(F.lit(float(min_x)), F.lit(float(max_y)), gt)
    bx, by = geo_to_pixel(F.lit(float(max_x)), F.lit(float(min_y)), gt)
    window = meta.select(
        "raster_id",
        F.greatest(F.lit(0), ax).alias("x0"),
        F.greatest(F.lit(0), ay).alias("y0"),
        F.least(F.col("width") - 1, bx).alias("x1"),
        F.least(F.col("height") - 1, by).alias("y1"),
    )
    return window.filter("x0 <= x1 and y0 <= y1")


def _cut(px: DataFrame, meta: DataFrame, window: DataFrame) -> tuple[DataFrame, DataFrame]:
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    cut = px.join(window, "raster_id").filter(inside).select("raster_id", "band", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "v")
    new = meta.join(window, "raster_id").withColumns({"width": F.col("x1") - F.col("x0") + 1, "height": F.col("y1") - F.col("y0") + 1, "gt": shifted(F.col("gt"), F.col("x0"), F.col("y0"))})
    return cut, new.select(meta.columns)


def raster_clip_bbox(px: DataFrame, meta: DataFrame, bbox: tuple[float, float, float, float], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pixels and meta inside (min_x, min_y, max_x, max_y); the pixel that holds the far corner belongs to it."""
    window = clip_window(meta, *bbox)
    if strict:
        _need(meta.join(window, "raster_id", "left_anti").isEmpty(), "the box misses some raster")
    return _cut(px, meta, window)


def raster_clip_pixels(px: DataFrame, meta: DataFrame, x0: int, y0: int, width: int, height: int, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pixels and meta of an exact window; rasters that do not hold it whole are absent, or an error with ``strict``."""
    _need(x0 >= 0 and y0 >= 0 and width > 0 and height > 0, "bad window")
    holds = (F.col("width") >= x0 + width) & (F.col("height") >= y0 + height)
    if strict:
        _need(meta.filter(~holds).isEmpty(), "the window exceeds some raster")
    window = meta.filter(holds).select("raster_id", F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(x0 + width - 1).alias("x1"), F.lit(y0 + height - 1).alias("y1"))
    return _cut(px, meta, window)


# ---------------------------------------------------------------- resampling


def _rows_of(meta: DataFrame, width: Column, height: Column) -> DataFrame:
    """One row for each target row of each raster, with its source size; columns of it are made where they are joined."""
    return meta.select("raster_id", F.col("width").alias("_sw"), F.col("height").alias("_sh"), width.cast("int").alias("_tw"), height.cast("int").alias("_th"))


def _source_at(target: Column, source_size: Column, target_size: Column) -> Column:
    return (target + 0.5) * (source_size.cast("double") / target_size) - 0.5


def _target_cells(sizes: DataFrame) -> DataFrame:
    """All target pixels; rows are spread over tasks before their columns are made."""
    rows = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("_th") - 1)))
    return rows.repartition("raster_id", "y").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_tw") - 1)))


def resample_meta(meta: DataFrame, width: Column, height: Column) -> DataFrame:
    """The new size; only the pixel size in the geotransform is scaled."""
    gt = F.col("gt")
    new = meta.withColumns({"_w": width.cast("int"), "_h": height.cast("int")})
    gt_new = F.array(gt[0], gt[1] * (F.col("width").cast("double") / F.col("_w")), gt[2], gt[3], gt[4], gt[5] * (F.col("height").cast("double") / F.col("_h")))
    return new.withColumn("gt", gt_new).withColumns({"width": F.col("_w"), "height": F.col("_h")}).select(meta.columns)


def raster_resample(px: DataFrame, meta: DataFrame, width: int | Column, height: int | Column, method: str = "nearest") -> tuple[DataFrame, DataFrame]:
    """Every raster at a new size, by ``nearest`` or ``bilinear``.

    nearest: the rounded source place, clamped. bilinear: four neighbours of the floor, weights shared out among those not
    missing; the fraction comes from the unclamped place, so the outermost half pixel blends as the clamped pair does.
    """
    for size in (width, height):
        _need(isinstance(size, Column) or size > 0, "target size must be positive")
    _need(method in ("nearest", "bilinear"), f"unknown method {method}")
    w, h = (s if isinstance(s, Column) else F.lit(s) for s in (width, height))
    cells = _target_cells(_rows_of(meta, w, h))
    bands = meta.select("raster_id", F.explode(F.sequence(F.lit(0), F.col("band_count") - 1)).alias("band"))
    sx, sy = _source_at(F.col("x"), F.col("_sw"), F.col("_tw")), _source_at(F.col("y"), F.col("_sh"), F.col("_th"))
    clamp = lambda v, size: F.greatest(F.lit(0), F.least(size - 1, v.cast("int")))
    source = px.select("raster_id", "band", F.col("x").alias("_x"), F.col("y").alias("_y"), "v")
    if method == "nearest":
        wanted = cells.select("raster_id", "x", "y", clamp(F.round(sx), F.col("_sw")).alias("_x"), clamp(F.round(sy), F.col("_sh")).alias("_y")).join(bands, "raster_id")
        return wanted.join(source, ["raster_id", "band", "_x", "_y"], "left").select("raster_id", "band", "x", "y", "v"), resample_meta(meta, w, h)
    x0, y0 = F.greatest(F.lit(0), F.floor(sx).cast("int")), F.greatest(F.lit(0), F.floor(sy).cast("int"))
    x1, y1 = F.least(F.col("_sw") - 1, x0 + 1), F.least(F.col("_sh") - 1, y0 + 1)
    fx, fy = sx - F.floor(sx), sy - F.floor(sy)
    corner = lambda x, y, weight: F.struct(x.alias("_x"), y.alias("_y"), weight.alias("w"))
    corners = F.array(corner(x0, y0, (1 - fx) * (1 - fy)), corner(x1, y0, fx * (1 - fy)), corner(x0, y1, (1 - fx) * fy), corner(x1, y1, fx * fy))
    wanted = cells.select("raster_id", "x", "y", F.explode(corners).alias("c")).select("raster_id", "x", "y", "c.*").join(bands, "raster_id")
    met = wanted.join(source, ["raster_id", "band", "_x", "_y"], "left")
    weight = F.sum(F.when(F.col("v").isNotNull(), F.col("w")).otherwise(0.0))
    out = met.groupBy("raster_id", "band", "x", "y").agg(F.sum(F.col("v") * F.col("w")).alias("_sum"), weight.alias("_weight"))
    return out.select("raster_id", "band", "x", "y", F.when(F.col("_weight") > 0, F.col("_sum") / F.col("_weight")).alias("v")), resample_meta(meta, w, h)


def resample_to_resolution(px: DataFrame, meta: DataFrame, resolution: float, method: str = "bilinear") -> tuple[DataFrame, DataFrame]:
    """Resample so that a pixel measures ``resolution``: sizes max(1, round(size * |gt1| / resolution)); a zero pixel size counts as 1."""
    _need(resolution > 0, "resolution must be positive")
    size = F.abs(F.col("gt")[1])
    scale = F.when(size == 0, 1.0).otherwise(size) / resolution
    new = lambda c: F.greatest(F.lit(1), F.round(F.col(c) * scale).cast("int"))
    return raster_resample(px, meta, new("width"), new("height"), method)


# ---------------------------------------------------------------- mosaic, overviews


def mosaic_grid(meta: DataFrame, order: str = "raster_id") -> DataFrame:
    """One row: the union extent at the pixel size of the first raster by ``order``, with width and height (at least 1)."""
    gt = F.col("gt")
    x1, y1 = gt[0] + F.col("width") * gt[1], gt[3] + F.col("height") * gt[5]
    first = F.min_by(F.struct(F.abs(gt[1]).alias("px"), F.abs(gt[5]).alias("py"), "crs", "band_count"), F.col(order))
    grid = meta.agg(F.min(F.least(gt[0], x1)).alias("min_x"), F.max(F.greatest(gt[0], x1)).alias("max_x"), F.min(F.least(gt[3], y1)).alias("min_y"), F.max(F.greatest(gt[3], y1)).alias("max_y"), first.alias("first"))
    tiny = F.raise_error(F.lit("the pixel size is degenerate")).cast("double")
    grid = grid.select("min_x", "min_y", "max_x", "max_y", *(F.when(F.col("first")[c] < 1e-15, tiny).otherwise(F.col("first")[c]).alias(c) for c in ("px", "py")))
    span = lambda a, b, p: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / F.col(p)).cast("int"))
    return grid.withColumns({"width": span("min_x", "max_x", "px"), "height": span("min_y", "max_y", "py")})


MOSAIC = {
    "overwrite": lambda v, seq: F.max_by(v, seq),
    "first": lambda v, seq: F.min_by(v, seq),
    "mean": lambda v, seq: F.avg(v),
    "max": lambda v, seq: F.max(v),
    "min": lambda v, seq: F.min(v),
}


def raster_mosaic(px: DataFrame, meta: DataFrame, strategy: str = "first", order: str = "raster_id", strict: bool = False) -> DataFrame:
    """band, x, y, v over the union grid; where rasters overlap the strategy decides by ``order`` (a column of meta).

    Missing values take no part; cells that none covers are absent. With ``strict``, band counts and CRS must agree.
    """
    _need(strategy in MOSAIC, f"unknown strategy {strategy}")
    if strict:
        kinds = meta.select("band_count", "crs").distinct().limit(2).count()
        _need(kinds == 1, "the rasters are none, or differ in bands or CRS")
    grid = mosaic_grid(meta, order).select(F.struct("*")).scalar()
    placed = meta.select("raster_id", F.col("gt"), F.col(order).alias("_seq"), grid.alias("g"))
    placed = placed.select("raster_id", "_seq", F.round((F.col("gt")[0] - F.col("g.min_x")) / F.col("g.px")).cast("int").alias("_dx"), F.round((F.col("g.max_y") - F.col("gt")[3]) / F.col("g.py")).cast("int").alias("_dy"))
    moved = px.filter("v is not null").join(placed, "raster_id").select("band", (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"), "v", "_seq")
    return moved.groupBy("band", "x", "y").agg(MOSAIC[strategy](F.col("v"), F.col("_seq")).alias("v"))


def build_overviews(px: DataFrame, meta: DataFrame, min_dim: int = 512) -> DataFrame:
    """px with ``level``: factors 2, 4, 8, ... while the larger side, halved each time, exceeds ``min_dim``; a cell is its top left pixel."""
    size = F.greatest("width", "height")
    levels = meta.select("raster_id", F.filter(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.when(F.floor(size / F.pow(F.lit(2.0), k - 1)) > min_dim, F.pow(F.lit(2.0), k).cast("int"))), lambda f: f.isNotNull()).alias("_factors"))
    wide = px.join(levels, "raster_id").withColumn("level", F.explode("_factors")).filter("x % level = 0 and y % level = 0")
    return wide.select("raster_id", "level", "band", F.expr("x div level").cast("int").alias("x"), F.expr("y div level").cast("int").alias("y"), "v")
