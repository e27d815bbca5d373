"""The affine map between pixels and ground coordinates, as Columns over a geotransform array of six doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_to_geo(x: Column, y: Column, gt: Column) -> tuple[Column, Column]:
    """gx = gt0 + x*gt1 + y*gt2, gy = gt3 + x*gt4 + y*gt5."""
    return gt[0] + x * gt[1] + y * gt[2], gt[3] + x * gt[4] + y * gt[5]


def geo_to_pixel(gx: Column, gy: Column, gt: Column) -> tuple[Column, Column]:
    """The inverse, rounded half away from zero; an error where the determinant is below 1e-15."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    safe = F.when(F.abs(det) < 1e-15, F.raise_error(F.lit("degenerate geotransform")).cast("double")).otherwise(det)
    dx, dy = gx - gt[0], gy - gt[3]
    return F.round((dx * gt[5] - dy * gt[2]) / safe).cast("int"), F.round((dy * gt[1] - dx * gt[4]) / safe).cast("int")


def shifted(gt: Column, x: Column, y: Column) -> Column:
    """The geotransform whose origin is pixel (x, y)."""
    gx, gy = pixel_to_geo(x, y, gt)
    return F.array(gx, gt[1], gt[2], gy, gt[4], gt[5])


def extent(gt: Column, width: Column, height: Column) -> Column:
    """Struct min_x, min_y, max_x, max_y of the two corners of a raster."""
    x1, y1 = pixel_to_geo(width, height, gt)
    return F.struct(F.least(gt[0], x1).alias("min_x"), F.least(gt[3], y1).alias("min_y"), F.greatest(gt[0], x1).alias("max_x"), F.greatest(gt[3], y1).alias("max_y"))
