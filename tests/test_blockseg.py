"""Segmentation on blocks against segmentation on pixel rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import blockseg as BS
from cairn.operators import segment as S
from cairn.operators.tiles import tile_offsets
from cairn.sources import raster as SR


def three_classes(scale=1.0, shift=0.0):
    """A model of three classes by the first two bands; a closure, so that it travels to the workers."""

    def run(x):
        a, b = x[:, :1] * scale + shift, x[:, 1:2] * scale + shift
        return np.concatenate([3 - a / 30, a / 20 - 2, b / 25 - 2], axis=1)

    return run


def rasters(spark):
    rng = np.random.default_rng(5)
    rows, meta = [], []
    for r, (w, h) in {"a": (37, 29), "b": (10, 50), "c": (5, 4), "d": (40, 40)}.items():
        v = np.round(rng.random((2, h, w)) * 100)
        v[:, :, : w // 2][rng.random((2, h, w // 2)) < 0.1] = np.nan
        if r == "d":
            v[:, :24, :] = 7.0  # nothing but nodata: some tiles are skipped
        rows += [(r, b, x, y, None if np.isnan(v[b, y, x]) else float(v[b, y, x])) for b in range(2) for y in range(h) for x in range(w)]
        meta.append((r, w, h, 2, [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], "EPSG:32650", [("Float64", 7.0), ("Float64", 7.0)]))
    px = spark.createDataFrame(rows, "raster_id string, band int, x int, y int, v double")
    return px, spark.createDataFrame(meta, "raster_id string, width int, height int, band_count int, gt array<double>, crs string, bands array<struct<dtype:string,nodata:float>>")


@pytest.mark.parametrize("blend,normalize,size", [("none", "none", 8), ("linear", "none", 16), ("gaussian", "minmax", 8), ("linear", "zscore", 12)])
def test_blocks_say_what_pixel_rows_say(spark, blend, normalize, size):
    px, meta = rasters(spark)
    model = three_classes() if normalize == "none" else three_classes(40.0, 40.0)
    c = S.SegmentConfig(tile=16, stride=11, channels=2, blend=blend, normalize=normalize, nodata=7.0, threshold=0.4)
    want, got = S.segment_large(px, meta, model, c), BS.segment_blocks(SR.from_pixels(px, meta, size), meta, model, c)
    key = lambda df: {(r.raster_id, r.x, r.y): int(r.v) for r in df.collect()}
    a, b = key(want.mask), key(SR.to_pixels(got.mask))
    assert a.keys() == b.keys() and sum(a[k] != b[k] for k in a) <= len(a) // 500  # scores that tie but for rounding
    assert {tuple(r) for r in got.tiles.select("raster_id", "tile_id", "skipped").collect()} == {tuple(r) for r in want.tiles.select("raster_id", "tile_id", "skipped").collect()}
    assert got.tiles.filter("skipped").count() > 0
    assert got.counts.agg(F.sum("n")).first()[0] == want.counts.agg(F.sum("n")).first()[0]


def test_failing_tiles_leave_class_0(spark):
    px, meta = rasters(spark)

    def fails(x):
        raise RuntimeError("no scores")

    got = BS.segment_blocks(SR.from_pixels(px, meta, 16), meta, fails, S.SegmentConfig(tile=16, stride=16, channels=2, nodata=7.0))
    assert {r["class"] for r in got.counts.collect()} == {0} and got.tiles.filter("error IS NOT NULL").count() == got.tiles.filter("NOT skipped").count() > 0


@pytest.mark.parametrize("length,tile,stride", [(37, 16, 11), (5, 16, 11), (16, 16, 16), (33, 16, 16), (17, 16, 1)])
def test_offsets_are_those_of_the_grid(spark, length, tile, stride):
    assert spark.range(1).select(tile_offsets(F.lit(length), tile, stride)).first()[0] == BS.offsets(length, tile, stride)
