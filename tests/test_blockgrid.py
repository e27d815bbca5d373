"""Operators on blocks against those on pixel rows and against plain arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import blockgrid as BG
from cairn.operators import polygonize as G
from cairn.operators import raster as R
from cairn.sources import raster as SR


def rasters(spark, shapes, seed=0, size=8):
    """Rasters of these (width, height) with a tenth missing: pixel rows, blocks, meta, values."""
    rng = np.random.default_rng(seed)
    held = {f"r{i:02d}": np.where(rng.random((h, w)) < 0.1, np.nan, np.round(rng.random((h, w)) * 100)) for i, (w, h) in enumerate(shapes)}
    rows = [(r, 0, x, y, None if np.isnan(v[y, x]) else float(v[y, x])) for r, v in held.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    px = spark.createDataFrame(rows, "raster_id string, band int, x int, y int, v double")
    meta = [(r, v.shape[1], v.shape[0], 1, [10.0 + 3 * i, 1.0, 0.0, 50.0 - 2 * i, 0.0, -1.0], "EPSG:32650", i) for i, (r, v) in enumerate(held.items())]
    meta = spark.createDataFrame(meta, "raster_id string, width int, height int, band_count int, gt array<double>, crs string, seq int")
    return px, SR.from_pixels(px, meta, size), meta, held


def cells(px):
    return sorted((r.raster_id, r.band, r.x, r.y, None if r.v is None else round(r.v, 3)) for r in px.select("raster_id", "band", "x", "y", "v").collect())


@pytest.mark.parametrize("method,w,h", [("nearest", 5, 31), ("bilinear", 5, 31), ("bilinear", 50, 3), ("nearest", 50, 3), ("bilinear", 1, 1)])
def test_resample_equals_pixel_rows(spark, method, w, h):
    px, chunks, meta, _ = rasters(spark, [(20, 13), (9, 30), (1, 1)])
    got, new = BG.resample(chunks, meta, w, h, method)
    want, new_too = R.raster_resample(px, meta, w, h, method)
    a, b = cells(SR.to_pixels(got)), cells(want)
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert np.allclose([np.nan if x[4] is None else x[4] for x in a], [np.nan if x[4] is None else x[4] for x in b], atol=2e-3, equal_nan=True)
    assert sorted(map(str, new.collect())) == sorted(map(str, new_too.collect()))


def test_clip_reads_blocks_of_the_window_only(spark, tmp_path):
    px, chunks, meta, held = rasters(spark, [(40, 33), (25, 50)])
    chunks.write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    got, new = BG.clip_pixels(stored, meta, 11, 9, 10, 14)
    execution = spark._jvm.org.apache.spark.sql.execution
    plan = got._jdf.queryExecution().explainString(execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(cx,1)" in plan and "LessThanOrEqual(cy,2)" in plan
    back = SR.to_pixels(got).collect()
    assert len(back) == 2 * 140 and all((r.v is None and np.isnan(held[r.raster_id][r.y + 9, r.x + 11])) or r.v == held[r.raster_id][r.y + 9, r.x + 11] for r in back)
    assert {(r.width, r.height) for r in new.collect()} == {(10, 14)}
    assert BG.clip_pixels(stored, meta, 30, 0, 20, 5)[0].isEmpty()
    want, _ = R.raster_clip_bbox(px, meta, (14.0, 30.0, 22.0, 44.0))
    assert cells(SR.to_pixels(BG.clip_bbox(stored, meta, (14.0, 30.0, 22.0, 44.0))[0])) == cells(want)


@pytest.mark.parametrize("strategy", sorted(R.MOSAIC))
def test_mosaic_of_many_rasters(spark, monkeypatch, strategy):
    monkeypatch.setattr(BG, "AT_ONCE", 3)
    px, chunks, meta, _ = rasters(spark, [(20, 13), (9, 30), (30, 9), (16, 16), (8, 8), (1, 1), (23, 7)])
    got = SR.to_pixels(BG.mosaic(chunks, meta, strategy, "seq")).filter("v is not null")
    want = R.raster_mosaic(px, meta, strategy, "seq")
    key = lambda df: sorted((r.band, r.x, r.y, round(r.v, 3)) for r in df.collect())
    assert [x[:3] for x in key(got)] == [x[:3] for x in key(want)]
    assert np.allclose([x[3] for x in key(got)], [x[3] for x in key(want)], atol=2e-3)


def test_overviews_level_by_level(spark):
    px, chunks, meta, _ = rasters(spark, [(40, 33), (70, 5), (3, 3)])
    got, want = BG.build_overviews(chunks, meta, 9), R.build_overviews(px, meta, 9)
    for level in (2, 4, 8):
        assert cells(SR.to_pixels(got.filter(F.col("level") == level))) == cells(want.filter(F.col("level") == level))
    assert BG.build_overviews(chunks, meta, 1000).isEmpty()


@pytest.mark.parametrize("seed,density", [(1, 0.5), (3, 1.0)])
def test_components_across_seams(spark, seed, density):
    rng = np.random.default_rng(seed)
    mask = rng.random((37, 29)) < density
    rows = [("m", 0, x, y, float(mask[y, x])) for y in range(37) for x in range(29)]
    px = spark.createDataFrame(rows, "raster_id string, band int, x int, y int, v double")
    meta = spark.createDataFrame([("m", 29, 37, 1, [0.0, 1.0, 0.0, 0.0, 0.0, 1.0], "EPSG:32650")], "raster_id string, width int, height int, band_count int, gt array<double>, crs string")
    labels = G.label_blocks(SR.from_pixels(px, meta, 8))
    box = ("pixels", "min_x", "max_x", "min_y", "max_y")
    key = lambda stats: sorted(tuple(r[c] for c in box) for r in stats.collect())
    assert key(G.component_stats(labels)) == key(G.component_stats(G.label_components(px.drop("band"))))
    for mode in ("edge", "centre"):
        rings = lambda df: sorted(sorted(sorted((p.x, p.y) for p in ring[:-1]) for ring in r.rings) for r in df.collect())
        want = rings(G.mask_to_polygons(px.drop("band"), meta, 1, mode))
        assert rings(G.label_polygons(labels, meta, mode)) == want
        assert rings(G.block_polygons(SR.from_pixels(px, meta, 8), meta, 1, mode)) == want
    assert G.label_blocks(SR.from_pixels(px.filter("false"), meta, 8)).isEmpty()
