"""Contracts of the raster, point, tile and polygon operators on small inputs."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions.crs import code_of
from cairn.operators import points as P
from cairn.operators import polygonize as G
from cairn.operators import raster as R
from cairn.operators import segment as S
from cairn.operators import tiles as T
from cairn.operators import vector as V
from cairn.plans.components import connected_components
from cairn.sources import raster as SR

PX = "raster_id string, band int, x int, y int, v double"
META = "raster_id string, width int, height int, band_count int, gt array<double>, crs string, bands array<struct<dtype:string,nodata:float>>, seq int"


def meta_of(spark, *rows):
    return spark.createDataFrame([(n, w, h, 1, gt or [100.0, 1.0, 0.0, 200.0, 0.0, -1.0], "EPSG:4326", [("Float64", nodata)], i) for i, (n, w, h, nodata, gt) in enumerate(rows)], META)


def pixels(spark, grid, name="r"):
    return spark.createDataFrame([(name, 0, x, y, None if v is None else float(v)) for y, row in enumerate(grid) for x, v in enumerate(row)], PX)


def grid_of(px):
    return {(r.x, r.y): r.v for r in px.collect()}


def test_threshold_treats_missing_and_nodata_as_zero(spark):
    px, meta = pixels(spark, [[1, None, 7], [5, 4.999, -9]]), meta_of(spark, ("r", 3, 2, -9.0, None))
    assert [grid_of(R.raster_threshold(px, meta, 5.0))[k] for k in ((0, 0), (1, 0), (2, 0), (0, 1), (1, 1), (2, 1))] == [0, 0, 1, 1, 0, 0]
    with pytest.raises(ValueError):
        R.raster_threshold(px, meta, 5.0, band=3, strict=True)
    with pytest.raises(ValueError):
        R.raster_threshold_range(px, meta, 2.0, 1.0)


def test_normalize(spark):
    flat = grid_of(R.raster_normalize(pixels(spark, [[3, None, 3]])))
    assert flat == {(0, 0): 0.0, (1, 0): None, (2, 0): 0.0}
    assert grid_of(R.raster_normalize_range(pixels(spark, [[-5, None, 50, 500]]), 0, 100)) == {(0, 0): 0.0, (1, 0): None, (2, 0): 0.5, (3, 0): 1.0}


def test_clip_twice_is_clip_once(spark):
    px, meta = pixels(spark, np.arange(80).reshape(8, 10)), meta_of(spark, ("r", 10, 8, None, None))
    box = (102.0, 194.0, 105.0, 198.0)
    once, m1 = R.raster_clip_bbox(px, meta, box)
    m = m1.first()
    assert (m.width, m.height, m.gt[0], m.gt[3]) == (4, 5, 102.0, 198.0)
    again, m2 = R.raster_clip_bbox(once, m1, (102.0, 193.0, 106.0, 198.0))
    assert grid_of(again) == grid_of(once)
    with pytest.raises(ValueError):
        R.raster_clip_bbox(px, meta, (500.0, 500.0, 510.0, 510.0), strict=True)


def test_mosaic_strategies(spark):
    a, b = pixels(spark, [[1, 2], [3, None]], "a"), pixels(spark, [[10, 20], [30, 40]], "b")
    meta = meta_of(spark, ("a", 2, 2, None, None), ("b", 2, 2, None, [101.0, 1.0, 0.0, 200.0, 0.0, -1.0]))
    want = {"first": 2.0, "overwrite": 10.0, "mean": 6.0, "max": 10.0, "min": 2.0}
    for strategy, v in want.items():
        got = {(r.x, r.y): r.v for r in R.raster_mosaic(a.unionByName(b), meta, strategy, "seq", strict=True).collect()}
        assert got[(1, 0)] == v and got[(1, 1)] == 30.0 and got[(2, 1)] == 40.0 and len(got) == 6


def test_chunks_keep_pixels(spark, tmp_path):
    px, meta = pixels(spark, [[x + 20 * y if (x + y) % 5 else None for x in range(20)] for y in range(9)]), meta_of(spark, ("r", 20, 9, None, None))
    assert grid_of(SR.to_pixels(SR.from_pixels(px, meta, 8))) == grid_of(px)
    SR.write_raster(px, meta, str(tmp_path / "r"))
    read_meta, chunks = SR.read_raster(spark, str(tmp_path / "r"))
    assert grid_of(SR.to_pixels(chunks)) == grid_of(px) and read_meta.first().width == 20


def test_formats(spark):
    names = ["a/b.TIF", "x.tif.cog", "c.geojson", "p.las", "d.csv", "none", "dir.tif/none"]
    df = spark.createDataFrame([(n,) for n in names], "p string").select(SR.detect_format(F.col("p")), SR.detect_format(F.col("p"), True))
    assert [tuple(r) for r in df.collect()] == [("Raster", "Raster"), ("Raster", "Raster"), ("Vector", "Vector"), ("PointCloud", "PointCloud"), ("Unknown", "Vector"), ("Unknown", "Unknown"), ("Unknown", "Unknown")]


# ---------------------------------------------------------------- points


def cloud(spark, xyz):
    return spark.createDataFrame([("c", i, *map(float, p), float(i), i % 5) for i, p in enumerate(xyz)], "cloud_id string, ord long, x double, y double, z double, intensity double, classification int")


@pytest.mark.parametrize("flat", [False, True])
def test_neighbours_match_brute_force(spark, flat):
    rng = np.random.default_rng(4)
    xyz = rng.exponential(size=(120, 3)) * [1, 5, 0 if flat else 2]
    xyz[-3:] += 50
    d = np.sort(np.linalg.norm(xyz[:, None] - xyz[None, :], axis=2), axis=1)[:, :6]
    got = {}
    for r in P.knn_self_join(cloud(spark, xyz), 6).collect():
        got.setdefault(r.ord, []).append(r.dist)
    assert all(np.allclose(sorted(got[i]), d[i]) for i in range(120))
    mean = d.mean(1)
    keep = {int(i) for i in np.flatnonzero(mean <= mean.mean() + mean.std())}
    assert {r.ord for r in P.outlier_removal(cloud(spark, xyz), 6, 1.0).collect()} == keep


def test_neighbours_of_few_points(spark):
    assert {(r.ord, r.other) for r in P.knn_self_join(cloud(spark, [(0, 0, 0), (1, 1, 1)]), 50).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert P.knn_self_join(cloud(spark, [(0, 0, 0)]).limit(0), 3).isEmpty()
    with pytest.raises(ValueError):
        P.knn_self_join(cloud(spark, [(0, 0, 0)]), 0)


@pytest.mark.parametrize("ratio", [0.001, 0.1, 0.37, 1.0])
def test_random_downsample_is_exact(spark, ratio):
    pc = cloud(spark, [(i, i, i) for i in range(1003)])
    got = [r.ord for r in P.random_downsample(pc, ratio, 3).collect()]
    assert len(got) == len(set(got)) == max(1, math.ceil(1003 * ratio))
    assert sorted(got) == sorted(r.ord for r in P.random_downsample(pc.repartition(7), ratio, 3).collect())


def test_voxels(spark):
    got = P.voxel_downsample(cloud(spark, [(0.1, 0, 0), (0.9, 0, 0), (-0.5, 0, 0)]), 1.0).collect()
    assert sorted((r.cx, r.x, r.classification) for r in got) == [(-1, -0.5, 2), (0, 0.5, 1)]


# ---------------------------------------------------------------- tiles


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 59), st.sampled_from([4, 8, 16]), st.integers(1, 16))
def test_blend_weights_and_offsets(length, tile, stride):
    stride = min(stride, tile)
    weights = T.blend_weights(tile, tile - stride, "linear")
    assert all(0 < w <= 1 for w in weights)
    assert all(0 < w <= 1 for w in T.blend_weights(tile, tile - stride, "gaussian"))


def test_tiles_cover_every_pixel(spark):
    for w, h, tile, stride in ((20, 9, 8, 3), (8, 8, 8, 8), (5, 30, 16, 12), (33, 17, 16, 16)):
        meta = meta_of(spark, ("r", w, h, None, None))
        tiles, cells = T.tile_raster(pixels(spark, np.ones((h, w))), meta, tile, stride)
        axis = lambda n: sorted({k * stride for k in range(n) if k * stride + tile <= n} | {max(0, n - tile)})
        want = [(x, y) for y in axis(h) for x in axis(w)]
        assert [(r.src_x, r.src_y) for r in tiles.orderBy("tile_id").collect()] == want
        assert cells.count() == sum(min(tile, w - x) * min(tile, h - y) for x, y in want)
        blended = T.blend_tiles(cells.select("raster_id", "tile_id", F.lit(0).alias("class"), F.col("tx").alias("px"), F.col("ty").alias("py"), F.lit(0.7).alias("p")), tiles, tile, stride, "gaussian")
        assert blended.count() == w * h and blended.filter("abs(score - 0.7) > 1e-12").isEmpty()


def test_scores_report_errors(spark):
    tensors = spark.createDataFrame([("a", 0, [1.0] * 4, [1, 1, 2, 2]), ("b", 0, [-1.0] * 4, [1, 1, 2, 2])], "raster_id string, tile_id long, tensor array<float>, shape array<long>")

    def model(x):
        if (x < 0).any():
            raise RuntimeError("bad tile")
        return np.concatenate([x, 2 * x], axis=1)

    got = {r.raster_id: r for r in S.score(tensors, model, 1).collect()}
    assert got["a"].scores == [1.0] * 4 + [2.0] * 4 and got["a"].scores_shape == [1, 2, 2, 2] and got["a"].error is None
    assert got["b"].scores is None and got["b"].error == "bad tile"
    report = S.batch_report(S.score(tensors, model, 1), tensors.select("raster_id"))
    assert tuple(S.overall_report(report).first()) == (False, 1, 2, "b: bad tile")
    assert S.score(tensors, lambda x: x[:, 0], 2).filter("error is null").isEmpty()
    with pytest.raises(ValueError):
        S.score(tensors, None)


# ---------------------------------------------------------------- components and rings


def mask_of(spark, rows):
    cells = [("m", x, y, int(c != ".")) for y, row in enumerate(rows) for x, c in enumerate(row)]
    return spark.createDataFrame(cells, "raster_id string, x int, y int, v int"), meta_of(spark, ("m", len(rows[0]), len(rows), None, [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]))


def block(n, holes=()):
    return ["".join("." if any(a <= x < b and c <= y < d for a, b, c, d in holes) else "#" for x in range(n)) for y in range(n)]


@pytest.mark.parametrize(
    "rows,outer,points,holes",
    [(block(10), 81, 5, []), (block(16, [(4, 12, 4, 12)]), 225, 5, [-79]), (block(26, [(4, 8, 4, 8), (15, 19, 15, 19)]), 625, 5, [-23, -23]), (["##..", "##..", "..##", "..##"], 2, 11, []), (["#..", "#..", "###"], 0.5, 6, [])],
)
def test_centre_rings(spark, rows, outer, points, holes):
    shapes = G.mask_to_polygons(*mask_of(spark, rows)).collect()
    assert len(shapes) == 1
    rings = [[(p.x, p.y) for p in r] for r in shapes[0].rings]
    assert (G.signed_area(rings[0]), len(rings[0])) == (outer, points)
    assert [G.signed_area(r) for r in rings[1:]] == holes


def test_thin_shapes_give_no_centre_rings(spark):
    for rows in (["#"], ["#####"]):
        assert G.mask_to_polygons(*mask_of(spark, rows)).isEmpty()
    touching = G.mask_to_polygons(*mask_of(spark, ["##..", "##..", "..##", "..##"])).collect()
    assert len(touching) == 1


@pytest.mark.parametrize("seed", range(4))
def test_edge_rings_enclose_the_pixels(spark, seed):
    rng = random.Random(seed)
    rows = ["".join(rng.choice("##.") for _ in range(12)) for _ in range(9)]
    mask, meta = mask_of(spark, rows)
    shapes = G.mask_to_polygons(mask, meta, mode="edge").collect()
    total = sum(abs(G.signed_area([(p.x, p.y) for p in s.rings[0]])) - sum(abs(G.signed_area([(p.x, p.y) for p in r])) for r in s.rings[1:]) for s in shapes)
    assert total == sum(r.count("#") for r in rows)
    seen, n = set(), 0
    for y, row in enumerate(rows):
        for x, c in enumerate(row):
            if c == "#" and (x, y) not in seen:
                n += 1
                todo = [(x, y)]
                while todo:
                    a, b = todo.pop()
                    if (a, b) in seen or not (0 <= b < 9 and 0 <= a < 12) or rows[b][a] != "#":
                        continue
                    seen.add((a, b))
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert G.label_components(mask).select("component").distinct().count() == n


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select((F.col("id") * 10 % 301).alias("a"), ((F.col("id") + 1) * 10 % 301).alias("b"))
    got = connected_components(edges).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}
    assert connected_components(edges.limit(0)).isEmpty()


# ---------------------------------------------------------------- coordinates


def test_known_coordinates(spark):
    df = spark.createDataFrame([(117.0, 0.0), (120.5, 36.2)], "x double, y double")
    assert V.transform_coords(df, "EPSG:4326", "EPSG:32650").first().x == pytest.approx(500000.0, abs=1e-6)
    for target in ("EPSG:3857", "EPSG:32650", "EPSG:32750"):
        back = V.transform_coords(V.transform_coords(df, "EPSG:4326", target), target, "EPSG:4326").collect()
        assert [(r.x, r.y) for r in back] == [(pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9)) for a, b in [(117.0, 0.0), (120.5, 36.2)]]
    with pytest.raises(ValueError):
        code_of("EPSG:9999")


def test_neighbours_in_dense_and_lonely_places(spark):
    """Two clouds of different scale: a crowd, many points in one place, and some far away."""
    rng = random.Random(3)
    at = [(rng.gauss(0, 0.01), rng.gauss(0, 0.01), 0.0) for _ in range(150)] + [(5.0, 5.0, 0.0)] * 40 + [(rng.uniform(-900, 900), rng.uniform(-900, 900), 0.0) for _ in range(20)]
    rows = [("a", i, *p) for i, p in enumerate(at)] + [("b", i, 1e6 * p[0], 1e6 * p[1], 0.0) for i, p in enumerate(at[:30])] + [("c", 0, 1.0, 1.0, 1.0), ("c", 1, 1.0, 1.0, 1.0)]
    pc = spark.createDataFrame(rows, "cloud_id string, ord long, x double, y double, z double")
    got = {}
    for r in P.knn_self_join(pc, 5).collect():
        got.setdefault((r.cloud_id, r.ord), {})[r["rank"]] = (round(r.dist, 9), r.other)
    for cloud in "abc":
        points = [(o, (x, y, z)) for c, o, x, y, z in rows if c == cloud]
        for o, p in points:
            want = sorted((round(sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5, 9), other) for other, q in points)[:5]
            assert [got[cloud, o][k] for k in sorted(got[cloud, o])] == want


def test_neighbours_of_a_dense_spot_and_far_points(spark, monkeypatch):
    """Thousands of points in one spot and some very far apart: three rounds settle all."""
    rng = np.random.default_rng(6)
    xyz = np.concatenate([rng.normal(size=(1500, 3)) * 0.001, rng.random((150, 3)) * 10000])
    rounds = []
    steps = P._steps_to_crowd
    monkeypatch.setattr(P, "_steps_to_crowd", lambda *a: (rounds.append(1), steps(*a))[1])
    got = {}
    for r in P.knn_self_join(cloud(spark, xyz.tolist()), 8).collect():
        got.setdefault(r.ord, []).append((r.rank, r.other))
    for i in range(len(xyz)):
        far = np.sqrt(((xyz - xyz[i]) ** 2).sum(1))
        assert [o for _, o in sorted(got[i])] == np.lexsort((np.arange(len(xyz)), far))[:8].tolist()
    assert len(rounds) <= 2


@pytest.mark.parametrize("tile,overlap", [(5, 4), (6, 5), (7, 4), (9, 3), (4, 2), (8, 0), (1, 0)])
def test_blend_weights_where_both_ends_reach(tile, overlap):
    """By hand: the deeper of the overlaps that a place lies in decides; most of these are longer than half a tile."""
    linear, bell = T.blend_weights(tile, overlap), T.blend_weights(tile, overlap, "gaussian", 0.5)
    spread = max(1.0, 0.5 * overlap)
    for j in range(tile):
        depths = [d for d in (j, tile - 1 - j) if d < overlap]
        assert linear[j] == pytest.approx((max(depths) + 1) / (overlap + 1) if depths else 1.0)
        assert bell[j] == pytest.approx(min(1 - math.exp(-((overlap - d) ** 2) / (2 * spread**2)) for d in depths) if depths else 1.0)
    assert T.blend_weights(5, 4) == pytest.approx([0.2, 0.8, 0.6, 0.8, 0.2])
    assert T.blend_weights(tile, overlap, "none") == [1.0] * tile
