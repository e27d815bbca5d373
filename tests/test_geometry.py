"""Geometry kernels and feature operators against sampling and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import kernels as K
from cairn.functions.geometry import RINGS, point_in_ring, polygon_area
from cairn.operators import topology as Y
from cairn.operators import vector as V
from cairn.plans.gridjoin import box_pairs
from cairn.sources import vector as SV

L_SHAPE = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)], float)
RING = [K.box(0, 0, 6, 6), K.box(2, 2, 4, 4)[::-1]]
BOW_TIE = np.array([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)], float)


def star(rng, points=9, radius=3.0, centre=(0, 0)):
    turn = sorted(rng.random() * 2 * math.pi for _ in range(points))
    reach = [radius * (0.3 + rng.random()) for _ in turn]
    ring = [(centre[0] + r * math.cos(t), centre[1] + r * math.sin(t)) for r, t in zip(reach, turn, strict=True)]
    return np.array([*ring, ring[0]])


def total(polygons):
    return sum(map(K.polygon_area, polygons))


@pytest.mark.parametrize("seed", range(12))
def test_overlay_areas_add_up(seed):
    rng = random.Random(seed)
    a, b = [[star(rng)]], [[star(rng, centre=(1, 0.5))]]
    both, only, whole = K.intersection(a, b), K.difference(a, b), K.union([*a, *b])
    area = total(a)
    assert total(both) + total(only) == pytest.approx(area, rel=1e-6)
    assert total(whole) == pytest.approx(area + total(b) - total(both), rel=1e-6)
    points = np.array([(rng.uniform(-4, 5), rng.uniform(-4, 5)) for _ in range(400)])
    assert (K.inside(points, both) == (K.inside(points, a) & K.inside(points, b))).mean() > 0.99


def test_overlay_of_special_shapes():
    assert total(K.intersection([[L_SHAPE]], [[K.box(0, 0, 2, 2)]])) == pytest.approx(3)
    assert total(K.intersection([RING], [[K.box(3, 3, 9, 9)]])) == pytest.approx(8)
    assert total(K.union([RING, [K.box(2, 2, 4, 4)]])) == pytest.approx(36)
    assert total(K.union([[K.box(0, 0, 1, 1)], [K.box(1, 0, 2, 1)]])) == pytest.approx(2)
    assert len(K.union([[K.box(0, 0, 1, 1)], [K.box(1, 0, 2, 1)]])) == 1
    assert K.intersection([[K.box(0, 0, 1, 1)]], [[K.box(1, 0, 2, 1)]]) == []
    assert len(K.difference([[K.box(0, 0, 6, 6)]], [[K.box(2, 2, 4, 4)]])[0]) == 2
    assert total(K.buffer("Polygon", [BOW_TIE], 0.0)) == pytest.approx(2)


def test_simplify_and_validity():
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 1), (4, 0)], float)
    assert K.simplify(line, 0.05).tolist() == [[0, 0], [2, 0], [3, 1], [4, 0]]
    assert K.invalid_reason("Polygon", [L_SHAPE]) is None and K.invalid_reason("Polygon", RING) is None
    assert K.invalid_reason("Polygon", [BOW_TIE]) == "self-intersection"
    assert K.invalid_reason("Polygon", [L_SHAPE[:-1]]) == "ring is not closed"
    assert K.invalid_reason("Polygon", [L_SHAPE, K.box(9, 9, 10, 10)]) == "hole lies outside shell"


def test_buffers():
    line = [np.array([(0, 0), (10, 0)], float)]
    n = 32
    cap = 0.5 * n * math.sin(2 * math.pi / n)
    assert total(K.buffer("LineString", line, 1.0)) == pytest.approx(20 + cap)
    assert total(K.buffer("Polygon", [K.box(0, 0, 4, 4)], -1.0)) == pytest.approx(4)
    assert total(K.buffer("Polygon", [K.box(0, 0, 4, 4)], 1.0)) == pytest.approx(16 + 16 + cap)
    assert total(K.buffer("Polygon", [L_SHAPE], 0.25)) > total([[L_SHAPE]])
    assert K.buffer("Polygon", [K.box(0, 0, 1, 1)], -1.0) == []
    bent = K.buffer("LineString", [np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0.5)], float)], 0.5)
    assert len(bent) == 1 and total(bent) > 10


def test_clip_line():
    parts = K.clip_line(np.array([(-1, 3), (7, 3), (7, 5), (-1, 5)], float), [RING])
    assert sorted(round(float(np.hypot(*np.diff(p, axis=0).T).sum()), 6) for p in parts) == [2, 2, 6]


# ---------------------------------------------------------------- features


def rings(*polygon):
    return [[(float(x), float(y), 0.0) for x, y in r] for r in polygon]


def features(spark, *rows):
    return spark.createDataFrame([("l", i, kind, rings(*shape), f"name{i}") for i, (kind, *shape) in enumerate(rows)], f"layer string, fid long, geom_type string, rings {RINGS}, name string")


def test_columns_agree_with_kernels(spark):
    fx = features(spark, ("Polygon", *RING), ("Polygon", L_SHAPE))
    assert [r.a for r in fx.orderBy("fid").select(polygon_area(F.col("rings")).alias("a")).collect()] == [32.0, 7.0]
    inside = fx.filter("fid = 1").select(point_in_ring(F.col("rings")[0], F.lit(0.5), F.lit(3.0)), point_in_ring(F.col("rings")[0], F.lit(2.0), F.lit(3.0))).first()
    assert tuple(inside) == (True, False)


@pytest.mark.parametrize("seed", range(3))
def test_box_pairs_match_nested_loops(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: [(i, x, y, x + rng.choice([0, 0.1, 1, 30]), y + rng.choice([0, 0.5, 2])) for i in range(n) for x, y in [(rng.uniform(-20, 20), rng.uniform(-20, 20))]]
    a, b = draw(60), draw(50)
    schema = "id long, min_x double, min_y double, max_x double, max_y double"
    got = [tuple(r) for r in box_pairs(spark.createDataFrame([*a, (99, None, None, None, None)], schema), spark.createDataFrame(b, schema)).collect()]
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_intersect_keeps_attributes_and_types(spark):
    a = features(spark, ("Polygon", L_SHAPE), ("LineString", np.array([(-1, 0.5), (9, 0.5)])), ("Point", np.array([(0.5, 0.5)])), ("Point", np.array([(8, 8)])))
    b = features(spark, ("Polygon", K.box(0, 0, 2, 2)), ("Polygon", K.box(3, 0, 5, 2)))
    got = sorted((r.name, r.b_fid, r.geom_type) for r in V.vector_intersect(a, b).collect())
    assert got == [("name0", 0, "Polygon"), ("name0", 1, "Polygon"), ("name1", 0, "LineString"), ("name1", 1, "LineString"), ("name2", 0, "Point")]
    assert V.intersects_any(a, b) and not V.intersects_any(a.filter("fid = 3"), b)
    assert {r.fid for r in V.semi_intersect(a, b).collect()} == {0, 1, 2}


def test_clip_counts_overlapping_clippers_once(spark):
    target = features(spark, ("Polygon", K.box(0, 0, 10, 10)))
    clipper = features(spark, ("Polygon", K.box(1, 1, 5, 5)), ("Polygon", K.box(3, 3, 7, 7)), ("Polygon", K.box(1, 1, 5, 5)))
    area = lambda fx: fx.agg(F.sum(polygon_area(F.col("rings")))).first()[0]
    assert area(V.vector_clip(target, clipper)) == pytest.approx(28)
    assert V.union_area(clipper).first().area == pytest.approx(28)


def test_dissolve_with_concave_shapes_and_holes(spark):
    fx = features(spark, ("Polygon", *RING), ("Polygon", L_SHAPE), ("Polygon", K.box(2.5, 2.5, 3.5, 3.5)))
    for cell in (None, 1.7, 50.0):
        assert V.dissolve(fx, cell).agg(F.sum(polygon_area(F.col("rings")))).first()[0] == pytest.approx(33)


def test_topology(spark):
    fx = features(spark, ("Polygon", K.box(0, 0, 2, 2)), ("Polygon", K.box(1, 1, 3, 3)), ("Polygon", BOW_TIE + 10), ("Point", np.array([(0, 0)])))
    got = sorted((r.issue_type, r.fid, r.other_fid, round(r.area, 6) if r.area else None) for r in Y.full_check(fx).collect())
    assert ("overlap", 0, 1, 1.0) in got and ("invalid", 2, None, None) in got and got[0][:2] == ("gap", -1)
    fixed = V.repair_polygons(fx.filter("fid = 2"))
    assert fixed.count() == 2 and Y.check_validity(fixed.withColumn("fid", F.monotonically_increasing_id())).isEmpty()
    assert Y.check_gaps(fx.filter("fid = 0")).isEmpty()


def test_buffer_and_simplify_rows(spark):
    fx = features(spark, ("Point", np.array([(1, 2)])), ("LineString", np.array([(0, 0), (5, 0)])), ("Polygon", L_SHAPE))
    assert {r.geom_type for r in V.vector_buffer(fx, 0.5).collect()} == {"Polygon"} and V.vector_buffer(fx, 0.5).count() == 3
    assert {r.geom_type: len(r.rings[0]) for r in V.vector_simplify(fx, 0.01).collect()} == {"Point": 1, "LineString": 2, "Polygon": 7}
    with pytest.raises(ValueError):
        V.vector_simplify(fx, -1)
    assert V.vector_buffer(fx.limit(0), 1.0).isEmpty()


def test_geojson_round_trip(spark, tmp_path):
    fx = features(spark, ("Polygon", L_SHAPE, K.box(0.1, 0.1, 0.5, 0.5)), ("LineString", np.array([(0, 0), (5, 1)])), ("Point", np.array([(1, 2)])))
    SV.write_vector(fx, str(tmp_path / "g"))
    back = SV.read_vector(spark, str(tmp_path / "g"), properties="name string")
    key = lambda r: (r.fid, r.layer, r.geom_type, [[(p.x, p.y) for p in ring] for ring in r.rings], r.name)
    assert sorted(map(key, back.collect())) == sorted(map(key, fx.collect()))
    assert SV.list_layers(back).first().feature_count == 3
    with pytest.raises(ValueError):
        SV.read_vector(spark, str(tmp_path / "g"), layer="other", strict=True)
    with pytest.raises(ValueError):
        SV.write_vector(fx, str(tmp_path / "h"), "shp")
    multi = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]},"properties":{"a":1}},{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[]},"properties":{}}]}'
    (tmp_path / "m.json").write_text(multi)
    assert [r.part for r in SV.read_vector(spark, str(tmp_path / "m.json"), properties="a int", collection=True).orderBy("part").collect()] == [0, 1]


def test_points_round_trip(spark, tmp_path):
    pc = spark.createDataFrame([("c", 0, 1.0, 2.0, 3.0, 0.5, 4)], "cloud_id string, ord long, x double, y double, z double, intensity float, classification short")
    for kind in ("parquet", "geojson"):
        SV.write_points(pc, str(tmp_path / kind), kind)
        r = SV.read_points(spark, str(tmp_path / kind), kind).first()
        assert (r.cloud_id, r.x, r.y, r.z, r.intensity, r.classification) == ("c", 1.0, 2.0, 3.0, 0.5, 4)


@pytest.mark.parametrize(
    "kind,rings,other,b_rings,want",
    [
        ("Polygon", [K.box(0, 0, 2, 2)], "Polygon", [K.box(2, 1, 5, 3)], [("LineString", 1.0)]),
        ("Polygon", [K.box(0, 0, 2, 2)], "Polygon", [K.box(2, 2, 5, 3)], [("Point", 0.0)]),
        ("Polygon", [K.box(0, 0, 2, 2)], "Polygon", [K.box(3, 2, 5, 3)], []),
        ("Polygon", [K.box(0, 0, 2, 2)], "LineString", [np.array([[2.0, 2], [4, 4]])], [("Point", 0.0)]),
        ("LineString", [np.array([[1.0, 1], [4, 1]])], "Polygon", [K.box(0, 0, 2, 2)], [("LineString", 1.0)]),
        ("LineString", [np.array([[0.0, 0], [2, 2]])], "LineString", [np.array([[0.0, 2], [2, 0], [2, 2], [1, 1]])], [("LineString", 2**0.5)]),
        ("LineString", [np.array([[0.0, 0], [2, 2]])], "LineString", [np.array([[0.0, 2], [2, 0]])], [("Point", 0.0)]),
        ("Point", [np.array([[1.0, 2]])], "Polygon", [K.box(0, 0, 2, 2)], [("Point", 0.0)]),
        ("LineString", [np.array([[0.0, 0], [2, 2]])], "Point", [np.array([[1.0, 1]])], [("Point", 0.0)]),
        ("Point", [np.array([[1.0, 1]])], "Point", [np.array([[1.0, 1]])], [("Point", 0.0)]),
        ("Point", [np.array([[1.0, 1]])], "Point", [np.array([[1.0, 1.5]])], []),
    ],
)
def test_common_parts_of_any_two_kinds(kind, rings, other, b_rings, want):
    from cairn.operators.vector import common

    size = lambda found: [(k, pytest.approx(float(np.hypot(*np.diff(r[0], axis=0).T).sum()))) for k, r in found]
    assert size(common(kind, rings, other, b_rings)) == want
    assert size(common(other, b_rings, kind, rings)) == want


def test_union_of_a_crowded_spot(spark):
    """Nested and jittered boxes over one place, far more than a cell holds, beside a few apart."""
    rows = [(0.0 - i % 40 / 100, 0.0 - i // 40 / 100, 1.0 + i % 7 / 10, 1.0 + i % 5 / 10) for i in range(600)] + [(10.0 + 3 * i, 0.0, 11.0 + 3 * i, 1.0) for i in range(5)]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "fid long, a double, b double, c double, d double")
    fx = V.boxes(df, *(F.col(c) for c in ("fid", "a", "b", "c", "d")))
    cells = {(i, j) for a, b, c, d in rows for i in range(round(a * 100), round(c * 100)) for j in range(round(b * 100), round(d * 100))}
    parts = V.dissolve(fx, crowd=16)
    assert parts.agg(F.sum(polygon_area(F.col("rings")))).first()[0] == pytest.approx(len(cells) / 10_000, rel=1e-6)


@pytest.mark.parametrize("distance", [0.05, -0.05, 0.3, -0.3, 2.0, -2.0])
def test_buffers_of_many_polygons_at_once(distance):
    """Stars with and without holes, at places far apart: what is buffered at once is what each is on its own, and simple shapes are."""
    rng = np.random.default_rng(12)

    def star(centre, low, high, n):
        turn = np.sort(rng.random(n)) * 2 * np.pi
        ring = centre + (rng.uniform(low, high, n) * [np.cos(turn), np.sin(turn)]).T
        return np.concatenate([ring, ring[:1]])

    polygons = []
    for k in range(60):
        centre = rng.random(2) * 10.0 ** (k % 5)
        holes = [star(centre + [dx, 0], 0.2, 0.5, 5)[:: rng.choice([1, -1])] for dx in ((-1, 1) if k % 3 == 1 else (0,) if k % 3 == 2 else ())]
        polygons.append([star(centre, 3, 4, 9 + k % 7)[:: rng.choice([1, -1])], *holes])
    bent = np.array([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)], float)
    polygons += [[bent], [K.box(0, 0, 8, 8), K.box(2, 2, 6, 6)], [K.box(0, 0, 8, 8), K.box(0, 2, 6, 6)], [K.box(0, 0, 2, 2), K.box(3, 3, 4, 4)], [bent[[0, 2, 1, 3, 4, 5, 0]]], []]
    found = K.buffers(polygons, distance)
    for polygon, one in zip(polygons, found, strict=True):
        if one is not None:
            alone = K.buffer("Polygon", polygon, distance)
            assert len(alone) == 1 and sorted(map(len, alone[0])) == sorted(map(len, one))
            assert K.polygon_area(one) == pytest.approx(K.polygon_area(alone[0]), rel=1e-9)
            assert K.area(one[0]) > 0 and all(K.area(h) < 0 for h in one[1:])
    assert found[-4:] == [None] * 4
    if abs(distance) < 0.1:
        assert sum(p is not None for p in found) > 30 and None not in found[60:62]


def test_a_batch_of_simple_shapes_is_buffered_without_an_arrangement(monkeypatch):
    monkeypatch.setattr(K, "arrange", lambda *a: pytest.fail("made an arrangement"))
    assert K.polygon_area(K.buffers([[K.box(0, 0, 8, 8), K.box(2, 2, 6, 6)]], -0.5)[0]) == pytest.approx(49 - (16 + 4 * 4 * 0.5 + 4 * 4 * 0.25 * np.sin(np.pi / 16)))
