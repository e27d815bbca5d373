"""Arrangements, overlay, buffers and validity against sampling, brute force and size."""

import time

import numpy as np
import pytest

from cairn.functions import arrangement as A
from cairn.functions import kernels as K


def closed(corners):
    corners = np.asarray(corners, float)
    return np.concatenate([corners, corners[:1]])


def draw(rng, kind):
    """A random ring: crossing itself anywhere or on a grid, a star, a box, a star on a grid."""
    n = int(rng.integers(3, 12))
    if kind == 0:
        return closed(rng.random((n, 2)) * 10)
    if kind == 1:
        return closed(rng.integers(0, 6, (n, 2)))
    if kind == 3:
        (x, y), (w, h) = rng.integers(0, 5, 2), rng.integers(1, 5, 2)
        return closed([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    turn, reach = np.sort(rng.random(n)) * 2 * np.pi, 1 + 4 * rng.random(n)
    star = 5 + np.column_stack([reach * np.cos(turn), reach * np.sin(turn)])
    return closed(np.round(star) if kind == 4 else star)


def wiggly(n, seed=0, centre=(0.0, 0.0)):
    rng, turn = np.random.default_rng(seed), np.arange(n) * 2 * np.pi / n
    reach = 100 * (1 + 0.15 * np.sin(9 * turn) + 1.5 / n * rng.normal(size=n))
    return closed(np.column_stack([reach * np.cos(turn), reach * np.sin(turn)]) + centre)


def away(points, rings):
    """Distance of points from lines."""
    far = np.full(len(points), np.inf)
    for r in rings:
        for a, d in zip(r[:-1], np.diff(r, axis=0), strict=True):
            along = np.clip((points - a) @ d / max(d @ d, 1e-300), 0, 1)
            far = np.minimum(far, np.hypot(*(points - a - along[:, None] * d).T))
    return far


def within(points, region):
    return K.inside(points, region) if region else np.zeros(len(points), bool)


@pytest.fixture(params=[0, 96], ids=["trees", "small"])
def few(request, monkeypatch):
    monkeypatch.setattr(A, "FEW", request.param)


@pytest.mark.parametrize("seed", range(40))
def test_overlay_and_buffer_of_any_rings(few, seed):
    rng = np.random.default_rng(seed)
    far = np.array([500000.0, 4000000.0]) if seed % 2 else np.zeros(2)
    a, b = ([[draw(rng, seed % 5) + far] for _ in range(rng.integers(1, 4))] for _ in range(2))
    points = rng.random((1500, 2)) * 12 - 1 + far
    in_a, in_b = K.inside(points, a), K.inside(points, b)
    clear = away(points, [r for p in a + b for r in p]) > 1e-4
    for found, want in ((K.intersection(a, b), in_a & in_b), (K.difference(a, b), in_a & ~in_b), (K.union([*a, *b]), in_a | in_b)):
        assert not ((within(points, found) != want) & clear).any()
        assert all(K.invalid_reason("Polygon", p) is None for p in found)
    d = (0.3, 1.0, -0.3, 2.5)[seed % 4]
    apart, inner = away(points, a[0]), K.inside(points, [a[0]])
    want = inner | (apart < d) if d > 0 else inner & (apart > -d)
    clear = (np.abs(apart - abs(d)) > 0.01 * abs(d)) & (apart > 1e-4)
    grown = K.buffer("Polygon", a[0], d)
    assert not ((within(points, grown) != want) & clear).any() and all(K.invalid_reason("Polygon", p) is None for p in grown)
    line = [a[0][0][:-1]]
    apart = away(points, line)
    assert not ((within(points, K.buffer("LineString", line, abs(d))) != (apart < abs(d))) & (np.abs(apart - abs(d)) > 0.01 * abs(d))).any()


def test_boxes_that_meet(few):
    rng = np.random.default_rng(4)
    low = np.concatenate([rng.random((300, 2)), rng.random((100, 2)) * 0.01])
    high = low + rng.choice([0, 0.01, 0.3], (400, 2))
    got = [p for i, j in A.meeting(low, high) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if (low[i] <= high[j]).all() and (low[j] <= high[i]).all()}
    assert len(got) == len(set(got)) and set(got) == want


def test_sides_of_pieces_against_rays(few):
    rng = np.random.default_rng(9)
    ends = rng.random((60, 2, 2))
    met = A.arrange(ends[:, 0], ends[:, 1], np.ones((60, 1), int))
    at = A.turned(met.place)
    a, b, delta = at[met.low], at[met.high], met.left - met.right
    for k, middle in enumerate((a + b) / 2):
        crossed = (a[:, 1] <= middle[1]) & (middle[1] < b[:, 1]) & (A.cross(b - a, middle - a) > 0) & (np.arange(len(a)) != k)
        assert (delta[crossed].sum(0) == met.right[k]).all()


BOX = closed([(0, 0), (9, 0), (9, 9), (0, 9)])


@pytest.mark.parametrize(
    "rings,want",
    [
        ([BOX, K.box(1, 1, 7, 7), K.box(2, 2, 3, 3)], "nested holes"),
        ([BOX, K.box(2, 2, 3, 3), K.box(1, 1, 7, 7)], "nested holes"),
        ([BOX, BOX[::-1]], "hole equals shell"),
        ([BOX, K.box(1, 1, 2, 2), K.box(1, 1, 2, 2)], "rings share a side"),
        ([BOX, K.box(0, 1, 2, 2)], "rings share a side"),
        ([BOX, closed([(0, 4), (4, 2), (9, 4), (4, 6)])], "interior is disconnected"),
        ([BOX, closed([(0, 4), (2, 2), (4, 4), (2, 6)]), closed([(4, 4), (6, 2), (9, 4), (6, 6)])], "interior is disconnected"),
        ([BOX, closed([(0, 4), (2, 2), (4, 4), (2, 6)]), closed([(4, 4), (6, 2), (8, 4), (6, 6)])], None),
        ([BOX, np.array([(1, 1), (float("nan"), 2), (2, 2), (1, 1)])], "coordinate is not finite"),
        ([np.array([(0, 0), (float("inf"), 0), (1, 1), (0, 0)])], "coordinate is not finite"),
        ([BOX, K.box(8, 8, 10, 10)], "self-intersection"),
        ([BOX, K.box(20, 20, 21, 21), K.box(1, 1, 2, 2)], "hole lies outside shell"),
        ([BOX[::-1], K.box(1, 1, 2, 2), K.box(3, 1, 4, 2)[::-1]], None),
    ],
)
def test_validity_of_rings(few, rings, want):
    assert K.invalid_reason("Polygon", rings) == want
    assert K.invalid_reason("Polygon", [r + 4000000.0 for r in rings]) == want


def test_holes_go_to_their_shells(few):
    """A ring in a ring in a ring, beside others, each with several holes."""
    rings = [K.box(0, 0, 40, 40), K.box(1, 1, 39, 39), K.box(2, 2, 20, 38), K.box(3, 3, 19, 37), K.box(22, 2, 38, 38)]
    holes = [K.box(23, 3 + 3 * k, 37, 5 + 3 * k) for k in range(10)]
    frame = K.difference([[rings[0]]], [[rings[1]]]) + K.difference([[rings[2]]], [[rings[3]]]) + [[rings[4], *holes]]
    found = K.union(frame)
    assert sorted(len(p) for p in found) == [2, 2, 11]
    assert sum(map(K.polygon_area, found)) == pytest.approx(1600 - 38**2 + 18 * 36 - 16 * 34 + 16 * 36 - 10 * 28)


def test_rings_of_many_points_take_seconds():
    began = time.time()
    a, b = wiggly(100_000), wiggly(100_000, 1, (5.0, 3.0))
    area = K.polygon_area([a])
    assert K.invalid_reason("Polygon", [a]) is None
    both, only = K.intersection([[a]], [[b]]), K.difference([[a]], [[b]])
    assert sum(map(K.polygon_area, both)) + sum(map(K.polygon_area, only)) == pytest.approx(area, rel=1e-9)
    ring = wiggly(10_000)
    grown = [sum(map(K.polygon_area, K.buffer("Polygon", [ring], d))) for d in (0.05, 2.0, 20.0, -2.0)]
    assert grown[3] < K.polygon_area([ring]) < grown[0] < grown[1] < grown[2]
    assert time.time() - began < 60  # seconds on any machine; quadratic work would take minutes


def test_wide_buffers_of_long_rings_go_by_stretches(monkeypatch):
    ring = wiggly(600)
    whole = [K.buffer("Polygon", [ring], d) for d in (15.0, -15.0)]
    monkeypatch.setattr(K, "MEETINGS", 100)
    for d, one in zip((15.0, -15.0), whole, strict=True):
        assert sum(map(K.polygon_area, K.buffer("Polygon", [ring], d))) == pytest.approx(sum(map(K.polygon_area, one)), rel=1e-4)


def test_lines_along_a_border_belong_to_one_side():
    left, right = [[K.box(0, 0, 1, 3)]], [[K.box(1, 0, 2, 3)]]
    line = np.array([(1.0, -1.0), (1.0, 4.0)])
    size = lambda parts: sum(float(np.hypot(*np.diff(p, axis=0).T).sum()) for p in parts)
    assert sorted(size(K.clip_line(line, r)) for r in (left, right)) == [0, 3]
    assert [size(K.clip_line(line, r, closed=True)) for r in (left, right)] == [3, 3]


def test_shared_stretches_and_points():
    lines, points = K.touches([closed([(0, 0), (4, 0), (4, 4), (0, 4)])], [closed([(4, 1), (8, 1), (8, 4), (4, 4), (4, 3), (5, 2)])])
    assert len(lines) == 1 and sorted(map(tuple, lines[0].tolist())) == [(4, 3), (4, 4)] and [tuple(p) for p in points] == [(4, 1)]


@pytest.mark.parametrize("seed", range(12))
def test_cells_of_a_polygon_add_up(seed):
    rng = np.random.default_rng(seed)
    shape = K.oriented([draw(rng, (0, 2, 3, 4)[seed % 4]) + (500000.0 if seed % 2 else 0.0)])
    for polygon in shape:
        for side in (0.5, 1.0, 4.0):
            parts = list(K.into_cells(polygon, side))
            assert len({(x, y, k) for k, (x, y, _) in enumerate(parts)}) == len(parts)
            assert sum(K.polygon_area(p) for _, _, p in parts) == pytest.approx(K.polygon_area(polygon), rel=1e-6)
            for x, y, p in parts:
                assert (p[0].min(0) >= np.array([x, y]) * side - 1e-6).all() and (p[0].max(0) <= np.array([x + 1, y + 1]) * side + 1e-6).all()


def test_a_huge_polygon_is_cut_into_no_more_cells_than_there_are_parcels(spark):
    from pyspark.sql import functions as F

    from cairn.functions.geometry import polygon_area
    from cairn.operators import vector as V

    n = 3000
    small = spark.range(n).select("id", (F.col("id") % 60 * 0.01).alias("a"), F.floor(F.col("id") / 60).cast("double").alias("b"))
    small = small.select("id", "a", (F.col("b") * 0.01).alias("b"), (F.col("a") + 0.008).alias("c"), (F.col("b") * 0.01 + 0.008).alias("d"))
    huge = spark.createDataFrame([(n, -600.0, -600.0, 0.3, 0.25), (n + 1, 100.0, 100.0, 900.0, 900.0)], "id long, a double, b double, c double, d double")
    fx = V.boxes(small.unionByName(huge), *(F.col(c) for c in ("id", "a", "b", "c", "d")))
    found = V.dissolve(fx, crowd=64)
    pieces, area, levels = found.agg(F.count("*"), F.sum(polygon_area(F.col("rings"))), F.countDistinct("level")).first()
    covered = {(i, j) for k in range(n) for i in range(k % 60 * 10, k % 60 * 10 + 8) for j in range(k // 60 * 10, k // 60 * 10 + 8) if i >= 300 or j >= 250}
    assert area == pytest.approx(600.3 * 600.25 + 800**2 + len(covered) * 1e-6, rel=1e-9)
    assert pieces < n and levels > 3  # cells of the parcels' size over the whole ground would be billions
