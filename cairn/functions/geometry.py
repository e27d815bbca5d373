"""Measures and checks of ring arrays as Columns: rings[0] is the outer ring, line or point, the others are holes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double,z:double>>>"


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of a closed ring; 0 for fewer than two points."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    cross = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the outer ring without its holes."""
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings), F.lit(1)))
    return F.abs(ring_area(rings[0])) - F.aggregate(holes, F.lit(0.0), lambda s, r: s + F.abs(ring_area(r)))


def bounds(rings: Column) -> Column:
    """Struct min_x, min_y, max_x, max_y."""
    points = F.flatten(rings)
    axis = lambda c: F.transform(points, lambda p: p[c])
    return F.struct(F.array_min(axis("x")).alias("min_x"), F.array_min(axis("y")).alias("min_y"), F.array_max(axis("x")).alias("max_x"), F.array_max(axis("y")).alias("max_y"))


def closed(ring: Column) -> Column:
    """The ring with its first point at the end, unless it is there already."""
    first, last = ring[0], F.element_at(ring, -1)
    return F.when((F.size(ring) > 0) & ((first["x"] != last["x"]) | (first["y"] != last["y"])), F.concat(ring, F.array(first))).otherwise(ring)


def box_rings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A closed rectangle."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"))
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def usable(geom_type: Column, rings: Column) -> Column:
    """Whether a geometry can be built: a point needs one coordinate, a line two, a polygon four."""
    n = F.size(rings[0])
    return F.coalesce(F.when(geom_type == "Point", n >= 1).when(geom_type == "LineString", n >= 2).when(geom_type == "Polygon", n >= 4), F.lit(False))


def checked(rings: Column) -> Column:
    """All holes go if one has fewer than four points; a z that is no finite number becomes 0."""
    finite = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.when(p["z"].isNull() | F.isnan(p["z"]) | (F.abs(p["z"]) == float("inf")), 0.0).otherwise(p["z"]).alias("z"))))
    return F.when(F.forall(F.slice(finite, F.lit(2), F.greatest(F.size(finite), F.lit(1))), lambda h: F.size(h) >= 4), finite).otherwise(F.slice(finite, 1, 1))


def point_in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule, by crossings of a ray to the right."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    crossings = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]))
    return F.size(F.filter(crossings, lambda c: c)) % 2 == 1
