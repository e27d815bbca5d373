"""Features and points from and to GeoJSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.geometry import RINGS, bounds, closed

_POSITIONS = "array<double>"
#: Depth of the coordinates of each geometry type.
_DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def _point(p):
    at = lambda i: F.get(p, F.lit(i))
    return F.struct(at(0).alias("x"), at(1).alias("y"), F.coalesce(at(2), F.lit(0.0)).alias("z"))


def _parts(geometry):
    """Every part of a geometry as rings; the coordinates are read as JSON text at the depth of the type."""
    text = F.get_json_object(geometry, "$.coordinates")
    read = lambda depth: F.from_json(text, "array<" * depth + _POSITIONS + ">" * depth)
    line = lambda ps: F.transform(ps, _point)
    kind = F.get_json_object(geometry, "$.type")
    return (
        F.when(kind == "Point", F.array(F.array(F.array(_point(read(0))))))
        .when(kind == "MultiPoint", F.transform(read(1), lambda p: F.array(F.array(_point(p)))))
        .when(kind == "LineString", F.array(F.array(line(read(1)))))
        .when(kind == "MultiLineString", F.transform(read(2), lambda ls: F.array(line(ls))))
        .when(kind == "Polygon", F.array(F.transform(read(2), line)))
        .when(kind == "MultiPolygon", F.transform(read(3), lambda poly: F.transform(poly, line)))
    )


def read_vector(spark: SparkSession, path: str, layer: str | None = None, properties: str = "", collection: bool = False, strict: bool = False) -> DataFrame:
    """Features of GeoJSON: one feature a line, or (``collection``) whole FeatureCollections.

    ``properties`` is the schema of the attributes (DDL); they become columns, null where a feature lacks them. One row a
    part, numbered by ``part``; geometry collections and broken geometries are dropped. ``layer`` selects features by the
    name in their ``layer`` member (``default`` where they have none); with ``strict`` a layer that is absent is an error.
    """
    if collection:
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("value"))
    else:
        raw = spark.read.text(path).filter(F.trim("value") != "")
    kind = F.get_json_object("value", "$.geometry.type")
    body = raw.select(
        F.coalesce(F.get_json_object("value", "$.layer"), F.lit("default")).alias("layer"),
        F.coalesce(F.get_json_object("value", "$.id").cast("long"), F.xxhash64("value")).alias("fid"),
        F.regexp_replace(kind, "^Multi", "").alias("geom_type"),
        F.get_json_object("value", "$.geometry").alias("_g"),
        F.from_json(F.get_json_object("value", "$.properties"), properties or "_none string").alias("_p"),
    )
    if layer is not None:
        body = body.filter(F.col("layer") == layer)
        if strict and body.isEmpty():
            raise ValueError(f"no layer {layer!r}")
    rows = body.select("layer", "fid", "geom_type", F.posexplode(_parts(F.col("_g"))).alias("part", "rings"), "_p").filter("rings is not null")
    return rows.select("layer", "fid", "geom_type", "part", F.col("rings").cast(RINGS).alias("rings"), *(["_p.*"] if properties else []))


def list_layers(fx: DataFrame) -> DataFrame:
    """layer, geom_type (of its smallest fid) and feature_count."""
    return fx.groupBy("layer").agg(F.min_by("geom_type", "fid").alias("geom_type"), F.count("*").alias("feature_count"))


def feature_count(fx: DataFrame) -> DataFrame:
    return fx.groupBy("layer").agg(F.count("*").alias("n"))


def layer_extent(fx: DataFrame) -> DataFrame:
    """layer and its extent."""
    b = bounds(F.col("rings"))
    return fx.groupBy("layer").agg(F.min(b["min_x"]).alias("min_x"), F.min(b["min_y"]).alias("min_y"), F.max(b["max_x"]).alias("max_x"), F.max(b["max_y"]).alias("max_y"))


def to_geojson(fx: DataFrame) -> DataFrame:
    """One GeoJSON feature a row in ``value``. Rings are closed where they are open; holes of fewer than three points are left out."""
    attributes = [c for c in fx.columns if c not in ("layer", "fid", "geom_type", "part", "rings")]
    pair = lambda p: F.array(p["x"], p["y"])
    line = lambda r: F.transform(r, pair)
    kept = F.concat(F.slice("rings", 1, 1), F.filter(F.slice(F.col("rings"), F.lit(2), F.greatest(F.size("rings"), F.lit(1))), lambda h: F.size(h) >= 3))
    coordinates = (
        F.when(F.col("geom_type") == "Point", F.to_json(pair(F.col("rings")[0][0])))
        .when(F.col("geom_type") == "LineString", F.to_json(line(F.col("rings")[0])))
        .otherwise(F.to_json(F.transform(kept, lambda r: line(closed(r)))))
    )
    properties = F.to_json(F.struct(*attributes)) if attributes else F.lit("{}")
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), "layer", F.col("fid").alias("id")))
    open_head = F.substring(head, F.lit(1), F.length(head) - 1)
    geometry = F.concat(F.lit(',"geometry":{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), coordinates, F.lit("}"))
    return fx.select(F.concat(open_head, geometry, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write_vector(fx: DataFrame, path: str, kind: str = "geojson") -> None:
    """GeoJSON lines or Parquet; another kind is an error."""
    if kind == "geojson":
        to_geojson(fx).write.text(path)
    elif kind == "parquet":
        fx.write.option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def read_points(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Points from Parquet or GeoJSON lines; intensity and classification are 0 where absent; ``ord`` is the one written, or else follows the input order."""
    if kind == "parquet":
        raw = spark.read.parquet(path)
        have = set(raw.columns)
    else:
        raw = spark.read.text(path).filter(F.get_json_object("value", "$.geometry.type") == "Point")
        at = _point(F.from_json(F.get_json_object("value", "$.geometry.coordinates"), _POSITIONS))
        raw = raw.select(
            F.coalesce(F.get_json_object("value", "$.layer"), F.lit("default")).alias("cloud_id"),
            F.coalesce(F.get_json_object("value", "$.id").cast("long"), F.monotonically_increasing_id()).alias("ord"),
            at.alias("p"),
            *(F.get_json_object("value", f"$.properties.{c}").alias(c) for c in ("intensity", "classification")),
        ).select("cloud_id", "ord", "p.*", "intensity", "classification")
        have = set(raw.columns)
    default = {"cloud_id": F.lit("cloud"), "ord": F.monotonically_increasing_id(), "intensity": F.lit(0.0), "classification": F.lit(0)}
    for name, value in default.items():
        if name not in have:
            raw = raw.withColumn(name, value)
    return raw.select(F.col("cloud_id").cast("string").alias("cloud_id"), F.col("ord").cast("long").alias("ord"), *(F.col(c).cast("double").alias(c) for c in "xyz"), F.coalesce(F.col("intensity").cast("float"), F.lit(0.0).cast("float")).alias("intensity"), F.coalesce(F.col("classification").cast("short"), F.lit(0).cast("short")).alias("classification"))


def write_points(pc: DataFrame, path: str, kind: str = "parquet") -> None:
    """Points as Parquet or GeoJSON lines; another kind is an error."""
    if kind == "parquet":
        pc.write.option("compression", "zstd").parquet(path)
    elif kind == "geojson":
        geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y", "z").alias("coordinates"))
        properties = F.struct("intensity", "classification")
        pc.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("cloud_id").alias("layer"), F.col("ord").alias("id"), geometry.alias("geometry"), properties.alias("properties"))).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")
