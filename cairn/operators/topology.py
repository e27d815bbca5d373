"""Topology checks. Issues: fid, other_fid, issue_type, area, description."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import kernels as K
from cairn.functions.geometry import bounds, usable
from cairn.operators.vector import _usable, boxes_of, dealt, paired, read_rings, union_area
from cairn.plans.gridjoin import box_pairs

ISSUE = ("fid", "other_fid", "issue_type", "area", "description")


def check_validity(fx: DataFrame) -> DataFrame:
    """An issue for each feature that cannot be built or is not valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [K.invalid_reason(k, r) if ok else "geometry could not be converted" for k, r, ok in zip(batch.column(1).to_pylist(), read_rings(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["fid", "description"])

    kind = fx.schema["fid"].dataType.simpleString()
    found = dealt(fx.select("fid", "geom_type", "rings", usable(F.col("geom_type"), F.col("rings")).alias("ok"))).mapInArrow(run, f"fid {kind}, description string")
    return found.filter("description is not null").select("fid", F.lit(None).cast("long").alias("other_fid"), F.lit("invalid").alias("issue_type"), F.lit(None).cast("double").alias("area"), "description")


def check_overlaps(fx: DataFrame) -> DataFrame:
    """An issue for each pair of polygons, smaller fid first, that share area."""
    solid = _usable(fx).filter("geom_type = 'Polygon'")
    framed = boxes_of(solid)
    pairs = box_pairs(framed, framed).filter("a_id < b_id")
    met = paired(solid.select("fid", "geom_type", "rings"), solid, pairs).select("fid", "b_fid", "rings", "b_rings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = [sum(map(K.polygon_area, K.intersection([a], [b]))) for a, b in zip(read_rings(batch.column(2)), read_rings(batch.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(areas, pa.float64())], names=["fid", "other_fid", "area"])

    kind = fx.schema["fid"].dataType.simpleString()
    found = met.mapInArrow(run, f"fid {kind}, other_fid {kind}, area double").filter("area > 0")
    return found.select("fid", "other_fid", F.lit("overlap").alias("issue_type"), "area", F.format_string("features %d and %d overlap, area %.6f", "fid", "other_fid", "area").alias("description"))


def check_gaps(fx: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One issue (fid -1) if two or more polygons leave more than ``tolerance`` of their common box uncovered."""
    solid = _usable(fx).filter("geom_type = 'Polygon'")
    b = bounds(F.col("rings"))
    frame = solid.agg(F.count("*").alias("n"), ((F.max(b["max_x"]) - F.min(b["min_x"])) * (F.max(b["max_y"]) - F.min(b["min_y"]))).alias("whole"))
    gap = frame.withColumn("area", F.col("whole") - union_area(fx).scalar()).filter((F.col("n") >= 2) & (F.col("area") > tolerance))
    return gap.select(F.lit(-1).cast("long").alias("fid"), F.lit(None).cast("long").alias("other_fid"), F.lit("gap").alias("issue_type"), "area", F.format_string("gaps with a total area of %.6f", "area").alias("description"))


def full_check(fx: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Validity, overlaps and gaps together."""
    return check_validity(fx).unionByName(check_overlaps(fx)).unionByName(check_gaps(fx, tolerance))
