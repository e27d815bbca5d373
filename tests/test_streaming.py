"""Stateless operators give on a stream what they give on a table."""

from pyspark.sql import functions as F

from cairn import catalog
from cairn.operators import points as P
from cairn.operators import raster as R
from cairn.operators import vector as V
from cairn.streaming import run_stream, stream_table


def both(spark, table, operator, tmp_path):
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    run_stream(stream_table(spark, str(tmp_path / "in"), schema, 1), operator, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    rows = lambda df: sorted(map(repr, df.collect()))
    got, want = rows(spark.read.parquet(str(tmp_path / "out"))), rows(operator(table))
    assert got == want and want


def test_points(spark, sf_dir, tmp_path):
    both(spark, catalog.pc_events(spark, sf_dir), lambda pc: P.pass_through(V.transform_points(pc, "EPSG:4326", "EPSG:3857"), "z", 5, 15), tmp_path)


def test_pixels(spark, sf_dir, tmp_path):
    px, meta = catalog.px_orders(spark, sf_dir)
    both(spark, px.filter("band = 0"), lambda s: R.raster_threshold(s, meta, 200000.0), tmp_path)


def test_features(spark, sf_dir, tmp_path):
    both(spark, catalog.fx_boxes(spark, sf_dir).withColumn("n", F.lit(1)), lambda fx: V.clip_to_extent(fx, (5.0, 3.0, 33.25, 12.75)), tmp_path)
