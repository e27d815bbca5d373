"""The registered queries: every operator over rasters, points and features derived from the given tables, with DuckDB SQL beside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.geometry import polygon_area
from cairn.operators import blockgrid as BG
from cairn.operators import blockseg as BS
from cairn.operators import chunks as B
from cairn.operators import points as P
from cairn.operators import polygonize as G
from cairn.operators import raster as R
from cairn.operators import segment as S
from cairn.operators import tiles as T
from cairn.operators import topology as Y
from cairn.operators import vector as V
from cairn.plans.storage import fresh_path, materialise, sized_as_rows
from cairn.sources import raster as SR
from cairn.sources import vector as SV

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def out(df: DataFrame, longs: str = "", doubles: str = "", strings: str = "") -> DataFrame:
    """Columns as long, as double rounded to six places, and as string."""
    rounded = lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0)
    return df.select(*(F.col(c).cast("long").alias(c) for c in longs.split()), *(rounded(c).alias(c) for c in doubles.split()), *(F.col(c).cast("string").alias(c) for c in strings.split()))


# ---------------------------------------------------------------- fixtures


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sized_as_rows(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bands(*nodata: float | None):
    return F.array(*(F.struct(F.lit("Float64").alias("dtype"), F.lit(n).cast("float").alias("nodata")) for n in nodata))


def _gt(*values):
    return F.array(*(F.lit(v).cast("double") if not hasattr(v, "cast") else v.cast("double") for v in values))


def px_orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two bands, 100 wide: price (missing where the status is P) and customer, one pixel an order."""
    o = table(spark, sf, "orders")
    x, y = (F.col("o_orderkey") % 100).cast("int").alias("x"), F.floor(F.col("o_orderkey") / 100).cast("int").alias("y")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    both = F.array(F.struct(F.lit(0).alias("band"), price.alias("v")), F.struct(F.lit(1).alias("band"), F.col("o_custkey").cast("double").alias("v")))
    px = o.select(F.lit("orders").alias("raster_id"), x, y, F.explode(both).alias("b")).select("raster_id", "b.band", "x", "y", "b.v")
    height = (F.floor(F.max("o_orderkey") / 100) + 1).cast("int")
    meta = o.agg(height.alias("height")).select(F.lit("orders").alias("raster_id"), F.lit(100).alias("width"), "height", F.lit(2).alias("band_count"), _gt(1000, 2, 0, 5000, 0, -2).alias("gt"), F.lit("EPSG:32650").alias("crs"), _bands(None, None).alias("bands"))
    return px, meta


PX_ORDERS = """px AS (SELECT 0::BIGINT AS band, o_orderkey % 100 AS x, o_orderkey // 100 AS y, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders
    UNION ALL SELECT 1::BIGINT, o_orderkey % 100, o_orderkey // 100, o_custkey::DOUBLE FROM orders), size AS (SELECT 100 AS w, max(o_orderkey) // 100 + 1 AS h FROM orders)"""


def px_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One band, 50 wide: the size of each part; 1 is its nodata value."""
    p = table(spark, sf, "part")
    px = p.select(F.lit("parts").alias("raster_id"), F.lit(0).alias("band"), (F.col("p_partkey") % 50).cast("int").alias("x"), F.floor(F.col("p_partkey") / 50).cast("int").alias("y"), F.col("p_size").cast("double").alias("v"))
    meta = p.agg((F.floor(F.max("p_partkey") / 50) + 1).cast("int").alias("height")).select(F.lit("parts").alias("raster_id"), F.lit(50).alias("width"), "height", F.lit(1).alias("band_count"), _gt(0, 1, 0, 100, 0, -1).alias("gt"), F.lit("EPSG:32650").alias("crs"), _bands(1.0).alias("bands"))
    return px, meta


PX_PARTS = "px AS (SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, p_size::DOUBLE AS v FROM part), size AS (SELECT 50 AS w, max(p_partkey) // 50 + 1 AS h FROM part)"


def px_multi(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A sparse raster for each order priority, shifted against one another; seq follows the name."""
    o = table(spark, sf, "orders")
    px = o.select(F.col("o_orderpriority").alias("raster_id"), F.lit(0).alias("band"), (F.col("o_orderkey") % 100).cast("int").alias("x"), F.floor(F.col("o_orderkey") / 100).cast("int").alias("y"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    names = o.groupBy("o_orderpriority").agg(F.lit(0).alias("_"))
    seq = names.join(names.select(F.col("o_orderpriority").alias("_other")), F.col("_other") <= F.col("o_orderpriority")).groupBy("o_orderpriority").agg((F.count("*") - 1).cast("int").alias("seq"))
    height = o.agg((F.floor(F.max("o_orderkey") / 100) + 1).cast("int").alias("height")).select("height").scalar()
    meta = seq.select(F.col("o_orderpriority").alias("raster_id"), F.lit(100).alias("width"), height.alias("height"), F.lit(1).alias("band_count"), _gt(10 * F.col("seq"), 1, 0, 1000 - 7 * F.col("seq"), 0, -1).alias("gt"), F.lit("EPSG:32650").alias("crs"), _bands(None).alias("bands"), "seq")
    return px, meta


RASTERS = "SELECT DISTINCT o_orderpriority AS raster_id FROM orders"
PX_MULTI = """names AS (SELECT o_orderpriority AS r, row_number() OVER (ORDER BY o_orderpriority) - 1 AS seq FROM (SELECT DISTINCT o_orderpriority FROM orders)),
    px AS (SELECT seq, o_orderkey % 100 + 10 * seq AS x, o_orderkey // 100 + 7 * seq AS y, o_totalprice AS v FROM orders JOIN names ON r = o_orderpriority WHERE o_orderstatus <> 'P')"""


def pc_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    z = F.hour("ts") + F.minute("ts") / 60.0
    return e.select(F.lit("events").alias("cloud_id"), F.col("event_id").alias("ord"), (F.col("user_id") * 0.5).alias("x"), F.col("value").alias("y"), z.alias("z"), F.col("value").alias("intensity"), (F.col("event_id") % 7).cast("short").alias("classification"))


PC_EVENTS = "pc AS (SELECT event_id AS ord, user_id * 0.5 AS x, value AS y, hour(ts) + minute(ts) / 60.0::DOUBLE AS z, value AS intensity, event_id % 7 AS classification FROM events)"


def fx_boxes(spark: SparkSession, sf: str) -> DataFrame:
    c = V.dealt(table(spark, sf, "customer"))  # rings are made in as many tasks as there are, not in those of one small file
    x0, y0 = (F.col("c_custkey") % 40) * 2.0, F.floor(F.col("c_custkey") / 40) * 2.0
    return V.boxes(c, F.col("c_custkey"), x0, y0, x0 + 0.5 + (F.col("c_custkey") % 7) * 0.5, y0 + 0.5 + (F.col("c_custkey") % 5) * 0.5, "boxes", "c_mktsegment", "c_nationkey")


FX_BOXES = """a AS (SELECT c_custkey AS fid, c_mktsegment, c_nationkey, (c_custkey % 40) * 2.0::DOUBLE AS x0, (c_custkey // 40) * 2.0::DOUBLE AS y0,
    (c_custkey % 40) * 2.0::DOUBLE + 0.5 + (c_custkey % 7) * 0.5 AS x1, (c_custkey // 40) * 2.0::DOUBLE + 0.5 + (c_custkey % 5) * 0.5 AS y1 FROM customer)"""


def fx_clip(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    x0, y0 = (F.col("s_suppkey") % 10) * 8.0, F.floor(F.col("s_suppkey") / 10) * 8.0
    return V.boxes(s, F.col("s_suppkey"), x0, y0, x0 + 3.0, y0 + 3.0, "clip")


FX_CLIP = "b AS (SELECT s_suppkey AS fid, (s_suppkey % 10) * 8.0::DOUBLE AS x0, (s_suppkey // 10) * 8.0::DOUBLE AS y0, (s_suppkey % 10) * 8.0::DOUBLE + 3 AS x1, (s_suppkey // 10) * 8.0::DOUBLE + 3 AS y1 FROM supplier)"
_OVERLAP = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def logits_emb(spark: SparkSession, sf: str) -> DataFrame:
    """Each embedding as logits of four classes over 4 x 4 pixels."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "l"))
    return e.select(F.lit("emb").alias("raster_id"), F.col("vec_id").alias("tile_id"), F.floor(F.col("pos") / 16).cast("int").alias("class"), (F.col("pos") % 4).cast("int").alias("px"), F.floor(F.col("pos") % 16 / 4).cast("int").alias("py"), F.col("l").cast("double").alias("logit"))


EMB = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS l, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


def tiles_emb(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each embedding as one 8 x 8 tile of one band."""
    e = table(spark, sf, "embeddings")
    cells = e.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select(F.lit("emb").alias("raster_id"), F.col("vec_id").alias("tile_id"), F.lit(0).alias("band"), (F.col("pos") % 8).cast("int").alias("tx"), F.floor(F.col("pos") / 8).cast("int").alias("ty"), F.col("v").cast("double").alias("v"))
    return e.select(F.lit("emb").alias("raster_id"), F.col("vec_id").alias("tile_id"), F.lit(0).alias("src_x"), F.lit(0).alias("src_y"), F.lit(8).alias("src_w"), F.lit(8).alias("src_h")), cells


# ---------------------------------------------------------------- pixels


@query(f"""WITH {PX_ORDERS}, s AS (SELECT min(v) AS a, max(v) AS b FROM px WHERE band = 0)
    SELECT class, count(*) AS n FROM (SELECT CASE WHEN v IS NULL THEN 0 WHEN ((v - a) / (b - a))::FLOAT >= 0.5 THEN 1 ELSE 0 END::BIGINT AS class FROM px, s WHERE band = 0) GROUP BY class""")
def normalize_threshold_counts(spark, sf):
    px, meta = px_orders(spark, sf)
    mask = R.raster_threshold(R.raster_normalize(px.filter("band = 0")), meta, 0.5)
    return out(T.class_counts(mask), "class n")


@query(f"WITH {PX_ORDERS} SELECT x, y, CASE WHEN v IS NULL THEN 0 WHEN v::FLOAT >= 200000::FLOAT THEN 1 ELSE 0 END::BIGINT AS v FROM px WHERE band = 0")
def threshold(spark, sf):
    return out(R.raster_threshold(*px_orders(spark, sf), 200000.0), "x y v")


@query(f"WITH {PX_PARTS} SELECT x, y, CASE WHEN v <> 1 AND v BETWEEN 1 AND 20 THEN 1 ELSE 0 END::BIGINT AS v FROM px")
def threshold_range(spark, sf):
    return out(R.raster_threshold_range(*px_parts(spark, sf), 1.0, 20.0), "x y v")


@query(f"WITH {PX_ORDERS} SELECT band, x, y, CASE WHEN v IS NOT NULL THEN round((least(greatest(v, 100.0), 250000.0) - 100.0) / 249900.0, 6) + 0.0 END::DOUBLE AS v FROM px", "normalize_range")
def normalize_range(spark, sf):
    return out(R.raster_normalize_range(px_orders(spark, sf)[0], 100.0, 250000.0), "band x y", "v")


@query(f"WITH {PX_ORDERS} SELECT band::BIGINT AS band, count(v) AS n, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM px GROUP BY band")
def band_stats(spark, sf):
    return out(R.band_stats(px_orders(spark, sf)[0]), "band n", "min max mean std")


@query(f"WITH {PX_PARTS} SELECT x, y, CASE WHEN v = 1 THEN 255 WHEN v >= 25 THEN 1 ELSE 0 END::BIGINT AS v FROM px")
def nodata_mask(spark, sf):
    px, meta = px_parts(spark, sf)
    return out(R.apply_nodata_mask(R.raster_threshold(px, meta, 25.0).drop("band"), px, meta), "x y v")


@query(f"WITH {PX_ORDERS} SELECT band, x, y, CASE WHEN v IS NOT NULL THEN least(greatest(round(v), 0), 65535) END::DOUBLE AS v FROM px")
def cast_uint16(spark, sf):
    return out(R.cast_raster(px_orders(spark, sf)[0], "UInt16"), "band x y", "v")


for _name, _low, _high in (("Byte", 0, 255), ("Int16", -32768, 32767)):

    @query(f"WITH {PX_ORDERS} SELECT band, x, y, CASE WHEN v IS NOT NULL THEN least(greatest(round(v / 7 - 400), {_low}), {_high}) END::DOUBLE AS v FROM px", f"cast_{_name.lower()}")
    def _cast(spark, sf, dtype=_name):
        return out(R.cast_raster(px_orders(spark, sf)[0].withColumn("v", F.col("v") / 7 - 400), dtype), "band x y", "v")


@query(f"WITH {PX_ORDERS} SELECT band, x - 10 AS x, y - 2 AS y, round(v, 6) AS v FROM px, size WHERE x BETWEEN 10 AND 40 AND y BETWEEN 2 AND least(8, h - 1)")
def clip_bbox(spark, sf):
    return out(R.raster_clip_bbox(*px_orders(spark, sf), (1020.0, 4984.0, 1080.0, 4996.0))[0], "band x y", "v")


@query(f"WITH {PX_ORDERS} SELECT band, x - 5 AS x, y - 3 AS y, round(v, 6) AS v FROM px WHERE x BETWEEN 5 AND 64 AND y BETWEEN 3 AND 10")
def clip_pixels(spark, sf):
    return out(R.raster_clip_pixels(*px_orders(spark, sf), 5, 3, 60, 8)[0], "band x y", "v")


@query(f"""WITH {PX_ORDERS}, f AS (SELECT 2 ** k::BIGINT AS level FROM size, generate_series(1, 30) g(k) WHERE floor(greatest(w, h) / 2 ** (k - 1)) > 32)
    SELECT level::BIGINT AS level, band, x // level::BIGINT AS x, y // level::BIGINT AS y, round(v, 6) AS v FROM px, f WHERE x % level::BIGINT = 0 AND y % level::BIGINT = 0""")
def overviews(spark, sf):
    return out(R.build_overviews(*px_orders(spark, sf), 32), "level band x y", "v")


@query(f"WITH {PX_ORDERS} SELECT 1000.0::DOUBLE AS min_x, 5000.0 - 2.0 * h::DOUBLE AS min_y, 1200.0::DOUBLE AS max_x, 5000.0::DOUBLE AS max_y, 'EPSG:32650' AS crs FROM size")
def extent(spark, sf):
    return out(SR.inspect_extent(px_orders(spark, sf)[1]), "", "min_x min_y max_x max_y", "crs")


@query(f"WITH {PX_ORDERS} SELECT 'orders' AS raster_id, w::BIGINT AS width, h::BIGINT AS height, 2::BIGINT AS band_count FROM size")
def raster_info(spark, sf):
    return out(SR.raster_info(px_orders(spark, sf)[1]), "width height band_count", "", "raster_id")


@query(f"""WITH {PX_ORDERS} SELECT (x // 16)::BIGINT AS cx, (y // 16)::BIGINT AS cy, band::BIGINT AS band, count(*) AS n, count(v) AS present, round(sum(v::FLOAT::DOUBLE * (1 + x % 16 + 16 * (y % 16))), 1) AS total FROM px GROUP BY ALL""")
def chunk_roundtrip(spark, sf):
    """Values as they come out of the blocks, each weighted by its place in its block."""
    px, meta = px_orders(spark, sf)
    back = SR.to_pixels(SR.from_pixels(px, meta, 16))
    weighted = F.sum(F.col("v") * (1 + F.col("x") % 16 + 16 * (F.col("y") % 16)))
    cells = back.groupBy(F.floor(F.col("x") / 16).alias("cx"), F.floor(F.col("y") / 16).alias("cy"), "band").agg(F.count("*").alias("n"), F.count("v").alias("present"), weighted.alias("total"))
    return cells.select(*(F.col(c).cast("long").alias(c) for c in ("cx", "cy", "band", "n", "present")), F.round("total", 1).alias("total"))


@query(f"WITH {PX_ORDERS} SELECT band, x, y, round(v::FLOAT::DOUBLE, 2) AS v FROM px, size WHERE x < w AND y < h")
def raster_files(spark, sf):
    """Written as blocks of 256 in the shared folder and read again."""
    path = fresh_path(spark)
    SR.write_raster(*px_orders(spark, sf), path)
    px = SR.to_pixels(SR.read_raster(spark, path)[1])
    return px.select(*(F.col(c).cast("long").alias(c) for c in ("band", "x", "y")), F.round("v", 2).alias("v"))


def _blocks(spark, sf, fixture=px_orders):
    """The raster as blocks of 16, and its meta."""
    px, meta = fixture(spark, sf)
    return SR.from_pixels(px, meta, 16), meta


def _apart(chunks: DataFrame) -> DataFrame:
    """Pixels of blocks, those beyond the raster's data left out, with coarse rounding as blocks are in single precision."""
    return SR.to_pixels(chunks).select(*(F.col(c).cast("long").alias(c) for c in ("band", "x", "y")), (F.round("v", 4) + 0.0).alias("v"))


@query(f"WITH {PX_PARTS} SELECT x, y, CASE WHEN v <> 1 AND v >= 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM px")
def blocks_threshold(spark, sf):
    return _apart(B.threshold(*_blocks(spark, sf, px_parts), 25.0)).drop("band")


@query(f"WITH {PX_PARTS} SELECT x, y, CASE WHEN v <> 1 AND v BETWEEN 1 AND 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM px")
def blocks_threshold_range(spark, sf):
    return _apart(B.threshold_range(*_blocks(spark, sf, px_parts), 1.0, 20.0)).drop("band")


@query(f"WITH {PX_ORDERS} SELECT band, x, y, CASE WHEN v IS NOT NULL THEN round(((least(greatest(v::FLOAT::DOUBLE, 100.0), 250000.0) - 100.0) / 249900.0)::FLOAT::DOUBLE, 4) + 0.0 END AS v FROM px")
def blocks_normalize_range(spark, sf):
    return _apart(B.normalize_range(_blocks(spark, sf)[0], 100.0, 250000.0))


@query(f"WITH {PX_ORDERS}, s AS (SELECT band AS b, min(v::FLOAT::DOUBLE) AS lo, max(v::FLOAT::DOUBLE) AS hi FROM px GROUP BY band) SELECT band, x, y, round(((v::FLOAT::DOUBLE - lo) / (hi - lo))::FLOAT::DOUBLE, 4) + 0.0 AS v FROM px JOIN s ON b = band")
def blocks_normalize(spark, sf):
    return _apart(B.normalize(_blocks(spark, sf)[0]))


@query(f"WITH {PX_ORDERS} SELECT band, x, y, CASE WHEN v IS NOT NULL THEN least(greatest(round(v::FLOAT::DOUBLE), 0), 65535) END::DOUBLE AS v FROM px")
def blocks_cast(spark, sf):
    return _apart(B.cast(_blocks(spark, sf)[0], "UInt16"))


@query(f"WITH {PX_ORDERS} SELECT band::BIGINT AS band, count(v) AS n, round(min(v::FLOAT::DOUBLE), 6) AS min, round(max(v::FLOAT::DOUBLE), 6) AS max, round(avg(v::FLOAT::DOUBLE), 6) AS mean, round(stddev_pop(v::FLOAT::DOUBLE), 6) AS std FROM px GROUP BY band")
def blocks_stats(spark, sf):
    return out(B.band_stats(_blocks(spark, sf)[0]), "band n", "min max mean std")


@query(f"WITH {PX_PARTS} SELECT CASE WHEN v <> 1 AND v >= 25 THEN 1 ELSE 0 END::BIGINT AS class, count(*) AS n FROM px GROUP BY ALL")
def blocks_class_counts(spark, sf):
    return out(B.class_counts(B.threshold(*_blocks(spark, sf, px_parts), 25.0)), "class n")


_ENDINGS = ("tif", "TIFF", "cog", "shp", "GeoJSON", "json", "gpkg", "las", "LAZ", "txt")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 < 3 THEN 'Raster' WHEN p_partkey % 10 < 7 THEN 'Vector' WHEN p_partkey % 10 < 9 THEN 'PointCloud' ELSE 'Unknown' END AS kind FROM part")
def detect_format(spark, sf):
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", SR.detect_format(F.concat(F.lit("a.b/"), "p_name", F.lit("."), ending)).alias("kind"))


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN 'Raster' WHEN 1 THEN 'Vector' ELSE 'PointCloud' END AS kind, count(DISTINCT p_size) AS n FROM part GROUP BY ALL")
def list_datasets(spark, sf):
    """The listing of a folder with a file for each size of part, under three endings."""
    path = fresh_path(spark)
    for k, ending in enumerate(("tif", "shp", "las")):
        some = table(spark, sf, "part").filter(F.col("p_partkey") % 3 == k).select("p_name", F.col("p_size").alias("size"))
        some.repartition("size").write.partitionBy("size").option("extension", ending).mode("append").csv(path)
    return SR.list_datasets(spark, path).groupBy("kind").agg(F.count("*").alias("n"))


def _resample_sql(w: str, h: str, bilinear: bool) -> str:
    grid = f"t AS (SELECT b.band, gx.x, gy.y, (gx.x + 0.5) * (w::DOUBLE / {w}) - 0.5 AS sx, (gy.y + 0.5) * (h::DOUBLE / {h}) - 0.5 AS sy, w, h FROM size, (SELECT unnest([0, 1]) AS band) b, LATERAL (SELECT unnest(range({w})) AS x) gx, LATERAL (SELECT unnest(range({h})) AS y) gy)"
    if not bilinear:
        return f"""WITH {PX_ORDERS}, {grid} SELECT t.band::BIGINT AS band, t.x, t.y, round(px.v, 6) AS v FROM t LEFT JOIN px ON px.band = t.band
            AND px.x = greatest(0, least(w - 1, round(sx)::BIGINT)) AND px.y = greatest(0, least(h - 1, round(sy)::BIGINT))"""
    return f"""WITH {PX_ORDERS}, {grid},
        c AS (SELECT *, greatest(0, floor(sx)::BIGINT) AS x0, greatest(0, floor(sy)::BIGINT) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM t),
        q AS (SELECT band, x, y, x0 AS ax, y0 AS ay, (1 - fx) * (1 - fy) AS wt FROM c UNION ALL SELECT band, x, y, least(w - 1, x0 + 1), y0, fx * (1 - fy) FROM c
            UNION ALL SELECT band, x, y, x0, least(h - 1, y0 + 1), (1 - fx) * fy FROM c UNION ALL SELECT band, x, y, least(w - 1, x0 + 1), least(h - 1, y0 + 1), fx * fy FROM c)
        SELECT q.band::BIGINT AS band, q.x, q.y, round(CASE WHEN sum(CASE WHEN v IS NOT NULL THEN wt ELSE 0 END) > 0 THEN sum(v * wt) / sum(CASE WHEN v IS NOT NULL THEN wt ELSE 0 END) END, 4) AS v
        FROM q LEFT JOIN px ON px.band = q.band AND px.x = q.ax AND px.y = q.ay GROUP BY ALL"""


_SINGLE = PX_ORDERS.replace("o_totalprice", "o_totalprice::FLOAT::DOUBLE")


def _single(sql: str, digits: int) -> str:
    """The same over values in single precision, as blocks hold them."""
    return f"SELECT * REPLACE (round(v::FLOAT::DOUBLE, {digits}) + 0.0 AS v) FROM ({sql.replace(PX_ORDERS, _SINGLE).replace("END, 4) AS v", "END, 9) AS v")})"


def _cells(chunks: DataFrame, digits: int, *more: str) -> DataFrame:
    """The values of blocks as pixels."""
    px = SR.to_pixels(chunks)
    return px.select(*(F.col(c).cast("long").alias(c) for c in ("band", "x", "y")), *more, (F.round("v", digits) + 0.0).alias("v"))


def px_small(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two bands of small whole numbers, 50 wide: part sizes (1 is missing), and keys modulo 97. Single precision holds what is computed from them."""
    px, meta = px_parts(spark, sf)
    size = px.withColumn("v", F.when(F.col("v") != 1, F.col("v")))
    keys = px.withColumns({"band": F.lit(1), "v": ((F.col("y") * 50 + F.col("x")) % 97).cast("double")})
    return size.unionByName(keys), meta.withColumn("band_count", F.lit(2))


_SMALL = """px AS (SELECT 0::BIGINT AS band, p_partkey % 50 AS x, p_partkey // 50 AS y, CASE WHEN p_size <> 1 THEN p_size::DOUBLE END AS v FROM part
    UNION ALL SELECT 1::BIGINT, p_partkey % 50, p_partkey // 50, (p_partkey % 97)::DOUBLE FROM part), size AS (SELECT 50 AS w, max(p_partkey) // 50 + 1 AS h FROM part)"""
for _method, _bilinear in (("nearest", False), ("bilinear", True)):
    for _w, _h in (("37", "23"), ("137", "43")):

        @query(_single(_resample_sql(_w, _h, _bilinear).replace(PX_ORDERS, _SMALL), 3), f"blocks_resample_{_method}" + ("" if _w == "37" else "_larger"))
        def _blocks_resample(spark, sf, method=_method, w=int(_w), h=int(_h)):
            chunks, meta = _blocks(spark, sf, px_small)
            return _cells(BG.resample(chunks, meta, w, h, method)[0], 3)


@query(f"WITH {_SINGLE} SELECT band, x - 10 AS x, y - 2 AS y, round(v, 2) AS v FROM px, size WHERE x BETWEEN 10 AND 40 AND y BETWEEN 2 AND least(8, h - 1)")
def blocks_clip_bbox(spark, sf):
    return _cells(BG.clip_bbox(*_blocks(spark, sf), (1020.0, 4984.0, 1080.0, 4996.0))[0], 2)


@query(f"WITH {_SINGLE} SELECT band, x - 5 AS x, y - 3 AS y, round(v, 2) AS v FROM px WHERE x BETWEEN 5 AND 64 AND y BETWEEN 3 AND 10")
def blocks_clip_pixels(spark, sf):
    """A window of a raster stored as blocks; the ranges of blocks reach the scan."""
    path = fresh_path(spark)
    chunks, meta = _blocks(spark, sf)
    chunks.write.parquet(path)
    return _cells(BG.clip_pixels(spark.read.parquet(path), meta, 5, 3, 60, 8)[0], 2)


@query(f"""WITH {_SINGLE}, f AS (SELECT 2 ** k::BIGINT AS level FROM size, generate_series(1, 30) g(k) WHERE floor(greatest(w, h) / 2 ** (k - 1)) > 32)
    SELECT level::BIGINT AS level, band, x // level::BIGINT AS x, y // level::BIGINT AS y, round(v, 2) AS v FROM px, f WHERE x % level::BIGINT = 0 AND y % level::BIGINT = 0""")
def blocks_overviews(spark, sf):
    found = BG.build_overviews(*_blocks(spark, sf), 32)
    cells = found.select("level", "band", "cx", "cy", "w", "size", F.posexplode("data").alias("i", "v"))
    at = (F.col("cx") * F.col("size") + F.col("i") % F.col("w")).cast("long").alias("x"), (F.col("cy") * F.col("size") + F.expr("i div w")).cast("long").alias("y")
    return cells.select(F.col("level").cast("long").alias("level"), F.col("band").cast("long").alias("band"), *at, F.round(F.col("v").cast("double"), 2).alias("v"))


@query(_resample_sql("37", "23", False))
def resample_nearest(spark, sf):
    return out(R.raster_resample(*px_orders(spark, sf), 37, 23, "nearest")[0], "band x y", "v")


@query(_resample_sql("37", "23", True))
def resample_bilinear(spark, sf):
    px = R.raster_resample(*px_orders(spark, sf), 37, 23, "bilinear")[0]
    return px.select(*(F.col(c).cast("long").alias(c) for c in ("band", "x", "y")), F.round("v", 4).alias("v"))


@query(_resample_sql("greatest(1, round(w * 2.0 / 7.0)::BIGINT)", "greatest(1, round(h * 2.0 / 7.0)::BIGINT)", False))
def resample_resolution(spark, sf):
    return out(R.resample_to_resolution(*px_orders(spark, sf), 7.0, "nearest")[0], "band x y", "v")


_MOSAIC_SQL = {"overwrite": "arg_max(v, seq)", "first": "arg_min(v, seq)", "mean": "avg(v)", "max": "max(v)", "min": "min(v)"}
for _name, _sql in _MOSAIC_SQL.items():

    @query(f"WITH {PX_MULTI} SELECT x::BIGINT AS x, y::BIGINT AS y, round({_sql}, 6) AS v FROM px GROUP BY x, y", f"mosaic_{_name}")
    def _mosaic(spark, sf, strategy=_name):
        return out(R.raster_mosaic(*px_multi(spark, sf), strategy, "seq"), "x y", "v")


for _name, _sql in _MOSAIC_SQL.items():

    @query(f"WITH {PX_MULTI} SELECT x::BIGINT AS x, y::BIGINT AS y, round(({_sql})::FLOAT::DOUBLE, 1) + 0.0 AS v FROM (SELECT * REPLACE (v::FLOAT::DOUBLE AS v) FROM px) GROUP BY x, y", f"blocks_mosaic_{_name}")
    def _blocks_mosaic(spark, sf, strategy=_name):
        chunks, meta = _blocks(spark, sf, px_multi)
        return _cells(BG.mosaic(chunks, meta, strategy, "seq"), 1).drop("band").filter("v is not null")


@query(f"WITH {PX_MULTI}, n AS (SELECT max(seq) AS m FROM names), s AS (SELECT max(o_orderkey) // 100 + 1 AS h FROM orders) SELECT 0.0::DOUBLE AS min_x, 100.0 + 10.0 * m::DOUBLE AS max_x, 1000.0::DOUBLE AS max_y, (100 + 10 * m)::BIGINT AS width, (h + 7 * m)::BIGINT AS height FROM n, s")
def mosaic_extent(spark, sf):
    return out(R.mosaic_grid(px_multi(spark, sf)[1], "seq"), "width height", "min_x max_x max_y")


# ---------------------------------------------------------------- points


@query(f"WITH {PC_EVENTS} SELECT ord, round(z, 6) AS z FROM pc WHERE z BETWEEN 5 AND 14.5")
def pass_through(spark, sf):
    return out(P.pass_through(pc_events(spark, sf), "z", 5.0, 14.5), "ord", "z")


@query(f"""WITH {PC_EVENTS} SELECT floor(x / 7.5)::BIGINT AS cx, floor(y / 7.5)::BIGINT AS cy, floor(z / 7.5)::BIGINT AS cz, count(*) AS n, arg_max(classification, ord)::BIGINT AS classification,
    round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(intensity), 6) AS intensity FROM pc GROUP BY ALL""")
def voxel_downsample(spark, sf):
    return out(P.voxel_downsample(pc_events(spark, sf), 7.5), "cx cy cz n classification", "x y z intensity")


@query()
def random_downsample(spark, sf):
    return out(P.random_downsample(pc_events(spark, sf), 0.1, 7), "ord classification", "x y z")


@query("SELECT greatest(1, ceil(count(*) * 0.1))::BIGINT AS n, greatest(1, ceil(count(*) * 0.1))::BIGINT AS matched, true AS stable, true AS seeded FROM events")
def random_downsample_checked(spark, sf):
    """How many points the sample has, how many of them are points of the cloud, whether the same seed gives the same ones and another seed others."""
    pc = pc_events(spark, sf)
    ones = P.random_downsample(pc, 0.1, 7)
    digest = lambda df: df.agg(F.sum(F.xxhash64("ord").cast("decimal(38,0)")).alias("d"))
    again, other = digest(P.random_downsample(pc.repartition(3), 0.1, 7)).scalar(), digest(P.random_downsample(pc, 0.1, 8)).scalar()
    met = ones.join(pc, pc.columns, "left_semi").agg(F.count("*").alias("matched"))
    whole = ones.agg(F.count("*").alias("n"), F.sum(F.xxhash64("ord").cast("decimal(38,0)")).alias("d"))
    return whole.join(met).select("n", "matched", (F.col("d") == again).alias("stable"), (F.col("d") != other).alias("seeded"))


@query("SELECT event_id AS ord, user_id * 0.5::DOUBLE AS x, round(value, 6) AS y, round(value::FLOAT::DOUBLE, 4) AS intensity, event_id % 7 AS classification FROM events")
def point_files(spark, sf):
    """Points written as GeoJSON lines in the shared folder and read again."""
    path = fresh_path(spark)
    SV.write_points(pc_events(spark, sf), path, "geojson")
    back = SV.read_points(spark, path, "geojson")
    return back.select("ord", "x", F.round("y", 6).alias("y"), F.round(F.col("intensity").cast("double"), 4).alias("intensity"), F.col("classification").cast("long").alias("classification"))


@query(f"""WITH {PC_EVENTS}, d AS (SELECT a.ord AS ord, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, row_number() OVER (PARTITION BY a.ord ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS r FROM pc a, pc b)
    SELECT ord, round(avg(d), 6) AS d FROM d WHERE r <= 8 GROUP BY ord""")
def knn(spark, sf):
    return out(P.mean_neighbour_distance(pc_events(spark, sf), 8), "ord", "d")


@query(f"""WITH {PC_EVENTS}, d AS (SELECT a.ord AS ord, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, row_number() OVER (PARTITION BY a.ord ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS r FROM pc a, pc b),
    m AS (SELECT ord, avg(d) AS d FROM d WHERE r <= 8 GROUP BY ord) SELECT ord FROM m WHERE d <= (SELECT avg(d) + 1.0 * stddev_pop(d) FROM m)""")
def outlier_removal(spark, sf):
    return out(P.outlier_removal(pc_events(spark, sf), 8, 1.0), "ord")


@query("SELECT 'events' AS cloud_id, count(*) AS n FROM events")
def point_count(spark, sf):
    return out(P.point_count(pc_events(spark, sf)), "n", "", "cloud_id")


_LON, _LAT = "(user_id % 360 - 180 + 0.25)", "(hour(ts) * 5 - 60 + 0.5)"


def lonlat(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("user_id") % 360 - 180 + 0.25).cast("double").alias("x"), (F.hour("ts") * 5 - 60 + 0.5).cast("double").alias("y"))


@query(f"SELECT event_id, round(radians({_LON}) * 6378137.0, 4) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians({_LAT}) / 2)), 4) AS y FROM events")
def to_3857(spark, sf):
    moved = V.transform_points(lonlat(spark, sf), "EPSG:4326", "EPSG:3857")
    return moved.select("event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("SELECT event_id, round(114 + user_id % 24 * 0.25, 6)::DOUBLE AS x, round(hour(ts) * 2.5 + minute(ts) / 60.0, 6)::DOUBLE AS y FROM events")
def utm_roundtrip(spark, sf):
    at = table(spark, sf, "events").select("event_id", (114 + F.col("user_id") % 24 * 0.25).cast("double").alias("x"), (F.hour("ts") * 2.5 + F.minute("ts") / 60.0).alias("y"))
    return out(V.transform_points(V.transform_points(at, "EPSG:4326", "EPSG:32650"), "EPSG:32650", "EPSG:4326"), "event_id", "x y")


#: Transverse Mercator on WGS 84 for the zone around 117 degrees, by the power series in the distance from the meridian.
_UTM = """g AS (SELECT user_id % 24 AS k, radians(114 + user_id % 24 * 0.25) AS lon, radians(hour(ts) * 2.5 + minute(ts) / 60.0) AS lat, 0.0066943799901413165 AS e2 FROM events),
    t AS (SELECT *, e2 / (1 - e2) AS ep, 6378137.0 / sqrt(1 - e2 * sin(lat) ^ 2) AS n, tan(lat) ^ 2 AS tt, e2 / (1 - e2) * cos(lat) ^ 2 AS c, (lon - radians(117)) * cos(lat) AS a,
        6378137.0 * ((1 - e2 / 4 - 3 * e2 ^ 2 / 64 - 5 * e2 ^ 3 / 256 - 175 * e2 ^ 4 / 16384) * lat - (3 * e2 / 8 + 3 * e2 ^ 2 / 32 + 45 * e2 ^ 3 / 1024 + 105 * e2 ^ 4 / 4096) * sin(2 * lat)
        + (15 * e2 ^ 2 / 256 + 45 * e2 ^ 3 / 1024 + 525 * e2 ^ 4 / 16384) * sin(4 * lat) - (35 * e2 ^ 3 / 3072 + 175 * e2 ^ 4 / 12288) * sin(6 * lat)) AS m FROM g),
    u AS (SELECT k, 500000 + 0.9996 * n * (a + (1 - tt + c) * a ^ 3 / 6 + (5 - 18 * tt + tt ^ 2 + 72 * c - 58 * ep) * a ^ 5 / 120) AS x,
        0.9996 * (m + n * tan(lat) * (a ^ 2 / 2 + (5 - tt + 9 * c + 4 * c ^ 2) * a ^ 4 / 24 + (61 - 58 * tt + tt ^ 2 + 600 * c - 330 * ep) * a ^ 6 / 720)) AS y FROM t)"""


@query(f"WITH {_UTM} SELECT k, count(*) AS n, round(avg(x), 1) AS x, round(avg(y), 1) AS y FROM u GROUP BY k")
def utm_values(spark, sf):
    """Mean easting and northing by longitude."""
    at = table(spark, sf, "events").select((F.col("user_id") % 24).alias("k"), (114 + F.col("user_id") % 24 * 0.25).cast("double").alias("x"), (F.hour("ts") * 2.5 + F.minute("ts") / 60.0).alias("y"))
    moved = V.transform_points(at, "EPSG:4326", "EPSG:32650").groupBy("k").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    return moved.select(F.col("k").cast("long").alias("k"), "n", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))


@query(f"WITH {FX_BOXES} SELECT fid, round(radians(x0) * 6378137.0, 4) + 0.0 AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(y0 / 1000) / 2)), 4) + 0.0 AS y FROM a")
def transform_boxes(spark, sf):
    shrunk = fx_boxes(spark, sf).withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p["x"].alias("x"), (p["y"] / 1000).alias("y"), p["z"].alias("z")))))
    first = F.col("rings")[0][0]
    return V.transform_vector(shrunk, "EPSG:4326", "EPSG:3857").select("fid", (F.round(first["x"], 4) + 0.0).alias("x"), (F.round(first["y"], 4) + 0.0).alias("y"))


# ---------------------------------------------------------------- features


_MEET = "a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1"


@query(f"""WITH {FX_BOXES}, {FX_CLIP}, m AS (SELECT a.fid AS fid, b.fid AS b_fid, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h FROM a, b WHERE {_MEET})
    SELECT fid, b_fid, CASE WHEN w > 0 AND h > 0 THEN 'Polygon' WHEN w > 0 OR h > 0 THEN 'LineString' ELSE 'Point' END AS geom_type, round(CASE WHEN w > 0 AND h > 0 THEN w * h ELSE w + h END, 6) AS size FROM m""")
def intersect_boxes(spark, sf):
    """Boxes that share area, a side or a corner only."""
    ring = F.col("rings")[0]
    length = F.aggregate(F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])), F.lit(0.0), lambda s, x: s + x)
    met = V.vector_intersect(fx_boxes(spark, sf), fx_clip(spark, sf))
    return out(met.withColumn("size", F.when(F.col("geom_type") == "Polygon", polygon_area(F.col("rings"))).when(F.col("geom_type") == "LineString", length).otherwise(0.0)), "fid b_fid", "size", "geom_type")


@query(f"""WITH {FX_BOXES}, {PC_EVENTS} SELECT ord AS fid, a.fid AS b_fid FROM pc, a WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def intersect_points(spark, sf):
    """Points on a grid of halves, so that many lie on sides and corners."""
    at = F.struct("x", "y", F.lit(0.0).alias("z"))
    points = pc_events(spark, sf).select(F.lit("events").alias("layer"), F.col("ord").alias("fid"), F.lit("Point").alias("geom_type"), F.array(F.array(at)).alias("rings"))
    return out(V.vector_intersect(points, fx_boxes(spark, sf)), "fid b_fid")


@query(f"WITH {FX_BOXES}, {FX_CLIP} SELECT DISTINCT a.fid AS fid, c_mktsegment FROM a, b WHERE {_MEET}")
def semi_intersect(spark, sf):
    return out(V.semi_intersect(fx_boxes(spark, sf), fx_clip(spark, sf)), "fid", "", "c_mktsegment")


@query(f"WITH {FX_BOXES}, b AS (SELECT * FROM a) SELECT a.fid AS fid, b.fid AS other_fid, round({_OVERLAP}, 6) AS area, 'overlap' AS issue_type FROM a, b WHERE a.fid < b.fid AND {_OVERLAP} > 0")
def overlaps(spark, sf):
    return out(Y.check_overlaps(fx_boxes(spark, sf)), "fid other_fid", "area", "issue_type")


@query(f"WITH {FX_BOXES}, {FX_CLIP} SELECT a.fid AS fid, round(sum({_OVERLAP}), 6) AS area FROM a, b WHERE {_OVERLAP} > 0 GROUP BY a.fid")
def clip_boxes(spark, sf):
    parts = V.vector_clip(fx_boxes(spark, sf), fx_clip(spark, sf))
    return out(parts.groupBy("fid").agg(F.sum(polygon_area(F.col("rings"))).alias("area")), "fid", "area")


@query(f"WITH {FX_BOXES}, b AS (SELECT 5.0::DOUBLE AS x0, 3.0::DOUBLE AS y0, 33.25::DOUBLE AS x1, 12.75::DOUBLE AS y1) SELECT fid, round({_OVERLAP}, 6) AS area FROM a, b WHERE {_OVERLAP} > 0")
def clip_extent(spark, sf):
    return out(V.clip_to_extent(fx_boxes(spark, sf), (5.0, 3.0, 33.25, 12.75)).withColumn("area", polygon_area(F.col("rings"))), "fid", "area")


# every coordinate is a multiple of a half: areas are counts of half cells
_CELLS = f"WITH {FX_BOXES}, c AS (SELECT DISTINCT i, j FROM a, LATERAL (SELECT unnest(range((x0 * 2)::BIGINT, (x1 * 2)::BIGINT)) AS i) gi, LATERAL (SELECT unnest(range((y0 * 2)::BIGINT, (y1 * 2)::BIGINT)) AS j) gj)"


@query(f"{_CELLS} SELECT round(count(*) * 0.25, 6)::DOUBLE AS area FROM c")
def dissolve_area(spark, sf):
    return out(V.union_area(fx_boxes(spark, sf)), "", "area")


@query(f"{_CELLS}, e AS (SELECT (max(x1) - min(x0)) * (max(y1) - min(y0)) AS whole FROM a) SELECT -1::BIGINT AS fid, 'gap' AS issue_type, round(any_value(whole) - (SELECT count(*) * 0.25 FROM c), 6)::DOUBLE AS area FROM e")
def gaps(spark, sf):
    return out(Y.check_gaps(fx_boxes(spark, sf)), "fid", "area", "issue_type")


@query(f"WITH {FX_BOXES} SELECT fid, round((x1 - x0) * (y1 - y0), 6) AS area, round((x1 - x0) * (y1 - y0) / 4, 6) AS area_px, row_number() OVER (ORDER BY y0, x0, fid) - 1 AS feature_id FROM a")
def polygon_attributes(spark, sf):
    fx = fx_boxes(spark, sf).withColumn("raster_id", F.lit("orders"))
    return out(V.add_polygon_attributes(fx, px_orders(spark, sf)[1]), "fid feature_id", "area area_px")


@query(f"WITH {FX_BOXES} SELECT fid FROM a WHERE (x1 - x0) * (y1 - y0) >= 2.5")
def small_polygons(spark, sf):
    return out(V.filter_small_polygons(fx_boxes(spark, sf), 2.5), "fid")


@query("SELECT c_mktsegment AS layer, 'Polygon' AS geom_type, count(*) AS feature_count FROM customer GROUP BY c_mktsegment")
def layers(spark, sf):
    return out(SV.list_layers(fx_boxes(spark, sf).withColumn("layer", F.col("c_mktsegment"))), "feature_count", "", "layer geom_type")


@query(f"WITH {FX_BOXES} SELECT c_mktsegment AS layer, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM a GROUP BY ALL")
def layer_extents(spark, sf):
    return out(SV.layer_extent(fx_boxes(spark, sf).withColumn("layer", F.col("c_mktsegment"))), "", "min_x min_y max_x max_y", "layer")


@query(f"WITH {FX_BOXES} SELECT c_nationkey::BIGINT AS fid, (row_number() OVER (PARTITION BY c_nationkey ORDER BY fid) - 1)::BIGINT AS part, round((x1 - x0) * (y1 - y0), 6) AS area FROM a")
def explode_parts(spark, sf):
    """The boxes of a nation as one multipolygon, and apart again."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("fid", "rings"))), lambda s: s["rings"])
    multi = fx_boxes(spark, sf).groupBy("c_nationkey").agg(parts.alias("parts")).select(F.lit("nations").alias("layer"), F.col("c_nationkey").alias("fid"), F.lit("MultiPolygon").alias("geom_type"), F.lit(None).cast(G.RINGS).alias("rings"), "parts")
    return out(V.explode_parts(multi).withColumn("area", polygon_area(F.col("rings"))), "fid part", "area")


@query(f"WITH {FX_BOXES} SELECT fid, CASE WHEN fid % 2 = 0 THEN 9 ELSE 5 END::BIGINT AS n, round((x1 - x0) * (y1 - y0) + CASE WHEN fid % 2 = 0 THEN 0.05 * (x1 - x0 + y1 - y0) ELSE 0 END, 6) AS area FROM a")
def simplify(spark, sf):
    """Boxes with the middle of each side moved out: by less than the tolerance, so that it goes, or by more."""
    by = F.when(F.col("fid") % 2 == 0, 0.05).otherwise(0.01)
    ring = F.col("rings")[0]
    middle = lambda a, b, dx, dy: F.struct(((a["x"] + b["x"]) / 2 + dx * by).alias("x"), ((a["y"] + b["y"]) / 2 + dy * by).alias("y"), F.lit(0.0).alias("z"))
    bulged = F.array(*(p for k, (dx, dy) in enumerate([(0, -1), (1, 0), (0, 1), (-1, 0)]) for p in (ring[k], middle(ring[k], ring[k + 1], dx, dy))), ring[4])
    fx = V.vector_simplify(fx_boxes(spark, sf).withColumn("rings", F.array(bulged)), 0.02)
    return out(fx.withColumns({"n": F.size(F.col("rings")[0]), "area": polygon_area(F.col("rings"))}), "fid n", "area")


def bow_ties(fx: DataFrame, which) -> DataFrame:
    """Two corners of some boxes change places: their sides cross in the middle."""
    ring = F.col("rings")[0]
    return fx.withColumn("rings", F.when(which, F.array(F.array(ring[0], ring[2], ring[1], ring[3], ring[4]))).otherwise(F.col("rings")))


@query("SELECT event_id AS fid, round(0.5 * 32 * 4.0 * sin(2 * pi() / 32), 6) AS area FROM events")
def buffer_points(spark, sf):
    pc = pc_events(spark, sf)
    at = F.struct("x", "y", F.lit(0.0).alias("z"))
    fx = pc.select(F.lit("events").alias("layer"), F.col("ord").alias("fid"), F.lit("Point").alias("geom_type"), F.array(F.array(at)).alias("rings"))
    return out(V.point_buffers(fx, 2.0).withColumn("area", polygon_area(F.col("rings"))), "fid", "area")


@query(f"WITH {FX_BOXES}, r AS (SELECT fid, x1 - x0 AS w, y1 - y0 AS h FROM a) SELECT fid, round(w * h + 2 * (w + h) * 0.25 + 0.5 * 32 * 0.0625 * sin(2 * pi() / 32), 4) AS area FROM r")
def buffer_boxes(spark, sf):
    fx = V.vector_buffer(fx_boxes(spark, sf), 0.25)
    return fx.select("fid", F.round(polygon_area(F.col("rings")), 4).alias("area"))


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Of each two boxes, one without its upper right quarter, and one with a hole of half its width and height in the middle."""
    p, q = F.col("rings")[0][0], F.col("rings")[0][2]
    at = lambda i, j: F.struct((p["x"] + (q["x"] - p["x"]) * i / 4).alias("x"), (p["y"] + (q["y"] - p["y"]) * j / 4).alias("y"), F.lit(0.0).alias("z"))
    ring = lambda *corners: F.array(*(at(i, j) for i, j in corners))
    bent = F.array(ring((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)))
    holed = F.array(F.col("rings")[0], ring((1, 1), (1, 3), (3, 3), (3, 1), (1, 1)))
    # written, so that what reads the rings in many places does not make them anew in each
    return materialise(fx_boxes(spark, sf).withColumn("rings", F.when(F.col("fid") % 2 == 0, bent).otherwise(holed)))


#: At distance d of shapes of w by h: a rounded corner adds a quarter of a polygon of 32 sides, a corner inwards takes d * d off.
_GROWN = """CASE WHEN fid % 2 = 0 THEN 0.75 * w * h + 2 * (w + h) * d + 5 * corner - d * d
    ELSE w * h + 2 * (w + h) * d + 4 * corner - greatest(w / 2 - 2 * d, 0) * greatest(h / 2 - 2 * d, 0) END"""
_SHRUNK = """CASE WHEN fid % 2 = 0 THEN 0.75 * w * h - 2 * (w + h) * d + 5 * d * d - corner
    ELSE (w - 2 * d) * (h - 2 * d) - (w * h / 4 + (w + h) * d + 4 * corner) END"""


@query(f"""WITH {FX_BOXES}, r AS (SELECT fid, x1 - x0 AS w, y1 - y0 AS h, 0.0625::DOUBLE AS d, 4 * 0.0625 * 0.0625 * sin(pi() / 16) AS corner FROM a)
    SELECT fid, round({_GROWN}, 6) AS grown, round({_SHRUNK}, 6) AS shrunk FROM r""")
def buffer_shapes(spark, sf):
    """Shapes with a corner inwards and shapes with a hole, a sixteenth wider and narrower."""
    fx = shapes(spark, sf)
    area = lambda distance, name: V.vector_buffer(fx, distance).groupBy("fid").agg(F.sum(polygon_area(F.col("rings"))).alias(name))
    return out(area(0.0625, "grown").join(area(-0.0625, "shrunk"), "fid"), "fid", "grown shrunk")


@query(f"""WITH {FX_BOXES}, parts AS (SELECT fid, x0, y0, (x0 + x1) / 2 AS x1, y1 FROM a WHERE fid % 2 = 0 UNION ALL SELECT fid, (x0 + x1) / 2, y0, x1, (y0 + y1) / 2 FROM a WHERE fid % 2 = 0
        UNION ALL SELECT fid, x0, y0, x0 + (x1 - x0) / 4, y1 FROM a WHERE fid % 2 = 1 UNION ALL SELECT fid, x1 - (x1 - x0) / 4, y0, x1, y1 FROM a WHERE fid % 2 = 1
        UNION ALL SELECT fid, x0 + (x1 - x0) / 4, y0, x1 - (x1 - x0) / 4, y0 + (y1 - y0) / 4 FROM a WHERE fid % 2 = 1 UNION ALL SELECT fid, x0 + (x1 - x0) / 4, y1 - (y1 - y0) / 4, x1 - (x1 - x0) / 4, y1 FROM a WHERE fid % 2 = 1)
    SELECT a.fid AS fid, b.fid AS other_fid, round(sum({_OVERLAP}), 6) AS area FROM parts a JOIN parts b ON a.fid < b.fid AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY ALL HAVING sum({_OVERLAP}) > 0""")
def overlaps_shapes(spark, sf):
    """Overlaps of shapes with corners inwards and holes."""
    return out(Y.check_overlaps(shapes(spark, sf)), "fid other_fid", "area")


@query(f"""WITH {FX_BOXES} SELECT fid, CASE fid % 7 WHEN 0 THEN 'nested holes' WHEN 1 THEN 'hole equals shell' WHEN 2 THEN 'interior is disconnected' WHEN 3 THEN 'coordinate is not finite'
    WHEN 4 THEN 'rings share a side' WHEN 5 THEN 'self-intersection' END AS description FROM a WHERE fid % 7 < 6""")
def validity_rings(spark, sf):
    """Boxes whose holes lie in one another, equal the shell, cut the inside in two, are nowhere, share a side, cross, and touch in a point."""
    p, q = F.col("rings")[0][0], F.col("rings")[0][2]
    at = lambda i, j: F.struct((p["x"] + (q["x"] - p["x"]) * i / 8).alias("x"), (p["y"] + (q["y"] - p["y"]) * j / 8).alias("y"), F.lit(0.0).alias("z"))
    ring = lambda *corners: F.array(*(at(i, j) for i, j in (*corners, corners[0])))
    box = lambda a, b, c, d: ring((a, b), (a, d), (c, d), (c, b))
    nowhere = F.transform(box(1, 1, 3, 3), lambda c: F.struct(F.lit(float("nan")).alias("x"), c["y"].alias("y"), c["z"].alias("z")))
    diamond = lambda a: ring((a, 4), (a + 2, 2), (a + 4, 4), (a + 2, 6))
    holes = [[box(1, 1, 7, 7), box(3, 3, 5, 5)], [F.reverse(F.col("rings")[0])], [diamond(0), diamond(4)], [nowhere], [box(1, 1, 4, 3), box(4, 1, 6, 3)], [box(1, 1, 4, 4), box(3, 3, 6, 6)], [diamond(0), box(5, 1, 7, 3)]]
    rings = F.coalesce(*(F.when(F.col("fid") % 7 == k, F.array(F.col("rings")[0], *some)) for k, some in enumerate(holes)))
    return out(Y.check_validity(fx_boxes(spark, sf).withColumn("rings", rings)), "fid", "", "description")


@query(f"WITH {FX_BOXES} SELECT fid, CASE WHEN fid % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS parts, round((x1 - x0) * (y1 - y0) / CASE WHEN fid % 3 = 0 THEN 2 ELSE 1 END, 6) AS area FROM a")
def repair(spark, sf):
    """A third of the boxes are bow-ties, which fall into two triangles."""
    fx = V.repair_polygons(bow_ties(fx_boxes(spark, sf), F.col("fid") % 3 == 0)).withColumn("area", polygon_area(F.col("rings")))
    return out(fx.groupBy("fid").agg(F.count("*").alias("parts"), F.sum("area").alias("area")), "fid parts", "area")


@query(f"""WITH {FX_BOXES} SELECT fid, CASE fid % 5 WHEN 0 THEN 'ring is not closed' WHEN 1 THEN 'geometry could not be converted' WHEN 2 THEN 'self-intersection' ELSE 'hole lies outside shell' END AS description FROM a WHERE fid % 5 < 4""")
def validity(spark, sf):
    """Of each five boxes one is left open, one has three points, one is a bow-tie, one has its hole beside it, and one is sound."""
    fifth = F.col("fid") % 5
    fx = bow_ties(fx_boxes(spark, sf), fifth == 2)
    fx = fx.withColumn("rings", F.transform("rings", lambda r: F.when(fifth == 0, F.slice(r, 1, 4)).when(fifth == 1, F.slice(r, 1, 3)).otherwise(r)))
    beside = F.transform(F.col("rings")[0], lambda p: F.struct((p["x"] + 100).alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    return out(Y.check_validity(fx.withColumn("rings", F.when(fifth == 3, F.array(F.col("rings")[0], beside)).otherwise(F.col("rings")))), "fid", "", "description")


@query(f"WITH {FX_BOXES}, {FX_CLIP} SELECT b.fid AS hole, arg_min(a.fid, [(a.x1 - a.x0) * (a.y1 - a.y0), a.fid::DOUBLE]) AS outer_id FROM b LEFT JOIN a ON b.x0 + 0.1 BETWEEN a.x0 AND a.x1 AND b.y0 + 0.1 BETWEEN a.y0 AND a.y1 GROUP BY b.fid")
def associate_holes(spark, sf):
    """The clip boxes, moved off the grid of the others' sides, as holes."""
    moved = F.transform(F.col("rings")[0], lambda p: F.struct((p["x"] + 0.1).alias("x"), (p["y"] + 0.1).alias("y"), p["z"].alias("z")))
    found = G.associate_holes(fx_boxes(spark, sf).select(F.col("fid").alias("id"), F.col("rings")[0].alias("ring")), fx_clip(spark, sf).select(F.col("fid").alias("id"), moved.alias("ring")))
    return out(found.select("hole", F.col("outer").alias("outer_id")), "hole outer_id")


@query(f"WITH {FX_BOXES}, b AS (SELECT * FROM a) SELECT 'overlap' AS issue_type, count(*) AS n FROM a, b WHERE a.fid < b.fid AND {_OVERLAP} > 0 UNION ALL SELECT 'gap', 1")
def full_check(spark, sf):
    return out(Y.full_check(fx_boxes(spark, sf)).groupBy("issue_type").agg(F.count("*").alias("n")), "n", "", "issue_type")


@query(f"""WITH {FX_BOXES}, b AS (SELECT * FROM a), halves AS (SELECT DISTINCT i, j FROM a, LATERAL (SELECT unnest(range((2 * x0)::BIGINT, (2 * x1)::BIGINT)) AS i) u, LATERAL (SELECT unnest(range((2 * y0)::BIGINT, (2 * y1)::BIGINT)) AS j) v)
    SELECT 'overlap' AS issue_type, a.fid AS fid, b.fid AS other_fid, round({_OVERLAP}, 6) AS area FROM a, b WHERE a.fid < b.fid AND {_OVERLAP} > 0
    UNION ALL SELECT 'gap', -1, NULL, round((max(x1) - min(x0)) * (max(y1) - min(y0)) - (SELECT count(*) / 4.0 FROM halves)::DOUBLE, 6) FROM a""")
def full_check_pairs(spark, sf):
    return out(Y.full_check(fx_boxes(spark, sf)), "fid other_fid", "area", "issue_type")


# ---------------------------------------------------------------- tensors, classes, blending


_TENSOR = {
    "none": "l",
    "imagenet": "(l - 0.485) / 0.229",
    "minmax": "CASE WHEN max(l) OVER w - min(l) OVER w <= 1e-6 THEN 0 ELSE (l - min(l) OVER w) / (max(l) OVER w - min(l) OVER w) END",
    "zscore": "(l - avg(l) OVER w) / CASE WHEN stddev_pop(l) OVER w <= 1e-6 THEN 1 ELSE stddev_pop(l) OVER w END",
}
for _name, _sql in _TENSOR.items():

    @query(f"WITH {EMB} SELECT vec_id AS tile_id, pos::BIGINT AS p, round(({_sql})::FLOAT::DOUBLE, 4) + 0.0 AS v FROM e WINDOW w AS (PARTITION BY vec_id) UNION ALL SELECT vec_id, 64 + unnest(range(64)), 0.0 FROM embeddings", f"tensor_{_name}")
    def _tensor(spark, sf, mode=_name):
        tiles, cells = tiles_emb(spark, sf)
        values = T.to_tensors(cells, tiles, mode, 8, 8, 2).select("tile_id", F.posexplode("tensor").alias("p", "v"))
        return values.select("tile_id", F.col("p").cast("long").alias("p"), (F.round(F.col("v").cast("double"), 4) + 0.0).alias("v"))


@query(f"WITH {EMB} SELECT vec_id AS tile_id, pos::BIGINT AS p, round(((l - 0.25) / 0.5)::FLOAT::DOUBLE, 4) + 0.0 AS v FROM e UNION ALL SELECT vec_id, 64 + unnest(range(64)), 0.0 FROM embeddings")
def tensor_custom(spark, sf):
    """Written as Parquet in the shared folder and read again."""
    tiles, cells = tiles_emb(spark, sf)
    path = fresh_path(spark)
    SR.write_tensors(T.to_tensors(cells, tiles, "custom", 8, 8, 2, (0.25, 0.0, 0.0), (0.5, 1.0, 1.0)), path)
    values = spark.read.parquet(path).select("tile_id", F.posexplode("tensor").alias("p", "v"))
    return values.select("tile_id", F.col("p").cast("long").alias("p"), (F.round(F.col("v").cast("double"), 4) + 0.0).alias("v"))


def sum_and_difference(a, b):
    import numpy as np

    return np.concatenate([a + b, a - b], axis=1)


@query(f"WITH {EMB} SELECT vec_id AS tile_id, (c * 64 + pos)::BIGINT AS p, round(CASE WHEN c = 0 THEN l::FLOAT + (l * 3)::FLOAT ELSE l::FLOAT - (l * 3)::FLOAT END::DOUBLE, 4) + 0.0 AS v FROM e, (SELECT unnest([0, 1]) AS c) k")
def score_two_inputs(spark, sf):
    tiles, cells = tiles_emb(spark, sf)
    tensors = T.to_tensors(cells, tiles, "none", 8, 8, 1).withColumn("thrice", F.transform("tensor", lambda v: (v * 3).cast("float")))
    scored = S.score(tensors, sum_and_difference, 8, ("tensor", "thrice")).filter("error is null").select("tile_id", F.posexplode("scores").alias("p", "v"))
    return scored.select("tile_id", F.col("p").cast("long").alias("p"), (F.round(F.col("v").cast("double"), 4) + 0.0).alias("v"))


@query(f"WITH {PX_PARTS} SELECT (ty * 16 + tx)::BIGINT AS p, px.v::DOUBLE AS v FROM size, (SELECT unnest(range(16)) AS tx) gx, (SELECT unnest(range(16)) AS ty) gy, px WHERE px.x = least(w - 1, floor(tx::FLOAT * (w::FLOAT / 16::FLOAT))::BIGINT) AND px.y = least(h - 1, floor(ty::FLOAT * (h::FLOAT / 16::FLOAT))::BIGINT)")
def band_tensor(spark, sf):
    return out(T.band_to_tensor(*px_parts(spark, sf), 0, 16, 16).select(F.posexplode("tensor").alias("p", "v")), "p", "v")


@query(f"WITH {EMB} SELECT vec_id AS tile_id, (pos % 4)::BIGINT AS px, (pos % 16 // 4)::BIGINT AS py, (arg_max(pos // 16, l))::BIGINT AS class FROM e GROUP BY ALL")
def sigmoid_argmax(spark, sf):
    return out(T.sigmoid_argmax(logits_emb(spark, sf)), "tile_id px py class")


@query(f"WITH {EMB} SELECT vec_id AS tile_id, (pos // 16)::BIGINT AS class, sum(CASE WHEN 1 / (1 + exp(-l)) >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n FROM e GROUP BY ALL")
def threshold_mask(spark, sf):
    mask = logits_emb(spark, sf).withColumn("m", T.threshold_mask(T.sigmoid(F.col("logit"))))
    return out(mask.groupBy("tile_id", "class").agg(F.sum("m").alias("n")), "tile_id class n")


TILE, STRIDE = 16, 12
_OFFSETS = """(SELECT DISTINCT least(k * 12, greatest(L - 16, 0)) AS o FROM (SELECT unnest(range(L // 12 + 1)) AS k) WHERE k * 12 + 16 <= L OR least(k * 12, greatest(L - 16, 0)) = greatest(L - 16, 0))"""
_TILES = f"""xs AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS k FROM (SELECT w AS L FROM size), LATERAL {_OFFSETS}), ys AS (SELECT o, row_number() OVER (ORDER BY o) - 1 AS k FROM (SELECT h AS L FROM size), LATERAL {_OFFSETS}),
    tiles AS (SELECT ys.k * (SELECT count(*) FROM xs) + xs.k AS tile_id, xs.o AS src_x, ys.o AS src_y, least(16, w - xs.o) AS src_w, least(16, h - ys.o) AS src_h FROM xs, ys, size)"""


@query(f"WITH {PX_PARTS}, {_TILES} SELECT tile_id::BIGINT AS tile_id, src_x::BIGINT AS src_x, src_y::BIGINT AS src_y, src_w::BIGINT AS src_w, src_h::BIGINT AS src_h FROM tiles")
def tiles(spark, sf):
    return out(T.tile_grid(px_parts(spark, sf)[1], TILE, STRIDE), "tile_id src_x src_y src_w src_h")


@query(f"WITH {PX_PARTS}, {_TILES} SELECT tile_id::BIGINT AS tile_id, count(*) AS n, round(sum(v * ((x - src_x) + 16 * (y - src_y))), 6) AS s FROM tiles JOIN px ON x >= src_x AND x < src_x + 16 AND y >= src_y AND y < src_y + 16 GROUP BY tile_id")
def tile_pixels(spark, sf):
    cells = T.tile_raster(*px_parts(spark, sf), TILE, STRIDE)[1]
    return out(cells.groupBy("tile_id").agg(F.count("*").alias("n"), F.sum(F.col("v") * (F.col("tx") + 16 * F.col("ty"))).alias("s")), "tile_id n", "s")


@query(f"WITH {PX_PARTS}, {_TILES} SELECT DISTINCT tile_id::BIGINT AS tile_id FROM tiles JOIN px ON x >= src_x AND x < src_x + 16 AND y >= src_y AND y < src_y + 16 WHERE y % 40 < 4 AND v <> 1")
def skip_tiles(spark, sf):
    """Rows 4 to 39 of each 40 count as nodata."""
    px, meta = px_parts(spark, sf)
    tiles, cells = T.tile_raster(px.withColumn("v", F.when(F.col("y") % 40 < 4, F.col("v")).otherwise(1.0)), meta, TILE, STRIDE)
    return out(T.skip_nodata_tiles(tiles, cells, 1.0), "tile_id")


def _probs(spark, sf):
    """Two classes whose probabilities hang on the pixel and on the tile, so that blending shows."""
    px, meta = px_parts(spark, sf)
    tiles, cells = T.tile_raster(px, meta, TILE, STRIDE)
    classes = F.explode(F.array(F.lit(0), F.lit(1)))
    p = (F.col("v") + F.col("tile_id") % 7 + 3 * F.col("class")) / 61.0
    return cells.withColumn("class", classes).select("raster_id", "tile_id", "class", F.col("tx").alias("px"), F.col("ty").alias("py"), p.alias("p")), tiles, meta


_PROBS = "p AS (SELECT tile_id, class, x, y, x - src_x AS tx, y - src_y AS ty, (v + tile_id % 7 + 3 * class) / 61.0::DOUBLE AS p FROM tiles JOIN px ON x >= src_x AND x < src_x + 16 AND y >= src_y AND y < src_y + 16, (SELECT unnest([0, 1]) AS class) c)"


def _weights(mode: str) -> str:
    """Weights along a side of 16 with an overlap of 4, by the distance to the nearer end."""
    ramp = {"none": "1.0", "linear": "(d + 1) / 5.0", "gaussian": "1 - exp(-((4 - d) ** 2) / 8.0)"}[mode]
    return f"wt AS (SELECT i, CASE WHEN d < 4 THEN {ramp} ELSE 1.0 END::DOUBLE AS w FROM (SELECT i, least(i, 15 - i) AS d FROM (SELECT unnest(range(16)) AS i)))"


for _name in ("none", "linear", "gaussian"):
    _agg = "arg_max(p, tile_id)" if _name == "none" else "sum(p * a.w * b.w) / sum(a.w * b.w)"

    @query(f"WITH {PX_PARTS}, {_TILES}, {_PROBS}, {_weights(_name)} SELECT class::BIGINT AS class, x::BIGINT AS x, y::BIGINT AS y, round({_agg}, 6) AS score FROM p JOIN wt a ON a.i = tx JOIN wt b ON b.i = ty GROUP BY ALL", f"blend_{_name}")
    def _blend(spark, sf, mode=_name):
        probs, tiles, _ = _probs(spark, sf)
        return out(T.blend_tiles(probs, tiles, TILE, STRIDE, mode), "class x y", "score")


@query(f"""WITH {PX_PARTS}, {_TILES}, {_PROBS}, s AS (SELECT class, x, y, arg_max(p, tile_id) AS s FROM p GROUP BY ALL),
    b AS (SELECT x, y, max(s) AS m, arg_max(class, s) AS c FROM s GROUP BY x, y) SELECT x::BIGINT AS x, y::BIGINT AS y, CASE WHEN m >= 0.5 THEN c ELSE 0 END::BIGINT AS v FROM b""")
def final_mask(spark, sf):
    probs, tiles, meta = _probs(spark, sf)
    return out(T.final_mask(T.blend_tiles(probs, tiles, TILE, STRIDE, "none"), meta, 0.5), "x y v")


def linear_scorer(x):
    """Two classes, each linear in the pixel: class 1 wins above 25."""
    import numpy as np

    first = x[:, :1]
    return np.concatenate([25.0 - first, first - 25.0], axis=1)


_CONFIG = S.SegmentConfig(tile=16, stride=12, channels=1, blend="none", nodata=-1.0, min_area=0.0, tolerance=0.0)


@query(f"WITH {PX_PARTS} SELECT x, y, CASE WHEN v = 1 THEN 255 WHEN v > 25 THEN 1 ELSE 0 END::BIGINT AS v FROM px")
def segment_large(spark, sf):
    return out(S.segment_large(*px_parts(spark, sf), linear_scorer, _CONFIG).mask, "x y v")


@query(f"WITH {PX_PARTS} SELECT x, y, CASE WHEN v = 1 THEN 255 WHEN v > 25 THEN 1 ELSE 0 END::BIGINT AS v FROM px")
def blocks_segment_large(spark, sf):
    """The same over blocks, from tiles to mask."""
    chunks, meta = _blocks(spark, sf, px_parts)
    mask = SR.to_pixels(BS.segment_blocks(chunks, meta, linear_scorer, _CONFIG).mask)
    return out(mask.join(px_parts(spark, sf)[0].select("raster_id", "x", "y"), ["raster_id", "x", "y"], "left_semi"), "x y v")


@query(f"""WITH {PX_PARTS}, {_TILES}, live AS (SELECT DISTINCT tile_id FROM tiles JOIN px ON x >= src_x AND x < src_x + 16 AND y >= src_y AND y < src_y + 16 WHERE y % 40 < 4)
    SELECT count(*) AS total_tiles, count(*) - (SELECT count(*) FROM live) AS skipped_tiles, (SELECT count(*) FROM live) AS inferred_tiles FROM tiles""")
def segmentation_stats(spark, sf):
    """Rows 4 to 39 of each 40 count as nodata, so that some tiles are skipped."""
    px, meta = px_parts(spark, sf)
    result = S.segment_large(px.withColumn("v", F.when(F.col("y") % 40 < 4, F.col("v")).otherwise(-1.0)), meta, linear_scorer, _CONFIG)
    return out(S.segmentation_stats(result.tiles), "total_tiles skipped_tiles inferred_tiles")


_TOO_BRIGHT = 49.99


def scaled_scorer(x):
    return linear_scorer(x / 10000.0)


def strict_scorer(x):
    if x.max() / 10000.0 > _TOO_BRIGHT:
        raise ValueError("too bright")
    return scaled_scorer(x)


@query(f"""WITH size AS (SELECT 100 * (max(o_orderkey) // 100 + 1) AS pixels FROM orders), r AS ({RASTERS}),
    ones AS (SELECT o_orderpriority AS raster_id, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice::FLOAT / 10000::FLOAT > 25 GROUP BY ALL)
    SELECT raster_id, true AS success, '' AS error, coalesce(n, 0) AS ones, pixels - coalesce(n, 0) AS others FROM r LEFT JOIN ones USING (raster_id), size""")
def batch_segment(spark, sf):
    result, _, report = S.batch_segment(*px_multi(spark, sf), scaled_scorer, S.SegmentConfig(tile=64, stride=48, channels=1), polygons=False)
    classes = result.mask.groupBy("raster_id").agg(F.count_if(F.col("v") == 1).alias("ones"), F.count_if(F.col("v") != 1).alias("others"))
    return report.join(classes, "raster_id").select("raster_id", "success", "error", "ones", "others")


@query(f"""WITH r AS ({RASTERS}), size AS (SELECT 100 AS w, max(o_orderkey) // 100 + 1 AS h FROM orders),
    g AS (SELECT raster_id, tx, ty, least(w - 1, floor(tx::FLOAT * (w::FLOAT / 16::FLOAT))::BIGINT) AS x, least(h - 1, floor(ty::FLOAT * (h::FLOAT / 16::FLOAT))::BIGINT) AS y FROM r, size, (SELECT unnest(range(16)) AS tx) gx, (SELECT unnest(range(16)) AS ty) gy)
    SELECT raster_id, tx::BIGINT AS x, ty::BIGINT AS y, CASE WHEN o_totalprice > 25 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM g LEFT JOIN orders ON o_orderpriority = raster_id AND o_orderkey = y * 100 + x AND o_orderstatus <> 'P'""")
def segment_image(spark, sf):
    return out(S.segment_image(*px_multi(spark, sf), linear_scorer, 16, 1)[0], "x y", "v", "raster_id")


# ---------------------------------------------------------------- polygons


def parts_mask(spark, sf):
    px, meta = px_parts(spark, sf)
    return R.raster_threshold(px, meta, 25.0).drop("band"), meta


_COMPONENTS = f"""WITH RECURSIVE {PX_PARTS}, s AS (SELECT x, y, y * 50 + x AS id FROM px WHERE v >= 25),
    n AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
    r(root, id) AS (SELECT id, id FROM s UNION SELECT r.root, n.b FROM r JOIN n ON n.a = r.id AND n.b > r.root),
    c AS (SELECT id, min(root) AS root FROM r GROUP BY id)"""
# an outline through pixel centres encloses the whole of four pixels that meet and half of three
_CENTRE = f"""{_COMPONENTS}, w AS (SELECT px.x, px.y, count(*) AS n, min(root) AS root FROM px JOIN s ON s.x - px.x IN (0, 1) AND s.y - px.y IN (0, 1) JOIN c USING (id) GROUP BY px.x, px.y HAVING count(*) >= 3),
    shapes AS (SELECT root, sum(CASE WHEN n = 4 THEN 1.0 ELSE 0.5 END) AS area FROM w GROUP BY root)"""


@query(f"{_COMPONENTS} SELECT pixels, count(*) AS n FROM (SELECT count(*) AS pixels FROM c GROUP BY root) GROUP BY pixels")
def components(spark, sf):
    stats = G.component_stats(G.label_components(parts_mask(spark, sf)[0]))
    return out(stats.groupBy("pixels").agg(F.count("*").alias("n")), "pixels n")


def blocks_mask(spark, sf):
    """The mask of the parts in blocks of 16."""
    chunks, meta = _blocks(spark, sf, px_parts)
    return B.threshold(chunks, meta, 25.0), meta


@query(f"{_COMPONENTS} SELECT pixels, min_x, min_y, max_x, max_y, count(*) AS n FROM (SELECT count(*) AS pixels, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM c JOIN s USING (id) GROUP BY root) GROUP BY ALL")
def blocks_components(spark, sf):
    stats = G.component_stats(G.label_blocks(blocks_mask(spark, sf)[0]))
    box = ["pixels", "min_x", "min_y", "max_x", "max_y"]
    return out(stats.groupBy(*box).agg(F.count("*").alias("n")), " ".join([*box, "n"]))


@query(f"{_CENTRE} SELECT round(area, 6)::DOUBLE AS area, count(*) AS n FROM shapes GROUP BY ALL")
def blocks_polygons(spark, sf):
    """How often each area occurs among the polygons of components labelled in blocks."""
    mask, meta = blocks_mask(spark, sf)
    shapes = G.label_polygons(G.label_blocks(mask), meta, "centre").withColumn("area", F.round(polygon_area(F.col("rings")), 6))
    return out(shapes.groupBy("area").agg(F.count("*").alias("n")), "n", "area")


@query(f"{_CENTRE} SELECT round(area, 6)::DOUBLE AS area, count(*) AS n FROM shapes GROUP BY ALL")
def blocks_traced(spark, sf):
    """The same from outlines traced block by block."""
    shapes = G.block_polygons(*blocks_mask(spark, sf), 1, "centre").withColumn("area", F.round(polygon_area(F.col("rings")), 6))
    return out(shapes.groupBy("area").agg(F.count("*").alias("n")), "n", "area")


@query(f"""{_COMPONENTS.replace("abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1", "abs(a.x - b.x) + abs(a.y - b.y) <= 1")} SELECT pixels::DOUBLE AS area, count(*) AS n FROM (SELECT count(*) AS pixels FROM c GROUP BY root) GROUP BY pixels""")
def blocks_traced_edge(spark, sf):
    """Areas of polygons along pixel sides: those of the parts that hang together by sides."""
    shapes = G.block_polygons(*blocks_mask(spark, sf), 1, "edge").withColumn("area", F.round(polygon_area(F.col("rings")), 6))
    return out(shapes.groupBy("area").agg(F.count("*").alias("n")), "n", "area")


@query(f"WITH {PX_PARTS} SELECT round(sum(CASE WHEN v >= 25 THEN 1 ELSE 0 END), 6)::DOUBLE AS area FROM px")
def polygons(spark, sf):
    mask, meta = parts_mask(spark, sf)
    return out(G.mask_to_polygons(mask, meta, 1, "edge").agg(F.sum(polygon_area(F.col("rings"))).alias("area")), "", "area")


@query(f"WITH {PX_PARTS} SELECT round(sum(CASE WHEN v >= 25 THEN 1 ELSE 0 END), 6)::DOUBLE AS area FROM px")
def boundary_area(spark, sf):
    edges = G.boundary_edges(parts_mask(spark, sf)[0])
    return out(edges.agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area")), "", "area")


@query(f"{_CENTRE} SELECT round(area, 6)::DOUBLE AS area, count(*) AS n FROM shapes GROUP BY ALL")
def polygons_centre(spark, sf):
    """How often each area occurs among the polygons of the components."""
    shapes = G.mask_to_polygons(*parts_mask(spark, sf), 1, "centre").withColumn("area", F.round(polygon_area(F.col("rings")), 6))
    return out(shapes.groupBy("area").agg(F.count("*").alias("n")), "n", "area")


@query(f"{_CENTRE} SELECT round(sum(area), 6)::DOUBLE AS area, true AS numbered FROM shapes WHERE area >= 4")
def segment_polygons(spark, sf):
    """Polygons of at least four pixels, repaired and numbered from 0 without a gap."""
    mask, meta = parts_mask(spark, sf)
    shapes = G.segment_to_polygons(mask, meta, 1, "centre", 4.0, 0.0)
    whole = (F.max("feature_id") + 1 == F.count("*")) & (F.min("feature_id") == 0) & (F.count_distinct("feature_id") == F.count("*"))
    return shapes.agg(F.round(F.sum("area"), 6).alias("area"), whole.alias("numbered"))


# ---------------------------------------------------------------- further operators on their own


@query(f"WITH {PX_ORDERS}, s AS (SELECT band AS b, min(v) AS lo, max(v) AS hi FROM px GROUP BY band) SELECT band, x, y, round((v - lo) / (hi - lo), 6) AS v FROM px JOIN s ON b = band")
def normalize(spark, sf):
    return out(R.raster_normalize(px_orders(spark, sf)[0]), "band x y", "v")


@query(f"WITH {FX_BOXES} SELECT fid, fid % 3 <> 1 AS usable FROM a")
def geometry_checks(spark, sf):
    """A third of the boxes cut down to three points."""
    fx = fx_boxes(spark, sf).withColumn("rings", F.transform("rings", lambda r: F.when(F.col("fid") % 3 == 1, F.slice(r, 1, 3)).otherwise(r)))
    return V.to_geometry_checks(fx).select("fid", "usable")


@query("SELECT 'boxes' AS layer, count(*) AS n FROM customer")
def feature_count(spark, sf):
    return out(SV.feature_count(fx_boxes(spark, sf)), "n", "", "layer")


@query(f"WITH {PX_ORDERS} SELECT x, y, round(v, 6) AS v FROM px WHERE band = 1")
def band_data(spark, sf):
    return out(SR.band_data(px_orders(spark, sf)[0], 1), "x y", "v")


@query(f"WITH {FX_BOXES} SELECT fid, 'Feature' AS kind, 5::BIGINT AS n, x0, y0, x1, y1 FROM a")
def geojson(spark, sf):
    """Each box as a GeoJSON feature, read again as JSON."""
    lines = SV.to_geojson(fx_boxes(spark, sf).select("layer", "fid", "geom_type", "rings", "c_mktsegment"))
    ring = F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<array<double>>>")[0]
    corners = [ring[k][i].alias(f"{'xy'[i]}{k // 2}") for k in (0, 2) for i in (0, 1)]
    return lines.select(F.get_json_object("value", "$.id").cast("long").alias("fid"), F.get_json_object("value", "$.type").alias("kind"), F.size(ring).cast("long").alias("n"), *corners)


@query(f"WITH {FX_BOXES} SELECT fid, x0, y0, x1, y1, c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM a")
def vector_files(spark, sf):
    """Features written as GeoJSON lines in the shared folder and read again."""
    path = fresh_path(spark)
    SV.write_vector(fx_boxes(spark, sf), path)
    back = SV.read_vector(spark, path, "boxes", "c_mktsegment string, c_nationkey long", strict=True)
    ring = F.col("rings")[0]
    return back.select("fid", *(ring[k][c].alias(f"{c}{k // 2}") for k in (0, 2) for c in "xy"), "c_mktsegment", "c_nationkey")


@query(f"""WITH r AS ({RASTERS}), top AS (SELECT o_orderpriority AS raster_id, max(o_totalprice::FLOAT) / 10000::FLOAT > {_TOO_BRIGHT} AS bad FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
    SELECT count_if(bad) = 0 AS success, (count(*) - count_if(bad))::BIGINT AS succeeded, count(*) AS total, coalesce(string_agg(CASE WHEN bad THEN raster_id || ': too bright' END, '; ' ORDER BY raster_id), '') AS error FROM r LEFT JOIN top USING (raster_id)""")
def overall_report(spark, sf):
    """The model refuses tiles with a very bright pixel, so some rasters fail and the others go on."""
    report = S.batch_segment(*px_multi(spark, sf), strict_scorer, S.SegmentConfig(tile=64, stride=48, channels=1, batch_size=1), polygons=False)[2]
    return S.overall_report(report).select("success", "succeeded", "total", "error")
