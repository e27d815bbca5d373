"""What keeps work off the driver and spreads it over tasks."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn import catalog
from cairn.functions import kernels as K
from cairn.operators import blockgrid as BG
from cairn.operators import chunks as B
from cairn.operators import points as P
from cairn.operators import polygonize as G
from cairn.operators import segment as S
from cairn.operators import topology as Y
from cairn.operators import vector as V
from cairn.plans.gridjoin import box_pairs
from cairn.plans.storage import materialise
from cairn.sources import raster as SR


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compressed_tables_are_not_taken_for_small_ones(spark, sf_dir):
    """A million rows that compress to less than the limit of a broadcast stay off the driver, a small table does not."""
    catalog.table(spark, sf_dir, "events")
    many = materialise(spark.range(1_000_000).select("id", F.lit("events").alias("cloud_id"), (F.col("id") % 7).cast("double").alias("d")))
    joined = many.join(many.select("id", F.col("d").alias("other")), "id")
    assert "BroadcastHashJoin" not in plan(joined)
    assert "BroadcastHashJoin" in plan(many.join(many.agg(F.max("id").alias("id")), "id"))


@pytest.mark.parametrize("step", [V.repair_polygons, lambda fx: V.vector_buffer(fx, 0.25), lambda fx: V.vector_simplify(fx, 0.1), Y.check_validity, lambda fx: V.clip_to_extent(fx, (0.0, 0.0, 30.0, 30.0))])
def test_kernels_are_dealt_over_tasks(spark, sf_dir, step):
    fx = catalog.fx_boxes(spark, sf_dir).coalesce(1)
    assert step(fx).rdd.getNumPartitions() >= V.shuffle_partitions(fx) > 1


def test_convex_rings_are_valid_without_an_arrangement(monkeypatch):
    monkeypatch.setattr(K, "crossing", lambda rings: pytest.fail("looked for crossings"))
    assert K.invalid_reason("Polygon", [K.box(0, 0, 2, 1)]) is None
    assert K.invalid_reason("Polygon", [K.circle(K.np.array([3.0, 4.0]), 2.0)]) is None
    assert K.invalid_reason("Polygon", [K.box(0, 0, 8, 8), K.box(1, 1, 3, 3), K.box(4, 4, 7, 7)]) is None
    monkeypatch.undo()
    assert K.invalid_reason("Polygon", [K.box(0, 0, 8, 8), K.box(1, 1, 7, 7), K.box(3, 3, 5, 5)]) == "nested holes"
    assert K.invalid_reason("Polygon", [K.box(0, 0, 8, 8), K.box(9, 1, 10, 3)]) == "hole lies outside shell"
    assert K.invalid_reason("Polygon", [K.box(0, 0, 8, 8), K.box(0, 0, 8, 8)]) == "hole equals shell"
    assert K.invalid_reason("Polygon", [K.box(0, 0, 2, 1)[[0, 2, 1, 3, 4]]]) == "self-intersection"
    assert K.invalid_reason("Polygon", [K.np.array([(0, 0), (2, 0), (1, 0), (2, 2), (0, 0)], float)]) == "self-intersection"


def test_a_geometry_of_many_parts_is_not_copied_for_each(spark):
    """A comb of 20,000 crossings, half a MB of points, falls into 20,000 triangles: with its own rings beside each that would be over 9 GB."""
    n = 20_000
    back = F.transform(F.sequence(F.lit(n), F.lit(0), F.lit(-1)), lambda k: F.struct(k.cast("double").alias("x"), (F.when(k % 2 == 0, -1.0).otherwise(1.0)).alias("y"), F.lit(0.0).alias("z")))
    there = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("z")) for x, y in ((0.0, -1.0), (0.0, 0.0), (float(n), 0.0))))
    fx = spark.range(1).select(F.lit("comb").alias("layer"), F.col("id").alias("fid"), F.lit("Polygon").alias("geom_type"), F.array(F.concat(there, back)).alias("rings"))
    assert V.repair_polygons(fx).count() >= n - 1


def test_dissolve_cuts_polygons_in_many_tasks(spark, sf_dir, monkeypatch):
    """The polygons of one small file are cut into cells by as many tasks as there are shuffle partitions."""
    seen = []
    monkeypatch.setattr(V, "materialise", lambda df: seen.append(df) or materialise(df))
    V.dissolve(catalog.fx_boxes(spark, sf_dir).coalesce(1))
    first = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition 4, true" in first[first.index("MapInArrow") :]


def test_boxes_of_rings_are_made_once_and_after_the_rows_are_dealt(spark, sf_dir):
    """The pairs are read from written boxes: no expression over rings is left in their plan, where it ran for each use and in the scan's tasks."""
    framed = V.boxes_of(catalog.fx_boxes(spark, sf_dir))
    pairs = box_pairs(framed, framed)
    optimized = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" not in optimized and "c_custkey" not in optimized
    met = {(r.a_id, r.b_id) for r in pairs.collect()}
    assert {(b, a) for a, b in met} == met and {(a, a) for a, _ in met} <= met


def test_polygons_along_a_line_are_not_quartered_round_by_round(spark, monkeypatch):
    """4,000 boxes, 4 abreast: the first grid already has small cells, as nearly all cells of the square around them are empty."""
    at = lambda c, k: (c + F.lit(k)).cast("double")
    x, y = F.col("id") % 4, F.floor(F.col("id") / 4)
    fx = V.boxes(spark.range(4000), F.col("id"), at(x, 0), at(y, 0), at(x, 0.5), at(y, 1))
    seen = []
    monkeypatch.setattr(V, "materialise", lambda df: seen.append(df) or materialise(df))
    pieces = V.dissolve(fx, crowd=16)
    assert len(seen) <= 9 and pieces.select("cx", "cy").distinct().count() > 200
    assert pieces.agg(F.sum(V.polygon_area(F.col("rings")))).first()[0] == pytest.approx(2000)


def test_a_large_polygon_keeps_the_first_grid_coarse(spark):
    """A box over the whole square beside the line is cut into no more pieces than about four for each group of polygons."""
    at = lambda c, k: (c + F.lit(k)).cast("double")
    x, y = F.col("id") % 4, F.floor(F.col("id") / 4)
    fx = V.boxes(spark.range(4000), F.col("id"), at(x, 0), at(y, 0), at(x, 0.5), at(y, 1))
    whole = V.boxes(spark.range(1), F.col("id") - 1, F.lit(0), F.lit(0), F.lit(1000), F.lit(1000))
    boxed = fx.unionByName(whole).select(V.bounds(F.col("rings")).alias("b"))
    assert V._first_level(boxed, lambda k: 1024 / 2**k, 3, 1000) == 4
    assert V._first_level(boxed.filter("b.max_x < 100"), lambda k: 1024 / 2**k, 3, 1000) > 6


def test_gaps_cut_polygons_after_they_are_dealt(spark, sf_dir, monkeypatch):
    """What checks rings is not worked out in the tasks of the scan, below the shuffle that deals the rows."""
    seen = []
    monkeypatch.setattr(V, "materialise", lambda df: seen.append(df) or materialise(df))
    Y.check_gaps(catalog.fx_boxes(spark, sf_dir))
    first = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in first and "lambda" not in first[first.rindex("Repartition 4, true") :]


def test_clippers_are_united_once(spark, sf_dir):
    """The pieces of dissolved clippers are written: no kernel on groups is left in the plan of a clip."""
    parts = V.vector_clip(catalog.fx_boxes(spark, sf_dir), catalog.fx_clip(spark, sf_dir))
    optimized = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in optimized and "MapInArrow" in optimized


def test_kernels_on_blocks_see_bounded_parts_of_a_batch():
    """However many blocks an Arrow batch holds, a kernel sees some of their values at a time, and the result is the same."""
    batch = pa.RecordBatch.from_arrays([pa.array([[1.0] * 256] * 9000 + [[2.0] * 3_000_000, None], pa.list_(pa.float32()))], names=["data"])
    parts = list(B.bounded(batch, 0))
    sizes = [len(p.column(0).flatten()) for p in parts]
    assert sum(p.num_rows for p in parts) == batch.num_rows and sum(sizes) == 9000 * 256 + 3_000_000
    assert all(n <= B.AT_ONCE or p.num_rows == 1 for n, p in zip(sizes, parts, strict=True))


def test_an_image_sends_no_more_pixels_than_its_tensor_has(spark):
    """Of 30,000 pixels, 16 x 16 come to the task that makes the tensor; those of a raster smaller than the tensor come repeatedly."""
    px = spark.range(30_000).select(F.lit("r").alias("raster_id"), F.lit(0).alias("band"), (F.col("id") % 100).cast("int").alias("x"), F.floor(F.col("id") / 100).cast("int").alias("y"), F.col("id").cast("double").alias("v"))
    meta = spark.createDataFrame([("r", 100, 300)], "raster_id string, width int, height int")
    rows = S.nearest_pixels(px, meta, 16).collect()
    source = lambda i, n: min(n - 1, int(K.np.float32(i) * (K.np.float32(n) / K.np.float32(16))))
    assert sorted((r.x, r.y, r.v) for r in rows) == sorted((i, j, float(source(j, 300) * 100 + source(i, 100))) for i in range(16) for j in range(16))
    small = S.nearest_pixels(px.filter("x < 5 and y < 3"), spark.createDataFrame([("r", 5, 3)], meta.schema), 16)
    assert small.count() == 256


def test_many_blocks_are_made_of_each_batch_of_pixels(monkeypatch):
    """Blocks that go on in the next batch, pixels given twice and missing ones; as many as come in few batches leave in few."""
    monkeypatch.setattr(SR, "AT_ONCE", 1000)
    rng = K.np.random.default_rng(5)
    rows = sorted((f"r{k % 3}", k % 2, k // 6, 0, 4, 4, int(i), None if i == 7 else float(rng.integers(100))) for k in range(300) for i in rng.integers(0, 16, 12))
    kinds = (pa.string(), *[pa.int32()] * 5, pa.int64(), pa.float32())
    names = [*SR.BLOCK, "i", "v"]
    rows.sort(key=lambda r: r[:6])
    sent = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 700]), kinds, strict=True)], names=names) for k in range(0, len(rows), 700)]
    made = list(SR._blocks(iter([sent[0].slice(0, 0), *sent])))
    assert len(made) < 20 and list(SR._blocks(iter([]))) == []
    want = {}
    for *key, i, v in rows:
        at = want.setdefault(tuple(key), [None] * 16)
        at[i] = v if at[i] is None else at[i] if v is None else max(at[i], v)
    got = [tuple(r.values()) for b in made for r in b.to_pylist()]
    assert {r[:6]: r[6] for r in got} == want and len(got) == len(want) == 300


def test_groups_of_kernels_are_spread(spark, sf_dir):
    """Blocks and rings are put together in all shuffle partitions, however few bytes they have."""
    chunks, meta = catalog._blocks(spark, sf_dir, catalog.px_multi)
    assert BG.mosaic(chunks, meta, "first", "seq").rdd.getNumPartitions() == V.shuffle_partitions(chunks) > 1
    closed = G.block_polygons(*catalog.blocks_mask(spark, sf_dir), 1, "edge")._jdf.queryExecution().optimizedPlan().toString()
    below = closed[closed.index("FlatMapGroupsInArrow") :]
    assert "RepartitionByExpression [ring#" in below


def test_neighbours_send_a_point_to_few_places(spark, monkeypatch):
    """Points go to their block and to those they are near the border of, not to each of 27 cells; lone points meet only the cells within reach."""
    rng = K.np.random.default_rng(8)
    at = K.np.concatenate([rng.random((4000, 3)) * 10, rng.random((5, 3)) * 10 + [0, 0, 200]])
    pc = spark.createDataFrame([("c", i, *map(float, p)) for i, p in enumerate(at)], "cloud_id string, ord long, x double, y double, z double")
    seen, groups = [], P.spread_groups
    monkeypatch.setattr(P, "spread_groups", lambda df, *keys: seen.append(df) or groups(df, *keys))
    got = {r.ord: r.d for r in P.mean_neighbour_distance(pc, 8).collect()}
    assert len(seen) == 1 and len(at) <= seen[0].count() < 4 * len(at) and seen[0].filter("own").count() == len(at)
    for i in [*range(0, 4000, 97), *range(4000, 4005)]:
        assert got[i] == pytest.approx(K.np.sort(K.np.sqrt(((at - at[i]) ** 2).sum(1)))[:8].mean(), rel=1e-12)


@pytest.mark.parametrize(("share", "min_area"), [(0.55, 0.0), (0.55, 8.0), (0.8, 2.0), (1.0, 0.0)])
def test_polygons_are_repaired_without_the_ring_of_a_component(spark, monkeypatch, share, min_area):
    """The parts are those of the repaired rings of whole components, of which no task builds one."""
    rng = K.np.random.default_rng(4)
    cells = [(r, int(x), int(y), int(v)) for r in ("a", "b") for (y, x), v in K.np.ndenumerate((rng.random((31, 17)) < share).astype(int))]
    mask = spark.createDataFrame(cells, "raster_id string, x int, y int, v int").repartition(3)
    meta = spark.createDataFrame([("a", [10.0, 2.0, 0.0, 50.0, 0.0, -2.0]), ("b", [0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "raster_id string, gt array<double>")
    rings = V.filter_small_polygons(G.mask_to_polygons(mask, meta).withColumns({"fid": F.col("component"), "geom_type": F.lit("Polygon")}), min_area)
    corners = lambda df: sorted((r.raster_id, r.component, sorted(sorted({(p.x, p.y) for p in ring}) for ring in r.rings)) for r in df.collect())
    want = corners(V.repair_polygons(rings))
    monkeypatch.setattr(G, "polygons_of", lambda *a: pytest.fail("made the ring of a component"))
    got = G.segment_to_polygons(mask, meta, 1, "centre", min_area, 0.0)
    assert corners(got) == want and want
