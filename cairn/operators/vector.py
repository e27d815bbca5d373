"""Operators on features: layer, fid (unique in a table), geom_type (Point, LineString, Polygon), rings, and attribute columns.

Kernels run in Arrow batches; a row without a usable geometry is dropped where the operator makes geometries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import kernels as K
from cairn.functions.crs import transform_xy
from cairn.functions.geometry import RINGS, bounds, box_rings, checked, polygon_area, usable
from cairn.plans.gridjoin import box_pairs
from cairn.plans.ranks import numbered
from cairn.plans.storage import discard, materialise

Parts = list[tuple[str, list[np.ndarray]]]
QUARTERINGS = 24  # levels below the first grid that a cell may be quartered


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


RINGS_ARROW = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])))


def read_rings(column: pa.Array) -> list[list[np.ndarray]]:
    """The rings of each row as arrays of points; null has none. The points are read from Arrow's buffers all at once."""
    rings = column.flatten()
    points = rings.flatten()
    at = np.column_stack([points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)]).astype(float)
    held = np.where(rings.is_null(), 0, rings.value_lengths().fill_null(0)).astype(np.int64)
    parts = np.split(at, np.cumsum(held)[:-1]) if len(held) else []
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [parts[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def write_rings(shapes: list[list[np.ndarray]]) -> pa.Array:
    """What ``read_rings`` reads, with z 0."""
    rings = [ring for shape in shapes for ring in shape]
    at = np.concatenate([np.zeros((0, 2)), *(np.asarray(r, float).reshape(-1, 2) for r in rings)])
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (at[:, 0], at[:, 1], np.zeros(len(at)))], fields=list(RINGS_ARROW.value_type.value_type))
    offsets = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    return pa.ListArray.from_arrays(offsets(map(len, shapes)), pa.ListArray.from_arrays(offsets(map(len, rings)), points, type=RINGS_ARROW.value_type), type=RINGS_ARROW)


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def map_geometries(fx: DataFrame, kernel: Callable[..., Parts], *others: str, drop: tuple[str, ...] = (), at_once: Callable[..., list[Parts | None]] | None = None) -> DataFrame:
    """Replace each row by one row for each part that the kernel makes of (geom_type, rings, ``others`` ...): types as strings, rings as arrays.

    ``at_once`` gets these as lists of a batch first, and leaves rows to the kernel by a null.
    """
    at = [fx.columns.index(c) for c in ("geom_type", "rings", *others)]
    kept = [i for i, c in enumerate(fx.columns) if c not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, shapes = [], [], []
            read = lambda c: c.to_pylist() if pa.types.is_string(c.type) else read_rings(c)
            columns = [read(batch.column(c)) for c in at]
            made = at_once(*columns) if at_once else [None] * batch.num_rows
            for i, (known, kind, *values) in enumerate(zip(made, *columns, strict=True)):
                for k, rings in kernel(kind, *values) if known is None else known:
                    rows.append(i)
                    kinds.append(k)
                    shapes.append(rings)
            of = pa.array(rows, pa.int64())
            new = {at[0]: pa.array(kinds, pa.string()), at[1]: write_rings(shapes)}
            # never the old rings: a geometry that falls into thousands of parts would be copied as often
            yield pa.RecordBatch.from_arrays([new[i] if i in new else batch.column(i).take(of) for i in kept], names=[batch.schema.names[i] for i in kept])

    return fx.mapInArrow(run, schema_of(fx.drop(*drop)))


def dealt(fx: DataFrame) -> DataFrame:
    """The rows dealt out evenly over all shuffle partitions, for kernels that take long for few bytes: a small file is one task else."""
    return fx.repartition(shuffle_partitions(fx))


def _usable(fx: DataFrame) -> DataFrame:
    return fx.filter(usable(F.col("geom_type"), F.col("rings"))).withColumn("rings", checked(F.col("rings")))


def explode_parts(fx: DataFrame) -> DataFrame:
    """One row for each part of a multi-part geometry, with ``part``. Input: geom_type Multi..., ``parts`` (array of rings) for them.

    Geometry collections are dropped; single geometries pass with part 0.
    """
    single = F.regexp_replace("geom_type", "^Multi", "")
    whole = fx.filter("geom_type <> 'GeometryCollection'").withColumn("parts", F.when(F.col("geom_type").startswith("Multi"), F.col("parts")).otherwise(F.array("rings")))
    other = [c for c in fx.columns if c not in ("geom_type", "rings", "parts")]
    return whole.select(*other, single.alias("geom_type"), F.posexplode("parts").alias("part", "rings"))


def to_geometry_checks(fx: DataFrame) -> DataFrame:
    """Features with ``usable`` and the rings as a geometry would be built from them."""
    return fx.withColumns({"usable": usable(F.col("geom_type"), F.col("rings")), "rings": checked(F.col("rings"))})


def vector_simplify(fx: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on lines and rings; points pass, polygons whose outer ring falls below four points are dropped."""
    _need(tolerance >= 0, "tolerance must not be negative")

    def kernel(kind: str, rings: list[np.ndarray]) -> Parts:
        if kind == "Point":
            return [(kind, rings)]
        out = [K.simplify(r, tolerance) for r in rings]
        if kind == "Polygon":
            if len(out[0]) < 4:
                return []
            out = [out[0], *(r for r in out[1:] if len(r) >= 4)]
        return [(kind, out)] if len(out[0]) >= 2 else []

    return map_geometries(dealt(_usable(fx)), kernel)


def point_buffers(fx: DataFrame, distance: float, quad_segs: int = 8) -> DataFrame:
    """Circles around points, made of built-in functions alone."""
    step = math.pi / (2 * quad_segs)
    point = F.col("rings")[0][0]
    corner = lambda k: F.struct((point["x"] + distance * F.cos(k * step)).alias("x"), (point["y"] + distance * F.sin(k * step)).alias("y"), F.lit(0.0).alias("z"))
    ring = F.transform(F.concat(F.sequence(F.lit(0), F.lit(4 * quad_segs - 1)), F.array(F.lit(0))), corner)
    return fx.filter(F.col("geom_type") == "Point").withColumns({"rings": F.array(ring), "geom_type": F.lit("Polygon")}).select(fx.columns)


def vector_buffer(fx: DataFrame, distance: float = 10.0, quad_segs: int = 8) -> DataFrame:
    """Everything within ``distance`` of each feature, as polygons; several where it falls apart, none where nothing is left."""
    solid = _usable(fx)

    def at_once(kinds: list[str], shapes: list[list[np.ndarray]]) -> list[Parts | None]:
        found = K.buffers([rings if kind == "Polygon" else [] for kind, rings in zip(kinds, shapes, strict=True)], distance, quad_segs)
        return [None if p is None else [("Polygon", p)] for p in found]

    others = map_geometries(dealt(solid.filter("geom_type <> 'Point'")), lambda kind, rings: [("Polygon", p) for p in K.buffer(kind, rings, distance, quad_segs)], at_once=at_once)
    return point_buffers(solid, distance, quad_segs).unionByName(others) if distance > 0 else others


def repair_polygons(fx: DataFrame) -> DataFrame:
    """Invalid polygons rebuilt by the even-odd rule, one row a part; what cannot be rebuilt, and anything valid, stays."""

    def kernel(kind: str, rings: list[np.ndarray]) -> Parts:
        if kind != "Polygon" or not rings or len(rings[0]) < 4 or K.invalid_reason(kind, rings) is None:
            return [(kind, rings)]
        closed = [r if (r[0] == r[-1]).all() else np.concatenate([r, r[:1]]) for r in rings]
        parts = K.buffer(kind, closed, 0.0)
        good = [p for p in parts if K.invalid_reason("Polygon", p) is None]
        return [("Polygon", p) for p in parts] if parts and len(good) == len(parts) else [(kind, rings)]

    return map_geometries(dealt(fx), kernel)


def filter_small_polygons(fx: DataFrame, min_area: float = 100.0) -> DataFrame:
    """Polygons of at least ``min_area``; others than polygons stay, unusable polygons go; 0 or less keeps all as it is."""
    if min_area <= 0:
        return fx
    return fx.filter((F.col("geom_type") != "Polygon") | (usable(F.col("geom_type"), F.col("rings")) & (polygon_area(F.col("rings")) >= min_area)))


def add_polygon_attributes(fx: DataFrame, meta: DataFrame, class_id: int = 1, source: str = "segmentation") -> DataFrame:
    """class_id, feature_id (0-based by lower edge, then left edge, within the raster), area, area_px and source.

    Input rows carry raster_id; a raster's features are numbered over many tasks.
    """
    sized = fx.withColumns({"_b": bounds(F.col("rings")), "area": polygon_area(F.col("rings"))})
    ranked = numbered(sized.withColumns({"_y": F.col("_b.min_y"), "_x": F.col("_b.min_x")}), ["raster_id"], ["_y", "_x", "fid"], "feature_id")
    pixel = meta.select("raster_id", F.abs(F.col("gt")[1] * F.col("gt")[5]).alias("_p"))
    return ranked.join(pixel, "raster_id").withColumns({"class_id": F.lit(class_id), "area_px": F.col("area") / F.col("_p"), "source": F.lit(source)}).drop("_b", "_y", "_x", "_p")


# ---------------------------------------------------------------- coordinates


def transform_coords(df: DataFrame, source: str, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """Coordinates in columns x and y (longitude, latitude order) in another system; unknown systems raise."""
    moved = df.withColumn("_at", transform_xy(F.col(x), F.col(y), source, target))
    return moved.withColumns({x: F.col("_at.x"), y: F.col("_at.y")}).drop("_at")


transform_points = transform_coords


def transform_vector(fx: DataFrame, source: str, target: str) -> DataFrame:
    """Every coordinate of every ring in another system; z and attributes stay."""

    def moved(p: Column) -> Column:
        at = transform_xy(p["x"], p["y"], source, target)
        return F.struct(at["x"].alias("x"), at["y"].alias("y"), p["z"].alias("z"))

    return fx.withColumn("rings", F.transform("rings", lambda r: F.transform(r, moved)))


# ---------------------------------------------------------------- joins


def boxes_of(fx: DataFrame, key: str = "fid") -> DataFrame:
    b = bounds(F.col("rings"))
    return fx.select(F.col(key).alias("id"), b["min_x"].alias("min_x"), b["min_y"].alias("min_y"), b["max_x"].alias("max_x"), b["max_y"].alias("max_y"))


def paired(a: DataFrame, b: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """a's columns with b_fid, b_type and b_rings for every pair whose boxes meet.

    Pairs are dealt out evenly over all shuffle partitions: the kernels that follow take long for few bytes, which adaptive
    coalescing would put into few tasks.
    """
    pairs = box_pairs(boxes_of(a), boxes_of(b)) if pairs is None else pairs
    right = b.select(F.col("fid").alias("b_id"), F.col("geom_type").alias("b_type"), F.col("rings").alias("b_rings"))
    met = a.join(pairs, a["fid"] == pairs["a_id"]).drop("a_id").join(right, "b_id").withColumnRenamed("b_id", "b_fid")
    return dealt(met)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_by(kind: str, rings: list[np.ndarray], polygon: list[np.ndarray]) -> Parts:
    """Parts of a geometry inside a polygon that have its own dimension."""
    if kind == "Point":
        return [(kind, rings)] if K.inside(rings[0][:1], [polygon])[0] else []
    if kind == "LineString":
        return [(kind, [line]) for line in K.clip_line(rings[0], [polygon])]
    return [(kind, p) for p in K.intersection([rings], [polygon])]


def common(kind: str, rings: list[np.ndarray], other: str, b_rings: list[np.ndarray]) -> Parts:
    """What two geometries have in common: polygons if they share area, else lines if they share any length, else points."""
    if "Point" in (kind, other):
        at, target, of = (rings, other, b_rings) if kind == "Point" else (b_rings, kind, rings)
        met = K.inside(at[0][:1], [of])[0] if target == "Polygon" else False
        return [("Point", [at[0][:1]])] if met or K.on_outline(at[0][0], of) else []
    if kind == other == "Polygon":
        found: Parts = [("Polygon", p) for p in K.intersection([rings], [b_rings])]
    elif "Polygon" in (kind, other):
        line, polygon = (rings[0], b_rings) if kind == "LineString" else (b_rings[0], rings)
        found = [("LineString", [x]) for x in K.clip_line(line, [polygon], closed=True)]
    else:
        found = []
    if found:
        return found
    lines, points = K.touches(rings, b_rings)
    return [("LineString", [x]) for x in lines] or [("Point", [x[None, :]]) for x in points]


def vector_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The intersection of every pair of features that meet, one row a part, with the attributes of a and b_fid.

    Points, lines and polygons may meet in any combination. A pair gives the parts of the highest dimension it has: where two
    polygons share area, a side that they only touch elsewhere is no row of its own; where they share none, the stretches of
    outline in common are rows of lines, and where they share no length either, the points are.
    """
    return map_geometries(paired(_usable(a), _usable(b)), common, "b_type", "b_rings", drop=("b_rings", "b_type"))


def _inside_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """The parts of a's features inside each polygon of b, of their own dimension only."""
    return map_geometries(paired(_usable(a), _usable(b).filter("geom_type = 'Polygon'")), lambda kind, rings, polygon: cut_by(kind, rings, polygon), "b_rings", drop=("b_rings", "b_type"))


def semi_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features of a that meet some feature of b, if only in a point."""
    return a.join(vector_intersect(a, b).select("fid").distinct(), "fid", "left_semi").select(a.columns)


def intersects_any(a: DataFrame, b: DataFrame) -> bool:
    return not vector_intersect(a, b).isEmpty()


CELL = ("level", "cx", "cy")
PIECES = f"level int, cx long, cy long, rings {RINGS}"


def _into_cells(side: Callable[[int], float], deeper: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (level, cx, cy, rings) cut at the borders of the cells ``deeper`` levels down, some thousand pieces at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(held: list[tuple[int, int, int, list[np.ndarray]]]) -> pa.RecordBatch:
            level, cx, cy, shapes = zip(*held, strict=True) if held else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), write_rings(list(shapes))], names=[*CELL, "rings"])

        for batch in batches:
            held, points = [], 0
            for level, rings in zip(batch.column(0).to_pylist(), read_rings(batch.column(3)), strict=True):
                for cx, cy, piece in K.into_cells(rings, side(level + deeper)):
                    held.append((level + deeper, cx, cy, piece))
                    points += sum(map(len, piece))
                    if points > 1 << 18:
                        yield batch_of(held)
                        held, points = [], 0
            yield batch_of(held)

    return run


def _first_level(boxed: DataFrame, side: Callable[[int], float], least: int, most: float) -> int:
    """The deepest level, ``least`` or below, whose cells with something in them are at most about ``most`` and on which the boxes that are larger
    than a cell cover no more cells than that.

    Where polygons lie along a line or in a few places, most cells of a square grid are empty, and the others would be quartered
    round by round. The numbers of cells are estimates; they only say where a search begins.
    """
    levels = range(least + 1, least + 13)  # four to the twelfth empty cells for each in use; what is left is quartered

    def at(c: str, level: int) -> Column:
        return F.floor(F.col(f"b.{c}") / side(level))

    def spread(level: int) -> Column:
        across, down = (at(f"max_{c}", level) - at(f"min_{c}", level) + 1 for c in "xy")
        return F.sum(F.when((across > 2) | (down > 2), across.cast("double") * down).otherwise(0.0))

    found = boxed.select("b").agg(*(f for k in levels for f in (F.approx_count_distinct(F.struct(at("min_x", k), at("min_y", k))), spread(k)))).first()
    for k, cells, covered in zip(levels, found[::2], found[1::2], strict=True):
        if cells > most or covered > most:
            return k - 1
    return levels[-1]


def dissolve(fx: DataFrame, cell: float | None = None, crowd: int = 256) -> DataFrame:
    """level, cx, cy, part, rings: the union of all polygons in pieces that end at the borders of square cells.

    Polygons are cut at the cells they cover and each cell is united on its own, so nothing is gathered beyond a cell.
    Without ``cell`` the cells are the leaves of a tree: from a grid with about as many cells in use as there are groups of ``crowd`` polygons, a
    cell with more than ``crowd`` different pieces is quartered, on its own, as long as that thins it out. So cells are small where
    polygons crowd, and a polygon as large as all others together is cut into no more pieces than there are cells. What still crowds
    a cell is united as a tree of bounded groups. Equal pieces are united before they meet.
    """
    solid = _usable(fx).filter("geom_type = 'Polygon'")
    b = bounds(F.col("rings"))
    boxed = solid.select("rings", b.alias("b"))
    if cell is None:
        n, wide = boxed.agg(F.count("*"), F.greatest(F.max("b.max_x") - F.min("b.min_x"), F.max("b.max_y") - F.min("b.min_y"))).first()
        start = max(0, math.floor(math.log(max(n, 1) / crowd, 4))) if n > crowd else 0
        largest = 2.0 ** math.ceil(math.log2(wide or 1.0))
        side = lambda level: largest / 2**level
        if n > crowd:
            start = _first_level(boxed, side, start, 2 * n / crowd)
    else:
        start, side = 0, lambda level: float(cell)
    first = solid.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"), "rings")
    now = materialise(dealt(first).mapInArrow(_into_cells(side, start), PIECES).distinct())
    leaves, deeper = [], 0
    while cell is None:
        sizes = materialise(now.groupBy(*CELL).agg(F.count("*").alias("n")))
        full = sizes.filter(F.col("n") > crowd)
        if deeper == QUARTERINGS or full.isEmpty():
            break
        kids = materialise(now.join(full.drop("n").hint("merge"), [*CELL], "left_semi").select(now.columns).mapInArrow(_into_cells(side, 1), PIECES).distinct())
        parent = [(F.col("level") - 1).alias("level"), *(F.floor(F.col(c) / 2).cast("long").alias(c) for c in CELL[1:])]
        made = kids.groupBy(*parent).agg(F.count("*").alias("m"))
        thin = materialise(full.join(made, [*CELL]).filter(F.col("m") <= 2.5 * F.col("n")).select(*CELL))  # of what lies over a cell, each quarter holds all
        leaves.append(now.join(thin.hint("merge"), [*CELL], "left_anti"))
        up = kids.withColumns({"_l": parent[0], "_x": parent[1], "_y": parent[2]})
        now = up.join(thin.select(*(F.col(c).alias(n) for c, n in zip(CELL, ("_l", "_x", "_y"), strict=True))).hint("merge"), ["_l", "_x", "_y"], "left_semi").select(*CELL, "rings")
        deeper += 1
    pieces = now
    for table in leaves:
        pieces = pieces.unionByName(table.select(*CELL, "rings"))

    def unite(key, table):
        parts = K.union(read_rings(table["rings"].combine_chunks()))
        heads = [pa.array([k.as_py()] * len(parts), t) for k, t in zip(key[:3], (pa.int32(), pa.int64(), pa.int64()), strict=True)]
        return pa.table([*heads, pa.array(range(len(parts)), pa.int32()), write_rings(parts)], names=[*CELL, "part", "rings"])

    united = f"level int, cx long, cy long, part int, rings {RINGS}"
    # what still crowds a cell is united in groups of at most about ``crowd``, round by round, while that leaves fewer pieces
    last, pieces = None, materialise(pieces)
    while True:
        sizes = pieces.groupBy(*CELL).agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
        total, most = sizes.agg(F.sum("n"), F.max("n")).first()
        if not most:
            break
        full = pieces.join(sizes, [*CELL]).withColumn("salt", F.pmod(F.xxhash64("rings"), F.ceil(F.col("n") / crowd)).cast("int"))
        joined = full.repartition(shuffle_partitions(fx), *CELL, "salt").groupBy(*CELL, "salt").applyInArrow(unite, united).drop("part")
        rest = pieces.join(sizes.select(*CELL), [*CELL], "left_anti")
        before, pieces = pieces, materialise(rest.unionByName(joined).distinct())
        discard(before)
        if total > 0.8 * (last or math.inf):  # what lies apart is not thinned out by uniting it
            break
        last = total
    return pieces.repartition(shuffle_partitions(fx), *CELL).groupBy(*CELL).applyInArrow(unite, united)


def union_area(fx: DataFrame) -> DataFrame:
    """One row: area of the union of all polygons."""
    return dissolve(fx).agg(F.coalesce(F.sum(polygon_area(F.col("rings"))), F.lit(0.0)).alias("area"))


def vector_clip(target: DataFrame, clipper: DataFrame, overlapping: bool = True) -> DataFrame:
    """Parts of each target inside the clippers taken together, with the target's attributes.

    Parts have the target's own dimension: a side or corner that it only touches is none. Clippers that may overlap are dissolved first, so that no ground counts twice; parts then also end at the dissolve's cell
    borders. With ``overlapping=False`` the clippers are known to be disjoint and are used as they are.
    """
    if overlapping:
        pieces = materialise(dissolve(clipper))  # its boxes and its rings are read apart
        clipper = pieces.select(F.xxhash64(*CELL, "part").alias("fid"), F.lit("Polygon").alias("geom_type"), "rings")
    return _inside_of(target, clipper).drop("b_fid")


def clip_to_extent(fx: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    """Parts of each feature inside (min_x, min_y, max_x, max_y). No join; features that the box misses never reach a kernel."""
    x0, y0, x1, y1 = map(float, extent)
    _need(x0 < x1 and y0 < y1, "the extent is empty")
    b = bounds(F.col("rings"))
    near = _usable(fx).filter((b["min_x"] <= x1) & (b["max_x"] >= x0) & (b["min_y"] <= y1) & (b["max_y"] >= y0))
    frame = [K.box(x0, y0, x1, y1)]
    return map_geometries(dealt(near), lambda kind, rings: cut_by(kind, rings, frame))


def boxes(df: DataFrame, fid: Column, x0: Column, y0: Column, x1: Column, y1: Column, layer: str = "boxes", *extra: str) -> DataFrame:
    """Rectangular features from columns."""
    return df.select(F.lit(layer).alias("layer"), fid.cast("long").alias("fid"), F.lit("Polygon").alias("geom_type"), box_rings(x0, y0, x1, y1).alias("rings"), *extra)
