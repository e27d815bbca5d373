"""From class masks to polygons: components over runs of pixels, and their rings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.affine import pixel_to_geo
from cairn.functions.arrangement import Arrangement, outline, turned
from cairn.functions.geometry import point_in_ring, ring_area
from cairn.operators.vector import boxes_of, write_rings
from cairn.plans.components import connected_components
from cairn.plans.gridjoin import box_pairs
from cairn.plans.groups import spread_groups
from cairn.plans.storage import materialise

RINGS = "array<array<struct<x:double,y:double,z:double>>>"
EAST, WEST, NORTH, SOUTH = range(4)
HELD = 1 << 20  # pixels or points that are sent as one batch, beyond those of a single block


def _batch(rows: list[tuple], kinds: tuple[pa.DataType, ...], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def mask_runs(mask: DataFrame, target: int = 1) -> DataFrame:
    """raster_id, run, y, x0, x1: maximal horizontal runs of the class. A window holds one row of an image."""
    rows = mask.filter(F.col("v") == target).select("raster_id", "x", "y")
    island = F.col("x") - F.row_number().over(Window.partitionBy("raster_id", "y").orderBy("x"))
    runs = rows.withColumn("_i", island).groupBy("raster_id", "y", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return runs.select("raster_id", F.xxhash64("raster_id", "y", "x0").alias("run"), "y", "x0", "x1")


def label_components(mask: DataFrame, target: int = 1) -> DataFrame:
    """Runs with their component (8-neighbour connectivity): raster_id, component, run, y, x0, x1."""
    runs = materialise(mask_runs(mask, target))
    above = runs.select("raster_id", (F.col("y") + 1).alias("y"), F.col("run").alias("other"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    touching = runs.join(above, ["raster_id", "y"]).filter((F.col("x0") <= F.col("a1") + 1) & (F.col("x1") + 1 >= F.col("a0")))
    labels = connected_components(touching.select("run", "other"), "run", "other").withColumnRenamed("node", "run")
    return runs.join(labels, "run", "left").select("raster_id", F.coalesce("component", "run").alias("component"), "run", "y", "x0", "x1")


def _set_runs(values: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, first x, last x) of the runs of the class in a block."""
    step = np.diff(np.pad(values == target, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (y, x0), (_, stop) = np.nonzero(step == 1), np.nonzero(step == -1)
    return y, x0, stop - 1


def _own_labels(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, corners: bool) -> np.ndarray:
    """Numbers from 0 of what the runs of a block belong to within it."""
    return np.unique(_parts(y, x0, x1, int(corners)), return_inverse=True)[1].ravel() if len(y) else np.zeros(0, np.int64)


def _labelled_runs(chunks: DataFrame, target: int, corners: bool) -> DataFrame:
    """raster_id, cx, cy, size, y, x0, x1, label of the runs of each block, labelled on its own; written."""
    names = ["raster_id", "cx", "cy", "size", "k", "y", "x0", "x1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raster, cx, cy, w, h, size = (batch.column(c)[i].as_py() for c in range(6))
                y, x0, x1 = _set_runs(batch.column(6)[i].values.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(h, w), target)
                if len(y):
                    heads = [pa.array([v] * len(y), t) for v, t in ((raster, pa.string()), (cx, pa.int32()), (cy, pa.int32()), (size, pa.int32()))]
                    k = _own_labels(y, x0, x1, corners).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*heads, pa.array(k), *(pa.array(v.astype(np.int64)) for v in (y + cy * size, x0 + cx * size, x1 + cx * size))], names=names)

    found = chunks.select("raster_id", "cx", "cy", "w", "h", "size", F.col("data").cast("array<double>")).mapInArrow(run, "raster_id string, cx int, cy int, size int, k long, y long, x0 long, x1 long")
    return materialise(found.withColumn("label", F.xxhash64("raster_id", "cx", "cy", "k")).drop("k"))


def _over_seams(runs: DataFrame, corners: bool) -> DataFrame:
    """label, component of the labels that meet others across a seam, with ``corners`` also across the corner where blocks meet."""
    size, first, last = F.col("size"), F.col("x0") % F.col("size") == 0, F.col("x1") % F.col("size") == F.col("size") - 1
    reach = int(corners)
    beside = F.array_compact(F.array(F.col("cx"), *([F.when(first, F.col("cx") - 1), F.when(last, F.col("cx") + 1)] if corners else [])))
    low = runs.filter(F.col("y") % size == size - 1).select("raster_id", (F.col("y") + 1).alias("y"), F.explode(beside).alias("cx"), "label", "x0", "x1")
    high = runs.filter(F.col("y") % size == 0).select("raster_id", "y", "cx", F.col("label").alias("other"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    down = low.join(high, ["raster_id", "y", "cx"]).filter((F.col("x0") <= F.col("a1") + reach) & (F.col("x1") + reach >= F.col("a0")))
    near = F.explode(F.array(*(F.struct((F.col("y") + d).alias("y"), F.expr(f"(y + {d}) div size = cy").alias("same")) for d in range(-reach, reach + 1)))).alias("s")
    right = runs.filter(last).select("raster_id", (F.col("cx") + 1).alias("cx"), "cy", "label", near).filter("s.same").select("raster_id", "cx", "cy", F.col("s.y").alias("y"), "label")
    left = runs.filter(first).select("raster_id", "cx", "cy", "y", F.col("label").alias("other"))
    seams = down.select("label", "other").unionByName(right.join(left, ["raster_id", "cx", "cy", "y"]).select("label", "other")).distinct()
    return connected_components(seams, "label", "other").withColumnRenamed("node", "label")


def label_blocks(chunks: DataFrame, target: int = 1, corners: bool = True) -> DataFrame:
    """``label_components`` of a mask in blocks: raster_id, component, run, y, x0, x1, runs ending at the blocks' borders.

    Blocks are labelled on their own; only labels that meet across a seam are nodes of the graph of components. Without
    ``corners`` pixels hang together by their sides only.
    """
    runs = _labelled_runs(chunks, target, corners)
    return runs.join(_over_seams(runs, corners), "label", "left").select("raster_id", F.coalesce("component", "label").alias("component"), F.xxhash64("raster_id", "y", "x0").alias("run"), "y", "x0", "x1")


# ---------------------------------------------------------------- rings over many blocks


def _with_halo(chunks: DataFrame, target: int) -> DataFrame:
    """raster_id, cx, cy, size, w, h, data: each block as bytes, a pixel wider on each side: 1 where the class is, also just beyond its borders."""
    names = ["raster_id", "cx", "cy", "size", "w", "h", "side", "data"]
    kinds = (pa.string(), *[pa.int32()] * 6, pa.binary())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                raster, cx, cy, w, h, size = (batch.column(c)[i].as_py() for c in range(6))
                here = (batch.column(6)[i].values.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(h, w) == target).astype(np.uint8)
                rows.append((raster, cx, cy, size, w, h, -1, here.tobytes()))
                for side, dx, dy, edge in ((WEST, 1, 0, here[:, -1]), (EAST, -1, 0, here[:, 0]), (NORTH, 0, 1, here[-1]), (SOUTH, 0, -1, here[0])):
                    rows.append((raster, cx + dx, cy + dy, size, w, h, side, edge.tobytes()))  # the border that the neighbour has on that side
                held += here.size
                if held > HELD:
                    yield _batch(rows, kinds, names)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, kinds, names)

    def meet(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        sides = dict(zip(held["side"].to_pylist(), range(held.num_rows), strict=True))
        if -1 not in sides:  # a border without a block beyond it
            return held.slice(0, 0)
        at = sides[-1]
        w, h = held["w"][at].as_py(), held["h"][at].as_py()
        grid = np.zeros((h + 2, w + 2), np.uint8)
        grid[1:-1, 1:-1] = np.frombuffer(held["data"][at].as_py(), np.uint8).reshape(h, w)
        for side, spot in ((WEST, (slice(1, -1), 0)), (EAST, (slice(1, -1), -1)), (NORTH, (0, slice(1, -1))), (SOUTH, (-1, slice(1, -1)))):
            if side in sides:
                grid[spot] = np.frombuffer(held["data"][sides[side]].as_py(), np.uint8)
        return held.slice(at, 1).set_column(7, "data", pa.array([grid.tobytes()], pa.binary()))

    schema = "raster_id string, cx int, cy int, size int, w int, h int, side int, data binary"
    parts = chunks.select("raster_id", "cx", "cy", "w", "h", "size", F.col("data").cast("array<double>")).mapInArrow(send, schema)
    return spread_groups(parts, "raster_id", "cx", "cy").applyInArrow(meet, schema).drop("side")


def block_chains(grid: np.ndarray, left: int, top: int, joined: bool) -> Iterator[tuple[tuple[int, int, int], tuple[int, int, int] | None, np.ndarray, np.ndarray]]:
    """Pieces of the outline within one block: ((x, y, direction) it starts with, (x, y, direction) it ends with, corners, pixels).

    A piece goes on until it reaches the block's border lines, where the next one may be another block's; one that closes
    before has no end. Corners are where it turns; pixels those along its right side, first and last of each straight part.
    """
    here = grid[1:-1, 1:-1] == 1
    h, w = here.shape
    # sides of set pixels with nothing beyond, the class on the right as y points down: start, end, pixel, direction
    beyond = {EAST: grid[:-2, 1:-1], SOUTH: grid[1:-1, 2:], WEST: grid[2:, 1:-1], NORTH: grid[1:-1, :-2]}
    steps = {EAST: (0, 0, 1, 0), SOUTH: (1, 0, 1, 1), WEST: (1, 1, 0, 1), NORTH: (0, 1, 0, 0)}
    found = []
    for kind, other in beyond.items():
        y, x = np.nonzero(here & (other == 0))
        ax, ay, bx, by = steps[kind]
        found.append(np.column_stack([x + ax, y + ay, x + bx, y + by, x, y, np.full(len(x), kind)]))
    edges = np.concatenate(found)
    start, end = edges[:, 1] * (w + 1) + edges[:, 0], edges[:, 3] * (w + 1) + edges[:, 2]
    leaving = np.full(((w + 1) * (h + 1), 4), -1)
    leaving[start, edges[:, 6]] = np.arange(len(edges))
    turn = np.array([NORTH, SOUTH, WEST, EAST] if joined else [SOUTH, NORTH, EAST, WEST])[edges[:, 6]]
    several = (leaving >= 0).sum(1) > 1
    follow = np.where(several[end], leaving[end, turn], leaving[end].max(1))
    border = (edges[:, 2] == 0) | (edges[:, 2] == w) | (edges[:, 3] == 0) | (edges[:, 3] == h)
    follow[border] = -1
    step, free = follow.tolist(), bytearray(b"\1") * len(edges)
    headless = np.setdiff1d(np.arange(len(edges)), follow[follow >= 0])
    for k in [*headless.tolist(), *range(len(edges))]:
        chain, at = [], k
        while at >= 0 and free[at]:
            free[at] = 0
            chain.append(at)
            at = step[at]
        if chain:
            e = edges[chain]
            turns = np.flatnonzero(np.append(True, e[1:, 6] != e[:-1, 6]))
            last = np.append(turns[1:], len(e)) - 1
            corners = e[turns, :2] + (left, top)
            pixels = np.stack([e[turns, 4:6], e[last, 4:6]], axis=1).reshape(-1, 2) + (left, top)
            begin, stop = e[0], e[-1]
            ends = None if at >= 0 else (int(stop[2]) + left, int(stop[3]) + top, int(stop[6]))
            yield (int(begin[0]) + left, int(begin[1]) + top, int(begin[6])), ends, corners, pixels


def block_polygons(chunks: DataFrame, meta: DataFrame, target: int = 1, mode: str = "centre") -> DataFrame:
    """The polygons of ``mask_to_polygons`` for a mask in blocks, components of any extent: raster_id, component, part, rings.

    Each block traces the outline inside it. Pieces that end at a seam go on with the one that starts there; the pieces of a ring
    are ordered by doubling pointers, so that no task follows a ring, and only the corners of a ring, which is one value, come together.
    """
    if mode not in ("centre", "edge"):
        raise ValueError(f"unknown mode {mode}")
    joined = mode == "centre"
    runs = _labelled_runs(chunks, target, joined)
    labels = _over_seams(runs, joined)
    names = ["raster_id", "cx", "cy", "k", "sx", "sy", "start", "ex", "ey", "end", "points"]
    kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.binary())

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                raster, cx, cy, size, w, h, data = (batch.column(c)[i].as_py() for c in range(7))
                grid = np.frombuffer(data, np.uint8).reshape(h + 2, w + 2)
                y, x0, x1 = _set_runs(grid[1:-1, 1:-1], 1)
                number = np.full((h, w), -1)
                for a, b, c, k in zip(y.tolist(), x0.tolist(), (x1 + 1).tolist(), _own_labels(y, x0, x1, joined).tolist(), strict=True):
                    number[a, b:c] = k
                for begin, stop, corners, pixels in block_chains(grid, cx * size, cy * size, joined):
                    px, py = pixels[0]
                    points = pixels if joined else corners
                    rows.append((raster, cx, cy, int(number[py - cy * size, px - cx * size]), *begin, *(stop or (None,) * 3), np.ascontiguousarray(points, np.int64).tobytes()))
                    held += len(points)
                if held > HELD:
                    yield _batch(rows, kinds, names)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, kinds, names)

    found = _with_halo(chunks, target).mapInArrow(trace, "raster_id string, cx int, cy int, k long, sx long, sy long, start long, ex long, ey long, end long, points binary")
    chain = F.xxhash64("raster_id", "sx", "sy", "start")  # no two pieces start at one corner in one direction
    pieces = materialise(found.select(chain.alias("chain"), "raster_id", F.xxhash64("raster_id", "cx", "cy", "k").alias("label"), "sx", "sy", "start", "ex", "ey", "end", "points"))
    # where two pieces start at the corner, the outline passes on at it or not, as within a block
    starts = pieces.groupBy("raster_id", F.col("sx").alias("ex"), F.col("sy").alias("ey")).agg(F.map_from_entries(F.collect_list(F.struct("start", "chain"))).alias("ways"))
    turns = F.array(*(F.lit(int(t)).cast("long") for t in ((NORTH, SOUTH, WEST, EAST) if joined else (SOUTH, NORTH, EAST, WEST))))
    way = F.when(F.size("ways") > 1, F.element_at("ways", F.element_at(turns, (F.col("end") + 1).cast("int")))).otherwise(F.map_values("ways")[0])
    links = materialise(pieces.filter("end IS NOT NULL").join(starts, ["raster_id", "ex", "ey"]).select("chain", way.alias("next")))
    rings = connected_components(links, "chain", "next").select(F.col("node").alias("chain"), F.col("component").alias("ring"))
    placed = materialise(pieces.select("chain").join(rings, "chain", "left").select("chain", F.coalesce("ring", "chain").alias("ring")))
    order = _places_in_rings(links.join(placed, "chain"))
    whole = pieces.join(placed, "chain").join(order, "chain", "left").join(labels, "label", "left")
    whole = whole.select("raster_id", "ring", F.coalesce("component", "label").alias("component"), F.coalesce("rank", F.lit(0)).alias("rank"), "points")

    def close(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        held = held.sort_by("rank")
        points = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in held["points"].to_pylist()])
        ring = _bends(points)
        hole = signed_area(np.concatenate([points, points[:1]])) < 0
        good = len(ring) >= 4 and (signed_area(ring) < 0) == hole and signed_area(ring) != 0
        shape = [[ring.astype(float)]] if good else [[]]
        return pa.table([held["raster_id"].slice(0, 1), held["component"].slice(0, 1), pa.array([bool(hole)]), write_rings(shape)], names=["raster_id", "component", "hole", "rings"])

    closed = spread_groups(whole, "ring").applyInArrow(close, f"raster_id string, component long, hole boolean, rings {RINGS}").filter("size(rings) > 0")
    parts = closed.groupBy("raster_id", "component").agg(F.array_sort(F.collect_list(F.struct("hole", F.col("rings")[0].alias("ring")))).alias("all"))
    pixel = parts.filter(~F.col("all")[0]["hole"]).select("raster_id", "component", F.lit(0).alias("part"), F.transform("all", lambda x: x["ring"]).alias("rings"))
    return _grounded(pixel, meta)


def _places_in_rings(links: DataFrame) -> DataFrame:
    """chain, rank of each link (chain, next, ring): its place in its ring, from the smallest chain on, by doubling pointers."""
    # towards the head: each knows one before it and how far that is
    now = materialise(links.filter(F.col("next") != F.col("ring")).select(F.col("next").alias("chain"), F.col("chain").alias("back"), F.lit(1).cast("long").alias("far"), "ring"))
    done = None
    while True:
        there = now.filter(F.col("back") == F.col("ring")).select("chain", F.col("far").alias("rank"))
        done = there if done is None else done.unionByName(there)
        going = now.filter(F.col("back") != F.col("ring"))
        if going.isEmpty():
            return done
        ahead = now.select(F.col("chain").alias("back"), F.col("back").alias("_b"), F.col("far").alias("_f"))
        passed = done.select(F.col("chain").alias("back"), F.col("rank").alias("_r"))
        step = going.join(ahead.hint("merge"), "back", "left").join(passed.hint("merge"), "back", "left")
        now = materialise(step.select("chain", F.coalesce("_b", "ring").alias("back"), (F.col("far") + F.coalesce("_f", "_r")).alias("far"), "ring"))


def component_stats(labels: DataFrame) -> DataFrame:
    """Pixels and bounds of each component."""
    size = F.sum(F.col("x1") - F.col("x0") + 1)
    return labels.groupBy("raster_id", "component").agg(size.alias("pixels"), F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def boundary_edges(mask: DataFrame, target: int = 1) -> DataFrame:
    """Directed pixel sides between the class and anything else, the class on the right as y points down: raster_id, x0, y0, x1, y1.

    The signed area over all edges of a raster is its number of set pixels, without any polygon being built.
    """
    cells = mask.filter(F.col("v") == target).select("raster_id", "x", "y")
    x, y = F.col("x"), F.col("y")
    sides = [(x, y, x + 1, y, x, y - 1), (x + 1, y, x + 1, y + 1, x + 1, y), (x + 1, y + 1, x, y + 1, x, y + 1), (x, y + 1, x, y, x - 1, y)]
    names = ("x0", "y0", "x1", "y1", "nx", "ny")
    edges = cells.select("raster_id", F.explode(F.array(*(F.struct(*(c.cast("int").alias(n) for c, n in zip(s, names, strict=True))) for s in sides))).alias("e")).select("raster_id", "e.*")
    beside = cells.select("raster_id", x.alias("nx"), y.alias("ny"))
    return edges.join(beside, ["raster_id", "nx", "ny"], "left_anti").select("raster_id", *names[:4])


# ---------------------------------------------------------------- rings of one component


def signed_area(ring: np.ndarray) -> float:
    x, y = np.asarray(ring, float).T
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


class Outline:
    """The outline of a set of pixel runs as directed straight pieces, the pixels on the right as y points down.

    On the line between two rows of pixels, what one row covers and the other does not are the horizontal pieces; the ends of
    a run are the vertical ones. Work and memory follow the number of runs, never the extent.

    ``start``/``end``: corners of each piece; ``first``/``last``: the pixels along its right side; ``run``: a run beside it.
    """

    def __init__(self, y: np.ndarray, x0: np.ndarray, x1: np.ndarray):
        n, of = len(y), np.arange(len(y))
        line, at = np.concatenate([y, y, y + 1, y + 1]), np.concatenate([x0, x1 + 1] * 2)
        change = np.zeros((4 * n, 2), np.int64)  # of what the row below the line covers, and of what the row above it does
        change[:n, 0], change[n : 2 * n, 0], change[2 * n : 3 * n, 1], change[3 * n :, 1] = 1, -1, 1, -1
        order = np.lexsort((at, line))
        line, at, change, of = line[order], at[order], change[order], np.tile(of, 4)[order]
        head = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (at[1:] != at[:-1])))
        covered = np.cumsum(change, axis=0)[np.append(head[1:], len(at)) - 1]
        self.line, self.at = line[head], at[head]
        # the run that was opened last, below and above: where something is covered, it covers it
        corner = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
        holder = np.zeros((len(head), 2), np.int64)
        for side in (0, 1):
            opens = change[:, side] == 1
            opened = np.zeros(len(head), np.int64)
            opened[corner[opens]] = np.arange(len(of))[opens]
            holder[:, side] = of[np.maximum.accumulate(opened)]
        below, above = np.flatnonzero((covered == (1, 0)).all(1)), np.flatnonzero((covered == (0, 1)).all(1))
        here = self._corner(y, x0), self._corner(y + 1, x0), self._corner(y, x1 + 1), self._corner(y + 1, x1 + 1)
        pieces = [  # start, end, first and last pixel (x, y), run
            (below, below + 1, self.at[below], self.line[below], self.at[below + 1] - 1, self.line[below], holder[below, 0]),
            (above + 1, above, self.at[above + 1] - 1, self.line[above] - 1, self.at[above], self.line[above] - 1, holder[above, 1]),
            (here[1], here[0], x0, y, x0, y, np.arange(n)),
            (here[2], here[3], x1, y, x1, y, np.arange(n)),
        ]
        self.start, self.end, fx, fy, lx, ly, self.run = (np.concatenate(c) for c in zip(*pieces, strict=True))
        self.first, self.last = np.column_stack([fx, fy]), np.column_stack([lx, ly])
        self.kind = np.repeat((EAST, WEST, NORTH, SOUTH), [len(p[0]) for p in pieces])

    def _corner(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = min(self.at.min(), at.min())
        wide = int(max(self.at.max(), at.max()) - low) + 1
        return np.searchsorted((self.line - self.line.min()) * wide + self.at - low, (line - self.line.min()) * wide + at - low)

    def loops(self, joined: bool) -> list[np.ndarray]:
        """Closed sequences of pieces. Where two pixels meet at a corner only, ``joined`` says whether the outline passes from one to the other."""
        leaving = np.full((len(self.at), 4), -1)  # the pieces that leave a corner, by their direction
        leaving[self.start, self.kind] = np.arange(len(self.start))
        several = (leaving >= 0).sum(1) > 1
        turn = np.array([NORTH, SOUTH, WEST, EAST] if joined else [SOUTH, NORTH, EAST, WEST])[self.kind]
        follow = np.where(several[self.end], leaving[self.end, turn], leaving[self.end].max(1))
        step, free, out = follow.tolist(), bytearray(b"\1") * len(follow), []
        for k in range(len(step)):
            if free[k]:
                loop = []
                while free[k]:
                    free[k] = 0
                    loop.append(k)
                    k = step[k]
                out.append(np.array(loop))
        return out


def _bends(points: np.ndarray) -> np.ndarray:
    """A closed ring without repeated points and without those it passes straight on."""
    points = points[(points != np.roll(points, 1, axis=0)).any(1)]
    while len(points) > 2:
        ahead, back = np.roll(points, -1, axis=0) - points, points - np.roll(points, 1, axis=0)
        turns = (back[:, 0] * ahead[:, 1] != back[:, 1] * ahead[:, 0]) | ((back * ahead).sum(1) < 0)
        if turns.all():
            break
        points = points[turns]
    return np.concatenate([points, points[:1]])


def polygons_of(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, mode: str) -> list[list[np.ndarray]]:
    """Polygons (outer ring, holes) of the pixels of one component.

    ``edge``: along the sides of the pixels, so that the area is their number; rings touch at corners and never cross, and the
    parts of a component that hang together by corners only are polygons of their own. ``centre``: the same outline drawn
    through the middles of its pixels, passing on at such corners; where it encloses nothing, it is no polygon.
    """
    outline = Outline(y, x0, x1)
    rings: list[tuple[float, int, np.ndarray]] = []  # area of the outline itself, part, ring
    part = _parts(y, x0, x1) if mode == "edge" else np.zeros(len(y), np.int64)
    for loop in outline.loops(joined=mode == "centre"):
        corners = outline.start[loop]
        at = np.column_stack([outline.at[corners], outline.line[corners]])
        through = at if mode == "edge" else np.stack([outline.first[loop], outline.last[loop]], axis=1).reshape(-1, 2)
        rings.append((signed_area(np.concatenate([at, at[:1]])), int(part[outline.run[loop[0]]]), _bends(through)))
    shells = {of: ring for area, of, ring in rings if area > 0}
    out = {of: [ring] for of, ring in shells.items() if len(ring) >= 4 and signed_area(ring) > 0}
    for area, of, ring in rings:
        if area < 0 and of in out and len(ring) >= 4 and signed_area(ring) < 0:
            out[of].append(ring)
    return list(out.values())


def _parts(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int = 0) -> np.ndarray:
    """Number of the part (pixels connected by their sides, with ``reach`` 1 also by corners) of each run."""
    order = np.lexsort((x0, y))
    low = x0.min() - 1
    wide = int(x1.max() - low) + 2
    first, last = (y * wide + x0 - low)[order], (y * wide + x1 - low)[order]
    # runs of the next row that a run touches: they end at its start or later, and start at its end or before
    begin, stop = np.searchsorted(last, first + wide - reach), np.searchsorted(first, last + wide + reach, side="right")
    root = list(range(len(y)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k, (a, b) in enumerate(zip(begin.tolist(), stop.tolist(), strict=True)):
        for other in range(a, b):
            root[find(other)] = find(k)
    out = np.empty(len(y), np.int64)
    out[order] = [find(k) for k in range(len(y))]
    return out


def associate_holes(outers: DataFrame, holes: DataFrame) -> DataFrame:
    """hole, outer: the outer ring each hole belongs to, for loose rings (id, ring: array of points).

    It is the smallest ring around the hole's first point (the deepest one, where rings do not cross), of equal ones that
    with the smallest id, and null where there is none. Candidates come from the grid join of boxes.
    """
    boxes = boxes_of(outers.select(F.col("id").alias("fid"), F.array("ring").alias("rings")))
    first = holes.select("id", F.col("ring")[0].alias("p")).filter("p is not null")
    spots = first.select("id", *(F.col(f"p.{c}").alias(f"{m}_{c}") for m in ("min", "max") for c in "xy"))
    near = box_pairs(spots, boxes).join(first.withColumnRenamed("id", "a_id"), "a_id").join(outers.withColumnRenamed("id", "b_id"), "b_id")
    around = near.filter(point_in_ring(F.col("ring"), F.col("p.x"), F.col("p.y")))
    best = around.groupBy("a_id").agg(F.min_by("b_id", F.struct(F.abs(ring_area(F.col("ring"))), "b_id")).alias("outer"))
    return holes.select(F.col("id").alias("hole")).join(best.withColumnRenamed("a_id", "hole"), "hole", "left")


def mask_to_polygons(mask: DataFrame, meta: DataFrame, target: int = 1, mode: str = "centre", min_pixels: int = 0) -> DataFrame:
    """raster_id, component, part, rings (outer first) in ground coordinates.

    A task builds the rings of one component, which is one value of the result, from its runs; components of fewer than
    ``min_pixels`` pixels are left out before that.
    """
    return label_polygons(label_components(mask, target), meta, mode, min_pixels)


def joined_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs without the seams where one goes on in the next."""
    order = np.lexsort((x0, y))
    y, x0, x1 = y[order], x0[order], x1[order]
    head = np.flatnonzero(np.append(True, (y[1:] != y[:-1]) | (x0[1:] != x1[:-1] + 1)))
    return y[head], x0[head], x1[np.append(head[1:], len(y)) - 1]


def label_polygons(labels: DataFrame, meta: DataFrame, mode: str = "centre", min_pixels: int = 0) -> DataFrame:
    """The polygons of components as ``label_components`` or ``label_blocks`` gives them."""
    if mode not in ("centre", "edge"):
        raise ValueError(f"unknown mode {mode}")
    if min_pixels > 1:
        labels = labels.join(component_stats(labels).filter(F.col("pixels") >= min_pixels).select("raster_id", "component"), ["raster_id", "component"], "left_semi")

    def trace(key, table):
        shapes = polygons_of(*joined_runs(*(table[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))), mode)
        columns = [pa.array([key[0].as_py()] * len(shapes), pa.string()), pa.array([key[1].as_py()] * len(shapes), pa.int64()), pa.array(range(len(shapes)), pa.int32()), write_rings(shapes)]
        return pa.table(columns, names=["raster_id", "component", "part", "rings"])

    pixel = spread_groups(labels, "raster_id", "component").applyInArrow(trace, f"raster_id string, component long, part int, rings {RINGS}")

    return _grounded(pixel, meta)


def _grounded(pixel: DataFrame, meta: DataFrame) -> DataFrame:
    """Rings in ground coordinates."""

    def grounded(c):
        gx, gy = pixel_to_geo(c["x"], c["y"], F.col("gt"))
        return F.struct(gx.alias("x"), gy.alias("y"), c["z"].alias("z"))

    ground = F.transform("rings", lambda r: F.transform(r, grounded))
    return pixel.join(meta.select("raster_id", "gt"), "raster_id").select("raster_id", "component", "part", ground.alias("rings"))


def _united(x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> list[list[np.ndarray]]:
    """Polygons of the squares between four pixels, or of the half of one with three, that hang together by their sides.

    A side with another square beyond it is none of the outline's; all other sides are. Work on corners follows the outline, not the ground.
    """
    wide = int(np.ptp(x)) + 4
    low = np.array([x.min() - 1, y.min() - 1])
    own = (y - low[1]) * wide + x - low[0]
    every, starts, ends = np.sort(own), [], []
    has = [(bits & b) > 0 for b in (1, 2, 8, 4)]
    around = (0, 1, wide + 1, wide)  # the corners, one after another
    for k, beyond in enumerate((-wide, 1, wide, -1)):
        on = np.flatnonzero(has[k] & has[(k + 1) % 4])
        place = np.minimum(np.searchsorted(every, own[on] + beyond), len(every) - 1)
        outer = on[every[place] != own[on] + beyond]
        across = np.flatnonzero(has[k] & ~has[(k + 1) % 4] & has[(k + 2) % 4])
        starts += [own[outer] + around[k], own[across] + around[k]]
        ends += [own[outer] + around[(k + 1) % 4], own[across] + around[(k + 2) % 4]]
    a, b = np.concatenate(starts), np.concatenate(ends)
    keys, node = np.unique(np.concatenate([a, b]), return_inverse=True)
    place = np.column_stack([keys % wide + low[0], keys // wide + low[1]]).astype(float)
    a, b = np.split(node.ravel(), 2)
    spots = turned(place - place.min(0))
    rising = (spots[a, 1] < spots[b, 1]) | ((spots[a, 1] == spots[b, 1]) & (spots[a, 0] < spots[b, 0]))
    none = np.zeros((len(a), 1), np.int64)
    met = Arrangement(place, np.where(rising, a, b), np.where(rising, b, a), none, none, np.ones(len(a), np.int64), (none, none, none, none))
    return outline(met, rising, ~rising)


def repaired_polygons(mask: DataFrame, meta: DataFrame, target: int = 1, min_area: float = 0.0) -> DataFrame:
    """raster_id, component, part, rings: the polygons through pixel centres as ``repair_polygons`` leaves them, of components of at least ``min_area``.

    What such a polygon of a component encloses are the squares between four of its pixels and the halves of those with three. Where only a line or
    a corner holds them together it is not valid and falls apart. So the parts are put together from squares, and no task
    meets the ring of a component, which may go through the whole raster.
    """
    labels = label_components(mask, target)
    px = labels.select("raster_id", "component", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    corners = F.array(*(F.struct((F.col("x") - dx).cast("long").alias("x"), (F.col("y") - dy).cast("long").alias("y"), F.lit(bit).alias("bit")) for dx, dy, bit in ((0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8))))
    found = px.select("raster_id", "component", F.explode(corners).alias("c")).select("raster_id", "component", "c.x", "c.y", "c.bit")
    squares = found.groupBy("raster_id", "x", "y").agg(F.bit_or("bit").alias("bits"), F.min("component").alias("component")).filter(F.bit_count("bits") >= 3)
    # along a row, squares go on across a side both of whose pixels are set; a window holds one row of an image
    row = Window.partitionBy("raster_id", "y").orderBy("x")
    first = ~F.coalesce((F.lag("x").over(row) == F.col("x") - 1) & (F.col("bits").bitwiseAND(5) == 5), F.lit(False))
    begun = squares.withColumn("_x", F.when(first, F.col("x"))).withColumn("_x", F.last("_x", ignorenulls=True).over(row))
    cells = materialise(begun.withColumn("run", F.xxhash64("raster_id", "y", "_x")).drop("_x"))
    above = cells.filter(F.col("bits").bitwiseAND(12) == 12).select("raster_id", "x", (F.col("y") + 1).alias("y"), F.col("run").alias("other"))
    seams = cells.join(above, ["raster_id", "x", "y"]).select("run", "other").distinct()
    pieces = connected_components(seams, "run", "other").withColumnRenamed("node", "run").withColumnRenamed("component", "piece")
    if min_area > 0:
        gt = F.col("gt")
        area = F.sum(F.when(F.col("bits") == 15, 1.0).otherwise(0.5))
        sizes = cells.groupBy("raster_id", "component").agg(area.alias("_a")).join(meta.select("raster_id", F.abs(gt[1] * gt[5] - gt[2] * gt[4]).alias("_p")), "raster_id")
        cells = cells.join(sizes.filter(F.col("_a") * F.col("_p") >= min_area).select("raster_id", "component"), ["raster_id", "component"], "left_semi")
    whole = cells.join(pieces, "run", "left").select("raster_id", "component", F.coalesce("piece", "run").alias("piece"), "x", "y", "bits")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come one after another; those of about ``HELD`` squares leave together."""
        rows: list[tuple] = []

        def made(held: pa.Table) -> pa.RecordBatch:
            piece = held["piece"].to_numpy()
            heads = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            x, y, bits = (held[c].to_numpy().astype(np.int64) for c in ("x", "y", "bits"))
            shapes, of = [], []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(piece)], strict=True):
                own = _united(x[a:b], y[a:b], bits[a:b])
                shapes += own
                of += [a] * len(own)
            at = pa.array(of, pa.int64())
            return pa.RecordBatch.from_arrays([held[c].combine_chunks().take(at) for c in ("raster_id", "component", "piece")] + [write_rings(shapes)], names=["raster_id", "component", "piece", "rings"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            piece = batch["piece"].to_numpy()
            last = int(np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))[-1])
            if last or (held and held[-1]["piece"][-1].as_py() != piece[0]):  # a piece ends in this batch
                held.append(batch.slice(0, last))
                n += last
                if n > HELD // 16:
                    yield made(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(batch.slice(last))
            else:
                held.append(batch)
            n += batch.num_rows - last
            held = [b for b in held if b.num_rows]
        if held:
            yield made(pa.Table.from_batches(held))

    dealt = whole.repartition(int(mask.sparkSession.conf.get("spark.sql.shuffle.partitions")), "piece").sortWithinPartitions("piece")
    pixel = dealt.mapInArrow(trace, f"raster_id string, component long, piece long, rings {RINGS}")
    return _grounded(pixel.withColumn("part", F.lit(0)), meta)


def segment_to_polygons(mask: DataFrame, meta: DataFrame, target: int = 1, mode: str = "centre", min_area: float = 100.0, tolerance: float = 1.0, source: str = "segmentation") -> DataFrame:
    """Polygons of a class: small ones dropped, simplified, repaired, with attributes.

    Where nothing is simplified, polygons through pixel centres are put together in their repaired parts at once. A ring to be simplified is met whole.
    """
    from cairn.operators.vector import add_polygon_attributes, filter_small_polygons, repair_polygons, vector_simplify

    if mode == "centre" and tolerance <= 0:
        parts = repaired_polygons(mask, meta, target, min_area).withColumns({"layer": F.col("raster_id"), "fid": F.col("component"), "geom_type": F.lit("Polygon")})
        return add_polygon_attributes(parts, meta, target, source)
    shapes = mask_to_polygons(mask, meta, target, mode).withColumns({"layer": F.col("raster_id"), "fid": F.col("component"), "geom_type": F.lit("Polygon")})
    shapes = filter_small_polygons(shapes, min_area)
    if tolerance > 0:
        shapes = vector_simplify(shapes, tolerance)
    return add_polygon_attributes(repair_polygons(shapes), meta, target, source)
