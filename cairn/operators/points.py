"""Point-cloud operators. Points: cloud_id, ord (unique within a cloud), x, y, z, intensity, classification."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.plans.groups import spread_groups
from cairn.plans.ranks import running_total
from cairn.plans.storage import discard, materialise


def _need(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def pass_through(pc: DataFrame, axis: str = "z", low: float = 0.0, high: float = 100.0, strict: bool = False) -> DataFrame:
    """Points with low <= axis <= high; the filter reaches the scan."""
    _need(axis.lower() in ("x", "y", "z"), "axis must be x, y or z")
    if strict:
        _need(not pc.isEmpty(), "no points")
    return pc.filter(F.col(axis.lower()).between(low, high))


def voxel_downsample(pc: DataFrame, size: float) -> DataFrame:
    """One point a cell of ``size``: centroid, mean intensity, and the classification of the last point by ``ord``."""
    _need(size > 0, "size must be positive")
    cells = [F.floor(F.col(c) / size).cast("long").alias(f"c{c}") for c in "xyz"]
    means = [F.avg(c).alias(c) for c in ("x", "y", "z", "intensity")]
    return pc.groupBy("cloud_id", *cells).agg(*means, F.max_by("classification", "ord").alias("classification"), F.count("*").alias("n"))


def random_downsample(pc: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Exactly ceil(n * ratio) points (at least one, if there are any) of each cloud, the same for the same seed.

    Points are ordered by a hash of seed and ``ord``. A histogram of the hash's leading bits finds the bucket where the
    count is reached; only that bucket is ranked, so no task holds a cloud. Buckets number about n / 1000, and no task meets them all.
    """
    _need(0 < ratio <= 1, "ratio must be in (0, 1]")
    total = pc.count()
    bits = max(6, min(40, math.ceil(math.log2(max(total, 1) / 1000 + 1))))
    hashed = pc.withColumn("_h", F.xxhash64(F.lit(seed), F.col("cloud_id"), F.col("ord"))).withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))
    counts = hashed.groupBy("cloud_id", "_b").agg(F.count("*").alias("_n"))
    totals = counts.groupBy("cloud_id").agg(F.sum("_n").alias("_all"))
    placed = running_total(counts, ["cloud_id"], "_b", "_n", "_before").join(totals, "cloud_id")
    placed = placed.select("cloud_id", "_b", "_before", (F.greatest(F.lit(1), F.ceil(F.col("_all") * ratio)) - F.col("_before")).alias("_left"), "_n").filter("_left > 0")
    near = hashed.join(placed, ["cloud_id", "_b"])
    whole = near.filter("_left >= _n")
    rank = F.row_number().over(Window.partitionBy("cloud_id", "_b").orderBy("_h", "ord"))
    part = near.filter("_left < _n").withColumn("_rank", rank).filter("_rank <= _left").drop("_rank")
    return whole.unionByName(part).select(pc.columns)


# ---------------------------------------------------------------- nearest neighbours


HALVINGS = 6  # tried at once
CROWD = 16  # times k: points of a cell beyond which the cells of a cloud are made smaller


def _cell_sizes(points: DataFrame, k: int) -> DataFrame:
    """cloud_id, size: the side of each cloud's cells, halved from one that holds about k points while the fullest cell is crowded and thins out.

    The first size is tried alone, as it does for even clouds; then some halvings at a time.
    """
    sides = F.array(*(F.max(c) - F.min(c) for c in "xyz"))
    box = points.groupBy("cloud_id").agg(F.count("*").alias("n"), F.filter(sides, lambda s: s > 0).alias("sides"))
    even = F.pow(F.aggregate("sides", F.lit(1.0), lambda a, s: a * s) * k / F.col("n"), 1.0 / F.size("sides"))
    first = materialise(box.select("cloud_id", F.when(F.size("sides") > 0, even).otherwise(1.0).alias("size")))
    left, tried, done, known = first, [0], None, None
    while True:
        some = points.join(left, "cloud_id").select("cloud_id", "size", *"xyz", F.explode(F.array(*map(F.lit, tried))).alias("h"))
        cells = [F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("h")) / F.col("size")) for c in "xyz"]
        full = some.groupBy("cloud_id", "h", *cells).agg(F.count("*").alias("n")).groupBy("cloud_id", "h").agg(F.max("n").alias("most"))
        known = materialise(full if known is None else full.unionByName(known))
        thinner = known.withColumn("prior", F.lag("most").over(Window.partitionBy("cloud_id").orderBy("h")))
        stop = (F.col("most") <= CROWD * k) | (F.col("most") >= 0.7 * F.col("prior"))
        found = materialise(thinner.filter(stop).groupBy("cloud_id").agg(F.min("h").alias("h")))
        sized = left.join(found, "cloud_id").select("cloud_id", (F.col("size") / F.pow(F.lit(2.0), F.col("h"))).alias("size"))
        done = sized if done is None else done.unionByName(sized)
        left = materialise(left.join(found, "cloud_id", "left_anti"))
        if left.isEmpty():
            return done
        tried = list(range(tried[-1] + 1, tried[-1] + 1 + HALVINGS))


def _steps_to_crowd(targets: DataFrame, pending: DataFrame, k: int, most: int) -> DataFrame:
    """cloud_id, ord, e: how often a cell must double until the point's own one holds k targets; ``most``, if none does.

    Counts of larger cells are sums over smaller ones; a point asks for one cell of each size.
    """
    cells = targets.groupBy("cloud_id", *(F.floor(F.col(c) / F.col("size")).cast("long").alias(f"c{c}") for c in "xyz")).agg(F.count("*").alias("n"))
    levels = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("e")
    up = [F.floor(F.col(f"c{c}") / F.pow(F.lit(2.0), F.col("e"))).cast("long").alias(f"c{c}") for c in "xyz"]
    full = cells.select("*", levels).groupBy("cloud_id", "e", *up).agg(F.sum("n").alias("n")).filter(F.col("n") >= k)
    own = pending.select("cloud_id", "ord", *(F.floor(F.col(c) / F.col("size")).cast("long").alias(f"c{c}") for c in "xyz"), levels).select("cloud_id", "ord", "e", *up)
    found = own.join(full, ["cloud_id", "e", "cx", "cy", "cz"]).groupBy("cloud_id", "ord").agg(F.min("e").alias("e"))
    return pending.select("cloud_id", "ord").join(found, ["cloud_id", "ord"], "left").select("cloud_id", "ord", F.coalesce("e", F.lit(most)).alias("e"))


BLOCK, HALO = 8, 2  # cells of a block on each axis, and cells around it whose points come along
WIDE = BLOCK + 2 * HALO
AT_ONCE = 1 << 21  # distances held at once


def _nearest_in(at: np.ndarray, mine: np.ndarray, met: np.ndarray, number: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, dist, number of the other) of the k nearest of ``met`` for each of ``mine``, with all others as far as the k-th."""
    found = []
    step = max(1, AT_ONCE // max(1, len(met)))
    for i in range(0, len(mine), step):
        here = mine[i : i + step]
        away = np.zeros((len(here), len(met)))
        for c in range(3):
            away += (at[here, c, None] - at[None, met, c]) ** 2
        away = np.sqrt(away)
        row, column = np.nonzero(away <= np.partition(away, k - 1, axis=1)[:, k - 1 : k]) if len(met) > k else np.indices(away.shape).reshape(2, -1)
        found.append((here[row], away[row, column], number[met[column]]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _ranked(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_nearest_in`` gives, in order of point, distance and number, and no more than k for each point."""
    point, away, other = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((other, away, point))
    point, away, other = point[order], away[order], other[order]
    head = np.flatnonzero(np.append(True, point[1:] != point[:-1]))
    rank = np.arange(len(point)) - np.repeat(head, np.diff(np.append(head, len(point))))
    return point[rank < k], away[rank < k], other[rank < k]


def _block_neighbours(k: int, whole: bool) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """For the points of a block: their k nearest in the 27 cells around their own, and for those that this does not settle, in the whole block with its halo."""

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        at = np.column_stack([held[c].to_numpy() for c in "xyz"])
        number, own, size = held["ord"].to_numpy(), np.flatnonzero(held["own"].to_numpy()), held["size"][0].as_py()
        corner = np.array([x.as_py() for x in key[1:]], float) * BLOCK - HALO
        place = np.floor(at / size)
        cell = (place - corner).astype(np.int64) @ np.array([WIDE * WIDE, WIDE, 1])
        order = np.argsort(cell, kind="stable")
        begin = np.searchsorted(cell[order], np.arange(WIDE**3 + 1))
        own = own[np.argsort(cell[own], kind="stable")]
        heads = np.flatnonzero(np.append(True, cell[own][1:] != cell[own][:-1]))[: len(own)]
        near = [a * WIDE * WIDE + b * WIDE for a in (-1, 0, 1) for b in (-1, 0, 1)]
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for mine in np.split(own, heads[1:]):
            middle = [cell[mine[0]] + step for step in near] if len(mine) else []
            if len(mine):
                found.append(_nearest_in(at, mine, np.concatenate([order[begin[m - 1] : begin[m + 2]] for m in middle]), number, k))
        point, away, other = _ranked(found, k)
        n, far = np.bincount(point, minlength=len(at)), np.zeros(len(at))
        np.maximum.at(far, point, away)
        border = np.minimum(at - (place - 1) * size, (place + 2) * size - at).min(1)
        wanting = own[(n[own] < k) | (far[own] > border[own])]
        if len(wanting):
            again = np.zeros(len(at), bool)
            again[wanting] = True
            more = _nearest_in(at, wanting, np.arange(len(at)), number, k)
            point, away, other = _ranked([tuple(x[~again[point]] for x in (point, away, other)), more], k)
            n, far = np.bincount(point, minlength=len(at)), np.zeros(len(at))
            np.maximum.at(far, point, away)
            border[wanting] = np.minimum(at - corner * size, (corner + WIDE) * size - at).min(1)[wanting]
        own = np.sort(own)
        ends, good = np.cumsum(n[own]), (n[own] == k) & (far[own] <= border[own])
        lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values))
        columns = {"cloud_id": pa.array([key[0].as_py()] * len(own), held.schema.field("cloud_id").type), "ord": pa.array(number[own]), "found": pa.array(n[own]), "far": pa.array(far[own]), "settled": pa.array(good)}
        columns |= {c: pa.array(at[own, i], mask=good) for i, c in enumerate("xyz")}
        columns["d"] = pa.array(np.add.reduceat(np.append(away, 0.0), np.append(0, ends[:-1])) / np.maximum(n[own], 1) if len(own) else np.zeros(0))
        if whole:
            columns |= {"dists": lists(away), "others": lists(other)}
        return pa.table(columns)

    return run


def _in_blocks(targets: DataFrame, k: int, whole: bool) -> DataFrame:
    """cloud_id, ord, found, far, settled, x, y, z (null where settled), d (mean distance) and, if ``whole``, dists and others: see ``_block_neighbours``.

    A point goes to its own block, and to those beside it that it is within two cells of: about twice, not to 27 cells.
    """
    cells = targets.withColumns({f"c{c}": F.floor(F.col(c) / F.col("size")).cast("long") for c in "xyz"})

    def sides(c: str) -> Column:
        own = F.floor(F.col(f"c{c}") / BLOCK).cast("long")
        within = F.col(f"c{c}") - own * BLOCK
        return F.array_compact(F.array(own, F.when(within < HALO, own - 1), F.when(within >= BLOCK - HALO, own + 1)))

    sent = cells.select("cloud_id", "ord", *"xyz", "size", *(sides(c).alias(f"s{c}") for c in "xyz"))
    for c in "xyz":
        sent = sent.withColumn(f"b{c}", F.explode(f"s{c}")).withColumn(f"o{c}", F.col(f"b{c}") == F.col(f"s{c}")[0])
    sent = sent.select("cloud_id", "bx", "by", "bz", "ord", *"xyz", "size", (F.col("ox") & F.col("oy") & F.col("oz")).alias("own"))
    kinds = f"cloud_id {targets.schema['cloud_id'].dataType.simpleString()}, ord long, found long, far double, settled boolean, x double, y double, z double, d double"
    return spread_groups(sent, "cloud_id", "bx", "by", "bz").applyInArrow(_block_neighbours(k, whole), kinds + ", dists array<double>, others array<long>" * whole)


def _knn(pc: DataFrame, k: int, cell: float | None, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Three tables for ``knn_self_join``: points that share their place with k others before them (cloud_id, ord, x, y, z), what ``_in_blocks``
    settles, and rows (cloud_id, ord, rank, other, dist) of the points that it does not."""
    here = F.row_number().over(Window.partitionBy("cloud_id", "x", "y", "z").orderBy("ord"))
    points = materialise(pc.select("cloud_id", F.col("ord").cast("long").alias("ord"), *(F.col(c).cast("double").alias(c) for c in "xyz")).withColumn("crowded", here > k))
    one = points.filter(~F.col("crowded")).drop("crowded")
    counts = one.groupBy("cloud_id").agg(F.count("*").alias("_n"))
    sizes = points.select("cloud_id").distinct().withColumn("size", F.lit(float(cell))) if cell else _cell_sizes(one, k)
    targets = one.join(sizes, "cloud_id")
    first = materialise(_in_blocks(targets, k, whole))
    extent = F.greatest(*(F.max(c) - F.min(c) for c in "xyz")) / F.first("size")
    # cells so large that the 27 around any point hold its whole cloud
    most = max(1, math.ceil(math.log2(max(1.0, targets.groupBy("cloud_id").agg(extent.alias("_w")).agg(F.max("_w")).first()[0] or 1.0))) + 1)
    judged = first.join(counts, "cloud_id").withColumn("settled", F.col("settled") | (F.col("found") == F.col("_n"))).drop("_n")
    left = materialise(judged.filter(~F.col("settled")).join(sizes, "cloud_id").select("cloud_id", "ord", *"xyz", "size", F.lit(0).alias("e"), F.col("far").alias("_far"), F.col("found").alias("_found")))
    steps = F.array(*(F.struct(*(F.lit(d).alias(n) for d, n in zip(t, "abc", strict=True))) for t in [(i, j, m) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)]))
    size = F.col("size") * F.pow(F.lit(2.0), F.col("e"))
    own = [F.floor(F.col(c) / size).cast("long").alias(f"c{c}") for c in "xyz"]
    low = {c: F.floor(F.col(c) / F.col("size")).cast("long").alias(f"l{c}") for c in "xyz"}
    done = None
    while not left.isEmpty():
        # no neighbour is farther than ``reach``: k others are within the k-th distance so far, or within a cell that holds as many
        far = left.filter(F.col("_found") == k).withColumns({"e": F.least(F.lit(most), F.greatest(F.col("e") + 1, F.ceil(F.log2(F.col("_far") / F.col("size"))).cast("int"))), "reach": F.col("_far")})
        few = left.filter(F.coalesce("_found", F.lit(0)) < k).drop("e")
        few = few.join(_steps_to_crowd(targets, few, k, most), ["cloud_id", "ord"]).withColumn("reach", F.when(F.col("e") < most, size * math.sqrt(3)).otherwise(math.inf))
        columns = ["cloud_id", "ord", *"xyz", "size", "e", "reach"]
        pending = materialise(far.select(columns).unionByName(few.select(columns)))
        border = F.least(*(F.least(F.col(c) - (F.floor(F.col(c) / size) - 1) * size, (F.floor(F.col(c) / size) + 2) * size - F.col(c)) for c in "xyz"))
        moved = {c: (F.col(f"c{c}") + F.col(f"s.{d}")) for c, d in zip("xyz", "abc", strict=True)}
        beyond = F.greatest(*(F.greatest(moved[c] * size - F.col(c), F.col(c) - (moved[c] + 1) * size) for c in "xyz"))  # of the cell, on some axis
        asked = pending.select("*", *own, border.alias("border"), F.explode(steps).alias("s")).filter(beyond <= F.col("reach") * (1 + 1e-9))
        asked = materialise(asked.select("cloud_id", "e", "ord", *"xyz", "border", "reach", *(moved[c].alias(f"c{c}") for c in "xyz")))
        # the small cells with points that lie in cells asked for: only their points are sent, not all once a size
        small = targets.select("cloud_id", *low.values()).distinct()
        up = [F.floor(F.col(f"l{c}") / F.pow(F.lit(2.0), F.col("e"))).cast("long").alias(f"c{c}") for c in "xyz"]
        cells = small.join(pending.select("cloud_id", "e").distinct(), "cloud_id").select("cloud_id", "e", *(f"l{c}" for c in "xyz"), *up)
        wanted = materialise(cells.join(asked.select("cloud_id", "e", "cx", "cy", "cz").distinct(), ["cloud_id", "e", "cx", "cy", "cz"], "left_semi"))
        base = targets.select("cloud_id", F.col("ord").alias("other"), *(F.col(c).alias(f"o{c}") for c in "xyz"), *low.values()).join(wanted, ["cloud_id", "lx", "ly", "lz"]).drop("lx", "ly", "lz")
        dist = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in "xyz"))
        met = asked.join(base, ["cloud_id", "e", "cx", "cy", "cz"]).select("cloud_id", "ord", "border", "other", "reach", dist.alias("dist")).filter(F.col("dist") <= F.col("reach") * (1 + 1e-9))
        ranked = materialise(met.withColumn("rank", F.row_number().over(Window.partitionBy("cloud_id", "ord").orderBy("dist", "other"))).filter(F.col("rank") <= k))
        summary = materialise(ranked.groupBy("cloud_id", "ord").agg(F.max("dist").alias("_far"), F.count("*").alias("_found"), F.first("border").alias("_border")).join(counts, "cloud_id"))
        settled = summary.filter(((F.col("_found") == k) & (F.col("_far") <= F.col("_border"))) | (F.col("_found") == F.col("_n"))).select("cloud_id", "ord")
        part = ranked.join(settled, ["cloud_id", "ord"], "left_semi").select("cloud_id", "ord", "rank", "other", "dist")
        done = part if done is None else done.unionByName(part)
        before, left = left, materialise(pending.drop("reach").join(settled, ["cloud_id", "ord"], "left_anti").join(summary.select("cloud_id", "ord", "_far", "_found"), ["cloud_id", "ord"], "left"))
        discard(before, pending, asked, wanted)
    return points.filter("crowded").drop("crowded"), judged.filter("settled"), done


def knn_self_join(pc: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """cloud_id, ord, rank, other, dist: the k nearest points of each, itself among them (fewer, if the cloud has fewer).

    Points meet those of the 27 cells around their own, in blocks of cells. A point is settled when its k-th distance is no more than the distance
    to the border of what it met. Each cloud has cells as large as its densest part wants; a point that finds too few there goes on with a cell
    that holds k points, whichever of the doubled sizes that is, and one whose k-th distance reaches over the border with a cell as large as that
    distance, which settles it. So there are three rounds at most, wherever points lie. Ties go to the
    smaller ord, so of points in one place only the k smallest can be anyone's neighbours, and only those are met; they are all neighbours of the
    others in that place.
    """
    _need(k > 0, "k must be positive")
    if pc.isEmpty():
        return pc.select("cloud_id", "ord", F.lit(1).alias("rank"), F.col("ord").alias("other"), F.lit(0.0).alias("dist"))
    crowded, first, later = _knn(pc, k, cell, True)
    near = F.posexplode(F.arrays_zip("dists", "others")).alias("_p", "_o")
    found = first.select("cloud_id", "ord", near).select("cloud_id", "ord", (F.col("_p") + 1).alias("rank"), F.col("_o.others").alias("other"), F.col("_o.dists").alias("dist"))
    if later is not None:
        found = found.unionByName(later)
    if crowded.isEmpty():
        return found
    place = ["cloud_id", "x", "y", "z"]
    same = pc.select("cloud_id", F.col("ord").alias("other"), *(F.col(c).cast("double").alias(c) for c in "xyz")).join(crowded.select(place).distinct(), place, "left_semi")
    same = same.withColumn("rank", F.row_number().over(Window.partitionBy(place).orderBy("other"))).filter(F.col("rank") <= k)
    return found.unionByName(crowded.join(same, place).select("cloud_id", "ord", "rank", "other", F.lit(0.0).alias("dist")))


def mean_neighbour_distance(pc: DataFrame, k: int = 50) -> DataFrame:
    """cloud_id, ord, d: mean distance to the k nearest, the point itself counting as one (distance 0)."""
    if k < 1 or pc.isEmpty():
        return knn_self_join(pc, k).groupBy("cloud_id", "ord").agg(F.avg("dist").alias("d"))
    crowded, first, later = _knn(pc, k, None, False)
    found = first.select("cloud_id", "ord", "d").unionByName(crowded.select("cloud_id", "ord", F.lit(0.0).alias("d")))
    return found if later is None else found.unionByName(later.groupBy("cloud_id", "ord").agg(F.avg("dist").alias("d")))


def outlier_removal(pc: DataFrame, k: int = 50, multiplier: float = 1.0, strict: bool = False) -> DataFrame:
    """Points whose mean neighbour distance is at most mean + multiplier * population standard deviation of its cloud."""
    _need(k > 0, "k must be positive")
    if strict:
        _need(not pc.isEmpty(), "no points")
    d = materialise(mean_neighbour_distance(pc, k))
    limit = d.groupBy("cloud_id").agg((F.avg("d") + multiplier * F.stddev_pop("d")).alias("_limit"))
    kept = d.join(limit, "cloud_id").filter(F.col("d") <= F.col("_limit")).select("cloud_id", "ord")
    return pc.join(kept, ["cloud_id", "ord"], "left_semi")


def point_count(pc: DataFrame) -> DataFrame:
    return pc.groupBy("cloud_id").agg(F.count("*").alias("n"))


