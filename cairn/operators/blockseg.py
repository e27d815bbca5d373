"""Segmentation of rasters stored as blocks: tiles, scores, blending and masks as arrays. No row is made for a pixel or a class.

Each block sends every tile that overlaps it the rectangle they share, which is the halo exchange; a tile is put together from its rectangles
and becomes a tensor. Each scored tile sends every block it overlaps the weighted sums of its classes and the weights; a block adds
them up, and its mask is what scores best. ``segment_blocks`` says the same as ``segment.segment_large``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import chunks as B
from cairn.operators.raster import SAME
from cairn.operators.segment import Model, SegmentConfig, Segmentation, score
from cairn.operators.tiles import blend_weights, tensor_of, tile_grid
from cairn.plans.storage import materialise


def offsets(length: int, tile: int, stride: int) -> list[int]:
    """Where tiles begin along an axis: at every stride, and at the last possible place."""
    last = max(length - tile, 0)
    regular = list(range(0, last + 1, stride))
    return regular if regular[-1] == last else [*regular, last]


def _shared(begin: int, length: int, at: int, n: int) -> slice | None:
    """The places from ``begin`` on that lie in at .. at + n, as a slice of ``length`` places; None without any."""
    a, b = max(at - begin, 0), min(at + n - begin, length)
    return slice(a, b) if a < b else None


def tile_parts(chunks: DataFrame, meta: DataFrame, tile: int, stride: int) -> DataFrame:
    """raster_id, tile_id, band, x, y, w, h, data: the rectangle that each block and each tile over it share; missing values are NaN."""
    names = ["raster_id", "tile_id", "band", "x", "y", "w", "h", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raster, band, cx, cy, w, h, size, width, height = (batch.column(k)[i].as_py() for k in range(9))
                values = batch.column(9)[i].values.cast(pa.float32()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(h, w)
                left, top, rows = cx * size, cy * size, []
                across = offsets(width, tile, stride)
                for r, y in enumerate(offsets(height, tile, stride)):
                    down = _shared(top, h, y, tile)
                    for c, x in enumerate(across) if down else ():
                        along = _shared(left, w, x, tile)
                        if along:
                            cut = values[down, along]
                            rows.append((raster, r * len(across) + c, band, left + along.start - x, top + down.start - y, cut.shape[1], cut.shape[0], np.ascontiguousarray(cut).tobytes()))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.int32(), *[pa.int32()] * 4, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    placed = chunks.join(meta.select("raster_id", "width", "height"), "raster_id").select("raster_id", F.col("band").cast("int"), "cx", "cy", "w", "h", "size", "width", "height", "data")
    return placed.mapInArrow(run, "raster_id string, tile_id long, band int, x int, y int, w int, h int, data binary")


def tensors(chunks: DataFrame, meta: DataFrame, c: SegmentConfig) -> DataFrame:
    """raster_id, tile_id, tensor, shape of every tile, padded with 0; the tensor is null where a tile has nothing but nodata and is to be skipped."""

    def build(key: tuple[pa.Scalar, ...], tiles: pa.Table, parts: pa.Table) -> pa.Table:
        grids: dict[int, np.ndarray] = {}
        for band, x, y, w, h, data in zip(*(parts[n].to_pylist() for n in ("band", "x", "y", "w", "h", "data")), strict=True):
            grid = grids.setdefault(band, np.full((c.tile, c.tile), np.nan))
            grid[y : y + h, x : x + w] = np.frombuffer(data, np.float32).reshape(h, w)
        some = any((~np.isnan(g) & (np.abs(g - c.nodata) >= SAME)).any() for g in grids.values())
        out = tensor_of(grids, c.normalize, c.tile, c.tile, c.channels, c.bytes_in).ravel() if tiles.num_rows and (some or not c.skip_nodata) else None
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([out], pa.list_(pa.float32()))], names=["raster_id", "tile_id", "tensor"])

    keys = ("raster_id", "tile_id")
    grid = tile_grid(meta, c.tile, c.stride).select("raster_id", "tile_id")
    made = grid.groupBy(*keys).cogroup(tile_parts(chunks, meta, c.tile, _stride(c)).groupBy(*keys)).applyInArrow(build, "raster_id string, tile_id long, tensor array<float>")
    return made.withColumn("shape", F.array(*(F.lit(n).cast("long") for n in (1, c.channels, c.tile, c.tile))))


def _stride(c: SegmentConfig) -> int:
    return c.tile if c.stride <= 0 or c.stride > c.tile else c.stride


def blended(scored: DataFrame, meta: DataFrame, c: SegmentConfig, size: int, band: int = 0) -> DataFrame:
    """Mask blocks of ``size`` from scored tiles: the class with the best blended score, 0 below the threshold and where no tile scored."""
    weights = np.array(blend_weights(c.tile, c.tile - _stride(c), c.blend, c.sigma))
    weight = weights[:, None] * weights[None, :]
    names = ["raster_id", "cx", "cy", "tile_id", "x", "y", "w", "h", "classes", "sums", "weights"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raster, tile_id, width, height, shape = (batch.column(k)[i].as_py() for k in range(5))
                logits = batch.column(5)[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(shape[1:])
                across = offsets(width, c.tile, _stride(c))
                left, top = across[tile_id % len(across)], offsets(height, c.tile, _stride(c))[tile_id // len(across)]
                w, h = min(c.tile, width - left, logits.shape[2]), min(c.tile, height - top, logits.shape[1])
                p = 1 / (1 + np.exp(-logits[:, :h, :w]))
                rows = []
                for cy in range(top // size, (top + h - 1) // size + 1):
                    for cx in range(left // size, (left + w - 1) // size + 1):
                        down, along = _shared(top, h, cy * size, size), _shared(left, w, cx * size, size)
                        part, share = p[:, down, along], weight[down, along]
                        sums = part if c.blend == "none" else part * share
                        rows.append((raster, cx, cy, tile_id, left + along.start - cx * size, top + down.start - cy * size, part.shape[2], part.shape[1], len(p), np.ascontiguousarray(sums).tobytes(), np.ascontiguousarray(share).tobytes()))
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 5, pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    placed = scored.filter("error IS NULL AND scores IS NOT NULL").join(meta.select("raster_id", "width", "height"), "raster_id").select("raster_id", "tile_id", "width", "height", "scores_shape", "scores")
    parts = placed.mapInArrow(send, "raster_id string, cx int, cy int, tile_id long, x int, y int, w int, h int, classes int, sums binary, weights binary")

    def settle(key: tuple[pa.Scalar, ...], blocks: pa.Table, held: pa.Table) -> pa.Table:
        w, h = (blocks[n][0].as_py() for n in "wh")
        data = np.zeros((h, w), np.float32)
        if held.num_rows:
            sums, total = np.zeros((max(held["classes"].to_pylist()), h, w)), np.zeros((h, w))
            for k in np.argsort(held["tile_id"].to_numpy(), kind="stable").tolist():
                x, y, pw, ph, classes = (held[n][k].as_py() for n in ("x", "y", "w", "h", "classes"))
                box = slice(y, y + ph), slice(x, x + pw)
                new, share = np.frombuffer(held["sums"][k].as_py()).reshape(classes, ph, pw), np.frombuffer(held["weights"][k].as_py()).reshape(ph, pw)
                if c.blend == "none":  # the last tile by number wins
                    sums[:classes, *box], total[box] = new, 1.0
                else:
                    sums[:classes, *box] += new
                    total[box] += share
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = np.where(total > 0, sums / total, 0.0)
            data = np.where((total > 0) & (mean.max(0) >= c.threshold), mean.argmax(0), 0).astype(np.float32)
        heads = [pa.array([key[0].as_py()], pa.string()), pa.array([band], pa.int32()), *(pa.array([k.as_py()], pa.int32()) for k in key[1:]), pa.array([w], pa.int32()), pa.array([h], pa.int32())]
        return pa.table([*heads, pa.array([data.ravel()], pa.list_(pa.float32())), pa.array([size], pa.int32())], names=list(B.COLUMNS))

    keys = ("raster_id", "cx", "cy")
    rows = meta.select("raster_id", "width", "height", F.explode(F.sequence(F.lit(0), F.expr(f"(height - 1) div {size}").cast("int"))).alias("cy"))
    grid = rows.select("raster_id", "width", "height", "cy", F.explode(F.sequence(F.lit(0), F.expr(f"(width - 1) div {size}").cast("int"))).alias("cx"))
    grid = grid.select(*keys, *(F.least(F.lit(size), F.col(s) - F.col(at) * size).cast("int").alias(n) for s, at, n in (("width", "cx", "w"), ("height", "cy", "h"))))
    return grid.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(settle, "raster_id string, band int, cx int, cy int, w int, h int, data array<float>, size int")


def apply_nodata_mask(mask: DataFrame, chunks: DataFrame, meta: DataFrame, fill: int = 255) -> DataFrame:
    """``fill`` wherever any band has band 0's nodata value; rasters without one are unchanged."""
    sentinel = meta.select("raster_id", F.get(F.col("bands"), F.lit(0))["nodata"].cast("double").alias("nodata")).filter("nodata IS NOT NULL")
    keys = ("raster_id", "cx", "cy")

    def stamp(blocks: pa.Table, bands: pa.Table) -> pa.Table:
        if not blocks.num_rows or not bands.num_rows:
            return blocks
        data = blocks["data"][0].values.to_numpy(zero_copy_only=False).copy()
        for values, nodata in zip(bands["data"], bands["nodata"].to_pylist(), strict=True):
            v = values.values.cast(pa.float32()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            data[np.isnan(v) if np.isnan(nodata) else np.abs(v - nodata) < SAME] = fill
        return blocks.set_column(blocks.schema.get_field_index("data"), "data", pa.array([data], pa.list_(pa.float32())))

    void = chunks.join(sentinel, "raster_id").select(*keys, "data", "nodata")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in mask.schema)
    return mask.groupBy(*keys).cogroup(void.groupBy(*keys)).applyInArrow(stamp, schema)


def segment_blocks(chunks: DataFrame, meta: DataFrame, model: Model, config: SegmentConfig | None = None, size: int | None = None) -> Segmentation:
    """``segment_large`` on blocks: the mask comes in blocks of the source's side, counts and tiles as there."""
    c = config or SegmentConfig()
    side = size or chunks.select("size").first()[0]
    made = tensors(chunks, meta, c)
    scored = materialise(score(made.filter("tensor IS NOT NULL").repartition("raster_id", "tile_id"), model, c.batch_size).drop("tensor"))
    mask = materialise(blended(scored, meta, c, side))
    state = tile_grid(meta, c.tile, c.stride).join(scored.select("raster_id", "tile_id", "error", F.lit(True).alias("_scored")), ["raster_id", "tile_id"], "left")
    return Segmentation(apply_nodata_mask(mask, chunks, meta, c.fill), B.class_counts(mask), state.withColumn("skipped", F.col("_scored").isNull()).drop("_scored"))
