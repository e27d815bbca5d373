"""Scoring of tensors and the segmentation pipelines built from tiles, scores and masks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.raster import apply_nodata_mask, resample_meta
from cairn.operators.tiles import blend_tiles, class_counts, final_mask, mask_to_raster, sigmoid, sigmoid_argmax, skip_nodata_tiles, tile_raster, to_tensors
from cairn.plans.storage import materialise

Model = Callable[..., np.ndarray]  # one or more arrays (n, C, H, W) to one (n, K, H, W)


class OnnxModel:
    """A model file's bytes as a scorer; one session for each Python worker, on one thread, since Spark's tasks have the cores."""

    _sessions: dict[int, object] = {}

    def __init__(self, data: bytes):
        self.data = data

    def __call__(self, *inputs: np.ndarray) -> np.ndarray:
        key = hash(self.data)
        if key not in self._sessions:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            self._sessions[key] = onnxruntime.InferenceSession(self.data, options)
        session = self._sessions[key]
        return session.run(None, {i.name: x.astype(np.float32) for i, x in zip(session.get_inputs(), inputs, strict=True)})[0]


def score(tensors: DataFrame, model: Model, batch_size: int = 8, inputs: tuple[str, ...] = ("tensor",), shape: str = "shape") -> DataFrame:
    """The rows with ``scores`` (array<float>), ``scores_shape`` and ``error``; batches of at most ``batch_size`` go to the model.

    Tensors of one batch have one shape. What the model returns must be numeric and have four dimensions, one entry a tensor;
    anything else, or an exception, becomes the error of the batch's rows rather than the end of the job.
    """
    if not callable(model):
        raise ValueError("no model is loaded")
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    at, shape_at = [tensors.columns.index(c) for c in inputs], tensors.columns.index(shape)

    def run_batch(arrays: list[np.ndarray]) -> np.ndarray:
        out = np.asarray(model(*arrays))
        if out.dtype.kind not in "fiu" or out.ndim < 4 or out.shape[0] != len(arrays[0]) or not out.size:
            raise ValueError(f"the model returned {out.dtype} of shape {out.shape}")
        return out.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = batch.column(shape_at).to_pylist()
            start = 0
            while start < batch.num_rows:
                stop = start + 1
                while stop < min(batch.num_rows, start + batch_size) and shapes[stop] == shapes[start]:
                    stop += 1
                part = batch.slice(start, stop - start)
                try:
                    arrays = [np.concatenate([np.asarray(x, np.float32).reshape(shapes[start]) for x in part.column(i).to_pylist()]) for i in at]
                    out = run_batch(arrays)
                    values, dims, errors = [o.ravel() for o in out], [[1, *out.shape[1:]]] * len(out), [None] * len(out)
                except Exception as e:  # a bad raster is recorded, the others go on
                    values, dims, errors = [None] * part.num_rows, [None] * part.num_rows, [str(e)] * part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(values, pa.list_(pa.float32())), pa.array(dims, pa.list_(pa.int64())), pa.array(errors, pa.string())], names=[*part.schema.names, "scores", "scores_shape", "error"]
                )
                start = stop

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tensors.schema)
    return tensors.mapInArrow(run, f"{schema}, scores array<float>, scores_shape array<long>, error string")


def explode_scores(scored: DataFrame, keys: tuple[str, ...] = ("raster_id", "tile_id")) -> DataFrame:
    """keys, class, px, py, logit of the rows without an error."""
    cells = scored.filter("error is null").select(*keys, "scores_shape", F.posexplode("scores").alias("_i", "logit"))
    h, w = F.col("scores_shape")[2], F.col("scores_shape")[3]
    place = lambda e: F.floor(e).cast("int")
    return cells.select(*keys, place(F.col("_i") / (h * w)).alias("class"), (F.col("_i") % w).cast("int").alias("px"), place(F.col("_i") % (h * w) / w).alias("py"), F.col("logit").cast("double").alias("logit"))


@dataclass
class SegmentConfig:
    tile: int = 512
    stride: int = 384
    channels: int = 3
    normalize: str = "none"
    bytes_in: bool = False
    batch_size: int = 8
    blend: str = "linear"
    sigma: float = 0.5
    threshold: float = 0.5
    skip_nodata: bool = True
    nodata: float = 0.0
    fill: int = 255
    min_area: float = 100.0
    tolerance: float = 1.0


def nearest_pixels(px: DataFrame, meta: DataFrame, size: int) -> DataFrame:
    """raster_id, band, x, y, v of size x size places: the pixel that ``to_tensors`` takes for each, so that no task meets a whole raster."""

    def places(at: str, length: str, name: str) -> DataFrame:
        step = (F.col(length).cast("float") / F.lit(size).cast("float")).cast("float")
        source = F.least(F.col(length) - 1, F.floor(F.col("i").cast("float") * step)).cast("int")
        return meta.select("raster_id", length, F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")).select("raster_id", source.alias(at), F.col("i").alias(name))

    met = px.join(places("x", "width", "_x"), ["raster_id", "x"]).join(places("y", "height", "_y"), ["raster_id", "y"])
    return met.select("raster_id", "band", F.col("_x").alias("x"), F.col("_y").alias("y"), "v")


def segment_image(px: DataFrame, meta: DataFrame, model: Model, size: int = 512, channels: int = 3, normalize: str = "none", batch_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """Each raster as one tensor of size x size: mask pixels and meta, whose geotransform is scaled to the mask."""
    whole = meta.select("raster_id", F.lit(0).cast("long").alias("tile_id"), F.lit(0).alias("src_x"), F.lit(0).alias("src_y"), F.col("width").alias("src_w"), F.col("height").alias("src_h"))
    if normalize not in ("minmax", "zscore"):  # these two need every pixel
        px, whole = nearest_pixels(px, meta, size), whole.withColumns({"src_w": F.lit(size), "src_h": F.lit(size)})
    cells = px.select("raster_id", F.lit(0).cast("long").alias("tile_id"), "band", F.col("x").alias("tx"), F.col("y").alias("ty"), "v")
    scored = score(to_tensors(cells, whole, normalize, size, size, channels), model, batch_size)
    mask = sigmoid_argmax(explode_scores(scored)).select("raster_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("class").alias("v"))
    return mask_to_raster(mask, resample_meta(meta, F.lit(size), F.lit(size)))


@dataclass
class Segmentation:
    mask: DataFrame  # raster_id, x, y, v with nodata stamped
    counts: DataFrame  # raster_id, class, n before that
    tiles: DataFrame  # every tile with skipped and error


def segment_large(px: DataFrame, meta: DataFrame, model: Model, config: SegmentConfig | None = None) -> Segmentation:
    """Tile, skip, score, blend and mask rasters of any size; all rasters are one job.

    Tiles smaller than the tile size are padded with 0 and scored unstretched; every tile that is not skipped is scored.
    """
    c = config or SegmentConfig()
    tiles, cells = tile_raster(px, meta, c.tile, c.stride)
    live = skip_nodata_tiles(tiles, cells, c.nodata) if c.skip_nodata else tiles
    padded = live.withColumns({"src_w": F.lit(c.tile), "src_h": F.lit(c.tile)})
    tensors = to_tensors(cells, padded, c.normalize, c.tile, c.tile, c.channels, bytes_in=c.bytes_in)
    scored = materialise(score(tensors.repartition("raster_id", "tile_id"), model, c.batch_size).drop("tensor"))
    probs = explode_scores(scored).withColumn("p", sigmoid(F.col("logit")))
    mask = materialise(final_mask(blend_tiles(probs, tiles, c.tile, c.stride, c.blend, c.sigma), meta, c.threshold))
    state = tiles.join(scored.select("raster_id", "tile_id", "error", F.lit(True).alias("_scored")), ["raster_id", "tile_id"], "left")
    return Segmentation(apply_nodata_mask(mask, px, meta, c.fill), class_counts(mask), state.withColumn("skipped", F.col("_scored").isNull()).drop("_scored"))


def segmentation_stats(tiles: DataFrame, polygons: DataFrame | None = None) -> DataFrame:
    """raster_id with total, skipped and inferred tiles and, given polygons (raster_id, area), their number and total area."""
    stats = tiles.groupBy("raster_id").agg(F.count("*").alias("total_tiles"), F.count_if("skipped").alias("skipped_tiles"), F.count_if(~F.col("skipped")).alias("inferred_tiles"))
    if polygons is None:
        return stats
    found = polygons.groupBy("raster_id").agg(F.count("*").alias("polygons"), F.sum("area").alias("total_area"))
    return stats.join(found, "raster_id", "left").withColumns({"polygons": F.coalesce("polygons", F.lit(0)), "total_area": F.coalesce("total_area", F.lit(0.0))})


def batch_report(tiles: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a raster: success, error (different messages joined by "; "), output name."""
    errors = tiles.groupBy("raster_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("error"))
    return meta.select("raster_id").join(errors, "raster_id", "left").select("raster_id", (F.coalesce("error", F.lit("")) == "").alias("success"), F.coalesce("error", F.lit("")).alias("error"), F.concat("raster_id", F.lit("_seg")).alias("output"))


def overall_report(report: DataFrame, messages: int = 1000) -> DataFrame:
    """One row: whether all succeeded, how many did, and the first ``messages`` messages by raster; all of them are rows of the report."""
    said = report.filter("error <> ''").select(F.concat_ws(": ", "raster_id", "error").alias("said")).distinct().orderBy("said").limit(messages)
    first = said.agg(F.array_join(F.array_sort(F.collect_list("said")), "; ").alias("error")).scalar()
    return report.agg(F.coalesce(F.bool_and("success"), F.lit(True)).alias("success"), F.count_if("success").alias("succeeded"), F.count("*").alias("total")).withColumn("error", first)


def batch_segment(px: DataFrame, meta: DataFrame, model: Model, config: SegmentConfig | None = None, polygons: bool = True) -> tuple[Segmentation, DataFrame | None, DataFrame]:
    """All rasters of a table: segmentation, polygons (unless not wanted) and a report; a raster that fails is a row of the report."""
    c = config or SegmentConfig()
    result = segment_large(px, meta, model, c)
    shapes = None
    if polygons:
        from cairn.operators.polygonize import segment_to_polygons

        shapes = segment_to_polygons(result.mask, meta, min_area=c.min_area, tolerance=c.tolerance)
    return result, shapes, batch_report(result.tiles, meta)


def batch_folder(spark: SparkSession, path: str, model: Model, config: SegmentConfig | None = None, polygons: bool = True):
    """``batch_segment`` over the rasters stored under a path."""
    from cairn.sources.raster import read_raster, to_pixels

    meta, chunks = read_raster(spark, path)
    return batch_segment(to_pixels(chunks), meta, model, config, polygons)
