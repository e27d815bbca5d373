"""Pixel-wise operators on blocks: a block's values stay one array, and no pixel ever becomes a row.

Blocks: raster_id, band, cx, cy, w, h, data, size (``sources.raster``). Values are single precision, as they are stored; missing
ones are null. Each operator says the same as the one of its name on pixel rows and gives blocks again. Kernels see the values of
many blocks at once; what differs from raster to raster (nodata values, statistics) is joined to the blocks, one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.raster import RANGES, SAME, _need

AT_ONCE = 1 << 20  # values that a kernel sees at once, beyond a single block

COLUMNS = ("raster_id", "band", "cx", "cy", "w", "h", "data", "size")


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of the arrays end to end, missing ones as NaN, and how many each array has."""
    flat = column.flatten()
    return flat.cast(pa.float32()).fill_null(np.nan).to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def bounded(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose arrays in column ``at`` hold about ``AT_ONCE`` values: what a kernel needs beside them stays bounded, whatever the batch."""
    total = np.append(0, np.cumsum(batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def map_values(chunks: DataFrame, kernel: Callable[..., np.ndarray], *parameters: str) -> DataFrame:
    """Blocks with ``data`` replaced by kernel(values, parameter of each value ...); NaN comes back as missing.

    ``parameters`` are columns of numbers beside the blocks', which are dropped; a null one is NaN.
    """
    rows = chunks.select(*COLUMNS, *(F.col(c).cast("double").alias(f"p{k}") for k, c in enumerate(parameters)))
    at = COLUMNS.index("data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, at)):
            values, sizes = _values(batch.column(at))
            held = [np.repeat(batch.column(len(COLUMNS) + k).fill_null(np.nan).to_numpy(zero_copy_only=False), sizes) for k in range(len(parameters))]
            new = np.asarray(kernel(values, *held), np.float32)
            data = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(new, mask=np.isnan(new)))
            yield pa.RecordBatch.from_arrays([data if k == at else batch.column(k) for k in range(len(COLUMNS))], names=list(COLUMNS))

    schema = ", ".join(f"{c} {'array<float>' if c == 'data' else chunks.schema[c].dataType.simpleString()}" for c in COLUMNS)
    return rows.mapInArrow(run, schema)


def _with_nodata(chunks: DataFrame, meta: DataFrame, band: int) -> DataFrame:
    nodata = meta.select("raster_id", F.get(F.col("bands"), F.lit(band))["nodata"].alias("nodata"))
    return chunks.filter(F.col("band") == band).join(nodata, "raster_id").withColumn("band", F.lit(0))


def _void(values: np.ndarray, nodata: np.ndarray) -> np.ndarray:
    return np.isnan(values) | (np.abs(values - nodata) < SAME)


def threshold(chunks: DataFrame, meta: DataFrame, limit: float = 128.0, band: int = 0) -> DataFrame:
    """1 where the value reaches the limit, else 0; missing and nodata give 0."""
    return map_values(_with_nodata(chunks, meta, band), lambda v, nodata: (v >= np.float32(limit)) & ~_void(v, nodata), "nodata")


def threshold_range(chunks: DataFrame, meta: DataFrame, low: float, high: float, band: int = 0) -> DataFrame:
    """1 where low <= value <= high, else 0; missing and nodata give 0."""
    _need(low <= high, "low must not exceed high")
    return map_values(_with_nodata(chunks, meta, band), lambda v, nodata: (v >= np.float32(low)) & (v <= np.float32(high)) & ~_void(v, nodata), "nodata")


def normalize_range(chunks: DataFrame, low: float, high: float) -> DataFrame:
    """(clamp(v) - low) / (high - low); missing stays missing."""
    _need(high > low, "high must exceed low")
    return map_values(chunks, lambda v: (np.clip(v.astype(float), low, high) - low) / (high - low))


def band_stats(chunks: DataFrame) -> DataFrame:
    """n, min, max, mean and population standard deviation of each band: a row of sums for each block, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, 2)):
            values, sizes = _values(batch.column(2))
            out = []
            for part in np.split(values.astype(float), np.cumsum(sizes)[:-1]) if len(sizes) else []:
                part = part[~np.isnan(part)]
                mean = part.mean() if len(part) else 0.0
                out.append((len(part), part.min() if len(part) else None, part.max() if len(part) else None, mean, float(((part - mean) ** 2).sum())))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.int64(), *[pa.float64()] * 4), strict=True)] if out else [pa.nulls(0, pa.int64()), *[pa.nulls(0, pa.float64())] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["raster_id", "band", "n", "low", "high", "mean", "spread"])

    band = chunks.schema["band"].dataType.simpleString()
    parts = chunks.select("raster_id", "band", "data").mapInArrow(run, f"raster_id string, band {band}, n long, low double, high double, mean double, spread double")
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    # around the first block's mean, so that large values lose no digits
    sums = parts.groupBy("raster_id", "band").agg(n.alias("n"), F.min("low").alias("min"), F.max("high").alias("max"), (total / n).alias("mean"))
    around = parts.join(sums.select("raster_id", "band", F.col("mean").alias("_mean")), ["raster_id", "band"])
    spread = around.groupBy("raster_id", "band").agg(F.sqrt(F.sum(F.col("spread") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2) / F.sum("n")).alias("std"))
    return sums.join(spread, ["raster_id", "band"])


def normalize(chunks: DataFrame) -> DataFrame:
    """Min-max over each band; a range below 1e-10 gives 0, missing stays missing."""
    stats = band_stats(chunks).select("raster_id", "band", F.col("min").alias("low"), F.col("max").alias("high"))

    def kernel(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        spread = high - low
        return np.where(spread < 1e-10, np.where(np.isnan(v), np.nan, 0.0), (v - low) / np.where(spread < 1e-10, 1.0, spread))

    return map_values(chunks.join(stats, ["raster_id", "band"]), kernel, "low", "high")


def cast(chunks: DataFrame, dtype: str) -> DataFrame:
    """Values as an integer type on disk holds them: rounded, halves away from zero, and clamped; missing stays missing."""
    _need(dtype in RANGES, f"unknown type {dtype}")
    low, high = RANGES[dtype]
    return map_values(chunks, lambda v: np.clip(np.copysign(np.floor(np.abs(v.astype(float)) + 0.5), v), low, high))


def class_counts(chunks: DataFrame) -> DataFrame:
    """raster_id, class, n of a mask; each block sends one row a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in bounded(whole, 1)):
            values, sizes = _values(batch.column(1))
            rows, classes, counts = [], [], []
            for k, part in enumerate(np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []):
                found, n = np.unique(part[~np.isnan(part)].astype(np.int64), return_counts=True)
                rows += [k] * len(found)
                classes += found.tolist()
                counts += n.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(classes, pa.int64()), pa.array(counts, pa.int64())], names=["raster_id", "class", "n"])

    return chunks.select("raster_id", "data").mapInArrow(run, "raster_id string, class long, n long").groupBy("raster_id", "class").agg(F.sum("n").alias("n"))
