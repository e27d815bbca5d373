"""Raster storage: blocks of pixels as arrays in Parquet, and the way between blocks and pixel rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.affine import extent

RASTER, VECTOR, POINTS = ("tif", "tiff", "cog"), ("shp", "geojson", "json", "gpkg"), ("las", "laz")
#: Further endings that the wider listing knows.
MORE_RASTER, MORE_VECTOR = ("img", "vrt", "png", "jpg", "jpeg", "bmp"), ("kml", "csv")


def detect_format(path, wide: bool = False):
    """Raster, Vector, PointCloud or Unknown by what follows the last dot, in any case."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    raster, vector = RASTER + (MORE_RASTER if wide else ()), VECTOR + (MORE_VECTOR if wide else ())
    return F.when(ending.isin(*raster), "Raster").when(ending.isin(*vector), "Vector").when(ending.isin(*POINTS), "PointCloud").otherwise("Unknown")


def list_datasets(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("Raster", "Vector", "PointCloud"), wide: bool = False) -> DataFrame:
    """path, length, modificationTime and kind of the files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    return files.withColumn("kind", detect_format(F.col("path"), wide)).filter(F.col("kind").isin(*kinds))


def to_pixels(chunks: DataFrame) -> DataFrame:
    """Pixel rows of blocks (raster_id, band, cx, cy, w, h, data) of the block size named in ``size``; NaN becomes null."""
    cells = chunks.select("raster_id", "band", "cx", "cy", "w", "size", F.posexplode("data").alias("_i", "_v"))
    x, y = F.col("cx") * F.col("size") + F.col("_i") % F.col("w"), F.col("cy") * F.col("size") + F.expr("_i div w")
    return cells.select("raster_id", "band", x.cast("int").alias("x"), y.cast("int").alias("y"), F.when(~F.isnan("_v"), F.col("_v").cast("double")).alias("v"))


BLOCK = ("raster_id", "band", "cx", "cy", "w", "h")
AT_ONCE = 1 << 20  # places of blocks in one batch, beyond a single block


def _heads(rows: pa.Table) -> np.ndarray:
    """The rows where a block begins."""
    first = np.zeros(rows.num_rows, bool)
    first[:1] = True
    for c in BLOCK:
        code = rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        first[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(first)


def _built(rows: pa.Table, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of rows sorted by block, about ``AT_ONCE`` places at a time."""
    area = rows["w"].to_numpy()[heads].astype(np.int64) * rows["h"].to_numpy()[heads]
    ends, total = np.append(heads[1:], rows.num_rows), np.append(0, np.cumsum(area))
    a = 0
    while a < len(heads):
        b = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, side="right")) - 1)
        part = rows.slice(heads[a], ends[b - 1] - heads[a])
        at = part["i"].to_numpy() + np.repeat(total[a:b] - total[a], ends[a:b] - heads[a:b])
        v = part["v"].combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)
        order = np.lexsort((np.where(np.isnan(v), -np.inf, v), at))
        data = np.full(total[b] - total[a], np.nan, np.float32)
        data[at[order]] = v[order]
        made = pa.ListArray.from_arrays(pa.array(total[a : b + 1] - total[a], pa.int32()), pa.array(data, mask=np.isnan(data)))
        keys = part.select(list(BLOCK)).take(pa.array(heads[a:b] - heads[a])).combine_chunks()
        yield pa.RecordBatch.from_arrays([*(keys[c].combine_chunks() for c in BLOCK), made], names=[*BLOCK, "data"])
        a = b


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of pixels sorted by block; the last one of a batch waits for the next, where it may go on."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            heads = _heads(rows)
            yield from _built(rows.slice(0, heads[-1]), heads[:-1])
            held = rows.slice(heads[-1])
    if held is not None:
        yield from _built(held, np.zeros(1, np.int64))


def from_pixels(px: DataFrame, meta: DataFrame, size: int = 256) -> DataFrame:
    """Blocks of ``size`` (256, or 512 for the cloud layout) from pixel rows; missing pixels are null in the array.

    Pixels come sorted by block, so that many blocks are made of each Arrow batch; only the pixels of the last one, at most size * size places,
    wait for the next batch. Of pixels given twice the largest value stays.
    """
    cell = px.join(meta.select("raster_id", "width", "height"), "raster_id").withColumns({"cx": F.expr(f"x div {size}").cast("int"), "cy": F.expr(f"y div {size}").cast("int")})
    w, h = F.least(F.lit(size), F.col("width") - F.col("cx") * size).cast("int"), F.least(F.lit(size), F.col("height") - F.col("cy") * size).cast("int")
    cell = cell.withColumns({"w": w, "h": h}).select("raster_id", "band", "cx", "cy", "w", "h", ((F.col("y") % size) * F.col("w") + F.col("x") % size).alias("i"), F.col("v").cast("float").alias("v"))

    band = px.schema["band"].dataType.simpleString()
    parts = int(px.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by their bytes, too few tasks would get all pixels
    sorted_cells = cell.repartition(parts, *BLOCK).sortWithinPartitions(*BLOCK)
    return sorted_cells.mapInArrow(_blocks, f"raster_id string, band {band}, cx int, cy int, w int, h int, data array<float>").withColumn("size", F.lit(size))


def write_raster(px: DataFrame, meta: DataFrame, path: str, layout: str = "tiled") -> None:
    """Blocks by raster and band (256 pixels a side, 512 in the ``cog`` layout) sorted by place, and the meta table beside them.

    A file holds squares of 16 by 16 blocks, so that a large band is written by many tasks.
    """
    size = {"tiled": 256, "cog": 512}[layout]
    chunks = from_pixels(px, meta, size)
    spread = chunks.repartition("raster_id", "band", F.expr("cy div 16"), F.expr("cx div 16")).sortWithinPartitions("raster_id", "band", "cy", "cx")
    spread.write.partitionBy("raster_id", "band").option("compression", "zstd").parquet(f"{path}/chunks")
    meta.write.parquet(f"{path}/meta")


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(meta, chunks); filters on raster_id and band prune folders, filters on cx and cy prune row groups."""
    chunks = spark.read.parquet(f"{path}/chunks").withColumns({"raster_id": F.col("raster_id").cast("string"), "band": F.col("band").cast("int")})
    return spark.read.parquet(f"{path}/meta"), chunks


def inspect_extent(meta: DataFrame) -> DataFrame:
    """raster_id, crs and extent of every raster."""
    return meta.select("raster_id", "crs", extent(F.col("gt"), F.col("width"), F.col("height")).alias("e")).select("raster_id", "crs", "e.*")


def raster_info(meta: DataFrame) -> DataFrame:
    return meta.select("raster_id", "width", "height", "band_count", "gt", "crs")


def band_data(px: DataFrame, band: int) -> DataFrame:
    """The pixels of one band, row by row."""
    return px.filter(F.col("band") == band).orderBy("raster_id", "y", "x")


def write_tensors(tensors: DataFrame, path: str) -> None:
    """Tensors with their shapes, as Parquet."""
    tensors.write.option("compression", "zstd").parquet(path)
