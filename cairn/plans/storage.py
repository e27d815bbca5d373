"""Intermediate tables in the folder that the driver and all executors share.

Cutting lineage needs a place every executor can read again after one of them is lost:
the session's ``spark.checkpoint.dir``. Only in local mode, where it is unset (tests), is a local folder made.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}

#: What a byte of a compressed file may come to in rows: constants and sorted numbers shrink to a hundredth and less.
FILE_FACTOR = 40


def sized_as_rows(spark: SparkSession) -> None:
    """Let Spark take compressed files as ``FILE_FACTOR`` times their size when it chooses what to broadcast.

    By the bare size of the files, tables of millions of rows pass for small ones and go through the driver whole. What turns out
    small is broadcast all the same, by the size its shuffle measures.
    """
    spark.conf.set("spark.sql.sources.fileCompressionFactor", str(FILE_FACTOR))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, local mode gets one of its own and a cluster an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
    return configured or sc.getCheckpointDir()


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet; what is written there is deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/cairn-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and read it back.

    Smaller than ``checkpoint()``, which keeps uncompressed rows, and as safe against lost executors.
    ``discard`` deletes the table once nothing reads it any more; the others go when the interpreter ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialise`` that no later job reads, not even to make a lost partition again."""
    for table in tables:
        delete(getattr(table, "_cairn_path", ""))


def delete(path: str) -> None:
    """Delete what was written to a path of ``fresh_path``; others are left alone."""
    spark = _written.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):  # a session that is gone took its folder along, or leaves it to its owner
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for path in list(_written):
        delete(path)
