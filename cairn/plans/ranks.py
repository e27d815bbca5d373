"""Numbers in order without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.plans.storage import materialise


def _before(of: str, keys: list[str], by: str) -> Column:
    return F.coalesce(F.sum(of).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def running_total(counts: DataFrame, keys: list[str], bucket: str, of: str, name: str, width: int = 1024) -> DataFrame:
    """Add ``name``: the sum of ``of`` in the buckets before, within ``keys``. Buckets are whole numbers.

    In two steps: within stretches of ``width`` buckets, and over the stretches, so that no task meets all buckets of a key.
    """
    counts = materialise(counts.withColumn("_stretch", F.floor(F.col(bucket) / width).cast("long")))
    stretches = counts.groupBy(*keys, "_stretch").agg(F.sum(of).alias("_sum"))
    far = stretches.withColumn("_far", _before("_sum", keys, "_stretch")).drop("_sum")
    near = counts.withColumn("_near", _before(of, [*keys, "_stretch"], bucket))
    return near.join(far, [*keys, "_stretch"]).withColumn(name, F.col("_near") + F.col("_far")).drop("_stretch", "_near", "_far")


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2 ... within each value of ``keys`` in the given order.

    Rows are dealt by range and sorted; a row's number is its place in its partition plus what its key has in the partitions before.
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = materialise(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    parts = dealt.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    parts = parts.withColumn("_before", _before("_n", keys, "_part")).drop("_n")
    return dealt.join(parts, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")
