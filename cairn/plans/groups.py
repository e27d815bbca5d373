"""Groups for kernels that take long for few bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData


def spread_groups(df: DataFrame, *keys: str) -> GroupedData:
    """The groups of ``keys`` over all shuffle partitions: by their bytes, adaptive coalescing would put very many small groups into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)
