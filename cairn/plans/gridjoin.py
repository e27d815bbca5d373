"""Pairs of overlapping boxes by equi-joins on the cells of grids of growing size.

A box lies on the level whose cells are as large as its longer side, so it covers at most four cells there and on any coarser
level. Two boxes meet on the coarser one's own level; one side of each join therefore holds only boxes of that very level, and
boxes far larger than the others do not spread over many cells. A pair is kept in one cell only, the one that holds the lower
left corner of its overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.storage import materialise

_BOX = ("min_x", "min_y", "max_x", "max_y")


def _levelled(boxes: DataFrame) -> DataFrame:
    """The boxes with their levels, written: they are read in six places, and a filter on what is still an expression over rings would be
    worked out below the shuffle that deals the rows, in the few tasks that scan a small file."""
    side = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1e-9))
    written = materialise(boxes.select("id", *_BOX).withColumn("level", F.ceil(F.log2(side)).cast("int")))
    return written.filter("min_x is not null and min_y is not null")


def _celled(boxes: DataFrame) -> DataFrame:
    size = F.pow(F.lit(2.0), F.col("at"))
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    over = boxes.withColumn("cx", F.explode(F.sequence(cell("min_x"), cell("max_x"))))
    return over.withColumn("cy", F.explode(F.sequence(cell("min_y"), cell("max_y"))))


def box_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id) of all pairs whose boxes overlap or touch. Inputs: id, min_x, min_y, max_x, max_y; null boxes take no part.

    A table paired with itself is given twice as the same object, and written once. The levels in use, at most a few dozen numbers, are all that comes to the driver.
    """
    named = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", *_BOX)), "at", "cx", "cy")
    left = _levelled(a)
    a, b = left, left if b is a else _levelled(b)
    levels = [r["level"] for r in a.select("level").union(b.select("level")).distinct().collect()]

    def own(df: DataFrame) -> DataFrame:
        return _celled(df.withColumn("at", F.col("level")))

    def coarser(df: DataFrame, least: int) -> DataFrame:
        """The box on every level in use that is at least ``least`` above its own."""
        every = F.array(*(F.lit(x) for x in levels)) if levels else F.array().cast("array<int>")
        return _celled(df.withColumn("at", F.explode(F.filter(every, lambda x: x >= F.col("level") + least))))

    found = None
    for left, right in ((own(a), coarser(b, 0)), (coarser(a, 1), own(b))):
        met = named(left, "a").join(named(right, "b"), ["at", "cx", "cy"])
        overlap = (F.col("a_min_x") <= F.col("b_max_x")) & (F.col("b_min_x") <= F.col("a_max_x")) & (F.col("a_min_y") <= F.col("b_max_y")) & (F.col("b_min_y") <= F.col("a_max_y"))
        size = F.pow(F.lit(2.0), F.col("at"))
        home = (F.floor(F.greatest("a_min_x", "b_min_x") / size) == F.col("cx")) & (F.floor(F.greatest("a_min_y", "b_min_y") / size) == F.col("cy"))
        part = met.filter(overlap & home).select("a_id", "b_id")
        found = part if found is None else found.unionByName(part)
    return found
