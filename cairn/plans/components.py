"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.storage import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node that edges lead to) for every node of an edge between two different nodes.

    Each round hangs every neighbour of a node on the smallest one known (large star: larger neighbours; small star: smaller
    ones), which halves path lengths or better; it ends when a round changes nothing, as it must, since every change brings
    some node to a smaller one. Each round is written to the shared folder in place of the one before. The smallest
    neighbours are written too: the join with them then has only shuffles below it, and Spark splits a node that very many others hang on.
    Nodes are numbers; null ends and loops are ignored; an empty table gives none.
    """
    high = F.greatest(F.col(a), F.col(b)).cast("long").alias("u")
    low = F.least(F.col(a), F.col(b)).cast("long").alias("v")
    now = materialise(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high, low).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest.hint("merge"), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        last, now = now, materialise(small.filter("u != v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(last, least)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
