"""Merkle manifest of a table, and proofs for many leaves at once by octopus multiproof.

The leaves of a group are numbered in order, sixteen consecutive nodes become one until one is left, and the tops of all
groups, in order, become one root in the same way. Nodes are addressed by (tree, level, place). A tree climbs several levels in a task, over
stretches of places, so that each level is neither a job of its own nor in one task.

For proofs, each stretch of wanted leaves works out which nodes its proofs need that do not follow from its own leaves or from
nodes already needed: the union of all proofs less everything shared. These coordinates are fetched by one join, the nodes in between are
derived where the leaves are, and the proof of each leaf is written out from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.ranks import numbered
from cairn.plans.storage import materialise

FAN = 16  # nodes that become one
STEPS = 3  # levels climbed in one task, so a task holds FAN ** STEPS nodes of a tree
STRETCH = FAN**STEPS
OWN = {"tree", "place", "level", "digest", "row", "part", "n", "spot", "top", "subroot", "root", "proof", "_all", "_part", "_at", "_first", "_before"}  # names of columns made here
TOP = "r"  # the tree over the groups; those of groups are "" (null) or begin with s


def node(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """Number of nodes of each level, from the leaves to the one on top."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def climb(digests: list[str], levels: int, whole: bool) -> Iterator[list[str]]:
    """The levels above consecutive nodes that begin a run; a whole tree ends with one node."""
    for _ in range(levels):
        if whole and len(digests) == 1:
            return
        digests = [node("".join(digests[i : i + FAN])) for i in range(0, len(digests), FAN)]
        yield digests


def absent(places: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(level, places) of the nodes that the proofs of these leaves need and that do not follow from them, each once."""
    own = np.unique(places)
    for level, size in enumerate(level_sizes(n)[:-1]):
        parents = np.unique(own // FAN)
        run = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        yield level, np.setdiff1d(run[run < size], own, assume_unique=True)
        own = parents


class Proofs:
    """Proofs of some leaves of one tree, written out from the leaves' digests and the nodes that ``absent`` named."""

    def __init__(self, leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> None:
        self.sizes, own = level_sizes(n), leaves
        known = {(0, p): d for p, d in leaves.items()} | fetched
        for level, size in enumerate(self.sizes[:-1]):
            own = {p: node("".join(known[level, i] for i in range(p * FAN, min(p * FAN + FAN, size)))) for p in {p // FAN for p in own}}
            known |= {(level + 1, p): d for p, d in own.items()}
        self.known, self.top = known, known[len(self.sizes) - 1, 0]
        self.cut: dict[tuple[int, int], tuple[str, str]] = {}

    def __call__(self, place: int) -> list[tuple[str, str]]:
        """(digests before, digests after) in the run of each node on the way from a leaf to the top."""
        out = []
        for level, size in enumerate(self.sizes[:-1]):
            here = (level, place)
            if here not in self.cut:
                first = place - place % FAN
                side = lambda a, b, level=level: "".join(self.known[level, i] for i in range(a, b))
                self.cut[here] = side(first, place), side(place + 1, min(first + FAN, size))
            out.append(self.cut[here])
            place //= FAN
        return out


# ---------------------------------------------------------------- columns


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value as - if null, else its number of UTF-8 bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in texts)), 256)


def proof_digest(proof: str = "proof") -> Column:
    """Digest of all siblings of a proof, level by level."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda p: F.array(p["before"], p["after"]))), ""), 256)


def fold(leaf: Column, proof: str = "proof") -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]), 256))


# ---------------------------------------------------------------- over a table


@dataclass
class Manifest:
    """``leaves``: the rows given with tree and place; ``nodes``: tree, level, place, digest, leaves included; ``groups``: tree, n, top, place."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    digest_col: str


def _stretch_climber(level: int):
    """Nodes of the STEPS levels above one stretch of the nodes of a tree at ``level``."""

    def run(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
        tree, stretch = (k.as_py() for k in key)
        whole = stretch == 0 and held.num_rows < STRETCH  # places are gapless: the tree has no further stretch
        ups = climb(held.sort_by("place")["digest"].to_pylist(), STEPS, whole)
        rows = [(tree, level + k, stretch * FAN ** (STEPS - k) + i, d) for k, up in enumerate(ups, 1) for i, d in enumerate(up)]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "level", "place", "digest"])

    return run


def _climbed(leaves: DataFrame) -> DataFrame:
    """tree, level, place, digest of all nodes above the leaves (tree, place, digest); one written table for every STEPS levels."""
    now, out, level = leaves, None, 0
    while True:
        stretches = now.select("tree", "place", "digest").groupBy("tree", F.floor(F.col("place") / STRETCH).cast("long").alias("stretch"))
        up = materialise(stretches.applyInArrow(_stretch_climber(level), "tree string, level int, place long, digest string"))
        out, level = up if out is None else out.unionByName(up), level + STEPS
        now = up.filter(F.col("level") == level)
        if now.filter("place > 0").isEmpty():
            return out


def build_manifest(rows: DataFrame, group_col: str = "source", order_col: str = "doc_id", digest_col: str = "leaf") -> Manifest:
    """Trees over the rows of each group, in the order of ``order_col``, and one tree over the groups, null first and then bytewise.

    Rows come with their digests. Those that repeat an ``order_col``, or have none (they come first), follow in the order of their
    digests; equal rows are leaves of their own. An empty table has no tree. Other columns are carried along, but for those whose
    names (``OWN``) the operator needs, which are left out. Only digests travel: however long a text, its row is as short as any.
    """
    rows = rows.select(*{c: None for c in (group_col, order_col, digest_col)}, *(c for c in rows.columns if c not in (group_col, order_col, digest_col) and c.lower() not in OWN))
    tree = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("s"), F.col(group_col).cast("string")))
    leaves = materialise(rows.withColumns({"tree": tree, "row": F.monotonically_increasing_id()}))
    leaves = materialise(numbered(leaves, ["tree"], [F.col(order_col).asc_nulls_first(), F.col(digest_col), F.col("row")], "place").drop("row"))
    flat = leaves.select("tree", F.lit(0).alias("level"), "place", F.col(digest_col).alias("digest"))
    nodes = flat.unionByName(_climbed(flat))
    tops = nodes.filter("place = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("top"))
    counted = leaves.groupBy("tree").agg(F.count("*").alias("n")).join(tops.hint("merge"), "tree").withColumn("_all", F.lit(TOP))
    groups = materialise(numbered(counted, ["_all"], ["tree"], "place").drop("_all"))
    over = groups.select(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), "place", F.col("top").alias("digest"))
    return Manifest(leaves, nodes.unionByName(over).unionByName(_climbed(over)), groups, digest_col)


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The ``wanted`` rows of the leaves (all, without) with subroot, root and proof: (before, after) for each level up to the root.

    One stretch of a tree is proved in a task, up to STRETCH leaves, with the nodes it needs beside them; a node on top that all
    stretches ask for is a skewed key of a join over a written table, which Spark splits.
    """
    wanted = manifest.leaves if wanted is None else wanted
    total = manifest.groups.count()
    part = F.floor(F.col("place") / STRETCH).cast("long")
    names = ["tree", "part", "n", "spot", "of", "level", "place"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                head = (x["tree"], x["part"], x["n"], x["spot"])
                rows.append((*head, None, None, None))  # a stretch that needs nothing still learns where it stands
                for of, places, n in ((x["tree"], np.array(x["places"]), x["n"]), (TOP, np.array([x["spot"]]), total)):
                    rows += [(*head, of, level, p) for level, found in absent(places, n) for p in found.tolist()]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    stretches = wanted.groupBy("tree", part.alias("part")).agg(F.collect_set("place").alias("places"))
    stretches = stretches.join(manifest.groups.select("tree", "n", F.col("place").alias("spot")).hint("merge"), "tree")
    asked = materialise(stretches.mapInArrow(ask, "tree string, part long, n long, spot long, of string, level int, place long"))
    fetched = asked.join(manifest.nodes.withColumnRenamed("tree", "of").hint("merge"), ["of", "level", "place"], "left")

    digest_col, kept = manifest.digest_col, [c for c in wanted.columns if c not in ("tree", "place")]
    proof = pa.struct([("before", pa.string()), ("after", pa.string())])

    def write(held: pa.Table, nodes: pa.Table) -> pa.Table:
        tree = held["tree"][0].as_py()
        n, spot = nodes["n"][0].as_py(), nodes["spot"][0].as_py()
        by_tree: dict[str, dict[tuple[int, int], str]] = {tree: {}, TOP: {}}
        for of, level, place, digest in zip(*(nodes[c].to_pylist() for c in ("of", "level", "place", "digest")), strict=True):
            if of is not None:
                by_tree[of][level, place] = digest
        places = held["place"].to_pylist()
        below = Proofs(dict(zip(places, held[digest_col].to_pylist(), strict=True)), by_tree[tree], n)
        above = Proofs({spot: below.top}, by_tree[TOP], total)
        rest = above(spot)
        before, after, ends = [], [], [0]
        for p in places:
            steps = below(p) + rest
            before += [b for b, _ in steps]
            after += [a for _, a in steps]
            ends.append(len(before))
        told = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(proof))
        columns = [held[c] for c in kept] + [pa.array([x] * len(places), pa.string()) for x in (below.top, above.top)]
        return pa.table([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), told)], names=[*kept, "subroot", "root", "proof"])

    schema = ", ".join([f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in kept] + ["subroot string, root string, proof array<struct<before: string, after: string>>"])
    one = wanted.withColumn("part", part).groupBy("tree", "part")
    return one.cogroup(fetched.groupBy("tree", "part")).applyInArrow(write, schema)
