"""Exact top-k search by inner product over a vector-approximation file.

Rows are laid out in blocks. A block keeps the cell of each component, one byte, in a grid of equal cells between its own
extremes. The score of a cell's middle is wrong by no more than half a cell a component, so one product of a query with the cells
bounds all scores of a block from above and below. The scan over the cells keeps what may still be among the k best; over
all blocks, only rows whose upper bound reaches the k-th best lower bound are left, and only of those are exact vectors read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.plans.storage import materialise

CELLS = 256  # cells of a component: one byte
BLOCK_ROWS = 4096
SCAN_ROWS = 64  # queries scored at once
GROUP_ROWS, GROUP_QUERIES = 1 << 18, 1 << 15  # rows and queries that meet in one task, at most


def cells_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component, and the lower edge and width of the cells of each component."""
    low = vectors.min(0)
    width = (vectors.max(0) - low) / CELLS
    code = np.floor((vectors - low) / np.where(width > 0, width, 1)).clip(0, CELLS - 1).astype(np.uint8)
    return code, low, width


def bounds(queries: np.ndarray, code: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, slack): each score lies within the slack of its query from the middle."""
    middle = (queries * width).astype(np.float32) @ code.T.astype(np.float32) + (queries @ (low + width / 2)).astype(np.float32)[:, None]
    size = np.abs(queries) @ (np.abs(low) + CELLS * width)
    # half a cell a component, and what single precision may add up to
    return middle, np.abs(queries) @ (width / 2) + size * (code.shape[1] + 4) * 2.0**-22


def near(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, blocks: list[tuple], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, row, lower, upper) of all rows whose upper bound reaches the k-th best lower bound here; a query is no row of its own.

    ``own`` and ``rows`` are numbers of rows, ``blocks`` the cells with their edges and widths, in the order of ``rows``.
    """
    place = np.argsort(rows)
    for i in range(0, len(queries), SCAN_ROWS):
        asked, mine = queries[i : i + SCAN_ROWS], own[i : i + SCAN_ROWS]
        parts = [bounds(asked, *b) for b in blocks]
        middle = np.concatenate([m for m, _ in parts], axis=1)
        slack = np.repeat(np.column_stack([s for _, s in parts]), [len(b[0]) for b in blocks], axis=1).astype(np.float32)
        lower, upper = middle - slack, middle + slack
        at = np.minimum(np.searchsorted(rows, mine, sorter=place), len(rows) - 1)
        self_ = np.flatnonzero(rows[place[at]] == mine)
        lower[self_, place[at[self_]]] = upper[self_, place[at[self_]]] = -np.inf
        least = np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(asked), -np.inf, np.float32)
        q, r = np.nonzero((upper >= least[:, None]) & (upper > -np.inf))
        yield mine[q], rows[r], lower[q, r].astype(float), upper[q, r].astype(float)


def _blocks(vectors: DataFrame, with_cells: bool) -> DataFrame:
    """(row, v) in blocks of one dimension, as bytes: cells with their edges and widths, or the vectors themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            flat, offsets = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            width = np.diff(offsets)
            for dim in np.unique(width).tolist():
                here = np.flatnonzero(width == dim)
                for i in range(0, len(here), BLOCK_ROWS):
                    part = here[i : i + BLOCK_ROWS]
                    exact = flat[offsets[part][:, None] + np.arange(dim)[None, :] - offsets[0]].reshape(len(part), dim).astype(float)
                    code, low, wide = cells_of(exact) if with_cells else (exact, np.zeros(0), np.zeros(0))
                    yield pa.RecordBatch.from_arrays([pa.array([dim]), *(pa.array([x.tobytes()], pa.binary()) for x in (rows[part], code, low, wide))], names=["dim", "rows", "data", "low", "width"])

    return vectors.mapInArrow(run, "dim long, rows binary, data binary, low binary, width binary")


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * component) as doubles; rows with a null id, vector or component, or one not finite, are left out."""
    parts = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), parts.alias("v"))


def _dealt(blocks: DataFrame, groups: int, others: int, mine: str, theirs: str) -> DataFrame:
    """Each block in one group, to meet every group of the other side."""
    group = F.pmod(F.xxhash64("rows"), F.lit(groups)).cast("int")
    return blocks.withColumn(mine, group).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best candidates of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query itself; ties go to the smaller
    id. Scores are integer inner products (exact below 2^53); vectors of another dimension than the query's are no candidates
    for it, and vectors without components score 0. Rows that ``whole_vectors`` leaves out take no part. Rows that repeat an
    id are rows of their own: each is a query with a list of its own, and candidates for one another. An empty table gives none; columns other than the two named are not read.

    Groups of queries meet groups of rows, a stated query set against all rows; only cells travel there. Of more than k + 1
    equal vectors the others could only come after those with smaller ids, so they are left out of the scan, not of the queries. What the scan leaves,
    about k rows a query and group, is thinned out over all groups before exact vectors are fetched by row.
    """
    whole = materialise(whole_vectors(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()))
    asked = whole.filter(F.col("id") % every == 0)
    # of equal vectors only those with the smallest ids can be among the best of any query
    alike = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("id", "row"))
    targets = materialise(whole.withColumn("alike", alike).filter(F.col("alike") <= k + 1).drop("alike"))
    n, m = targets.count(), asked.count()
    least = math.ceil(math.sqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    r, q = max(least, math.ceil(n / GROUP_ROWS)), max(least, math.ceil(m / GROUP_QUERIES))
    data = _dealt(_blocks(targets.select("row", "v"), True), r, q, "i", "j")
    queries = _dealt(_blocks(asked.select("row", "v"), False), q, r, "j", "i")

    def scan(key, left, right):
        names = ["q", "row", "lower", "upper"]
        dim = key[0].as_py()
        shape = lambda x, kind: np.frombuffer(x, kind).reshape(-1, dim) if dim else None
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 2]
        if left.num_rows and right.num_rows:
            held = [np.frombuffer(x, np.int64) for x in left["rows"].to_pylist()]
            asked = [np.frombuffer(x, np.int64) for x in right["rows"].to_pylist()]
            codes = [shape(x, np.uint8) if dim else np.zeros((len(h), 0), np.uint8) for x, h in zip(left["data"].to_pylist(), held, strict=True)]
            blocks = [(c, np.frombuffer(a), np.frombuffer(b)) for c, a, b in zip(codes, left["low"].to_pylist(), left["width"].to_pylist(), strict=True)]
            exact = np.concatenate([shape(x, float) if dim else np.zeros((len(h), 0)) for x, h in zip(right["data"].to_pylist(), asked, strict=True)])
            found += near(exact, np.concatenate(asked), np.concatenate(held), blocks, k)
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    by = ("dim", "i", "j")
    seen = materialise(data.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(scan, "q long, row long, lower double, upper double"))
    # the k-th best lower bound of each query over all groups
    best = F.slice(F.sort_array(F.collect_list("lower"), asc=False), 1, k)
    limits = seen.groupBy("q").agg(best.alias("best")).select("q", F.when(F.size("best") == k, F.element_at("best", -1)).otherwise(float("-inf")).alias("least"))
    left = seen.join(limits.hint("merge"), "q").filter("upper >= least").select("q", "row")
    exact = left.join(targets.hint("merge").select("row", F.col("id").alias("vec_id"), "v"), "row").join(asked.hint("merge").select(F.col("row").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("w")), "q")
    score = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).cast("long")
    scored = exact.select("q", "query_id", "vec_id", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
