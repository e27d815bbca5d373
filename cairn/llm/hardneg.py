"""Hard negatives of anchors by a vertical scan that reads as few dimensions of as few rows as bounds allow.

Rows lie in columns, one array a dimension. An anchor reads them in descending order of its own magnitudes, so that the products that
move a score most come first. What the dimensions not yet read can add lies between two numbers that follow from the extremes of each column; with
them the scores so far bound the final ones, and rows that cannot be among the wanted ones any more leave the set of candidates. After the last
dimension the scores of those left are exact. One scan finds each anchor's positives; their scores open the windows
of the second, for negatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.plans.storage import materialise

STEP = 8  # dimensions read between two looks at the bounds
BLOCK_ROWS = 1024
GROUP_BYTES = 32 << 20  # vectors of rows, and of anchors, that meet in one task, at most

Narrow = Callable[[np.ndarray, float, float], np.ndarray | None]


class Columns:
    """Rows in the order of label and id, a column a dimension."""

    def __init__(self, row: np.ndarray, ident: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((row, ident, label))
        self.row, self.ident, self.label = row[order], ident[order], label[order]
        self.data = np.ascontiguousarray(vectors[order].T)
        self.low, self.high = (self.data.min(1), self.data.max(1)) if len(row) else (np.zeros(len(self.data)),) * 2

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.label, [label, label + 1]))

    def scan(self, query: np.ndarray, rows: slice, never: np.ndarray | slice, narrow: Narrow) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of those of ``rows``, without ``never``, that ``narrow`` leaves from the scores so far and what may still come."""
        order = np.argsort(-np.abs(query), kind="stable")
        ends = np.sort(np.stack([query * self.low, query * self.high]), axis=0)[:, order]
        rest = ends.sum(1, keepdims=True) - ends.cumsum(1)
        places = np.arange(rows.start, rows.stop)
        score = np.zeros(len(self.row))
        score[never] = -np.inf
        score = score[rows]
        here: slice | np.ndarray = rows
        for i in range(0, len(order), STEP):
            some = order[i : i + STEP]
            score = score + query[some] @ (self.data[some, here] if isinstance(here, slice) else self.data[some[:, None], here])
            kept = narrow(score, *rest[:, min(i + STEP, len(order)) - 1])
            if kept is not None and not kept.all():
                places, score = places[kept], score[kept]
                here = places
        live = score > -np.inf
        return places[live], score[live]


def best_rows(k: int) -> Narrow:
    """Keep what may be among the k highest."""

    def narrow(score: np.ndarray, least: float, most: float) -> np.ndarray | None:
        return score + most >= np.partition(score, -k)[-k] + least if len(score) > k else None

    return narrow


def in_windows(windows: list[tuple[int, int]], k: int) -> Narrow:
    """Keep what may be among the k highest of those that end in some window."""

    def narrow(score: np.ndarray, least: float, most: float) -> np.ndarray:
        kept = np.zeros(len(score), bool)
        for low, high in windows:
            a, b = low - most, high - least
            if low - least <= high - most:
                sure = score[(score >= low - least) & (score <= high - most)]
                if len(sure) >= k:
                    a = max(a, np.partition(sure, -k)[-k] + least - most)
            kept |= (score >= a) & (score <= b)
        return kept

    return narrow


def highest(score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones those with the smallest ids, in that order."""
    if len(score) > k:
        least = np.partition(score, -k)[-k]
        ties = np.flatnonzero(score == least)
        need = k - int((score > least).sum())
        if len(ties) > need:
            ties = ties[np.argpartition(ident[ties], need - 1)[:need]]
        some = np.concatenate([np.flatnonzero(score > least), ties])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ident[some], -score[some]))]


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores from ``low`` to ``high`` percent of one."""
    return -(-low * score // 100), high * score // 100


def positives_of(held: Columns, row: int, label: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best other rows of the label."""
    mine = held.of_label(label)
    places, score = held.scan(query, mine, np.flatnonzero(held.row[mine] == row) + mine.start, best_rows(k))
    top = highest(score, held.ident[places], k)
    return places[top], score[top]


def negatives_of(held: Columns, label: int, query: np.ndarray, windows: list[tuple[int, int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each window, (places, scores) of the k best rows of other labels in it."""
    places, score = held.scan(query, slice(0, len(held.row)), held.of_label(label), in_windows(windows, k))
    for low, high in windows:
        fits = np.flatnonzero((score >= low) & (score <= high))
        top = fits[highest(score[fits], held.ident[places[fits]], k)]
        yield places[top], score[top]


# ---------------------------------------------------------------- over a table


def _blocks(vectors: DataFrame, wanted: int = 0) -> DataFrame:
    """(row, id, label, v) in blocks of one dimension, as bytes; with ``wanted``, and the first scores of the array ``windows``."""
    names = ["dim", "rows", "ids", "labels", "data", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [batch.column(i).to_numpy() for i in range(3)]
            flat, offsets = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
            scores = np.full((batch.num_rows, wanted), np.nan)
            if wanted:
                for i, found in enumerate(batch.column(4).to_pylist()):
                    scores[i, : len(found)] = found
            width = np.diff(offsets)
            for dim in np.unique(width).tolist():
                at = np.flatnonzero(width == dim)
                for i in range(0, len(at), BLOCK_ROWS):
                    part = at[i : i + BLOCK_ROWS]
                    exact = flat[offsets[part][:, None] + np.arange(dim)[None, :] - offsets[0]].astype(float)
                    data = [*(h[part].astype(np.int64) for h in heads), exact, scores[part]]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=names)

    columns = ["row", "id", "label", "v", *(["windows"] if wanted else [])]
    return vectors.select(columns).mapInArrow(run, "dim long, rows binary, ids binary, labels binary, data binary, windows binary")


def _dealt(blocks: DataFrame, groups: int, others: int, mine: str, theirs: str) -> DataFrame:
    """Each block in one group, to meet every group of the other side."""
    group = F.pmod(F.xxhash64("rows"), F.lit(groups)).cast("int")
    return blocks.withColumn(mine, group).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def _held(table: pa.Table, dim: int, wanted: int = 0) -> tuple[np.ndarray, ...]:
    """Rows, ids, labels, vectors and windows of a group of blocks."""
    whole = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    rows = whole("rows", np.int64)
    return rows, whole("ids", np.int64), whole("labels", np.int64), whole("data", float).reshape(len(rows), dim), whole("windows", float).reshape(len(rows), wanted)


def _met(rows: DataFrame, anchors: DataFrame, groups: tuple[int, int], wanted: int, find: Callable[[Columns, int, int, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """anchor (its row), which, id, score of all that ``find`` gives where a group of anchors meets a group of rows."""

    def scan(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        dim, out = key[0].as_py(), [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int64),) * 2]
        if left.num_rows and right.num_rows:
            held = Columns(*_held(left, dim)[:4])
            for row, _, label, query, scores in zip(*_held(right, dim, wanted), strict=True):
                for which, places, score in find(held, row, label, query, scores[~np.isnan(scores)]):
                    out.append((np.full(len(places), row), np.full(len(places), which), held.ident[places], score.astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor", "which", "id", "score"])

    r, q = groups
    by = ("dim", "i", "j")
    left, right = _dealt(_blocks(rows), r, q, "i", "j").groupBy(*by), _dealt(_blocks(anchors, wanted), q, r, "j", "i").groupBy(*by)
    return left.cogroup(right).applyInArrow(scan, "anchor long, which long, id long, score long")


def hard_negatives(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score: the hardest negatives of each anchor and positive.

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives are the ``positives`` best other rows of its label, its
    negatives for each the ``negatives`` best rows of other labels that score ``low`` to ``high`` percent of the positive. A score is
    the inner product of floor(scale * component), exact below 2^53; ties go to the smaller id. Rows with a null id, label, vector
    or component, or one not finite, take no part, and vectors of another dimension than the anchor's are not compared with it. Rows
    that repeat an id are rows of their own: each is an anchor with lists of its own. Vectors without components score 0. An empty table
    gives none. Columns other than the three named are not read.

    Groups of anchors meet groups of rows, both bounded in bytes: a stated query set against all rows. Each task returns at most
    ``positives`` (times ``negatives``) rows an anchor, so no label, vector or window is a hot key, however many rows have it.
    """
    part = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    whole = whole.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), part.alias("v"))
    whole = materialise(whole)
    anchors = whole.filter(F.col("id") % every == 0)
    sizes = [t.agg(F.sum(8 * F.size("v"))).first()[0] or 0 for t in (whole, anchors)]
    least = math.ceil(math.sqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    groups = tuple(max(least, math.ceil(size / GROUP_BYTES)) for size in sizes)

    def near(held: Columns, row: int, label: int, query: np.ndarray, _: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        yield 0, *positives_of(held, row, label, query, positives)

    def far(held: Columns, _: int, label: int, query: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        windows = [window_of(int(s), low, high) for s in scores]
        for which, (places, score) in enumerate(negatives_of(held, label, query, windows, negatives)):
            yield which, places, score

    def first(found: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("anchor", "which").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    found = materialise(first(_met(whole, anchors, groups, 0, near), positives).select("anchor", (F.col("rank") - 1).cast("long").alias("which"), "id", "score"))
    lists = found.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("which", "score"))), lambda x: x["score"].cast("double")).alias("windows"))
    asked = materialise(anchors.join(lists.hint("merge"), F.col("row") == F.col("anchor")).drop("anchor"))
    hard = first(_met(whole, asked, groups, positives, far), negatives)
    named = hard.join(found.select("anchor", "which", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).hint("merge"), ["anchor", "which"])
    named = named.join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")).hint("merge"), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
