"""Quality classifier: histogram gradient-boosted trees over statistics of the text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.bytetext import IS_DARK, LOWER, Block, encoded, lookup, slices
from cairn.llm.decontamination import word_hashes

TRAIN_ROWS = 20_000  # labelled rows that the trees are fitted on, at most
BINS, ROUNDS, DEPTH, RATE, L2, MIN_ROWS = 64, 60, 3, 0.15, 1.0, 5

_KINDS = {
    "upper": lookup(lambda b: 65 <= b <= 90),
    "lower": lookup(lambda b: 97 <= b <= 122),
    "digit": lookup(lambda b: 48 <= b <= 57),
    "space": lookup(lambda b: b in (32, 9)),
    "line": lookup(lambda b: b == 10),
    "stop": lookup(lambda b: chr(b) in ".?;:"),
    "comma": lookup(lambda b: b == 44),
    "mark": lookup(lambda b: chr(b) in "#$%&*|!<>{}[]~^=_+@/\\"),
    "other": lookup(lambda b: b >= 128),
}
FEATURES = ["log_bytes", *_KINDS, "log_words", "word_bytes", "longest_word", "new_words", "new_pairs", "new_triples", "common_word", "capitals", "line_words"]


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text, all of it read; an empty text has zeros."""
    block = Block(texts)
    size = (block.end - block.at).astype(float)
    some = np.maximum(size, 1)
    columns = [np.log1p(size)]
    edges = np.append(block.at, len(block.data))
    counts = {}
    for name, kind in _KINDS.items():
        counts[name] = np.add.reduceat(kind[block.data], edges[:-1], dtype=np.int64)
        columns.append(counts[name] / some)
    begin, stop, first = block.words(IS_DARK)
    n = np.diff(first).astype(float)
    words = np.maximum(n, 1)
    length = (stop - begin).astype(float)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    total = np.bincount(owner, length, len(texts))
    longest = np.zeros(len(texts))
    np.maximum.at(longest, owner, length)
    hashes = word_hashes(LOWER[block.data], begin, stop)

    def fresh(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of different values of each text, and how often its commonest occurs."""
        key = values * np.uint64(0x9E3779B97F4A7C15) + of.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        order = np.argsort(key)
        runs = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(key) else np.array([], int)
        most = np.zeros(len(texts))
        np.maximum.at(most, of[order[runs]], np.diff(np.append(runs, len(key))))
        return np.bincount(of[order[runs]], minlength=len(texts)), most

    single, most = fresh(hashes, owner)
    columns += [np.log1p(n), total / words, longest, single / words]
    for k in (2, 3):
        same = owner[k - 1 :] == owner[: len(owner) - k + 1] if len(owner) >= k else np.array([], bool)
        if same.any():
            mixed = hashes[k - 1 :].copy()
            for j in range(1, k):
                mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + hashes[k - 1 - j : len(hashes) - j]
            columns.append(fresh(mixed[same], owner[k - 1 :][same])[0] / np.maximum(n - k + 1, 1))
        else:
            columns.append(np.zeros(len(texts)))
    capital = np.bincount(owner, _KINDS["upper"][block.data[begin]], len(texts)) if len(begin) else np.zeros(len(texts))
    columns += [most / words, capital / words, n / (counts["line"] + 1)]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Complete trees of one depth, flattened: node i of a tree goes on to 2i+1, or 2i+2 where the feature exceeds the threshold."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        trees, rows = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        margin = self.start + (self.leaf[trees, node - (2**depth - 1)].sum(1) if self.leaf.size else np.zeros(len(x)))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Boost trees on binned features under logistic loss; equal rows in another order give the same trees up to rounding.

    Without labelled rows the score is 0.5 for all, with one label only it is near that label.
    """
    empty = np.zeros((0, 1))
    if not len(y):
        return Trees(0.0, empty.astype(int), empty, empty)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    width = x.shape[1]
    flat = binned + np.arange(width) * BINS
    margin = np.full(len(y), start)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((rounds, inner), int), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), int)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                here = np.flatnonzero(node == k)
                if len(here) < 2 * MIN_ROWS:
                    continue
                cells = flat[here].ravel()
                hist = [np.bincount(cells, np.repeat(v[here], width), width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h, np.ones(len(y)))]
                gl, hl, nl = hist
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = -1
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, k], threshold[t, k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
        margin = margin + leaf[t][at]
    return Trees(start, feature, threshold, leaf)


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls in the fold kept from training; never null."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, those with the smallest hash of their id.

    Null labels are left out; an id with two different labels counts with each, and rows that repeat an id count among the
    ``rows`` too. Only features come to the driver.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").distinct()
    chosen = known.filter(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    # at most ``rows`` ids: the one table small enough by its own limit to be broadcast
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(list(features(texts[a:b])))], names=["_id", "_y", "x"])

    found = sample.select("_id", "_text", "_y").mapInArrow(run, f"_id {sample.schema['_id'].dataType.simpleString()}, _y int, x array<double>").orderBy(F.xxhash64("_id"), "_id", "_y", "x").limit(rows).toPandas()
    found = found.sort_values("_id", kind="stable")
    return fit(np.array(found["x"].tolist()).reshape(-1, len(FEATURES)), found["_y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score to every row, all its columns kept. A narrow job."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(place))
            for a, b in slices(texts):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(trees.score(features(texts[a:b])))], names=[*part.schema.names, score_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{score_col}` double")


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, rows: int = TRAIN_ROWS
) -> DataFrame:
    """id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) for every row.

    Scores depend on the text alone; null counts as empty, and an empty text is scored like any other.
    Repeated rows each give their row; an empty table gives none; without labels every score is 0.5. A very long text is measured
    whole, in one task; further columns are not read, whatever they are called.
    """
    trees = train(docs, labels, id_col, text_col, label_col, rows)
    slim = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    scored = score(slim, trees, "_text")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
