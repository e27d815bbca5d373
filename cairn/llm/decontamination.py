"""Benchmark decontamination: multi-pattern search over words after Wu and Manber.

Windows of benchmark words are the patterns and words the symbols. A cursor stands on the last word of a possible
occurrence. The hash of the block of words that ends there looks up how far the cursor may move without missing one; where
that is 0, the block hash selects a bucket of windows and the words themselves are compared.

The tables that every task holds grow with the number of windows up to a fixed size: the shifts, and a bit for each block hash that ends a window. The buckets
are rows of a table, as many as the benchmark has windows; what the cursors stop at is joined with them by block hash and
compared there. So nothing but the bounded tables passes through the driver, however large the benchmark is; one that fills them
makes the cursors stop more often, and changes no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.bytetext import LOWER, Block, encoded, slices
from cairn.plans.storage import materialise

WINDOW = 13  # words
BLOCK = 3  # words of a shift block
STRIDE = 256  # cursor positions scanned by one cursor
TABLE_BITS, MOST_BITS = 20, 22  # least and most slots of the shifts of one window length; 2^(TABLE_BITS + 3) bits mark the block hashes that end a window


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses."""
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)


def word_hashes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word of lower-cased bytes, the same wherever the word stands."""
    up, down = _powers(1 << max(10, math.ceil(math.log2(len(data) + 1))))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    mixed = (sums[stop] - sums[begin]) * down[begin]
    return mixed ^ (mixed >> np.uint64(29))


def block_hash(hashes: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each place."""
    out = hashes[last]
    for i in range(1, size):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + hashes[last - i]
    return out ^ (out >> np.uint64(31))


@dataclass
class ShiftTables:
    """Tables of fixed size for all windows of one length."""

    length: int
    bits: int
    shift: np.ndarray
    ends: np.ndarray  # bits, 64 a number

    @property
    def block(self) -> int:
        return min(BLOCK, self.length)

    def stops(self, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the last word, and block hash, wherever a window may end."""
        counts = np.diff(first)
        starts = [np.arange(a + self.length - 1, a + n, STRIDE) for a, n in zip(first[:-1].tolist(), counts.tolist(), strict=True) if n >= self.length]
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        if starts:
            cursor = np.concatenate(starts)
            limit = np.minimum(cursor + STRIDE, first[np.searchsorted(first, cursor, side="right")])
            while len(cursor):
                key = block_hash(hashes, cursor, self.block)
                jump = self.shift[slot_of(key, self.bits)].astype(np.int64)
                stand = np.flatnonzero(jump == 0)
                if len(stand):
                    word, bit = end_bit(key[stand], self.bits)
                    stand = stand[self.ends[word] >> bit & np.uint64(1) > 0]
                    found.append((cursor[stand], key[stand]))
                cursor = cursor + np.maximum(jump, 1)
                live = cursor < limit
                cursor, limit = cursor[live], limit[live]
        at, keys = (np.concatenate(c) for c in zip(*found, strict=True))
        return at, keys


def slot_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def end_bit(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and bit that mark a block hash, from other bits of it than its slot."""
    high = key >> np.uint64(64 - bits - 3)
    return (high >> np.uint64(6)).astype(np.int64), high & np.uint64(63)


def _windows(window: int):
    """(item, text) to its different windows: length, block hash at the end, the words with single spaces, item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            for item, text in zip(items, encoded(batch.column(1)), strict=True):
                block = Block([text])
                begin, stop, _ = block.words()
                if not len(begin):
                    continue
                lowered = LOWER[block.data]
                hashes, raw = word_hashes(lowered, begin, stop), lowered.tobytes()
                words = [raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                size = min(window, len(words))
                last = np.arange(size - 1, len(words))
                said = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
                key = block_hash(hashes, last, min(BLOCK, size)).view(np.int64)
                for i in range(0, len(said), 50_000):
                    n = len(said[i : i + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, size, np.int32)), pa.array(key[i : i + n]), pa.array(said[i : i + n], pa.binary()), pa.array([item] * n, pa.string())], names=["size", "key", "said", "item"]
                    )

    return run


def _table_rows(table_bits: int):
    """(size, said) to rows of the tables: shifts (size, slot, shift) and marked bits (size, number, bits), the other columns null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts = batch.column(0).to_numpy(), encoded(batch.column(1))
            for size in np.unique(sizes).tolist():
                block = Block([texts[i] for i in np.flatnonzero(sizes == size).tolist()])
                begin, stop, first = block.words()
                hashes = word_hashes(block.data, begin, stop)
                width = min(BLOCK, size)
                slots, shifts = [], []
                for end in range(width - 1, size):
                    key = block_hash(hashes, first[:-1] + end, width)
                    slots.append(slot_of(key, table_bits))
                    shifts.append(np.full(len(key), size - 1 - end, np.int32))
                slot, shift = np.concatenate(slots), np.concatenate(shifts)
                order = np.lexsort((shift, slot))
                lead = order[np.append(True, np.diff(slot[order]) != 0)]
                word, bit = end_bit(key, table_bits)
                number, inverse = np.unique(word, return_inverse=True)
                bits = np.zeros(len(number), np.uint64)
                np.bitwise_or.at(bits, inverse, np.uint64(1) << bit)
                for place, shift_of, marked in ((slot[lead], pa.array(shift[lead]), pa.nulls(len(lead), pa.int64())), (number, pa.nulls(len(number), pa.int32()), pa.array(bits.view(np.int64)))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), size, np.int32)), pa.array(place.astype(np.int64)), shift_of, marked], names=["size", "place", "shift", "bits"])

    return run


def build_tables(windows: DataFrame, bits_of_slots: int = TABLE_BITS) -> list[ShiftTables]:
    """Tables by window length from the rows of ``_windows``; at most a row for each slot and each number of bits comes to the driver."""
    rows = windows.select("size", "said").distinct().mapInArrow(_table_rows(bits_of_slots), "size int, place long, shift int, bits long")
    found = rows.groupBy("size", "place", F.col("shift").isNull().alias("marks")).agg(F.min("shift").alias("shift"), F.bit_or("bits").alias("bits")).toArrow()
    size, place, marks = (found[c].to_numpy() for c in ("size", "place", "marks"))
    shift, bits = found["shift"].fill_null(0).to_numpy(), found["bits"].fill_null(0).to_numpy().view(np.uint64)
    out = []
    for n in np.unique(size).tolist():
        table = ShiftTables(n, bits_of_slots, np.full(1 << bits_of_slots, n - min(BLOCK, n) + 1, np.uint8), np.zeros(1 << max(0, bits_of_slots - 3), np.uint64))
        mine = (size == n) & ~marks
        table.shift[place[mine]] = shift[mine]
        table.ends[place[(size == n) & marks]] = bits[(size == n) & marks]
        out.append(table)
    return out


def _stops(shared):
    """(id, text) to id, words, and for each place where a window may end its length, block hash, words and number of the last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                block = Block(texts[a:b])
                begin, stop, first = block.words()
                lowered = LOWER[block.data]
                hashes, raw = word_hashes(lowered, begin, stop), lowered.tobytes()
                spots: list[list[dict]] = [[] for _ in range(b - a)]
                for table in tables:
                    at, keys = table.stops(first, hashes)
                    for last, key, doc in zip(at.tolist(), keys.view(np.int64).tolist(), (np.searchsorted(first, at, side="right") - 1).tolist(), strict=True):
                        span = slice(last - table.length + 1, last + 1)
                        said = b" ".join([raw[x:y] for x, y in zip(begin[span].tolist(), stop[span].tolist(), strict=True)])
                        spots[doc].append({"size": table.length, "key": key, "said": said, "last": last - int(first[doc])})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(spots, _SPOTS)], names=["id", "n_words", "spots"])

    return run


_SPOTS = pa.list_(pa.struct([("size", pa.int32()), ("key", pa.int64()), ("said", pa.binary()), ("last", pa.int64())]))


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _digest(c: str) -> list[Column]:
    """Two hashes of a value that stand for it in joins."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def _grouped(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each window once with the number of the set of items that have it, and the items of each number: both written.

    However many items share a text, a place in a document meets one row.
    """
    sets = windows.groupBy("size", "key", "said").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets = materialise(sets.withColumn("of", F.sha2(F.concat_ws(",", F.transform("items", lambda i: F.concat(F.octet_length(i).cast("string"), F.lit(":"), i))), 256)))
    return sets.select("size", "key", "said", "of"), sets.select("of", "items").dropDuplicates(["of"])


def _searched(keyed: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, table_bits: int | None = None) -> DataFrame:
    """(id, text) to one row each: id, n_words, n_hit, n_items, items."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    windows = materialise(items.mapInArrow(_windows(window), "size int, key long, said binary, item string").distinct())
    grouped, sets = _grouped(windows)
    if table_bits is None:  # a few slots for each block of a window, so that most of them stay empty
        table_bits = min(MOST_BITS, max(TABLE_BITS, math.ceil(math.log2(4 * window * max(1, grouped.count())))))
    tables = keyed.sparkSession.sparkContext.broadcast(build_tables(grouped, table_bits))
    kind = keyed.schema["id"].dataType.simpleString()
    spotted = keyed.mapInArrow(_stops(tables), f"id {kind}, n_words long, spots array<struct<size:int,key:long,said:binary,last:long>>")
    spotted = materialise(spotted.withColumn("row", F.monotonically_increasing_id()))
    tables.unpersist()
    at = spotted.select("row", F.explode("spots").alias("s")).select("row", "s.*")
    met = at.join(grouped, ["size", "key", "said"])
    run = F.struct((F.col("last") - F.col("size") + 1).alias("a"), (F.col("last") + 1).alias("b"))
    hits = met.groupBy("row").agg(F.array_sort(F.collect_set(run)).alias("runs"), F.array_sort(F.collect_set("of")).alias("sets"))
    # runs are sorted by start: add up what each adds beyond the furthest end so far
    covered = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["to"]))).alias("n"), F.greatest(s["to"], r["b"]).alias("to")),
        lambda s: s["n"],
    )
    h1, h2 = _digest("sets")
    hits = materialise(hits.select("row", covered.alias("n_hit"), "sets").withColumns({"h1": h1, "h2": h2}))
    # the items of each different collection of sets, found once for all documents that have it
    collected = hits.dropDuplicates(["h1", "h2"]).select("h1", "h2", F.explode("sets").alias("of")).join(sets, "of")
    named = materialise(collected.groupBy("h1", "h2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))
    hits = hits.drop("sets").join(named.hint("merge"), ["h1", "h2"]).select("row", "n_hit", "items")
    out = spotted.select("row", "id", "n_words").join(hits.hint("merge"), "row", "left")
    return out.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, table_bits: int | None = None) -> DataFrame:
    """Hit words and occurring items of every text: id, n_words, n_hit, n_items, items (sorted as strings).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. A word inside any occurrence is hit.

    A null or empty text has no words and no hits; an empty benchmark and items without words hit nothing; the windows of an
    item without an id hit, but name nothing. Very long texts are read a word after the other and take memory in proportion to themselves
    and to the places where a window may end. Repeated rows each give their row, and equal item texts count as separate
    items. Further columns are ignored.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _searched(keyed, benchmark, item_col, "text", window, table_bits).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that ``contaminated`` names; rows without id or text are judged alike.

    What is dropped is joined by id and two hashes of the text, whatever the other columns are called.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    texts = docs.toDF(*own)
    mark = F.struct(F.col(own[docs.columns.index(id_col)]).alias("of"), *(f(F.col(own[docs.columns.index(text_col)]).cast("string")).alias(n) for n, f in (("h1", F.xxhash64), ("h2", F.hash))))
    keyed = texts.select(mark.alias("id"), F.col(own[docs.columns.index(text_col)]).cast("string").alias("text"))
    bad = _searched(keyed, benchmark, item_col, "text", window).filter(contaminated()).select("id.*").distinct()
    same = mark["of"].eqNullSafe(F.col("of")) & (mark["h1"] == F.col("h1")) & (mark["h2"] == F.col("h2"))
    return texts.join(bad, same, "left_anti").toDF(*docs.columns)


def contaminated(n_hit="n_hit", n_words="n_words"):
    """The rule: some hit word, and at least a twentieth of all words hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def items_digest(items="items"):
    return F.sha2(F.concat_ws(",", items), 256)
