"""Removal of repeated passages with longest-previous-factor arrays over sparse suffixes.

Take the suffixes of all documents in suffix order, ties at the depth of interest broken by position. The longest previous
factor of a suffix is its longest common prefix with a suffix that starts at a smaller position. It is the longer of two: the
common prefixes with the nearest suffixes before and after it in that order that have smaller positions. Where it reaches
``length``, the window of ``length`` bytes there has an earlier copy and is removed.

No machine holds that order for a whole corpus, so suffixes are bucketed by an anchor: of the ``ANCHOR``-byte grams in a window
the one with the smallest hash, leftmost of equals. Equal windows have equal anchors at the same offset, so each bucket can be
ordered on its own, and a run of windows with one anchor is kept as one context.

1. A map batch finds the contexts of its documents. A context equal to an earlier one of the batch is removed at once; of the
   others, hashes go to the bucket of their anchor. What shares its anchor with no other context is done.
2. The bytes of the other contexts are fetched. In a bucket, a context equal to the one before it is removed as it passes by;
   the different ones are put into suffix order and their factors found. A bucket with very many different contexts is split by the
   hash of each window instead.

Hashes only choose what is compared: every removal rests on equal bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bytetext import Block, encoded, regrouped, slices
from cairn.llm.decontamination import _BYTE, _powers, merged
from cairn.llm.jaccard import mixed
from cairn.plans.storage import materialise

LENGTH = 100
ANCHOR = 20
CROWD = 2000  # different contexts of an anchor beyond which they are split by window, so that no task orders them all
SLICE = 1 << 18  # bytes whose working arrays stay in the processor's cache


class Rolling:
    """Hashes of any byte range, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(1 << max(10, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]


def contexts(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, first window, windows, anchor's offset from the first, anchor hash, context hash)."""
    block = Block(texts)
    data, at, last = block.data, block.at, block.end - length
    long = np.flatnonzero(last >= at)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    roll = Rolling(data)
    # order of the grams: 32 bits of hash, then place
    least = (mixed(roll.grams(anchor)) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data) - anchor + 1, dtype=np.uint64)
    span, have = length - anchor + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # first window of each run: where the anchor changes, and where a text starts
    head = np.append(True, place[1:] != place[:-1])
    head[at[long]] = True
    inside = np.zeros(len(place) + 1, np.int8)
    inside[at[long]] += 1
    inside[last[long] + 1] -= 1
    first = np.flatnonzero(head & (np.cumsum(inside[:-1]) > 0))
    text = long[np.searchsorted(at[long], first, side="right") - 1]
    final = np.minimum(np.append(first[1:] - 1, len(data)), last[text])
    spot = place[first]
    lo, n = spot - first, final - first + 1
    shape = mixed((lo.astype(np.uint64) << np.uint64(20)) + n.astype(np.uint64))
    return text, first - at[text], n, lo, roll.of(spot, spot + anchor), mixed(roll.of(first, final + length) ^ shape)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, in the order of the bytes."""
    return np.ndarray(max(0, len(data) - 7), ">u8", data.tobytes(), strides=(1,))


def _steps(depth: int) -> list[int]:
    return [*range(0, depth - 8, 8), depth - 8]


def first_equal(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each window of ``depth`` (at least 8) bytes the number of the first equal one, in the order given."""
    fingerprint = Rolling(data).of(starts, starts + depth)
    order = np.argsort(fingerprint, kind="stable")
    new = np.append(True, fingerprint[order[1:]] != fingerprint[order[:-1]]) if len(order) else np.zeros(0, bool)
    first = np.empty(len(starts), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    words, others = _words(data), np.flatnonzero(first != np.arange(len(first)))
    agree = np.ones(len(others), bool)
    for i in _steps(depth):
        agree &= words[starts[others] + i] == words[starts[first[others]] + i]
    seen: dict[bytes, int] = {}
    for k in others[~agree].tolist():  # equal fingerprints of different bytes
        first[k] = seen.setdefault(data[starts[k] : starts[k] + depth].tobytes(), k)
    return first


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes, equal ones in the order given, and the common prefix of each with
    the one before it, counted up to ``depth``.

    Eight bytes are compared at a time, and only suffixes that agree so far are compared further. Of equal ones a single one is ordered.
    """
    words, n = _words(data), len(starts)
    first = first_equal(data, starts, depth)
    single = np.flatnonzero(first == np.arange(n))
    order, common = single.copy(), np.full(len(single), depth, np.int64)
    if len(single):
        common[0] = 0
    open_ = np.arange(len(single))  # places of the order whose suffixes agree with a neighbour's so far, group by group
    group = np.zeros(len(single), np.int64)
    for i in _steps(depth):
        if not len(open_):
            break
        key = words[starts[order[open_]] + i].astype(np.uint64)
        by = np.lexsort((key, group))
        order[open_], key = order[open_][by], key[by]
        inner = group[1:] == group[:-1]
        split = inner & (key[1:] != key[:-1])
        differ = key[1:][split] ^ key[:-1][split]
        equal_bytes = 7 - np.floor(np.log2(differ.astype(float))).astype(np.int64).clip(0, 63) // 8
        # a float may round up to the next power of two: then the byte above is meant, and checked
        high = (differ >> (np.uint64(56) - np.uint64(8) * equal_bytes.clip(0, 7).astype(np.uint64))) == 0
        common[open_[1:][split]] = i + equal_bytes + high
        tied = np.append(False, inner & ~split)
        keep = tied | np.append(tied[1:], False)
        group = np.cumsum(~tied)[keep]
        open_ = open_[keep]
    # equal suffixes after the one that was ordered
    place = np.empty(n, np.int64)
    place[order] = np.arange(len(order))
    place = place[first]
    whole = np.lexsort((np.arange(n), place))
    lead = np.append(True, place[whole][1:] != place[whole][:-1]) if n else np.zeros(0, bool)
    return whole, np.where(lead, common[place[whole]], depth)


def longest_previous_factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, from suffixes in order: their positions, and common prefixes with the one before.

    ``position`` tells which of two suffixes is earlier; equal positions are the same suffix met twice. Each suffix steps to
    the nearest one before it, then after it, with a smaller position: all step at once, each step as far as the suffix
    stepped to has come itself, the common prefix shrinking on the way.
    """
    out = np.zeros(len(position), np.int64)
    for back in (False, True):
        at = position[::-1] if back else position
        reach = np.append(0, common[:0:-1] if back else common[1:])[: len(at)]
        to = np.arange(len(at)) - 1
        moving = np.flatnonzero(reach > 0)
        while len(moving := moving[at[to[moving]] >= at[moving]]):
            via = to[moving]
            reach[moving] = np.minimum(reach[moving], reach[via])
            to[moving] = to[via]
            moving = moving[reach[moving] > 0]
        out = np.maximum(out, reach[::-1] if back else reach)
    return out


def later_windows(bucketed: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Spans (document, from, to) of windows that have an earlier copy among the given contexts (document, first, windows, bytes)."""
    bucketed = sorted(bucketed, key=lambda c: (c[0], c[1]))  # contexts of one document do not share windows
    data = np.frombuffer(b"".join(c[3] for c in bucketed), np.uint8)
    sizes = np.array([len(c[3]) for c in bucketed])
    n = np.array([c[2] for c in bucketed])
    owner = np.repeat(np.arange(len(bucketed)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    doc, place = np.array([c[0] for c in bucketed], np.int64)[owner], np.array([c[1] for c in bucketed], np.int64)[owner] + inner
    # the same window seen twice (a repeated row) has one position
    position = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])))
    if len(position) and (np.diff(doc) == 0).any() and (np.diff(place)[np.diff(doc) == 0] <= 0).any():
        position = np.unique(np.column_stack([doc, place]), axis=0, return_inverse=True)[1].ravel()
    order, common = suffix_order(data, (np.cumsum(sizes) - sizes)[owner] + inner, length)
    later = order[longest_previous_factors(position[order], common) >= length]
    return _spans(doc[later], place[later], np.ones(len(later), np.int64), length)


def _spans(doc: np.ndarray, first: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Windows merged to spans of bytes by document."""
    if not len(doc):
        return []
    order = np.lexsort((first, doc))
    doc, a, b = doc[order], first[order], (first + n - 1 + length)[order]
    # the furthest end so far, restarting at each document: documents are lifted above one another
    lift = np.cumsum(np.append(0, (doc[1:] != doc[:-1]).astype(np.int64))) << 40
    reach = np.maximum.accumulate(b + lift)
    new = np.append(True, (a + lift)[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    ends = reach[np.append(heads[1:] - 1, len(doc) - 1)] - lift[heads]
    return list(zip(doc[heads].tolist(), a[heads].tolist(), ends.tolist(), strict=True))


_ROW = "key long, ctx long, doc long, first long, n int"


def _context_rows(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(doc, text) to the batch's different contexts; what repeats in the batch comes as spans with null ctx (first, first + n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = encoded(batch.column(1))
            parts = []
            for a, b in slices(texts, SLICE):
                text, first, n, lo, key, ctx = contexts(texts[a:b], length, anchor)
                parts.append((ids[text + a].astype(np.int64), text + a, first, n, key.view(np.int64), ctx.view(np.int64)))
            if not parts:
                continue
            doc, row, first, n, key, ctx = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((first, doc, ctx, key))
            doc, row, first, n, key, ctx = (c[order] for c in (doc, row, first, n, key, ctx))
            new = np.append(True, (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])) if len(key) else np.zeros(0, bool)
            lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, int)
            for k in np.flatnonzero(~new).tolist():
                j, size = lead[k], n[k] - 1 + length
                new[k] = texts[row[k]][first[k] : first[k] + size] != texts[row[j]][first[j] : first[j] + size]
            later = ~new & ((doc != doc[lead]) | (first != first[lead]))
            spans = _spans(doc[later], first[later], n[later], length)
            d, s, e = (np.array(c, np.int64) for c in zip(*spans, strict=True)) if spans else (np.zeros(0, np.int64),) * 3
            spread = mixed(d.astype(np.uint64) + np.uint64(3)).view(np.int64)
            columns = [
                np.concatenate([key[new], spread]),
                pa.array(np.concatenate([ctx[new], d]), mask=np.arange(int(new.sum()) + len(d)) >= new.sum()),
                np.concatenate([doc[new], d]),
                np.concatenate([first[new], s]),
                np.concatenate([n[new], e - s]).astype(np.int32),
            ]
            out = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["key", "ctx", "doc", "first", "n"])
            for i in range(0, out.num_rows, 100_000):
                yield out.slice(i, 100_000)

    return docs.mapInArrow(run, _ROW)


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (key, ctx, doc, first): those whose key another row has too, and spans as they are."""
    held: pa.RecordBatch | None = None  # the last row with a context, and whether it has gone out
    gone = False
    for batch in batches:
        ready = batch.column(1).is_null()
        if ready.true_count:
            yield batch.filter(ready)
            batch = batch.filter(pc.invert(ready))
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        same = np.append(False, key[1:] == key[:-1])
        if held is not None and held.column(0)[0].as_py() == key[0]:
            same[0] = True
            if not gone:
                yield held
        out = same | np.append(same[1:], False)
        if out.any():
            yield batch.filter(pa.array(out))
        held, gone = batch.slice(batch.num_rows - 1), bool(out[-1])


def _fetch_bytes(length: int):
    """(doc, text, wanted contexts) to bucket rows; crowded contexts come apart into windows, of equal ones in a slice of texts the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, wanted = batch.column(0).to_pylist(), encoded(batch.column(1)), batch.column(2).to_pylist()
            for a, b in slices(texts):
                rows: list[tuple] = []
                crowded: list[tuple[int, int, int, bytes]] = []
                for doc, text, contexts_of in zip(docs[a:b], texts[a:b], wanted[a:b], strict=True):
                    for w in contexts_of:
                        part = text[w["first"] : w["first"] + w["n"] - 1 + length]
                        if w["crowd"]:
                            crowded.append((doc, w["first"], w["n"], part))
                        else:
                            rows.append((w["key"], w["ctx"], doc, w["first"], w["n"], part))
                if crowded:
                    rows += _single_windows(sorted(crowded), length)
                for i in range(0, len(rows), 20_000):
                    yield _bucket_batch(rows[i : i + 20_000])

    return run


def _single_windows(crowded: list[tuple[int, int, int, bytes]], length: int) -> list[tuple]:
    """Bucket rows for the first of each different window of sorted contexts, and spans for the others."""
    data = np.frombuffer(b"".join(c[3] for c in crowded), np.uint8)
    n, sizes = np.array([c[2] for c in crowded]), np.array([len(c[3]) for c in crowded])
    owner = np.repeat(np.arange(len(crowded)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts = (np.cumsum(sizes) - sizes)[owner] + inner
    doc, place = np.array([c[0] for c in crowded], np.int64)[owner], np.array([c[1] for c in crowded], np.int64)[owner] + inner
    first = first_equal(data, starts, length)
    single = np.flatnonzero(first == np.arange(len(first)))
    key = Rolling(data).of(starts[single], starts[single] + length).view(np.int64)
    whole = data.tobytes()
    rows = [(k, k, d, p, 1, whole[s : s + length]) for k, d, p, s in zip(key.tolist(), doc[single].tolist(), place[single].tolist(), starts[single].tolist(), strict=True)]
    later = np.flatnonzero((doc != doc[first]) | (place != place[first]))
    spans = _spans(doc[later], place[later], np.ones(len(later), np.int64), length)
    return rows + [(mixed(np.array([d], np.int64).view(np.uint64)).view(np.int64)[0].item(), None, d, s, e - s, None) for d, s, e in spans]


def _bucket_batch(rows: list[tuple]) -> pa.RecordBatch:
    key, ctx, doc, first, n, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (key, ctx, doc, first, n)), pa.array(data, pa.binary())], names=["key", "ctx", "doc", "first", "n", "data"])


def _order_buckets(length: int):
    """Over rows sorted by (key, ctx, doc, first): spans of windows with an earlier copy in their bucket. Rows without bytes are spans already.

    A context with the bytes of the last different one is removed as it passes by; only different ones are held, bucket by bucket.
    """

    def emit(spans) -> pa.RecordBatch:
        doc, a, b = zip(*spans, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, a, b)], names=["doc", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            done = []
            for key, _, doc, first, n, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if data is None:
                    done.append((doc, first, first + n))
                elif held and held[-1][4] == data and held[-1][0] == key:
                    if (doc, first) != held[-1][1:3]:
                        done.append((doc, first, first + n - 1 + length))
                else:
                    held.append((key, doc, first, n, data))
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            for part in _by_size(held[:cut]):
                done += later_windows([r[1:] for r in part], length)
            held = held[cut:]
            if done:
                yield emit(done)
        done = [s for part in _by_size(held) for s in later_windows([r[1:] for r in part], length)]
        if done:
            yield emit(done)

    return run


def _by_size(rows: list[tuple], limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Whole buckets of about ``limit`` bytes together."""
    part: list[tuple] = []
    size = 0
    for i, row in enumerate(rows):
        if size > limit and row[0] != rows[i - 1][0]:
            yield part
            part, size = [], 0
        part.append(row)
        size += len(row[4])
    if part:
        yield part


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc long, text) to spans (doc, first, last) of bytes, not merged, whose windows have an earlier copy."""
    rows = _context_rows(docs, length, anchor)
    compared = materialise(rows.repartition("key").sortWithinPartitions("key", "ctx", "doc", "first").mapInArrow(_shared_anchors, _ROW))
    shared = compared.filter("ctx is not null")
    # written, so that the join shuffles its rows on its own and Spark can split a crowded key, or broadcasts if it measures little
    crowds = shared.select("key", "ctx").distinct().groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > CROWD)
    crowds = materialise(crowds.select("key", F.lit(True).alias("crowd")))
    wanted = shared.join(crowds, "key", "left").groupBy("doc").agg(F.collect_list(F.struct("key", "ctx", "first", "n", F.coalesce("crowd", F.lit(False)).alias("crowd"))).alias("wanted"))
    # both joins shuffle the texts alike, so that Spark shuffles them once; what they meet grows with the corpus
    fetched = docs.hint("merge").join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_fetch_bytes(length), "key long, ctx long, doc long, first long, n long, data binary")
    ordered = fetched.repartition("key").sortWithinPartitions("key", "ctx", "doc", "first").mapInArrow(_order_buckets(length), "doc long, first long, last long")
    return compared.filter("ctx is null").select("doc", "first", (F.col("first") + F.col("n")).alias("last")).unionByName(ordered)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """id, n_bytes, removed (array of structs a, b: maximal runs of removed bytes) and kept (binary) for every row.

    A byte is removed where a string of ``length`` bytes covers it that also starts earlier: in a smaller id, or earlier in
    the same document. Null counts as empty; shorter texts keep everything. Ids are integers and name one text: rows that
    repeat id and text are one document, and what is found for an id is removed from each of its rows. A row without id
    keeps everything. An empty table gives none; further columns are ignored. A very long text is cut and checked whole, in memory in
    proportion to it.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = texts.filter("doc is not null")
    spans = repeated_spans(known, length, anchor)
    by_doc = spans.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct(F.col("first").alias("a"), F.col("last").alias("b"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for x, y in slices(texts):
                part = texts[x:y]
                removed, kept = [], []
                for text, spans in zip(part, batch.column(2).slice(x, y - x).to_pylist(), strict=True):
                    runs = [(a, min(b, len(text))) for a, b in merged([(s["a"], s["b"]) for s in spans or []]) if a < len(text)]
                    edges = [0, *(e for r in runs for e in r), len(text)]
                    removed.append([{"a": a, "b": b} for a, b in runs])
                    kept.append(b"".join([text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]))
                kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array([len(t) for t in part], pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "removed", "kept"])

    joined = known.hint("merge").join(by_doc, F.col("doc") == F.col("of"), "left").select("doc", "text", "spans")
    joined = joined.unionByName(texts.filter("doc is null").withColumn("spans", F.lit(None).cast(by_doc.schema["spans"].dataType)))
    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, removed array<struct<a:long,b:long>>, kept binary")
