"""Packing of tokenised documents into sequences by bin completion.

What the packing depends on is only how many pieces there are of each length, at most ``capacity`` numbers. So the search
runs over that histogram: a filling (a multiset of lengths) is used as many times as the counts allow. Spark tokenises,
counts, and deals the pieces of each length out to the places that the chosen fillings hold for it.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.bytetext import IS_DARK, Block, encoded, slices
from cairn.plans.storage import materialise

CAPACITY = 1024
END_ID = 2
SEARCH_NODES = 1500  # nodes of the branch-and-bound before the best packing found is returned; None: until it is proven or all are seen
FILLINGS = 3  # fillings tried at a node, in order of waste; None: all undominated ones
FILLING_STEPS = 600  # steps of the enumeration at a node; None: all
BEST_FIT_EVERY = 32  # levels between best-fit incumbents

# ---------------------------------------------------------------- tokens

#: How a byte-level tokenizer with its usual pattern splits texts (fixed value).
_PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose kind no version of Unicode has changed; texts with others are left to the tokenizer itself.
_SETTLED = re.compile(r"[\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u044f\u05d0-\u05ea\u0621-\u063a\u2010-\u2027\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
LONG_RUN = 500  # bytes without white space, or of white space alone, beyond which a text is left to the tokenizer itself


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on in turn."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids (little-endian unsigned 32-bit) of texts, those that ``tokenizers`` gives for the file.

    Where the file is a byte-level model of the common kind, whose merges are numbered in their order, ``tiktoken`` finds the
    same ids in less than half the time. Texts with characters that the two may class differently, and those with very long runs, are encoded by
    ``tokenizers``, and so is everything where the file is of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = self._fast(json.loads(Path(path).read_text()))

    @staticmethod
    def of(path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    @staticmethod
    def _fast(file: dict):
        import tiktoken

        model, split, added = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
        vocabulary, merges = model.get("vocab"), [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
        usual = (
            file["normalizer"] is None
            and {k: split.get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
            and all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
        )
        if not usual:
            return None
        byte_of = {c: b for b, c in _byte_letters().items()}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        return tiktoken.Encoding("file", pat_str=_PRETOKENS, mergeable_ranks=ranks, special_tokens=special)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        if self.fast is None:
            yield from (self._whole(t.decode()) for t in texts)
            return
        block = Block(texts)
        begin, stop, first = block.words(IS_DARK)
        long = np.zeros(len(texts), bool)
        long[np.searchsorted(block.end, begin[stop - begin > LONG_RUN])] = True
        gap_from, gap_to = np.append(0, stop), np.append(begin, len(block.data) - 1)
        for at in np.flatnonzero(gap_to - gap_from > LONG_RUN).tolist():  # a gap may reach over several texts
            long[np.searchsorted(block.end, gap_from[at]) : np.searchsorted(block.end, gap_to[at]) + 1] = True
        wide = np.add.reduceat(block.data >= 0xCA, block.at) > 0  # lead bytes from U+0280 on
        for text, slow, check in zip(map(bytes.decode, texts), long.tolist(), wide.tolist(), strict=True):
            if slow or (check and not _SETTLED.fullmatch(text)):
                yield self._whole(text)
            else:
                yield self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of each piece; only texts longer than ``capacity`` are cut, and only the first piece is short."""
    n = len(ids) // 4
    start, length = 0, n if n <= capacity else n % capacity or capacity
    while start < n:
        yield start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, length = start + length, capacity


def tokenise_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each text's ids with ``end_id`` appended: id, piece, start, length, ids_crc32. A narrow job.

    A null or empty text is one piece that holds the end id alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        encoder = Encoder.of(tokenizer_path)
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                rows = [(i, k, *p) for i, ids in enumerate(encoder.ids(texts[a:b]), a) for k, p in enumerate(cut(ids + end, capacity))]
                at, piece, start, length, crc = map(list, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[id_col, "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- bin completion over a histogram

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for each threshold, pieces that cannot share a bin, and what the middling ones must add."""
    sizes = sorted((s for s, n in counts.items() if n), reverse=True)
    best = math.ceil(sum(s * n for s, n in counts.items()) / capacity)
    for small in {s for s in sizes if 2 * s <= capacity}:
        big = sum(counts[s] for s in sizes if s > capacity - small)
        mid = [s for s in sizes if capacity - small >= s > capacity / 2]
        room = sum((capacity - s) * counts[s] for s in mid)
        rest = sum(s * counts[s] for s in sizes if 2 * s <= capacity and s >= small)
        best = max(best, big + sum(counts[s] for s in mid) + max(0, math.ceil((rest - room) / capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, a whole length at a time: bins of equal content are one group."""
    groups: dict[int, list[tuple[Filling, int]]] = {capacity: []}
    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        for room in sorted(r for r in groups if r >= size):
            per = room // size
            while left and groups.get(room):
                filling, times = groups[room].pop()
                full = min(times, left // per)
                partly = left % per if full < times and left < per * times else 0
                for copies, n in ((per, full), (partly, 1 if partly else 0), (0, times - full - (1 if partly else 0))):
                    if n:
                        key = room - copies * size
                        target = groups.setdefault(key, [])
                        entry = (filling + ((size, copies),) if copies else filling, n)
                        target.insert(0, entry) if not copies else target.append(entry)
                left -= per * full + partly
                if full < times:
                    break
            if not left:
                break
        per = capacity // size
        if left // per:
            groups.setdefault(capacity - per * size, []).append((((size, per),), left // per))
        if left % per:
            groups.setdefault(capacity - left % per * size, []).append((((size, left % per),), 1))
    return [x for held in groups.values() for x in held]


def fillings(counts: dict[int, int], capacity: int, limit: int | None = FILLINGS, steps: int | None = FILLING_STEPS) -> list[Filling]:
    """Undominated fillings around the longest piece, those with least waste first; all of them where nothing is limited.

    Depth-first, longest first. A filling is dominated where a remaining longer piece could take the place of one of its
    pieces, or another piece would still fit; both show as a waste that some step between remaining lengths does not exceed.
    """
    sizes = sorted((s for s, n in counts.items() if n), reverse=True)
    largest = sizes[0]
    found: list[tuple[int, Filling]] = []
    left = [math.inf if steps is None else steps]

    def undominated(chosen: dict[int, int], waste: int) -> bool:
        free = [s for s in sizes if counts[s] > chosen.get(s, 0)]
        if free and free[-1] <= waste:
            return False
        return not any(s != largest and any(s < f <= s + waste for f in free) for s in chosen)

    def extend(i: int, room: int, chosen: dict[int, int]) -> None:
        left[0] -= 1
        if left[0] < 0 or (limit and len(found) >= limit and found[limit - 1][0] == 0):
            return
        while i < len(sizes) and sizes[i] > room:
            i += 1
        if i == len(sizes):
            if undominated(chosen, room):
                found.append((room, tuple(sorted(chosen.items(), reverse=True))))
                found.sort(key=lambda x: x[0])
            return
        size = sizes[i]
        for copies in range(min(counts[size] - chosen.get(size, 0), room // size), -1, -1):
            extend(i + 1, room - copies * size, chosen | ({size: chosen.get(size, 0) + copies} if copies else {}))

    extend(0, capacity - largest, {largest: 1})
    return [f for _, f in found[:limit]]


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = SEARCH_NODES, limit: int | None = FILLINGS, steps: int | None = FILLING_STEPS) -> list[tuple[Filling, int]]:
    """Fillings with the times each is used, in as few bins as the search finds.

    Branch and bound: the incumbent is best-fit decreasing; a node completes the bin of the longest remaining piece in one
    of its undominated ways, as many times as the counts allow, and is cut where its bins and the waste bound of the rest
    cannot beat the incumbent. Best-fit on what remains gives new incumbents on the way down. Stops at the lower bound, and
    then the packing is the smallest there is. With ``nodes``, ``limit`` and ``steps`` all None every filling is also tried
    fewer times, so that the end of the search proves the packing too; that is for histograms of a few dozen pieces.
    """
    rest = {s: n for s, n in counts.items() if n}
    best = best_fit(rest, capacity)
    fewest = sum(n for _, n in best)
    floor = lower_bound(rest, capacity)
    whole = nodes is None and limit is None and steps is None
    left = math.inf if nodes is None else nodes
    # a node on the path: what remains, its bins so far, the filling that led here, the fillings (and times) still to try
    path: list[tuple[dict[int, int], int, tuple[Filling, int] | None, Iterator[tuple[Filling, int]]]] = []

    def ways(rest: dict[int, int]) -> Iterator[tuple[Filling, int]]:
        for filling in fillings(rest, capacity, limit, steps):
            most = min(rest[s] // k for s, k in filling)
            yield from ((filling, times) for times in range(most, 0 if whole else most - 1, -1))

    def enter(rest: dict[int, int], used: int, by: tuple[Filling, int] | None) -> None:
        nonlocal best, fewest, left
        left -= 1
        if not rest or len(path) % BEST_FIT_EVERY == BEST_FIT_EVERY - 1:
            tail = best_fit(rest, capacity)
            total = used + sum(n for _, n in tail)
            if total < fewest:
                fewest = total
                best = [x[2] for x in path if x[2]] + ([by] if by else []) + tail
        bound = used + math.ceil(sum(s * n for s, n in rest.items()) / capacity)
        path.append((rest, used, by, ways(rest) if rest and bound < fewest else iter(())))

    if fewest > floor:
        enter(rest, 0, None)
    while path and left > 0 and fewest > floor:
        rest, used, _, options = path[-1]
        way = next(options, None)
        if way is None:
            path.pop()
            continue
        filling, times = way
        lower = {s: n - times * k for s, n in rest.items() if (k := dict(filling).get(s, 0)) * times < n}
        enter(lower, used + times, way)
    return best


def places(packing: list[tuple[Filling, int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, copies a bin, first bin, offset of the first copy), in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    bins = 0
    for filling, times in packing:
        offset = 0
        per = Counter()
        for size, copies in filling:
            per[size] += copies
        for size, copies in sorted(per.items(), reverse=True):
            out.setdefault(size, []).append((ranks[size], copies, bins, offset))
            ranks[size] += copies * times
            offset += copies * size
        bins += times
    return out


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", nodes: int | None = SEARCH_NODES, limit: int | None = FILLINGS, steps: int | None = FILLING_STEPS
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stable (materialised) table of pieces. ``nodes``, ``limit`` and ``steps`` bound the search as in ``pack``.

    Only the histogram of lengths, at most ``capacity`` rows, comes to the driver. Pieces of one length are ranked within
    hashed buckets of bounded size, so a length that a third of all pieces share is spread over many tasks.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = {s: np.array(rows, dtype=np.int64) for s, rows in places(pack(counts, capacity, nodes, limit, steps)).items()}
    buckets = max(64, math.ceil(max(counts.values(), default=0) / 2000))
    order = [F.col(c) for c in (id_col, "piece", "start", "ids_crc32")]
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col), "piece"), F.lit(buckets)))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1
    # pieces of the same length in the buckets before, in two steps: no task meets more than a thousandth of the buckets at once
    sizes = materialise(dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("thousand", F.expr("bucket div 1000")))
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy("length", *keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("length", "thousand").agg(F.sum("n").alias("n")).select("length", "thousand", before("thousand").alias("far"))
    offsets = sizes.withColumn("near", before("thousand", "bucket")).hint("merge").join(groups, ["length", "thousand"]).select("length", "bucket", (F.col("near") + F.col("far")).alias("before"))
    # the buckets grow with the pieces: never a broadcast
    ranked = dealt.withColumn("within", within).join(offsets.hint("merge"), ["length", "bucket"]).select(*pieces.columns, (F.col("before") + F.col("within")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes, ranks = (table[c].to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for size in np.unique(sizes):
                here = sizes == size
                rows = plan[int(size)]
                row = rows[np.searchsorted(rows[:, 0], ranks[here], side="right") - 1]
                turn = ranks[here] - row[:, 0]
                sequence[here] = row[:, 2] + turn // row[:, 1]
                offset[here] = row[:, 3] + turn % row[:, 1] * size
            out = table.drop_columns("rank").append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from out.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
    nodes: int | None = SEARCH_NODES, limit: int | None = FILLINGS, steps: int | None = FILLING_STEPS,
) -> DataFrame:
    """Tokenise all texts and pack their pieces into sequences of at most ``capacity`` ids.

    One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text holds the end id alone;
    repeated rows are packed each on its own; an empty table gives no rows; further columns are ignored. A very long text is tokenised
    whole, in one task. With ``nodes``, ``limit`` and ``steps`` all None the search is exhaustive, and ends with the fewest sequences.
    """
    pieces = materialise(tokenise_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    return pack_pieces(pieces, capacity, id_col, nodes, limit, steps)
