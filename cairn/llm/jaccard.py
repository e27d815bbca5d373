"""Exact Jaccard join of word n-gram sets by parity sketches.

Every n-gram of a set flips bits of a sketch, so what two sets share cancels out and the Hamming distance of two sketches is
at most the size of the symmetric difference. Sets that reach the threshold differ in at most D n-grams, where D follows from
the sizes; with the n-grams dealt by hash into more than D parts, some part of both sketches is equal (pigeonhole).
Sizes are banded, so that both sets of a pair use the same number of parts.

Below 90 % parts would hold so few n-grams that any shared passage makes them equal. There the n-grams of a set are put into
one order, common ones last, and the first of them are its parts: two sets that share at least the threshold of the larger
one share one of their first n-grams, whatever the order. Common are those that a sample of fixed size meets repeatedly; a
poor sample costs time and no link.

1. Sets that are equal are put into classes by a hash; the smallest id stands for its class.
2. Documents that agree in a part are chained if their sketches, kept beside the sets' sizes, are near enough for a link; where
   more than CROWD documents agree in one, all are chained to the smallest id that has it. The chains' components are coarse
   groups that hold every link. Parts that many documents of a map batch have are chained at once, so that a very common part sends
   one row a batch; that row stands for documents that are not near it, so all that have such a part are chained, however few rows it has.
3. A coarse group is compared block by block: sketches first, then the sets themselves. Only a spanning forest of the links
   leaves a task, and groups of any size are spread over tasks of bounded size.
4. Components of classes and forests are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.bytetext import IS_DARK, LOWER, Block, encoded, regrouped, slices
from cairn.llm.decontamination import word_hashes
from cairn.plans.components import connected_components
from cairn.plans.storage import materialise

NGRAM = 3
THRESHOLD = 90  # percent
BLOCK_DOCS = 256
BLOCK_SHINGLES = 200_000
SHIP_BYTES = 8 << 20
SAMPLE_DOCS = 20_000
COMMON_GRAMS = 1_000_000
CROWD, CROWD_IN_BATCH = 1024, 128
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], n: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; a shorter text has its whole sequence, an empty one none."""
    block = Block(texts)
    begin, stop, first = block.words(IS_DARK)
    words = word_hashes(LOWER[block.data], begin, stop)
    if len(words) >= n:
        grams = words[n - 1 :].copy()
        for j in range(1, n):
            grams = mixed(grams) + words[n - 1 - j : len(words) - j]
        grams = mixed(grams)
    else:
        grams = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for j in range(a, b):
                whole = mixed(whole) + words[j : j + 1]
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Bands:
    """Size bands, each reaching so far that a pair over the threshold lies in one band or in two neighbouring ones.

    Scheme i compares bands i and i+1 with ``parts[i]`` parts, one more than the sets may differ by, plus ``SPARE``: with
    that many, a set with at most SPARE empty parts may leave its empty parts out.
    """

    SPARE = 1

    def __init__(self, percent: int, top: int = 1 << 31):
        self.percent = percent
        self.starts = [1]
        while self.starts[-1] <= top:  # no text has more words
            self.starts.append(100 * self.starts[-1] // percent + 1)
        self.starts = np.array(self.starts, np.int64)
        largest = np.append(self.starts[2:], [1 << 40, 1 << 40]) - 1
        self.differ = self.most_different(2 * largest)
        self.parts = self.differ + 1 + self.SPARE

    def most_different(self, sizes_sum):
        """Largest symmetric difference of two sets over the threshold, by the sum of their sizes."""
        return sizes_sum * (100 - self.percent) // (100 + self.percent)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, size, side="right") - 1


@cache
def bands(percent: int) -> Bands:
    return Bands(percent)


def part_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, key) for the parts of each set's sketch in the schemes of its band and of the one below.

    A key is the parity of a part's n-grams over 64 bits, mixed with scheme and part. Sets so small that only equal ones
    reach the threshold have none.
    """
    plan = bands(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    places, keys = [], []
    for below in (0, 1):
        scheme = plan.of(np.maximum(sizes, 1)) - below
        used = (scheme >= 0) & (plan.differ[np.maximum(scheme, 0)] > 0) & (sizes > 0)
        parts = np.where(used, plan.parts[np.maximum(scheme, 0)], 0)
        offset = np.cumsum(parts) - parts
        here = used[owner]
        of, value = owner[here], values[here]
        if not len(of):
            continue
        part = ((value >> np.uint64(32)) * parts[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = offset[of] + part
        order = np.argsort(slot, kind="stable")
        slot, value = slot[order], value[order]
        head = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        parity = np.zeros(int(parts.sum()), np.uint64)
        parity[slot[head]] = np.bitwise_xor.reduceat(value, head)
        full = np.zeros(len(parity), bool)
        full[slot[head]] = True
        doc = np.repeat(np.arange(len(sets)), parts)
        # more empty parts than the spare ones: they count too, for pairs that agree in nothing else
        empties = np.bincount(doc, ~full, len(sets))
        keep = full | (empties[doc] > Bands.SPARE)
        number = np.arange(len(parity)) - offset[doc]
        salt = mixed(scheme[doc].astype(np.uint64) * np.uint64(1 << 32) + number.astype(np.uint64) + np.uint64(1))
        places.append(doc[keep])
        keys.append(mixed(parity + salt)[keep])
    return (np.concatenate(places), np.concatenate(keys)) if places else (np.zeros(0, int), np.zeros(0, np.uint64))


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def parity_sketch(s: np.ndarray) -> bytes:
    """A parity sketch of at least as many bits as the set has n-grams, a power of two; bit i is the parity of hashes i modulo that."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def set_digests(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """(id, text) to id, n_shingles, two hashes of the set and its parity sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], n)
                h1 = [int(np.bitwise_xor.reduce(mixed(s))) if len(s) else 0 for s in sets]
                h2 = [int(np.add.reduce(mixed(s + np.uint64(7)))) if len(s) else 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)),
                        pa.array(list(map(parity_sketch, sets)), pa.binary()),
                    ],
                    names=["id", "n", "h1", "h2", "sketch"],
                )

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, sketch binary")


Common = tuple[np.ndarray, np.ndarray]  # sorted n-grams, and how many sampled sets have each


def common_grams(docs: DataFrame, n: int, rows: int) -> Common:
    """The n-grams that more than one set of a sample of the ``rows`` rows (id, text) has; at most COMMON_GRAMS, the most common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches):
            texts = encoded(batch.column(0))
            for a, b in slices(texts):
                gram, times = np.unique(np.concatenate(shingle_sets(texts[a:b], n)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(times.astype(np.int64))], names=["gram", "times"])

    million = min(1_000_000, SAMPLE_DOCS * 1_000_000 // max(1, rows))
    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < million).select("text")
    counted = materialise(sample.mapInArrow(run, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")).filter("times > 1"))
    least, held = 2, 0
    for r in counted.groupBy("times").count().orderBy(F.desc("times")).collect():
        held += r["count"]
        if held > COMMON_GRAMS:
            least = r.times + 1
            break
    found = counted.filter(F.col("times") >= least).toArrow()
    gram = found["gram"].to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return gram[order], np.minimum(found["times"].to_numpy(), 1 << 20)[order].astype(np.int64)


def first_grams(sets: list[np.ndarray], percent: int, common: Common) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, key) for the first n-grams of each set, common ones last: as many as reach one of those of any set over the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    gram, times = common
    weight = np.zeros(len(values), np.int64)
    if len(gram):
        at = np.minimum(np.searchsorted(gram, values), len(gram) - 1)
        weight = np.where(gram[at] == values, times[at], 0)
    order = np.argsort(owner << 21 | weight, kind="stable")  # a set is sorted: ties are in the order of the n-grams
    rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    taken = rank < (sizes - -(-sizes * percent // 100) + 1)[owner]
    return owner[taken], values[order][taken]


def _sketch_rows(docs: DataFrame, percent: int, n: int, common: Common | None = None) -> DataFrame:
    """(id, text) to rows (key, id, other): a part of a sketch (other null), or a chain to another id of the batch with the same part.

    With ``common``, the parts are the first n-grams. Only parts that many documents of the batch have are chained here; the one row that
    is left of such a part has its own id as the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in regrouped(batches):
            ids = _ids(batch)
            texts = encoded(batch.column(1))
            places, keys = [], []
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], n)
                p, k = part_keys(sets, percent) if common is None else first_grams(sets, percent, common)
                places.append(ids[p + a])
                keys.append(k)
            doc, key = np.concatenate(places or [np.zeros(0, np.int64)]), np.concatenate(keys or [np.zeros(0, np.uint64)])
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            fresh = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            crowded = np.zeros(len(key), bool)
            if len(key):
                run_of = np.cumsum(fresh) - 1
                crowded = (np.bincount(run_of) > CROWD_IN_BATCH)[run_of]
                fresh |= ~crowded
            lead = doc[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(key) else doc
            chained = np.unique(np.column_stack([doc, lead])[(~fresh) & (doc != lead)], axis=0)
            out_key = np.concatenate([key[fresh].view(np.int64), mixed(chained[:, 0].astype(np.uint64)).view(np.int64)])
            out_id = np.concatenate([doc[fresh], chained[:, 0]])
            alone = np.append(~crowded[fresh], np.zeros(len(chained), bool))
            other = pa.array(np.concatenate([doc[fresh], chained[:, 1]]), mask=alone)
            for i in range(0, len(out_id), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(out_key[i : i + 200_000]), pa.array(out_id[i : i + 200_000]), other.slice(i, 200_000)], names=["key", "id", "other"])

    return docs.mapInArrow(run, "key long, id long, other long")


def near_pairs(group: list[tuple[int, int, bytes]], percent: int) -> list[tuple[int, int]]:
    """Of (id, size, sketch), a spanning forest of the pairs whose sizes and sketches allow a link."""
    every = sorted((n, i, len(b) * 8, int.from_bytes(b, "little")) for i, n, b in group)
    root = list(range(len(every)))
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, (n, i, bits, sketch) in enumerate(every):
        for y in range(x + 1, len(every)):
            m, j, wide, other = every[y]
            if m * percent > n * 100:
                break
            while wide > bits:  # a sketch of half as many bits is the sum of the halves
                wide //= 2
                other = (other & ((1 << wide) - 1)) ^ (other >> wide)
            if (sketch ^ other).bit_count() <= (n + m) * (100 - percent) // (100 + percent) and find(x) != find(y):
                root[find(y)] = find(x)
                if i != j:
                    out.append((i, j))
    return out


def _near_chains(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Rows of parts to chains (id, other): of near documents where a few share a part, to the smallest id where many do.

    Groups that share several parts are compared once. A batch sends a part that many of its documents have as one row, so the
    window over a part, however common, meets at most CROWD_IN_BATCH rows a batch. Whoever shares a part with such a row may be near to one
    of those it stands for, so it is chained to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, of = batch.column(0).flatten(), np.diff(batch.column(0).offsets.to_numpy())
            ids, sizes, marks = (held.field(k).to_pylist() for k in range(3))
            every, at, out = list(zip(ids, sizes, marks, strict=True)), 0, []
            for k in of.tolist():
                out += near_pairs(every[at : at + k], percent)
                at += k
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["id", "other"])

    whole = Window.partitionBy("key")
    stands = F.max(F.when(F.col("other") == F.col("id"), 1).otherwise(0)).over(whole) == 1
    crowd = (F.count("*").over(whole) > CROWD) | stands
    shared = materialise(rows.select("key", "id", "other", crowd.alias("crowd"), F.count("*").over(whole).alias("docs"), F.min("id").over(whole).alias("lead")).filter("docs > 1 or other is not null"))
    chained = F.col("other").isNotNull() & (F.col("other") != F.col("id"))
    many = shared.filter(chained | F.col("crowd")).select("id", F.when(chained, F.col("other")).otherwise(F.col("lead")).alias("other"))
    few = shared.filter(F.col("other").isNull() & ~F.col("crowd")).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    members = few.select("ids").distinct().select(F.xxhash64("ids").alias("group"), F.explode("ids").alias("id")).join(sketches.hint("merge"), "id")
    groups = members.groupBy("group").agg(F.collect_list(F.struct("id", "n", "sketch")).alias("members")).select("members")
    return many.unionByName(groups.mapInArrow(run, "id long, other long"))


def _forest(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Links within ``left``, or between ``left`` and ``right``, as stars on the smallest id of what they connect."""
    every = sorted([(i, s, 0) for i, s in left] + [(i, s, 1) for i, s in right or []], key=lambda x: (len(x[1]), x[0]))
    n = np.array([len(s) for _, s, _ in every], np.int64)
    side = np.array([x[2] for x in every])
    words = 1 << max(2, int(np.ceil(np.log2(max(1, 2 * n.max()) / 64 + 1))))
    words = min(words, 128)
    sketch = np.zeros((len(every), words * 64), np.uint8)
    for row, (_, s, _) in zip(sketch, every, strict=True):
        row[:] = np.bincount((s % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    bits = np.packbits(sketch, axis=1).view(np.uint64)
    root = list(range(len(every)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    plan = bands(percent)
    reach = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(every)):
        rest = np.arange(i + 1, reach[i])
        if right is not None:
            rest = rest[side[rest] != side[i]]
        if not len(rest):
            continue
        most = plan.most_different(n[rest] + n[i])
        near = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(1, dtype=np.int64) <= most]
        for j in near.tolist():
            a, b = find(i), find(j)
            if a != b:
                shared = len(np.intersect1d(every[i][1], every[j][1], assume_unique=True))
                if 100 * shared >= percent * (int(n[i]) + int(n[j]) - shared):
                    root[b] = a
    members: dict[int, list[int]] = {}
    for x in range(len(every)):
        members.setdefault(find(x), []).append(every[x][0])
    return [(min(m), x) for m in members.values() if len(m) > 1 for x in m if x != min(m)]


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links) for every row.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets. A null or empty text has an empty set
    and links with nothing. Ids are integers; rows that repeat an id are one node of the graph, each with its own set; a row
    without id stays alone with a null component. An empty table gives none; further columns are ignored, whatever they are called. A
    very long text is shingled whole, in one task, in memory in proportion to it.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = texts.filter("id is not null")
    by_order = percent < THRESHOLD
    digests = materialise(set_digests(texts, n))
    # classes of equal sets; written, so that the join meets its rows by a shuffle of its own, whose skew Spark can split
    classes = digests.filter("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("rows"))
    classes = materialise(classes.filter(F.col("rows") > 1).drop("rows"))
    placed = materialise(digests.join(classes.hint("merge"), ["n", "h1", "h2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    # coarse groups
    common = common_grams(known, n, digests.filter("n > 0").count()) if by_order else None
    rows = _sketch_rows(known, percent, n, common)
    chains = _near_chains(rows, digests.filter("n > 0 and id is not null").select("id", "n", "sketch"), percent).filter("id != other").distinct()
    coarse = connected_components(chains, "id", "other")
    members = coarse.hint("merge").join(placed.filter("id = rep").select(F.col("id").alias("node"), "n").groupBy("node").agg(F.max("n").alias("n")), "node")
    # written, so that Spark can split the join on the members of a very large group
    sizes = materialise(members.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")).filter("docs > 1"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    wanted = members.join(sizes.hint("merge"), "component").select(F.col("node").alias("id"), "component", blocks.alias("blocks"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, group, blocks = _ids(batch), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            texts = encoded(batch.column(1))
            out, size = [], 0
            for a, b in slices(texts):
                for i, s in enumerate(shingle_sets(texts[a:b], n), a):
                    mine, data = int(mixed(np.array([ids[i]]).view(np.uint64))[0] % np.uint64(blocks[i])), s.tobytes()
                    for k in range(int(blocks[i])):  # a set goes to every block pair of its own; a few MB are held at once
                        out.append((int(group[i]), min(mine, k), max(mine, k), int(mine > k), int(ids[i]), data))
                        size += len(data) + 64
                        if size > SHIP_BYTES:
                            yield shipped_batch(out)
                            out, size = [], 0
            if out:
                yield shipped_batch(out)

    def shipped_batch(out: list[tuple]) -> pa.RecordBatch:
        c, x, y, side, who, data = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), *(pa.array(v, pa.int32()) for v in (x, y, side)), pa.array(who, pa.int64()), pa.array(data, pa.binary())], names=["component", "x", "y", "side", "id", "grams"])

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        sides: list[list[tuple[int, np.ndarray]]] = [[], []]
        for i, side, g in zip(pdf["id"], pdf["side"], pdf["grams"], strict=True):
            if g:
                sides[side].append((int(i), np.frombuffer(g, np.uint64)))
        cross = pdf["x"].iloc[0] != pdf["y"].iloc[0]
        edges = _forest(sides[0], sides[1] if cross else None, percent) if sides[0] and (sides[1] or not cross) else []
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    # as in all joins here, both sides grow with the corpus: never a broadcast
    shipped = known.hint("merge").join(wanted, "id").select("id", "text", "component", "blocks").mapInArrow(ship, "component long, x int, y int, side int, id long, grams binary")
    links = shipped.groupBy("component", "x", "y").applyInPandas(link, "a long, b long")
    fine = connected_components(links.unionByName(placed.filter("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))), "a", "b")
    return placed.hint("merge").join(fine.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
