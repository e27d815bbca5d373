"""Jaccard components, repeated passages and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm.jaccard import Bands, jaccard_components, part_keys
from cairn.llm.packing import Encoder, best_fit, cut, lower_bound, pack, pack_documents, places
from cairn.llm.queries import tokenizer_path
from cairn.llm.repeats import longest_previous_factors, remove_repeats, suffix_order

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent=90):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_components_match_brute_force(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("percent", [80, 90])
def test_chains_of_near_copies(spark, percent, monkeypatch):
    """Copies that drift word by word: links chain far texts together, and large groups are compared block by block."""
    import cairn.llm.jaccard as J

    monkeypatch.setattr(J, "BLOCK_DOCS", 7)
    rng = random.Random(percent)
    texts, words = [], [f"a{rng.randrange(10**6)}" for _ in range(150)]
    for i in range(60):
        words = list(words)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"b{rng.randrange(10**6)}"
        texts.append(" ".join(words))
        if i % 9 == 0:
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, percent=percent).collect()}
    assert got == brute_components(rows, percent)


@pytest.mark.parametrize(("crowd", "sample"), [(1024, 20_000), (1024, 0), (2, 20_000)])
def test_stage_on_five_words(spark, crowd, sample, monkeypatch):
    """The pipeline's stage drops copies from 0.8 of five-word shingles on, whatever passages other documents share."""
    import cairn.llm.jaccard as J
    from corpus_pipeline import near_duplicates

    monkeypatch.setattr(J, "CROWD", crowd)
    monkeypatch.setattr(J, "CROWD_IN_BATCH", crowd)
    monkeypatch.setattr(J, "SAMPLE_DOCS", sample)
    rng = random.Random(3)
    fresh = lambda k: [f"c{rng.randrange(10**9)}" for _ in range(k)]
    base, line = fresh(500), fresh(30)
    texts = [base, base + fresh(80)]  # 496 / 576 = 0.861 at five words, 498 / 578 < 0.9 at three
    for n in (100, 104, 105, 300):  # around 0.8
        one = fresh(n)
        texts += [one, one[: n - 9], [*one, *fresh(24)], [*one, *fresh(25)]]
    edited = [w if i % 50 else "edit" for i, w in enumerate(base)]
    texts += [edited, *([*fresh(rng.randrange(5, 120)), *line, *fresh(10)] for _ in range(20)), fresh(3), [], fresh(4)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [(i, {tuple(t[k : k + 5]) for k in range(len(t) - 4)}) for i, t in enumerate(texts)]
    root = list(range(len(texts)))
    for i, s in sets:
        for j, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert root[1] == 0
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near_duplicates(spark, docs, "").collect()} == {i for i, r in enumerate(root) if i == r}


@pytest.mark.parametrize(("percent", "n"), [(90, 3), (80, 5)])
def test_links_to_what_a_batch_chained_are_kept(spark, percent, n):
    """Hundreds of drafts of one text in a batch, which all its parts are common in, and in another batch a draft that is near to the text alone."""
    words, run = [f"w{i}" for i in range(300)], 13 if percent == 90 else 28
    draft = lambda at, tag: " ".join([*words[:at], *(f"{tag}x{j}" for j in range(run)), *words[at + run :]])
    rows = [(i, draft(run + 5 + i * 7 % (295 - 2 * run), f"v{i}")) for i in range(900)] + [(1000, " ".join(words)), (1001, draft(0, "e"))]
    sets = [{tuple(t.split()[k : k + n]) for k in range(300 - n + 1)} for _, t in rows]
    near = [i for (i, _), s in zip(rows, sets, strict=True) if 100 * len(s & sets[-1]) >= percent * len(s | sets[-1])]
    assert near == [1000, 1001]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionById(2, F.when(F.col("doc_id") == 1001, 1).otherwise(0))
    assert {r.component_id for r in jaccard_components(docs, percent=percent, n=n).collect()} == {0}


def test_components_of_odd_rows(spark, empty):
    assert jaccard_components(empty).isEmpty()
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A b C d"), (9, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(df).collect())
    assert got == [("5", 2, "5"), ("5", 2, "5"), ("7", 2, "5"), ("9", 0, "9"), ("None", 2, "None")]


@settings(max_examples=60, deadline=None)
@given(st.integers(10, 400), st.integers(0, 40), st.randoms(use_true_random=False))
def test_linked_sets_share_a_part(n, changes, rng):
    """No pair over the threshold is lost: some part of both sketches is equal."""
    draw = lambda k: np.array([rng.getrandbits(64) for _ in range(k)], np.uint64)
    a = np.unique(draw(n))
    b = np.unique(np.concatenate([a[min(changes // 2, len(a) - 1) :], draw(changes - changes // 2)]))
    both = len(np.intersect1d(a, b))
    if 100 * both >= 90 * (len(a) + len(b) - both) and not np.array_equal(a, b):
        place, key = part_keys([a, b], 90)
        assert set(key[place == 0].tolist()) & set(key[place == 1].tolist())


def test_bands_reach_all_pairs():
    plan = Bands(90, 5000)
    for b in range(1, 4000):
        i = plan.of(np.array([b, 100 * b // 90]))
        assert i[1] - i[0] <= 1


# ---------------------------------------------------------------- repeated passages


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def removed(df, **options):
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    got = remove_repeats(df, **options).select("doc_id", "n_bytes", size.alias("gone"), F.size("removed").alias("runs"), F.sha2("kept", 256).alias("sha")).collect()
    return {r.doc_id: (r.n_bytes, r.gone, r.runs, r.sha) for r in got}


@pytest.mark.parametrize("crowd", [2000, 1])
def test_repeats_match_brute_force(docs, rows, crowd, monkeypatch):
    import cairn.llm.repeats as R

    monkeypatch.setattr(R, "CROWD", crowd)
    assert removed(docs) == brute_repeats(rows, 100)


def test_repeats_in_periodic_text(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") * rng.randrange(1, 40) for _ in range(30))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert removed(df, length=40, anchor=8) == brute_repeats(rows, 40)


def test_repeats_of_odd_rows(spark, empty):
    assert remove_repeats(empty).isEmpty()
    long = "0123456789" * 2 + "".join(chr(97 + i % 26) for i in range(200))
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.kept)) for r in remove_repeats(df).select("doc_id", "kept").collect())
    first = brute_repeats([(1, long)], 100)[1]
    assert got == [("1", first[0] - first[1]), ("1", first[0] - first[1]), ("2", 0), ("None", len(long))]


@settings(max_examples=150, deadline=None)
@given(st.text("ab", min_size=1, max_size=60) | st.text("ab\xff", min_size=1, max_size=40), st.integers(8, 12))
def test_longest_previous_factors(text, depth):
    """Against every pair of suffixes, up to the depth; the text is padded so that each suffix is so long."""
    data = text.encode() + bytes(range(200, 200 + depth))
    starts = np.arange(len(data) - depth + 1)
    order, common = suffix_order(np.frombuffer(data, np.uint8), starts, depth)
    prefix = [data[i : i + depth] for i in range(len(starts))]
    assert order.tolist() == sorted(range(len(starts)), key=lambda i: (prefix[i], i))
    match = lambda x, y: next((k for k in range(depth) if x[k] != y[k]), depth)
    assert common.tolist() == [0, *(match(prefix[a], prefix[b]) for a, b in zip(order, order[1:], strict=False))]
    factors = dict(zip(order.tolist(), longest_previous_factors(order, common).tolist(), strict=True))
    assert all(factors[i] == max((match(prefix[j], prefix[i]) for j in range(i)), default=0) for i in range(len(starts)))


def test_factors_of_equal_fingerprints(monkeypatch):
    """Hashes that say nothing: what is removed rests on the bytes."""
    import cairn.llm.repeats as R

    monkeypatch.setattr(R.Rolling, "of", lambda self, begin, end: np.zeros(len(begin), np.uint64))
    data = np.frombuffer(b"abcdefghijabcdefghijXbcdefghij", np.uint8)
    first = R.first_equal(data, np.array([0, 10, 20, 1, 11, 21]), 9)
    assert first.tolist() == [0, 0, 2, 3, 3, 3]


# ---------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12))
def test_packing_is_whole(counts):
    packing = pack(counts, 40)
    used = Counter()
    for filling, times in packing:
        assert sum(s * k for s, k in filling) <= 40
        for s, k in filling:
            used[s] += k * times
    assert used == Counter(counts)
    bins = sum(n for _, n in packing)
    assert lower_bound(counts, 40) <= bins <= sum(n for _, n in best_fit(counts, 40))


def test_search_beats_best_fit():
    counts = {7: 4, 6: 4, 4: 4, 3: 4}  # 7+3 and 6+4 fill all bins of 10
    assert sum(n for _, n in pack(counts, 10)) == 8


def fewest_bins(pieces, capacity):
    """By trying every way: each piece into an open bin or a new one."""
    best = len(pieces)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= pieces[i]}.values():
            put(i + 1, rooms[:k] + [rooms[k] - pieces[i]] + rooms[k + 1 :])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_unlimited_search_is_exhaustive(pieces):
    bins = sum(n for _, n in pack(Counter(pieces), 20, None, None, None))
    assert bins == fewest_bins(sorted(pieces, reverse=True), 20)
    assert bins <= sum(n for _, n in pack(Counter(pieces), 20)) <= bins + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab C\t\n'sd.,!|9é\xa0\x85’中ሴ😀<|endoftext>", max_size=20) | st.sampled_from(["<|endoftext|>", "  ", " the", "\n\n", "'ll"]), max_size=8).map("".join))
def test_ids_are_those_of_the_tokenizer(text):
    encoder = Encoder.of(tokenizer_path("byte_bpe_50k.json"))
    texts = [text, "x", text * 3, "", text[::-1]]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.fast is not None and list(encoder.ids([t.encode() for t in texts])) == want


def test_ids_of_long_runs_and_added_tokens():
    encoder = Encoder.of(tokenizer_path("byte_bpe_50k.json"))
    texts = ["a", " " * 3000, "b", "x" * 200_000, "\n " * 400 + "é" * 251, "q" * 500, "a <|endoftext|> b<|endoftext|>"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.ids([t.encode() for t in texts])] == want
    assert want[-1].count(50256) == 2


def test_places_are_gapless():
    ranks = places([(((5, 2), (3, 1)), 2), (((5, 1),), 1)])
    assert ranks == {5: [(0, 2, 0, 0), (4, 1, 2, 0)], 3: [(0, 1, 0, 10)]}


def test_cut():
    assert [(a, n) for a, n, _ in cut(bytes(4 * 10), 4)] == [(0, 2), (2, 4), (6, 4)]
    assert [(a, n) for a, n, _ in cut(bytes(4 * 8), 4)] == [(0, 4), (4, 4)]
    assert [(a, n) for a, n, _ in cut(bytes(4 * 3), 4)] == [(0, 3)]


def test_packed_documents(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["a <|endoftext|> b", "a  b\n\n c\t", "don't I'll <x>", " \xa0 y", "½ Ⅷ 12a 日本 語", "a\x0bb ", "  ", "a \n b  "]
    texts = dict(rows) | {1000 + i: t for i, t in enumerate(odd)}
    got = pack_documents(docs.select("doc_id", "text").unionByName(spark.createDataFrame([(k, texts[k]) for k in texts if k >= 1000], "doc_id long, text string")), path, 64).collect()
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == [sum(m.length for m in mine[:i]) for i in range(len(mine))]
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.length == 64 for r in mine[1:]) and (len(ids) > 64 or len(mine) == 1)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_documents(empty, path).isEmpty()


def test_exhaustive_packing_is_in_reach(spark):
    """Lengths for which best fit alone wastes a sequence; without bounds the operator proves the fewest."""
    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, " the" * n) for i, n in enumerate((5, 5, 3, 3, 3, 2, 2, 2, 2, 1))], "doc_id long, text string")
    got = pack_documents(docs, path, 12, nodes=None, limit=None, steps=None).collect()
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) == -(-total // 12)
