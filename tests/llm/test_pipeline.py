"""The corpus pipeline: every stage, and run(), against plain Python."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from cairn.llm.pii import detect, replace, session_key
from cairn.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEM = " ".join(f"item{i}" for i in range(30))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, _score double, n_words long, n_hit long, items string, _late int, _kinds string, id long, component_id long"


def corpus():
    rng = random.Random(12)
    prose = lambda k: " ".join(rng.choice(["river", "stone", "under", "walks", "light", "paper", "green"]) + str(rng.randrange(40)) for _ in range(k))
    texts = [prose(60) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5] + " more words here", texts[7].upper()]
    texts += [f"{ITEM} {prose(5)}", f"{prose(30)} {ITEM} {prose(30)}", f"{prose(900)} {ITEM}"]
    texts += ["Mail jane.doe@example.com, call +1 017 555 7713. " + prose(30), "Mail jane.doe@example.com now. " + prose(31)]
    texts += [f"Mail john{i}@example.com or call +1 017 555 771{i % 10}. " + prose(32) for i in range(24)]
    texts += [" ".join(w + "###" for w in prose(40).split()) for _ in range(40)]
    texts += [None, "", None, prose(150_000), "x" * 10**6]
    return [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[9])]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 7, 8, "x", 9, "k", 1, 2) for i, t in corpus()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, ""), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, int("###" not in (t or "")), 0) for i, t in corpus() if i is not None and i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def keyed(rows):
    return sorted((str(r.doc_id), r.text or "", r.text is None) for r in rows)


def plain(rows):
    return sorted((str(i), t or "", t is None) for i, t in rows)


def words(text):
    return WORD.findall((text or "").translate(LOW))


def kept_near(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, t in rows if i is not None for w in [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))]}
    gone = set()
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    gone = {i for i, r in root.items() if r != i}
    return [(i, t) for i, t in rows if i not in gone]


def kept_clean(rows):
    windows = {tuple(ITEM.split()[k : k + 13]) for k in range(18)}
    out = []
    for i, t in rows:
        w, hit = words(t), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit |= set(range(k, k + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append((i, t))
    return out


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = C.quality(spark, docs, sf_dir)
    assert scored.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in scored.collect()]
    every = dict(enumerate(t for _, t in corpus()[:-2]))
    good = {i for i, t in every.items() if t and len(t) < 10_000 and "###" not in t}
    assert good <= {i for i, _ in kept} and not {i for i, t in kept if t and "###" in t}

    near = C.near_duplicates(spark, docs, sf_dir)
    assert near.columns == docs.columns and keyed(near.collect()) == plain(kept_near(corpus()))
    clean = C.decontamination(spark, docs, sf_dir)
    assert clean.columns == docs.columns and keyed(clean.collect()) == plain(kept_clean(corpus()))
    private = C.pii(spark, docs, sf_dir).collect()
    key = session_key(spark)
    assert keyed(private) == plain((i, None if t is None else replace(t, key, {})[0]) for i, t in corpus())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and r._late == 9 and r._kinds == "k" for r in private)

    want = kept_clean(kept_near(kept))
    got = C.run(spark, sf_dir).collect()
    tokenizer = __import__("tokenizers").Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = []
    for i, t in want:
        ids = np.array([*tokenizer.encode("" if t is None else replace(t, key, {})[0], add_special_tokens=False).ids, 2], "<u4")
        starts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024)] if len(ids) > 1024 else [0]
        pieces += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(b)[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(sorted(b), sorted(b)[1:], strict=False)) and sum(n for _, n in b) <= 1024 for b in bins.values())
    assert not any(detect(t or "") and (i, t) in [(r.doc_id, r.text) for r in private] for i, t in corpus())


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.isEmpty()
