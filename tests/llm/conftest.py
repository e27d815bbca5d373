import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = {"id": 1, "_id": 2, "_text": "x", "key": 3, "n": 4, "score": 0.5, "component": 5, "spans": "s", "h1": 6}


def words_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Exact and near copies, shared passages, repeats in a document, empty, null and long texts, other scripts."""
    rng = random.Random(5)
    base = [words_text(rng, 60 + 7 * i) for i in range(12)]
    passage = words_text(rng, 40)
    rows = [*base, base[0], base[3], base[3]]
    for text in base[4:8]:
        words = text.split()
        words[len(words) // 2] = "changed"
        rows.append(" ".join(words))
        rows.append(" ".join(words[:-20]))
    rows += [f"{base[1][:50]} {passage} {base[2][:60]}", f"{passage}\n{passage}", passage.upper(), "", None, " ", "word", "two words", "äöü ñandú Ελλάδα", words_text(rng, 5000, 3000)]
    rows += ["x" * 300, "x" * 300 + "y", "ab" * 120]
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus over several partitions, with columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in rows], SCHEMA).repartition(5)
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
