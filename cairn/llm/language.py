"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams (2 to 4 bytes, non-letters folded to one space) present in both, over the
geometric mean of how many different ones each has. Texts are compared with a few landmarks (Nyström), and one ridge regression
a language is solved on that. All n-grams count; only those of some landmark can be in common, so only those have a number.

A text's row of the kernel, times the weights of the landmarks, is its row of presences times one small matrix (n-grams by
languages), which is multiplied out once: texts are scored by that sparse product, a slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.bytetext import LOWER, Block, encoded, lookup, slices
from cairn.llm.quality import held_out
from cairn.plans.storage import discard, materialise

TRAIN_ROWS = 600  # expected training rows a language
LANDMARKS = 40  # expected landmarks a language
ALL_ROWS, ALL_LANDMARKS = 24_000, 1_600  # of all languages together; shared out evenly where the numbers a language exceed them
ORDERS = (2, 3, 4)
RIDGE = 1e-2

_FOLD = np.where(lookup(lambda b: b >= 128 or chr(b).isalpha()), LOWER, 0x20).astype(np.uint8)


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Each n-gram of the folded bytes as one number."""
    size = max(0, len(data) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out |= data[i : i + size].astype(np.uint64) << np.uint64(8 * i)
    return out


def present(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of the different n-grams of each text, with a space around it; the length is above the n-gram's 32 bits."""
    block = Block(texts)
    data = _FOLD[block.data]
    begin, end = block.at - 1, block.end + 1
    of, gram = [], []
    for n in ORDERS:
        found = grams(data, n)
        count = np.maximum(end - begin - n + 1, 0)
        owner = np.repeat(np.arange(len(texts)), count)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
        key = np.sort(found[at] | owner.astype(np.uint64) << np.uint64(32))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        of.append((key >> np.uint64(32)).astype(np.int64))
        gram.append((key & np.uint64(0xFFFFFFFF)) | np.uint64(n << 32))
    return np.concatenate(of), np.concatenate(gram)


class Vocabulary:
    """Numbers of known n-grams (from 1; 0 for others): a table of slots, each checked against the n-gram, with the next slots for those that share one."""

    def __init__(self, known: np.ndarray):
        self.size = len(known) + 1
        self.bits = max(10, int(4 * len(known)).bit_length())
        self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        left, step = np.arange(len(known)), 0
        while len(left):  # who finds a slot taken tries the next one
            at = self._slot(known[left], step)
            free = self.numbers[at] == 0
            _, leads = np.unique(at, return_index=True)
            mine = np.zeros(len(left), bool)
            mine[leads] = True
            mine &= free
            self.keys[at[mine]], self.numbers[at[mine]] = known[left[mine]], left[mine] + 1
            left, step = left[~mine], step + 1
        self.steps = step

    def _slot(self, values: np.ndarray, step: int) -> np.ndarray:
        hashed = (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (hashed + step) & ((1 << self.bits) - 1)

    def number(self, values: np.ndarray) -> np.ndarray:
        at = self._slot(values, 0)
        out = np.where(self.keys[at] == values, self.numbers[at], 0)
        open_ = np.flatnonzero((out == 0) & (self.numbers[at] != 0))
        for step in range(1, self.steps):
            at = self._slot(values[open_], step)
            same = self.keys[at] == values[open_]
            out[open_[same]] = self.numbers[at[same]]
            open_ = open_[~same & (self.numbers[at] != 0)]
        return out


@dataclass
class KernelClassifier:
    languages: list[str]
    vocabulary: Vocabulary
    sizes: np.ndarray  # different n-grams of each landmark
    first: np.ndarray  # where the landmarks of each numbered n-gram begin in ``of``
    of: np.ndarray  # landmarks, n-gram by n-gram
    weights: np.ndarray  # landmarks x languages
    product: np.ndarray | None = None  # n-grams x languages

    @classmethod
    def untrained(cls, languages: list[str], sets: list[np.ndarray]) -> "KernelClassifier":
        """On landmarks given by their different n-grams."""
        every, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(inverse, kind="stable")
        counts = np.bincount(inverse, minlength=len(every))
        return cls(languages, Vocabulary(every), np.array([len(x) for x in sets], float), np.concatenate([[0, 0], np.cumsum(counts)]), owner[order], np.zeros((len(sets), len(languages))))

    def _presence(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number) of the n-grams that some landmark has, and how many different ones each text has."""
        text, gram = present(texts)
        number = self.vocabulary.number(gram)
        known = number > 0
        return text[known], number[known], np.bincount(text, minlength=len(texts)).astype(float)

    def kernel(self, texts: list[bytes]) -> np.ndarray:
        """Texts by landmarks."""
        text, number, sizes = self._presence(texts)
        count = self.first[number + 1] - self.first[number]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[number], count)
        both = np.bincount(np.repeat(text, count) * len(self.sizes) + self.of[at], minlength=len(texts) * len(self.sizes)).reshape(len(texts), -1)
        return both / np.sqrt(np.maximum(sizes, 1)[:, None] * np.maximum(self.sizes, 1))

    def settle(self, weights: np.ndarray) -> None:
        """Set the weights, and multiply the landmarks' presences out with them."""
        self.weights = weights
        scaled = weights / np.sqrt(np.maximum(self.sizes, 1))[:, None]
        number = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.product = np.column_stack([np.bincount(number, scaled[self.of, k], len(self.first) - 1) for k in range(weights.shape[1])])

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """``kernel(texts) @ weights``."""
        text, number, sizes = self._presence(texts)
        sums = np.column_stack([np.bincount(text, self.product[number, k], len(texts)) for k in range(self.product.shape[1])])
        return sums / np.sqrt(np.maximum(sizes, 1))[:, None]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and a confidence from 0 to 1: half the regression's value plus a half, clipped."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        margin = self.margins(texts)
        best = margin.argmax(1)
        lettered = np.array([bool(_LETTERS(t)) for t in texts], bool)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, np.where(lettered, np.clip((margin[np.arange(len(best)), best] + 1) / 2, 0, 1), 0.0)


def _LETTERS(text: bytes) -> bool:
    if text.upper() != text.lower():  # an ASCII letter, the usual case
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _share(counts: dict[str, int], wanted: int, lang_col: str, salt: int) -> Column:
    """Condition that keeps about ``wanted`` rows a language (all, if fewer), by a hash of the id and the row's place in the scan.

    The place makes it a share of rows: of many that repeat one id, as few are kept as of others.
    """
    shares = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, wanted / n)) + (n <= wanted))))) if counts else F.lit(None).cast("map<string,int>")
    return F.coalesce(F.pmod(F.xxhash64("_id", "_at", F.lit(salt)), F.lit(1 << 30)) < F.element_at(shares, F.col(lang_col)), F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> KernelClassifier:
    """Learn from rows with a language whose id is not held out (crc32 mod 4 is 2).

    The bounds are per language: about ``rows`` training rows and ``landmarks`` landmarks, rows that repeat an id included; of
    them only the landmarks' n-grams and one kernel row each come to the driver.
    """
    usable = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).alias("_lang")).filter(
        F.col("_lang").isNotNull() & F.col("_id").isNotNull() & ~held_out("_id", 4, 2)
    )
    usable = usable.withColumn("_at", F.monotonically_increasing_id())
    counts = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    rows, landmarks = (max(1, min(n, total // max(1, len(languages)))) for n, total in ((rows, ALL_ROWS), (landmarks, ALL_LANDMARKS)))
    # both samples in one pass over the texts
    sample = materialise(usable.withColumns({"_mark": _share(counts, landmarks, "_lang", 1), "_row": _share(counts, rows, "_lang", 2)}).filter("_mark or _row"))
    kind = usable.schema["_id"].dataType.simpleString()

    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [present([t])[1] for t in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["_id", "_lang", "grams"])

    chosen = sample.filter("_mark").select("_id", "_text", "_lang").mapInArrow(gram_sets, f"_id {kind}, _lang string, grams array<long>").toPandas().sort_values("_id", kind="stable")
    if chosen.empty:
        return KernelClassifier.untrained([], [])
    sets = [np.asarray(g, np.int64).view(np.uint64) for g in chosen["grams"]]
    model = KernelClassifier.untrained(languages, sets)

    def kernel_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(list(model.kernel(texts[a:b])), pa.list_(pa.float64()))], names=["_id", "_lang", "k"])

    of_rows = lambda column: sample.filter(column).select("_id", "_text", "_lang").mapInArrow(kernel_rows, f"_id {kind}, _lang string, k array<double>").toPandas().sort_values("_id", kind="stable")
    marks, taught = of_rows("_mark"), of_rows("_row")
    discard(sample)
    # Nyström: whiten the landmarks' kernel, then ridge regression of +1 / -1 for each language, all languages weighing alike
    among = np.array(marks["k"].tolist()).reshape(len(sets), len(sets))
    value, vector = np.linalg.eigh((among + among.T) / 2)
    solid = value > 1e-6 * value.max()
    whiten = vector[:, solid] / np.sqrt(value[solid])
    target = np.array([languages.index(x) for x in taught["_lang"]], int)
    phi = np.array(taught["k"].tolist()).reshape(-1, len(sets)) @ whiten
    weight = 1 / np.maximum(np.bincount(target, minlength=len(languages)), 1)[target]
    y = np.where(target[:, None] == np.arange(len(languages)), 1.0, -1.0)
    left = (phi * weight[:, None]).T @ phi + RIDGE / max(len(sets), 1) * np.eye(phi.shape[1])
    model.settle(whiten @ np.linalg.solve(left, (phi * weight[:, None]).T @ y))
    return model


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """id, held_out, lang_pred and score for every row, from its whole text alone.

    ``und`` with score 0 where the text is null, empty or has no letter, or where nothing could be learned.
    Repeated rows each give their row; an empty table gives none. A very long text is scored whole, in memory in proportion to it. Other
    columns are not read, whatever they are called.
    """
    model = train(docs, id_col, text_col, lang_col, rows, landmarks)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                names, scores = model.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    found = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
    return found.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "lang_pred", "score")
