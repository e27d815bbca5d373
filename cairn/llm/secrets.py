"""Secret scan with Spark's own functions: patterns, and character Markov models for strings that no pattern names.

Two first-order models are trained from labelled samples: random strings (values found behind secret keywords, and hashes
of row ids in base 64) and ordinary identifiers (the words of the sampled texts). A string is a secret where its mean
log-likelihood ratio a transition exceeds a threshold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.plans.storage import discard, materialise

#: Fixed patterns; the matches of the first are kept where the captured value has MIN_VALUE characters.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "markov")
#: Strings the models judge: whole runs of 16 or more such characters, with a letter and a digit among them.
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
TRAIN_DOCS = 2_000  # texts of the labelled sample, in expectation
THRESHOLD = 0.5  # mean log-likelihood ratio a transition
LONG = 16  # characters of a string that may be a secret
SMOOTHING = 0.5
BLOCK_MATCHES = 256
_SPAN = "array<struct<start:long,kind:int,end:long>>"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points; ``keep`` decides by the matched string.

    The text between matches and the matches themselves, laid end to end, give the places. Matches are gone through in blocks,
    whose spans are moved to their place afterwards: the work stays in proportion to the text, however many there are.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        wanted = pair["hit"].isNotNull() & (keep(pair["hit"]) if keep else F.lit(True))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(wanted, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))

    def all_of(held: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK_MATCHES).cast("int")), lambda k: F.aggregate(F.slice(held, k * BLOCK_MATCHES + 1, F.lit(BLOCK_MATCHES)), start, step))
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPAN}>").alias("parts"))
        return F.flatten(F.aggregate(blocks, begin, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["parts"], F.array(moved(b["spans"], s["at"]))).alias("parts")), lambda s: s["parts"]))

    return F.transform(F.array(pairs), all_of)[0]  # as an argument, so that the pairs are made once


def _when(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPAN))


def _neighbours(string: Column, f) -> Column:
    """f of each character and the next one."""
    symbols = F.split(string, "")
    n = F.greatest(F.length(string) - 1, F.lit(0))
    return F.zip_with(F.slice(symbols, F.lit(1), n), F.slice(symbols, F.lit(2), n), f)


def _transitions(strings: DataFrame, kind: str) -> DataFrame:
    """Counts of character pairs over distinct strings with their weights, as codes below 128."""
    pairs = strings.groupBy("s").agg(F.count("*").alias("n")).select("n", F.explode(_neighbours(F.col("s"), lambda a, b: F.struct(F.ascii(a).alias("a"), F.ascii(b).alias("b")))).alias("two"))
    return pairs.groupBy("two.a", "two.b").agg(F.sum("n").alias("n")).withColumn("kind", F.lit(kind))


def train_ratios(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = TRAIN_DOCS) -> list[float]:
    """Log ratio (random over ordinary) of each transition, at 128 * first + second.

    Trained on about ``sample_docs`` texts, those with the smallest hash of their id; the counts that come to the driver
    are at most two for each pair of 128 characters. Without rows all ratios are 0.
    """
    total = docs.count()
    share = min(1.0, sample_docs / total) if total else 1.0
    hashed = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    sample = materialise(docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), hashed.alias("h")).filter(F.coalesce(F.col("h") < int(share * (1 << 30)) + (share == 1.0), F.lit(False))))
    values = sample.select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(1))).alias("s"))
    drawn = sample.select(F.explode(F.array(*(F.base64(F.unhex(F.sha2(F.concat_ws("-", F.coalesce("id", F.lit("")), F.lit(i)), 256))) for i in range(4)))).alias("s"))
    plain = sample.select(F.explode(F.regexp_extract_all(F.regexp_replace("text", ASSIGN, " "), F.lit(r"[A-Za-z0-9_-]{4,}"), F.lit(0))).alias("s"))
    random = _transitions(values.unionByName(drawn).filter(F.length("s") >= 2), "random")
    # first without the strings that could be unlabelled secrets, which would teach the wrong class; then with those of them that look ordinary
    mixed = F.col("s").rlike("[0-9]") & F.col("s").rlike("[A-Za-z]") & (F.length("s") >= LONG)
    first = _log_ratios(random.unionByName(_transitions(plain.filter(~mixed), "plain")))
    ordinary = ~mixed | (_mean_ratio(F.col("s"), _table(first)) <= 0)
    ratios = _log_ratios(random.unionByName(_transitions(plain.filter(ordinary), "plain")))
    discard(sample)
    return ratios


def _log_ratios(transitions: DataFrame) -> list[float]:
    rows = transitions.filter("a < 128 and b < 128").collect()
    counts = {k: {(r["a"], r["b"]): r["n"] for r in rows if r["kind"] == k} for k in ("random", "plain")}
    used = sorted({x for c in counts.values() for pair in c for x in pair})
    ratios = [0.0] * (128 * 128)
    for a in range(128):
        sums = {k: sum(c.get((a, b), 0) for b in used) + SMOOTHING * max(1, len(used)) for k, c in counts.items()}
        for b in range(128):
            p = {k: (c.get((a, b), 0) + SMOOTHING) / sums[k] for k, c in counts.items()}
            ratios[128 * a + b] = round(math.log(p["random"] / p["plain"]), 4) if used else 0.0
    return ratios


def _table(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")


def _mean_ratio(string: Column, table: Column) -> Column:
    each = _neighbours(string, lambda a, b: F.element_at(table, F.ascii(a) * 128 + F.ascii(b) + 1))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / (F.length(string) - 1)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Spans of secrets in every text: id, base (spans by pattern) and added (spans by the models that touch none of those).

    Spans are structs (start, kind, end) in code points, end exclusive; kind is a place in KINDS. A null or empty text has
    none. Repeated rows each give their row; an empty table gives none; further columns are ignored. A very long text is one value, in
    memory as long as its row is. Apart from the small
    training sample nothing is shuffled, and no text leaves the JVM.
    """
    text = F.col("_text")
    table = _table(train_ratios(docs, id_col, text_col, sample_docs))
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    found = slim.withColumns({
        "_assign": _when((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(ASSIGN), _spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= MIN_VALUE)),
        "_access": _when(F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), _spans(text, ACCESS, 1)),
        "_hex": _when(text.rlike(HEX), _spans(text, HEX, 2)),
        "_other": _when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, 3, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (_mean_ratio(m, table) > threshold))),
    })
    base = found.select(id_col, F.concat("_assign", "_access", "_hex").alias("base"), "_other")
    free = F.filter("_other", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return base.select(id_col, "base", free.alias("added"))


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined_spans(*columns: str) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    return _joined(F.concat(*columns))
