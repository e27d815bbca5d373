"""Quality rules judged for whole hosts.

Each document is measured and tested by some rules. Failures are counted by host, and a host's failure rate is drawn towards that of
all hosts by a beta prior whose mean and strength are fitted to the counts of all hosts: a host of three documents says little about itself, one
of thousands almost all. Documents of a host whose drawn rate passes the limit of a rule go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.bytetext import encoded
from cairn.plans.storage import materialise

WINDOW = 8  # words
LEAST_WORDS, REPEAT_PERCENT = 20, 30
HOST_LIMIT = 0.5  # a host goes when more of its documents than this fail one rule
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6  # documents that the prior counts for: a host's only document never decides alone

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules by name: what makes a document fail, over its measures.
RULES = {
    "short": f"n_words < {LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "words": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE = ("short", "repeats")  # rules that also drop the document itself

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BLANK = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_INNER = np.arange(256) & 0xC0 == 0x80  # further bytes of a character


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` (a power of two) words that occur twice or more.

    Numbers stand for words, then for pairs of numbers, and so on up to the window: equal numbers are equal windows.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    width = 1
    while width < size:
        pairs = number[:-width] * (number.max() + 1) + number[width:]
        _, number, times = np.unique(pairs, return_inverse=True, return_counts=True)
        width *= 2
    starts = np.flatnonzero(times[number] > 1)
    edges = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + size, minlength=len(words) + 1)
    return int((edges.cumsum() > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The ``MEASURES`` of a text in UTF-8."""
    data = np.frombuffer(text, np.uint8)
    words = text.split()  # at ASCII white space
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), int((~(_BLANK | _INNER)[data]).sum()), int(_SYMBOL[data].sum()), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def domain(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and a leading www; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)", 1)
    return F.when(host != "", host)


def measured(docs: DataFrame, id_col: str, text_col: str, host: Column) -> DataFrame:
    """id, host and measures of every row."""
    kinds = [docs.schema[id_col].dataType.simpleString(), "string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = np.array([measure(t) for t in encoded(batch.column(2))], np.int64).reshape(-1, len(MEASURES)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)], names=["id", "host", *MEASURES])

    slim = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kinds[0]}, host string, {', '.join(f'{m} long' for m in MEASURES)}")


def beta_prior(hosts: DataFrame, failures: str, n: str = "n") -> tuple[Column, Column]:
    """Aggregates (mean, strength) of the beta prior of a failure rate over hosts with ``failures`` out of ``n`` documents.

    By moments: how far the hosts' rates lie apart beyond what chance makes of their sizes gives the correlation within a host,
    whose odds are the prior's strength in documents, within bounds. Without any spread to go by, all hosts get about the common rate.
    """
    f, size = F.col(failures).cast("double"), F.col(n).cast("double")
    total, many = F.sum(size), F.count(size) - 1
    mean = F.sum(f) / total
    apart = (F.sum(f * f / size) - mean * F.sum(f)) / F.nullif(mean * (1 - mean), F.lit(0.0))
    room = F.nullif(total - F.sum(size * size) / total - many, F.lit(0.0))
    within = F.coalesce((apart - many) / room, F.lit(0.0))
    strength = F.when(within <= 0, MOST_STRENGTH).otherwise(1 / within - 1)
    return mean, F.least(F.greatest(strength, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def host_verdicts(found: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, a drawn rate for each rule (rate_<rule>) and host_failed, the names of the rules it fails, of each host.

    Counts are partial sums before the shuffle, so one host with most rows is no hot key; only two numbers a rule are seen by the driver.
    """
    counts = [F.sum(F.expr(rule).cast("long")).alias(f"f_{name}") for name, rule in RULES.items()]
    hosts = materialise(found.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *counts))
    fitted = [c.alias(f"{part}_{name}") for name in RULES for part, c in zip("ms", beta_prior(hosts, f"f_{name}"), strict=True)]
    prior = hosts.agg(*fitted).first()
    rates = {name: (F.col(f"f_{name}") + (prior[f"m_{name}"] or 0.0) * (prior[f"s_{name}"] or 0.0)) / (F.col("n") + (prior[f"s_{name}"] or 0.0)) for name in RULES}
    failed = F.array_join(F.array_compact(F.array(*(F.when(rate > limit, F.lit(name)) for name, rate in rates.items()))), ",")
    return hosts.select("host", "n", *(rate.alias(f"rate_{name}") for name, rate in rates.items()), failed.alias("host_failed"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """One row for each row of ``docs``: its id, measures, base_failed, host_failed (rules, comma-joined; else empty) and kept.

    ``host`` is a column of ``docs`` (source, unless given; ``domain`` makes one of a URL). A null text is an empty one and fails; a
    row without a host is judged by itself alone. Repeated rows count each; an empty table gives none. A very long text takes memory in
    proportion to itself. Columns of ``docs`` may have any names.

    Hosts that fail are joined as a table of their own, never broadcast, to a written table, so that Spark splits a hot host.
    """
    found = materialise(measured(docs, id_col, text_col, F.col("source") if host is None else host))
    bad = materialise(host_verdicts(found, limit).filter("host_failed <> ''").select("host", "host_failed"))
    base = F.expr(" OR ".join(f"({RULES[name]})" for name in BASE))
    joined = found.join(bad.hint("merge"), "host", "left").withColumns({"base_failed": base, "host_failed": F.coalesce("host_failed", F.lit(""))})
    out = joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_failed") == ""))
    return out.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "host_failed", "kept")
