"""Licence scan: phrases by an Aho-Corasick automaton, SPDX expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.bytetext import IS_WORD, LOWER, Block, encoded, slices

#: Phrases whose places are counted, with their labels (fixed values).
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notice phrases that only add labels.
NOTICE_PHRASES = {
    "the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license 2": "apache-2",
    "apache 2 0": "apache-2",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: The words of the tag in front of a licence expression.
IDENTIFIER_TAG = "spdx license identifier"
#: How freely a text under the licence may be used, by the first matching prefix of its label; others: UNKNOWN_FREEDOM.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "zlib": 1.0,
    "cc-by-nc": 0.2, "cc-by-nd": 0.3, "cc-by-sa": 0.6, "cc-by": 0.9,
    "mpl": 0.7, "lgpl": 0.6, "agpl": 0.3, "gpl": 0.4, "proprietary": 0.05,
}
UNKNOWN_FREEDOM = 0.25
EXCEPTION_GAIN = 0.2  # a "with" exception lifts some of a licence's conditions

#: First parts of identifiers that are known whatever follows them (fixed values); others are known by a version or their place.
FAMILIES = frozenset(
    "0bsd aal afl agpl apache apsl artistic beerware blueoak boost bsd bsl bzip2 cal cc cc0 cddl cdla cecill cpl curl dco documentref ecl edl efl epl etalab eudatagrid eupl"
    " fsfap ftl gfdl gpl hpnd icu ijg imagemagick intel ipl isc json lgpl libpng libtiff licenseref lppl mit mpl ms mulanpsl ncsa netcdf nist ntp oclc odbl odc ofl ogl oldap openssl osl"
    " pddl php postgresql psf qpl ruby sgi sissl sleepycat sspl tcl unicode unlicense upl vim w3c watcom wtfpl x11 xfree86 zlib zpl".split()
)
_EXCEPTION = re.compile(r"(?i).*(?:exception|-note|-linking).*|additionref-.+|shl-[\d.]+")

_BEFORE = re.compile(r"[ \t:=\"']*")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9.+\-_]+)")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def is_licence(token: str, follows: str | None, first: bool) -> bool:
    """Whether a token names a licence: it has a version, or is of a known family, or begins with a capital and ends its part.

    After an operator, a word of a known family in small letters that prose follows is prose too.
    """
    if not token[:1].isalnum():
        return False
    ends = follows is None or follows in "()" or follows.lower() in _PRECEDENCE
    listed = re.split(r"[-+.]", token.lower(), maxsplit=1)[0] in FAMILIES
    if listed:
        return first or ends or not token.islower() or bool(re.search(r"\d", token))
    versioned = re.fullmatch(r"(?i)[a-z][a-z0-9.+]*(?:-[a-z0-9.+]+)*-v?\d[a-z0-9.+-]*", token) is not None
    return versioned or token[0].isupper() and ends


def tokens(expression: str) -> Iterator[str]:
    """Tokens up to the first character that no expression holds, made as they are asked for."""
    at = 0
    while m := _TOKEN.match(expression, at):
        yield m[1] if m[1] in "()" else m[1].rstrip(".") or "."
        at = m.end()


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the licence expression in postfix order, operators in lower case; None if it names no licence.

    ``with`` binds closest, then ``and``, then ``or``; all associate to the left. An expression ends before the first token
    that cannot follow. Where an operator is followed by neither a licence (an exception, for ``with``) nor a bracket, it and what
    follows are prose, and the expression ends before it. The right side of ``with`` is one exception, never a bracket. Brackets
    that are still open at the end are closed there.
    """
    output: list[str] = []
    waiting: list[str] = []
    operand_next = True
    ahead = tokens(expression)
    token = next(ahead, None)
    while token is not None:
        low, follows = token.lower(), next(ahead, None)
        if operand_next:
            after_with = bool(waiting) and waiting[-1] == "with"
            if token == "(" and not after_with:
                waiting.append(token)
            elif token not in "()" and low not in _PRECEDENCE and (_EXCEPTION.fullmatch(token) if after_with else is_licence(token, follows, not output)):
                output.append(token)
                operand_next = False
            else:
                break
        elif token == ")":
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        elif low in _PRECEDENCE:
            while waiting and waiting[-1] != "(" and _PRECEDENCE[waiting[-1]] >= _PRECEDENCE[low]:
                output.append(waiting.pop())
            waiting.append(low)
            operand_next = True
        else:
            break
        token = follows
    if not output:
        return None
    while operand_next and waiting:  # an operator that leads to nothing, with the brackets after it
        operand_next = waiting.pop() == "("
    return output + [x for x in reversed(waiting) if x != "("]


def label_of(identifier: str) -> str:
    """Label of an SPDX identifier: lower case, without -only, -or-later, + and a trailing .0."""
    low = identifier.lower().rstrip("+")
    low = re.sub(r"-(only|or-later)$", "", low)
    low = re.sub(r"(-\d+)\.0$", r"\1", low)
    return re.sub(r"^(cc-by(?:-[a-z]+)*)-[\d.]+$", r"\1", re.sub(r"^bsd-.*", "bsd", low))


def freedom_of(label: str) -> float:
    """Freedom of the longest prefix listed."""
    known = [p for p in FREEDOM if label == p or label.startswith(p + "-")]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN_FREEDOM


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Labels named by an expression and the freedom it leaves: ``or`` the best side, ``and`` the worst, ``with`` a little more."""
    labels: set[str] = set()
    stack: list[float | str] = []

    def value(x: float | str) -> float:
        if isinstance(x, float):
            return x
        labels.add(label := label_of(x))
        return freedom_of(label)

    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # the right side names an exception, not a licence
            stack.append(min(1.0, value(left) + EXCEPTION_GAIN))
        else:
            stack.append((max if token == "or" else min)(value(left), value(right)))
    return labels, value(stack[0])


class LicenceMatcher:
    """The automaton over all phrases and the tag, and the scan of a block of texts."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tag: str):
        self.base, self.notices, self.tag = base, notices, tag
        self.automaton = ahocorasick.Automaton()
        for phrase in {*base, *notices, tag}:
            self.automaton.add_word(phrase.encode().decode("latin-1"), phrase)
        self.automaton.make_automaton()

    def scan(self, texts: list[bytes]) -> list[dict]:
        block = Block(texts)
        begin, stop, first = block.words()
        found = [{"n_words": int(n), "at": [], "base": set(), "labels": set(), "freedom": []} for n in np.diff(first)]
        # one space after each word, and nothing else between words: phrases become plain strings
        lowered = LOWER[block.data]
        word = IS_WORD[lowered]
        lowered[~word] = 0x20
        lowered[block.end] = 0
        keep = word | np.append(False, word[:-1])
        keep[block.end] = True
        line = lowered[keep].tobytes().decode("latin-1")
        place = np.cumsum(keep) - 1
        starts = place[begin]
        whole = " \0"
        tags: list[tuple[int, int]] = []  # document and place of the first byte after each tag, in order
        for last, phrase in self.automaton.iter(line):
            at = last - len(phrase.encode()) + 1
            if (at and line[at - 1] not in whole) or (last + 1 < len(line) and line[last + 1] not in whole):
                continue
            k = int(np.searchsorted(starts, at))
            doc = int(np.searchsorted(first, k, side="right")) - 1
            hit = found[doc]
            if phrase in self.base:
                hit["at"].append(k - int(first[doc]))
                hit["base"].add(self.base[phrase])
                hit["freedom"].append(freedom_of(self.base[phrase]))
            if phrase in self.notices:
                hit["labels"].add(self.notices[phrase])
                hit["freedom"].append(freedom_of(self.notices[phrase]))
            if phrase == self.tag:
                tags.append((doc, int(stop[k + self.tag.count(" ")]) - int(block.at[doc])))
        for (doc, begins), (next_doc, limit) in zip(tags, [*tags, (-1, 0)][1:], strict=True):
            text = texts[doc]
            limit = limit if next_doc == doc else len(text)  # no expression goes on over the next tag
            ends = text.find(b"\n", begins, limit)
            said = text[begins : ends if ends >= 0 else limit].decode("utf-8", "replace")
            postfix = to_postfix(said[_BEFORE.match(said).end() :])
            if postfix:
                labels, freedom = evaluate(postfix)
                found[doc]["labels"] |= labels
                found[doc]["freedom"].append(freedom)
        return found


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None
) -> DataFrame:
    """Licence statements of every text: one row out for each row in, with the row's id.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased, numbered from 0. ``n_base`` counts every
    place of a base phrase, ``first_word``/``last_word`` are the smallest and largest start (null without one).
    ``labels`` are the base labels, those of the other notice phrases, and the licences named in the expression after an
    ``SPDX-License-Identifier`` tag, which may be as long as its line. ``score`` is the freedom left by the strictest statement, 0 without any.

    A null or empty text has no words, no labels and score 0. Repeated rows each give their row. Other columns are ignored,
    so clashing names do no harm. A narrow job: nothing is shuffled, and a very long text is scanned whole, in time and memory in
    proportion to it; each tag reads its line up to the next tag.
    """
    base, notices = base or BASE_PHRASES, notices or NOTICE_PHRASES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = LicenceMatcher(base, notices, IDENTIFIER_TAG)
        for batch in batches:
            texts = encoded(batch.column(1))
            for a, b in slices(texts):
                found = matcher.scan(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([x["n_words"] for x in found], pa.int64()),
                        pa.array([len(x["at"]) for x in found], pa.int64()),
                        pa.array([min(x["at"], default=None) for x in found], pa.int64()),
                        pa.array([max(x["at"], default=None) for x in found], pa.int64()),
                        pa.array([",".join(sorted(x["base"])) for x in found], pa.string()),
                        pa.array([",".join(sorted(x["base"] | x["labels"])) for x in found], pa.string()),
                        pa.array([min(x["freedom"], default=0.0) for x in found], pa.float64()),
                    ],
                    names=[id_col, *(part.split()[0] for part in SCHEMA.split(", "))],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
