"""Personal data replaced by keyed surrogates of the same type and format.

A surrogate is a keyed permutation of the entity's symbols, each within its own alphabet (digits, lower and upper letters of one
script, vowels and consonants of a name), so different entities get different surrogates, the same entity the same one
everywhere, and lengths, separators and case stay; only an e-mail address grows, by a top-level domain that is reserved. Names are
replaced word by word, so that a full name, a title with the surname, and capitals all lead to the same surname. A listed
first name becomes another of its gender; one that is not listed keeps its last letter, which tells the gender in many languages. A
check over all entities of the corpus, for names over all surnames, finds surrogates that are real entities of it, or that coincide; those are
drawn again until none is left. Where a format has too few values for that, later draws are longer by one keyed symbol a round.
"""

from __future__ import annotations

import contextlib
import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.bytetext import encoded
from cairn.plans.storage import discard, materialise

KEY = b"replace this key"  # a real run passes its own, see session_key
ATTEMPTS = 12  # draws of the same length

#: First names by gender (fixed values); a name is replaced by another of its row.
FEMALE = (
    "Aisha Alice Amina Amy Anita Anna Anne Barbara Beatrice Carla Carmen Charlotte Chiara Clara Claudia Diana Elena Elizabeth Emily Emma Eva Fatima Francesca Giulia Greta Hanna"
    " Helen Ingrid Irene Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Leila Linda Lisa Lucia Margaret Maria Marie Mary Mei Michelle Monika Nadia Natalia Nina Olga Olivia"
    " Patricia Paula Priya Rosa Sakura Sandra Sarah Silvia Sofia Susan Svetlana Teresa Ursula Valentina Yuki"
).split()
MALE = (
    "Adam Ahmed Albert Alejandro Alexander Andrew Anton Antonio Boris Carlos Charles Christian Daniel David Diego Dmitri Edward Fabio Felix Francisco Frank George Giovanni Hans"
    " Hassan Henry Hiroshi Ibrahim Igor Ivan Jack Jacques James Javier Jean Johann John Jorge Jose Joseph Juan Karl Kenji Kevin Klaus Luca Louis Lukas Marc Marco Martin Michael Miguel Mohammed"
    " Omar Oscar Pablo Paolo Paul Pedro Peter Pierre Rajesh Robert Sergei Stefan Thomas William Wolfgang"
).split()
#: Forms of address, without their full stop; any number of them may come before a name (fixed values).
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Sir Lady Rev Capt Herr Frau Ing Dipl Mag Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Srta Don Doña Signor Signora Dott".split()
#: Small words inside surnames (fixed values).
PARTICLES = "de del della der den des di da dal do dos das du el la las le los van von vom zu zum zur ten ter bin bint ibn al af av y e".split()
#: What announces a name of two words or more (fixed values).
CUES = ("my name is", "My name is", "Name:", "name:", "From:", "To:", "Cc:", "Attn:", "Contact:", "Author:", "signed by", "Sincerely,", "Regards,", "regards,", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo")

_LETTER = r"[^\W\d_]"
_UPPER = r"[^\W\d_a-z]"
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)})\b[ '’])"
_TITLE = rf"(?:{'|'.join(t for x in TITLES for t in (x, x.upper()))})\b"
_INITIAL = rf"{_UPPER}\.(?:[ -]?(?={_UPPER}))"
_NAME_WORD = rf"(?!{_TITLE})(?:{_UPPER}['’])?{_UPPER}{_LETTER}{{1,39}}(?:[-'’](?:{_UPPER}['’])?{_UPPER}{_LETTER}{{1,39}})*(?!\w)"
_RUN = rf"(?:{_INITIAL})*{_PARTICLE}*{_NAME_WORD}(?: (?:{_INITIAL})*{_PARTICLE}*{_NAME_WORD})*"
_CAPITAL = re.compile(rf"\b[A-Z]{_LETTER}*")
_CHAIN = re.compile(rf"(?:{_TITLE}\.?(?:[ -]|(?<=\.)))+")
_NAMED = re.compile(rf"({_RUN})")
_FOLLOWED = re.compile(rf"({_NAME_WORD}(?: (?:{_INITIAL})*{_PARTICLE}*{_NAME_WORD})+)")
_SHOUTED = re.compile(rf"([A-Z]{{2,40}}(?:-[A-Z]{{2,40}})? (?:[A-Z]\. )*(?:[A-Z]['’])?[A-Z]{{2,40}}(?:-[A-Z]{{2,40}})?)\b")
_CUED = re.compile(rf"(?:{'|'.join(map(re.escape, CUES))})\s{{1,4}}({_NAME_WORD}(?: (?:{_INITIAL})*{_PARTICLE}*{_NAME_WORD})+)")
_TURNED = re.compile(rf"(?:^|[;:(\[\n\t\"])[ ]?({_PARTICLE}*{_NAME_WORD}, ([A-Z]{_LETTER}{{1,39}})(?: [A-Z]\.)?)(?= ?(?:[;,.)\]\n\"]|$))", re.MULTILINE)
_SUFFIXED = re.compile(rf"({_NAME_WORD}(?: (?:{_INITIAL})*{_PARTICLE}*{_NAME_WORD})+)(?=,? (?:Jr|Sr|Ph\.?D|M\.?D|Esq)\b)")
_ENDINGS = (" Jr", " Sr", "PhD", "Ph.D", " MD", " M.D", " Esq")
_TITLE_WORDS = {t for x in TITLES for t in (x, x.upper())}
_GIVEN = {x: row for row in (FEMALE, MALE) for x in row}
_SHOUTS = {x.upper() for x in _GIVEN}

_RIGHT = r"(?![A-Za-z0-9])"
_NUMBERS = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    rf"(?P<iban>[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_RIGHT})"
    r"|(?P<ip6>(?<!:)(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![:\w]|\.\d)|(?<!:)[0-9A-Fa-f]{1,4}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}(?![:\w]|\.\d))"
    r"|(?P<ip>(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?[A-Za-z0-9]))"
    rf"|(?P<phone>\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?\d{{2,4}}){{2,4}}{_RIGHT}|\(\d{{3}}\) ?\d{{3}}-\d{{4}}{_RIGHT}|\d{{3}}[-.]\d{{3}}[-.]\d{{4}}{_RIGHT})"
    rf"|(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}}{_RIGHT})"
    rf"|(?P<card>\d(?:[ -]?\d){{12,18}}{_RIGHT})"
    r")"
)
# an address is sought from its @, so that long words without one cost nothing
_MAILBOX = re.compile(r"[\w%+-]+(?:\.[\w%+-]+)*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_MAYBE_NUMBERS = re.compile(r"\d\d|\d[.)]")
#: Country calling codes of one digit and of two (fixed values); all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_TRUNK = "(0)"  # dialled within the country only

Entity = tuple[int, int, str, str]  # start, end, kind, canonical value


def _iban_valid(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Places of e-mail addresses: the longest mailbox that ends at an @, and the domain after it."""
    turned, last = "", 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            turned = turned or text[::-1]
            mailbox = _MAILBOX.match(turned, len(text) - at, len(text) - last)
            if mailbox:
                yield at - len(mailbox[0]), domain.end()
                last = domain.end()
        at = text.find("@", at + 1)


def _canonical(kind: str, said: str) -> str | None:
    """The same value for every way of writing an entity; null if it is none after all."""
    if kind == "iban":
        value = said.replace(" ", "")
        return value if _iban_valid(value) else None
    if kind == "phone":
        digits = re.sub(r"\D", "", said.replace(_TRUNK, "", 1) if said.startswith("+") else said)
        if not said.startswith("+"):
            return f":{digits}"
        code = next((digits[:k] for k in (1, 2) if digits[:k] in SHORT_CODES), digits[:3])
        return f"{code}:{digits[len(code) :]}"
    if kind == "ip6":
        with contextlib.suppress(ValueError):
            return ipaddress.IPv6Address(said).exploded
        return None
    if kind == "card":
        value = re.sub(r"\D", "", said)
        # an unbroken number needs the check digit; groups are a card's by their look
        return value if not value.isascii() or said != value or _luhn(value[:-1]) == int(value[-1]) else None
    return said if kind == "ip" else re.sub(r"\D", "", said)


def full_name(said: str) -> str:
    """A name with words in capitals written like others."""
    return re.sub(rf"{_LETTER}+", lambda m: m[0][0] + m[0][1:].lower() if m[0].isupper() and len(m[0]) == len(m[0].lower()) else m[0], said)


def names(text: str) -> Iterator[tuple[int, int]]:
    """Places of names, without their titles: after titles, from a listed first name on, after a word that announces one, before
    what only follows names, and surname first. A name goes on over words that begin with a capital, initials and particles."""
    until = 0
    for m in _CAPITAL.finditer(text):
        word = m[0]
        found = None
        if m.start() >= until:
            if word in _TITLE_WORDS:
                chain = _CHAIN.match(text, m.start())
                if chain:
                    until = chain.end()
                    found = _NAMED.match(text, until)
            elif word in _GIVEN:
                found = _FOLLOWED.match(text, m.start())
            elif word in _SHOUTS:
                found = _SHOUTED.match(text, m.start())
        if found:
            until = found.end()
            yield found.span(1)
    if any(cue in text for cue in CUES):
        yield from (m.span(1) for m in _CUED.finditer(text))
    if any(x in text for x in _ENDINGS):
        yield from (m.span(1) for m in _SUFFIXED.finditer(text))
    if ", " in text:
        yield from (m.span(1) for m in _TURNED.finditer(text) if m[2] in _GIVEN)


def detect(text: str) -> list[Entity]:
    """Entities of a text, not overlapping, in order; where two kinds overlap, addresses go before numbers and those before names."""
    found: list[Entity] = [(a, b, "email", text[a:b].lower()) for a, b in addresses(text)] if "@" in text else []

    def free(a: int, b: int, taken: list[Entity]) -> bool:
        k = bisect_left(taken, (b,))
        return not k or taken[k - 1][1] <= a

    if _MAYBE_NUMBERS.search(text):
        taken = list(found)
        for m in _NUMBERS.finditer(text):
            if free(*m.span(), taken) and (value := _canonical(m.lastgroup, m[0])) is not None:
                found.append((m.start(), m.end(), m.lastgroup, value))
    taken, last = sorted(found), 0
    for a, b in sorted(names(text), key=lambda x: (x[0], -x[1])):
        if a >= last and free(a, b, taken):
            found.append((a, b, "name", full_name(text[a:b])))
            last = b
    return sorted(found)


def parts_of(kind: str, value: str) -> list[str]:
    """The values of an entity that are looked up in the corpus: of a name its surnames, of others the value."""
    return [value[a:b] for a, b, role in _words(value) if role == "surname"] if kind == "name" else [value]


def _words(name: str) -> list[tuple[int, int, str]]:
    """Words of a name as (start, end, role): listed, given, surname or initial; particles and what an apostrophe cuts off are none."""
    whole = [m.span() for m in re.finditer(r"[^ ,]+", name)]
    full = [(a, b) for a, b in whole if name[a:b] not in PARTICLES]
    turned = ", " in name
    out = []
    for a, b in full:
        for m in re.finditer(rf"{_LETTER}+", name[a:b]):
            x, y = a + m.start(), a + m.end()
            if y - x == 1:
                role = "" if name[y : y + 1] in ("'", "’") else "initial"
            elif m[0] in _GIVEN and (len(full) > 1 or b - a > y - x):
                role = "listed"
            else:
                role = "given" if len(full) > 1 and (a, b) == full[-1 if turned else 0] else "surname"
            if role and not (role == "surname" and m[0] in PARTICLES):
                out.append((x, y, role))
    return out


# ---------------------------------------------------------------- keyed permutation


def permute(symbols: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of sequences: in turn, even and odd places are shifted by amounts that hang on the other ones."""
    out = list(symbols)
    for turn in range(8):
        mine = range(turn % 2, len(out), 2)
        other = ",".join(str(out[i]) for i in range(1 - turn % 2, len(out), 2))
        stream = hashlib.shake_256(key + f"|{tweak}|{turn}|{len(out)}|{radices}|{other}".encode()).digest(4 * len(mine))
        for k, i in enumerate(mine):
            out[i] = (out[i] + int.from_bytes(stream[4 * k : 4 * k + 4], "big")) % radices[i]
    return out


def _span(a: str, b: str, leave: str = "") -> str:
    return "".join(chr(c) for c in range(ord(a), ord(b) + 1) if chr(c) not in leave)


#: Alphabets by script and case; a symbol stays in its own.
_ALPHABETS = [_span("0", "9"), _span("a", "z"), _span("A", "Z"), _span("ß", "ÿ", "÷"), _span("À", "Þ", "×"), _span("α", "ω"), _span("Α", "Ω", "΢"), _span("а", "я"), _span("А", "Я")]
_NAME_ALPHABETS = ["aeiou", "".join(c for c in _span("b", "z") if c not in "aeiou"), "AEIOU", "".join(c for c in _span("B", "Z") if c not in "AEIOU"), *_ALPHABETS[3:]]


class _Places(dict[str, tuple[str, int] | None]):
    """Alphabet and place of every letter and digit, null for other characters.

    Of a script without an alphabet above, it is the characters of the same script and kind within 256 code points, and the
    ten digits of a kind.
    """

    def __missing__(self, c: str) -> tuple[str, int] | None:
        self[c] = None
        if c.isalnum():
            kind, script = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]
            if kind == "Nd":
                zero = ord(c) - unicodedata.decimal(c)
                alphabet = _span(chr(zero), chr(zero + 9))
            else:
                window = [x for x in map(chr, range(ord(c) & ~255, (ord(c) | 255) + 1)) if x.isalnum() and unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script]
                alphabet = "".join(x for x in window if self.get(x) is None)
            self |= {x: (alphabet, i) for i, x in enumerate(alphabet)}
        return self[c]


@lru_cache(maxsize=4)
def _places(named: bool) -> _Places:
    return _Places({c: (alphabet, i) for alphabet in (_NAME_ALPHABETS if named else _ALPHABETS) for i, c in enumerate(alphabet)})


def cipher(value: str, key: bytes, tweak: str, named: bool = False) -> str:
    """Permute the letters and digits of a string, each within its alphabet; other characters stay."""
    known = _places(named)
    at = [i for i, c in enumerate(value) if known[c]]
    moved = permute([known[value[i]][1] for i in at], [len(known[value[i]][0]) for i in at], key, tweak)
    out = list(value)
    for i, s in zip(at, moved, strict=True):
        out[i] = known[value[i]][0][s]
    return "".join(out)


def _longer(drawn: str, width: int, value: str, key: bytes, tweak: str, named: bool = False) -> str:
    """``drawn`` with ``width`` further keyed symbols of the alphabet of its last letter or digit."""
    known = _places(named)
    alphabet = next((known[c][0] for c in reversed(drawn) if known[c]), known["a"][0])
    stream = hashlib.shake_256(key + f"|{tweak}|longer|{value}".encode()).digest(4 * width)
    return drawn + "".join(alphabet[int.from_bytes(stream[4 * k : 4 * k + 4], "big") % len(alphabet)] for k in range(width))


def _luhn(payload: str) -> int:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(payload))))
    return -total % 10


def surrogate(kind: str, value: str, key: bytes = KEY, attempt: int = 0) -> str:
    """Canonical surrogate of a canonical value; ``attempt`` draws another one, from ATTEMPTS on a longer one each time."""
    tweak, width = f"{kind}|{attempt}", max(0, attempt - ATTEMPTS + 1)
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        return f"{_longer(cipher(local, key, tweak), width, value, key, tweak)}@{cipher(domain, key, tweak)}.example"
    if kind == "ip":
        drawn = permute([int(x) for x in value.split(".")], [256] * 4, key, tweak)
        return ".".join(map(str, [*drawn, *hashlib.shake_256(key + f"|{tweak}|longer|{value}".encode()).digest(width)]))
    if kind == "phone":
        code, rest = value.split(":")
        return f"{code}:{_longer(cipher(rest, key, tweak + code), width, value, key, tweak)}"
    if kind == "card":  # the last digit keeps its distance from the check digit, so valid numbers stay valid
        payload = _longer(cipher(value[:-1], key, tweak), width, value, key, tweak)
        digits = _places(False)[value[-1]][0]
        return payload + digits[(_luhn(payload) + int(value[-1]) - _luhn(value[:-1])) % 10]
    if kind == "iban":
        body = value[:2] + "00" + _longer(cipher(value[4:], key, tweak), width, value, key, tweak)
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        return f"{value[:2]}{check:02d}{body[4:]}"
    if kind == "ip6":
        drawn = permute([int(x, 16) for x in value.split(":")], [1 << 16] * 8, key, tweak)
        return ":".join(f"{x:04x}" for x in drawn) if not width else f"{':'.join(f'{x:04x}' for x in drawn)}:{width:x}"
    if kind == "name":
        return name_surrogate(value, key, lambda _: attempt)
    return _longer(cipher(value, key, tweak), width, value, key, tweak)


def name_surrogate(name: str, key: bytes, attempt_of: Callable[[str], int]) -> str:
    """A name with every word replaced by its role; ``attempt_of`` a surname says which of its draws stands."""
    out, last = [], 0
    for a, b, role in _words(name):
        word = name[a:b]
        if role == "listed":
            row = _GIVEN[word]  # another of its row: turned by a keyed number that is never 0
            turn = int.from_bytes(hashlib.shake_256(key + f"|listed|{len(row)}".encode()).digest(8), "big") % (len(row) - 1)
            new = row[(row.index(word) + 1 + turn) % len(row)]
        elif role == "given":
            new = word
            while new == word or new in _GIVEN:  # a listed name is what only a listed one becomes
                new = cipher(new[:-1], key, "name|given" + new[-1:], True) + new[-1]
                if new == word:
                    break
        elif role == "initial":
            new = cipher(word, key, "name|initial", True)
        else:
            attempt = attempt_of(word)
            tweak = f"name|{attempt}|last"
            new = _longer(cipher(word, key, tweak, True), max(0, attempt - ATTEMPTS + 1), word, key, tweak, True)
        out += [name[last:a], new]
        last = b
    return "".join([*out, name[last:]])


def render(said: str, kind: str, replacement: str) -> str:
    """The canonical surrogate in the way the mention was written."""
    if kind == "email":
        return replacement.upper() if said.isupper() else "".join(c.upper() if k < len(said) and said[k].isupper() else c for k, c in enumerate(replacement))
    if kind == "ip6":
        with contextlib.suppress(ValueError):
            short = ipaddress.IPv6Address(replacement).compressed
            return short.upper() if said.upper() == said and said.lower() != said else short
        return replacement
    if kind == "name":
        shouted = [len(w) > 1 and w.isupper() and len(w) == len(w.lower()) for w in re.findall(rf"{_LETTER}+", said)]
        at = iter(shouted)
        return re.sub(rf"{_LETTER}+", lambda m: m[0].upper() if next(at, False) else m[0], replacement)
    if kind == "ip":
        return replacement
    kept = said.find(_TRUNK) if kind == "phone" and said.startswith("+") else -1
    symbols = iter(replacement.replace(":", ""))
    return "".join([*(c if not c.isalnum() or kept <= k < kept + len(_TRUNK) and kept >= 0 else next(symbols) for k, c in enumerate(said)), *symbols])


def replace(text: str, key: bytes, other: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """Text with surrogates, and the kinds replaced; ``other`` has the attempt of entities, or surnames, whose first draw collided."""
    out, last, kinds = [], 0, []
    for a, b, kind, value in detect(text):
        if kind == "name":
            new = name_surrogate(value, key, lambda word: other.get(("name", word), 0))
        else:
            new = surrogate(kind, value, key, other.get((kind, value), 0))
        out += [text[last:a], render(text[a:b], kind, new)]
        last = b
        kinds.append(kind)
    return "".join([*out, text[last:]]), kinds


# ---------------------------------------------------------------- over a corpus


def _mentions(docs: DataFrame, id_type: str) -> DataFrame:
    """(_id, _text) to the different entities, and surnames, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, values = [], [], []
            for i, text in enumerate(encoded(batch.column(1))):
                for kind, value in {(k, part) for _, _, k, v in detect(text.decode()) for part in parts_of(k, v)}:
                    at.append(i)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["_id", "kind", "value"])

    return docs.mapInArrow(run, f"_id {id_type}, kind string, value string")


def _drawn(entities: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, v, key, attempt) for k, v in zip(kinds, values, strict=True)], pa.string())], names=["kind", "value", "drawn"])

    return entities.mapInArrow(run, "kind string, value string, drawn string")


def resolve(entities: DataFrame, key: bytes = KEY, draw: Callable[[DataFrame, bytes, int], DataFrame] = _drawn) -> DataFrame:
    """kind, value, attempt for the entities whose first draw cannot stand; materialised.

    A draw stands if it is no entity of the corpus, no surrogate that stands already, and, of those that draw it in the same
    round, the smallest value has it. After ATTEMPTS draws each is longer than the one before, so that all entities find a
    free one in the end, however many share a format.
    """
    entities = materialise(entities)
    pending, standing, late = entities, None, None
    for attempt in count():
        drawn = draw(pending, key, attempt)
        taken = entities.select("kind", F.col("value").alias("drawn"))
        if standing is not None:
            taken = taken.unionByName(standing.select("kind", "drawn"))
        # all of these grow with the corpus: never a broadcast
        first = drawn.join(taken.hint("merge"), ["kind", "drawn"], "left_anti").groupBy("kind", "drawn").agg(F.min("value").alias("value"))
        fixed = materialise(first.withColumn("attempt", F.lit(attempt)))
        standing = fixed if standing is None else standing.unionByName(fixed)
        if attempt:
            late = fixed if late is None else late.unionByName(fixed)
        before, pending = pending, materialise(pending.join(fixed.hint("merge"), ["kind", "value"], "left_anti").select("kind", "value"))
        if attempt:
            discard(before)
        if pending.isEmpty():
            if late is None:
                return fixed.filter(F.lit(False)).select("kind", "value", "attempt")
            return late.select("kind", "value", "attempt")
    raise AssertionError("unreachable")


def replace_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY, kinds_col: str = "pii_kinds") -> DataFrame:
    """Every row with its text's entities replaced and ``kinds_col``, the kinds replaced in order; all other columns as they are.

    A text without entities, null included, is unchanged. Repeated rows get the same replacement; an empty table gives
    none; columns may have any names. A very long text is searched whole, in time and memory in proportion to it. The first draw is made where the text is; only entities that had to be drawn again are
    joined in by id.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    mentions = materialise(_mentions(slim, kind))
    late = resolve(mentions.select("kind", "value").distinct(), key)
    extra = materialise(mentions.hint("merge").join(late, ["kind", "value"]).distinct().groupBy(F.col("_id").alias("of")).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("late")))
    discard(mentions)
    # by place, not by name: whatever the columns are called, nothing clashes
    place, own = docs.columns.index(text_col), [f"c{k}" for k in range(len(docs.columns))]
    joined = docs.toDF(*own).join(extra, F.col(own[docs.columns.index(id_col)]).eqNullSafe(F.col("of")), "left").drop("of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            texts, kinds = [], []
            for text, redrawn in zip(column.to_pylist(), batch.column(len(own)).to_pylist(), strict=True):
                new, found = (None, []) if text is None else replace(text, key, {(x["kind"], x["value"]): x["attempt"] for x in redrawn or []})
                texts.append(new)
                kinds.append(found)
            columns = [*batch.columns[:-1]]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.list_(pa.string()))], names=[*own, "kinds"])

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(own, docs.schema, strict=True))
    return joined.mapInArrow(run, f"{schema}, kinds array<string>").toDF(*docs.columns, kinds_col)


def session_key(spark: SparkSession) -> bytes:
    """The key set as ``spark.cairn.pii.key``; without one a fixed key, for tests only."""
    return spark.conf.get("spark.cairn.pii.key", KEY.decode()).encode()


def joined_kinds(kinds_col: str = "pii_kinds") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(kinds_col)), ",")
