"""PII surrogates: each entity becomes another of its own kind, by key.

Entities are found map-side. A surrogate is the image of the entity's canonical form under a keyed
permutation of all forms of that shape (digits stay digits, letters letters of their case and
script, names in the name lists stay in the list of their gender and script). A permutation keeps
distinct entities distinct and one entity one, in all documents and on all executors, with no table
of what has been seen; it has no fixed point, so nothing stays as it was. ``collisions`` checks that
over a whole corpus: no two entities of a kind with one surrogate, no entity with two.

Names are found after an honorific, and where a listed first name precedes a capitalised word, on one line; a
function word ends a name, a possessive 's is no part of it. Their words are then replaced wherever they
stand alone in the same document, each by the same surrogate.

The permutation of a set of n forms, numbered 0 to n - 1, is x -> D(E(x) + c mod n), where E is a
Feistel network with keyed rounds as wide as its halves, walked until it falls below n, D its inverse and
c a keyed shift from 1 to n - 1. A longer entity is permuted in blocks, forward and back, each under a tweak
that holds all that lies before it in its direction: every place depends on the whole, at any length.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow

ROUNDS = 6

# Honorifics by gender, and first names by gender and script, which map within their list.
HONORIFICS = {"mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "sir": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "mme": "f", "madame": "f", "señora": "f", "sra": "f", "dr": "x", "prof": "x", "г-н": "m", "г-жа": "f"}
FIRST_NAMES = {
    ("f", "latin"): "Alice Anna Barbara Carla Catherine Clara Diana Elena Elizabeth Emma Eva Hannah Helen Ines Isabel Jane Jennifer Julia Karen Laura Linda Lisa Lucia Margaret Maria Marie Martha Mary Nancy Nina Olivia Patricia Rosa Ruth Sandra Sarah Sofia Sophie Susan Teresa".split(),
    ("m", "latin"): "Adam Albert Alexander Andrew Anton Carlos Charles Daniel David Diego Edward Eric Felix Francis Frank George Hans Henry Hugo Ivan Jacob James John Joseph Karl Louis Lucas Mark Martin Max Michael Oscar Paul Peter Richard Robert Simon Thomas Victor William".split(),
    ("f", "cyrillic"): "Алина Анна Вера Дарья Елена Ирина Мария Наталья Ольга София Татьяна Юлия".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
}
# The letters of a shape, vowels and others apart so that a made-up name can be spoken.
ALPHABETS = {
    "latin_vowel": "aeiou", "latin": "bcdfghjklmnpqrstvwxyz",
    "marked_vowel": "àáâäèéêëìíîïòóôöùúûü", "marked": "çñß",
    "cyrillic_vowel": "аеиоуыэюя", "cyrillic": "бвгджзйклмнпрстфхцчшщъь",
    "greek_vowel": "αεηιουω", "greek": "βγδζθκλμνξπρστφχψ",
    "wide_vowel": "ａｅｉｏｕ", "wide": "ｂｃｄｆｇｈｊｋｌｍｎｐｑｒｓｔｖｗｘｙｚ",
}
_CLASS = {c: letters for letters in ALPHABETS.values() for c in letters}


def low(text: str) -> str:
    """Lower case, character by character: letters whose lower case is longer stay."""
    return text if text.isascii() and text.islower() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _steady(c: str, category: str) -> bool:
    """A letter that is its own lower case and comes back from its upper case, or stays without one."""
    return unicodedata.category(c) == category and c not in _CLASS and c.lower() == c and (len(c.upper()) > 1 or low(c.upper()) == c)


@lru_cache(10_000)
def letters_like(c: str) -> str | None:
    """The letters that c may become: its alphabet, or those of its category in its row of 64 code points; None: it stays."""
    if c in _CLASS:
        return _CLASS[c]
    category, row = unicodedata.category(c), ord(c) // 64 * 64
    if category not in ("Ll", "Lo") or not _steady(c, category):
        return None
    return "".join(x for x in map(chr, range(row, row + 64)) if _steady(x, category))


# Words that no name has, in the languages of the honorifics.
FUNCTION_WORDS = frozenset("""a about after all also am an and are as at be because before but by can did do does for from had has have he her here his how i if in into is it its me my no not of on one or our she so some that the their them then there these they this those to too was we were what when where which while who why with you your
aber als am auch auf aus bei bin bist das dass dem den der des die doch du ein eine einen einer er es für hat ich ihr im ist mit nach nicht noch oder sie sind und uns von war warum was wenn wer wie wir wo zu zum zur
au aux avec ce ces cette dans de des du elle elles en est et eux il ils je la le les leur leurs mais nous où ou par pas pour puis que qui sa ses son sont sur tu un une vous
al como con cuando del donde el ella ellos era esta este los las más muy nos para pero por porque qué que se si sin su sus también un una yo""".split())

_NAME = r"[^\W\d_](?:[^\W\d_]|(?!['’][sS](?!\w))['’-](?=[^\W\d_]))+(?!\w)"
#: What may stand between the words of a name: a line's end may not.
_GAP = "[ \\t\\xa0]"
#: Patterns in order of precedence where two begin at one place; the group "it", where there is one, is the entity.
PATTERNS = {
    "secret": r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)["']?(?:\s+is)?\s*[:=]\s*["']?(?P<it>[A-Za-z0-9_\-+/=]{8,})""",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "number": r"(?<![\w.-])\d(?:[ -]?\d){8,18}(?![\w-])",
    "passport": r"(?i:\bpassport(?: no\.?| number)?)[:#\s]{1,3}(?P<it>[A-Z]{1,2}\d{6,8})(?!\w)",
    "address": r"(?<![\w.-])\d{1,5} [A-Z][a-z]+(?: [A-Z][a-z]+)? (?:Street|Avenue|Road|Lane|Boulevard|Drive)\b",
    "name": rf"(?i:\b(?:{'|'.join(HONORIFICS)})\b)\.?{_GAP}(?P<it>(?=[^\W\d_])(?-i:{_NAME}(?:{_GAP}{_NAME}){{0,2}}))",
}
#: A listed first name, as it is or in capitals, before another capital (letters first: that makes the search fast), and up to three words of one line.
_FIRST = re.compile("(?:" + "|".join(re.escape(x) for names in FIRST_NAMES.values() for name in names for x in (name, name.upper())) + r")(?=[ \t\xa0][^\W\d_a-z])")
_ON_LINE = re.compile(rf"(?:{_NAME})(?:{_GAP}(?:{_NAME})){{1,2}}")
_WORD = re.compile(rf"(?<![\w])(?:{_NAME})")


#: A round is one block of the hash up to so many bits, and a stream of it beyond.
HASH_BITS = 256
#: Digits that are permuted together; a longer list is taken in blocks.
BLOCK = 512


def _bytes(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "big")


def _round(key: bytes, tweak: str, i: int, value: int, bits: int = HASH_BITS) -> int:
    """A keyed number of at least so many bits."""
    if bits <= HASH_BITS:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|" % (i, value) + tweak.encode(), key=key, digest_size=32).digest(), "big")
    told = tweak.encode()
    stream = hashlib.shake_256(key + b"%d|%d|%d|" % (i, bits, len(told)) + told + _bytes(value))
    return int.from_bytes(stream.digest((bits + 7) // 8), "big")


def _feistel(key: bytes, tweak: str, n: int, x: int, forward: bool) -> int:
    """A keyed permutation of 0 .. n - 1, or its inverse."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for i in range(ROUNDS) if forward else reversed(range(ROUNDS)):
            if forward:
                left, right = right, left ^ (_round(key, tweak, i, right, half) & mask)
            else:
                left, right = right ^ (_round(key, tweak, i, left, half) & mask), left
        x = left << half | right
        if x < n:
            return x


def permute(key: bytes, tweak: str, n: int, x: int) -> int:
    """Where x of 0 .. n - 1 goes: never to itself if n is over 1."""
    if n < 2:
        return x
    bits = n.bit_length()
    shift = 1 + _round(key, tweak, -1, n, bits + 64 if bits > 2 * HASH_BITS else HASH_BITS) % (n - 1)
    return _feistel(key, tweak, n, (_feistel(key, tweak, n, x, True) + shift) % n, False)


def _mixed(key: bytes, tweak: str, radices: list[int], digits: list[int]) -> list[int]:
    """Permutes all lists of digits below radices."""
    if len(digits) > BLOCK:
        return _chained(key, tweak, radices, digits)
    n, x = 1, 0
    for r, d in zip(radices, digits, strict=True):
        n, x = n * r, x * r + d
    x = permute(key, f"{tweak}|{radices}", n, x)
    out = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def _chained(key: bytes, tweak: str, radices: list[int], digits: list[int]) -> list[int]:
    """A permutation of long lists: block by block from the front, then from the back, each under what precedes it."""
    whole = hashlib.blake2b(f"{tweak}|{radices}".encode(), digest_size=32).hexdigest()
    starts = range(0, len(digits), BLOCK)
    for turn, order in enumerate((starts, reversed(starts))):
        before, out = hashlib.blake2b(b"%d" % turn, digest_size=32), list(digits)
        for at in order:
            part = slice(at, at + BLOCK)
            out[part] = _mixed(key, f"{whole}|{turn}|{at}|{before.hexdigest()}", radices[part], digits[part])
            before.update(b",".join(b"%d" % d for d in digits[part]) + b";")
        digits = out
    return digits


def _shape(key: bytes, tweak: str, text: str, hexadecimal: bool = False) -> str:
    """Permutes the digits and letters of a lower-case text, each within its class; all else stays and is part of the shape."""
    classes = ["0123456789abcdef" if hexadecimal and c in "0123456789abcdef" else "0123456789" if c in "0123456789" else letters_like(c) for c in text]
    places = [i for i, c in enumerate(classes) if c]
    if not places:
        return text
    fixed = "".join("\0" if c else t for c, t in zip(classes, text, strict=True))
    new = _mixed(key, f"{tweak}|{fixed}|{[classes[i][:1] for i in places]}", [len(classes[i]) for i in places], [classes[i].index(text[i]) for i in places])
    out = list(text)
    for i, d in zip(places, new, strict=True):
        out[i] = classes[i][d]
    return "".join(out)


def _like(new: str, old: str) -> str:
    """new in the case of old, character by character."""
    return "".join(n.upper() if o != o.lower() and len(n.upper()) == 1 else n for n, o in zip(new, old, strict=True))


def _pour(digits: str, old: str) -> str:
    """digits in the places of old's digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in old)


def luhn(digits: str) -> int:
    """The check digit of what precedes it."""
    total = sum(d if i % 2 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return -total % 10


def _digits(key: bytes, kind: str, digits: str) -> str:
    return "".join(map(str, _mixed(key, kind, [10] * len(digits), [int(c) for c in digits])))


def _number(key: bytes, old: str) -> str:
    digits = "".join(c for c in old if c.isdigit())
    if len(digits) >= 13 and luhn(digits[:-1]) == int(digits[-1]):  # cards map to cards
        body = _digits(key, "card", digits[:-1])
        return _pour(body + str(luhn(body)), old)
    new = _digits(key, "number", digits)
    while len(new) >= 13 and luhn(new[:-1]) == int(new[-1]):  # and others to others
        new = _digits(key, "number", new)
    return _pour(new, old)


def _phone(key: bytes, old: str) -> str:
    """The last ten digits, however written, map alike; what precedes them (a country) stays."""
    digits = "".join(c for c in old if c.isdigit())
    head, tail = digits[:-10], digits[-10:]
    return _pour(head + _digits(key, "phone", tail), old)


def _ip(key: bytes, old: str) -> str:
    return ".".join(map(str, _mixed(key, "ip", [256] * 4, [int(x) for x in old.split(".")])))  # 01 is 1


def _ipv6(key: bytes, old: str) -> str:
    """An address in full, however it is written; link-local and other prefixes are not kept."""
    groups = [int(g, 16) for g in ipaddress.IPv6Address(old).exploded.split(":")]
    return ":".join(f"{g:x}" for g in _mixed(key, "ipv6", [65536] * 8, groups))


def _iban(key: bytes, old: str) -> str:
    flat = old.replace(" ", "")
    body = _shape(key, "iban" + flat[:2], flat[4:].lower()).upper()
    right = lambda b: 98 - int("".join(str(int(c, 36)) for c in b + flat[:2] + "00")) % 97
    check = (right(body) + int(flat[2:4]) - right(flat[4:])) % 100  # as wrong as it was
    new = iter(flat[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(new) for c in old)


def _email(key: bytes, old: str) -> str:
    """Local part within its domain; the domain's labels but the last map for themselves, so that one domain stays one."""
    local, _, domain = old.rpartition("@")
    *labels, top = domain.lower().split(".")
    new = ".".join([*(_shape(key, "label", x) for x in labels), top])
    return _like(_shape(key, "local|" + domain.lower(), local.lower()) + "@" + new, old)


def _secret(key: bytes, old: str) -> str:
    hexadecimal = lambda x: all(c in "0123456789abcdef" for c in x)
    now, is_hex = old.lower(), hexadecimal(old.lower())
    while True:  # others map to others
        now = _shape(key, "secret", now, is_hex)
        if hexadecimal(now) == is_hex:
            return _like(now, old)


def _passport(key: bytes, old: str) -> str:
    return _like(_shape(key, "passport", old.lower()), old)


def _address(key: bytes, old: str) -> str:
    """House number and street, whose kind stays; numbers of one length map among themselves."""
    number, *street, kind = old.split(" ")
    return " ".join([_digits(key, "house", number), *(_word(key, w) for w in street), kind])


_LISTED = {low(name): (group, i) for group, names in FIRST_NAMES.items() for i, name in enumerate(names)}


def _word(key: bytes, old: str) -> str:
    """A word of a name: a listed first name within its list, another to another unlisted one of its shape."""
    plain = low(old)
    if plain in _LISTED:
        group, i = _LISTED[plain]
        new = FIRST_NAMES[group][permute(key, f"first|{group}", len(FIRST_NAMES[group]), i)]
        return new.upper() if old.isupper() and len(old) > 1 else new.lower() if old.islower() else new
    new = _shape(key, "name", plain)
    while new in _LISTED:
        new = _shape(key, "name", new)
    return _like(new, old)


def _name(key: bytes, old: str) -> str:
    return re.sub(_NAME, lambda m: _word(key, m[0]), old)


MAKERS: dict[str, Callable[[bytes, str], str]] = {"secret": _secret, "email": _email, "iban": _iban, "ip": _ip, "ipv6": _ipv6, "ssn": lambda k, x: _pour(_digits(k, "ssn", x.replace("-", "")), x), "phone": _phone, "number": _number, "passport": _passport, "address": _address, "name": _name}


def canonical(kind: str, text: str) -> str:
    """What makes two mentions one entity."""
    if kind in ("ssn", "phone", "number"):
        digits = "".join(c for c in text if c.isdigit())
        return digits[-10:] if kind == "phone" else digits
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).exploded
    return re.sub(r"\s+", "" if kind == "iban" else " ", low(text))


def _opens(word: str) -> bool:
    """Whether a word may be a name's: it begins with a capital, or its script has none, and it is no function word."""
    return (word[0].isupper() or unicodedata.category(word[0]) == "Lo") and low(word) not in FUNCTION_WORDS


def _is_ipv6(text: str) -> bool:
    try:
        return int(ipaddress.IPv6Address(text)) > 1  # neither :: nor ::1
    except ValueError:
        return False


_DIGIT, _SECRET_MARKS = re.compile(r"[0-9]"), ("token", "secret", "passw", "key")


class Surrogates:
    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.patterns = [(kind, re.compile(p, 0 if kind == "name" else re.ASCII)) for kind, p in PATTERNS.items()]
        self.make = lru_cache(100_000)(lambda kind, text: MAKERS[kind](self.key, text))

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the entities, none overlapping: the earliest first, then by precedence."""
        found = []
        plain, digits = text.lower(), _DIGIT.search(text) is not None
        may = {"email": "@" in text, "secret": any(x in plain for x in _SECRET_MARKS), "name": True, "passport": digits and "passport" in plain, "ipv6": "::" in text or text.count(":") > 6}
        for rank, (kind, pattern) in enumerate(self.patterns):
            if not may.get(kind, digits):  # what every match must hold
                continue
            for m in pattern.finditer(text):
                start, end = m.span("it") if "it" in pattern.groupindex else m.span()
                if kind == "ipv6" and not _is_ipv6(m[0]):
                    continue
                if kind == "name":
                    kept = re.match(rf"{_NAME}(?:{_GAP}{_NAME})*", text[start:end])
                    words = kept[0].split() if kept else []
                    n = next((i for i, w in enumerate(words) if not _opens(w)), len(words))
                    if not n:
                        continue
                    end = start + len(re.match(rf"{_NAME}(?:{_GAP}{_NAME}){{{n - 1}}}", text[start:end])[0])
                found.append((start, rank, end, kind))
        found += self._bare_names(text)
        out, at = [], 0
        for start, _, end, kind in sorted(found):
            if start >= at:
                out.append((start, end, kind))
                at = end
        return self._carried(text, out)

    def _bare_names(self, text: str) -> Iterator[tuple[int, int, int, str]]:
        """A listed first name and the capitalised words after it, where no honorific tells."""
        for first in _FIRST.finditer(text):
            start = first.start()
            m = None if start and (text[start - 1].isalnum() or text[start - 1] in "_'’-") else _ON_LINE.match(text, start)
            words = [*_WORD.finditer(text, start, m.end())] if m else []
            if len(words) > 1 and words[0][0] == first[0] and words[1][0][0].isupper() and _opens(words[1][0]) and words[1][0] != words[0][0]:
                last = 2 if len(words) > 2 and words[2][0][0].isupper() and _opens(words[2][0]) else 1
                yield start, len(self.patterns), words[last].end(), "name"

    def _carried(self, text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """found, and the other places of the words of the names in it."""
        known = {w[0] for a, b, kind in found if kind == "name" for w in _WORD.finditer(text, a, b) if len(w[0]) > 2}
        if not known:
            return found
        out, i = [], 0
        for w in _WORD.finditer(text):
            while i < len(found) and found[i][1] <= w.start():
                out.append(found[i])
                i += 1
            if w[0] in known and not (i < len(found) and found[i][0] < w.end()):
                out.append((w.start(), w.end(), "name"))
        return out + found[i:]

    def replace(self, text: str) -> tuple[str, list[str], int]:
        """The text with surrogates, the kinds in order, and how many entities are distinct."""
        parts, kinds, at, seen = [], [], 0, set()
        for start, end, kind in self.find(text):
            old = text[start:end]
            seen.add((kind, canonical(kind, old)))
            parts += [text[at:start], self.make(kind, old)]
            kinds.append(kind)
            at = end
        parts.append(text[at:])
        return "".join(parts), kinds, len(seen)

    def pairs(self, text: str) -> set[tuple[str, str, str]]:
        """(kind, entity, surrogate) of a text, in canonical form."""
        found = ((kind, text[start:end]) for start, end, kind in self.find(text))
        return {(kind, canonical(kind, old), canonical(kind, self.make(kind, old))) for kind, old in found}


def collisions(docs: DataFrame, key: bytes | str, text_col: str = "text") -> DataFrame:
    """kind, digest, n: surrogates (or entities) by digest that n > 1 entities (or surrogates) of their kind share; no row if all is well.

    Only digests leave a task, each (entity, surrogate) once a batch; both counts are aggregations.
    """
    secret = key.encode() if isinstance(key, str) else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(secret)
        short = lambda side, x: hashlib.blake2b(x.encode(), key=surrogates.key[:32], person=side, digest_size=16).hexdigest()
        for batch in batches:
            found = set().union(*(surrogates.pairs(t) for t in batch.column(0).to_pylist() if t))
            rows = [(kind, short(b"entity", old), short(b"surrogate", new)) for kind, old, new in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["kind", "entity", "surrogate"])

    pairs = map_arrow(docs.select(F.col(text_col).alias("text")), run, "kind string, entity string, surrogate string").distinct()
    sides = F.explode(F.array(F.struct(F.concat(F.lit("s"), "surrogate").alias("digest"), F.col("entity").alias("other")), F.struct(F.concat(F.lit("e"), "entity").alias("digest"), F.col("surrogate").alias("other"))))
    return pairs.select("kind", sides.alias("x")).groupBy("kind", "x.digest").agg(F.count("*").alias("n")).where("n > 1")


def surrogate_pii(docs: DataFrame, key: bytes | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text (with surrogates), n_entities, n_distinct, kinds (sorted, distinct).

    The key is a secret of the caller; one key gives one mapping everywhere. Null texts stay null with
    no entity; empty ones stay empty. Repeated rows are treated alike. An empty table gives an empty one.
    """
    secret = key.encode() if isinstance(key, str) else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(secret)
        for batch in batches:
            texts, counts, distinct, kinds = [], [], [], []
            for text in batch.column(1).to_pylist():
                new, found, n = surrogates.replace(text) if text else (text, [], 0)
                texts.append(new)
                counts.append(len(found))
                distinct.append(n)
                kinds.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(distinct, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "text", "n_entities", "n_distinct", "kinds"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, text string, n_entities long, n_distinct long, kinds array<string>")
