"""PII: detected entities get keyed surrogates of the same type, format, script and gender.

A surrogate is the image of the entity under a keyed permutation of all values of its format. So equal entities
have equal surrogates in every document, different ones have different surrogates, and no table of entities is
kept or shuffled. The collision checks that this rests on are made where it could fail: values that leave
their format (or names that land among the listed ones) walk on along the permutation, small domains use a shift
that moves every value, every slice of rows is checked as it is masked, and ``collisions`` audits a masked corpus.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prunescan.llm.common import sliced

# Letter classes within which letters are exchanged, so that script and shape stay.
CLASSES = (
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "àáâãäåæèéêëìíîïòóôõöøùúûüÿœ",
    "çñßšžðþ",
    "аеиоуыэюяё",
    "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
    "0123456789",
)
# Titles that announce a person, with the gender they state.
TITLES = {"mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "mademoiselle": "f", "señora": "f", "sra": "f", "dr": "", "prof": "", "professor": ""}
# Given names by gender; Latin, then Cyrillic.
GIVEN = {
    "m": ("james", "john", "robert", "michael", "william", "david", "richard", "thomas", "charles", "daniel", "hans", "peter", "klaus", "wolfgang", "pierre", "jean", "michel", "antoine", "carlos", "jose", "miguel", "diego"),
    "f": ("mary", "patricia", "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "ursula", "monika", "sabine", "petra", "marie", "sophie", "camille", "isabelle", "carmen", "lucia", "pilar", "dolores"),
    "mc": ("иван", "сергей", "андрей", "дмитрий", "алексей", "николай", "владимир", "павел"),
    "fc": ("анна", "мария", "елена", "ольга", "наталья", "татьяна", "ирина", "светлана"),
}
_PLACE = {c: (k, i) for k, letters in enumerate(CLASSES) for i, c in enumerate(letters)}
_GENDER = {name: kind for kind, names in GIVEN.items() for name in names}
_NAME = r"[^\W\d_]+(?:[-'][^\W\d_]+)*"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]*\w@(?:[\w-]+\.)+[^\W\d_]{2,}(?!\w)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{13,19})(?![\w]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]|\.\d)")),
    ("phone", re.compile(r"(?<![\w.+(/-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\w]|\.\d)")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")),
    ("ip6", re.compile(r"(?<![\w:.])(?=[\da-fA-F:]*\d)(?:(?:[\da-fA-F]{1,4}:){7}[\da-fA-F]{1,4}|(?:[\da-fA-F]{1,4}:){2,6}(?::[\da-fA-F]{1,4}){1,5}|[\da-fA-F]{1,4}:(?::[\da-fA-F]{1,4}){2,6})(?![\w:])")),
)
PERSON = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(TITLES)})\.? (?P<a>{_NAME})(?: (?P<b>{_NAME}))?|(?P<c>{'|'.join(_GENDER)}) (?P<d>{_NAME}))(?!\w)", re.IGNORECASE)
#: Phrases after which a capitalised name stands, whether it is listed or not.
INTRODUCED = re.compile(rf"(?<!\w)(?i:my name is|name:|contact:|author:|from:|attn:|signed,|sincerely,|regards,|yours,|ich heiße|je m'appelle|me llamo|меня зовут)\s+(?P<a>{_NAME})(?: (?P<b>{_NAME}))?(?!\w)")
WORD = re.compile(_NAME)
HINT = re.compile(r"[\d@]")


@dataclass(frozen=True)
class Entity:
    kind: str
    first: int
    end: int
    surrogate: str


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """Image of ``x`` under a keyed permutation of 0..size-1; ``tweak`` names the domain.

    Up to 4096 values it is a shift that moves every value; beyond, a balanced Feistel network on mixed radix
    halves, walked on until it lands inside the domain.
    """
    if size < 2:
        return x
    if size <= 4096:
        return (x + 1 + int.from_bytes(hashlib.blake2b(tweak.encode(), key=key, digest_size=8).digest()) % (size - 1)) % size
    half = math.isqrt(size - 1) + 1
    width = half.bit_length() // 8 + 9
    while True:
        left, right = divmod(x, half)
        for k in range(8):
            seed = f"{tweak}/{k}/{right}".encode()
            draw = b"".join(hashlib.blake2b(seed, key=key, digest_size=min(64, width), salt=bytes([i])).digest() for i in range(-(-width // 64)))
            left, right = right, (left + int.from_bytes(draw)) % half
        x = left * half + right
        if x < size:
            return x


def _digits(text: str, new: str) -> str:
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _mapped(text: str, key: bytes, tweak: str, fixed: int = 0) -> str:
    """Permute the characters from place ``fixed`` on within their classes; others and the case of letters stay.

    A leading nonzero digit of the part stays nonzero.
    """
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    radix, value, size, lead = [], 0, 1, True
    for i, c in enumerate(low):
        if i < fixed or c not in _PLACE:
            continue
        k, at = _PLACE[c]
        base = len(CLASSES[k])
        if k == len(CLASSES) - 1 and lead:
            base, at, lead = (9, at - 1, False) if at else (1, 0, True)
            shift = 1 if base == 9 else 0
        else:
            shift, lead = 0, lead and k != len(CLASSES) - 1
        radix.append((i, k, base, shift))
        value, size = value * base + at, size * base
    shape = "".join(f"{k}.{b} " for _, k, b, _ in radix) + "".join(c for i, c in enumerate(low) if i < fixed or c not in _PLACE)
    value = permute(value, size, key, f"{tweak}/{shape}")
    out = list(text)
    for i, k, base, shift in reversed(radix):
        value, at = divmod(value, base)
        c = CLASSES[k][at + shift]
        out[i] = c.upper() if text[i] != low[i] else c
    return "".join(out)


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _card(text: str, key: bytes) -> str:
    digits = "".join(filter(str.isdigit, text))
    valid, new = luhn(digits), digits
    while True:  # walks on within the numbers whose check digit is as right as this one's
        new = digits[0] + _mapped("1" + new[1:], key, "card" + digits[0], 1)[1:] if len(new) > 1 else new
        if luhn(new) == valid:
            return _digits(text, new)


def _ip(text: str, key: bytes) -> str:
    parts = text.split(".")
    low = [(0, 10, 100)[len(p) - 1] for p in parts]
    size = [(10, 90, 156)[len(p) - 1] for p in parts]
    if any(len(p) > 1 and p[0] == "0" for p in parts):
        return _mapped(text, key, "ip0")
    value = 0
    for p, a, n in zip(parts, low, size):
        value = value * n + int(p) - a
    value = permute(value, math.prod(size), key, f"ip/{size}")
    out = []
    for a, n in zip(reversed(low), reversed(size)):
        value, at = divmod(value, n)
        out.append(str(a + at))
    return ".".join(reversed(out))


def _ip6(text: str, key: bytes) -> str:
    """Hexadecimal digits change; a group's leading digit stays zero or other than zero."""
    first = lambda i: i == 0 or text[i - 1] == ":"
    places = [(i, 15 if first(i) else 16) for i, c in enumerate(text) if c != ":" and not (first(i) and c == "0")]
    value, size, out = 0, 1, list(text.lower())
    for i, base in places:
        value, size = value * base + int(text[i], 16) - (base == 15), size * base
    shape = "".join(c if c == ":" or first(i) and c == "0" else "x" for i, c in enumerate(text))
    value = permute(value, size, key, f"ip6/{shape}")
    for i, base in reversed(places):
        value, at = divmod(value, base)
        out[i] = f"{at + (base == 15):x}"
    new = "".join(out)
    return new.upper() if any(c in "ABCDEF" for c in text) else new


def _check_digits(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _iban(text: str, key: bytes) -> str:
    """Check digits that are right stay right, wrong ones stay as far off: two numbers that differ there only keep differing."""
    plain = text.replace(" ", "")
    country, body = plain[:2], _mapped(plain[4:], key, "iban" + plain[:2])
    off = int(plain[2:4]) - _check_digits(country, plain[4:])
    new = iter(country + f"{(_check_digits(country, body) + off) % 100:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _phone(text: str, key: bytes) -> str:
    """The last ten digits change, so that one number written with and without its country code stays one."""
    digits = "".join(filter(str.isdigit, text))
    keep = max(0, len(digits) - 10) if len(digits) >= 10 else min(2, len(digits) - 1)
    return _digits(text, digits[:keep] + _mapped(digits[keep:], key, "phone"))


def _email(text: str, key: bytes) -> str:
    local, _, host = text.rpartition("@")
    name, _, top = host.rpartition(".")
    return f"{_mapped(local, key, 'local')}@{_mapped(name, key, 'host')}.{top}"


def _as_case(text: str, new: str) -> str:
    return new.upper() if text.isupper() and len(text) > 1 else new.capitalize() if text[:1].isupper() else new


def person_name(text: str, key: bytes) -> str:
    """Another name of the same script and case: of the same gender if the given name is listed, else changed letter by letter.

    Listed names are exchanged among themselves. Others walk on along the permutation until they reach a name that
    isn't listed either, so no two names have one surrogate.
    """
    names = GIVEN.get(_GENDER.get(text.lower(), ""))
    if names is not None:
        return _as_case(text, names[permute(names.index(text.lower()), len(names), key, f"given/{_GENDER[text.lower()]}")])
    new = _mapped(text, key, "name")
    while new.lower() in _GENDER:
        new = _mapped(new, key, "name")
    return new


SURROGATES = {"email": _email, "iban": _iban, "card": _card, "ssn": lambda t, key: _mapped(t, key, "ssn"), "phone": _phone, "ip": _ip, "ip6": _ip6, "person": person_name}


def normal(kind: str, text: str) -> str:
    """What spellings of one entity have in common."""
    if kind in ("phone", "card", "ssn"):
        digits = "".join(filter(str.isdigit, text))
        return digits[-10:] if kind == "phone" else digits
    return text.replace(" ", "").lower() if kind == "iban" else text.lower()


def _persons(text: str) -> Iterator[tuple[int, int]]:
    """Spans of names: after a title, after a listed given name, after a phrase that introduces one."""
    for m in PERSON.finditer(text):
        names = [g for g in ("a", "b", "c", "d") if m[g] and m[g][:1].isupper()]
        if names and not (m["c"] and "d" not in names) and not (m["a"] and "a" not in names):
            yield from map(m.span, names)
    for m in INTRODUCED.finditer(text):
        if m["a"][:1].isupper():
            yield from (m.span(g) for g in ("a", "b") if m[g] and m[g][:1].isupper())


def entities(text: str, key: bytes) -> list[Entity]:
    """The entities of a text in order, not overlapping; an earlier pattern wins where two overlap.

    Names found once are looked for in the whole text, so that a later bare surname is the same person.
    """
    found: list[Entity] = []
    taken = bytearray(len(text))

    def take(kind: str, first: int, end: int) -> None:
        if taken.find(1, first, end) < 0:
            taken[first:end] = b"\x01" * (end - first)
            found.append(Entity(kind, first, end, SURROGATES[kind](text[first:end], key)))

    if HINT.search(text):
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                take(kind, *m.span())
    names = set()
    for first, end in list(_persons(text)):
        names.add(text[first:end].lower())
        take("person", first, end)
    if names:
        for m in WORD.finditer(text):
            if m[0][:1].isupper() and len(m[0]) > 1 and m[0].lower() in names:
                take("person", *m.span())
    return sorted(found, key=lambda e: e.first)


def _checked(seen: dict, text: str, found: list[Entity]) -> None:
    """Raise if two entities of the rows seen so far share a surrogate, or one entity has two."""
    for e in found:
        one, other = normal(e.kind, text[e.first : e.end]), normal(e.kind, e.surrogate)
        if seen.setdefault((e.kind, "of", other), one) != one or seen.setdefault((e.kind, "for", one), other) != other:
            raise RuntimeError(f"two {e.kind} entities share a surrogate, or one has two")


def _masked(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("original", pa.string()), ("surrogate", pa.string())]))
    for batch in sliced(batches):
        texts, found, seen = [], [], {}
        for text in batch.column(0).to_pylist():
            own = entities(text, key) if text else []
            if own:
                _checked(seen, text, own)
            found.append([{"kind": e.kind, "first": e.first, "end": e.end, "original": text[e.first : e.end], "surrogate": e.surrogate} for e in own])
            if own:
                parts, at = [], 0
                for e in own:
                    parts += [text[at : e.first], e.surrogate]
                    at = e.end
                text = "".join(parts) + text[at:]
            texts.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(found, kind)], [*batch.schema.names[1:], "masked", "found"])


def mask(docs: DataFrame, text: str = "text", key: bytes | None = None, entities_col: str | None = None) -> DataFrame:
    """Replace personal data in ``text`` by surrogates; all other columns stay, in their order.

    Kinds: e-mail addresses, IBANs, card numbers, social security numbers, phone numbers, IPv4 and IPv6 addresses, and
    persons named by a title, a listed given name or a phrase that introduces a name; a name found in a text is
    replaced wherever it stands in that text, so a bare surname stays the same person. Names that no such sign gives
    away are not found. Surrogates keep length, punctuation, case, script, country code or brand, top-level domain,
    check-digit validity, and the gender of listed given names.

    ``key`` (at most 64 bytes), or the session's ``prunescan.pii.key``, decides the surrogates: the same key gives
    coreference across runs, another one unlinkable copies. It must be kept secret, as it undoes the masking; there is
    no default. Every slice of rows is checked for distinct and consistent surrogates; a breach ends the job.

    With ``entities_col`` the kinds, places (code points of the input), originals and surrogates are added as an
    array under that name. Null and empty texts stay. Nothing is shuffled, and rows are masked one by one, so
    repeated rows agree. An empty table gives no rows.
    """
    if not key:
        key = docs.sparkSession.conf.get("prunescan.pii.key", "").encode()
    if not key:
        raise ValueError("INVALID_REQUEST: surrogates need a key: pass one or set prunescan.pii.key")
    rest = [c for c in docs.columns if c != text]
    names = [f"c{i}" for i in range(len(rest))]
    d = docs.select(F.col(f"`{text}`").cast("string").alias("t"), *(F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)))
    kinds = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in zip(rest, names))
    out = d.mapInArrow(lambda it: _masked(it, key), f"{kinds}masked string, found array<struct<kind string, first int, end int, original string, surrogate string>>")
    back = dict(zip(rest, names)) | {text: "masked"}
    cols = [F.col(back[c]).alias(c) for c in docs.columns]
    return out.select(*cols, *([F.col("found").alias(entities_col)] if entities_col else []))


def collisions(masked: DataFrame, entities_col: str) -> DataFrame:
    """Audit: surrogates that stand for more than one entity, or for themselves: ``kind, surrogate, n_originals``. Sound masking gives no rows."""
    e = masked.select(F.explode(entities_col).alias("e")).select(F.col("e.kind").alias("kind"), F.lower("e.original").alias("o"), F.lower("e.surrogate").alias("surrogate")).distinct()
    return e.groupBy("kind", "surrogate").agg(F.count("*").alias("n_originals"), F.max(F.col("o") == F.col("surrogate")).alias("own")).filter("n_originals > 1 or own").drop("own")
