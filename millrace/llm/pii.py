"""Personal data: detection, and keyed surrogates that keep type, script, gender and format.

Detected: e-mail addresses, phone numbers (international, and national ones with separators), payment cards, bank accounts
(IBAN), social security numbers, IPv4 and IPv6 addresses (compressed ones too), and people named after a title, with all parts
of the name. A surrogate is a keyed permutation without fixed points of all values of the same
format: digits stay digits, letters keep case and script (and vowels stay vowels), separators stay, octets stay octets,
check digits are recomputed. Known given names are exchanged within their gender and script. A permutation keeps different
entities different and one entity the same everywhere (an e-mail's case and a phone's punctuation don't matter). The
corpus-wide check groups surrogates and redraws the key if two entities ever share one.

Null texts stay null, empty ones empty; texts without entities are unchanged; repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, table, with_field, without

#: The key of the registered query; pass your own secret in production.
DEFAULT_KEY = "millrace-demo-key"
ROUNDS = 6

# Titles by gender, and common given names by gender and script.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "x", "Prof": "x", "Господин": "m", "Госпожа": "f"}
GIVEN = {
    ("m", "LATIN"): "James John Robert Michael William David Thomas Peter Paul Hans Karl Jean Pierre Luis Carlos Juan Pedro Marco Daniel Martin".split(),
    ("f", "LATIN"): "Mary Anna Linda Susan Karen Sarah Laura Maria Julia Emma Sophie Marie Claire Carmen Lucia Elena Paula Ingrid Heike Nina".split(),
    ("m", "CYRILLIC"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил".split(),
    ("f", "CYRILLIC"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
}
GENDER_OF = {n: k for k, names in GIVEN.items() for n in names}
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιου", "βγδζθκλμνξπρστφχψ", "áéíóú", "äöü", "àèù", "âêîôû"]
ALPHABET_OF = {c: a for a in ALPHABETS for c in a}

# Small words inside a name: the capitalised part after them belongs to it. Words that join two people are no name.
PARTICLES = set("von van der den de del della di da do dos du la le les el al bin ben ibn bint abu zu zum zur ter ten af av y e i и фон де".split())
JOINS = "and|und|et|y|и"

KINDS = ("email", "iban", "card", "phone", "ssn", "ipv6", "ipv4", "person")
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_GAP = r"[^\S\r\n]+"
_MARKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x483, 0x487), (0x591, 0x5BD), (0x5BF, 0x5C7), (0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6DC), (0x6DF, 0x6E8), (0x6EA, 0x6ED), (0x711, 0x711), (0x730, 0x74A), (0x200C, 0x200D))) + "".join(c for c in map(chr, range(0x750, 0x20000)) if unicodedata.category(c) in ("Mn", "Mc"))
#: Letters with their combining marks; a part of a name is initials (J.R.), or words with apostrophes and hyphens but no 's.
WORD = rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*+"
_PART = rf"(?:[^\W\d_]\.(?:-?[^\W\d_]\.)*+|{WORD}(?:['’ʼ‐‑-](?!s(?!\w)){WORD})*+(?!\w))"
NEXT = re.compile(rf"{_GAP}(?!(?:{_TITLE}|{JOINS})(?!\w))(?P<part>{_PART})|(?<=\.)(?P<close>{WORD})(?!\w)")
WORDS = re.compile(WORD)
_HEX = "[0-9A-Fa-f]{1,4}"
DETECT = re.compile(
    r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24})"
    r"|(?<![\w.])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"
    r"|(?<![\w.+-])(?P<ipv4>(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3})(?!\.?\d|\w)"
    r"|(?<![\w.+-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?<![\w.+-])(?P<card>[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\w-])"
    r"|(?<![\w.])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|(?:1[ .-])?(?:\(\d{3}\)[ .-]?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}"
    r"|(?<![/-])(?:\(0\d{1,5}\)|0\d{1,5}(?=[ ./-]))(?:[ ./-]?\d{2,8}){1,5})(?![\w-])"
    r"|(?<![\w:])(?P<ipv6>(?:" + _HEX + r":){7}" + _HEX + r"|(?:" + _HEX + r"(?::" + _HEX + r"){0,6})?::(?:" + _HEX + r"(?::" + _HEX + r"){0,6})?)(?![\w:]|\.\d)"
    rf"|\b(?:(?:{_TITLE})\.?{_GAP})+(?!(?:{_TITLE}|{JOINS})(?!\w))(?P<person>{_PART})"
)
QUICK = re.compile(rf"@|\d\D?\d|:[0-9a-fA-F]|::|\b(?:{_TITLE})\.?{_GAP}")


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


@cache
def _letters() -> dict[str, str]:
    """The alphabet of every letter that ALPHABETS lacks: letters of its script, case and kind, so that each has another one."""
    groups: dict[tuple, list[str]] = defaultdict(list)
    for c in map(chr, range(0xAA, 0x33480)):
        if c.isalpha() and c not in ALPHABET_OF and c == c.lower():
            back = len(c.upper()) == 1 and c.upper().lower() == c
            x = ord(c)
            groups[unicodedata.name(c, "?").split()[0], unicodedata.category(c), back, bool(unicodedata.decomposition(c)), x < 0x180, x >= 0x4E00, x >> 16].append(c)
    alone = "".join(sorted(g[0] for g in groups.values() if len(g) == 1))
    return {c: a for g in groups.values() for a in ["".join(g) if len(g) > 1 else alone] for c in g}


def alphabet(c: str) -> str | None:
    """The letters that one of a lower-case text is exchanged for."""
    return ALPHABET_OF.get(c) or (_letters().get(c) if not c.isascii() and c.isalpha() else None)


class Surrogates:
    """Keyed surrogates of one key."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _draw(self, tweak: str, turn: int, x: int, n: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{turn}|{x}".encode(), key=self.key, digest_size=max(16, n.bit_length() // 8 + 9))
        return int.from_bytes(h.digest(), "little") % n

    def _mixed(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """A Feistel permutation of 0 to n - 1 (or its inverse) with cycle walking."""
        side = math.isqrt(n - 1) + 1
        while True:
            a, b = divmod(x, side)
            for t in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    a, b = (b - self._draw(tweak, t, a, side)) % side, a
                else:
                    a, b = b, (a + self._draw(tweak, t, b, side)) % side
            x = a * side + b
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A permutation of 0 to n - 1 without fixed points (if n > 1): a rotation seen through the Feistel permutation."""
        return self._mixed((self._mixed(x, n, tweak) + 1) % n, n, tweak, back=True) if n > 1 else x

    def symbols(self, values: list[str], choices: list[list[str] | str], tweak: str) -> list[str]:
        """Every value exchanged for one of its choices, all together one permutation."""
        x, n = 0, 1
        for v, c in zip(values, choices):
            x, n = x * len(c) + c.index(v), n * len(c)
        x, out = self.permute(x, n, tweak + "|" + ",".join(str(len(c)) for c in choices)), []
        for c in reversed(choices):
            x, k = divmod(x, len(c))
            out.append(c[k])
        return out[::-1]

    def characters(self, text: str, tweak: str, fixed: int = 0) -> str:
        """Letters and digits of a lower-case text exchanged within their class; the first ``fixed`` and all others stay."""
        of = [("0123456789" if c.isascii() and c.isdigit() else alphabet(c)) if i >= fixed else None for i, c in enumerate(text)]
        at = [i for i, a in enumerate(of) if a]
        if not at:
            return text
        shape = "".join("9" if c.isdigit() else a[0] if (a := alphabet(c)) else c for c in text)
        new = self.symbols([text[i] for i in at], [of[i] for i in at], f"{tweak}|{shape}")
        out = list(text)
        for i, c in zip(at, new):
            out[i] = c
        return "".join(out)

    def email(self, norm: str) -> str:
        local, _, domain = norm.partition("@")
        head, _, last = domain.rpartition(".")
        labels = head.split(".")
        kept = ".".join([self.characters(x, "label") for x in labels])
        return f"{self.characters(local, 'local')}@{kept}.{last}"

    def digits(self, norm: str, tweak: str, first: str = "0123456789") -> str:
        head = first if norm[0] in first else "".join(d for d in "0123456789" if d not in first)
        return "".join(self.symbols(list(norm), [head, *["0123456789"] * (len(norm) - 1)], tweak))

    def card(self, norm: str) -> str:
        body = norm[0] + self.digits(norm[1:-1], f"card{norm[0]}")
        return body + str((luhn(body) + int(norm[-1]) - luhn(norm[:-1])) % 10)

    def ipv4(self, norm: str) -> str:
        parts = norm.split(".")
        ranges = {1: [str(i) for i in range(10)], 2: [str(i) for i in range(10, 100)], 3: [str(i) for i in range(100, 256)]}
        return ".".join(self.symbols(parts, [ranges[len(p)] for p in parts], "ipv4"))

    def iban(self, norm: str) -> str:
        body = list(norm[4:])
        new = "".join(self.symbols(body, ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in body], "iban" + "".join("9" if c.isdigit() else "A" for c in body)))
        check = lambda b: 98 - int("".join(str(int(c, 36)) for c in b + norm[:2] + "00")) % 97
        return f"{norm[:2]}{(check(new) + int(norm[2:4]) - check(norm[4:])) % 97:02d}{new}"

    def name(self, word: str) -> str:
        """A given name within its gender and script; other names by letters, never a known given name."""
        title = word[:1].upper() + word[1:].lower()
        if title in GENDER_OF:
            names = GIVEN[GENDER_OF[title]]
            return names[self.permute(names.index(title), len(names), "given" + "".join(GENDER_OF[title]))].lower()
        out = word.lower()
        for _ in range(64):
            out = self.characters(out, "name")
            if out[:1].upper() + out[1:] not in GENDER_OF:
                break
        return out

    def of(self, kind: str, norm: str) -> str:
        if kind == "email":
            return self.email(norm)
        if kind == "person":
            return WORDS.sub(lambda m: self.name(m[0]), norm)
        if kind == "phone":
            code = 1 if norm.startswith("1") and len(norm) == 11 else max(0, len(norm) - 10) if len(norm) > 10 else int(norm.startswith("0"))
            rest = norm[code:]
            return norm[:code] + self.digits(rest, f"phone{norm[:code]}", "23456789")
        if kind == "ipv6":
            groups = norm.split(":")
            new = self.symbols(list("".join(groups)), ["0123456789abcdef"] * sum(map(len, groups)), "ipv6" + ",".join(str(len(g)) for g in groups))
            return ":".join("".join(new[sum(map(len, groups[:i])) : sum(map(len, groups[: i + 1]))]) for i in range(len(groups)))
        return {"card": self.card, "ipv4": self.ipv4, "iban": self.iban, "ssn": lambda s: self.digits(s, "ssn")}[kind](norm)


def canonical(kind: str, text: str) -> str:
    """The form in which mentions of one entity agree."""
    if kind in ("email", "person", "ipv6"):
        return " ".join(text.lower().split())
    if kind == "iban":
        return text.replace(" ", "")
    return text if kind == "ipv4" else re.sub(r"\D", "", text)


def dressed(kind: str, text: str, new: str) -> str:
    """The surrogate with the punctuation and case of the mention."""
    if kind == "ipv4":
        return new
    if kind in ("email", "person", "ipv6"):
        if len(new) != len(text):
            upper = text.isupper() and len(text) > 1
            return new.upper() if upper else new if text.islower() else re.sub(r"[^\W\d_]+", lambda m: m[0][:1].upper() + m[0][1:], new)
        return "".join(n.upper() if t.isupper() else n for t, n in zip(text, new))
    rest = iter(new)
    return "".join(next(rest) if (c.isdigit() if kind != "iban" else c != " ") else c for c in text)


def sound(kind: str, text: str) -> bool:
    """Whether a match is an entity: national phones have 9 to 13 digits and are no dates, a compressed address has up to 7 groups."""
    if kind == "phone" and text.lstrip("(").startswith("0"):
        return 9 <= sum(map(str.isdigit, text)) <= 13 and not re.match(r"\d\d([./-])\d\d\1\d{4}", text)
    return kind != "ipv6" or "::" not in text or 0 < sum(map(bool, text.split(":"))) <= 7


def name_end(text: str, end: int) -> int:
    """Where a name ends whose first part ends at ``end``.

    Every further part is capitalised, an initial, of a script without case, or a particle before such a part. Line ends,
    other punctuation, titles and digits end a name.
    """
    at = end
    while m := NEXT.match(text, at):
        part, at = m[m.lastgroup], m.end()
        if not part[0].islower():
            end = at
        elif part.lower() not in PARTICLES:
            break
    return end


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """Spans and kinds of the entities of a text, in order, without overlaps."""
    if not text or not QUICK.search(text):
        return []
    out, at = [], 0
    while m := DETECT.search(text, at):
        kind, (a, b) = m.lastgroup, m.span(m.lastgroup)
        if not sound(kind, m[kind]) or kind == "person" and len(m[kind]) == 1 and m[kind].islower():
            at = a + 1
            continue
        at = b = name_end(text, b) if kind == "person" else b
        out.append((a, b, kind))
    return mentions(text, out)


def mentions(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``found`` and every other mention, without a title, of the names in it.

    A part of a found name counts anywhere in the text if it is spelt alike, capitalised (or of a script without case) and no
    particle or initial; a listed given name before it, and further capitalised parts of found names after it, belong to it.
    """
    parts = {w[0] for a, b, kind in found if kind == "person" for w in WORDS.finditer(text[a:b]) if len(w[0]) > 1 and not w[0][0].islower() and w[0].lower() not in PARTICLES}
    if not parts:
        return found
    one = "|".join(sorted(map(re.escape, parts), key=lambda x: (-len(x), x)))
    given = "|".join(sorted(GENDER_OF))
    whole = re.compile(rf"(?<!\w)(?:(?:{given}){_GAP})*(?:{one})(?!\w)(?:{_GAP}(?:{one})(?!\w))*")
    out, taken, k = list(found), [(a, b) for a, b, _ in found], 0
    for m in whole.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or taken[k][0] >= m.end():
            out.append((*m.span(), "person"))
    return sorted(out)


def replace(text: str | None, s: Surrogates) -> tuple[str | None, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, kind, canonical form, canonical surrogate) of what was there."""
    found, out, at = [], [], 0
    for a, b, kind in detect(text):
        norm = canonical(kind, text[a:b])
        new = s.of(kind, norm)
        out += [text[at:a], dressed(kind, text[a:b], new)]
        found.append((a, b, kind, norm, new))
        at = b
    return ("".join(out) + text[at:] if found else text), found


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("norm", T.StringType()), T.StructField("surrogate", T.StringType())]))


def pseudonymise(df: DataFrame, key: str, text: str = "text", output: str = "safe_text", spans: str = "entities") -> DataFrame:
    """Add ``output`` (the text with surrogates) and ``spans`` (what was replaced; it holds the originals, so keep it safe)."""
    df = without(df, output, spans)
    at = df.columns.index(text)
    names = [f.name for f in SPANS.elementType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(SPANS)
        for batch in batches:
            for part in steps(batch, at):
                made = [replace(t.as_py(), s) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([a for a, _ in made], pa.string()), pa.array([[dict(zip(names, e)) for e in b] for _, b in made], kind)], [*part.schema.names, output, spans])

    return df.mapInArrow(run, with_field(df.schema, T.StructField(output, T.StringType()), T.StructField(spans, SPANS)))


def collisions(df: DataFrame, spans: str = "entities") -> int:
    """How many surrogates stand for more than one entity, over the whole table."""
    each = df.select(F.explode(spans).alias("e")).select("e.kind", "e.norm", "e.surrogate").distinct()
    return each.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").count()


def checked_key(df: DataFrame, key: str, text: str = "text", most: int = 8) -> str:
    """``key``, or the first variant of it under which no two entities of the table share a surrogate."""
    for k in range(most):
        now = key if not k else f"{key}#{k}"
        if not collisions(pseudonymise(df.select(text), now, text)):
            return now
    raise ValueError("no key keeps the entities apart")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, checked_key(docs, DEFAULT_KEY))
    return out.select("doc_id", F.col("safe_text").alias("text"), F.size("entities").cast("long").alias("n_entities"))
