"""PII: surrogate generation. Detected entities give way to keyed replacements of the same type and format.

Every replacement is a keyed permutation of the entity's canonical values (digits of a phone number, an IBAN without blanks, an
e-mail address or a name without case, all groups of an address), written in the format that was found: characters keep
their class (script, vowel or consonant in names), separators and capitals their place; card numbers and IBANs keep their
check digits' validity, addresses their range. So one value in two formats has one surrogate in two formats. Listed names become others of their script and gender; of unlisted ones the ending that shows a
gender stays. The title's gender isn't used: one name may stand behind several titles, and must have one surrogate.
A permutation maps equal entities to equal surrogates in every document (coreference) and different ones to
different surrogates (distinctness), without a table of all entities; it has no fixed point, so no entity stays as it
was. Names are found by titles (several in a row, initials behind them) or as a listed given name before a listed family
name or one with the ending of family names; what a document names so is then found wherever its words stand alone in the same
document, also in capitals. Function words are no names. Should two entities of a document share a surrogate, the second is moved on.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm._base import ship, slices

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
MARKS = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Given and family names by script and gender; a name is replaced by one of its own list.
NAMES = {
    ("latin", "f"): "Agnieszka Anna Barbara Camille Carmen Clara Elena Elizabeth Emma Ingrid Isabel Jennifer Jessica Julia Juliette Karen Katarzyna Laura Linda Lucia Maria Marie Mary Monika Nora Patricia Paula Petra Pilar Rosa Sabine Sarah Sofia Susan Teresa".split(),
    ("latin", "m"): "Adam Andreas Antoine Antonio Carlos Charles David Erik Felix Hans Jack James Javier John Joseph Jürgen Karl Krzysztof Luis Manuel Marco Martin Michael Olivier Paul Pierre Piotr Richard Robert Stefan Thomas William Wolfgang".split(),
    ("latin", "family"): "Becker Bernard Brown Davis Dubois Durand Ferrari Fischer Garcia Hoffmann Johnson Jones Leroy Lopez Martinez Meyer Miller Moreau Müller Nowak Rossi Schmidt Schulz Smith Wagner Weber Williams Wilson".split(),
    ("cyrillic", "f"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Владимир Дмитрий Иван Михаил Олег Сергей".split(),
    ("cyrillic", "family"): "Волков Иванов Козлов Морозов Новиков Петров Смирнов Соколов".split(),
}
_LISTED = {n.lower(): k for k, names in NAMES.items() for n in names}
# Titles, letters that take each other's place in names, and endings that show a gender.
TITLES = "Mrs|Ms|Miss|Mr|Dr|Prof|Frau|Herr|Madame|Mme|Monsieur|Señora|Señor|Sra|Sr|Госпожа|Господин|Κυρία|Κύριος"
TITLES_AFTER = "先生|女士|小姐"
NAME_LETTERS = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àáâäèéêëìíîïòóôöùúûü", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "çćčďğłńñňřśšťźžż", "ÇĆČĎĞŁŃÑŇŘŚŠŤŹŽŻ",
    "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЫЭЮЯЁ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "άέήίόύώ", "ΆΈΉΊΌΎΏ",
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗", "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平小文国华",
]
ENDINGS = ["ская", "ский", "ова", "ева", "ина", "ая", "ов", "ев", "ин", "а", "я", "owa", "ska", "ski", "cka", "cki", "a", "ου", "ος", "ης", "ας", "α", "η"]
FAMILY_ENDINGS = "son|sen|mann|stein|berg|ski|ska|cki|cka|wicz|ová|ova|ov|eva|ev|ez|elli|etti|eau|enko|opoulos|ский|ская|ова|ов|ева|ев|ина|ин|енко"
NO_NAMES = "The|A|An|This|That|These|Those|And|Or|But|If|In|On|At|To|Of|For|He|She|It|We|They|You|Der|Die|Das|Ein|Eine|Und|Oder|Aber|Er|Sie|Es|Wir|Le|La|Les|Un|Une|Et|Ou|Il|Elle|El|Los|Las|Una|Y|O|И|В|На|Он|Она|Мы"
#: Country codes of one and of two digits; all others have three.
CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_ENDINGS = sorted(ENDINGS, key=len, reverse=True)
_CLASS = {c: letters for letters in NAME_LETTERS for c in letters}

_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f\u0900-\u0dff])"
_WORD = rf"(?:[\u4e00-\u9fff]{{2,4}}|[^\W\d_a-zа-яß-öø-ÿα-ώ\u4e00-\u9fff](?:{_LETTER}*(?:[-'’]{_LETTER}{{2,}})+|{_LETTER}+))"
_INITIAL = r"(?:[^\W\d_a-zа-яß-öø-ÿα-ώ\u4e00-\u9fff]\. ?)"
_NOT = rf"(?!(?:{NO_NAMES}|{TITLES})\b(?![-'’][^\W\d_a-zа-яß-öø-ÿα-ώ]{_LETTER}))"  # O’Neil and El-Amin begin as such words do
_GIVEN = "|".join(n for k, names in NAMES.items() if k[1] != "family" for n in names)
_FAMILY = "|".join(n for k, names in NAMES.items() if k[1] == "family" for n in names)
PATTERNS = [
    ("email", r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret", r"""(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b\s*[=:]\s*["']?)(?P<secret>[^\s"']{6,})"""),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip6", r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d)"),
    ("passport", r"(?i:\b(?:passport|passeport|reisepass|pasaporte|паспорт)\b(?:\s*(?:no|nr|num|number|nummer|número|numéro)\b)?[\s.:#№]*)(?P<passport>[A-Z]{0,2}\d{6,9})\b"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\d.]*\d)"),
    ("card", r"(?<![\d-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,4}(?![\d-]*\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w+])\+\d{8,14}(?!\d)"),
    ("name", rf"\b(?:{TITLES})\b\.?(?: (?:{TITLES})\b\.?)* (?P<name>{_INITIAL}*{_NOT}{_WORD}(?: {_INITIAL}*{_NOT}{_WORD})?)"),
    ("listed", rf"\b(?P<listed>(?:{_GIVEN}) {_INITIAL}*(?:(?:{_FAMILY})\b|{_NOT}(?:[^\W\d_a-zа-яß-öø-ÿ]{_LETTER}+?(?:{FAMILY_ENDINGS})\b)))"),
    ("before", rf"(?P<before>[{NAME_LETTERS[-2]}][\u4e00-\u9fff]{{1,2}})(?={TITLES_AFTER})"),
]
FIND = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in PATTERNS))
#: A text that this doesn't find has no entity.
MAYBE = re.compile(r"\d|@|::|(?i:password|passwd|pwd|secret|token|key)|\b(?:" + TITLES + "|" + _GIVEN + r")\b|" + TITLES_AFTER)


@functools.lru_cache(maxsize=1 << 14)
def letters(c: str) -> str | None:
    """The letters that can take the place of c: of its class above, or else of its category and its 128 code points,
    or its whole block for Han and Hangul."""
    if c in _CLASS:
        return _CLASS[c]
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return None
    low, high = (0x4E00, 0xA000) if "\u4e00" <= c <= "\u9fff" else (0xAC00, 0xD7A4) if "\uac00" <= c <= "\ud7a3" else (ord(c) & ~127, (ord(c) | 127) + 1)
    found = "".join(x for x in map(chr, range(low, high)) if x not in _CLASS and unicodedata.category(x) == kind)
    return found if len(found) > 1 else None


def low(s: str) -> str:
    """s in lower case where that keeps its length."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def cased(old: str, new: str) -> str:
    """new, in lower case, with capitals where old has them, as far as these have one lower case form."""
    return "".join(n.upper() if o.isupper() and low(n.upper()) == n else n for o, n in zip(old, new, strict=True))


def groups(s: str) -> list[int]:
    """The eight numbers of an IPv6 address."""
    return [int(x, 16) for x in ipaddress.IPv6Address(s).exploded.split(":")]


def canonical(kind: str, s: str) -> str:
    """The form that all formats of one value share."""
    if kind == "phone":
        return s[: s.startswith("+")] + re.sub(r"\D", "", s)
    if kind == "ip6":
        return str(groups(s))
    return {"email": low, "name": low, "iban": lambda x: x.replace(" ", ""), "card": lambda x: re.sub(r"\D", "", x)}.get(kind, str)(s)


def ending(s: str) -> str:
    """The ending that shows a gender, if three letters stand before it."""
    return next((e for e in _ENDINGS if s.endswith(e) and len(s) >= len(e) + 3), "")


class Permutations:
    """Keyed permutations of small and large ranges, by Feistel rounds and cycle walking."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        h = hashlib.blake2b(b"%d:%d:%d" % (i, bits, half), digest_size=32, key=self.key, person=hashlib.blake2b(tweak, digest_size=16).digest())
        wide = int.from_bytes(h.digest(), "big")
        while bits > 256 and wide.bit_length() < bits - 8:
            wide = wide << 256 | int.from_bytes(hashlib.blake2b(wide.to_bytes(wide.bit_length() // 8 + 1, "big"), digest_size=32, key=self.key).digest(), "big")
        return wide & ((1 << bits) - 1)

    def _feistel(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        bits = max(2, (n - 1).bit_length() + 1 & ~1) // 2
        mask = (1 << bits) - 1
        while True:  # walk until the value is in range again
            left, right = x >> bits, x & mask
            for i in range(8):
                if back:
                    left, right = right ^ self._round(tweak, 7 - i, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, i, right, bits)
            x = left << bits | right
            if x < n:
                return x

    def move(self, x: int, n: int, tweak: bytes) -> int:
        """A permutation of 0 to n - 1 without fixed points (n > 1): one step along a keyed cycle through all values."""
        if n < 2:
            return x
        return self._feistel((self._feistel(x, n, tweak, False) + 1) % n, n, tweak, True)

    def text(self, s: str, tweak: str, classes: Callable[[str], str | None] | None = None, keep: Callable[[int, str], bool] = lambda i, c: False) -> str:
        """s with its characters moved within their classes (disjoint strings); those without one, and those that keep says, stay."""
        classes = classes or plain
        sets = [None if keep(i, c) else classes(c) for i, c in enumerate(s)]
        value, n = 0, 1
        for c, kind in zip(s, sets, strict=True):
            if kind:
                n, value = n * len(kind), value * len(kind) + kind.index(c)
        shape = "".join("_" if k is None else k[0] for k in sets)
        value = self.move(value, n, f"{tweak}:{shape}:{''.join(c for c, k in zip(s, sets, strict=True) if not k)}".encode())
        out = []
        for c, kind in zip(reversed(s), reversed(sets), strict=True):
            if kind:
                value, r = divmod(value, len(kind))
                c = kind[r]
            out.append(c)
        return "".join(reversed(out))


def plain(c: str) -> str | None:
    """Digits, and letters by case; letters outside ASCII by their class."""
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else letters(c) if c > "\x7f" else None


def mark(c: str) -> str | None:
    """For secrets without letters and digits: other marks in ASCII, or the category of the 128 code points around."""
    if c in MARKS:
        return MARKS
    near = "".join(x for x in map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1)) if c > "\x7f" and not x.isspace() and unicodedata.category(x) == unicodedata.category(c))
    return near if len(near) > 1 else None


def rest97(s: str) -> int:
    """The remainder that an IBAN's check is about."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def luhn(digits: str) -> int:
    """The digit that makes digits + it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


class Surrogates:
    def __init__(self, key: bytes) -> None:
        self.p = Permutations(key)

    def email(self, s: str) -> str:
        """The last label and any reserved example domain stay; the other labels and the local part move together."""
        tail = re.search(r"(?:\.example)?\.[^.@]+$", s, re.IGNORECASE).start()
        return cased(s, self.p.text(low(s), "email", keep=lambda i, c: i >= tail))

    def access_key(self, s: str) -> str:
        return self.p.text(s, "access_key", keep=lambda i, c: i < 4)

    def secret(self, s: str) -> str:
        """Hexadecimal secrets stay hexadecimal, others stay others; the marks move in those of marks alone."""
        if all(c in HEX for c in s):
            return self.p.text(s, "secret", lambda c: HEX)
        if not any(map(plain, s)):
            return self.p.text(s, "marks", mark)
        s = self.p.text(s, "secret")
        while all(c in HEX for c in s):  # cycle walking keeps the two kinds apart, and the map one-to-one
            s = self.p.text(s, "secret")
        return s

    def iban(self, s: str) -> str:
        """The country stays, and the check digits are as right or wrong as they were (00, 01 and 99, which no IBAN has, stay)."""
        old = s.replace(" ", "")
        new = self.p.text(old, "iban", keep=lambda i, c: i < 4)
        if 2 <= int(old[2:4]) <= 98:
            zero = rest97(new[:2] + "00" + new[4:])
            new = f"{new[:2]}{(rest97(old) - zero - 2) % 97 + 2:02d}{new[4:]}"
        one = iter(new)
        return "".join(c if c == " " else next(one) for c in s)

    def ssn(self, s: str) -> str:
        return self.p.text(s, "ssn")

    def phone(self, s: str) -> str:
        """The country code behind a plus stays; the other digits move, whatever stands between them."""
        digits = re.sub(r"[^0-9]", "", s)
        code = (1 if digits[:1] in CODES else 2 if digits[:2] in CODES else 3) if s.startswith("+") else 0
        new = iter(digits[:code] + self.p.text(digits[code:], "phone"))
        return "".join(next(new) if c in DIGITS else c for c in s)

    def passport(self, s: str) -> str:
        return self.p.text(s, "passport")

    def ip6(self, s: str) -> str:
        """The first group stays if others aren't zero, and zero groups stay, so that what is left out stays so; the others become other numbers."""
        old = groups(s)
        moving = [i for i, x in enumerate(old) if x and (i or not any(old[1:]))]
        value = 0
        for i in moving:
            value = value * 65_535 + old[i] - 1
        fixed = "".join(":" if i in moving else f"{x:x}." for i, x in enumerate(old))
        value, new = self.p.move(value, 65_535 ** len(moving), f"ip6:{fixed}".encode()), list(old)
        for i in reversed(moving):
            value, r = divmod(value, 65_535)
            new[i] = r + 1
        head, gap, tail = s.partition("::")
        first, last = ([x for x in part.split(":") if x] for part in (head, tail))
        place = [*range(len(first)), *range(8 - len(last), 8)]
        told = [f"{new[i]:0{4 if len(x) == 4 and x[0] == '0' else 1}x}" for i, x in zip(place, first + last, strict=True)]
        told = [x if int(t or "0", 16) == 0 else t.upper() if x.upper() == x and x.lower() != x else t for x, t in zip(first + last, told, strict=True)]
        return ":".join(told[: len(first)]) + gap + ":".join(told[len(first) :])

    def card(self, s: str) -> str:
        """The issuer's first digit stays, and the check digit is as right or wrong as it was."""
        digits = re.sub(r"\D", "", s)
        off = (int(digits[-1]) - luhn(digits[:-1])) % 10
        body = digits[0] + self.p.text(digits[1:-1], f"card:{digits[0]}")
        new = iter(body + str((luhn(body) + off) % 10))
        return "".join(next(new) if c in DIGITS else c for c in s)

    def ip(self, s: str) -> str:
        """Private and loopback ranges map to themselves; other addresses to others with as many digits in each place, as far as octets allow."""
        held = self._held(s)
        while self._held(s := self._address(s, held)) != held:
            pass
        return s

    @staticmethod
    def _held(s: str) -> int:
        """Leading octets that a private or loopback address keeps."""
        return 2 if s.startswith("192.168.") else 1 if s.startswith(("10.", "127.")) else 0

    def _address(self, s: str, held: int) -> str:
        parts = s.split(".")
        ranges = []
        for x in parts[held:]:
            lo, hi = {1: (0, 9), 2: (10, 99), 3: (100, 255)}.get(len(x), (0, 255))
            if str(int(x)) != x:
                lo, hi = 0, 10 ** (len(x) - 1) - 1  # zeros in front stay zeros in front
            ranges.append((lo, hi, len(x) if str(int(x)) != x else 0))
        n, value = 1, 0
        for x, (lo, hi, _) in zip(parts[held:], ranges, strict=True):
            n, value = n * (hi - lo + 1), value * (hi - lo + 1) + int(x) - lo
        value = self.p.move(value, n, f"ip:{parts[:held]}:{ranges}".encode())
        out = []
        for lo, hi, width in reversed(ranges):
            value, r = divmod(value, hi - lo + 1)
            out.append(f"{r + lo:0{width}d}" if width else str(r + lo))
        return ".".join(parts[:held] + out[::-1])

    def name(self, s: str) -> str:
        return "".join(x if x in " -'’." else self._one_name(x) for x in re.split(r"([ \-'’.])", s))

    def _one_name(self, old: str) -> str:
        s = low(old)
        kind = _LISTED.get(s)
        if kind:
            names = NAMES[kind]
            at = next(i for i, n in enumerate(names) if n.lower() == s)
            new = names[self.p.move(at, len(names), f"name:{kind}".encode())]
            return new.upper() if old.isupper() else new.lower() if old.islower() else new
        end = ending(s)
        stem = len(s) - len(end)
        while True:  # cycle walking past listed names and other endings keeps the map one-to-one
            s = self.p.text(s, "name", letters, keep=lambda i, c: i >= stem)
            if s not in _LISTED and ending(s) == end:
                return cased(old, s)

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with surrogates, and (type, start, end, surrogate) of each entity, offsets in the old text."""
        if not MAYBE.search(text):
            return text, []
        spans = []
        for m in FIND.finditer(text):
            group = next(k for k, v in m.groupdict().items() if k.startswith("k_") and v is not None)[2:]
            kind = "name" if group in ("listed", "before") else group
            spans.append((kind, *(m.span(group) if group in ("secret", "name", "listed", "before", "passport") else m.span())))
        spans += self._mentions(text, spans)
        out, found, at, used = [], [], 0, {}
        for kind, start, end in sorted(spans, key=lambda x: x[1]):
            old = text[start:end]
            new = getattr(self, kind)(old)
            while used.setdefault((kind, canonical(kind, new)), canonical(kind, old)) != canonical(kind, old):
                new = getattr(self, kind)(new)  # the maps are one-to-one, so this isn't met; if it were, the entities would stay apart
            out += [text[at:start], new]
            found.append((kind, start, end, new))
            at = end
        return "".join([*out, text[at:]]), found

    @staticmethod
    def _mentions(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Other places of the words of the names found (three letters or more, or Han), alone or in a row, outside all entities."""
        words = {w for kind, a, b in spans if kind == "name" for w in text[a:b].split(" ") if w and (len(w.split(".")[-1]) > 2 or "\u4e00" <= w[0] <= "\u9fff")}
        words |= {w.upper() for w in words}
        if not words:
            return []
        one = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))
        han = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True) if "\u4e00" <= w[0] <= "\u9fff")
        held, more, i = sorted((a, b) for _, a, b in spans), [], 0
        for m in re.finditer(rf"(?<!\w)(?:{one})(?: (?:{one}))*(?!\w)" + (f"|{han}" if han else ""), text):
            while i < len(held) and held[i][1] <= m.start():
                i += 1
            if i == len(held) or held[i][0] >= m.end():
                more.append(("name", *m.span()))
        return more


ENTITY = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surrogate", T.StringType())]))
_ARROW = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def surrogates(docs: DataFrame, text: str = "text", *, key: bytes) -> DataFrame:
    """docs with its text rewritten and `entities` (type, start, end in code points of the old text, surrogate).

    Who has the key can undo the surrogates, so it has no default; at most 64 bytes. Null text stays null and empty text
    empty, without entities; a column named entities is replaced, others stay; repeated rows get the same text; an empty
    table gives no rows. No row moves between tasks, and no table of entities is needed, so nothing grows with the corpus.
    """
    ship(docs.sparkSession)
    docs = docs.drop("entities")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for big in batches:
            for batch in slices([big], text):
                done = [make.rewrite(x) if x is not None else (None, []) for x in batch.column(text).to_pylist()]
                columns = [pa.array([x for x, _ in done], pa.string()) if n == text else batch.column(n) for n in names]
                spans = pa.array([[dict(zip(("type", "start", "end", "surrogate"), e, strict=True)) for e in found] for _, found in done], _ARROW)
                yield pa.RecordBatch.from_arrays([*columns, spans], [*names, "entities"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("entities", ENTITY)]))
