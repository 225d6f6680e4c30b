"""Format-preserving pseudonyms for personal data.

What is found and passes its validity test is replaced by a keyed permutation of the
values of its own format: an alternating Feistel network over a mixed-radix number,
one radix per character class, with cycle walking where the valid values do not fill
the domain. A permutation keeps equal values equal in every document under one key
and different ones different, and its result is again valid (check digits fit, octets
stay below 256, a date is a date).

Formats: e-mail addresses in any script (the registrable domain stays), telephone numbers
(digits only; the spelling and the country code stay), payment card numbers of 13 to 19
digits that pass the Luhn test (as their pseudonyms do; other digits stay), IBANs, US
social security numbers, IPv4 and IPv6 addresses, dates of the years 1 to 9999 (ISO,
day.month.year, day/month/year, and month/day/year where that is no day/month/year; with
as many digits for day and month as before, and between 1900 and 2099 if they were),
hexadecimal secrets of 32 digits or more and keys with a known beginning, which stays.

The key is a secret of whoever runs this: ``spark.queryloom.pii.key`` names it for the
registered queries. Without one a public default is used, for tests and comparisons: its
pseudonyms can be undone by anyone.

A match that swallowed a group behind its value is read again as a shorter one that ends at
a group: an IBAN by its country's length, a telephone number by the length of its country's
numbers where that is known. What passes no test is tried as the formats that come later,
and then searched from its second character on.

Defined results: a null text stays null with no findings; ids, ties and repeated rows
do not matter, since a row's result depends on its text alone; a long text is read
whole; other columns stay as they are. There is no shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queryloom.llm._common import lean

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
#: Only a default, so that results can be compared; give a secret of your own.
KEY = b"queryloom default pseudonym key"
KEY_SETTING = "spark.queryloom.pii.key"
ROUNDS = 8
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
ALPHABET = {ch: a for a in CLASSES for ch in a}


@cache
def alphabet(ch: str) -> str:
    """The characters that may stand in the place of ch: of its class, or letters and digits of its kind near it in Unicode."""
    if ch in ALPHABET:
        return ALPHABET[ch]
    kind = unicodedata.category(ch)
    if kind[0] not in "LMN":
        return ""
    block = ord(ch) & ~127
    return "".join(x for c in range(block, block + 128) if unicodedata.category(x := chr(c)) == kind and x not in ALPHABET)

PATTERNS = (
    r"(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})",
    r"(?<![\w.])(?P<ip>(?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\d)",
    r"(?<![\w:.])(?P<ip6>(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,6}|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})(?![\w:])",
    r"(?<![\w.-])(?P<date>\d{4}-\d\d-\d\d|\d\d?\.\d\d?\.\d{4}|\d\d?/\d\d?/\d{4})(?![\w-])",
    r"(?<![\w-])(?P<ssn>\d{3}-\d\d-\d{4})(?![\w-])",
    r"(?<!\w)(?P<iban>[A-Z]{2}\d\d(?: ?[A-Z0-9]){11,30})(?!\w)",
    r"(?<![\w.])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\(0\d{1,4}\) ?\d{3,4}[ -]?\d{3,4}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4})(?![\w-])",
    r"(?<![\w.-])(?P<card>\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    r"(?<!\w)(?P<secret>[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)",
    r"(?<![\w-])(?P<token>(?:AKIA|ASIA)[0-9A-Z]{16}|sk-(?:[a-z]+-)*[A-Za-z0-9_]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})(?![\w-])",
)
FIND = re.compile("|".join(PATTERNS))
ONE = {kind: re.compile(next(x for x in PATTERNS if f"<{kind}>" in x)) for kind in ("email", "ip", "ip6", "date", "ssn", "iban", "phone", "card", "secret", "token")}
SOME = re.compile(r"[0-9@]|[a-f]{32}|[A-F]{32}|AKIA|ASIA|sk-|gh[pousr]_|github_pat_|xox|AIza|glpat-")
#: What a format counts as.
COUNTS = {"ip6": "ip", "token": "secret"}
#: Letters and digits of an IBAN by country.
IBAN = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 "
        "KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
#: Least and most digits of a national number, by country code, where they are fixed.
NATIONAL = {"1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "30": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "36": (8, 9), "39": (6, 11), "40": (9, 9), "41": (9, 9), "44": (9, 10), "45": (8, 8), "46": (7, 9), "47": (8, 8), "48": (9, 9), "49": (6, 11), "52": (10, 10), "55": (10, 11), "61": (9, 9), "65": (8, 8), "81": (9, 10), "86": (10, 11), "90": (10, 10), "91": (10, 10), "351": (9, 9), "353": (7, 9), "420": (9, 9), "421": (9, 9)}


class Feistel:
    """Keyed permutations; ``tweak`` names the format, so formats don't share one."""

    def __init__(self, key: bytes = KEY) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: str, r: int, half: int, size: int) -> int:
        data = f"{tweak}|{r}|{half}".encode()
        wide = (size.bit_length() + 7) // 8 + 8
        out = b"".join(hashlib.blake2b(data, key=self.key, digest_size=64, salt=i.to_bytes(4, "little")).digest() for i in range(-(-wide // 64)))
        return int.from_bytes(out[:wide], "little") % size

    def pair(self, tweak: str, a: int, b: int, size_a: int, size_b: int, back: bool = False) -> tuple[int, int]:
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2 == 0:
                a = (a + sign * self._round(tweak, r, b, size_a)) % size_a
            else:
                b = (b + sign * self._round(tweak, r, a, size_b)) % size_b
        return a, b

    def number(self, tweak: str, x: int, size: int, back: bool = False) -> int:
        """Permutation of range(size), walking cycles of the next rectangle."""
        if size < 2:
            return x
        side = 1 << ((size - 1).bit_length() + 1) // 2
        other = -(-size // side)
        while True:
            x = (lambda p: p[0] * other + p[1])(self.pair(tweak, x // other, x % other, side, other, back))
            if x < size:
                return x

    def text(self, tweak: str, s: str, back: bool = False) -> str:
        """Permutation of the strings with the character classes of s; other characters stay."""
        size, x, shape = 1, 0, []
        for ch in s:
            if a := alphabet(ch):
                size, x = size * len(a), x * len(a) + a.index(ch)
            shape.append(ch if not a else str(CLASSES.index(a)) if a in CLASSES else a[0])
        x, out = self.number(f"{tweak}:{''.join(shape)}", x, size, back), []
        for ch in reversed(s):
            if a := alphabet(ch):
                x, k = divmod(x, len(a))
                ch = a[k]
            out.append(ch)
        return "".join(reversed(out))


def luhn(digits: str) -> int:
    """0 for a valid number."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def spread(like: str, chars: str) -> str:
    """chars in the places of the letters and digits of like."""
    it = iter(chars)
    return "".join(next(it) if ch.isalnum() else ch for ch in like)


def compact(s: str) -> str:
    return "".join(ch for ch in s if ch.isalnum())


def _email(f: Feistel, s: str, back: bool) -> str:
    local, _, host = s.partition("@")
    labels = host.split(".")
    return f.text("email", local, back) + "@" + ".".join([*(f.text("host", x, back) for x in labels[:-2]), *labels[-2:]])


def _phone(f: Feistel, s: str, back: bool) -> str | None:
    digits = compact(s)
    country = len(re.match(r"\+?(\d*)", s)[1]) if s.startswith("+") and not s[1:].isdigit() else (1 if s.startswith(("+", "0", "(0")) else 0)
    if not 7 <= len(digits) <= 15:
        return None
    return spread(s, digits[:country] + f.text("phone" + digits[:country], digits[country:], back))


def _card(f: Feistel, s: str, back: bool) -> str | None:
    digits = compact(s)
    if luhn(digits):
        return None
    body = f.text("card", digits[:-1], back)
    return spread(s, body + str(-luhn(body + "0") % 10))


def _iban(f: Feistel, s: str, back: bool) -> str | None:
    flat = compact(s)
    value = lambda t: int("".join(str(int(ch, 36)) for ch in t))
    if not 15 <= len(flat) <= 34 or value(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = f.text("iban" + flat[:2], flat[4:], back)
    return spread(s, flat[:2] + f"{98 - value(body + flat[:2] + '00') % 97:02d}" + body)


def _ssn(f: Feistel, s: str, back: bool) -> str | None:
    a, b, c = map(int, s.split("-"))
    if not (0 < a < 900 and a != 666 and b and c):
        return None
    x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    x, c = divmod(f.number("ssn", x, 898 * 99 * 9999, back), 9999)
    a, b = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"


def _ip(f: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.number("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ip6(f: Feistel, s: str, back: bool) -> str | None:
    try:
        x = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    new = str(ipaddress.IPv6Address(f.number("ip6", x, 1 << 128, back)))
    return new.upper() if any(ch.isupper() for ch in s) else new


#: All dates, and among them those of 1900 to 2099, which stay among themselves.
DATES, NEAR = datetime.date.max.toordinal(), (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())


def _date(f: Feistel, s: str, back: bool) -> str | None:
    mark = next(ch for ch in s if not ch.isdigit())
    texts = s.split(mark)
    y, m, d = texts if mark == "-" else texts[::-1]
    american = mark == "/" and int(m) > 12
    if american:
        m, d = d, m
    try:
        x = datetime.date(int(y), int(m), int(d)).toordinal()
    except ValueError:
        return None
    wide = len(m) == len(d) == 2  # else a part of two digits has no leading zero
    near = NEAR[0] <= x <= NEAR[1]

    def alike(new: datetime.date) -> bool:
        sizes = wide or (len(str(new.month)) == len(m) and len(str(new.day)) == len(d))
        return sizes and (NEAR[0] <= new.toordinal() <= NEAR[1]) == near and (new.day > 12 or not american)

    low, size = (NEAR[0], NEAR[1] - NEAR[0] + 1) if near else (1, DATES)
    while True:
        x = low + f.number("date" if near else "far date", x - low, size, back)
        if alike(new := datetime.date.fromordinal(x)):
            break
    year, month, day = f"{new.year:04d}", f"{new.month:0{len(m)}d}", f"{new.day:0{len(d)}d}"
    return mark.join((year, month, day) if mark == "-" else (month, day, year) if american else (day, month, year))


def _secret(f: Feistel, s: str, back: bool) -> str:
    upper = s.isupper()
    x = f.number(f"secret{len(s)}", int(s, 16), 16 ** len(s), back)
    return f"{x:0{len(s)}{'X' if upper else 'x'}}"


TOKEN = re.compile(r"AKIA|ASIA|sk-(?:[a-z]+-)*|gh[pousr]_|github_pat_|xox[abprs]-|AIza|glpat-")


def _token(f: Feistel, s: str, back: bool) -> str:
    start = TOKEN.match(s).end()
    return s[:start] + f.text("token" + s[:start], s[start:], back)


def _groups(s: str) -> list[str]:
    """s and its beginnings that end at a group, the longest first."""
    return [s, *(s[: m.start()] for m in reversed(list(re.finditer(r"[ .-]+", s))))]


def _ibans(s: str) -> list[str]:
    """The readings of a match as an IBAN, best first."""
    size, all_ = IBAN.get(s[:2]), _groups(s)
    return all_ if size is None else [*(x for x in all_ if len(compact(x)) == size), s]


def _phones(s: str) -> list[str]:
    if not s.startswith("+"):
        return [s]
    all_, lead = _groups(s), re.match(r"\+(\d+)", s)[1]
    code = next((lead[:n] for n in (1, 2, 3) if lead[:n] in NATIONAL), None)
    if code is None or len(code) < len(lead) <= 3:
        return all_
    least, most = NATIONAL[code]
    return [*(x for x in all_ if least <= len(compact(x)) - len(code) - ("(0)" in x) <= most), *all_]


#: Formats whose pattern may take a group too many.
READINGS: dict[str, Callable[[str], list[str]]] = {"iban": _ibans, "phone": _phones}
MAKE: dict[str, Callable[[Feistel, str, bool], str | None]] = {"email": _email, "phone": _phone, "card": _card, "iban": _iban, "ssn": _ssn, "ip": _ip, "ip6": _ip6, "date": _date, "secret": _secret, "token": _token}


class Pseudonymizer:
    def __init__(self, key: bytes = KEY, cache: int = 100_000) -> None:
        self.feistel, self.known, self.limit = Feistel(key), {}, cache

    def value(self, kind: str, s: str, back: bool = False) -> str | None:
        """The pseudonym of s, or None where s isn't valid; ``back`` undoes it."""
        at = (kind, s, back)
        if at not in self.known:
            if len(self.known) >= self.limit:
                self.known.clear()
            self.known[at] = MAKE[kind](self.feistel, s, back)
        return self.known[at]

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)

        if not SOME.search(text):
            return text, counts
        out, at, done = [], 0, 0
        while m := FIND.search(text, at):
            if (found := self._first(text, m)) is None:
                at = m.start() + 1
                continue
            kind, size, new = found
            counts[COUNTS.get(kind, kind)] += 1
            out += (text[done : m.start()], new)
            at = done = m.start() + size
        return "".join((*out, text[done:])), counts

    def _first(self, text: str, m: re.Match) -> tuple[str, int, str] | None:
        """Kind, length and pseudonym of the first reading of a match that is valid."""
        kinds = list(ONE)
        for kind in kinds[kinds.index(m.lastgroup) :]:
            if here := m if kind == m.lastgroup else ONE[kind].match(text, m.start()):
                for s in READINGS[kind](here[0]) if kind in READINGS else (here[0],):
                    if (new := self.value(kind, s)) is not None:
                        return kind, len(s), new
        return None


def key_of(spark: SparkSession) -> bytes:
    """The key that the session's settings name, else the public default."""
    return spark.conf.get(KEY_SETTING, KEY.decode()).encode()


def pseudonymize(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """docs with the text replaced, and pii_<kind> counts behind its columns."""
    names = [f"pii_{k}" for k in KINDS]
    taken = {c.lower() for c in docs.columns}
    while taken & set(names):
        names = [f"_{x}" for x in names]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.IntegerType()) for name in names)])
    at = docs.columns.index(text_col)

    @lean
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swap = Pseudonymizer(key)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column(at).to_pylist():
                new, n = swap.text(t or "")
                texts.append(None if t is None else new)
                counts.append(n)
            columns = [*batch.columns, *(pa.array([n[k] for n in counts], pa.int32()) for k in KINDS)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return docs.mapInArrow(work, schema)


def digest(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, the number found of each kind, and the text as it leaves."""
    out = pseudonymize(docs.select("doc_id", "text"), key)
    total = sum((F.col(f"pii_{k}") for k in KINDS[1:]), F.col(f"pii_{KINDS[0]}"))
    return out.select("doc_id", total.alias("n_found"), *(F.col(f"pii_{k}").alias(f"n_{k}") for k in KINDS), "text", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
