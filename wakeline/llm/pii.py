"""PII: format-preserving Feistel pseudonyms.

What is found and validated is replaced by a value of the same format through a keyed permutation, so that equal values
get equal pseudonyms in every document and different ones of one written format stay different.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import ipaddress
import re
import secrets
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROUNDS = 8
#: Characters that are permuted as one number.
BLOCK = 200
KINDS = ("email", "secret", "ip", "date", "card", "iban", "ssn", "phone")


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a Feistel network over the next even number of bits, walking its cycle until
    the value is in range again."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            got = b""
            block = 0
            while len(got) < width:
                got += hashlib.blake2b(right.to_bytes(width, "big") + bytes([r]) + block.to_bytes(4, "big") + tweak.encode(), key=key).digest()
                block += 1
            left, right = right, left ^ (int.from_bytes(got[:width], "big") & mask)
        x = left << half | right
        if x < size:
            return x


def permute_within(x: int, size: int, valid: Callable[[int], bool], key: bytes, tweak: str) -> int:
    """The permutation restricted to the valid values (x is one): walk on until one is met."""
    while True:
        x = permute(x, size, key, tweak)
        if valid(x):
            return x


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _refill(text: str, digits: str) -> str:
    """text with its digits, in order, replaced by the given ones."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or d[0] not in "23456" or not luhn(d):
        return None
    # the first digit (the network) and the length stay; the rest is permuted and the check digit made anew
    n = len(d) - 2
    body = d[0] + str(permute(int(d[1:-1]), 10**n, key, f"card{len(d)}{d[0]}")).zfill(n)
    return _refill(text, next(body + c for c in "0123456789" if luhn(body + c)))


def _phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if text.startswith("+") and not text.startswith("+1"):
        if not 8 <= len(d) <= 15:
            return None
        n = len(d) - 2  # an international number: its first two digits stay
        return _refill(text, d[:2] + str(permute(int(d[2:]), 10**n, key, f"phone{d[:2]}{n}")).zfill(n))
    head, d = d[:-10], d[-10:]
    if head not in ("", "1") or len(d) != 10:
        return None
    return _refill(text, head + str(permute(int(d), 10**10, key, "phone")).zfill(10))


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(text: str, key: bytes) -> str | None:
    x = int(_digits(text))
    return _refill(text, str(permute_within(x, 10**9, _ssn_ok, key, "ssn")).zfill(9)) if _ssn_ok(x) else None


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    return str(ipaddress.IPv4Address(permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")))


def _days(month: int, leap: bool) -> int:
    return 29 if month == 2 and leap else 28 if month == 2 else 30 if month in (4, 6, 9, 11) else 31


def _pairs(leap: bool) -> list[tuple[int, int]]:
    """All (a, b) that are a day and a month in one order or the other."""
    fits = lambda d, m: 1 <= m <= 12 and 1 <= d <= _days(m, leap)
    return [(a, b) for a in range(1, 32) for b in range(1, 32) if fits(a, b) or fits(b, a)]


PAIRS = _pairs(True)
PAIR_AT = {p: k for k, p in enumerate(PAIRS)}
LEAP_ONLY = set(PAIRS) - set(_pairs(False))


def _date(text: str, key: bytes) -> str | None:
    a, b, c = re.split(r"[-/.]", text)
    if len(a) == 4:  # every day of the years 1 to 9999
        try:
            day = datetime.date(int(a), int(b), int(c)).toordinal()
        except ValueError:
            return None
        new = datetime.date.fromordinal(1 + permute(day - 1, datetime.date.max.toordinal(), key, "date"))
        return _refill(text, f"{new.year:04d}{new.month:02d}{new.day:02d}")
    # day first and month first are written alike, so the strings that are a date in either order are permuted
    pair, year, n = (int(a), int(b)), int(c), len(PAIRS)

    def valid(x: int) -> bool:
        return x >= n and (PAIRS[x % n] not in LEAP_ONLY or calendar.isleap(x // n))

    if pair not in PAIR_AT or not valid(year * n + PAIR_AT[pair]):
        return None
    x = permute_within(year * n + PAIR_AT[pair], 10_000 * n, valid, key, "day")
    return _refill(text, f"{PAIRS[x % n][0]:02d}{PAIRS[x % n][1]:02d}{x // n:04d}")


#: Radices and alphabets of the character classes that keep their class.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def permute_string(text: str, key: bytes, tweak: str) -> str:
    """Digits stay digits, ASCII letters keep their case, all else stays: one permutation of the strings of that shape. A string
    over BLOCK characters is permuted block by block, each under a tweak that holds what stood before (so it stays one to one,
    and the work is in proportion to the length)."""
    if len(text) > BLOCK:
        before, out = hashlib.blake2b(key=key, digest_size=16), []
        for k in range(0, len(text), BLOCK):
            out.append(permute_string(text[k : k + BLOCK], key, f"{tweak}{before.hexdigest()}" if k else tweak))
            before.update(text[k : k + BLOCK].encode())
        return "".join(out)
    kinds = [next((a for a in CLASSES if c in a), None) for c in text]
    x, size = 0, 1
    for c, a in zip(text, kinds, strict=True):
        if a:
            x, size = x * len(a) + a.index(c), size * len(a)
    shape = "".join("-" if a is None else str(CLASSES.index(a)) for a in kinds)
    x = permute(x, size, key, f"{tweak}{shape}")
    out = []
    for c, a in zip(reversed(text), reversed(kinds), strict=True):
        if a:
            x, k = divmod(x, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


def _email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    name, _, top = domain.rpartition(".")
    return permute_string(local, key, "local") + "@" + permute_string(name, key, "domain") + "." + top


def _secret(text: str, key: bytes) -> str:
    m = re.match(r"(AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)?(.*)", text, re.S)
    return (m[1] or "") + permute_string(m[2], key, "secret")


def _iban(text: str, key: bytes) -> str | None:
    s = text.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4]))
    if not 15 <= len(s) <= 34 or number(s) % 97 != 1 or not 2 <= int(s[2:4]) <= 98:
        return None
    body = permute_string(s[4:], key, "iban" + s[:2])
    new = s[:2] + f"{98 - number(s[:2] + '00' + body) % 97:02d}" + body
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in text)


RULES: dict[str, Callable[[str, bytes], str | None]] = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone}
#: Tried in this order at each place; a match that its rule finds invalid is left as it is. No form has a greatest length.
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-]))"
    r"|(?<![A-Za-z0-9])(?P<secret>(?:AKIA|ASIA)[A-Z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,})"
    r"|(?i:(?<![a-z0-9])(?:api_?key|secret|token|passw(?:or)?d|pwd|aws_secret_access_key)[\"']?[ ]?[=:][ ]?[\"']?)(?P<value>[A-Za-z0-9/+_-]{8,})"
    r"|(?<![\w.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w]|\.[0-9])"
    r"|(?<![\w/.-])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![\w/-]|\.[0-9])"
    r"|(?<![\w.-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<![\w+.-])(?P<card>[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{13})(?![\w-])"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w+.-])(?P<phone>(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[1-9][0-9]{7,14}|\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5})(?![\w-])"
)
NEEDS = re.compile(r"[0-9@]|AKIA|ASIA|gh[pousr]_|sk-|xox|(?i:secret|token|passw|pwd|api_?key)")
#: Digits of other scripts; DIGITS gives the ASCII digit of each.
OTHER_DIGITS = re.compile(r"[^\D0-9]")
DIGITS = {c: str(unicodedata.decimal(chr(c))) for c in range(128, sys.maxunicode + 1) if chr(c).isdecimal()}


def in_script(new: str, old: str) -> str:
    """new with its digits in the script of those of old: place by place where the lengths agree, else that of old's first digit."""
    at = [ord(c) - int(DIGITS[ord(c)]) if ord(c) in DIGITS else 48 for c in old]
    if len(new) != len(old):
        at = [next((z for z, c in zip(at, old, strict=True) if c.isdecimal()), 48)] * len(new)
    return "".join(chr(z + ord(c) - 48) if "0" <= c <= "9" else c for c, z in zip(new, at, strict=True))


class Pseudonyms:
    """Replaces personal data in texts. Pseudonyms of values already seen are kept for speed (a bounded cache).

    Digits of every script count as digits: a value has the pseudonym of its ASCII form, written in its own script.
    """

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.of = lru_cache(100_000)(lambda kind, value: RULES[kind](value, self.key))

    def _new(self, kind: str, value: str) -> str | None:
        return self.of(kind, value) if len(value) <= BLOCK else RULES[kind](value, self.key)

    def text(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        counts: dict[str, int] = {}
        if text is None:
            return text, counts
        foreign = not text.isascii() and OTHER_DIGITS.search(text) is not None
        plain = text.translate(DIGITS) if foreign else text  # as long as the text
        if not NEEDS.search(plain):
            return text, counts
        out, end = [], 0
        for m in PATTERN.finditer(plain):
            kind = "secret" if m.lastgroup == "value" else m.lastgroup
            new = self._new(kind, m[m.lastgroup])
            if new is None:
                continue
            counts[kind] = counts.get(kind, 0) + 1
            a, b = m.span(m.lastgroup)
            out += [text[end:a], in_script(new, text[a:b]) if foreign else new]
            end = b
        return "".join([*out, text[end:]]), counts


def _kernel(key: bytes, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonyms(key)
        for batch in batches:
            i = batch.schema.get_field_index("text")
            done = [worker.text(x.as_py()) for x in batch.column(i)]
            columns = [batch.column(k) if k != i else pa.array([x for x, _ in done], batch.schema.field(i).type) for k in range(batch.num_columns)]
            columns += [pa.array([c.get(kind, 0) for _, c in done], pa.int64()) for kind in KINDS[: len(names) - len(columns)]]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def session_key(spark: SparkSession) -> bytes:
    """The key of the setting spark.wakeline.pii.key; where it is unset, one drawn at random for this application (pseudonyms
    then agree within a session only, and nobody can invert them later)."""
    told = spark.conf.get("spark.wakeline.pii.key", None)
    return told.encode() if told else _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


_drawn: dict[str, bytes] = {}


def pseudonymised(df: DataFrame, *, key: bytes, counts: bool = True) -> DataFrame:
    """df with its column text rewritten, and n_<kind> counts added unless told not to (an own column of that name is
    replaced). Whoever has the key can invert the pseudonyms.

    A null text stays null, an empty one empty; texts of any length are taken whole; repeated rows are rewritten alike.
    Numbers that fail their check (Luhn, mod 97, octets, calendar, social security areas) are left as they are. An
    empty table gives no rows.
    """
    added = [f"n_{k}" for k in KINDS] if counts else []
    df = df.drop(*added)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {v}" for k, v in types.items()), *(f"{k} long" for k in added)])
    return df.mapInArrow(_kernel(key, [*df.columns, *added]), schema)
