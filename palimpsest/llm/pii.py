"""Operator 2: format-preserving pseudonyms for personal data by keyed Feistel permutations.

Values that pass validation are replaced by another value of the same format: a number
stays a number of as many digits, a card keeps a right check digit, a date stays a date.
The permutation depends on the key and the format alone, so equal values get equal
pseudonyms in all documents, and the holder of the key can invert them.  A date has one
pseudonym in whatever form it is written.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Characters of a long value that are permuted at once.
BLOCK = 64
_LOW = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_LATIN = "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_LATIN_UP = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_CLASSES = [_DIGITS, _LOW, _LOW.upper(), _LATIN, _LATIN_UP]
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of the integers below any size."""

    def __init__(self, key: bytes):
        self.key = key[:64]

    def _round(self, i: int, tweak: str, x: int, size: int) -> int:
        # hexadecimal: linear in the size of the number, and without Python's limit on decimal digits
        text = f"{tweak}|{i}|{size:x}|{x:x}".encode()
        wide = -(-size.bit_length() // 8) + 8
        out = b""
        block = 0
        while len(out) < wide:
            out += hashlib.blake2b(text + b"|%d" % block, key=self.key, digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:wide], "big") % size

    @staticmethod
    def _halves(size: int) -> tuple[int, int]:
        a = 1 << -(-(size - 1).bit_length() // 2)
        return a, -(-size // a)

    def _once(self, x: int, size: int, tweak: str, backward: bool) -> int:
        a, b = self._halves(size)
        left, right = x % a, x // a
        for i in reversed(range(ROUNDS)) if backward else range(ROUNDS):
            sign = -1 if backward else 1
            if i % 2 == 0:
                left = (left + sign * self._round(i, tweak, right, a)) % a
            else:
                right = (right + sign * self._round(i, tweak, left, b)) % b
        return left + a * right

    def permute(self, x: int, size: int, tweak: str, backward: bool = False, valid: Callable[[int], bool] = lambda x: True) -> int:
        """Cycle walking: repeats the Feistel network until the value is below ``size`` and valid."""
        while True:
            x = self._once(x, size, tweak, backward)
            if x < size and valid(x):
                return x

    def digits(self, text: str, tweak: str, backward: bool = False, valid: Callable[[str], bool] = lambda s: True) -> str:
        """A digit string of equal length."""
        n = len(text)
        return f"{self.permute(int(text), 10**n, f'{tweak}{n}', backward, lambda x: valid(f'{x:0{n}d}')):0{n}d}"

    def classes(self, text: str, tweak: str, backward: bool = False, alphabets: list[str] | None = None) -> str | None:
        """Each letter and digit changes within its class; others stay.  None where nothing can change.

        Characters are permuted in blocks of BLOCK, each tweaked by a hash of the plain text before it,
        so that the work is linear in the length of the text.
        """
        kinds = [_kind(c, alphabets) for c in text]
        if all(len(k) < 2 for k in kinds):
            return None
        shape = hashlib.blake2b("\0".join(kinds).encode(), digest_size=16).hexdigest()
        before = hashlib.blake2b(digest_size=16)
        out = []
        for at in range(0, len(text), BLOCK):
            part, own = text[at : at + BLOCK], kinds[at : at + BLOCK]
            new = self._block(part, own, f"{tweak}{shape}{at}{before.hexdigest() if at else ''}", backward)
            before.update((new if backward else part).encode())
            out.append(new)
        return "".join(out)

    def _block(self, text: str, kinds: list[str], tweak: str, backward: bool) -> str:
        size, value = 1, 0
        for c, kind in zip(text, kinds):
            if kind:
                size, value = size * len(kind), value * len(kind) + kind.index(c)
        if size < 2:
            return text
        value = self.permute(value, size, tweak, backward)
        out = []
        for c, kind in zip(reversed(text), reversed(kinds)):
            if kind:
                value, at = divmod(value, len(kind))
                c = kind[at]
            out.append(c)
        return "".join(reversed(out))


@lru_cache(maxsize=4096)
def _script(block: int, category: str) -> str:
    """The letters or digits of one Unicode category among 256 neighbouring code points."""
    return "".join(c for c in map(chr, range(block << 8, (block + 1) << 8)) if unicodedata.category(c) == category)


@lru_cache(maxsize=100_000)
def _class(c: str) -> str:
    known = next((a for a in _CLASSES if c in a), None)
    return known or (_script(ord(c) >> 8, unicodedata.category(c)) if c.isalnum() else "")


def _kind(c: str, alphabets: list[str] | None) -> str:
    """The class in which a character changes, empty for none."""
    return _class(c) if alphabets is None else next((a for a in alphabets if c in a), "")


def luhn_digit(payload: str) -> str:
    """The check digit that makes payload + digit valid."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c)
        total += (d if i % 2 else (2 * d - 9 if d > 4 else 2 * d))
    return str(-total % 10)


def _iban_check(country: str, body: str) -> str:
    value = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - value % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """Puts digits in the places of the digits of ``shape``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _bare(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


_LOCAL = re.compile(r"[\w.%+-]")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_SECRET = re.compile(r"(?i)(?<=[\"'=:\s])[A-Za-z0-9+/_-]{20,}(?=[\"'\s,;]|$)")
_SECRET_BEFORE = re.compile(r"(?i)(?:token|secret|api[_-]?key|access[_-]?key|password|passwd|bearer)\W{1,6}$")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SPAN = re.compile(r"[\d+(][\d ().+/-]*+")
_NUMBER = re.compile(
    r"(?P<date>(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]))"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d]))"
)


def mail_addresses(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of all mail addresses: from each @ to both sides, so that every character is read once or twice."""
    end = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > end and _LOCAL.match(text, begin - 1):
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at and (text[at - 1].isalnum() or text[at - 1] == "_") else None
        if host:
            end = host.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


class Pseudonymiser:
    """Finds, validates and replaces personal data in texts with one key.

    Mail addresses (the local part changes), card numbers with a right Luhn digit, phone
    numbers, IPv4 addresses, social security numbers of an issued range, IBANs with a
    right checksum, dates from 1900 to 2099, and secrets named as such.  What fails
    validation is left as it is.  ``backward`` restores the originals.
    """

    def __init__(self, key: bytes, backward: bool = False):
        self.feistel, self.backward = Feistel(key), backward
        self.cached = lru_cache(maxsize=100_000)(self._value)

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym, None where the value isn't valid."""
        return (self.cached if len(text) <= 100 else self._value)(kind, text)

    def _value(self, kind: str, text: str) -> str | None:
        f, back = self.feistel, self.backward
        if kind == "email":
            local, _, host = text.partition("@")
            new = f.classes(local, "email", back)
            return None if new is None else new + "@" + host
        if kind == "secret":
            if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
                return f.classes(text, "hex", back, ["0123456789abcdef" if text.lower() == text else "0123456789ABCDEF"])
            return f.classes(text, "secret", back)
        if kind == "iban":
            bare = text.replace(" ", "")
            if not 15 <= len(bare) <= 34 or _iban_check(bare[:2], bare[4:]) != bare[2:4]:
                return None
            body = f.classes(bare[4:], "iban" + bare[:2], back) or bare[4:]
            rest = iter(bare[:2] + _iban_check(bare[:2], body) + body)
            return "".join(c if c == " " else next(rest) for c in text)
        digits = _bare(text)
        if kind == "card":
            if luhn_digit(digits[:-1]) != digits[-1]:
                return None
            payload = f.digits(digits[:-1], "card", back)
            return _refill(text, payload + luhn_digit(payload))
        if kind == "ip":
            parts = text.split(".")
            if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
                return None
            value = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
            return ".".join(map(str, value.to_bytes(4, "big")))
        if kind == "ssn":
            issued = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
            return _refill(text, f.digits(digits, "ssn", back, issued)) if issued(digits) else None
        if kind == "phone":
            if not 9 <= len(digits) <= 15:
                return None
            country = len(re.match(r"\+?(\d*)", text)[1]) if text[0] == "+" else 0
            if country > 3:
                country = 1
            return _refill(text, digits[:country] + f.digits(digits[country:], "phone" + digits[:country], back))
        order = ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y")
        for form in order:
            try:
                day = datetime.datetime.strptime(text, form).date().toordinal()
            except ValueError:
                continue
            if not _FIRST_DAY <= day <= _LAST_DAY:
                return None
            # one permutation for all forms; a slash date is read day first where it can be, so days up to
            # the twelfth stay such days and each form is read back as it was
            early = datetime.date.fromordinal(day).day > 12
            ok = lambda x: (datetime.date.fromordinal(_FIRST_DAY + x).day > 12) == early
            day = _FIRST_DAY + f.permute(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, "date", back, ok)
            made = datetime.date.fromordinal(day)
            return form.replace("%Y", f"{made.year:04d}").replace("%m", f"{made.month:02d}").replace("%d", f"{made.day:02d}")
        return None

    def found(self, text: str) -> list[tuple[int, int, str]]:
        """(begin, end, replacement) of all validated values, in order and without overlaps."""
        out: list[tuple[int, int, str]] = []  # in order

        def add(begin: int, end: int, kind: str) -> None:
            at = bisect_left(out, (begin,))
            if (not at or out[at - 1][1] <= begin) and (at == len(out) or out[at][0] >= end) and (new := self.value(kind, text[begin:end])) is not None:
                out.insert(at, (begin, end, new))

        if "@" in text:
            for begin, end in mail_addresses(text):
                add(begin, end, "email")
        for m in _SECRET.finditer(text):
            if _SECRET_BEFORE.search(text, max(0, m.start() - 24), m.start()):
                add(*m.span(), "secret")
        for m in _IBAN.finditer(text):
            add(*m.span(), "iban")
        for span in _SPAN.finditer(text):
            if span.end() - span.start() >= 7:
                for m in _NUMBER.finditer(text, span.start(), span.end()):
                    edge = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
                    if not any(c.isalnum() or c == "_" for c in edge):
                        add(*m.span(), m.lastgroup)
        return out

    def replace(self, text: str) -> tuple[str, int]:
        found = self.found(text)
        if not found:
            return text, 0
        out, at = [], 0
        for begin, end, new in found:
            out += [text[at:begin], new]
            at = end
        return "".join(out) + text[at:], len(found)


def pseudonymise(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text", backward: bool = False) -> DataFrame:
    """(doc_id, text, replaced): all rows, their text with pseudonyms, and how many values changed.

    A null text stays null with 0 replaced, an empty one stays empty; repeated rows and null
    ids come out as they went in; other columns are not read.  Texts are handled whole.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonymiser(key, backward)
        for b in batches:
            new = [(None, 0) if t is None else made.replace(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([t for t, n in new], pa.string()), pa.array([n for _, n in new], pa.int32())], ["doc_id", "same", "changed", "replaced"])

    digit_or_at = F.col("text").rlike("[0-9@]|(?i:token|secret|passw|bearer|key)")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    # a text goes to Python only where it can hold a value; the others pass by untouched
    split = rows.select("doc_id", F.when(~digit_or_at, F.col("text")).alias("same"), F.when(digit_or_at, F.col("text")).alias("candidate"))
    done = split.mapInArrow(apply, "doc_id long, same string, changed string, replaced int")
    return done.select("doc_id", F.coalesce("changed", "same").alias("text"), "replaced")
