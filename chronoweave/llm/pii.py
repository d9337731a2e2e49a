"""Personal data: validated numbers, dates and addresses become keyed pseudonyms of the same format.

A Feistel network over the numbers below ``n`` (two digits of a mixed radix, cycle-walking) permutes each
kind of value within its format, so a value has one pseudonym wherever it occurs, no two values share
one, and whoever holds the key can undo it.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import batches_of

ROUNDS = 10
CHUNK = 1 << 22
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Days that read only as month first when the month is written first: those above 12.
LATE_DAYS = [x for x in range(FIRST_DAY, LAST_DAY + 1) if datetime.date.fromordinal(x).day > 12]
# IBAN lengths by country, of the IBAN registry.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: Hex digits beyond which a secret is permuted as two halves of bytes.
LONG_HEX = 128
#: Characters of an e-mail name that are permuted together; longer names go by parts of this length.
NAME_PART = 64
MONTHS = "January February March April May June July August September October November December".split()


@functools.cache
def short_days(day_width: int, month_width: int, late: bool) -> list[int]:
    """Ordinals of the days that can be written with a day and month of these widths, of 2 with a leading zero where needed; ``late``: days above 12 alone."""
    days = (datetime.date.fromordinal(x) for x in range(FIRST_DAY, LAST_DAY + 1))
    return [x.toordinal() for x in days if (day_width == 2 or x.day < 10) and (month_width == 2 or x.month < 10) and (x.day > 12 or not late)]


def feistel(value: int, n: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of 0 to n-1; ``tweak`` gives each kind of value its own."""
    if not 0 <= value < n:
        raise ValueError("the value is outside the domain")
    if n == 1:
        return 0
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def noise(i: int, x: int, m: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{n}|{i}|{x}".encode(), key=key[:64], digest_size=max(16, m.bit_length() // 8 + 9))
        return int.from_bytes(h.digest(), "big") % m

    while True:
        x, y = divmod(value, b)  # x below a, y below b
        for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            sign = -1 if inverse else 1
            if i % 2:
                y = (y + sign * noise(i, x, b)) % b
            else:
                x = (x + sign * noise(i, y, a)) % a
        value = x * b + y
        if value < n:
            return value


def luhn_digit(digits: str) -> str:
    """The check digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def luhn_ok(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_ok(value: str) -> bool:
    return IBAN_LENGTHS.get(value[:2]) == len(value) and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _refilled(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order; other characters stay."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


class Pseudonyms:
    """One key's pseudonyms. ``inverse`` restores the originals from pseudonyms."""

    def __init__(self, key: bytes, inverse: bool = False) -> None:
        if not key:
            raise ValueError("a key is needed")
        self.key, self.inverse = key, inverse
        self.memo: dict[tuple[str, str], str | None] = {}

    def _number(self, digits: str, tweak: str) -> str:
        n = 10 ** len(digits)
        return str(feistel(int(digits), n, self.key, tweak, self.inverse)).zfill(len(digits))

    def _letters(self, text: str, kind: str) -> str:
        """Digits, lower-case and upper-case ASCII letters permuted each within their place's alphabet, together; others stay."""
        places = [(i, a) for i, c in enumerate(text) for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in a]
        value, n = 0, 1
        for i, a in places:
            value, n = value * len(a) + a.index(text[i]), n * len(a)
        shape = "".join("9" if len(a) == 10 else "a" for _, a in places)
        value = feistel(value, n, self.key, f"{kind}|{shape}", self.inverse)
        out = list(text)
        for i, a in reversed(places):
            value, r = divmod(value, len(a))
            out[i] = a[r]
        return "".join(out)

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not (13 <= len(digits) <= 19 and luhn_ok(digits)):
            return None
        body = self._number(digits[:-1], "card")
        return _refilled(text, body + luhn_digit(body))

    def iban(self, text: str) -> str | None:
        value = text.replace(" ", "").upper()
        if not iban_ok(value):
            return None
        body = self._letters(value[4:], "iban" + value[:2])
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        new = value[:2] + f"{check:02d}" + body
        it = iter(new.lower() if text == text.lower() else new)
        return "".join(next(it) if c != " " else c for c in text)

    def phone(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if not 9 <= len(digits) <= 15:
            return None
        country = re.match(r"\+(\d{1,3})(?=[\s\-(.])", text)
        keep = len(country[1]) if country else 0
        if len(digits) - keep < 6:
            return None
        return _refilled(text, digits[:keep] + self._number(digits[keep:], f"phone{digits[:keep]}"))

    def ssn(self, text: str) -> str | None:
        a, b, c = text.split("-")
        if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000":
            return None
        valid = [x for x in range(1, 900) if x != 666]
        value = (valid.index(int(a)) * 99 + int(b) - 1) * 9999 + int(c) - 1
        value = feistel(value, len(valid) * 99 * 9999, self.key, "ssn", self.inverse)
        value, c_ = divmod(value, 9999)
        a_, b_ = divmod(value, 99)
        return f"{valid[a_]:03d}-{b_ + 1:02d}-{c_ + 1:04d}"

    def ip(self, text: str) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if max(parts) > 255:
            return None
        value = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, self.key, "ip", self.inverse)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def email(self, text: str) -> str | None:
        local, _, domain = text.rpartition("@")
        parts = [local[i : i + NAME_PART] for i in range(0, len(local), NAME_PART)]
        new = [self._letters(x, "email@" + domain.lower() + ("" if i == 0 else f"#{i}")) for i, x in enumerate(parts)]
        return f"{''.join(new)}@{domain}"

    def _halves(self, text: str) -> str:
        """A Feistel network over the two halves of a hex string of any length, by an extendable hash of the other half; linear time."""
        cut = len(text) // 2
        left, right = text[:cut], text[cut:]

        def mixed(x: str, other: str, i: int) -> str:
            noise = hashlib.shake_256(b"|".join((hashlib.blake2b(b"hex", key=self.key[:64]).digest(), f"{len(text)}|{i}".encode(), other.encode()))).hexdigest(-(-len(x) // 2))
            return f"{int(x, 16) ^ int(noise[: len(x)], 16):0{len(x)}x}"

        for i in range(ROUNDS - 1, -1, -1) if self.inverse else range(ROUNDS):
            if i % 2:
                right = mixed(right, left, i)
            else:
                left = mixed(left, right, i)
        return left + right

    def secret(self, text: str) -> str | None:
        """Hexadecimal strings of any length with digits and letters both: keys, tokens, hashes. Their pseudonyms hold both as well."""
        if text.isdigit() or text.isalpha():
            return None
        new = text.lower()
        while new == text.lower() or new.isdigit() or new.isalpha():
            if len(text) > LONG_HEX:
                new = self._halves(new)
            else:
                new = f"{feistel(int(new, 16), 16 ** len(text), self.key, 'hex', self.inverse):0{len(text)}x}"
            if new == text.lower():  # a fixed point stays one
                break
        return new.upper() if text.upper() == text else new

    def _day(self, y: int, m: int, d: int) -> datetime.date | None:
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        return datetime.date.fromordinal(FIRST_DAY + feistel(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, self.key, "date", self.inverse))

    def _late_day(self, y: int, m: int, d: int) -> datetime.date | None:
        """Days above 12 are permuted among themselves, so that a date with the month first stays one."""
        try:
            day = datetime.date(y, m, d).toordinal()
        except ValueError:
            return None
        if d <= 12 or not FIRST_DAY <= day <= LAST_DAY:
            return None
        return datetime.date.fromordinal(LATE_DAYS[feistel(bisect.bisect_left(LATE_DAYS, day), len(LATE_DAYS), self.key, "late date", self.inverse)])

    def _short_date(self, a: str, s: str, b: str, y: int) -> str | None:
        """Dates with a day or month of one digit are permuted among those that can be written in the same widths."""
        for order, day, month in (("day", a, b), ("month", b, a)):
            try:
                old = datetime.date(y, int(month), int(day)).toordinal()
            except ValueError:
                continue
            # With the month first only dates that don't read as day first.
            days = short_days(len(day), len(month), order == "month")
            new = datetime.date.fromordinal(days[feistel(bisect.bisect_left(days, old), len(days), self.key, f"short date {len(a)} {len(b)} {order}", self.inverse)])
            d, m = f"{new.day:0{len(day)}d}", f"{new.month:0{len(month)}d}"
            return f"{d}{s}{m}{s}{new.year}" if order == "day" else f"{m}{s}{d}{s}{new.year}"
        return None

    def date(self, text: str) -> str | None:
        """ISO dates, and day or month first with a year of 1900 to 2099; an ambiguous one counts as day first. Widths and separators stay."""
        a, s, b, _, c = re.split(r"([-/.])", text)
        if len(a) == 4:
            new = self._day(int(a), int(b), int(c))
            return new and f"{new.year:04d}{s}{new.month:02d}{s}{new.day:02d}"
        if len(a) + len(b) < 4:
            return self._short_date(a, s, b, int(c))
        new = self._day(int(c), int(b), int(a))
        if new:
            return f"{new.day:02d}{s}{new.month:02d}{s}{new.year:04d}"
        new = self._late_day(int(c), int(a), int(b))
        return new and f"{new.month:02d}{s}{new.day:02d}{s}{new.year:04d}"

    def long_date(self, text: str) -> str | None:
        if m := re.fullmatch(r"(\d{1,2}) (\w+) (\d{4})", text):
            new = self._day(int(m[3]), MONTHS.index(m[2]) + 1, int(m[1]))
            return new and f"{new.day} {MONTHS[new.month - 1]} {new.year}"
        m = re.fullmatch(r"(\w+) (\d{1,2}), (\d{4})", text)
        new = self._day(int(m[3]), MONTHS.index(m[1]) + 1, int(m[2]))
        return new and f"{MONTHS[new.month - 1]} {new.day}, {new.year}"

    def of(self, kind: str, text: str) -> str | None:
        """The pseudonym, or None if the value is not valid for its kind."""
        if len(self.memo) > 100_000:
            self.memo = {}
        if (kind, text) not in self.memo:
            self.memo[kind, text] = getattr(self, kind)(text)
        return self.memo[kind, text]


_month = "|".join(MONTHS)
#: Kinds and patterns, the first that is valid at a place wins.
KINDS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])(?:[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,29}|[a-z]{2}[0-9]{2}(?: ?[0-9a-z]){11,29})(?![0-9A-Za-z])",
    "card": r"(?<![\d.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\d])",
    "ip": r"(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\d])(?!\.\d)",
    "ssn": r"(?<![\d\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d\-])",
    "date": r"(?<![\d\-/.])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:19|20)[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.(?:19|20)[0-9]{2}|[0-9]{1,2}-[0-9]{1,2}-(?:19|20)[0-9]{2})(?![\d\-/])",
    "long_date": rf"(?<!\w)(?:[0-9]{{1,2}} (?:{_month}) (?:19|20)[0-9]{{2}}|(?:{_month}) [0-9]{{1,2}}, (?:19|20)[0-9]{{2}})(?!\d)",
    "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[ \-.]?(?:\([0-9]{1,4}\)[ \-.]?)?[0-9]{2,4}(?:[ \-.]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ \-.][0-9]{4}|[0-9]{3}[ \-.][0-9]{3}[ \-.][0-9]{4})(?![\w])(?!\.\d)",
}
#: More characters than any value has between, before or after its digits across a blank.
REACH = 64
_mark = re.compile(r"[0-9@]+")
_any = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
_each: dict[str, Callable] = {k: re.compile(p).match for k, p in KINDS.items()}


def _beginnings(kind: str, found: str) -> Iterator[str]:
    """The match and, as it may have taken in what follows a value, its beginnings up to a blank or hyphen: of an IBAN that of its country's length, of a card those of 13 digits and more, longest first."""
    yield found
    lengths = {"iban": (IBAN_LENGTHS.get(found[:2].upper()),), "card": range(13, 19)}.get(kind, ())
    for i in range(len(found) - 1, 0, -1) if lengths else ():
        if found[i] in " -" and sum(c not in " -" for c in found[:i]) in lengths:
            yield found[:i]


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches outside which no value can be: every kind has a digit or an @, and blanks at REACH places from any are in no value."""
    at, n = 0, len(text)
    while m := _mark.search(text, at):
        start = max(at, text.rfind(" ", at, max(at, m.start() - REACH)) + 1)
        end = -1
        while m:
            last = m.end()
            if end < last + REACH:
                end = text.find(" ", last + REACH)
                end = n if end < 0 else end
            m = _mark.search(text, last, end + REACH)  # a value across that blank would have a digit so near
        yield start, end
        at = end


def find_values(text: str, valid: Callable[[str, str], str | None]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of valid values, from left to right without overlaps."""
    for at, end in _regions(text):
        while m := _any.search(text, at, end):
            for kind in KINDS:
                own = _each[kind](text, m.start())
                if own and (hit := next(((x, new) for x in _beginnings(kind, own[0]) if (new := valid(kind, x)) is not None), None)):
                    at = own.start() + len(hit[0])
                    yield own.start(), at, kind, hit[1]
                    break
            else:
                at = m.start() + 1


def replace_values(text: str, pseudonyms: Pseudonyms) -> tuple[str, list[dict]]:
    out, last, spans = [], 0, []
    for a, b, kind, new in find_values(text, pseudonyms.of):
        out += [text[last:a], new]
        spans.append({"kind": kind, "start": a, "end": b, "pseudonym": new})
        last = b
    return "".join([*out, text[last:]]), spans


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``(doc_id, text, n_values, spans)`` of each row of ``docs(doc_id, text)``: the text with its valid values replaced.

    Spans give kind, place in the old text and pseudonym, never the old value. A null text stays null and
    has no values; empty texts and texts without values stay byte for byte. Where values of several kinds begin at one
    place the first of KINDS that is valid wins, and values never overlap. Digits are ASCII digits. Left as they are: dates outside 1900 to
    2099 or without a full year, IBANs that mix cases, IPv6 addresses. Hex secrets over LONG_HEX digits and parts of
    e-mail names after the first NAME_PART characters have permutations of their own. A value's pseudonym depends on nothing around it. Repeated
    rows give equal results, a null doc_id stays null, texts count whole, an empty table gives an empty result, and
    further columns, whatever their names, are ignored. No shuffle.
    """
    kind = docs.schema["doc_id"].dataType
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("pseudonym", StringType())])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))

    def run(batches):
        own = Pseudonyms(key)
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                done = [(None, []) if t is None else replace_values(t, own) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([len(d[1]) for d in done], pa.int64()), pa.array([d[1] for d in done], arrow_span)], names=["doc_id", "text", "n_values", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, StructType([StructField("doc_id", kind), StructField("text", StringType()), StructField("n_values", LongType()), StructField("spans", ArrayType(span))]))
