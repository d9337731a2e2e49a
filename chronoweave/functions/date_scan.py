"""The date annotator in one Arrow pass: compiled patterns over a text, a sweep over sorted spans.

It gives what ``dates.annotate_dates_native`` gives as a Column. A text without four digits in a row has no
date and is not looked at further; a grammar's pattern only runs if what it cannot do without is there.
"""

from __future__ import annotations

import re

import pyarrow as pa

from .dates import GRAMMARS, MONTHS, SUFFIX

_YEAR = re.compile(r"[0-9]{4}")
_MONTH = {k: f"{i:02d}" for i, m in enumerate(MONTHS, 1) for k in (m, m[:3])}
#: What a text must hold for a grammar to match: a dash, a comma, or nothing special.
_NEEDS = {"ts1": "–", "ts2": "–", "ts3": "–", "ts4": "–", "ts5": "–", "ts6": "–", "ymd": ",", "mdy": ","}
_PATTERNS = {name: (re.compile(p.replace("(?U)", ""), re.UNICODE if "(?U)" in p else re.ASCII), first, last) for name, (p, first, last) in GRAMMARS.items()}
_YMD = re.compile(r"^(\d{4})[-|/.](\d{1,2})[-|/.](\d{1,2})$", re.ASCII)
_DMY = re.compile(r"^(\d{1,2})[-|/.](\d{1,2})[-|/.](\d{4})$", re.ASCII)
_Y = re.compile(r"^\d{4}$", re.ASCII)
ROW = pa.struct([("text", pa.string()), ("method", pa.string()), ("begin", pa.string()), ("end", pa.string()), ("s", pa.int32()), ("e", pa.int32())])


def _day(y: str, m: str, d: str) -> str:
    return f"{y}-{m}-{d.rjust(2, '0')}{SUFFIX}"


def _side(found: re.Match, groups: tuple[int, int, int], last: bool) -> str | None:
    y, m, d = (found[g] if g else None for g in groups)
    if m is None:
        return _day(y, "12", "31") if last else _day(y, "01", "01")
    if (month := _MONTH.get(m.lower())) is None:
        return None
    return _day(y, month, ("31" if last else "01") if d is None else d)


def _normal(y: str, m: str, d: str, method: str) -> tuple[str, str, str] | None:
    if int(m) == 0:
        return method, _day(y, "01", "01"), _day(y, "12", "31")
    month = m.rjust(2, "0")
    if 1 <= int(m) <= 12 and int(d) == 0:
        return method, _day(y, month, "01"), _day(y, month, "31")
    if 1 <= int(m) <= 12 and 1 <= int(d) <= 31:
        return method, _day(y, month, d), _day(y, month, d)
    return None


def _numeric(token: str) -> tuple[str, str, str] | None:
    if _Y.match(token):
        return "year", _day(token, "01", "01"), _day(token, "12", "31")
    if found := _YMD.match(token):
        return _normal(found[1], found[2], found[3], "num_ymd")
    if found := _DMY.match(token):
        return _normal(found[3], found[1], found[2], "num_mdy") or _normal(found[3], found[2], found[1], "num_dmy")
    return None


def _resolved(dates: list[tuple]) -> list[tuple]:
    """Of dates with one span the last, at the first's place; a date goes if a longer one, or an equally long later one, overlaps it (ends included)."""
    once: dict[tuple[int, int], tuple] = {}
    for x in dates:
        once[x[4:]] = x  # a dict keeps the first's place
    placed = sorted((x[4], x[5], p, x) for p, x in enumerate(once.values()))
    gone = set()
    for i, (s, e, p, _) in enumerate(placed):
        for j in range(i + 1, len(placed)):
            t, u, q, _ = placed[j]
            if t > e:
                break
            gone.add(i if (u - t, q) > (e - s, p) else j)
    return [x for i, (*_, x) in enumerate(placed) if i not in gone]


def scan(text: str | None) -> list[tuple] | None:
    """``(text, method, begin, end, s, e)`` of a text's dates, by place."""
    if text is None:
        return None
    if not _YEAR.search(text):
        return []
    out = []
    for name, (pattern, first, last) in _PATTERNS.items():
        if name in _NEEDS and _NEEDS[name] not in text:
            continue
        seen = set()
        for found in pattern.finditer(text):
            said = found[0]
            if said in seen:
                continue
            seen.add(said)
            begin, end = _side(found, first, False), _side(found, last, True)
            if begin and end:
                s = text.find(said)
                out.append((said, name, begin, end, s, s + len(said)))
    seen = set()
    for token in text.split(" "):
        if not any("0" <= c <= "9" for c in token):
            continue
        for mark in ".;()[],":
            token = token.strip(mark)
        if token not in seen:
            seen.add(token)
            if span := _numeric(token):
                s = text.find(token)
                out.append((token, *span, s, s + len(token)))
    return _resolved(out) if len(out) > 1 else out


def scan_texts(texts: pa.Array) -> pa.Array:
    names = [f.name for f in ROW]
    found = [scan(t) for t in texts.to_pylist()]
    return pa.array([None if x is None else [dict(zip(names, row)) for row in x] for x in found], pa.list_(ROW))
