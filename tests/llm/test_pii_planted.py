"""Pseudonyms of values that are planted in texts, found and checked by code of the test's own."""

import datetime
import random
import string

import pytest

from chronoweave.llm import pii

KEY = b"a key"


def card(r):
    body = [r.choice("3456")] + [r.choice(string.digits) for _ in range(r.randint(12, 17))]
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(body)))
    return "".join(body) + str((10 - total % 10) % 10)


def luhn(text):
    digits = [int(c) for c in reversed(text)]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def mod97(text):
    turned = text.upper()[4:] + text.upper()[:4]
    rest = 0
    for c in turned:
        for d in c if c.isdigit() else str(ord(c) - 55):
            rest = (rest * 10 + int(d)) % 97
    return rest


def iban(r):
    body = "".join(r.choice(string.digits) for _ in range(18))
    check = next(f"{x:02d}" for x in range(2, 99) if mod97(f"DE{x:02d}{body}") == 1)
    value = f"DE{check}{body}"
    return value.lower() if r.random() < 0.5 else value


def date(r):
    d = datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(73_000))
    s = r.choice("/.-")
    return r.choice([f"{d.day}{s}{d.month}{s}{d.year}", f"{d:%d}{s}{d:%m}{s}{d.year}", f"{d:%m}{s}{d:%d}{s}{d.year}", f"{d.month}{s}{d.day}{s}{d.year}", f"{d:%Y-%m-%d}"])


MAKERS = {
    "card": card, "iban": iban, "date": date, "ip": lambda r: ".".join(str(r.randrange(256)) for _ in range(4)),
    "email": lambda r: "".join(r.choice(string.ascii_letters + "09") for _ in range(r.choice([1, 7, 64, 65, 150, 3000]))) + "@mail.example.com",
    "ssn": lambda r: f"{r.randrange(1, 666):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}",
    "secret": lambda r: "a1" + "".join(r.choice("0123456789abcdef") for _ in range(r.choice([30, 38, 62]))),
}


def valid(kind, old, new):
    """The new value has the old one's length and characters' classes, and is a valid one of its kind."""
    kinds = lambda t: [("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else c) for c in t]
    if kind == "ip":
        return all(0 <= int(x) < 256 and x == str(int(x)) for x in new.split("."))
    if kind == "secret":
        return len(new) == len(old) and set(new) <= set("0123456789abcdef")
    if kinds(old) != kinds(new):
        return False
    if kind == "card":
        return luhn(new)
    if kind == "iban":
        return mod97(new) == 1 and new[:2] == old[:2]
    return kind != "date" or any(_reads(new, f) for f in ("%d{0}%m{0}%Y", "%m{0}%d{0}%Y", "%Y{0}%m{0}%d"))


def _reads(text, form):
    try:
        return bool(datetime.datetime.strptime(text, form.format(next(c for c in text if c in "/.-"))))
    except ValueError:
        return False


def test_planted_values_are_found_whole_and_stay_linked(spark):
    r = random.Random(5)
    pool = [(k, make(r)) for k, make in MAKERS.items() for _ in range(60)]
    docs, truth = [], {}
    for i in range(300):
        text, spans = "", []
        for kind, value in r.choices(pool, k=r.randrange(6)):
            text += " ".join(r.choice(["one", "été", "of", "two", "\U0001f600"]) for _ in range(r.randint(1, 4))) + " "
            spans.append((kind, len(text), len(text) + len(value), value))
            text += value + r.choice([" , ", "; ", " \n", " "]) + "and "
        docs.append((i, text))
        truth[i] = spans
    new_of = {}
    for row in pii.pseudonymise(spark.createDataFrame(docs, "doc_id long, text string"), KEY).collect():
        text = dict(docs)[row["doc_id"]]
        assert [(s["kind"], s["start"], s["end"]) for s in row["spans"]] == [t[:3] for t in truth[row["doc_id"]]], text
        out, last = "", 0
        for (kind, a, b, old), s in zip(truth[row["doc_id"]], row["spans"]):
            assert new_of.setdefault((kind, old), s["pseudonym"]) == s["pseudonym"] and valid(kind, old, s["pseudonym"]), (kind, old, s["pseudonym"])
            out, last = out + text[last:a] + s["pseudonym"], b
        assert row["text"] == out + text[last:] and row["n_values"] == len(row["spans"])
    assert len(new_of) > 200 and len({(k, v) for (k, _), v in new_of.items()}) == len(new_of)
    back = pii.Pseudonyms(KEY, inverse=True)
    assert all(back.of(kind, new) == old for (kind, old), new in new_of.items())


@pytest.mark.parametrize("form", ["{d}/{m}/{y}", "{d}.{m:02d}.{y}", "{d:02d}-{m}-{y}", "{m}/{d}/{y}"])
def test_short_dates_are_permuted_within_their_widths(form):
    own, back = pii.Pseudonyms(KEY), pii.Pseudonyms(KEY, inverse=True)
    days = [datetime.date(1999, 11, 1) + datetime.timedelta(i) for i in range(500)]
    texts = {form.format(d=x.day, m=x.month, y=x.year) for x in days}
    new = {t: own.date(t) for t in texts}
    assert None not in new.values() and len(set(new.values())) == len(texts)
    assert all(len(n) == len(t) and back.date(n) == t for t, n in new.items())
    assert own.date("0/1/2000") is own.date("31/2/2000") is own.date("5/0/2000") is None


def test_what_stays_in_clear():
    for text in ("on 5/6/1899 and 5/6/24", "De89370400440532013000", "2001:db8::1", "1.2.3", "5/6/20245", "15/6/2024/1"):
        assert pii.replace_values(text, pii.Pseudonyms(KEY)) == (text, [])


def test_stretches_without_digits_hold_no_values():
    """A search of the whole text finds the same as one around its digits and @ signs."""

    def everywhere(text, valid):
        at = 0
        while at < len(text):
            for kind in pii.KINDS:
                own = pii._each[kind](text, at)
                hit = own and next((x for x in pii._beginnings(kind, own[0]) if valid(kind, x) is not None), None)
                if hit:
                    yield at, at + len(hit), kind, valid(kind, hit)
                    at += len(hit) - 1
                    break
            at += 1

    r, own = random.Random(1), pii.Pseudonyms(KEY)
    bits = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", " ", "\n", "a@b.de", "I paid", "4111 1111 1111 1111", " 12 September 2001", "March 4, 1999", "A B C D", "1.2.3.4", "+1 (743) 555-3824", "word " * 20, "w" * 90, "Z" * 70, "a1" * 40, "\t", "5/6/2001"]
    for _ in range(1000):
        text = "".join(r.choice(bits) + r.choice(["", "\xa0", " "]) for _ in range(r.randrange(12)))
        assert list(pii.find_values(text, own.of)) == list(everywhere(text, own.of)), text
