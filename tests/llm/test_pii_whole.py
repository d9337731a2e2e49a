"""Personal data that used to stay in clear text."""

import datetime

import pytest

from chronoweave.llm import pii


@pytest.mark.parametrize("value", ["03/25/1985", "12-31-1999", "02.29.2000", "01/13/1900", "12/31/2099"])
def test_dates_with_the_month_first(value):
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", inverse=True)
    a, spans = pii.replace_values(f"born {value}, {value}; y", there)
    assert len(spans) == 2 and value not in a
    m, d, y = (int(x) for x in (spans[0]["pseudonym"][:2], spans[0]["pseudonym"][3:5], spans[0]["pseudonym"][6:]))
    assert d > 12 and datetime.date(y, m, d)
    assert pii.replace_values(a, back)[0] == f"born {value}, {value}; y"


def test_dates_share_no_pseudonym():
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", inverse=True)
    days = [datetime.date(1999, 1, 1) + datetime.timedelta(i) for i in range(0, 1500)]
    texts = {f"{d:%d/%m/%Y}" for d in days} | {f"{d:%m/%d/%Y}" for d in days if d.day > 12}
    new = {t: there.date(t) for t in texts}
    assert None not in new.values() and len(set(new.values())) == len(texts)
    assert all(back.date(x) == t for t, x in new.items())
    assert [there.date(t) for t in ("02/30/1999", "13/13/1999", "00/25/1999", "31/02/2003")] == [None] * 4


IBANS = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"]
CARDS = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "3782 822463 10005"]


@pytest.mark.parametrize("value, after", [(v, a) for v in IBANS for a in (" I paid", " BIC ABCDEFGH", " 12 EUR", " 2024", "", ".")] + [(v, a) for v in CARDS for a in (" 123", " 7", " 12 27", " 12345", "", " EUR")])
def test_numbers_before_other_tokens(value, after):
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", inverse=True)
    a, spans = pii.replace_values(f"to {value}{after}", there)
    assert [(s["kind"], s["start"], s["end"]) for s in spans] == [("iban" if value in IBANS else "card", 3, 3 + len(value))]
    new = spans[0]["pseudonym"]
    assert new != value and a == f"to {new}{after}"
    assert back.of(spans[0]["kind"], new) == value


def test_longest_valid_number_and_the_rest():
    own = pii.Pseudonyms(b"key")
    long = "4111 1111 1111 1111 " + next(f"{x:03d}" for x in range(1000) if pii.luhn_ok(f"4111111111111111{x:03d}"))
    assert [s["end"] for s in pii.replace_values(long, own)[1]] == [len(long)]
    for text in ("4111 1111 1111 1112 123", "DE89370400440532013001 I paid", "4111111111111111123", "DE893704004405320130001 I"):
        assert pii.replace_values(text, own)[0] == text


def _there_and_back(text):
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", inverse=True)
    new, spans = pii.replace_values(text, there)
    assert pii.replace_values(new, back)[0] == text
    return new, spans


@pytest.mark.parametrize("text", ["\uff10\uff100-12-3456", "\uff1900-11-1111", "123-\uff10\uff10-4567", "\uff14111 1111 1111 1111", "\uff11.2.3.4", "2003-05-1\uff17"])
def test_digits_of_other_scripts_stay(text):
    assert pii.replace_values(f"a {text} b", pii.Pseudonyms(b"key")) == (f"a {text} b", [])


@pytest.mark.parametrize("value", ["TR330006100519786457841326", "MT84MALT011000012345MTLCAST001S", "SA0380000000608010167519", "BR1800360305000010009795493C1"])
def test_ibans_of_the_whole_registry(value):
    assert pii.iban_ok(value)
    new, spans = _there_and_back(f"pay {value}.")
    assert [s["kind"] for s in spans] == ["iban"] and value not in new


@pytest.mark.parametrize("digits", [32, 33, 64, 128, 129, 130, 1001, 200_000])
@pytest.mark.parametrize("upper", [False, True])
def test_hex_secrets_of_any_length(digits, upper):
    value = ("0123456789abcdef5a7" * (digits // 19 + 1))[:digits]
    value = value.upper() if upper else value
    new, spans = _there_and_back(f"key={value};")
    assert [s["kind"] for s in spans] == ["secret"] and value not in new and len(new) == digits + 5
    assert spans[0]["pseudonym"].isupper() == upper
