"""The registered queries, by name, over nasty tables and empty ones, against brute force in Python."""

import collections
import datetime
import hashlib
import json
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from chronoweave.llm import pii, queries, toxicity

from .test_llm import PAGES, brute_captures, brute_components, brute_hits, nasty, sets_of

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, shard int, score double, page int, payload string, fp string, taken long, key string, `size` int, copies int"
HELD = Path("/root/testdata/sf0.01")


def tables(spark, where, docs, labels, pages, items):
    rows = [(*r[:5], 7, 0.5, 3, "p", "f", 1, "k", 2, 3) for r in docs]
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(*p, "x", 4) for p in pages], "page_id long, url string, html string, payload string, row int").write.parquet(f"{where}/pages.parquet")
    spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string").write.parquet(f"{where}/benchmark.parquet")
    some = bool(docs)
    when = datetime.datetime(2024, 1, 1)
    clicks = [(1, when, None, 1, "view", 1.5, "{}", 1), (1, when, when, 1, "view", 2.5, "{}", 1), (2, None, when, None, None, None, None, 1), (3, when, when, 1, None, 0.005, "{}", 1), (None, when, when, 1, "view", float("nan"), "{}", 1)]
    spark.createDataFrame(clicks if some else [], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, n int").write.parquet(f"{where}/clicks.parquet")
    vectors = [(1, [1.0, 0.0], 1, 5), (2, [1.0, 0.1], 1, 5), (2, [0.0, 1.0], 1, 5), (None, [1.0, 0.0], 1, 5), (4, None, 1, 5), (5, [1.0, None], 1, 5), (6, [1.0, 0.0], None, 5)]
    spark.createDataFrame(vectors if some else [], "vec_id long, embedding array<float>, label int, c int").write.parquet(f"{where}/embeddings.parquet")
    return str(where)


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(3)
    say = lambda words, n, *more: " ".join([*rng.choices(words, k=n), *more])
    english, french = [f"the{i}ing" for i in range(60)], [f"qué{i}eux" for i in range(60)]
    docs = [(r[0], r[1], r[2], r[3], r[4]) for r in nasty()]
    docs += [(100 + i, say(english, 40, *(["vile", "you are an idiot"] if i % 5 == 0 else [])), "en", "web", 1) for i in range(60)]
    docs += [(200 + i, say(french, 40), "fr", None, 1) for i in range(40)]
    docs += [(5, "mail ann.b@example.org, card 4111 1111 1111 1111", "en", "web", 1)] * 3
    labels = [(100 + i, 1, int(i % 5 == 0), None) for i in range(60)] + [(None, 1, 1, None), (200, None, None, None), (101, 1, None, "x")]
    items = [(1, "w1 w2 W3"), (1, "one two three four five"), (None, "smile"), (4, None), (5, " .,"), (12, " ".join(docs[6][1].split()[20:60]))]
    return tables(spark, tmp_path_factory.mktemp("nasty") / "sf", docs, labels, PAGES, items), docs, labels, items


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("nothing") / "sf", [], [], [], [])


def run(spark, name, where):
    found = entry.queries()[next(k for k in entry.queries() if k.split("_")[0] == name)](spark, where)
    return found.columns, [r.asDict() for r in found.collect()]


def bag(rows, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


def raw(t):
    return (t or "").encode()


@pytest.mark.parametrize("name", [k.split("_")[0] for k in queries.queries()])
def test_empty_tables(spark, nothing, name):
    columns, rows = run(spark, name, nothing)
    assert rows == [] and len(columns) > 2


def test_op1(spark, data):
    columns, rows = run(spark, "op1", data[0])
    docs = data[1]
    assert columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert bag(rows, "doc_id") == collections.Counter((d[0],) for d in docs)
    texts = {d[0]: d[1] for d in docs if d[0] is not None}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] >= 100:
            assert r["lang_pred"] == ("en" if r["doc_id"] < 200 else "fr")
        elif r["doc_id"] is not None and r["doc_id"] != 5:
            assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[r["doc_id"]] or ""))


def test_op2(spark, data):
    columns, rows = run(spark, "op2", data[0])
    docs = data[1]
    assert columns[:8] == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    pad = lambda b: b + b"\0" * (-len(b) % 64 if b else 64)
    want = collections.Counter((d[0], len(raw(d[1])), len(p := pad(raw(d[1]))), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for d in docs)
    assert bag(rows, *columns[:5]) == want
    assert all(len(v) == 1 for v in _by(rows, "payload_sha256", "feature", "media_sha256", "media_bytes").values())
    media = {(r["media_sha256"], r["media_bytes"]) for r in queries.tiff.encode_texts(spark.createDataFrame(docs, "doc_id long, text string, l string, s string, n long")).toPandas()["media"].map(lambda m: {"media_sha256": hashlib.sha256(m).hexdigest(), "media_bytes": len(m)})}
    assert {(r["media_sha256"], r["media_bytes"]) for r in rows} == media


def _by(rows, key, *columns):
    out = collections.defaultdict(set)
    for r in rows:
        out[r[key]].add(tuple(r[c] for c in columns))
    return out


def test_op3(spark, data):
    columns, rows = run(spark, "op3", data[0])
    assert columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert bag(rows, *columns) == brute_captures(PAGES)


def test_op4(spark, data):
    columns, rows = run(spark, "op4", data[0])
    assert columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert bag(rows, "doc_id", "size", "text_crc32") == collections.Counter((d[0], len(raw(d[1])) + 1, zlib.crc32(raw(d[1]))) for d in data[1])
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(v) == 1 for v in _by(rows, "doc_id", "shard", "grown_shard").values())


def test_op5(spark, data):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    columns, rows = run(spark, "op5", data[0])
    assert columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    own = [(d[0], [*t.encode(d[1] or "", add_special_tokens=False).ids, 1]) for d in data[1]]
    assert bag(rows, "doc_id", "n_tokens", "ids_crc32") == collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in own)
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x or 0))


def test_op6(spark, data):
    columns, rows = run(spark, "op6", data[0])
    assert columns == ["doc_id", "n_shingles", "component_id"]
    want = brute_components([(d[0], d[1]) for d in data[1]])
    assert bag(rows, *columns) == collections.Counter((d[0], len(sets_of(d[1])), want.get(d[0])) for d in data[1])


def test_op7(spark, data):
    """Score and prediction of each row, and what is learned equals learning from the rows of the other fold on lists."""
    where, docs, labels, _ = data
    columns, rows = run(spark, "op7", where)
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    marks = {}
    for i, _, y, _ in labels:
        if i is not None and y is not None and not fold(i):
            marks[i] = max(y, marks.get(i, 0))
    train = [(d[1], marks.get(d[0], -1)) for d in docs if d[0] is not None and not fold(d[0])]
    model = toxicity.learn([t for t, _ in train], np.array([y for _, y in train]))
    want = model.score([d[1] for d in docs])
    assert bag(rows, "doc_id") == collections.Counter((d[0],) for d in docs)
    told = _by(rows, "doc_id", "score")
    for d, s in zip(docs, want):
        assert any(abs(s - x) < 0.01 for (x,) in told[d[0]])
    for r in rows:
        assert r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None and 100 <= r["doc_id"] < 160:
            assert r["predicted"] == int(r["doc_id"] % 5 == 0)


def test_op8(spark, data):
    columns, rows = run(spark, "op8", data[0])
    assert columns[:6] == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    items = [("" if i is None else str(i), t) for i, t in data[3]]
    want = collections.Counter()
    for d in data[1]:
        n, hit, found = brute_hits(d[1], items)
        want[d[0], n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n] += 1
    assert bag(rows, *columns[:6]) == want


def test_op9(spark, data):
    columns, rows = run(spark, "op9", data[0])
    assert columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert bag(rows, "doc_id", "size") == collections.Counter((d[0], size(d[1])) for d in data[1])
    total = collections.Counter()
    for d in data[1]:
        total[d[3]] += size(d[1])
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, left, share = {}, set(order), 1.5 * sum(total.values())
    while left:
        level = share / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level > 2 * total[s]}
        for s in full or left:
            want[s] = 2.0 * total[s] if full else weight[s] * level
        left -= full or left
        share -= sum(2 * total[s] for s in full)
    taken = collections.Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert taken == collections.Counter({(total[s], round(want[s], 6)): int(want[s] + 1e-9) for s in order})


def test_op10(spark, data):
    """Texts without values stay; the same value has one pseudonym everywhere, valid for its kind, and is restored by the key."""
    columns, rows = run(spark, "op10", data[0])
    assert columns[:4] == ["doc_id", "text", "n_values", "spans"]
    own, back = pii.Pseudonyms(queries.DEMO_KEY), pii.Pseudonyms(queries.DEMO_KEY, inverse=True)
    want = collections.Counter()
    for d in data[1]:
        new, spans = (None, []) if d[1] is None else pii.replace_values(d[1], own)
        want[d[0], new, len(spans), json.dumps(spans)] += 1
        if d[1] is not None:
            assert pii.replace_values(new, back)[0] == d[1]
    got = collections.Counter((r["doc_id"], r["text"], r["n_values"], json.dumps([{k: s[k] for k in ("kind", "start", "end", "pseudonym")} for s in r["spans"]])) for r in rows)
    assert got == want and sum(r["n_values"] for r in rows) >= 6
    mailed = [r for r in rows if r["n_values"] == 2]
    assert len(mailed) == 3 and len({r["text"] for r in mailed}) == 1
    card = re.search(r"card ([\d ]+)$", mailed[0]["text"])[1]
    assert card != "4111 1111 1111 1111" and pii.luhn_ok(card.replace(" ", ""))


def test_brute_pseudonyms():
    """Every kind over its whole domain or a long walk of it: no two values share a pseudonym, and formats hold."""
    own = pii.Pseudonyms(b"k")
    days = [f"{datetime.date(2000, 1, 1) + datetime.timedelta(i)}" for i in range(800)]
    assert len({own.date(d) for d in days}) == 800 and all(re.fullmatch(r"\d{4}-\d\d-\d\d", own.date(d)) for d in days)
    cards = [(f"4{i:011d}0") for i in range(500)]
    cards = [c + pii.luhn_digit(c) for c in cards]
    assert len({own.card(c) for c in cards}) == 500 and all(pii.luhn_ok(own.card(c)) for c in cards)
    assert len({own.ip(f"10.0.{i // 256}.{i % 256}") for i in range(1000)}) == 1000
    assert len({own.ssn(f"123-45-{i:04d}") for i in range(1, 900)}) == 899


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql(spark, data, name):
    """The SQL over the nasty tables and over the small ones; that of op12 takes ids for unique."""
    for where in ("/root/testdata/sf0.001", *([data[0]] if "op12" not in name else [])):
        c = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "clicks", "embeddings"):
            p = Path(f"{where}/{t}.parquet")
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        cursor = c.execute(queries.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        found = entry.queries()[name](spark, where)
        assert sorted(found.columns) == sorted(names)
        show = lambda r: tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r)
        assert sorted(map(show, cursor.fetchall())) == sorted(show(tuple(r)) for r in found.select(names).collect()), where


def test_op11(spark, data):
    columns, rows = run(spark, "op11", data[0])
    assert columns == ["click_id", "kind", "n", "median2", "mad4", "far"]
    assert bag(rows, *columns) == collections.Counter([(1, "view", 1, 300, 0, False), (3, None, 1, 2, 0, False), (None, "view", 1, 300, 0, None)])


def test_op12(spark, data):
    columns, rows = run(spark, "op12", data[0])
    assert bag(rows, *columns) == collections.Counter([(1, 2, 1, True), (2, 2, 1, False), (2, 0, 2, True), (None, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)])


def test_op13(spark, data):
    from .test_spelling import brute, brute_counts

    columns, rows = run(spark, "op13", data[0])
    assert columns == ["word", "form", "root", "n", "n_near", "form_n"]
    counts = brute_counts([(d[0], d[1]) for d in data[1]])
    assert bag(rows, *columns) == collections.Counter(brute(counts))
