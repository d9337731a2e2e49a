"""The training-data operators against brute force, round trips and held-out accuracy, with nasty tables."""

import collections
import hashlib
import json
import pickle
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.llm import components, decontam, langid, mixing, ngram_join, pii, queries, sharding, tiff, tokenpack, toxicity, warc

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, score double"


def nasty():
    """Nulls everywhere, empty and long texts, ties, repeated rows, copies, near copies, clashing columns."""
    random.seed(5)
    words = [f"w{i}" for i in range(4000)]
    base = [random.choice(words) for _ in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    far = [random.choice(words) for _ in range(400)]
    texts = [None, "", " \t\n", "one", "One  two", "one two three four five", " ".join(base), "\n".join(near).upper(), " ".join(base), " ".join(far), " ".join(base[:200] + far[200:]), " ".join(random.choices(words, k=150_000)), "été ça coûte 12 €", "😀 smile", "one two three four five six"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, i, "k", 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[1], (None, " ".join(base), "en", "s1", 3, 1, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(nasty(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def sets_of(text, k=4):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_components(rows, percent=85, k=4):
    own = [(i, sets_of(t, k)) for i, t in rows if i is not None]
    up = {i: i for i, _ in own}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            (i, s), (j, r) = own[a], own[b]
            if s and r and 100 * len(s & r) >= percent * len(s | r):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


@pytest.mark.parametrize("which", ["docs", "real"])
def test_ngram_join(which, docs, real):
    df = docs if which == "docs" else real
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = ngram_join.similarity_components(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == collections.Counter((i, len(sets_of(t))) for i, t in rows)
    kept = [r["doc_id"] for r in ngram_join.one_of_each_group(df).collect()]
    assert set(x for x in kept if x is not None) == set(want.values())


def test_trie_finds_all_links():
    random.seed(3)
    for _ in range(60):
        base = random.sample(range(1000), 60)
        sets = []
        for _ in range(random.randint(1, 25)):
            s = set(base[: random.randint(1, 60)]) ^ set(random.sample(range(1000), random.randint(0, 8)))
            sets.append(np.array(sorted(s or {1}), np.uint64))
        percent = random.choice([50, 80, 85, 100])
        got = set(ngram_join.trie_links(sets, sets, percent))
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))}
        assert got == want


def test_components(spark):
    random.seed(4)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["v"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


def test_sketch_pieces(monkeypatch):
    text = " ".join(random.choices("abcdefgh", k=500))
    whole = ngram_join.shingle_sets([text, "a", None, "a b c d"])
    for size in (1, 2, 3, 5, 37, 400):
        monkeypatch.setattr(ngram_join, "PIECE_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, ngram_join.shingle_sets([text, "a", None, "a b c d"])))
        for t in ("a", " a", "a ", "a b", "ab  cd\n", "  ", "", "a b c d e", "word " * 40, "\ta\x0bB c\x0cD"):
            assert np.array_equal(ngram_join.shingle_sets([t])[0], ngram_join.shingle_sets([t], size=1 << 20)[0]), (t, size)
    assert [len(s) for s in whole] == [len(sets_of(text)), 1, 0, 1]


def test_large_groups_meet_leaders(spark, monkeypatch):
    """Near copies, chains of them and unlike texts that share rare words, in groups of many blocks, against brute force."""
    rng = random.Random(8)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "GRID_SETS", 3)
    monkeypatch.setattr(ngram_join, "BUCKET_TOKENS", 300)
    rows = []
    for group in range(5):
        base = [f"g{group}w{i}" for i in range(80)]
        for _ in range(25):
            words = base.copy()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                words[rng.randrange(80)] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(words)))
        for step in range(12):  # a chain: each is near the next one
            rows.append((len(rows), " ".join(base[step * 2 :] + [f"c{group}n{i}" for i in range(step * 2)])))
    common = [f"rare{i}" for i in range(12)]
    rows += [(len(rows) + i, " ".join([f"u{i}n{j}" for j in range(60)] + common)) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = brute_components(rows)
    assert got == want and 20 < len(set(want.values())) < 120


def test_repeated_ids(spark):
    """A doc_id of two texts joins both their groups; the stage keeps texts, not ids."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a, 1), (5, b, 2), (3, a + " z", 3), (4, b, 4), (9, c, 5), (9, a, 6), (9, c, 5), (9, c, 7), (5, None, 8), (None, a, 9), (None, a, 9), (7, "", 1), (7, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, join_hash int").repartition(4)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(df).collect())
    assert got == collections.Counter([(5, 27, 3), (5, 27, 3), (3, 28, 3), (4, 27, 3), (9, 27, 3), (9, 27, 3), (9, 27, 3), (9, 27, 3), (5, 0, 3), (None, 27, None), (None, 27, None), (7, 0, 7), (7, 0, 7)])
    kept = ngram_join.one_of_each_group(df)
    assert kept.columns == df.columns
    rows_kept = collections.Counter(tuple(r) for r in kept.collect())
    assert {(i, t) for i, t, _ in rows_kept} == {(3, a + " z"), (4, b), (9, c), (5, None), (None, a), (7, "")}
    assert sum(rows_kept.values()) == 8 and rows_kept[None, a, 9] == rows_kept[7, "", 1] == 2


def test_language_id(spark, docs, empty, real):
    model = langid.fit(real.where(~langid.held_out()))
    got = langid.predict(real.where(langid.held_out()), model)
    assert got.where("lang = lang_pred").count() / got.count() > 0.95
    edge = langid.predict(docs, model)
    assert edge.count() == docs.count()
    assert {r["lang_pred"] for r in edge.where("text is null or text in ('', ' \t\n')").collect()} == {"und"}
    assert edge.where("not (score between 0 and 1 and coverage between 0 and 1)").count() == 0
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    one = langid.fit(docs)
    assert langid.predict(docs.where("text = 'one'"), one).first()["lang_pred"] == "en"


def test_long_texts_are_hashed_piece_by_piece():
    texts = ["Été, ça va?  " * 50 + "!!", None, "x" * 500, " . " * 90, "short one", "a b " * 100 + "\n"]
    whole, owner, lettered = langid.gram_hashes(texts)
    for piece in (7, 40, 100_000):
        parts = list(langid.hashes_by_piece(texts, langid.GRAM, piece))
        assert collections.Counter((int(i), int(h)) for hs, os, _ in parts for h, i in zip(hs, os)) == collections.Counter(zip(owner.tolist(), whole.tolist()))
        assert np.logical_or.reduce([p[2] for p in parts]).tolist() == lettered.tolist() == [True, False, True, False, True, True]


def test_known_languages_keep_all_columns(spark, real):
    model = langid.fit(real)
    docs = spark.createDataFrame([(1, None, 1.0, "x"), (2, "12 -", 2.0, "y"), (3, real.where("lang = 'en' and length(text) > 500").first()["text"], 3.0, "z"), (None, "qzx " * 30, None, None)], "doc_id long, text string, score double, lang_pred string")
    kept = langid.known(docs, model, 0.2)
    assert kept.schema == docs.schema and [(r["doc_id"], r["score"], r["lang_pred"]) for r in kept.collect()] == [(3, 3.0, "z")]
    assert langid.known(docs.limit(0), model, 0.2).count() == 0


def brute_language(model_of, texts):
    """Counts by exact sets: the share of a text's n-grams that each language claims."""
    out = []
    for t in texts:
        h, _, lettered = langid.gram_hashes([t])
        counts = {x: sum(int(g) in own for g in h) for x, own in model_of.items()}
        best = max(counts, key=counts.get)
        out.append(best if lettered[0] else langid.UND)
    return out


def test_language_id_equals_exact_sets(real):
    """The filters' corrected counts choose the language that exact sets of the same n-grams choose, but for close calls."""
    import pandas as pd

    rows = real.select("doc_id", "text", "lang").where("text is not null and lang is not null").toPandas()
    grams, owners = {}, {}
    for lang, part in rows.groupby("lang"):
        h, _, _ = langid.gram_hashes(part["text"].tolist())
        g, n = np.unique(h, return_counts=True)
        grams[lang] = pd.Series(n / n.sum(), index=g)
    share = pd.DataFrame(grams).fillna(0)
    share = share[(share >= 1e-5).any(axis=1)]
    owners = {x: ((share[x] >= 1e-5) & (share[x] >= 0.25 * share.max(axis=1))).to_numpy() for x in share}
    names = list(owners)
    model = langid.build_model(names, share.index.to_numpy().astype(np.uint64), [owners[x] for x in names])
    sets = {x: set(map(int, share.index[owners[x]])) for x in names}
    texts = [*rows["text"].tolist()[:120], None, "", "7 - 8", "x"]
    langs, score, _ = model.predict(texts)
    want = brute_language(sets, texts)
    assert all(a == b or s < 0.55 for a, b, s in zip(langs, want, score))
    assert sum(a == b for a, b in zip(langs, want)) >= len(texts) - 2


def test_language_filters_equal_sets():
    """The corrected counts are close to those of exact sets, with more languages than a plane has bits."""
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    owners = [rng.random(5000) < 0.2 for _ in range(70)]
    model = langid.build_model([f"l{i}" for i in range(70)], grams, owners)
    masks = model.masks(grams)
    for j in (0, 5, 69):
        has = (masks[j // 64] >> np.uint64(j % 64)).astype(np.uint64) & np.uint64(1)
        assert has[owners[j]].all()
        assert has[~owners[j]].mean() < 0.02


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(scheme, predictor, tile, order):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 9, (37, 64), dtype=np.uint8), rng.integers(0, 60000, (5, 33, 3), dtype=np.uint16), np.zeros((300, 64), np.uint8)]
    for planar in (False, True):
        for fill in (1, 2):
            got = list(tiff.read_tiff(tiff.write_tiff(pages, scheme, predictor, 700, tile, order, planar, fill)))
            assert [p.number for p in got] == [0, 1, 2]
            for p, want in zip(got, pages):
                assert np.array_equal(p.data.reshape(want.shape), want)


def test_lzw_and_packbits_long():
    data = bytes(random.choices(range(256), k=9000)) + b"a" * 5000 + bytes(range(256)) * 20
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.packbits_encode(b"") == b""


def test_tiff_faults():
    whole = tiff.write_tiff([np.arange(640, dtype=np.uint8).reshape(10, 64)] * 2, tiff.LZW)
    for i in range(len(whole)):
        with pytest.raises(ValueError):
            list(tiff.read_tiff(whole[:i]))
    damaged = bytearray(tiff.write_tiff([np.zeros((9, 64), np.uint8)], tiff.DEFLATE))
    damaged[9] ^= 255
    with pytest.raises(ValueError, match="damaged|cut off"):
        list(tiff.read_tiff(bytes(damaged)))
    with pytest.raises(ValueError, match="predictor 3"):
        list(tiff.read_tiff(tiff.write_tiff([np.zeros((9, 64), np.uint8)], tiff.DEFLATE, 3)))
    with pytest.raises(ValueError, match="not a TIFF"):
        list(tiff.read_tiff(b"GIF89a--"))
    bomb = tiff.write_tiff([np.zeros((4096, 4096), np.uint8)], tiff.DEFLATE, strip_bytes=1 << 30)
    assert len(tiff.expand(bomb[8 : 8 + 20_000], tiff.DEFLATE, 100)) == 100


def test_tiff_media(spark, docs, empty):
    media = tiff.encode_texts(docs)
    got = tiff.tiff_pages(media).collect()
    want = collections.Counter((r["doc_id"], tiff.payload(r["text"])) for r in docs.collect())
    assert collections.Counter((r["doc_id"], bytes(r["data"])) for r in got if r["height"] < tiff.PAGE_ROWS and not r["page"]) == collections.Counter({k: n for k, n in want.items() if len(k[1]) < tiff.ROW * tiff.PAGE_ROWS})
    assert len(got) == sum(-(-len(x) // (tiff.ROW * tiff.PAGE_ROWS)) * n for (_, x), n in want.items()) > docs.count()
    folded = tiff.payload_digests(tiff.tiff_pages(media)).collect()
    assert collections.Counter((r["doc_id"], r["payload_sha256"], r["payload_bytes"], r["tail_crc32"]) for r in folded) == collections.Counter({(i, hashlib.sha256(x).hexdigest(), len(x), zlib.crc32(x[-64:])): n for (i, x), n in want.items()})
    assert tiff.payload_digests(tiff.tiff_pages(tiff.encode_texts(empty))).count() == 0
    clash = spark.createDataFrame([(7, bytearray(tiff.write_tiff([np.ones((2, 64), np.uint8)] * 2)), "x"), (8, bytearray(b"II*"), "y"), (9, None, "z")], "page int, media binary, feature string")
    assert [(r["page"], r["height"], r["fault"]) for r in tiff.tiff_pages(clash, strict=False).collect()] == [(0, 2, None), (1, 2, None), (None, None, "not a TIFF")]
    assert tiff.tiff_pages(clash.where("page = 7")).count() == 2


def test_tiff_layouts_have_their_share():
    """Codec, predictor, layout and byte order do not depend on a payload's size."""
    for size in (64, 640, 64_000):
        told = [tuple(tiff.layout_for(bytes([i % 256]) * size + bytes([i // 256]) * 64).values()) for i in range(3000)]
        assert len(set(told)) == 24
        for k in range(4):
            shares = collections.Counter(t[k] for t in told)
            assert min(shares.values()) > 3000 / len(shares) * 0.85


def brute_captures(pages):
    """Rows of op3 by their contract; a null page_id comes before all others."""
    raw = [(i, (h or "").encode()) for i, _, h in pages]
    last = {}
    for i, x in raw:
        if len(x) >= 1000 and i is not None:
            last[x] = max(last.get(x, i), i)
    rows = []
    for i, x in raw:
        visits = len(x) >= 1000 and last.get(x) is not None and last[x] != i
        rows.append((i, len(x), hashlib.sha1(x).hexdigest(), "revisit" if visits else "response", last[x] if visits else None))
    return collections.Counter(rows)


BIG = "<p>" + "é" * 700 + "\r\n\r\nWARC/1.1\r\n" + "x" * 400
PAGES = [
    (1, "http://a/", BIG), (5, None, BIG), (3, "http://b/\r\nX: y", BIG), (2, "u", None), (4, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", BIG), (8, "u", BIG + "y"), (8, "u", BIG + "y"), (9, "u", ""),
    (5, "u", BIG + "other"), (9, "u", BIG + "z"), (9, "u", BIG + "z"), (9, "v", BIG + "z"), (2, "u", BIG + "z"), (None, "u", None), (None, None, BIG + "n"), (11, "u", BIG * 200), (10, "u", BIG * 200),
]


def test_warc(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(*p, "extra", "x", 1, "y") for p in PAGES], "page_id long, url string, html string, payload string, sha1 string, row int, refers_to string")
    path = str(tmp_path / "warc")
    got = warc.archived_pages(df, path)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_captures(PAGES)
    records = warc.read_archives(spark, path).collect()
    assert len(records) == 3 * len(PAGES) == len({r["record_id"] for r in records})
    assert {r["record_type"] for r in records} == {"request", "response", "revisit", "metadata"}
    assert {r["refers_to_id"] for r in records if r["record_type"] == "revisit"} <= {r["record_id"] for r in records if r["record_type"] == "response"}
    nested = warc.assemble_captures(warc.read_archives(spark, path)).collect()
    assert len(nested) == len(PAGES) and all(len(r["responses"]) == len(r["requests"]) == len(r["metadata"]) == 1 for r in nested)
    assert warc.archived_pages(df.limit(0)).count() == 0
    texts = [(None if p[0] is None else f" Seite {p[0]}\r\né%", *p[1:]) for p in PAGES]
    named = warc.archived_pages(spark.createDataFrame(texts, "page_id string, url string, html string"))
    assert collections.Counter(tuple(r) for r in named.collect()) == brute_captures(texts)
    small = ((100, 2), (2000, 1), (None, 1))
    warc.write_pages(df, str(tmp_path / "classes"), classes=small)
    assert len({r["record_id"] for r in warc.read_archives(spark, str(tmp_path / "classes")).collect()}) == 3 * len(PAGES)
    cut = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_archive(cut))
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\na\r\nb\r\n\r\n"
    members = b"".join(gzip.compress(record) for _ in range(5000))  # one gzip member a record
    assert [b for _, b in warc.parse_archive(members)] == [b"a\r\nb"] * 5000
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_archive(members[:-9]))


def test_jump_hash():
    """Against the published loop, one key at a time."""

    def jump(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * sharding.JUMP_MULTIPLIER + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.array([random.getrandbits(64) for _ in range(3000)], np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_shards(docs, empty):
    got = sharding.shard_rows(docs, buckets=3).collect()
    assert len(got) == docs.count()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_rows(empty).count() == 0


def test_packing():
    rng = np.random.default_rng(2)
    for width in (1, 3, 7, 8, 11, 16, 17, 23, 31, 32):
        ids = rng.integers(0, 1 << width, 1000, dtype=np.uint64).astype(np.uint32)
        packed = tokenpack.pack(ids, width)
        assert len(packed) == -(-1000 * width // 8)
        for a, n in ((0, 1000), (1, 5), (999, 1), (333, 400), (10, 0)):
            assert np.array_equal(tokenpack.unpack(packed, width, a, n), ids[a : a + n])
    assert [tokenpack.bits_for(v) for v in (1, 2, 256, 257, 49408)] == [1, 1, 8, 9, 16]


def test_token_pack(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = tokenpack.packed_documents(docs, path).orderBy("start").collect()
    rows = [(r["doc_id"], [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == collections.Counter((i, len(x), crc(x)) for i, x in rows)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert tokenpack.packed_documents(empty, path).count() == 0


def test_encoder_equals_whole_text():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    e = tokenpack.Encoder(path)
    texts = ["It's  they'RE here now\x1cx\x0bv", "é ́x ΑΣ ΟΔΟΣ, ΟΔΟΣ.", "a<|endoftext|>b <|startoftext|>", "x\r\n\ty", "", None, "12345 $%^ ''s", "日本語 テスト 😀😀"]
    for t, got in zip(texts, e.encode(texts)):
        assert got.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(spark, tmp_path):
    """Ids across blanks, and a tokenizer whose declared parts differ from the word-wise one's: ids of whole texts."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    texts = ["It's  here now\x0bv", "a b\n\n c", "", None, "été 12  3"]
    e = tokenpack.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.word_wise
    for t, got in zip(texts, e.encode(texts)):
        assert got.tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids
    declared = json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())
    assert tokenpack.is_word_wise(declared)
    declared["normalizer"]["normalizers"].pop()  # upper case differs now
    (tmp_path / "own.json").write_text(json.dumps(declared))
    e = tokenpack.Encoder(str(tmp_path / "own.json"))
    assert not e.word_wise and [x.tolist() for x in e.encode(["Ab aB"])] == [e.tokenizer.encode("Ab aB", add_special_tokens=False).ids]
    got = tokenpack.packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), str(tmp_path / "own.json")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: 1 + len(e.tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_toxic_terms_of_inflected_words():
    rng = np.random.default_rng(5)
    endings, common = ["e", "en", "ung", "lich", "er", "ait"], [f"w{i}" for i in range(300)]
    make = lambda *more: " ".join([*rng.choice(common, 40), *more])
    toxic = [make("vequ" + endings[i % 6], "brute") for i in range(40)]
    twice = [make("maron", "maron") for _ in range(40)]
    clean = [make("maron") if i % 4 == 0 else make() for i in range(600)]
    copied = [make("rareword")] * 30
    texts = [*toxic, *twice, *copied, *clean, None, ""]
    labels = np.array([1] * 110 + [0] * 602)
    found = dict(toxicity.mine_terms(texts, labels))
    assert found == {"vequ*": 1, "brute": 1, "maron": 2}  # thirty copies of one text are one text
    model = toxicity.learn(texts, labels)
    assert (model.score([make("vequons"), make("maron", "maron")]) >= toxicity.THRESHOLD).all()
    assert (model.score([make("maron"), make(), "", None]) < toxicity.THRESHOLD).all()
    assert toxicity.mine_terms(texts[:5], labels[:5]) == [] == toxicity.mine_terms([], labels[:0])
    counts = toxicity.Voters(["vequ*", "vequin", "éo*"], [1, 1, 2]).counts(["Vequin, vequ vequon; VEQ", "éon éo Éa", None])
    assert counts[:, :3].tolist() == [[3, 1, 0], [0, 0, 2], [0, 0, 0]]


def test_toxicity(spark, real, docs, empty):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    train = ~toxicity.held_out()
    model = toxicity.fit(real.where(train), labels.where(train))
    words = [(1, "you are an idiot and a worthless scum"), (2, "the weather is fine"), (3, None), (4, "")]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(words, "doc_id long, text string"), model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == got[3]["predicted"] == got[4]["predicted"] == 0
    assert toxicity.score(docs, model).count() == docs.count()
    assert toxicity.score(empty, model).count() == 0
    bare = toxicity.fit(empty, labels.limit(0))
    assert toxicity.score(docs, bare).where("not score between 0 and 1").count() == 0


def test_label_model_recovers_voters():
    """Planted accuracies and a pair of correlated voters."""
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    fire = np.where(y[:, None], [0.6, 0.5, 0.4, 0.3], [0.02, 0.05, 0.03, 0.25])
    votes = rng.random((6000, 4)) < fire
    votes = np.c_[votes, np.where(rng.random(6000) < 0.95, votes[:, 0], ~votes[:, 0] & (rng.random(6000) < 0.1))]
    labels = np.where(rng.random(6000) < 0.05, y.astype(int), -1)
    model = toxicity.LabelModel().fit(votes, labels)
    assert model.parent[4] == 0 or model.parent[0] == 4
    assert abs(model.prior - 0.2) < 0.08
    p = model.posterior(votes)
    assert ((p > 0.5) == y).mean() > 0.88


def brute_hits(text, items, window=13):
    import re

    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = cut(text), set(), set()
    for name, item in items:
        v = cut(item)
        n = min(window, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(name)
    return len(w), len(hit), sorted(found)


def test_automaton_equals_brute_force():
    random.seed(6)
    for case in range(120):
        window = random.choice([2, 3, 5])
        say = lambda n: " ".join(random.choices("abcd" if case % 2 else "abcdefghijk", k=n))
        items = [(str(i), say(random.randint(0, 12))) for i in range(6)]
        automaton = decontam.Automaton(items, window, part_bytes=random.choice([1, 60, 100, 1 << 20]))
        automaton = pickle.loads(pickle.dumps(automaton))
        for _ in range(6):
            text = say(random.randint(0, 40)) + random.choice(["", " " + items[0][1] + " zz " + items[1][1].upper() + ", " + items[2][1]])
            n, spans, found = automaton.scan(text)
            assert (n, sum(b - a for a, b in spans), sorted(found)) == brute_hits(text, items, window), (items, text, window)
            assert all(a[1] < b[0] or a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "w1 w2 W3"), (1, "one two three four five"), (None, "smile"), (4, None), (5, " .,")], "item_id long, text string")
    rows = [(str(r["item_id"] or ""), r["text"]) for r in items.collect()]
    got = decontam.find_contamination(docs, items).collect()
    assert len(got) == docs.count()
    want = collections.Counter((r["doc_id"], *map(str, brute_hits(r["text"], rows))) for r in docs.collect())
    assert collections.Counter((r["doc_id"], str(r["n_words"]), str(r["n_hit"]), str(r["items"])) for r in got) == want
    assert decontam.find_contamination(empty, items).count() == 0
    assert decontam.find_contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.remove_spans(docs.where("doc_id = 14"), items).first()["text"] == "six"
    ends = docs.sparkSession.createDataFrame([(1, "  a one two three four five b  c "), (2, "w1 w2 w3 x w1, w2 w3"), (3, "  keep  ")], "doc_id long, text string")
    assert [r["text"] for r in decontam.remove_spans(ends, items).orderBy("doc_id").collect()] == ["  a b  c ", "x", "  keep  "]
    stays = decontam.without_contaminated(docs, items)
    assert stays.columns == docs.columns and stays.where("doc_id in (5, 13, 14)").count() == 0 and stays.where("doc_id = 3").count() == 1
    for bounds in ({"item_bytes": 30}, {"built_bytes": 1500}):
        assert 1 < len(list(decontam.automata(items, **bounds))) < 6
        many = decontam.find_contamination(docs, items, **bounds).collect()
        assert sorted(map(str, many)) == sorted(map(str, got)), bounds
    assert [r["text"] for r in decontam.remove_spans(ends, items, item_bytes=30).orderBy("doc_id").collect()] == ["  a b  c ", "x", "  keep  "]
    clash = docs.withColumn("found_so_far", F.lit("x"))
    assert sorted(map(str, decontam.without_contaminated(clash, items, item_bytes=30).collect())) == sorted(map(str, decontam.without_contaminated(clash, items).collect()))
    assert decontam.without_contaminated(clash, items, item_bytes=30).columns == clash.columns


def test_items_in_pieces_of_any_size_equal_brute_force(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choices("abc", k=n))
    items = [(str(i % 7), say(rng.randint(0, 40))) for i in range(12)]
    docs = [(i, say(rng.randint(0, 60))) for i in range(40)] + [(40, None), (41, ""), (1, "a b c")]
    held = spark.createDataFrame(items, "item_id string, text string")
    assert 1 < len(list(decontam.automata(held, 5, item_bytes=200, piece_bytes=20))) < 9
    got = decontam.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), held, 5, item_bytes=200, piece_bytes=20).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted((d, *brute_hits(t, items, 5)) for d, t in docs)


def test_automaton_is_small():
    """Twenty bytes for a byte of the items, at most, where dictionaries take 150."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=200))) for i in range(300)]
    automaton = decontam.Automaton(items)
    size = sum(len(t) for _, t in items)
    assert automaton.bytes() < 20 * size
    assert len(pickle.dumps(automaton)) < 20 * size


def compare(sql, found, **tables):
    c = duckdb.connect()
    for k, v in tables.items():
        c.register(k, v.toArrow())
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, cursor.fetchall())) == sorted(key(tuple(r)) for r in found.select(names).collect())


def test_mixing(docs, empty, real):
    for df in (docs.where("doc_id is not null").dropDuplicates(["doc_id"]), real):
        compare(mixing.OP9_SQL, mixing.mix_to_targets(df, buckets=37), documents=df.select("doc_id", "text", "source"))
    again = [sorted(map(str, mixing.mix_to_targets(docs, buckets=4).collect())) for _ in range(2)]
    assert again[0] == again[1] and len(again[0]) == docs.count()
    mixed = mixing.mix_to_targets(docs)
    assert mixed.where("taken > 2 * size or taken < 0").count() == 0
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert r["t"] == int(r["g"])
    assert mixing.mix_to_targets(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_are_rows(spark, docs):
    """Each row, told from others by all its columns, is copied as the mix takes it; clashing names stay."""
    names = "doc_id long, text string, source string, mix_row int, mix_copies int, copies int, size int, rows int, `a.b` int, props map<string, int>"
    rows = [(1, "a b c", "s", 1, 2, 3, 4, 5, 6, {"k": 1}), (1, "a b c", "t", 1, 2, 3, 4, 5, 6, {}), (1, "d e f g", "s", 7, 2, 3, 4, 5, 6, None), (None, "n n", "s", 7, 2, 3, 4, 5, 6, None), (None, "m m", "s", 7, 2, 3, 4, 5, 6, None), (2, None, "s", None, None, None, None, None, None, None), (3, "x", None, None, None, None, None, None, None, None)]
    rows += [(4, "same row here", "t", 0, 0, 0, 0, 0, 0, {"k": 2})] * 7
    df = spark.createDataFrame(rows, names).repartition(3)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixing.mixed_documents(df.limit(0)).count() == 0
    key = lambda r: str(tuple(r))
    got = collections.Counter(map(key, mixed.collect()))
    taken = mixing.mix_to_targets(df).collect()
    want = collections.Counter()
    for r in taken:
        want[r["doc_id"], r["source"], r["size"]] += -(-r["taken"] // r["size"]) if r["size"] else 0
    told = collections.Counter()
    for r in mixed.collect():
        told[r["doc_id"], r["source"], len(r["text"].split())] += 1
    assert told == +want
    assert set(got) <= {key(r) for r in df.collect()}
    assert got[key(df.where("doc_id = 4").first())] == want[4, "t", 3]


def test_warc_sql(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    compare(warc.OP3_SQL, warc.archived_pages(pages), pages=pages)


def test_feistel():
    for n in (1, 2, 10, 97, 1000):
        image = [pii.feistel(x, n, b"k", "t") for x in range(n)]
        assert sorted(image) == list(range(n))
        assert [pii.feistel(y, n, b"k", "t", inverse=True) for y in image] == list(range(n))
    assert [pii.feistel(x, 97, b"k", "t") for x in range(97)] != [pii.feistel(x, 97, b"other", "t") for x in range(97)]


VALUES = ["4539578763621486", "4539 5787 6362 1486", "DE89370400440532013000", "+1 (743) 555-3824", "10.20.30.40", "123-45-6789", "2003-05-17", "17/05/2003", "5 March 2003", "March 5, 2003", "ann.99@mail9.example.com", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]


@pytest.mark.parametrize("value", VALUES)
def test_pseudonyms_keep_format_and_link(value):
    there, back = pii.Pseudonyms(b"key"), pii.Pseudonyms(b"key", inverse=True)
    a, spans = pii.replace_values(f"x {value}, {value}; y", there)
    assert len(spans) == 2 and value not in a
    new = spans[0]["pseudonym"]
    assert a == f"x {new}, {new}; y"
    assert pii.replace_values(a, back)[0] == f"x {value}, {value}; y"


def test_pseudonyms_leave_the_rest():
    for text in ("4539578763621487", "300.1.2.3", "000-12-3456", "2003-13-45", "31/02/2003", "version 1.2.3", "order 12345", "DE00370400440532013000", "a@b", "deadbeef"):
        assert pii.replace_values(text, pii.Pseudonyms(b"key")) == (text, [])


def test_pii(docs, empty, spark):
    got = pii.pseudonymise(docs, b"key")
    assert got.count() == docs.count()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.where("n_values = 0").collect()) == collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert pii.pseudonymise(empty, b"key").count() == 0


def test_queries_are_registered():
    assert [k.split("_")[0] for k in queries.queries()] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]


def test_pipeline(spark, real):
    import corpus_pipeline

    language, _, clean, mix, shard = [f for _, f in corpus_pipeline.STAGES]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == [*real.columns, "shard"]
    rows = [(r["doc_id"], r["text"]) for r in language(spark, real, DATA).select("doc_id", "text").collect()]
    least = set(brute_components(rows, 80, 5).values())
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in rows if i in least and not ((h := brute_hits(t, items))[1] and 20 * h[1] >= h[0])]
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {i for i, _ in kept}
    stage4 = real.join(spark.createDataFrame([(i,) for i, _ in kept], "doc_id long"), "doc_id").select(*real.columns)
    want = collections.Counter({r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix_to_targets(stage4).collect() if r["taken"]})
    assert collections.Counter(r["doc_id"] for r in out.collect()) == want


def test_stages_keep_columns(spark, real, tmp_path):
    """Each stage on nulls, repeated ids, clashing names and nothing at all: its columns stay, and so do rows it has no reason to drop."""
    import corpus_pipeline

    rows = [tuple(r) for r in real.where("lang = 'en'").select("doc_id", "text", "lang", "source", "n_chars").limit(30).collect()]
    rows = [*rows, rows[0], (rows[0][0], rows[1][1], None, None, None), (None, rows[2][1], "en", "web", 1), (7_000_001, None, None, None, None), (7_000_002, "", "en", None, 0)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, coverage double, shard int, mix_copy int, mix_copies int, text_hash long"
    docs = spark.createDataFrame([(*r, 0.5, "x", 0.1, 3, 1, 2, 9) for r in rows], names)
    spark.createDataFrame([(1, "no such words at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == (docs.columns if name != "sharding" else [*docs.columns, "shard_"]), name
        assert out.where("score <> 0.5 or shard <> 3 or mix_copy <> 1 or mix_copies <> 2 or lang_pred <> 'x' or text_hash <> 9").count() == 0
        kept[name] = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    told = collections.Counter(r[:2] for r in rows)
    assert kept["decontamination"] == kept["sharding"] == told
    assert kept["language_id"] == collections.Counter({k: n for k, n in told.items() if k[1]})
    assert (None, rows[2][1]) in kept["ngram_join"] and (7_000_001, None) in kept["ngram_join"] and max(kept["ngram_join"].values()) == 1
    assert all(k in told and k[1] for k in kept["mixing"])
