"""Spelling variants against all pairs of words, and counts of words against one text at a time."""

import collections
import itertools
import random
import re
import zlib

import pytest

from chronoweave.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        close = [v for v in counts if near(w, v)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [form, w, n, len(close), counts[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {(w, *v) for w, v in out.items()}


def brute_counts(docs):
    held = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            held[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word] += 1
    return {w: n for w, n in held.items() if len(w) >= 5 and n >= 3}


def found(spark, counts):
    df = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(counts)
    return set(rows)


def words(seed, n, alphabet, lengths):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rng.choices(alphabet, k=rng.choice(lengths)))
        out[w] = rng.choice([1, 2, 3, 3, 6, 12, 40])
        for _ in range(3):
            i, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
            out[rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])] = rng.choice([3, 5, 9, 30])
    return {w: k for w, k in out.items() if w}


@pytest.mark.parametrize("seed, alphabet, lengths", [(1, "ab", [3, 4, 5, 6]), (2, "abcé", [4, 5]), (3, "aÿb🙂", [2, 3, 9]), (4, "abcdefghij", [5, 6, 7])])
def test_all_pairs(spark, seed, alphabet, lengths):
    counts = words(seed, 150 if len(alphabet) > 2 else 40, alphabet, lengths)
    assert found(spark, counts) == brute(counts)


def test_runs_prefixes_and_chains(spark):
    counts = {"a" * k: 2**k for k in range(1, 12)} | {"baaaa": 5, "aaaab": 11, "aaba": 1000, "x": 1}
    assert found(spark, counts) == brute(counts)
    assert found(spark, {"alone": 3}) == {("alone", None, "alone", 3, 0, None)}


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, word string, n int")
    assert spelling.variants(spelling.word_counts(empty)).collect() == []
    assert spelling.word_counts(spark.createDataFrame([(1, None, "w", 1), (None, "", "w", 1), (2, "12 é, .", "w", 1)], "doc_id long, text string, word string, n int")).collect() == []


def test_counts_of_words(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeàÉ×", k=rng.randrange(3, 9))) for _ in range(60)] + ["Straße", "ŒUVRES", "naïveté"]
    docs = [(rng.choice([None, i, i, 7]), rng.choice([" ", "’", "1", "\n"]).join(rng.choice([w, w.upper()]) for w in rng.choices(vocabulary, k=40))) for i in range(120)]
    docs += [(500, " ".join(rng.choices(vocabulary, k=60_000))), (501, None), (502, "x" * 300_000)]
    df = spelling.word_counts(spark.createDataFrame([(*d, "w", 9) for d in docs], "doc_id long, text string, word string, n int"))
    rows = df.collect()
    assert {r["word"]: r["n"] for r in rows} == brute_counts(docs) and len(rows) == len({r["word"] for r in rows})


def test_light_words_are_few(spark):
    """A word lies in light subtrees at no more nodes than the logarithm of the number of words."""
    counts = words(9, 400, "abc", [6, 7, 8])
    held = spark.createDataFrame([(i, w) for i, w in enumerate(counts)], "id long, word string")
    places = spelling.trie_places(held)
    light = places.join(spelling.heavy_children(places), ["node", "i"]).where("c <> heavy").groupBy("id").count().agg({"count": "max"}).first()[0]
    assert 2**light <= len(counts)
    pairs = {(a, b) for a, b in itertools.permutations(range(len(counts)), 2) if near(list(counts)[a], list(counts)[b])}
    got = [tuple(r) for r in spelling.one_edit_pairs(held).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
