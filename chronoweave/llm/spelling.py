"""Spelling variants: words one edit apart, by errata tries over a distributed trie.

The trie of all words is held as rows: a node is the hash of its prefix and its length. Each node's heavy child is
the one with most words below; all other children are light, so a word lies in a light subtree at no more nodes than
the logarithm of the number of words. The words of light subtrees alone are merged, small to large, with one
character skipped, with it replaced by the heavy child's, and with the heavy child's put before it; where such a
path comes to a terminal of the trie, or where two light words come to the same one with their characters
left open, the two words differ by one edit. The end of a word counts as a character of its own.

Two words part at one node, where at most one of them goes on in the heavy child, so every pair is met; pairs are then
compared by their letters, which leaves nothing to the hashes.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, materialize

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A document's run loses a code point if this divides its checksum.
SLIP = 97
_RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Distinct words that a task counts before it passes them on.
HELD = 100_000
#: Hashes are sums of code points times powers of BASE; a code point times a hash stays in 63 bits.
BASE, MODULUS = 1009, (1 << 41) - 21
#: Characters that a task lays out at once.
LAID = 1 << 18
_powers = np.ones(1, np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: how often each word occurs in whole texts, with the slips of the pen that a document's checksum decides.

    Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased; where SLIP divides the crc32 of ``<doc_id>:<run>`` its code
    point at crc32 modulo length is left out. Words of LEAST_LENGTH code points and LEAST_COUNT occurrences stay. A null
    text has none, a null doc_id counts as an empty one; rows that share a doc_id count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                _count(held, doc, text.as_buffer().to_pybytes() if text.is_valid else b"")
                if len(held) > HELD:
                    yield _counted(held)
                    held.clear()
        yield _counted(held)

    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _count(held: Counter[str], doc: str, raw: bytes) -> None:
    text = raw.translate(_LOWER).decode("utf-8", "replace")
    runs = Counter(_RUNS.findall(text) if len(text) < LAID else (m.group() for m in _RUNS.finditer(text)))
    seed = zlib.crc32(f"{doc}:".encode())
    for word, n in runs.items():
        h = zlib.crc32(word.encode(), seed)
        if h % SLIP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LENGTH:
                continue
        held[word] += n


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def _powers_to(n: int) -> np.ndarray:
    """Powers 0 to ``n`` of BASE."""
    global _powers
    if len(_powers) <= n:
        out, last = list(_powers), int(_powers[-1])
        while len(out) <= n:
            last = last * BASE % MODULUS
            out.append(last)
        _powers = np.array(out, np.int64)
    return _powers


def _sums(terms: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... terms, each term below MODULUS."""
    out, carried = np.zeros(len(terms) + 1, np.int64), 0
    for at in range(0, len(terms), 8192):  # 8192 terms of 41 bits stay in 63
        part = np.cumsum(terms[at : at + 8192]) + carried
        part %= MODULUS
        out[at + 1 : at + 1 + len(part)] = part
        carried = int(part[-1])
    return out


PLACES = "id long, size int, i int, c int, node long, skipped long, open long, before long, power long"


def _places(word: str, n: int) -> list[np.ndarray]:
    """At each place of a word, its end included: the character (0 for the end), the node's hash, and the hashes of the word without the character, with it left open, and with a gap before it.

    The hash without the character is multiplied by BASE, as ``terminals`` are.
    """
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    powers = _powers_to(n + 1)
    before = _sums(codes * powers[:n] % MODULUS)
    whole, c = before[-1], np.append(codes, 0)
    after = np.append((whole - before[1:]) % MODULUS, 0)
    skipped = (before * BASE + after) % MODULUS
    left_open = (before + after) % MODULUS
    gap = (before + (whole - before) % MODULUS * BASE) % MODULUS
    return [c, before, skipped, left_open, gap, powers[: n + 1]]


def trie_places(words: DataFrame) -> DataFrame:
    """Rows PLACES of ``words(id, word)``: a word's node, its character there and the errata's hashes, for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(word)
                held.append([np.full(n + 1, key, np.int64), np.full(n + 1, n, np.int32), np.arange(n + 1, dtype=np.int32), *_places(word, n)])
                size += n + 1
                if size >= LAID:
                    yield _laid(held)
                    held, size = [], 0
        if held:
            yield _laid(held)

    return words.select("id", "word").mapInArrow(run, PLACES)


def _laid(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    names = [p.split()[0] for p in PLACES.split(", ")]
    columns = [np.concatenate(x) for x in zip(*held)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if n == "c" else c) for n, c in zip(names, columns)], names=names)


def heavy_children(places: DataFrame) -> DataFrame:
    """``(node, i, heavy)`` of nodes with several children: the character that most words go on with (ties: the greatest, so the end of a word only where it is alone)."""
    children = places.groupBy("node", "i", "c").agg(F.count(F.lit(1)).alias("m"))
    best = children.groupBy("node", "i").agg(F.max(F.struct("m", "c")).alias("most"), F.count(F.lit(1)).alias("k"))
    return best.where("k > 1").select("node", "i", F.col("most.c").alias("heavy"))


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, each in both orders, of ids of ``words(id, word)`` that differ by one inserted, deleted or replaced code point; words are distinct."""
    places = trie_places(words)
    # Written first: all words meet at the shortest prefixes, and Spark splits such a partition only if no aggregate stands on the join's other side.
    heavy = materialize(heavy_children(places), "heavy")
    light = materialize(places.join(heavy, ["node", "i"]).where("c <> heavy"), "light")
    filled = lambda gap: f"({gap} + heavy * power) % {MODULUS} * {BASE} % {MODULUS}"
    path = lambda at, length, hash_: F.struct(F.expr(at).alias("at"), F.expr(length).cast("int").alias("length"), F.expr(hash_).alias("h"))
    inner, real = F.col("c") > 0, F.col("heavy") > 0
    ways = F.array(F.when(inner, path("0", "size - 1", "skipped")), F.when(inner & real, path("1", "size", filled("open"))), F.when(real, path("2", "size + 1", filled("before"))))
    probes = light.select("id", F.explode(ways).alias("p")).where("p is not null").select(F.col("id").alias("a"), F.col("p.length").alias("size"), F.col("p.h").alias("h"))
    # A word's own hash is where its last place has the whole word before it.
    terminals = places.where("c = 0").select(F.col("id").alias("b"), "size", F.expr(f"node * {BASE} % {MODULUS}").alias("h"))
    met = probes.join(terminals, ["size", "h"]).select("a", "b")
    opened = light.where(inner).select("id", "size", "i", "open")
    both = opened.withColumnRenamed("id", "a").join(opened.withColumnRenamed("id", "b"), ["size", "i", "open"]).where("a < b").select("a", "b")
    every = met.unionByName(both).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    name = lambda k: words.select(F.col("id").alias(k), F.col("word").alias(f"word_{k}"))
    seen = every.join(name("a"), "a").join(name("b"), "b").where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")
    return seen.unionByName(seen.select(F.col("b").alias("a"), F.col("a").alias("b")))


def variants(counts: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of ``counts(word, n)``, whose words are distinct and not null.

    ``n_near`` words are one edit away; ``form`` is the one of most occurrences (ties: the least by code point) if
    it has twice the word's at least, ``form_n`` its occurrences; ``root`` is where the forms lead to in the end.
    Words without a near one are their own roots. No words give no rows.
    """
    words = materialize(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = one_edit_pairs(words)
    named = pairs.join(words.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    best = named.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"), F.col("b").alias("form_id"))).alias("f"))
    joined = words.join(best, words["id"] == best["a"], "left")
    good = F.coalesce(-F.col("f.less") >= 2 * F.col("n"), F.lit(False))
    formed = materialize(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("f.form")).alias("form"), F.when(good, F.col("f.form_id")).alias("form_id"), F.when(good, -F.col("f.less")).alias("form_n")), "formed")
    # Each step doubles how far a root lies; a form has twice the occurrences, so there are few steps.
    roots = materialize(formed.where("form_id is not null").select("id", F.col("form_id").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("id").alias("root"), F.col("root").alias("further"))
        now = materialize(roots.join(onward, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not now.where("moved").isEmpty()
        drop_stored(roots)
        roots = now
        if not moved:
            break
    led = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return formed.join(led, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
