"""Benchmark decontamination by a generalised suffix automaton over words.

The automaton holds every substring of every test item. Reading a document's words, its state is the
longest suffix so far that occurs in an item; where that reaches a window's length, a window ends. It is
built in parts of bounded size and kept in sorted arrays; words are only read by it where runs of several words
occur in items. Items that are too many for one automaton in memory make several, which read all documents one after the other.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import batches_of, drop_stored, free_name, materialize

WINDOW = 13
#: A document is contaminated if this many times its hit words make up its words.
COVERAGE = 20
#: Bytes of test items that are on the driver at once, of what is built from them (what exceeds either makes a further automaton), of a piece of an item, and of the items of one part.
ITEM_BYTES = 24 << 20
BUILT_BYTES = 384 << 20
PIECE_BYTES = 1 << 20
PART_BYTES = 1 << 20
#: Words of a run that items must hold for the automaton to read it, at most.
RUN = 4
CHUNK = 1 << 22
_fold = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))



def words_of(text: str | None) -> list[bytes]:
    """ASCII letters and digits and all other characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_fold).split()


class _Growing:
    """A suffix automaton while words are added to it: dictionaries, 100 and more bytes a word."""

    def __init__(self) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]
        self.held: list[set] = [set()]
        self.short: list[dict[int, set]] = [{}]

    def add(self, item: int, words: list[int], whole: bool) -> None:
        """A sequence of an item; ``whole`` if the item is shorter than a window and so a window itself."""
        last = 0
        for w in words:
            last = self._extend(last, w)
            self.held[last].add(item)
        if whole:  # it is the longest string of the state that it ends in
            self.short[last].setdefault(len(words), set()).add(item)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        now = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = now
            p = self.link[p]
        if p == -1:
            self.link[now] = 0
        else:
            q = self.next[p][w]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return now

    def _state(self, length: int, to: dict) -> int:
        self.next.append(to)
        self.link.append(0)
        self.length.append(length)
        self.held.append(set())
        self.short.append({})
        return len(self.link) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy


class _Part:
    """A suffix automaton in arrays: its transitions are sorted by state and word."""

    def __init__(self, grown: _Growing, window: int) -> None:
        g, n = grown, len(grown.link)
        order = sorted(range(1, n), key=lambda v: g.length[v])
        for v in reversed(order):
            if g.length[g.link[v]] >= window:
                g.held[g.link[v]] |= g.held[v]
        full, short = [0] * n, [0] * n
        for v in order:
            up = g.link[v]
            # States on a state's suffix path that hold windows of WINDOW words: the shortest one serves all.
            full[v] = 0 if g.length[v] < window else v if g.length[up] < window else full[up]
            short[v] = v if g.short[v] else short[up]
        keys = np.fromiter((v << 32 | w for v, to in enumerate(g.next) for w in to), np.int64)
        to = np.fromiter((x for t in g.next for x in t.values()), np.int32)
        by = np.argsort(keys, kind="stable")
        ends = [v for v in range(n) if full[v] == v and v]
        self.keys, self.to = keys[by], to[by]
        self.link, self.length = np.array(g.link, np.int32), np.array(g.length, np.int32)
        self.full, self.short = np.array(full, np.int32), np.array(short, np.int32)
        self.held_state = np.array(ends, np.int32)
        self.held_at = np.cumsum([0, *(len(g.held[v]) for v in ends)], dtype=np.int64)
        self.held = np.fromiter((x for v in ends for x in sorted(g.held[v])), np.int32)
        self.whole = {v: sorted((k, sorted(s)) for k, s in own.items()) for v, own in enumerate(g.short) if own}

    def bytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray)) + 400 * len(self.whole)

    def views(self) -> tuple:
        return tuple(memoryview(x) for x in (self.keys, self.to, self.link, self.length, self.full, self.short))

    def items_of(self, state: int) -> list[int]:
        i = int(np.searchsorted(self.held_state, state))
        return self.held[self.held_at[i] : self.held_at[i + 1]].tolist()


class Automaton:
    """Suffix automata of many word sequences, with the items of each state that windows need.

    Items that are longer than a part are cut into sequences that overlap by a window less a word, so that each window is in one.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW, part_bytes: int = PART_BYTES) -> None:
        self.window, self.least = window, window
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.parts: list[_Part] = []
        runs: list[np.ndarray] = []
        sequences = [np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], np.int64) for _, text in items]
        self.least = min([window, *(len(x) for x in sequences if len(x))])
        self.run = min(self.least, RUN)
        now, size, most = _Growing(), 0, max(2 * window, part_bytes // 6)
        for i, words in enumerate(sequences):
            runs.append(np.unique(self._run_hashes(words)))
            for at in range(0, max(1, len(words) - window + 1), most - window + 1) if len(words) else ():
                own = words[at : at + most].tolist()
                if size and size + len(own) > most:
                    self.parts.append(_Part(now, window))
                    now, size = _Growing(), 0
                now.add(i, own, len(words) < window)
                size += len(own)
        if size:
            self.parts.append(_Part(now, window))
        self.known = np.unique(np.concatenate([np.empty(0, np.uint64), *runs]))
        self._views: list | None = None

    def __getstate__(self) -> dict:
        return {**vars(self), "_views": None}

    def bytes(self) -> int:
        """About what it takes in each task: its arrays, and some 150 bytes for each word that items know."""
        return sum(p.bytes() for p in self.parts) + self.known.nbytes + 150 * len(self.ids)

    def _run_hashes(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of all runs of ``run`` words; 0 where one has a word that no item knows."""
        n = len(ids) - self.run + 1
        if n < 1:
            return np.empty(0, np.uint64)
        h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(self.run):
            own = ids[i : i + n]
            h = (h ^ own.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            ok &= own > 0
        return np.where(ok, h | np.uint64(1), np.uint64(0))

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where a window may be: stretches of which all runs occur in items, as long as the shortest window."""
        h = self._run_hashes(ids)
        if not len(h) or not len(self.known):
            return
        inside = self.known[np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)] == h
        edges = np.flatnonzero(np.diff(np.r_[0, inside.astype(np.int8), 0]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + self.run - 1 >= self.least:
                yield a, b + self.run - 1

    def _walk(self, part: _Part, views: tuple, words: list[int], a: int) -> Iterator[tuple[int, int]]:
        """(first, after) of the longest window that ends at each word, and the items of all of them into ``self._found``."""
        keys, to, link, length, full, short = views
        n, v, matched = len(keys), 0, 0
        for i, w in enumerate(words, a):
            while True:
                key = v << 32 | w
                at = bisect_left(keys, key)
                if at < n and keys[at] == key:
                    v = to[at]
                    matched += 1
                    break
                if not v:
                    matched = 0
                    break
                v = link[v]
                matched = length[v]
            size = 0
            if matched >= self.window:
                size = self.window
                self._found.add((part, full[v]))
            u = short[v]
            while u:
                for k, names in part.whole.get(u, ()):
                    if k <= matched:
                        size = max(size, k)
                        self._short.update(names)
                u = short[link[u]] if link[u] > 0 else 0
            if size:
                yield i + 1 - size, i + 1

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
        """Number of words, spans (first, after last) of hit words, and the items whose windows occur."""
        words = words_of(text)
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        if self._views is None:
            self._views = [p.views() for p in self.parts]
        self._found, self._short = set(), set()
        hits = []
        for a, b in self._stretches(ids):
            for part, views in zip(self.parts, self._views):
                hits += self._walk(part, views, ids[a:b].tolist(), a)
        items = {self.names[x] for part, state in self._found for x in part.items_of(state)} | {self.names[x] for x in self._short}
        return len(words), _united(hits), items


def _pieces(words: list[bytes], window: int, size: int) -> Iterator[list[bytes]]:
    """Stretches of some ``size`` bytes that overlap by a window less a word: each window is in one, and none is shorter than a window if the words are not."""
    at = 0
    while True:
        end, own = at, 0
        while end < len(words) and (own < size or end - at < window):
            own += len(words[end]) + 1
            end += 1
        yield words[at:end]
        if end == len(words):
            return
        at = end - window + 1


def _cut(benchmark: DataFrame, window: int, size: int) -> DataFrame:
    """``(i, text)`` of the items, those of more than ``size`` bytes in pieces. Equal rows are one."""

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = text is None or len(text.encode("utf-8", "surrogatepass")) <= size
                own = [text] if whole else [b" ".join(x).decode("utf-8", "surrogatepass") for x in _pieces(words_of(text), window, size)]
                names += [name] * len(own)
                texts += own
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["i", "text"])

    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").mapInArrow(run, "i string, text string").distinct()


def automata(benchmark: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES, built_bytes: int = BUILT_BYTES, piece_bytes: int = PIECE_BYTES) -> Iterator[Automaton]:
    """Automata that together hold all items of ``benchmark(item_id, text)``, one at least.

    Each is made of about ``item_bytes`` of items at most and takes ``built_bytes`` at most, or is that of one piece of ``piece_bytes`` alone.
    The driver holds one group of items at a time. Items without words are left out.
    """

    def built(rows: list[tuple[str, str | None]]) -> Iterator[Automaton]:
        automaton = Automaton(rows, window)
        if automaton.bytes() <= built_bytes or len(rows) < 2:
            yield automaton
        else:
            del automaton
            for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
                yield from built(half)

    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size <= item_bytes:
        rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").collect()
        yield from built([(r["i"], r["text"]) for r in rows])
        return
    pieces = materialize(_cut(benchmark, window, piece_bytes), "items")
    groups = max(2, -(-2 * size // item_bytes))
    # Pieces are distinct and small against a group: with enough groups all are small enough, or hold a single piece.
    while True:
        group = F.pmod(F.xxhash64("i", "text"), F.lit(groups))
        sizes = pieces.groupBy(group.alias("g")).agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("k"))
        largest = sizes.where(F.col("k") > 1).agg(F.max("n").alias("n")).first()["n"] or 0
        if largest <= item_bytes:
            break
        groups *= 2
    for g in range(groups):
        if rows := pieces.where(group == g).collect():
            yield from built([(r["i"], r["text"]) for r in rows])
    drop_stored(pieces)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by place, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


Found = tuple[int, list[tuple[int, int]], set]
_FOUND = pa.struct([("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


def _scanned(docs: DataFrame, found_by: Iterator[Automaton], finish: Callable[[pa.RecordBatch, list[Found]], pa.RecordBatch], schema) -> DataFrame:
    """``docs`` with all they hold of all automata, given to ``finish`` a batch at a time.

    One automaton is one pass without a shuffle. Of several each is a pass of its own, so that a task holds one: what
    a pass finds goes on beside the rows in a table in the shared folder, and the one before it is deleted.
    """
    names = docs.columns
    extra = free_name(names, "found_so_far")
    held = None

    def scan(automaton: Automaton, part: pa.RecordBatch) -> list[Found]:
        found = [automaton.scan(t) for t in part.column(names.index("text")).to_pylist()]
        if part.num_columns == len(names):
            return found
        before = part.column(len(names)).to_pylist()
        return [(n, _united([*spans, *map(tuple, b["spans"])]), {*items, *b["items"]}) for (n, spans, items), b in zip(found, before)]

    def middle(automaton: Automaton):
        def run(batches):
            for batch in batches:
                for part in batches_of(batch, "text", CHUNK):
                    found = [{"spans": [list(x) for x in spans], "items": sorted(items)} for _, spans, items in scan(automaton, part)]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(found, _FOUND)], names=[*names, extra])

        return run

    def last(automaton: Automaton):
        def run(batches):
            for batch in batches:
                for part in batches_of(batch, "text", CHUNK):
                    found = scan(automaton, part)
                    yield finish(part.select(names), found)

        return run

    carried = StructType([*docs.schema.fields, StructField(extra, StructType([StructField("spans", ArrayType(ArrayType(LongType()))), StructField("items", ArrayType(StringType()))]))])
    automaton = next(found_by)
    for following in found_by:
        now = materialize((docs if held is None else held).mapInArrow(middle(automaton), carried), "scanned")
        drop_stored(held)
        held, automaton = now, following
    return (docs if held is None else held).mapInArrow(last(automaton), schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **bounds: int) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, items (sorted strings), spans of hit words.

    A window is ``window`` consecutive words of an item, or a shorter item whole; items without words have
    none. Null and empty texts have no words. Repeated rows, repeated item ids and null item ids (an empty
    string) are allowed; without items nothing is hit. Texts count whole; a null doc_id stays null; an empty table
    gives an empty result; further columns, whatever their names, are ignored. ``bounds`` are those of ``automata``: any
    number of items is taken, in as many passes over the documents as they have groups.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))

    def finish(part: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array([f[0] for f in found], pa.int64()),
                pa.array([sum(b - a for a, b in f[1]) for f in found], pa.int64()),
                pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
                pa.array([[{"first": a, "after": b} for a, b in f[1]] for f in found], span),
            ],
            names=["doc_id", "n_words", "n_hit", "items", "spans"],
        )

    schema = f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<first: long, after: long>>"
    return _scanned(docs.select("doc_id", "text"), automata(benchmark, window, **bounds), finish, schema)


def digests(found: DataFrame, coverage: int = COVERAGE) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, longest: int | None = None, **bounds: int) -> DataFrame:
    """``docs`` with hit spans cut out of the texts of contaminated documents, or of any that exceed ``longest`` words.

    Texts without such spans stay byte for byte. What is before and after a cut is joined by a space; a text's own
    ends stay where no cut touches them. Null texts stay null, repeated rows are each cut alike, all columns stay as they are,
    whatever their names, and an empty table stays empty; without items nothing is cut.
    """
    import re

    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    at = docs.schema.fieldNames().index("text")

    def clean(text: str | None, n: int, spans: list[tuple[int, int]]) -> str | None:
        hit = sum(b - a for a, b in spans)
        if not (hit and coverage * hit >= n):
            spans = [s for s in spans if longest is not None and s[1] - s[0] > longest]
        if not spans:
            return text
        where = [m.span() for m in pattern.finditer(text)]
        cuts = [0, *(x for a, b in spans for x in (where[a][0], where[b - 1][1])), len(text)]
        left = [text[a:b] for a, b in zip(cuts[::2], cuts[1::2])]
        left = [x.lstrip(" ") if i else x for i, x in enumerate(left)]
        left = [x.rstrip(" ") if i < len(left) - 1 else x for i, x in enumerate(left)]
        return " ".join(x for x in left if x)

    def finish(part: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
        texts = [clean(t, n, spans) for t, (n, spans, _) in zip(part.column(at).to_pylist(), found)]
        return part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return _scanned(docs, automata(benchmark, window, **bounds), finish, docs.schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, **bounds: int) -> DataFrame:
    """``docs`` without contaminated documents; the others stay byte for byte, with all their columns, whatever their names. No shuffle.

    Null and empty texts stay, repeated rows stay or go together, an empty table stays empty; without items all stay.
    """

    def finish(part: pa.RecordBatch, found: list[Found]) -> pa.RecordBatch:
        hits = [(n, sum(b - a for a, b in spans)) for n, spans, _ in found]
        return part.filter(pa.array([not (hit and coverage * hit >= n) for n, hit in hits], pa.bool_()))

    return _scanned(docs, automata(benchmark, window, **bounds), finish, docs.schema)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


#: Windows of documents joined to windows of items.
OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bu AS (SELECT item, least(13, len(ws)) AS k, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, id FROM (SELECT *, row_number() OVER () AS id FROM b)),
bw AS (SELECT DISTINCT item, k, array_to_string(x, ' ') AS x FROM (SELECT item, k, list(x) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS x FROM bu) WHERE len(x) = k),
du AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
dw AS (SELECT r, i, k, array_to_string(x[1 : k], ' ') AS x FROM (SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS x FROM du), (SELECT DISTINCT k FROM bw) WHERE len(x) >= k),
h AS (SELECT DISTINCT r, i, dw.k, item FROM dw JOIN bw ON bw.k = dw.k AND bw.x = dw.x),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN t ON t.r = d.r
"""
