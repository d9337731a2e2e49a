"""Similarity join of documents on their sets of word n-grams, by prefix trees.

1. Each text's set is hashed to sorted 64-bit tokens. Equal sets are one class from here on.
2. If a set of n tokens has a partner of Jaccard similarity t, at most ``n - ceil(t n)`` of its tokens are
   not the partner's. So among its first tokens, in the order of the hashes, all but so many are shared
   with some other class; this leaves the classes that may have a partner.
3. Two such sets also share one of the first ``n - ceil(t n) + 1`` of each, in any global order. The
   tokens' document frequencies are counted, and the filter is applied again with rare
   tokens first; widely shared passages then come last and bring no candidates.
4. Classes that share such a token meet in a group. A large group is compared with a few leaders first: what is
   linked to a leader is one cluster, and needs no comparing among itself. Jaccard distance is a metric, so
   only sets near a leader can be linked to a set of its cluster; the rest goes on with other leaders, then in
   blocks. A block's sets, globally ordered, form a prefix tree; all probes descend it at once, a node's overlap
   serves all sets below it, and probes leave where the remaining lengths can no longer reach the threshold.
5. Links join classes to components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, drop_stored, free_name, marked_among, materialize, row_hash
from .components import connected_components

WORDS = 4
#: The threshold, in hundredths.
PERCENT = 85
CHUNK = 1 << 20
#: Bytes of a text that are hashed at once.
PIECE_BYTES = 1 << 20
#: Prefix tokens that a bucket holds, about, and how many buckets there are at most.
BUCKET_TOKENS = 1 << 19
MOST_BUCKETS = 1 << 16
#: Sets of a group that are compared with its leaders in one place, and tokens; more make a group large.
BLOCK_SETS = 64
BLOCK_TOKENS = 1_000_000
#: Sets of either side of a block that are compared with each other.
GRID_SETS = 128
#: Leaders of a large group, and how often what they leave is given new ones.
LEADERS = 4
ROUNDS = 3
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_powers: tuple[np.ndarray, np.ndarray] = (np.empty(0, _U), np.empty(0, _U))
_bytes = np.frombuffer(hashlib.shake_256(b"byte values").digest(2048), _U)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, _U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=_U))
        _powers = (both[0], both[1])
    return _powers


def _pieces(raw, k: int, size: int) -> Iterator[bytes]:
    """A text's words, lower-cased and joined by spaces, in pieces of about ``size`` bytes that begin with the k - 1 words before them."""
    view = memoryview(raw).cast("B")
    words: list[bytes] = []
    rest, fresh = b"", False
    for at in range(0, len(view), size):
        chunk = rest + bytes(view[at : at + size]).lower()
        own = chunk.split()
        rest = own.pop() if own and at + size < len(view) and chunk[-1:] not in b" \t\n\r\x0b\x0c" else b""
        words += own
        fresh = fresh or bool(own)
        if len(words) >= k and fresh:
            yield b" ".join(words)
            words, fresh = words[len(words) - k + 1 :], False
    if rest:
        words.append(rest)
        fresh = True
    if fresh:
        yield b" ".join(words)


def _piece_hashes(pieces: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each piece's k-word shingles; of fewer words, of the whole."""
    a = np.frombuffer(b"\n" + b"\n".join(pieces) + b"\n", np.uint8)
    lines = np.flatnonzero(a == 10)
    cuts = np.flatnonzero((a == 10) | (a == 32))
    starts, ends = cuts[:-1] + 1, cuts[1:]
    owner = np.searchsorted(lines, starts, "right") - 1
    power, inverse = _powers_to(len(a))
    sums = np.zeros(len(a) + 1, _U)
    np.cumsum(_bytes[a] * power[: len(a)], out=sums[1:])
    count = np.bincount(owner, minlength=len(pieces))
    first = np.cumsum(count) - count
    last = np.minimum(np.arange(len(starts)) + k - 1, len(starts) - 1)
    full = owner[last] == owner
    full &= np.arange(len(starts)) + k - 1 < len(starts)
    full[first[count < k]] = True
    last[first[count < k]] = (first + count - 1)[count < k]
    begin, stop = starts[full], ends[last[full]]
    h = _mixed((sums[stop] - sums[begin]) * inverse[begin])
    bounds = np.searchsorted(owner[full], np.arange(len(pieces) + 1))
    return [np.unique(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:])]


def shingle_sets(texts: list, k: int = WORDS, size: int | None = None) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; with 1 to k-1 words, of the whole sequence.

    Texts are strings, UTF-8 buffers or None. Words are what ASCII white space parts, with A-Z lower-cased. A
    long text is split and hashed piece by piece, so that beside it only its hashes are held.
    """
    size = size or PIECE_BYTES
    out: list[list[np.ndarray]] = [[] for _ in texts]
    pieces, of, n = [], [], 0

    def flush() -> None:
        for i, own in zip(of, _piece_hashes(pieces, k)):
            out[i].append(own)

    for i, t in enumerate(texts):
        for piece in _pieces(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t, k, size) if t is not None else ():
            pieces.append(piece)
            of.append(i)
            n += len(piece)
            if n > size:
                flush()
                pieces, of, n = [], [], 0
    if pieces:
        flush()
    return [np.empty(0, _U) if not x else x[0] if len(x) == 1 else np.unique(np.concatenate(x)) for x in out]


def _raw(column: pa.Array) -> list:
    return [x.as_buffer() if x.is_valid else None for x in column]


def prefix_length(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def sample_length(n, percent: int = PERCENT):
    """How many first tokens by hash are compared: a third more than may differ from a partner's, and one."""
    return prefix_length(n, percent) + prefix_length(n, percent) // 3


def fingerprint(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def key_of(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "little", signed=True)


def _table(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def sketches(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """``(doc_id, text_hash, n, fp, key)`` of each row of ``docs(doc_id, text)``; fp and key are null for an empty set."""

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                sets = shingle_sets(_raw(part.column(2)), k)
                fps = [fingerprint(s) for s in sets]
                yield _table([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array([f and key_of(f) for f in fps], pa.int64())], ["doc_id", "text_hash", "n", "fp", "key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, fp binary, key long")


def _by_bucket(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of tokens by bucket, and where each bucket begins in it."""
    b = ((_mixed(tokens ^ _U(0x5851F42D4C957F2D)) >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def _suspects(docs: DataFrame, buckets: int, k: int, percent: int) -> DataFrame:
    """``(key, shared)``: how many of a class's first tokens by hash another class has among its own. Classes without any are left out.

    A token that several classes of one task hold is counted for them at once, and goes on without them, to be
    counted for those of other tasks. So of a token that very many hold, a bucket gets one entry a task. A class
    may be counted once more than it should for a token that it shares anyway; that lets more through, never less.
    """

    def emit(tokens: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(tokens)
        own = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(t) for t in tokens])
        names = np.array(keys, np.int64)
        held = np.argsort(flat, kind="stable")
        t = flat[held]
        first = np.r_[True, t[1:] != t[:-1]]
        group = np.cumsum(first) - 1
        many = np.bincount(group) > 1
        here = np.bincount(own[held][many[group]], minlength=len(keys))
        told = np.flatnonzero(here)
        if len(told):
            yield _table([pa.array([int(names[told[0]] % buckets)], pa.int32()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary()), pa.array([names[told].tobytes()], pa.binary()), pa.array([here[told].astype(np.int64).tobytes()], pa.binary())], ["bucket", "tokens", "idx", "keys", "counts"])
        stays = held[first]  # of each token one class, which stands for itself or, marked, for several
        flat, own, mark = flat[stays], own[stays], many
        order, at = _by_bucket(flat, buckets)
        for b in np.flatnonzero(np.diff(at)):
            part = order[at[b] : at[b + 1]]
            used, index = np.unique(own[part], return_inverse=True)
            index = np.where(mark[part], len(used), index)
            yield _table([pa.array([int(b)], pa.int32()), pa.array([flat[part].tobytes()], pa.binary()), pa.array([index.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes()], pa.binary()), pa.array([names[used].tobytes()], pa.binary()), pa.array([None], pa.binary())], ["bucket", "tokens", "idx", "keys", "counts"])

    def run(batches):
        seen, tokens, keys, n = set(), [], [], 0
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                for s in shingle_sets(_raw(part.column(0)), k):
                    if not len(s) or (key := key_of(fingerprint(s))) in seen:
                        continue
                    seen.add(key)  # copies beside each other are emitted once; others fall together in their bucket
                    tokens.append(s[: sample_length(len(s), percent)].copy())
                    keys.append(key)
                    n += len(tokens[-1])
                if n > 1 << 21:
                    yield from emit(tokens, keys)
                    seen, tokens, keys, n = set(), [], [], 0
        if keys:
            yield from emit(tokens, keys)

    def by_part(names: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, at = _by_bucket(names.view(_U), buckets)
        for part in np.flatnonzero(np.diff(at)):
            own = order[at[part] : at[part + 1]]
            yield _table([pa.array([int(part)], pa.int32()), pa.array([names[own].tobytes()], pa.binary()), pa.array([counts[own].astype(np.int64).tobytes()], pa.binary())], ["part", "keys", "counts"])

    def total(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.frombuffer(k.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.int64)) for batch in rows for k, c in zip(batch.column("keys"), batch.column("counts"))]
        names, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        yield _table([names, pa.array(np.bincount(where, np.concatenate([c for _, c in held])).astype(np.int64))], ["key", "shared"])

    def shared(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, several = [np.empty(0, _U)], [np.empty(0, np.int64)], [np.empty(0, _U)]
        for batch in rows:
            for t, i, names, counts in zip(*(batch.column(c) for c in ("tokens", "idx", "keys", "counts"))):
                names = np.frombuffer(names.as_buffer(), np.int64)
                if counts.is_valid:
                    yield from by_part(names, np.frombuffer(counts.as_buffer(), np.int64))
                    continue
                t, raw = np.frombuffer(t.as_buffer(), _U), i.as_buffer()
                i = np.frombuffer(raw, np.uint16 if raw.size == 2 * len(t) else np.uint32)
                one = i < len(names)
                several.append(t[~one])
                tokens.append(t[one])
                keys.append(names[i[one]])
        t, v = np.concatenate(tokens), np.concatenate(keys)
        order = np.lexsort((v, t))
        t, v = t[order], v[order]
        if not len(t):
            return
        once = np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])]
        t, v = t[once], v[once]
        same = t[1:] == t[:-1]
        names, n = np.unique(v[np.r_[False, same] | np.r_[same, False] | np.isin(t, np.concatenate(several))], return_counts=True)
        yield from by_part(names, n)

    blobs = docs.select("text").mapInArrow(run, "bucket int, tokens binary, idx binary, keys binary, counts binary")
    # A class has a count from each bucket; they go on as a row for each bucket and part of the classes, to be summed there.
    parts = _grouped(blobs, ["bucket"], shared, "part int, keys binary, counts binary")
    return _grouped(parts, ["part"], total, "key long, shared long")


def _grouped(df: DataFrame, by: list[str], f, schema: str, extra: list[str] | None = None) -> DataFrame:
    """``f`` over the batches of each group of rows with equal ``by``: dealt by hash, sorted, and streamed, so small groups cost little.

    ``f`` gets an iterator of record batches of one group at a time and reads it to its end.
    """

    def run(batches):
        pending: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in by)))
            start = 0
            for i in range(1, len(keys) + 1):
                if i < len(keys) and keys[i] == keys[start]:
                    continue
                if pending and keys[start] != name:
                    yield from f(iter(pending))
                    pending = []
                name = keys[start]
                pending.append(batch.slice(start, i - start))
                start = i
        if pending:
            yield from f(iter(pending))

    return df.repartition(*by).sortWithinPartitions(*by, *(extra or [])).mapInArrow(run, schema)


def _candidate_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(block, key, n, tokens)`` of the classes ``wanted(rep, key)``, from the texts of their least documents."""

    def run(batches):
        rows, n = [], 0

        def out():
            block = hashlib.blake2b(b"".join(r[0].to_bytes(8, "little", signed=True) for r in rows), digest_size=8).digest()
            names = pa.array([int.from_bytes(block, "little", signed=True)] * len(rows), pa.int64())
            return _table([names, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["block", "key", "n", "tokens"])

        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                for key, s in zip(part.column(0).to_pylist(), shingle_sets(_raw(part.column(1)), k)):
                    if len(s) and key_of(fingerprint(s)) == key:
                        rows.append((key, len(s), s.tobytes()))
                        n += len(s)
                if n > BLOCK_TOKENS:
                    yield out()
                    rows, n = [], 0
        if rows:
            yield out()

    # Only texts that may be wanted are shuffled.
    wanted = materialize(wanted, "wanted")
    asked = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("rep is not null")
    texts = marked_among(asked, ["rep"], wanted, ["rep"], "may").where("may").join(wanted, "rep").select("key", "text")
    return texts.mapInArrow(run, "block long, key long, n long, tokens binary")


def _frequencies(sets: DataFrame, buckets: int) -> DataFrame:
    """``(block, tokens, df)``: of each block's tokens those of two sets or more, with their document frequencies."""

    def run(batches):
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            for block in np.unique(blocks):
                own = [np.frombuffer(batch.column(1)[int(i)].as_buffer(), _U) for i in np.flatnonzero(blocks == block)]
                t, n = np.unique(np.concatenate(own), return_counts=True)
                order, at = _by_bucket(t, buckets)
                for b in np.flatnonzero(np.diff(at)):
                    part = order[at[b] : at[b + 1]]
                    yield _table([pa.array([int(b)], pa.int32()), pa.array([int(block)], pa.int64()), pa.array([t[part].tobytes()], pa.binary()), pa.array([n[part].astype(np.uint32).tobytes()], pa.binary())], ["bucket", "block", "tokens", "counts"])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, tokens, counts = [], [], []
        for batch in rows:
            blocks += batch.column("block").to_pylist()
            tokens += [np.frombuffer(x.as_buffer(), _U) for x in batch.column("tokens")]
            counts += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("counts")]
        all_t, where = np.unique(np.concatenate(tokens), return_inverse=True)
        df = np.bincount(where, np.concatenate(counts)).astype(np.uint32)
        at = 0
        for block, t in zip(blocks, tokens):
            own = df[where[at : at + len(t)]]
            at += len(t)
            if (own > 1).any():
                yield _table([pa.array([block], pa.int64()), pa.array([t[own > 1].tobytes()], pa.binary()), pa.array([own[own > 1].tobytes()], pa.binary())], ["block", "tokens", "df"])

    return _grouped(sets.select("block", "tokens").mapInArrow(run, "bucket int, block long, tokens binary, counts binary"), ["bucket"], count, "block long, tokens binary, df binary")


def _rare_prefixes(sets: DataFrame, frequencies: DataFrame, percent: int) -> DataFrame:
    """``(token, key)``: of each set's prefix, rare tokens first, the tokens that other sets hold too."""
    both = sets.select("block", F.lit(1).alias("kind"), "key", "tokens", F.lit(None).cast("binary").alias("df")).unionByName(frequencies.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("key"), "tokens", "df"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_t, known_n, known = [np.empty(0, _U)], [np.empty(0, np.uint32)], None
        for batch in rows:
            tokens, keys = [], []
            for kind, key, t, df in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist(), batch.column("tokens"), batch.column("df")):
                t = np.frombuffer(t.as_buffer(), _U)
                if not kind:
                    known_t.append(t)
                    known_n.append(np.frombuffer(df.as_buffer(), np.uint32))
                    continue
                if known is None:
                    all_t, first = np.unique(np.concatenate(known_t), return_index=True)
                    known = (all_t, np.concatenate(known_n)[first])
                if not len(known[0]):
                    continue
                at = np.minimum(np.searchsorted(known[0], t), len(known[0]) - 1)
                n = np.where(known[0][at] == t, known[1][at], 1)
                prefix = np.lexsort((t, n))[: prefix_length(len(t), percent)]
                prefix = prefix[n[prefix] > 1]
                tokens.append(t[prefix])
                keys += [key] * len(prefix)
            if keys:
                yield _table([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(keys, pa.int64())], ["token", "key"])

    return _grouped(both, ["block"], run, "token long, key long", ["kind"])


def trie_links(probes: list[np.ndarray], sets: list[np.ndarray], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Pairs (probe, set) whose Jaccard similarity reaches the threshold, by a prefix tree of the sets.

    Tokens are ordered by the number of sets that hold them, rare ones first. Sorted sequences hold the
    tree: a node is a range of them with a common beginning. ``overlap`` counts, for all probes still
    alive, the tokens they share with a node's path; a probe stays alive below a node if the longest
    remainder there could still make the threshold with it.
    """
    flat = np.concatenate([*probes, *sets]) if probes or sets else np.empty(0, _U)
    names, inverse, held = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), np.int64)
    by_count = np.lexsort((names, held))
    rank[by_count] = np.arange(len(names))
    lone = int((held == 1).sum())  # tokens of one set alone have the first ranks; they overlap with nothing
    bounds = np.cumsum([0, *(len(s) for s in probes), *(len(s) for s in sets)])
    seqs = [np.sort(rank[inverse[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])]
    seqs = [s[np.searchsorted(s, lone) :] - lone for s in seqs]
    width = len(names) - lone
    mine, theirs = seqs[: len(probes)], seqs[len(probes) :]
    n_probe = np.array([len(s) for s in probes], np.int64)
    order = sorted(range(len(sets)), key=lambda i: theirs[i].astype(">u4").tobytes())
    theirs = [theirs[i] for i in order]
    n_set = np.array([len(sets[i]) for i in order], np.int64)
    size = np.array([len(s) for s in theirs], np.int64)
    chunk = max(1, (1 << 26) // max(1, width))
    for base in range(0, len(probes), chunk):
        own = mine[base : base + chunk]
        has = np.zeros((max(1, width), len(own)), np.uint8)
        for j, s in enumerate(own):
            has[s, j] = 1
        n_own = n_probe[base : base + chunk]
        stack = [(0, len(theirs), 0, np.arange(len(own)), np.zeros(len(own), np.int64))] if theirs else []
        while stack:
            lo, hi, depth, alive, overlap = stack.pop()
            a, b = theirs[lo], theirs[hi - 1]
            m = min(len(a), len(b))
            differs = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differs[0]) if len(differs) else m
            if end > depth:
                overlap = overlap + (has[a[depth:end]].sum(0, dtype=np.int64)[alive] if len(alive) * 4 > len(own) else has[np.ix_(a[depth:end], alive)].sum(0, dtype=np.int64))
            bound = int(((100 + percent) * (size[lo:hi] - end) - percent * n_set[lo:hi]).max())
            stays = (100 + percent) * overlap + bound >= percent * n_own[alive]
            if not stays.all():
                alive, overlap = alive[stays], overlap[stays]
            if not len(alive):
                continue
            while lo < hi and size[lo] == end:  # sequences that end here sort first
                for p in alive[100 * overlap >= percent * (n_own[alive] + n_set[lo] - overlap)]:
                    yield base + int(p), order[lo]
                lo += 1
            while lo < hi:
                to = lo + 1
                if theirs[hi - 1][end] == theirs[lo][end]:
                    to = hi
                else:
                    while theirs[to][end] == theirs[lo][end]:
                        to += 1
                stack.append((lo, to, end, alive, overlap))
                lo = to


class Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _with_tokens(rows: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(marked_among(sets.select("key", "tokens"), ["key"], rows, ["key"], "may").where("may"), "key").select(*by, "role", "key", "tokens")


def _sides(rows: Iterator[pa.RecordBatch]) -> tuple[list[list[int]], list[list[np.ndarray]]]:
    """Keys and tokens of a group's rows, by their role 0 or 1."""
    keys, tokens = [[], []], [[], []]
    for batch in rows:
        for role, key, t in zip(batch.column("role").to_pylist(), batch.column("key").to_pylist(), batch.column("tokens")):
            keys[role].append(key)
            tokens[role].append(np.frombuffer(t.as_buffer(), _U))
    return keys, tokens


def _edges(left: list[int], right: list[int], pairs: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """As many edges as join what ``pairs`` of places join."""
    place = {key: i for i, key in enumerate(dict.fromkeys([*left, *right]))}
    names, found = list(place), Union(len(place))
    for a, b in pairs:
        found.join(place[left[a]], place[right[b]])
    edges = [(names[x], names[r]) for x in range(len(names)) if (r := found.root(x)) != x]
    if edges:
        yield _table([pa.array(c, pa.int64()) for c in zip(*edges)], ["a", "b"])


def _judged(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(pivot, leader, key, linked)`` for the leaders of large groups ``(pivot, key, blocks)`` and the members that are linked to one or near enough for a link to its cluster.

    If x is linked to y and y to a leader, the similarity of x and the leader is at least ``2 percent - 100``, by the triangle
    inequality of Jaccard distances.
    """
    chosen = large.groupBy("pivot", "blocks").agg(*[F.min_by("key", F.xxhash64("key", F.lit(i))).alias(f"l{i}") for i in range(LEADERS)])
    leaders = chosen.select("pivot", "blocks", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("key"))
    leaders = leaders.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("role"), "key")
    dealt = large.select("pivot", F.pmod(F.xxhash64("key", F.lit(9)), F.col("blocks")).cast("int").alias("i"), F.lit(1).alias("role"), "key")
    near = 2 * percent - 100

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(rows)
        pivot = rows[0].column("pivot")[0].as_py()
        (heads, members), (head_tokens, tokens) = _sides(iter(rows))
        out: list[tuple] = []
        for head, h in zip(heads, head_tokens):
            for key, t in zip(members, tokens):
                both = len(np.intersect1d(h, t, assume_unique=True))
                if 100 * both >= near * (len(h) + len(t) - both):
                    out.append((pivot, head, key, 100 * both >= percent * (len(h) + len(t) - both)))
        if out:
            yield _table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["pivot", "leader", "key", "linked"])

    return _grouped(_with_tokens(leaders.unionByName(dealt), sets, ["pivot", "i"]), ["pivot", "i"], run, "pivot long, leader long, key long, linked boolean")


def _visits(judged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: links between a cluster's members and the sets that are near its leader, but not linked to it."""
    sizes = judged.groupBy("pivot", "leader").agg(F.ceil(F.count_if("linked") / GRID_SETS).cast("int").alias("c"), F.ceil(F.count_if(~F.col("linked")) / GRID_SETS).cast("int").alias("v")).where("v > 0")
    rows = judged.join(sizes, ["pivot", "leader"]).withColumn("mine", F.pmod(F.xxhash64("key", F.lit(5)), F.when(F.col("linked"), F.col("c")).otherwise(F.col("v"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("linked"), F.col("v")).otherwise(F.col("c")) - 1)))
    rows = rows.select("pivot", "leader", F.when(F.col("linked"), F.col("other")).otherwise(F.col("mine")).alias("i"), F.when(F.col("linked"), F.col("mine")).otherwise(F.col("other")).alias("j"), F.col("linked").cast("int").alias("role"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (left, right), (probes, theirs) = _sides(batches)
        yield from _edges(left, right, trie_links(probes, theirs, percent))

    by = ["pivot", "leader", "i", "j"]
    return _grouped(_with_tokens(rows, sets, by), by, run, "a long, b long")


def _links(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: edges that join the same classes as all links do, from groups of candidates ``(token, key)``."""
    ends = candidates.groupBy("token").agg(F.min("key").alias("pivot"), F.max("key").alias("most")).where("pivot <> most").select("token", "pivot")
    members = candidates.join(ends, "token").select("pivot", "key").distinct()
    members = materialize(members.join(sets.select("key", "n"), "key"), "candidates")
    edges, open_ = [], members
    for _ in range(ROUNDS):
        sizes = open_.groupBy("pivot").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"))
        large = sizes.where("blocks > 1")
        if not large.limit(1).count():
            break
        judged = materialize(_judged(open_.join(large, "pivot"), sets, percent), "judged")
        edges += [judged.where("linked and leader <> key").select(F.col("leader").alias("a"), F.col("key").alias("b")), materialize(_visits(judged, sets, percent), "visits")]
        open_ = materialize(open_.join(judged.where("linked").select("pivot", "key").distinct(), ["pivot", "key"], "left_anti"), "candidates")
    sizes = open_.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t")).where("m > 1")
    blocks = sizes.select("pivot", F.greatest(F.ceil(F.col("m") / GRID_SETS), F.ceil(F.col("t") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = open_.select("pivot", "key").join(blocks, "pivot").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    dealt = dealt.select("pivot", i.alias("i"), j.alias("j"), (F.col("mine") == j).cast("int").alias("role"), "key")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(rows)
        (left, right), (probes, theirs) = _sides(iter(rows))
        if rows[0].column("i")[0].as_py() == rows[0].column("j")[0].as_py():
            left, probes = right, theirs
        yield from _edges(left, right, trie_links(probes, theirs, percent))

    by = ["pivot", "i", "j"]
    out = _grouped(_with_tokens(dealt, sets, by), by, run, "a long, b long")
    for part in edges:
        out = out.unionByName(part)
    return out


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' sketches, the classes of equal sets ``(fp, key, rep, n, copies)``, and edges ``(a, b)`` between keys of classes that join what links join."""
    every = materialize(sketches(docs, k), "sketches")
    total = every.agg(F.sum(F.floor((F.col("n") * (100 - percent)) / 75) + 1).alias("p")).first()["p"] or 0
    buckets = lambda n: min(MOST_BUCKETS, max(1, -(-int(n) // BUCKET_TOKENS)))
    classes = every.where("fp is not null and doc_id is not null").groupBy("fp", "key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    # Two partners share as many of their first tokens as the smaller one's sample_length exceeds what may differ.
    smaller = F.floor((percent * F.col("n") + 99) / 100)
    may_differ = smaller - F.floor((percent * smaller + 99) / 100)
    shared_at_least = F.floor((may_differ + 1) / 3) + 1
    wanted = classes.join(_suspects(docs, buckets(total), k, percent), "key").where(F.col("shared") >= shared_at_least).select("rep", "key")
    sets = materialize(_candidate_sets(docs, wanted, k), "sets")
    if sets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():  # rows that are there several times
        repeated, sets = sets, materialize(sets.groupBy("key").agg(F.min("block").alias("block"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sets")
        drop_stored(repeated)
    tokens = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    candidates = materialize(_rare_prefixes(sets, _frequencies(sets, buckets(tokens)), percent), "prefixes")
    edges = materialize(_links(candidates, sets, percent), "links")
    drop_stored(sets, candidates)
    return every, classes, edges


def _rooted(classes: DataFrame, edges: DataFrame) -> DataFrame:
    roots = connected_components(edges)
    return classes.join(roots.select(F.col("v").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def similarity_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    ``component_id`` is the least doc_id that links reach; two documents link if 100 * intersection >=
    percent * union of their shingle sets. Rows without words are linked with nothing: their component is
    themselves. Rows that repeat a doc_id are one document of several texts, which joins the components of all of
    them. A null doc_id takes no part: its component_id is null. Texts count whole, whatever their length; an
    empty table gives an empty result; further columns are ignored.
    """
    every, classes, edges = _classes(docs, k, percent)
    ids = every.where("fp is not null and doc_id is not null")
    several = ids.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").select("doc_id", "a")
    edges = edges.unionByName(ids.join(several, "doc_id").where("key <> a").select("a", F.col("key").alias("b")))
    named = _rooted(classes, edges)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("m"), F.sum("copies").alias("c"))
    joined = named.join(least.where("m > 1 or c > 1").drop("m", "c"), "root").select("fp", "component_id")
    own = every.join(joined, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    if not several.limit(1).count():
        return own
    # A repeated doc_id may have rows without words beside others: all its rows are in one component.
    lone = own.where("n_shingles = 0").join(several.select(F.col("doc_id").alias("d")).distinct(), F.col("doc_id") == F.col("d"), "left_semi")
    return own if not lone.limit(1).count() else _one_component_each(own)


def _one_component_each(own: DataFrame) -> DataFrame:
    least = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"))
    return own.join(least, "doc_id", "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def one_of_each_group(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group that links join: that of the least doc_id, of equal ids that of the least text hash.

    Rows are told apart by their texts here, so texts that share a doc_id but no link stay both; a row that is there several
    times stays once (of rows that differ in further columns, that of the least hash). Rows without words and rows
    without a doc_id are linked with nothing and stay. Texts count whole, an empty table gives an empty
    result, all columns stay, whatever their names.
    """
    every, classes, edges = _classes(docs, k, percent)
    ids = every.where("fp is not null and doc_id is not null")
    named = _rooted(classes, edges).select("fp", "root")
    rows = materialize(ids.join(named, "fp").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c")), "rows")
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    told = rows.join(first, "root").withColumn("stays", F.struct("doc_id", "text_hash") == F.col("first"))
    goes = materialize(told.where("not stays").select("doc_id", "text_hash"), "copies")
    name, mark = free_name(docs.columns, "join_id"), free_name(docs.columns, "join_hash")
    marked = docs.withColumns({name: F.col("doc_id").cast("long"), mark: F.xxhash64("text")})
    by = lambda t: (F.col(name) == F.col(f"{t}.doc_id")) & (F.col(mark) == F.col(f"{t}.text_hash"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Rows that can't be among those that go stay where they are; a null doc_id is among none.
    may = free_name(marked.columns, "join_may")
    told_of = marked_among(marked, [name, mark], goes, ["doc_id", "text_hash"], may)
    stays = told_of.where(~F.col(may)).drop(may).unionByName(told_of.where(F.col(may)).drop(may).join(goes.alias("goes"), by("goes"), "left_anti"))
    again = materialize(told.where("stays and c > 1").select("doc_id", "text_hash"), "again")
    if not again.limit(1).count():
        return stays.select(*columns)
    hashed = free_name(docs.columns, "join_row")
    several = marked.withColumn(hashed, row_hash(docs)).join(again.alias("again"), by("again"), "left_semi")
    one = several.groupBy(name, mark).agg(F.min_by(F.struct(*columns), F.col(hashed)).alias("all")).select("all.*")
    return stays.join(again.alias("again"), by("again"), "left_anti").select(*columns).unionByName(one)


#: Pairs of rows that share a shingle, links by their counts, components by reach; for small tables.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT r, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
s AS (SELECT DISTINCT r, array_to_string(x, ' ') AS x FROM (SELECT r, n, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x FROM u) WHERE len(x) = least(n, 4)),
n AS (SELECT w.r, w.doc_id, coalesce(c, 0)::BIGINT AS n FROM w LEFT JOIN (SELECT r, count(*) AS c FROM s GROUP BY r) k ON k.r = w.r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT DISTINCT na.doc_id AS a, nb.doc_id AS b FROM p JOIN n na ON na.r = p.a JOIN n nb ON nb.r = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c) AND na.doc_id IS NOT NULL AND nb.doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM n WHERE doc_id IS NOT NULL UNION SELECT g.a, l.b FROM g JOIN l ON l.a = g.b)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n LEFT JOIN (SELECT a, min(b) AS component_id FROM g GROUP BY a) m ON m.a = n.doc_id
"""
