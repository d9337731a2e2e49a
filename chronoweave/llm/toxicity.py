"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicon terms (a seed list, and words and beginnings of words that labelled toxic texts hold
far more often; inflected words share their beginning) and patterns. The label model is a tree-augmented mixture: given the hidden label, each voter fires with a
probability that depends on the label and on the one voter it is most correlated with. EM estimates these
from the votes of all rows; in its steps a labelled row's label counts as one more, very reliable, vote. The
posteriors that the model then gives the votes alone train a logistic regression over the voters' counts, which
scores all texts. Terms are counted and votes cast on executors; the driver gets counts and votes, no text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import batches_of, crc_of_id, drop_stored, materialize

# Seed words of abuse in four languages.
SEED_WORDS = """
idiot moron loser trash scum clown stupid pathetic worthless disgusting dumb fool jerk bastard vermin filth garbage
ugly hate kill shut imbecile freak creep coward liar rat pig maggot parasite degenerate
crétin salaud connard abruti débile ordure minable imbécile
dumm dummkopf trottel arschloch abschaum versager mistkerl
idiota estúpido imbécil basura escoria cerdo asqueroso perdedor
""".split()
#: A fold of FOLDS is held out: rows with this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
CHUNK = 1 << 22
#: Letters of a beginning of words, and how often a term may have to occur before it votes.
STEM_LETTERS = (3, 12)
MOST_LEAST = 3
#: Words of a shingle by which copies are told.
SHINGLE = 5
_apart = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))
PATTERNS = {
    "shouting": re.compile(r"(?:\b[A-Z]{3,}\b\W+){4}"),
    "exclaiming": re.compile(r"!{2,}"),
    "masked": re.compile(r"\b[a-zA-Z]+\*+[a-zA-Z]+\b"),
    "stretched": re.compile(r"([a-zA-Z])\1{3,}"),
    "you are": re.compile(r"(?i)\byou(?:'re| are)\b"),
    "nobody": re.compile(r"(?i)\bnobody\b|\bshut up\b|\bgo away\b"),
}


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_apart).split()


@dataclass(frozen=True)
class Voters:
    """Lexicon and patterns. A term is a word, or with a star at its end the beginning of words; it votes if it occurs ``least`` times."""

    lexicon: list[str]
    least: list[int]
    patterns: list[str] = field(default_factory=lambda: list(PATTERNS))

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How often each term occurs in each text, and whether each pattern does."""
        words: dict[bytes, int] = {}
        stems: dict[bytes, int] = {}
        for j, term in enumerate(self.lexicon):
            (stems if term.endswith("*") else words)[term.rstrip("*").encode()] = j
        sizes = sorted({len(x) for x in stems})
        heads = {x[: sizes[0]] for x in stems} if sizes else set()
        held: dict[bytes, list[int]] = {w: [j] for w, j in words.items()}
        seen: set[bytes] = set()
        out = np.zeros((len(texts), len(self.lexicon) + len(self.patterns)), np.float32)
        for i, text in enumerate(texts):
            own = words_in(text)
            distinct = set(own)
            if stems:
                new = distinct - seen
                seen |= new
                for w in new:
                    if w[: sizes[0]] in heads and (begun := [stems[w[:n]] for n in sizes if w[:n] in stems and n <= len(w)]):
                        held.setdefault(w, []).extend(begun)
            if found := held.keys() & distinct:
                for w, n in Counter(w for w in own if w in found).items():
                    for j in held[w]:
                        out[i, j] += n
            for j, name in enumerate(self.patterns, len(self.lexicon)):
                out[i, j] = PATTERNS[name].search(text or "") is not None
        return out

    def fires(self, counts: np.ndarray) -> np.ndarray:
        return counts >= np.r_[np.array(self.least, np.float32), np.ones(len(self.patterns), np.float32)]


def _terms(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [w, *(w[:n] + "*" for n in range(STEM_LETTERS[0], min(STEM_LETTERS[1], len(w)) + 1))]


def _gain(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio statistic of terms in ``c1`` of n1 and ``c0`` of n0 texts; 0 where the former are not the more frequent."""
    out = np.zeros(len(c1))
    for seen, n in ((c1, n1), (c0, n0), (n1 - c1, n1), (n0 - c0, n0)):
        both = c1 + c0 if seen is c1 or seen is c0 else n1 + n0 - c1 - c0
        out += 2 * seen * np.log(np.maximum(seen, 1e-9) * (n1 + n0) / (np.maximum(both, 1e-9) * n))
    return np.where(c1 * n0 > c0 * n1, out, 0)


def copy_mark(text: str | None) -> int:
    """The least shingle hash of a text: copies of one text mostly share it."""
    words = words_in(text)
    return min(zlib.crc32(b" ".join(words[i : i + SHINGLE])) for i in range(max(1, len(words) - SHINGLE + 1)))


class TermCounts:
    """How often words and their beginnings occur in texts; with ``wanted``, only those."""

    def __init__(self, wanted: dict[str, int] | None = None) -> None:
        self.wanted, self.made = wanted, {}

    def of(self, text: str | None) -> Counter:
        out: Counter = Counter()
        for w, n in Counter(words_in(text)).items():
            if (terms := self.made.get(w)) is None:
                if len(self.made) > 1 << 18:
                    self.made.clear()
                terms = self.made[w] = [t for t in _terms(w) if self.wanted is None or t in self.wanted]
            for t in terms:
                out[t] += n
        return out

    def holders(self, texts: list[str | None]) -> Counter:
        """How many of the texts hold each term."""
        held: Counter = Counter()
        for text in texts:
            held.update(self.of(text).keys())
        return held

    def table(self, texts: list[str | None], toxic: list[int]) -> np.ndarray:
        """(label, occurrences less one, term): how many texts hold a wanted term so often at least."""
        by = np.zeros((2, MOST_LEAST, len(self.wanted)), np.int64)
        for text, y in zip(texts, toxic):
            found = self.of(text)
            at = np.fromiter((self.wanted[t] for t in found), np.int64, len(found))
            often = np.fromiter(found.values(), np.int64, len(found))
            for k in range(MOST_LEAST):
                by[y, k, at[often > k]] += 1
        return by


def _bounds(candidates: int, least: int, n1: int, n0: int) -> tuple[float, int]:
    """The least gain of a term that is no chance among so many candidates, and how many toxic texts have to hold it to reach that."""
    bound = 2 * np.log(max(2, MOST_LEAST * candidates))
    return bound, max(least, int(np.ceil(bound / (2 * np.log((n1 + n0) / n1)))))


def _chosen(wanted: dict[str, int], by: np.ndarray, n1: int, n0: int, bound: float, least: int, ratio: float, most: int) -> list[tuple[str, int]]:
    gains = np.array([np.where((by[1, k] >= least) & (by[1, k] * n0 >= ratio * by[0, k] * n1), _gain(by[1, k], by[0, k], n1, n0), 0) for k in range(MOST_LEAST)])
    best, gain = gains.argmax(0), gains.max(0, initial=0)
    names = sorted((t for t, j in wanted.items() if gain[j] >= bound), key=lambda t: (-round(gain[wanted[t]], 6), -len(t.rstrip("*")), t.endswith("*"), t))
    kept: list[tuple[str, int]] = []
    stems, beginnings = set(), set()
    for t in names:
        base = t.rstrip("*")
        if len(kept) == most or any(base[:n] in stems for n in range(1, len(base) + 1)) or (t.endswith("*") and base in beginnings):
            continue
        kept.append((t, int(best[wanted[t]]) + 1))
        beginnings.update(base[:n] for n in range(1, len(base) + 1))
        if t.endswith("*"):
            stems.add(base)
    return kept


def mine_terms(texts: list[str | None], toxic: np.ndarray, least: int = 3, ratio: float = 4.0, most: int = 200) -> list[tuple[str, int]]:
    """Terms and how often they must occur: those most telling of toxic texts, by a likelihood ratio test.

    Candidates are all words and beginnings of words that ``least`` toxic texts hold, with one to
    MOST_LEAST occurrences. Copies of a toxic text tell no more than one of them, so those that share their
    least shingle hash count once. A term must be ``ratio`` times as frequent in toxic texts, and pass a bound that
    grows with the number of candidates, so that chance passes none. Of terms that begin with each other the
    most telling one stays, and the longest of equals; ``most`` stay at most.
    """
    bad = list({copy_mark(t): t for t, y in reversed(list(zip(texts, toxic))) if y == 1}.values())
    good = [t for t, y in zip(texts, toxic) if y != 1]
    n1, n0 = len(bad), len(good)
    if not n1 or not n0:
        return []
    held = TermCounts().holders(bad)
    bound, least = _bounds(sum(n >= least for n in held.values()), least, n1, n0)
    wanted = {t: j for j, t in enumerate(sorted(t for t, n in held.items() if n >= least))}
    by = TermCounts(wanted).table([*bad, *good], [1] * n1 + [0] * n0)
    return _chosen(wanted, by, n1, n0, bound, least, ratio, most)


def mine_terms_of(rows: DataFrame, least: int = 3, ratio: float = 4.0, most: int = 200) -> list[tuple[str, int]]:
    """``mine_terms`` of ``rows(text, toxic)`` on executors; the driver gets terms and counts. Of copies that of the least text hash counts."""

    def marked(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([copy_mark(t) for t in batch.column(0).to_pylist()], pa.int64())], names=["text", "mark"])

    bad = rows.where("toxic = 1").select("text").mapInArrow(marked, "text string, mark long").groupBy("mark").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    counted = materialize(bad.select("text", F.lit(1).alias("y")).unionByName(rows.where("toxic = 0").select("text", F.lit(0).alias("y"))), "toxicity-counted")
    n1, n0 = counted.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    if not n1 or not n0:
        drop_stored(counted)
        return []

    def holders(batches):
        count, held = TermCounts(), Counter()
        for batch in batches:
            held.update(count.holders(batch.column(0).to_pylist()))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    held = materialize(counted.where("y = 1").select("text").mapInArrow(holders, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "toxicity-terms")
    bound, least = _bounds(held.count(), least, n1, n0)
    wanted = {t: j for j, t in enumerate(sorted(r["term"] for r in held.where(F.col("n") >= least).select("term").collect()))}

    def tables(batches):
        count = TermCounts(wanted)
        by = np.zeros((2, MOST_LEAST, len(wanted)), np.int64)
        for batch in batches:
            by += count.table(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        at = np.flatnonzero(by)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(by.reshape(-1)[at], pa.int64())], names=["at", "n"])

    by = np.zeros(2 * MOST_LEAST * len(wanted), np.int64)
    if wanted:
        found = counted.select("text", "y").mapInArrow(tables, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        by[found.column("at").to_numpy()] = found.column("n").to_numpy()
    drop_stored(counted, held)
    return _chosen(wanted, by.reshape(2, MOST_LEAST, len(wanted)), n1, n0, bound, least, ratio, most)


class LabelModel:
    """P(label), and P(voter fires | label, its parent voter), by EM.

    The parents form a maximum spanning tree over the voters' mutual information given the label (the
    correlations); voters that seldom fire keep to themselves.
    """

    def __init__(self, rounds: int = 25, smoothing: float = 0.5) -> None:
        self.rounds, self.smoothing = rounds, smoothing

    def fit(self, votes: np.ndarray, labels: np.ndarray, trust: float = 0.97) -> LabelModel:
        """``votes``: 0 or 1 (row, voter). ``labels``: 1, 0, or -1 if unknown; known ones are right with probability ``trust``."""
        v = votes.astype(float)
        known = labels >= 0
        start = np.clip(np.where(v.sum(1) > 0, 0.3, 0.02), 0, 1)
        q = np.where(known, np.where(labels == 1, trust, 1 - trust), start)
        self.parent = np.full(v.shape[1], -1)
        for step in range(self.rounds):
            self._maximise(v, q)
            if step == 3:
                self.parent = self._tree(v, q)
                self._maximise(v, q)
            p = self.posterior(votes)
            prior = np.where(labels == 1, trust, np.where(labels == 0, 1 - trust, 0.5))
            q = p * prior / (p * prior + (1 - p) * (1 - prior))
        return self

    def _maximise(self, v: np.ndarray, q: np.ndarray) -> None:
        s, w = self.smoothing, np.stack([1 - q, q])
        self.prior = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
        self.fires = np.empty((2, 2, v.shape[1]))  # label, parent's vote, voter
        base = (w @ v + s) / (w.sum(1, keepdims=True) + 2 * s)
        for j, p in enumerate(self.parent):
            if p < 0:
                self.fires[:, :, j] = base[:, j, None]
                continue
            for u in (0, 1):
                on = w * (v[:, p] == u)
                self.fires[:, u, j] = (on @ v[:, j] + 4 * s * base[:, j]) / (on.sum(1) + 4 * s)

    def _tree(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        n = v.shape[1]
        info = np.zeros((n, n))
        for w in (1 - q, q):
            total = w.sum()
            both = (v * w[:, None]).T @ v / total
            one = np.diag(both)
            for a, pa_ in ((1, one), (0, 1 - one)):
                for b, pb in ((1, one), (0, 1 - one)):
                    joint = np.clip(both if a and b else one[:, None] - both if a else one[None] - both if b else 1 - one[:, None] - one[None] + both, 1e-9, 1)
                    info += total / len(v) * joint * np.log(joint / np.clip(pa_[:, None] * pb[None], 1e-9, 1))
        parent, reach, best = np.full(n, -1), np.full(n, 1e-3), np.full(n, -1)
        left = set(range(n))
        while left:  # Prim's algorithm; below the least gain a voter starts a tree of its own
            j = max(left, key=lambda x: (reach[x], -x))
            parent[j] = best[j]
            left.discard(j)
            better = info[j] > reach
            reach[better], best[better] = info[j][better], j
        return self._acyclic(parent)

    @staticmethod
    def _acyclic(parent: np.ndarray) -> np.ndarray:
        for j in range(len(parent)):
            seen, x = set(), j
            while x >= 0:
                if x in seen:
                    parent[j] = -1
                    break
                seen.add(x)
                x = parent[x]
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(int)
        seen = np.where(self.parent >= 0, v[:, self.parent], 0)
        log = np.empty((2, len(v)))
        columns = np.arange(v.shape[1])
        for y in (0, 1):
            p = self.fires[y, seen, columns]
            log[y] = np.log(self.prior if y else 1 - self.prior) + np.log(np.where(v == 1, p, 1 - p)).sum(1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression on soft labels, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    b = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return b


@dataclass(frozen=True)
class ToxicityModel:
    voters: Voters
    weights: np.ndarray

    def features(self, counts: np.ndarray) -> np.ndarray:
        fires = self.voters.fires(counts)
        terms = fires[:, : len(self.voters.lexicon)]
        total = (counts[:, : len(self.voters.lexicon)] * terms).sum(1)
        return np.c_[fires, total > 0, total > 1, np.log1p(total)].astype(float)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = self.features(self.voters.counts(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def voters_of(mined: dict[str, int]) -> Voters:
    terms = list(dict.fromkeys([*SEED_WORDS, *mined]))
    return Voters(terms, [mined.get(t, 1) for t in terms])


def learn_from(counts: np.ndarray, labels: np.ndarray, voters: Voters) -> ToxicityModel:
    """From the voters' counts in rows with labels 1, 0 or -1 (unknown). Without rows the seed lexicon alone votes."""
    model = ToxicityModel(voters, np.empty(0))
    if not len(counts):
        x = model.features(counts)
        w = np.zeros(x.shape[1] + 1)
        w[-1], w[-2], w[-3], w[-4] = -4, 1, 1, 3
        return ToxicityModel(voters, w)
    votes = voters.fires(counts)
    p = LabelModel().fit(votes, labels).posterior(votes)  # of the votes alone: a row's own label has no part in it
    return ToxicityModel(voters, logistic(model.features(counts), p, np.ones(len(p))))


def learn(texts: list[str | None], labels: np.ndarray) -> ToxicityModel:
    """From texts with labels 1, 0 or -1 (unknown)."""
    known = labels >= 0
    voters = voters_of(dict(mine_terms([t for t, k in zip(texts, known) if k], labels[known])))
    return learn_from(voters.counts(texts), labels, voters)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = 20_000, unlabelled_rows: int = 5_000) -> DataFrame:
    """``(doc_id, text, toxic)`` of the documents to learn from: ``rows`` labelled ones and ``unlabelled_rows`` others at most, those least by a hash of doc_id; toxic is null for the others.

    A doc_id with several labels is toxic if one says so; null labels and ids teach nothing. Rows that repeat a
    doc_id all count, up to the bounds.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = lambda seed: F.xxhash64(F.col("doc_id"), F.lit(seed))
    drawn = marks.orderBy(by_hash(1), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    known = texts.join(F.broadcast(drawn), "doc_id").orderBy(by_hash(1), "doc_id", F.xxhash64("text")).limit(rows)  # of `rows` rows at most
    # ids first: drawing among the texts themselves would gather far more of them than are kept
    others = texts.select("doc_id").join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_anti").distinct().orderBy(by_hash(3), "doc_id").limit(unlabelled_rows)
    more = texts.join(F.broadcast(others), "doc_id").orderBy(by_hash(3), "doc_id", F.xxhash64("text")).limit(unlabelled_rows)
    return known.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).unionByName(more.select("doc_id", "text", F.lit(None).cast("int").alias("toxic")))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000, unlabelled_rows: int = 5_000) -> ToxicityModel:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, as far as ``training_rows`` go. Texts stay on executors."""
    train = materialize(training_rows(docs, labels, rows, unlabelled_rows), "toxicity-rows")
    voters = voters_of(dict(mine_terms_of(train.where("toxic is not null").select("text", "toxic"))))

    def cast(batches):
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                counts = voters.counts(part.column(0).to_pylist())
                at = [np.flatnonzero(x) for x in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(at, pa.list_(pa.int32())), pa.array([x[i] for x, i in zip(counts, at)], pa.list_(pa.float32()))], names=["toxic", "place", "at", "n"]
                )

    votes = train.select("text", "toxic", F.xxhash64("doc_id", "text").alias("place")).mapInArrow(cast, "toxic int, place long, at array<int>, n array<float>").toArrow().sort_by([("place", "ascending"), ("toxic", "ascending")])
    counts = np.zeros((votes.num_rows, len(voters.lexicon) + len(voters.patterns)), np.float32)
    for row, at, n in zip(counts, votes.column("at").to_pylist(), votes.column("n").to_pylist()):
        row[at] = n
    drop_stored(train)
    return learn_from(counts, np.array([-1 if y is None else y for y in votes.column("toxic").to_pylist()], np.int64), voters)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, score, predicted)`` of each row of ``docs(doc_id, text)``; empty and null texts get the score of no votes.

    Texts count whole, whatever their length; repeated rows get equal scores, a null doc_id stays null, an empty
    table gives an empty result; further columns, whatever their names, are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                s = model.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def held_out(column: str = "doc_id"):
    return crc_of_id(column) % FOLDS == HELD_OUT
