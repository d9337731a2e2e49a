"""Language identification by bit-sliced Bloom filters over character n-grams.

Each language has a Bloom filter of its frequent n-grams; all share size and hash functions and are stored
as slices: word ``i`` holds bit ``i`` of every language's filter. An n-gram's words, ANDed, are the mask of
the languages whose filters hold it. A text's count per language is the number of its n-grams in whose
mask the language is, less what the filter's measured false positive rate explains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import batches_of, crc_of_id, materialize

GRAM = 4
#: Bytes of text handled at once.
CHUNK = 1 << 20
#: Characters of a long text that are hashed at once.
PIECE = 1 << 20
UND = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.uint32(32)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(texts: list[str | None], n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' letter n-grams, the text each belongs to, and whether each text has a letter.

    Letters are lower-cased; a run of other characters is one space; a text begins and ends with a space.
    """
    parts = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    sep = b"\x20\x00\x00\x00"
    chars = np.frombuffer(sep + (sep + sep).join(parts) + sep, np.uint32)
    sizes = np.fromiter((len(p) // 4 + 2 for p in parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    letter = _is_letter()[chars]
    lettered = np.bincount(owner[letter], minlength=len(parts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    keep[1:] |= owner[1:] != owner[:-1]
    c, owner = np.where(letter, chars, _SPACE)[keep].astype(np.uint64), owner[keep]
    if len(c) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int32), lettered
    inside = owner[n - 1 :] == owner[: len(owner) - n + 1]
    return _hash(c, n)[inside], owner[: len(owner) - n + 1][inside], lettered


def _hash(c: np.ndarray, n: int) -> np.ndarray:
    if len(c) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = c[: len(c) - n + 1].copy()
        for i in range(1, n):
            h = h * _ODD + c[i : len(c) - n + 1 + i]
        return _mixed(h)


def hashes_by_piece(texts: list[str | None], n: int = GRAM, piece: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``gram_hashes``, in several parts: texts of more than ``piece`` characters come by themselves, cut at blanks."""
    long = {i for i, t in enumerate(texts) if t and len(t) > piece}
    yield gram_hashes([None if i in long else t for i, t in enumerate(texts)], n)
    for i in sorted(long):
        yield from _pieces_of(texts, i, n, piece)


def _pieces_of(texts: list[str | None], i: int, n: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of one long text, piece by piece: the last n - 1 letters and spaces of a piece begin the next one."""
    text, carried = texts[i], np.array([32], np.uint64)
    letter_of = _is_letter()
    some, end = False, 0
    while end < len(text):
        at, end = end, text.find(" ", end + piece, end + 2 * piece)
        end = min(len(text), at + piece) if end < 0 else end
        chars = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = letter_of[chars]
        some = some or bool(letter.any())
        c = np.concatenate([carried, np.where(letter, chars, _SPACE).astype(np.uint64)])
        if end == len(text):
            c = np.append(c, np.uint64(32))
        c = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]]
        h = _hash(c, n)
        carried = c[-(n - 1) :]
        yield h, np.full(len(h), i, np.int32), np.array([j == i and some for j in range(len(texts))])


@dataclass(frozen=True)
class LanguageModel:
    """Bit-sliced filters: ``planes[p][i]`` holds bit ``i`` of the filters of languages 64p to 64p+63."""

    languages: list[str]
    planes: list[np.ndarray] = field(repr=False)
    false_positive: np.ndarray
    hashes: int
    gram: int

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        """Masks of the languages that hold each n-gram, by plane."""
        size = np.uint64(len(self.planes[0]) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        out = None
        with np.errstate(over="ignore"):
            for k in range(self.hashes):
                at = ((h + np.uint64(k) * step) & size).astype(np.int64)
                words = [p[at] for p in self.planes]
                out = words if out is None else [a & b for a, b in zip(out, words)]
        return out

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected counts (text, language), numbers of n-grams, and whether a text has letters."""
        total, lettered = np.zeros(len(texts)), np.zeros(len(texts), bool)
        hits = np.zeros((len(texts), len(self.languages)))
        for h, owner, own_lettered in hashes_by_piece(texts, self.gram):
            total += np.bincount(owner, minlength=len(texts))
            lettered |= own_lettered
            if len(h):
                for p, mask in enumerate(self.masks(h)):
                    for j in range(min(64, len(self.languages) - 64 * p)):
                        has = (mask >> mask.dtype.type(j)) & mask.dtype.type(1)
                        hits[:, 64 * p + j] += np.bincount(owner, has, len(texts))
        f = self.false_positive
        return np.maximum(0, (hits - total[:, None] * f) / (1 - f)), total, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage of each text.

        Score: the best count's share of the best two. Coverage: the best count's share of all n-grams. No
        letters: ``und``, 0 and 0. Ties go to the language that has more training rows.
        """
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        c, total, lettered = self.counts(texts)
        best = c.argmax(1)
        top = c.max(1)
        second = np.sort(c, 1)[:, -2] if c.shape[1] > 1 else np.zeros(len(texts))
        score = np.where(lettered, np.divide(top, top + second, out=np.zeros(len(top)), where=top > 0), 0)
        cover = np.divide(top, total, out=np.zeros(len(top)), where=lettered & (total > 0))
        return [self.languages[b] if ok else UND for b, ok in zip(best, lettered)], score, np.minimum(cover, 1)


def build_model(languages: list[str], grams: np.ndarray, owners: list[np.ndarray], hashes: int = 4, gram: int = GRAM, bits_per_gram: int = 12) -> LanguageModel:
    """Filters from ``grams``, the hashes, and the boolean row of each language's members among them."""
    most = max([1, *(int(o.sum()) for o in owners)])
    size = 1 << (bits_per_gram * most - 1).bit_length()
    planes = []
    for p in range(0, max(1, len(languages)), 64):
        width = min(64, len(languages) - p)
        planes.append(np.zeros(size, next(t for t, w in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if width <= w)))
    rates = []
    step = (grams >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        at = [((grams + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(hashes)]
    for j, own in enumerate(owners):
        plane, bit = planes[j // 64], planes[j // 64].dtype.type(1 << (j % 64))
        for a in at:
            plane[np.unique(a[own])] |= bit
        rates.append(float(((plane & bit) != 0).mean()) ** hashes)
    return LanguageModel(languages, planes, np.array(rates), hashes, gram)


def fit(docs: DataFrame, rows_per_language: int = 3000, least_share: float = 1e-5, claim: float = 0.25, gram: int = GRAM) -> LanguageModel:
    """Learn from rows ``(doc_id, text, lang)`` with both text and lang.

    Fitting is bounded: of each language, rows are taken by a hash of doc_id so that about
    ``rows_per_language`` remain. A language claims an n-gram that makes ``least_share`` of its n-grams at
    least, so a filter holds ``1 / least_share`` n-grams at most, and at least ``claim`` times the n-gram's
    largest share in any language.
    """
    train = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return LanguageModel([], [np.zeros(1, np.uint8)], np.zeros(0), 1, gram)
    place = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / sizes[k]))])
    drawn = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 20)) < F.element_at(place, F.col("lang")) * float(1 << 20)

    def count(batches):
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                langs = np.array(part.column(1).to_pylist(), object)
                h, owner, _ = gram_hashes(part.column(0).to_pylist(), gram)
                for lang in sorted(set(langs)):
                    g, n = np.unique(h[langs[owner] == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = train.where(drawn).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "langid-grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = [x for x in languages if x in totals]
    if not languages:
        return LanguageModel([], [np.zeros(1, np.uint8)], np.zeros(0), 1, gram)
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, float(totals[k]))]), F.col("lang"))
    shared = counts.withColumn("share", share).where(F.col("share") >= least_share).groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("by"), F.max("share").alias("most"))
    kept = shared.select("gram", F.transform(F.filter("by", lambda x: x["share"] >= claim * F.col("most")), lambda x: x["lang"]).alias("langs")).toArrow()
    grams = kept.column("gram").to_numpy().view(np.uint64)
    owners = {x: np.zeros(len(grams), bool) for x in languages}
    for i, held in enumerate(kept.column("langs").to_pylist()):
        for x in held:
            owners[x][i] = True
    return build_model(languages, grams, [owners[x] for x in languages], gram=gram)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All rows of ``docs(doc_id, text, ...)`` with lang_pred, score and coverage; other columns stay.

    A null text, an empty one and one without letters are ``und`` with score 0. Texts of any length count
    whole, a long one piece by piece; repeated rows get equal results, an empty table gives an empty result.
    Columns of ``docs`` that are called lang_pred, score or coverage are replaced; ``known`` keeps them.
    """
    schema = docs.drop("lang_pred", "score", "coverage").schema
    at = schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                langs, score, cover = model.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(cover)], names=[*part.schema.names, "lang_pred", "score", "coverage"])

    full = StructType([*schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("coverage", DoubleType())])
    return docs.drop("lang_pred", "score", "coverage").mapInArrow(run, full)


def known(docs: DataFrame, model: LanguageModel, least_coverage: float) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language that covers ``least_coverage`` of its n-grams; all columns stay as they are, whatever their names."""
    at = docs.schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                langs, _, cover = model.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([x != UND and c >= least_coverage for x, c in zip(langs, cover)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id", folds: int = 5):
    return crc_of_id(column) % folds == 0
