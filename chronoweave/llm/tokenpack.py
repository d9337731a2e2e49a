"""Token ids in a binary format: fixed-width bit packing in blocks.

A block is ``BPK1``, its body's length, then the body: width, number of documents, number of ids, the
doc_ids (with a validity byte each), the offsets of the documents' first ids, and the ids, each in the
fewest bits that hold the vocabulary, packed from the least significant bit. A file is a sequence of
blocks, each with a line feed after it (Spark's text writer adds it; readers go by lengths).
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, materialize, scratch_path

MAGIC = b"BPK1"
#: Ids after which a block is closed, and blocks in a file.
BLOCK_IDS = 1 << 17
FILE_BLOCKS = 128
#: Pieces whose ids a task keeps; only speed depends on it.
MEMO_PIECES = 250_000
CHUNK = 1 << 21
#: Letters of ASCII and Latin-1, then marks that are no part of a contraction or special token: two pieces of the tokenizer, which ignores case.
_PLAIN = r"^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,!?:;|#$&%*]*)$"
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[.,!?:;|#$&%*]+")
# What a tokenizer must declare for its words' ids to be its texts' ids. Others encode whole texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTS = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_WORD_END = "</w>"
_encoders: dict[str, Encoder] = {}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of ``width`` bits each (1 to 32), from the least significant bit of the first byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from id ``start`` on: each is a shift of the 8 bytes at its first bit; only their bytes are read."""
    if not count:
        return np.empty(0, np.uint32)
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count, start * width // 8).astype(np.uint32)
    first = start * width
    low = first // 8
    raw = np.frombuffer(data, np.uint8)[low : (first + count * width + 7) // 8]
    raw = np.concatenate([raw, np.zeros(8, np.uint8)])
    at = first - low * 8 + np.arange(count, dtype=np.int64) * width
    byte = at // 8
    wide = np.zeros(count, np.uint64)
    for i in range(5):
        wide |= raw[byte + i].astype(np.uint64) << np.uint64(8 * i)
    return ((wide >> (at % 8).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    offsets = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    body = struct.pack("<BIQ", width, len(ids), int(offsets[-1]))
    body += np.array([x is not None for x in doc_ids], np.uint8).tobytes() + np.array([x or 0 for x in doc_ids], "<i8").tobytes() + offsets.tobytes() + pack(flat, width)
    return MAGIC + struct.pack("<Q", len(body)) + body


class Block:
    """A block opened for random access: ``ids(i)`` unpacks document ``i`` alone."""

    def __init__(self, body) -> None:
        self.width, self.documents, self.count = struct.unpack_from("<BIQ", body)
        at = 13
        held = np.frombuffer(body, np.uint8, self.documents, at)
        at += self.documents
        ids = np.frombuffer(body, "<i8", self.documents, at)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(ids, held)]
        at += 8 * self.documents
        self.offsets = np.frombuffer(body, "<u8", self.documents + 1, at).astype(np.int64)
        self.packed = memoryview(body)[at + 8 * (self.documents + 1) :]

    def ids(self, i: int) -> np.ndarray:
        return unpack(self.packed, self.width, int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i]))


def read_blocks(data) -> Iterator[Block]:
    at, view = 0, memoryview(data)
    while at < len(view):
        if bytes(view[at : at + 4]) != MAGIC:
            raise ValueError(f"no block at byte {at}")
        (n,) = struct.unpack_from("<Q", view, at + 4)
        yield Block(view[at + 12 : at + 12 + n])
        at += 13 + n


def is_word_wise(declared: dict) -> bool:
    """Whether a tokenizer's file declares that white space is dropped, that neither normaliser, splits nor added tokens reach across it, and that words end in a mark."""
    model = declared.get("model") or {}
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or t.get("single_word") or len(t["content"].split()) != 1 for t in declared.get("added_tokens") or [])
    return plain and declared.get("normalizer") == _NORMALIZER and declared.get("pre_tokenizer") == _PARTS and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and model.get("end_of_word_suffix") == _WORD_END


class Encoder:
    """The ids of whole texts; of a word-wise tokenizer, by its own ids of the words between blanks.

    Such a tokenizer drops white space, and neither its normaliser nor its splits reach across blanks, so a
    text's ids are its words' ids in order. Any other tokenizer encodes the texts whole. A batch's words are told apart by Arrow's dictionaries, a plain
    word is parted into its letters and the marks after them, pieces met before are not encoded again, and
    the ids of all words are gathered at once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_wise = is_word_wise(json.loads(Path(path).read_text("utf-8")))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(_WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        """Slot ``i`` holds ``ids[bounds[i]:bounds[i + 1]]``; slot 0 is the empty piece."""
        self.slots: dict[str, int] = {"": 0}
        self.ids, self.bounds = np.empty(0, "<u4"), np.zeros(2, np.int64)

    def _encoded(self, pieces: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids and how many each has. Plain ones, which the tokenizer does not part, are one text, cut after each end-of-word id."""
        if plain:
            ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(pieces):
                return ids, np.diff(cuts, prepend=0)
        each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for own in each for i in own], "<u4"), np.fromiter(map(len, each), np.int64, len(each))

    def _learn(self, pieces: list[str]) -> None:
        parts: tuple[list[str], list[str]] = ([], [])
        for x in pieces:
            parts[_PIECE.fullmatch(x) is not None].append(x)
        ids, sizes = [self.ids], []
        for plain, own in enumerate(parts):
            for i in range(0, len(own), 256):
                found, size = self._encoded(own[i : i + 256], bool(plain))
                ids.append(found)
                sizes.append(size)
        first = len(self.slots)
        self.slots.update(zip(parts[0] + parts[1], range(first, first + len(pieces))))
        self.ids = np.concatenate(ids)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes))])

    def _slots_of(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if new := [x for x in names if x not in self.slots]:
            self._learn(new)
        return np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        import pyarrow.compute as pc

        if not self.word_wise:
            own = texts if isinstance(texts, list) else texts.to_pylist()
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t or "" for t in own], add_special_tokens=False)]
        if len(self.slots) > MEMO_PIECES:
            self._forget()
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        head, tail = pc.extract_regex(words, pattern=_PLAIN).flatten()
        head = self._slots_of(pc.coalesce(pc.utf8_lower(head), words))
        tail = self._slots_of(pc.fill_null(tail, ""))
        # each word's ids are those of two slots; first for the distinct words, then for all
        ids, ends = _gather(self.ids, self.bounds, np.stack([head, tail], 1).reshape(-1))
        ids, ends = _gather(ids, ends[::2], index)
        at = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _gather(values: np.ndarray, bounds: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[bounds[i]:bounds[i + 1]]`` of all ``picks``, side by side, and their bounds."""
    sizes = (bounds[1:] - bounds[:-1])[picks]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    at = np.repeat(bounds[picks] - ends[:-1], sizes) + np.arange(ends[-1])
    return values[at], ends


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs(doc_id, text)`` and write it in ascending doc_id order (null first), ``end_id`` after each document.

    The rows are range-partitioned by doc_id, rows that share one by a hash of the text, so files in the order
    of their numbers are in order and no doc_id is hot. A null or empty text is its end id alone; rows that
    repeat a doc_id follow each other; texts of any length are one document of a block. doc_id must be a number.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.setdefault(tokenizer, None) or Encoder(tokenizer)
        _encoders[tokenizer] = encoder  # a reused worker keeps what it has met
        width = bits_for(encoder.tokenizer.get_vocab_size(with_added_tokens=True))
        end = np.array([end_id], "<u4")
        names, ids, n = [], [], 0
        for batch in batches:
            for part in batches_of(batch, "text", CHUNK):
                for name, own in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                    names.append(name)
                    ids.append(np.concatenate([own, end]))
                    n += len(own) + 1
                    if n >= block_ids:
                        yield pa.RecordBatch.from_arrays([pa.array([write_block(names, ids, width)], pa.binary())], names=["block"])
                        names, ids, n = [], [], 0
            pa.default_memory_pool().release_unused()
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([write_block(names, ids, width)], pa.binary())], names=["block"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("place"))
    ranged = keyed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    blocks = ranged.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of packed files: part, piece, doc_id, start within the file, n_tokens, ids_crc32."""
    schema = pa.schema([("path", pa.string()), ("file_ids", pa.int64()), ("doc_id", pa.int64()), ("file_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, start = content.as_buffer(), 0
                for block in read_blocks(data):
                    flat = unpack(block.packed, block.width, 0, block.count).astype("<u4")
                    crcs = [zlib.crc32(flat[a:b]) for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())]
                    n = block.documents
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path_] * n, pa.string()), pa.array([block.count] + [0] * (n - 1), pa.int64()), pa.array(block.doc_ids, pa.int64()), pa.array(start + block.offsets[:-1]), pa.array(np.diff(block.offsets)), pa.array(crcs, pa.int64())], schema=schema
                    )
                    start += block.count

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, "path string, file_ids long, doc_id long, file_start long, n_tokens long, ids_crc32 long")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.regexp_extract(name, r"^part-(\d+)-", 1).cast("long").alias("part"), F.regexp_extract(name, r"-c(\d+)", 1).cast("long").alias("piece"), "file_ids", "doc_id", "file_start", "n_tokens", "ids_crc32")


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write ``docs(doc_id, text)`` packed, read the files and place each document among all ids: doc_id, start, n_tokens, ids_crc32.

    A file's first id is the sum of the files before it, over one row per file. An empty table gives an
    empty result; further columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "packed")
    write_packed(docs, path, tokenizer, end_id)
    rows = materialize(read_packed(spark, path), "packed-index")
    totals = rows.groupBy("part", "piece").agg(F.sum("file_ids").alias("n"))
    firsts = totals.select("part", "piece", (F.sum("n").over(Window.orderBy("part", "piece")) - F.col("n")).alias("first"))
    return rows.join(firsts, ["part", "piece"]).select("doc_id", (F.col("first") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")
