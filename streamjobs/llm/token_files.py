"""Token files: the ids of many documents as one array, document ends as an Elias-Fano sequence.

Layout of a file, all integers little-endian:

* ids of the documents one after another, 2 or 4 bytes each;
* doc_ids, 8 bytes each, and one byte each that is 0 where a doc_id is null;
* the ends of the documents (ids up to and with each one): the low bits of every
  end packed to 64-bit words, the high bits in unary (a one at ``high + i`` for
  the i-th end) in 64-bit words, and for every 256th one its place;
* a trailer: magic, bytes per id, low bits, documents, ids, words of each part.

The i-th end is found by going to the sampled one before it and counting ones from
there, so that the index needs about 2 bits and the low bits per document.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamjobs.llm.words import in_batches, rows_of
from streamjobs.session import fresh_path, written

MAGIC = b"TOKEF001"
SAMPLE = 256
END_ID = 2
_TRAILER = "<8s7Q"  # magic, bytes per id, low bits, documents, ids, words of low, high, samples
_FILES = pa.schema([("path", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


class EliasFano:
    """A rising sequence of integers below ``universe + 1`` with access by position."""

    def __init__(self, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray, size: int):
        self.low_bits, self.low, self.high, self.samples, self.size = low_bits, low, high, samples, size

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 64) // 64 * 64 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        rests = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        flat = np.zeros((n * low_bits + 63) // 64 * 64, np.uint8)
        flat[:n * low_bits] = rests.ravel()
        return cls(low_bits, np.packbits(flat, bitorder="little").view("<u8"), high,
                   ones[::SAMPLE].astype("<u8"), n)

    def select(self, i: int) -> int:
        """Place of the i-th one in the high bits, from the sample before it."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word, here = place // 64, int(self.high[place // 64]) >> (place % 64) << (place % 64)
        while True:
            count = here.bit_count()
            if left < count:
                for _ in range(left):
                    here &= here - 1
                return word * 64 + (here & -here).bit_length() - 1
            left -= count
            word += 1
            here = int(self.high[word])

    def __getitem__(self, i: int) -> int:
        value, at = 0, i * self.low_bits
        if self.low_bits:
            word, shift = at // 64, at % 64
            both = int(self.low[word]) | (int(self.low[word + 1]) << 64 if word + 1 < len(self.low) else 0)
            value = both >> shift & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | value


def index_bytes(ends: np.ndarray) -> tuple[EliasFano, bytes]:
    index = EliasFano.of(ends)
    return index, index.low.tobytes() + index.high.tobytes() + index.samples.tobytes()


class TokenFile:
    """A token file opened for random access; ``source`` is a seekable Arrow file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        trailer = struct.calcsize(_TRAILER)
        source.seek(size - trailer)
        magic, self.width, low_bits, self.n_docs, self.n_ids, *words = struct.unpack(_TRAILER, source.read(trailer))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(self.n_ids * self.width)
        ids = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        known = np.frombuffer(source.read(self.n_docs), np.uint8)
        self.doc_ids = [d if k else None for d, k in zip(ids.tolist(), known.tolist(), strict=True)]
        parts = [np.frombuffer(source.read(8 * n), "<u8") for n in words]
        self.ends = EliasFano(low_bits, *parts, self.n_docs)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def ids(self, i: int, start: int | None = None) -> tuple[np.ndarray, int]:
        """The ids of the i-th document, its end id last, and where they end; ``start`` if it is known."""
        end = self.ends[i]
        if start is None:
            start = self.bounds(i)[0]
        self.source.seek(start * self.width)
        return np.frombuffer(self.source.read((end - start) * self.width), f"<u{self.width}").astype("<u4"), end


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark takes it for, so that tasks do not look for it on their own disks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


_TAIL = ".,;:!?#$%&*|"
#: Letters whose lower case is not that of each sign for itself go the long way.
_ODD = re.compile("[\u0130\u03a3]")


def _byte_signs() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for signs from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(256 + k) for k in range(256))
    return [chr(b) if b in printable else next(others) for b in range(256)]


class _Words:
    """Ids of runs of letters as the model merges them."""

    def __init__(self, tokenizer):
        self.tokenize, self.sign = tokenizer.model.tokenize, _byte_signs().__getitem__

    def merged(self, word: str) -> list[int]:
        folded = word.lower()
        if not folded.isascii():
            folded = "".join(map(self.sign, unicodedata.normalize("NFC", word).lower().encode()))
        return [t.id for t in self.tokenize(folded)]


class _Letters(dict):
    """Whether a letter stays inside its word: some are taken apart by the tokenizer, or are no letters to it.

    A letter is asked for once: alone and between others it must be encoded as the one word that it is part of.
    """

    #: Letters asked for at the start: Latin ones, which stay as they are in any word of them.
    COMMON = [*map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x180))]

    def __init__(self, tokenizer, words: _Words, common: str | None = None):
        self.tokenizer, self.words = tokenizer, words
        self.plain = "".join(c for c in self.COMMON if self[c]) if common is None else common
        self.common = re.compile(f"[{self.plain}]+" if self.plain else "(?!)").fullmatch

    def __missing__(self, letter: str) -> bool:
        value = self[letter] = letter.isalpha() and not _ODD.search(letter) and all(
            self.tokenizer.encode(word, add_special_tokens=False).ids == self.words.merged(word)
            for word in (letter, f"a{letter}b", f"{letter}{letter}"))
        return value

    def all_in(self, word: str) -> bool:
        """Whether the word, as normalisation leaves it, is one word of the model."""
        return bool(self.common(word)) or word.isalpha() and all(map(self.__getitem__, set(word) | set(unicodedata.normalize("NFC", word))))


class _Pieces(dict):
    """Ids of pieces of text between white space, as bytes; each is encoded once while it is held.

    Letters with signs after them, if any, are merged by the library's model as the two words
    they are; the library encodes all other pieces in full. The letters and the signs are held
    as the pieces that they are when alone, so that no word is held twice.
    """

    LIMIT = 500_000

    def __init__(self, tokenizer, width: int, plain: bool, common: str | None = None):
        self.tokenizer, self.kind, self.plain = tokenizer, {2: "H", 4: "I"}[width], plain
        words = _Words(tokenizer)
        self.merged, self.letters = words.merged, _Letters(tokenizer, words, common)
        self.common = self.letters.common

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_TAIL)
        if self.plain and (self.common(word) or self.letters.all_in(word)):
            value = (self[word] + self[piece[len(word):]] if len(word) < len(piece)
                     else array(self.kind, self.merged(word)).tobytes())
        else:
            value = array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = value
        return value

    def encode(self, text: str) -> bytes:
        if len(self) > self.LIMIT:
            self.clear()
        # str.split also takes these four for white space, the tokenizer does not
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        pieces = re.split("[ \t\n\x0b\x0c\r]+", text) if odd else text.split()
        return b"".join(map(self.__getitem__, pieces))


#: The parts of a tokenizer file under which letters and the signs after them are two words of its model.
_PLAIN = {"normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"],
          "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def is_plain(definition: str) -> bool:
    """Whether a tokenizer file folds, splits and maps its words as :class:`_Words` does."""
    held = json.loads(definition)
    normal = (held.get("normalizer") or {}).get("normalizers", [])
    split = (held.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return ([n["type"] for n in normal] == _PLAIN["normalizer"] and [p["type"] for p in split] == _PLAIN["pre_tokenizer"]
            and split[0]["pattern"] == {"Regex": _PLAIN["pattern"]} and not split[1]["add_prefix_space"])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents to ``folder``, in ascending doc_id order over and within the files.

    ``tokenizer`` is the path of a tokenizer file on the driver; its pre-tokenizer has to drop
    white space, so that the pieces between white space are encoded each for themselves (others
    are refused). Each document ends with ``end_id``; a null or empty text is that id alone.
    Null doc_ids come first, rows of one doc_id in the order of their texts' hashes. A file is
    written under a name of its own and moved to its place when complete, so that a task that is
    run again does no harm. Returns the files: ``path, part, n_docs, n_ids``.
    """
    from tokenizers import Tokenizer

    with open(tokenizer) as source:
        definition = source.read()
    loaded = Tokenizer.from_str(definition)
    both = loaded.encode("a b", add_special_tokens=False).ids
    if both != loaded.encode("a", add_special_tokens=False).ids + loaded.encode(" b\n", add_special_tokens=False).ids:
        raise ValueError("the tokenizer keeps white space")
    width = 2 if max(loaded.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    plain = is_plain(definition)
    folder = qualified(docs.sparkSession, folder)
    common = _Pieces(loaded, width, plain).letters.plain  # asked for once, not by every task
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # as large as the vocabulary

    def run(batches):
        store, root = _folder(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        pieces = _Pieces(Tokenizer.from_str(shared.value), width, plain, common)
        last = np.array([end_id], f"<u{width}").tobytes()
        name, path = f"{root}/.{uuid.uuid4().hex}", f"{root}/part-{part:06d}.tok"
        doc_ids, ends, total, out = [], [], 0, None
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            out = out or store.open_output_stream(name)
            raw = pieces.encode(text or "") + last
            out.write(raw)
            total += len(raw) // width
            doc_ids.append(doc_id)
            ends.append(total)
        if out is None:
            return
        index, packed = index_bytes(np.array(ends, np.uint64))
        out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
        out.write(bytes(d is not None for d in doc_ids))
        out.write(packed)
        out.write(struct.pack(_TRAILER, MAGIC, width, index.low_bits, len(ends), total,
                              len(index.low), len(index.high), len(index.samples)))
        out.close()
        store.move(name, path)
        yield pa.RecordBatch.from_pylist([{"path": path, "part": part, "n_docs": len(ends), "n_ids": total}], schema=_FILES)

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return (slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .mapInArrow(run, "path string, part int, n_docs long, n_ids long"))


def _from_files(files: DataFrame, folder: str, ddl: str, schema: pa.Schema, row: Callable[..., tuple], weight=None) -> DataFrame:
    """``row(doc_id, start, ids)`` of every document; one task reads one file at a time."""
    spark = files.sparkSession
    folder = qualified(spark, folder)
    listed = sorted(files.select("part", "path", "n_ids").collect())
    starts, total = [], 0
    for _, path, n_ids in listed:
        starts.append((path, total))
        total += n_ids

    def run(batches: Iterator[pa.RecordBatch]):
        store, _ = _folder(folder)

        def each():
            for path, before in rows_of(batches, "path", "before"):
                with store.open_input_file(path) as source:
                    held = TokenFile(source)
                    start = 0
                    for i, doc_id in enumerate(held.doc_ids):
                        ids, end = held.ids(i, start)
                        yield row(doc_id, before + start, ids)
                        start = end

        return in_batches(each(), schema, weight=weight)

    table = spark.createDataFrame(starts, "path string, before long")
    return table.repartition(max(1, len(starts)), "path").mapInArrow(run, ddl)


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document in the files that :func:`write_tokens` names.

    ``start`` counts the ids of all documents before it. The file list, one row per file, is
    brought to the driver for the running sum over the files.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _from_files(files, folder, "doc_id long, start long, ids array<int>", schema,
                       lambda doc_id, start, ids: (doc_id, start, ids.view(np.int32)), lambda r: 4 * len(r[2]))


def digests(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files; the checksum is of 32-bit ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return _from_files(files, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", schema,
                       lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.tobytes())))


def token_report(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write all documents to a new folder below the shared one, and digest what the files hold."""
    folder = fresh_path(docs.sparkSession, "tokens")
    return digests(written(write_tokens(docs, tokenizer, folder, end_id), "token-files"), folder)
