"""Byte-level BPE over a table: every distinct pre-token of the corpus is encoded once.

Documents come in blocks of neighbouring rows. A block explodes into its distinct
pre-tokens, each with a place number, and every document of the block becomes the
sequence of its places. The pre-tokens are shuffled by the hash of their text, those
of a block with the same hash bucket in one row, so that equal ones of all blocks
meet and are encoded once; their ids go back to the blocks, where the documents are
put together again by position. Decoding looks the ids up in the table of token
bytes, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.llm.words import in_batches, rows_of

#: A block ends with the document that brings it to so many distinct pre-tokens or pre-tokens.
DISTINCT, TOKENS = 200_000, 2_000_000

#: Buckets of pre-tokens for each shuffle partition.
BUCKETS = 4

_WORDS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("places", pa.binary()), ("words", pa.binary())])
_DOCS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("places", pa.binary())])
_IDS = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("ids", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class _Places(dict):
    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


class _Encoded(dict):
    """Ids of pre-tokens as little-endian 32-bit numbers, each encoded when it is first met."""

    def __init__(self, encoder):
        self.encoder = encoder

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = np.array(self.encoder._encode_single_piece(word), "<u4").tobytes()
        return ids


def _packed(numbers: np.ndarray, squeeze) -> bytes:
    """Numbers by byte planes, compressed: frequent pre-tokens have small place numbers."""
    return squeeze.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(raw: bytes, open_up) -> np.ndarray:
    planes = np.frombuffer(open_up.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _strings(pieces: list[bytes], squeeze) -> bytes:
    """Byte strings as one: their number, their lengths, and what they hold."""
    lengths = _packed(np.fromiter(map(len, pieces), np.uint32, len(pieces)), squeeze)
    return len(lengths).to_bytes(8, "little") + lengths + squeeze.compress(b"".join(pieces))


def _pieces(raw: bytes, open_up) -> list[bytes]:
    cut = 8 + int.from_bytes(raw[:8], "little")
    ends = np.cumsum(_unpacked(raw[8:cut], open_up)).tolist()
    held = open_up.decompress(raw[cut:])
    return [held[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _blocks(batches, pattern):
    """Blocks of documents as (number, pre-tokens by falling frequency, [(doc_id, places)]).

    The number is a digest of the block's content; blocks of equal content number their
    pre-tokens alike, so that it does no harm if they meet.
    """
    find = regex.compile(pattern).findall
    places, docs, tokens = _Places(), [], 0

    def ended():
        everything = np.concatenate([p for _, p in docs])
        digest = xxhash.xxh3_64("\0".join(places).encode("utf-8", "surrogatepass"))
        digest.update(everything.tobytes())
        block = digest.intdigest() - (1 << 63)
        count = np.bincount(everything, minlength=len(places))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(places)
        return block, [words[i] for i in order.tolist()], [(d, rank[p]) for d, p in docs]

    for doc_id, text in rows_of(batches, "doc_id", "text"):
        found = find(text or "")
        docs.append((doc_id, np.fromiter(map(places.__getitem__, found), np.int64, len(found)).astype(np.int32)))
        tokens += len(found)
        if len(places) >= DISTINCT or tokens >= TOKENS:
            yield ended()
            places, docs, tokens = _Places(), [], 0
    if docs:
        yield ended()


def _words(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)

        def each():
            for block, held, _ in _blocks(batches, pattern):
                raw = [w.encode("utf-8", "surrogatepass") for w in held]
                bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")  # places rise within a bucket
                for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if len(places):
                        gaps = np.diff(places, prepend=0)
                        yield int(bucket[places[0]]), block, _packed(gaps, squeeze), _strings([raw[i] for i in places.tolist()], squeeze)

        return in_batches(each(), _WORDS, weight=lambda r: len(r[3]))

    return docs.mapInArrow(run, "bucket int, block long, places binary, words binary")


def _sequences(docs: DataFrame, pattern: str) -> DataFrame:
    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        rows = ((b, d, _packed(p, squeeze)) for b, _, held in _blocks(batches, pattern) for d, p in held)
        return in_batches(rows, _DOCS, weight=lambda r: len(r[2]))

    return docs.mapInArrow(run, "block long, doc_id long, places binary")


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` for every row: token ids of the whole text, and the bytes these ids stand for.

    ``ranks`` is the path of a rank file on the driver, ``pattern`` splits a text into the
    pieces that are encoded each for itself; there are no special tokens. A null or empty
    text has no ids and decodes to no bytes. Rows without doc_id and rows that repeat one
    come back each; an empty table gives no rows. Rows are read in the order of doc_id
    and text within their partition, so that a task run anew makes the same blocks.
    """
    import tiktoken

    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(Path(ranks).read_bytes())  # as large as the vocabulary
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    slim = slim.sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encoded(batches):
        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(raw.value), special_tokens={})
        squeeze, open_up = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        current, known = None, _Encoded(encoder)

        def each():
            nonlocal current, known
            for bucket, block, places, words in rows_of(batches, "bucket", "block", "places", "words"):
                if bucket != current:  # equal pre-tokens are in one bucket
                    current, known = bucket, _Encoded(encoder)
                yield block, places, _strings([known[w] for w in _pieces(words, open_up)], squeeze)

        return in_batches(each(), _IDS, weight=lambda r: len(r[2]))

    def together(batches):
        table = {rank: token for token, rank in read_ranks(raw.value).items()}
        token_bytes = [table.get(i, b"") for i in range(max(table, default=-1) + 1)]
        open_up = zstandard.ZstdDecompressor()
        current, known = None, []

        def each():
            nonlocal current, known
            for block, ids, doc_id, places in rows_of(batches, "block", "ids", "doc_id", "places"):
                if block != current:
                    current, known = block, []
                at = _unpacked(places, open_up)
                if ids is not None:
                    at = np.cumsum(at).tolist()
                    known += [None] * (at[-1] + 1 - len(known))
                    for i, piece in zip(at, _pieces(ids, open_up), strict=True):
                        known[i] = piece
                    continue
                found = np.frombuffer(b"".join(map(known.__getitem__, at.tolist())), "<u4")
                yield doc_id, found.view(np.int32), b"".join(map(token_bytes.__getitem__, found.tolist()))

        return in_batches(each(), _OUT, weight=lambda r: 4 * len(r[1]) + len(r[2]))

    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = (_words(slim, pattern, buckets).repartition("bucket").sortWithinPartitions("bucket")
             .mapInArrow(encoded, "block long, places binary, ids binary"))
    rows = words.unionByName(_sequences(slim, pattern), allowMissingColumns=True)
    # The ids of a block come before its documents.
    return (rows.repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
                .mapInArrow(together, "doc_id long, ids array<int>, decoded binary"))
