"""Words, word hashes and shingles of whole texts, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_LIMIT = 200_000  # cached words per task; the cache starts anew beyond it
_MIX = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8; ``lower`` folds A-Z only. Null has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """64-bit hashes of words, each computed once while the cache holds it."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every run of ``size`` word hashes, in order; none if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mix(out * _MIX + hashes[k:k + n])
    return mix(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Shingle hashes in order; a shorter, non-empty sequence is one shingle."""
    if len(hashes) >= size:
        return grams(hashes, size)
    return grams(hashes, len(hashes)) if len(hashes) else np.empty(0, np.uint64)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the long column Spark has for them."""
    return values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)


def drawn(key: Column, n: Column, sample: int) -> Column:
    """Whether a row is among about ``sample`` of ``n`` rows, by the hash of its key; all are if there are no more."""
    h = F.xxhash64(key)
    # The low 20 bits and the high 32 as a fraction: 52 bits, exact as a double.
    place = F.pmod(h, F.lit(1 << 20)) + F.shiftrightunsigned(h, 32) / F.lit(float(1 << 32))
    return place < F.lit(float(1 << 20)) * sample / n


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, some hundred rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, weight=None, most: int = 8 << 20):
    """Tuples as Arrow batches of at most ``size`` rows or about ``most`` bytes, as ``weight`` counts them."""
    held, heavy = [], 0
    for row in rows:
        held.append(row)
        heavy += weight(row) if weight else 0
        if len(held) >= size or heavy >= most:
            yield _batch(held, schema)
            held, heavy = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
