"""Benchmark decontamination: windows as long as the items, found by SimHash in Hamming blocks.

For every item length in the benchmark, the windows of that many words of every
document are compared with the items of that length by the exact weighted Jaccard
similarity of their five-word shingles. A shorter text is one window as a whole.

A window can only reach the similarity if most of its shingles are shingles of items of
its length. A bitmap of fixed size over shingle hashes finds the windows for which that
may be so; a full bitmap would let more windows pass, but never miss one. Windows that
follow each other travel as one row.

These windows get SimHash fingerprints of 64 bits, cut into four blocks of 16 bits. Two
fingerprints within a distance of 11 are within 2 in one block at least, so the items'
blocks are listed with all values up to 2 bits away and meet the windows' own blocks:
no pair within the radius is missed.

Similar windows can lie beyond the radius (at a similarity of 0.8 the mean distance is 9 to
10). The exact way for the rest: of n shingles that have to share k, each numbered as often as
it stands there and sorted, one of the first n - k + 1 is shared among the first of the other
side, too. The order puts shingles that few items have first (a second bitmap of fixed size
tells), so that a preamble of many items brings none of them together. Pairs that met by
fingerprint are not met again. All pairs are verified on their words.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.llm.words import WordHashes, grams, in_batches, mix, rows_of
from streamjobs.session import written

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints up to this distance apart meet in one of the blocks.
RADIUS = 11
_BLOCKS, _BLOCK_BITS = 4, 16
_REACH = RADIUS // _BLOCKS  # some block of two such fingerprints is no further apart
#: Shingles of more items than this come last in the order of tokens.
FREQUENT = 64
#: Bits of the map of benchmark shingles, whatever the size of the benchmark.
MAP_BITS = 1 << 26
_PAGE = 32768  # bits of one row of the map, as Spark's bitmap functions have it
_RUN = 64  # at least so many windows that follow each other are one row
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_WINDOW = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()),
                     ("need", pa.int32()), ("prints", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("words", pa.string())])
_WINDOW_DDL = "doc_id long, text_hash long, start int, n_words int, need int, prints array<long>, tokens array<long>, words string"


def plain_words(text: str | None) -> list[str]:
    """Lower-case words without ASCII signs at their ends."""
    return [w for x in (text or "").lower().split() if (w := x.strip(_EDGE))]


def _hashes(words: list[str], cache: WordHashes) -> np.ndarray:
    return cache.of([w.encode("utf-8", "surrogatepass") for w in words])


def window_shingles(hashes: np.ndarray, n_words: int) -> np.ndarray:
    """Shingle hashes for windows of ``n_words``; short windows are one shingle."""
    return grams(hashes, min(SHINGLE, n_words))


def per_window(n_words: int) -> int:
    return n_words - min(SHINGLE, n_words) + 1


def _of_length(shingle_hashes: np.ndarray, n_words: int) -> np.ndarray:
    return mix(shingle_hashes ^ (np.uint64(n_words * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))


def fingerprints(shingle_hashes: np.ndarray, n: int) -> np.ndarray:
    """SimHash of every run of ``n`` shingles: the signs of the sums of their bits as +1 and -1."""
    bits = np.unpackbits(shingle_hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int32) * 2 - 1, axis=0, out=sums[1:])
    ones = (sums[n:] - sums[:-n]) > 0
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def common(n: int, m: int, similarity: float) -> int:
    """Least number of shingles that sets of ``n`` and ``m`` share if they are so similar."""
    return math.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def first_tokens(shingle_hashes: np.ndarray, count: int, frequent: np.ndarray) -> np.ndarray:
    """The first ``count`` of the numbered shingles, those of few items first: equal ones differ by how many came before."""
    held = np.sort(shingle_hashes)
    at = np.arange(len(held))
    new = np.concatenate([[True], held[1:] != held[:-1]])
    number = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    tokens = mix(held + number * np.uint64(0x9E3779B97F4A7C15))
    return tokens[np.lexsort((tokens, _has(frequent, held)))][:count]


def _has(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set in a bitmap."""
    at = hashes % np.uint64(MAP_BITS)
    return held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1) > 0


def near_blocks(fingerprint: int) -> np.ndarray:
    """Block values up to ``_REACH`` bits away from those of a fingerprint, each with its block's number above them."""
    size = (1 << _BLOCK_BITS) - 1
    return np.concatenate([_MASKS ^ (fingerprint >> b * _BLOCK_BITS & size) | b << _BLOCK_BITS for b in range(_BLOCKS)])


_MASKS = np.array([sum(1 << k for k in bits) for n in range(_REACH + 1) for bits in combinations(range(_BLOCK_BITS), n)], np.int64)


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with words: id, length, words and bits of the two maps, the shingles' own and those of the length."""
    schema = pa.schema([("item_id", pa.int64()), ("n_words", pa.int32()), ("words", pa.string()),
                        ("bits", pa.list_(pa.int64())), ("own", pa.list_(pa.int64()))])

    def run(batches):
        cache = WordHashes()

        def each():
            for item_id, text in rows_of(batches, "item_id", "text"):
                words = plain_words(text)
                if words:
                    found = window_shingles(_hashes(words, cache), len(words))
                    own, of_length = (np.unique(h % np.uint64(MAP_BITS)).astype(np.int64) for h in (found, _of_length(found, len(words))))
                    yield item_id, len(words), " ".join(words), np.union1d(own, of_length), own

        return in_batches(each(), schema, weight=lambda r: 8 * len(r[3]))

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "item_id long, n_words int, words string, bits array<long>, own array<long>")


def _ready(items: DataFrame, frequent: np.ndarray, similarity: float) -> DataFrame:
    """``_item, n_words, tokens, print, blocks``: first tokens, fingerprint and near block values of the items."""
    schema = pa.schema([("_item", pa.int64()), ("n_words", pa.int32()), ("tokens", pa.list_(pa.int64())), ("print", pa.int64()),
                        ("blocks", pa.list_(pa.int64()))])
    shared = items.sparkSession.sparkContext.broadcast(frequent)  # of fixed size

    def run(batches):
        cache = WordHashes()

        def each():
            for item, words in rows_of(batches, "_item", "words"):
                words = words.split(" ")
                found = window_shingles(_hashes(words, cache), len(words))
                least = math.ceil(similarity * len(found) - 1e-9)  # in common with any window, however short
                own = fingerprints(found, len(found))
                yield (item, len(words), first_tokens(found, len(found) - least + 1, shared.value).view(np.int64),
                       own.view(np.int64)[0], near_blocks(int(own[0])))

        return in_batches(each(), schema, weight=lambda r: 8 * len(r[2]) + 8 * len(r[4]))

    return items.select("_item", "words").mapInArrow(
        run, "_item long, n_words int, tokens array<long>, print long, blocks array<long>")


def _map_of(bits: DataFrame) -> np.ndarray:
    """A bitmap of the numbers in column ``bit``, put together by Spark page by page."""
    bit = F.col("bit") + 1  # Spark counts positions from one
    pages = (bits.groupBy(F.bitmap_bucket_number(bit).alias("page"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("map")).collect())
    full = np.zeros(MAP_BITS // 8, np.uint8)
    for row in pages:
        low = (row["page"] - 1) * _PAGE // 8
        full[low:low + _PAGE // 8] = np.frombuffer(row["map"], np.uint8)
    return full


def _windows(docs: DataFrame, lengths: list[int], bitmap: np.ndarray, frequent: np.ndarray, similarity: float) -> DataFrame:
    """Runs of windows that may be similar to an item: start of the first, least shared shingles, fingerprints, first tokens, words."""
    shared = docs.sparkSession.sparkContext.broadcast((bitmap, frequent))  # of fixed size
    needs = [(n, per_window(n), common(per_window(n), per_window(n), similarity)) for n in lengths]

    def enough(hits: np.ndarray, n: int, need: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hits)])
        return np.flatnonzero(total[n:] - total[:-n] >= need)

    def run(batches):
        (held, often), cache = shared.value, WordHashes()

        def each():
            for doc_id, text_hash, text in rows_of(batches, "doc_id", "text_hash", "text"):
                words = plain_words(text)
                hashes = _hashes(words, cache)
                by_size: dict = {}
                for n_words, n, need in needs:
                    size = min(SHINGLE, n_words)
                    if size not in by_size:
                        found = grams(hashes, size)
                        hits = _has(held, found)
                        by_size[size] = found, hits, int(hits.sum())
                    found, hits, most = by_size[size]
                    if len(found) < n:  # a text shorter than the item
                        n, need = len(found), common(len(found), n, similarity)
                    if not n or most < need or not len(enough(hits, n, need)):
                        continue
                    own = np.zeros(len(found), bool)
                    at = np.flatnonzero(hits)
                    own[at] = _has(held, _of_length(found[at], n_words))
                    starts = enough(own, n, need)
                    breaks = np.flatnonzero(np.diff(starts) > 1) + 1
                    most_starts = max(_RUN, n_words)
                    for whole in np.split(starts, breaks):
                        for low in range(0, len(whole), most_starts):
                            a, b = int(whole[low]), int(whole[min(low + most_starts, len(whole)) - 1])
                            tokens = np.unique(np.concatenate([first_tokens(found[k:k + n], n - need + 1, often) for k in range(a, b + 1)]))
                            prints = np.unique(fingerprints(found[a:b + n], n))
                            yield (doc_id, text_hash, a, n_words, need, prints.view(np.int64), tokens.view(np.int64),
                                   " ".join(words[a:b + n_words]))

        return in_batches(each(), _WINDOW, weight=lambda r: 8 * len(r[5]) + 8 * len(r[6]) + len(r[7]))

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return texts.filter("text is not null").mapInArrow(run, _WINDOW_DDL)


def weighted_similarity(left: list[str], right: list[str]) -> float:
    """Weighted Jaccard similarity of the shingles, each as often as it stands there."""
    a, b = (Counter(tuple(w[i:i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) for w in (left, right))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def best_window(words: list[str], size: int, item: list[str]) -> tuple[float, int]:
    """The first of the most similar windows of ``size`` words: :func:`weighted_similarity` with ``item``, and start."""
    wanted = Counter(tuple(item[i:i + SHINGLE]) for i in range(max(1, len(item) - SHINGLE + 1)))
    n, n_item, shared, best = per_window(size), wanted.total(), 0, (-1.0, 0)
    width, held = min(SHINGLE, size), Counter()
    every = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    for i, shingle in enumerate(every):
        held[shingle] += 1
        shared += held[shingle] <= wanted[shingle]
        if i >= n:
            gone = every[i - n]
            shared -= held[gone] <= wanted[gone]
            held[gone] -= 1
        if i >= n - 1 and (found := shared / max(1, n + n_item - shared)) > best[0]:
            best = found, i - n + 1
    return best


def _met_by_fingerprint(windows: DataFrame, ready: DataFrame) -> DataFrame:
    """``_run, _item`` of all pairs of a window of the run and an item of its length within the radius."""
    size = (1 << _BLOCK_BITS) - 1
    own = F.transform(F.sequence(F.lit(0), F.lit(_BLOCKS - 1)), lambda b: F.call_function(
        "shiftright", F.col("_print"), b * _BLOCK_BITS).bitwiseAND(F.lit(size)) + b * (size + 1))
    cut = (windows.select("_run", "n_words", F.explode("prints").alias("_print"))
                  .select("_run", "n_words", "_print", F.explode(own).alias("_block")))
    near = ready.select("_item", "n_words", "print", F.explode("blocks").alias("_block"))
    apart = F.bit_count(F.col("_print").bitwiseXOR(F.col("print")))
    return cut.join(near, ["n_words", "_block"]).filter(apart <= RADIUS).select("_run", "_item")


def _met_by_tokens(windows: DataFrame, ready: DataFrame) -> DataFrame:
    """``_run, _item`` of all pairs that can be similar at any distance: the exact way for what lies beyond the radius."""
    wanted = ready.select("_item", "n_words", F.posexplode("tokens").alias("_rank", "_token"))
    # The item's own first tokens are fewer, the more the two have to share.
    size = F.col("n_words") - F.least(F.lit(SHINGLE), "n_words") + 1
    return (windows.select("_run", "n_words", "need", F.explode("tokens").alias("_token")).join(wanted, ["n_words", "_token"])
                   .filter(F.col("_rank") <= size - F.col("need")).select("_run", "_item"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_hash, item_id, similarity, start, n_words, distance, by_fingerprint``: items found in documents, best window each.

    ``benchmark`` has ``item_id`` and ``text``. A pair of window and item counts if their weighted
    similarity is at least ``similarity``; ``distance`` is that of their fingerprints, and ``by_fingerprint``
    says whether window and item met by their blocks or by the exact way for the rest. A text shorter
    than the item is its one window, with its own ``n_words``. Of equally good windows the first
    counts. Words are folded and lose signs at their ends; texts and items without words match
    nothing. Rows of one doc_id and text are reported as one; a row without doc_id is reported with
    null. Empty tables give no rows.
    """
    items = written(_items(benchmark).withColumn("_item", F.monotonically_increasing_id()), "items")
    lengths = sorted(r["n_words"] for r in items.select("n_words").distinct().collect())
    often = items.select(F.explode("own").alias("bit")).groupBy("bit").count().filter(F.col("count") > FREQUENT)
    frequent = _map_of(often.select("bit"))
    ready = written(_ready(items, frequent, similarity), "items-ready")
    bitmap = _map_of(items.select(F.explode("bits").alias("bit")))
    windows = written(_windows(docs, lengths, bitmap, frequent, similarity).withColumn("_run", F.monotonically_increasing_id()), "windows")

    first = _met_by_fingerprint(windows, ready).withColumn("_way", F.lit(0))
    rest = _met_by_tokens(windows, ready).withColumn("_way", F.lit(1))
    met = first.union(rest).groupBy("_run", "_item").agg((F.min("_way") == 0).alias("by_fingerprint"))
    near = (met.join(windows.select("_run", "doc_id", "text_hash", "start", "n_words", "words"), "_run")
               .join(items.select("_item", "item_id", F.col("words").alias("_words")), "_item"))
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
                        ("start", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32()), ("by_fingerprint", pa.bool_())])

    def verify(batches):
        cache = WordHashes()

        def fingerprint(words: list[str]) -> int:
            found = window_shingles(_hashes(words, cache), len(words))
            return int(fingerprints(found, len(found))[0])

        def each():
            for *key, start, n_words, left, right, by_fingerprint in rows_of(
                    batches, "doc_id", "text_hash", "item_id", "start", "n_words", "words", "_words", "by_fingerprint"):
                left, right = left.split(" "), right.split(" ")
                n_words = min(n_words, len(left))
                found, at = best_window(left, n_words, right)
                if found >= similarity:
                    apart = fingerprint(left[at:at + n_words]) ^ fingerprint(right)
                    yield *key, found, start + at, n_words, apart.bit_count(), by_fingerprint

        return in_batches(each(), schema)

    verified = near.select("doc_id", "text_hash", "item_id", "start", "n_words", "words", "_words", "by_fingerprint").mapInArrow(
        verify, "doc_id long, text_hash long, item_id long, similarity double, start int, n_words int, distance int, by_fingerprint boolean")
    return (verified.groupBy("doc_id", "text_hash", "item_id")
                    .agg(F.min(F.struct((-F.col("similarity")).alias("_far"), "start", "similarity", "n_words", "distance", "by_fingerprint"))
                          .alias("_best"))
                    .select("doc_id", "text_hash", "item_id", "_best.similarity", "_best.start", "_best.n_words", "_best.distance",
                            "_best.by_fingerprint"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every document and item found in it, see :func:`contaminated`."""
    return contaminated(docs, benchmark).drop("text_hash")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, in which no benchmark item is found."""
    found = written(contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
                    .distinct(), "contaminated")
    names, places = docs.columns, [f"_{i}" for i in range(len(docs.columns))]
    doc_id, text = (F.col(places[names.index(c)]) for c in ("doc_id", "text"))
    same = doc_id.cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    return docs.toDF(*places).join(found, same, "left_anti").toDF(*names)
