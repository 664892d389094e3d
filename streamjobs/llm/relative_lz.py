"""Repeated passages between documents: relative Lempel-Ziv factors against reference blocks.

A passage counts from ``WINDOW`` words on. Of every window the run of ``ANCHOR``
words with the smallest hash is its anchor, so that equal windows have equal
anchors. The index keeps of every anchor the first document (smallest doc_id)
and the number of documents. What stands around its shared anchors in a first
document is a reference block. A later document with such anchors is factored
greedily against the block: the longest match from the next matching window on
is a factor, and parsing goes on at the first window that crosses the factor's
end, so that no window at a boundary is left out. A window that its anchor's
first document does not have may still stand in another earlier document; those
windows, which all documents agree on, are settled by their full word sequence.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.llm.words import WordHashes, grams, in_batches, rows_of, signed, words_of
from streamjobs.session import written

WINDOW, ANCHOR = 13, 7
#: Ids are prefiltered by this many hash buckets before a join with texts; so many rows are broadcast at most.
BUCKETS = 1 << 20

_READ = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("digest", pa.binary()), ("whole", pa.string()),
                   ("anchors", pa.list_(pa.int64()))])
_BLOCKS = pa.schema([("doc_id", pa.int64()), ("many", pa.list_(pa.int64())), ("block", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("start", pa.int32()), ("stop", pa.int32()),
                    ("key", pa.binary())])
_SPANS = "array<struct<start:int,stop:int>>"


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def anchors_of(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor hash at every word that starts one, and the place of the anchor of every window."""
    runs = grams(hashes, anchor)
    if len(hashes) < window:
        return runs, np.empty(0, np.int64)
    ahead = sliding_window_view(runs, window - anchor + 1)
    return runs, ahead.argmin(axis=1) + np.arange(len(ahead))


def _read(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches):
        hashes = WordHashes()

        def each():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                words = words_of(text)
                runs, places = anchors_of(hashes.of(words), window, anchor)
                found = signed(np.unique(runs[np.unique(places)])) if len(places) and doc_id is not None else []
                yield doc_id, len(words), _digest(words), _sha256(words), found

        return in_batches(each(), _READ, weight=lambda r: 8 * len(r[4]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, digest binary, whole string, anchors array<long>")


def _bucket(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents that share a bucket with one of ``ids``; the filter runs before any shuffle."""
    buckets = written(ids.select(_bucket(ids.columns[0]).alias("_bucket")).distinct(), "buckets")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null")
    return (texts.withColumn("_bucket", _bucket("doc_id"))
                 .join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket"))


def _reference_blocks(wanted: DataFrame, window: int, anchor: int) -> DataFrame:
    """From (doc_id, anchors, many, text of the first document): the words around those anchors in it."""
    def run(batches):
        hashes = WordHashes()
        last, words, runs = None, [], None

        def each():
            nonlocal last, words, runs
            for doc_id, anchors, many, text in rows_of(batches, "doc_id", "anchors", "many", "text"):
                if text != last:
                    last, words = text, words_of(text)
                    runs = signed(grams(hashes.of(words), anchor))
                at = np.flatnonzero(np.isin(runs, np.array(anchors, np.int64)))
                parts, start, stop = [], 0, 0
                for p in at.tolist():  # windows of this anchor reach so far to both sides
                    low, high = max(0, p - (window - anchor)), p + window
                    if low > stop or not parts:
                        parts.append([low, high])
                    parts[-1][1] = stop = high
                if parts:
                    yield doc_id, many, b"\n".join(b" ".join(words[a:b]) for a, b in parts)

        return in_batches(each(), _BLOCKS, weight=lambda r: len(r[2]))

    return wanted.mapInArrow(run, "doc_id long, many array<long>, block binary")


class Reference:
    """A block's words and the first place of every window in it. Runs of words never match across their ends."""

    def __init__(self, block: bytes, hashes: WordHashes, window: int):
        self.words: list = []
        keys, places = [], []
        for run in block.split(b"\n"):
            words = run.split()
            found = grams(hashes.of(words), window)
            keys.append(found)
            places.append(np.arange(len(found)) + len(self.words))
            self.words += [*words, None]
        self.keys, first = np.unique(np.concatenate(keys), return_index=True)
        self.places = np.concatenate(places)[first]

    def factors(self, words: list[bytes], keys: np.ndarray, window: int) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Factors of at least ``window`` words as (start, stop), and which windows of ``words`` the block has."""
        if not len(self.keys) or not len(keys):
            return [], np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        has = self.keys[at] == keys
        hits, found, k = np.flatnonzero(has), [], 0
        while k < len(hits):
            i = int(hits[k])
            p, n = int(self.places[at[i]]), 0
            while i + n < len(words) and self.words[p + n] == words[i + n]:
                n += 1
            if n < window:  # equal hashes of other words
                has[i] = False
                k += 1
                continue
            found.append((i, i + n))
            k = int(np.searchsorted(hits, i + n - window + 1))  # the first window across the factor's end
        return found, has


def _parsed(asked: DataFrame, window: int, anchor: int) -> DataFrame:
    """Factors as word spans (key null), and the windows that are still open (key: their words' digest)."""
    def run(batches):
        hashes = WordHashes()
        last, words, digest, own, keys, runs, places = None, [], b"", None, None, None, None

        def each():
            nonlocal last, words, digest, own, keys, runs, places
            for doc_id, many, block, text in rows_of(batches, "doc_id", "many", "block", "text"):
                if text != last:
                    last, words = text, words_of(text)
                    own, digest = hashes.of(words), _digest(words)
                    keys = grams(own, window)
                    runs, places = anchors_of(own, window, anchor)
                found, has = Reference(block, hashes, window).factors(words, keys, window)
                for start, stop in found:
                    yield doc_id, digest, start, stop, None
                if many and len(places):
                    open_ones = np.isin(signed(runs)[places], np.array(many, np.int64)) & ~has
                    for i in np.flatnonzero(open_ones).tolist():
                        yield doc_id, digest, i, i + window, _digest(words[i:i + window])

        return in_batches(each(), _FOUND, size=20_000)

    return asked.mapInArrow(run, "doc_id long, digest binary, start int, stop int, key binary")


def _merged(spans: Column) -> Column:
    """Spans in order, overlapping and touching ones as one."""
    nothing = F.lit(None).cast(_SPANS)
    ordered = F.array_sort(spans)

    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["stop"]),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.when(spans.isNull(), nothing).otherwise(F.aggregate(ordered, F.array().cast(_SPANS), add))


def _repeats(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What was read of each document, the first document of each word sequence, and the spans of the other documents."""
    if anchor > window:
        raise ValueError("an anchor is no longer than a window")
    read = written(_read(docs, window, anchor), "read")
    first = written(read.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node")), "first")

    found = read.select("doc_id", F.explode("anchors").alias("hash"))
    shared = written(found.groupBy("hash").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("_last"),
                                               F.count(F.lit(1)).alias("n"))
                          .filter("m < _last").select("hash", "m", (F.col("n") > 2).alias("many")), "index")
    later = found.join(shared, "hash").filter("doc_id > m")
    pairs = later.groupBy("doc_id", "m").agg(F.collect_list("hash").alias("anchors"),
                                             F.collect_list(F.when(F.col("many"), F.col("hash"))).alias("many"))
    pairs = written(pairs.join(first.select("node").distinct(), F.col("doc_id") == F.col("node"), "left_semi"), "pairs")

    references = _texts(docs, pairs.select("m")).withColumnRenamed("doc_id", "m")
    blocks = written(_reference_blocks(pairs.join(references, "m").select("doc_id", "anchors", "many", "text"),
                                       window, anchor), "blocks")
    texts = _texts(docs, pairs.select("doc_id"))
    parsed = written(_parsed(blocks.join(texts, "doc_id").select("doc_id", "many", "block", "text"), window, anchor), "parsed")
    open_ones = parsed.filter("key is not null")
    earliest = written(open_ones.groupBy("key").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("_last"))
                                .filter("m < _last").select("key", "m"), "earliest")
    elsewhere = open_ones.join(earliest, "key").filter("doc_id > m")
    columns = ["doc_id", "digest", "start", "stop"]
    spans = (parsed.filter("key is null").select(*columns).union(elsewhere.select(*columns))
                   .groupBy("doc_id", "digest")
                   .agg(_merged(F.collect_list(F.struct("start", "stop"))).alias("spans")))
    return read, first, written(spans, "spans")


def _keep(words: list, spans: list) -> list:
    kept, at = [], 0
    for span in spans:
        kept += words[at:span["start"]]
        at = span["stop"]
    return kept + words[at:]


def repeat_report(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    A word goes if a run of ``window`` words that covers it also starts in a document with
    a smaller doc_id; runs are judged on the input. Words are ``[^\\x20\\x09-\\x0D]+``,
    unchanged; the digest is that of the kept words joined by one space. A null or empty text
    has no words. A row without doc_id neither gives nor loses words. Rows of one doc_id are
    each other's equals: neither makes the other's words go. An empty table gives no rows.
    """
    read, first, spans = _repeats(docs, window, anchor)

    def run(batches):
        schema = pa.schema([("_id", pa.int64()), ("_digest", pa.binary()), ("removed", pa.int64()), ("sha", pa.string())])

        def each():
            for doc_id, digest, cut, text in rows_of(batches, "doc_id", "digest", "spans", "text"):
                words = words_of(text)
                if _digest(words) == digest:  # a repeated doc_id may have another text
                    kept = _keep(words, cut)
                    yield doc_id, digest, len(words) - len(kept), _sha256(kept)

        return in_batches(each(), schema)

    cut = (spans.join(_texts(docs, spans.select("doc_id")), "doc_id").select("doc_id", "digest", "spans", "text")
                .mapInArrow(run, "_id long, _digest binary, removed long, sha string").dropDuplicates(["_id", "_digest"]))
    cut = written(cut, "cut")
    slim = read.select("doc_id", "n_words", "digest", "whole").join(first, "digest", "left")
    both = slim.join(cut, (slim["doc_id"] == cut["_id"]) & (slim["digest"] == cut["_digest"]), "left")
    copy = F.coalesce((F.col("doc_id") > F.col("node")) & (F.col("n_words") >= window), F.lit(False))
    return both.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(text: str, spans: list) -> str:
    """The text without the words of ``spans`` and the white space between and after them."""
    raw, kept, at = text.encode("utf-8", "surrogatepass"), [], 0
    places = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    for span in spans:
        kept.append(raw[at:places[span["start"]]])
        at = places[span["stop"]]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with all its columns, without the words that :func:`repeat_report` counts as removed.

    White space of what stays is unchanged, and so are texts that lose nothing; ``n_chars``,
    if there is such a column, is counted anew where a text changes.
    """
    read, first, spans = _repeats(docs, window, anchor)
    slim = read.select("doc_id", "n_words", "digest").join(first, "digest").filter("n_words > 0").distinct()
    whole = (slim.filter((F.col("doc_id") > F.col("node")) & (F.col("n_words") >= window))
                 .select("doc_id", "digest", F.array(F.struct(F.lit(0).alias("start"),
                                                              F.col("n_words").cast("int").alias("stop"))).alias("spans")))
    own = spans.join(whole.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti")
    cuts = written(own.unionByName(whole).groupBy("doc_id").agg(
        F.collect_list(F.struct("digest", "spans")).alias("_cuts")), "cuts").withColumnRenamed("doc_id", "_cut_id")

    @F.udf("string", useArrow=True)
    def cut(text, wanted):
        digest = _digest(words_of(text))
        spans = [c["spans"] for c in wanted or [] if bytes(c["digest"]) == digest]
        return cut_text(text, spans[0]) if spans else text

    # Columns go by their place, so that no name of the table can clash.
    names, places = docs.columns, [f"_{i}" for i in range(len(docs.columns))]
    key, text = (places[names.index(c)] for c in ("doc_id", "text"))
    joined = docs.toDF(*places).join(cuts, F.col(key).cast("long") == F.col("_cut_id"), "left")
    hit = F.col("_cut_id").isNotNull() & F.col(text).isNotNull()
    joined = joined.withColumn("_new", cut(F.when(hit, F.col(text)), "_cuts"))
    columns = [F.col(c).alias(n) for c, n in zip(places, names, strict=True)]
    columns[names.index("text")] = F.when(hit, F.col("_new")).otherwise(F.col(text)).alias("text")
    if "n_chars" in names:
        old = F.col(places[names.index("n_chars")])
        new = F.length("_new").cast(docs.schema["n_chars"].dataType)
        columns[names.index("n_chars")] = F.when(hit, new).otherwise(old).alias("n_chars")
    return joined.select(*columns)
