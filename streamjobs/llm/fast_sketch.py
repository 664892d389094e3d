"""Near-duplicate documents: fast similarity sketches, banding and exact verification.

A sketch has ``bins`` coordinates. In round i every shingle is thrown into a bin
and gives it the value (i, hash), unless the bin has a smaller one; the rounds
end as soon as all bins are filled. From round ``bins`` on, round i fills bin
i - bins from all shingles, so that ``2 * bins`` rounds always suffice. A
coordinate of two sets agrees with the probability of their Jaccard similarity.

Exact copies (equal shingle sets) are one class from the start. Classes that
agree in a band of the sketch are compared with their neighbour in the sorted
band bucket; neighbours of similarity 0.5 or more form groups, and inside a
group all classes are compared on their full shingle sets, block against
block, as far as links have not joined them before. A bucket in which some
neighbours are less similar is such a group of its own, so that all classes
that share a bucket are compared or joined. Only links that join something
leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.llm.components import components
from streamjobs.llm.words import WordHashes, in_batches, mix, rows_of, shingles, signed, words_of
from streamjobs.operators.ordered import previous_values
from streamjobs.session import written

BINS, ROWS = 96, 4  # 24 bands of 4: a pair of similarity 0.8 shares none with probability 3e-6
GROUP = 0.5  # neighbours at least this similar are compared further
BLOCK = 1024  # classes of a group compared in one task are at most twice as many
_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64(0xFFFFFFFF)
_S32 = np.uint64(32)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The ``bins`` coordinates of a non-empty set of 64-bit hashes."""
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    seeds = _SEEDS if bins == BINS else mix(np.arange(1, 2 * bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    empty = bins
    for i in range(2 * bins):
        h = mix(elements ^ seeds[i])
        value = (np.uint64(i) << _S32) | (h & _LOW)
        if i < bins:
            np.minimum.at(least, ((h >> _S32) * np.uint64(bins) >> _S32).astype(np.int64), value)
        else:
            least[i - bins] = min(least[i - bins], value.min())
        empty = int((least >> _S32 > np.uint64(2 * bins)).sum())
        if not empty:
            break
    return least


def band_keys(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of ``rows`` coordinates; bands never share keys but by chance."""
    bands = coordinates.reshape(-1, rows)
    key = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, k])
    return key


def _set_of(text: str | None, words: int, hashes: WordHashes) -> np.ndarray:
    return np.unique(shingles(hashes.of(words_of(text, lower=True)), words))


def _digest(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                     ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("elements", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per document: the size and digest of its shingle set, and the sketch's band keys (none if empty)."""
    def run(batches):
        hashes = WordHashes()

        def each():
            for doc_id, text_hash, text in rows_of(batches, "doc_id", "text_hash", "text"):
                found = _set_of(text, words, hashes)
                bands = signed(band_keys(sketch(found))) if len(found) and doc_id is not None else []
                yield doc_id, text_hash, len(found), _digest(found), bands

        return in_batches(each(), _SIGNED)

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The full shingle sets of the wanted classes (``node``, ``digest``), one row each."""
    def run(batches):
        hashes = WordHashes()

        def each():
            for node, digest, text in rows_of(batches, "node", "digest", "text"):
                found = _set_of(text, words, hashes)
                if _digest(found) == digest:  # a repeated doc_id may have another text
                    yield node, found.tobytes()

        return in_batches(each(), _SETS, weight=lambda r: len(r[1]))

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string"))
    return (texts.join(wanted, F.col("_id") == F.col("node")).select("node", "digest", "text")
                 .mapInArrow(run, "doc_id long, elements binary").dropDuplicates(["doc_id", "elements"]))


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the exact sizes of intersection and union."""
    def run(batches):
        def each():
            for a, b, left, right in rows_of(batches, "a", "b", "left", "right"):
                left, right = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                shared = _shared(left, right)
                yield a, b, shared, len(left) + len(right) - shared

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("joint", pa.int64())])
        return in_batches(each(), schema)

    left = sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("right"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
                 .mapInArrow(run, "a long, b long, shared long, joint long"))


def _shared(left: np.ndarray, right: np.ndarray) -> int:
    both = np.concatenate([left, right])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _in_blocks(members: DataFrame, percent: int) -> DataFrame:
    """Links that join what ``label`` has not joined, from comparing blocks of a group with each other.

    ``members``: group, doc_id, label, elements, n_blocks, block.
    """
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    # A class stands in each pair of blocks that its own block is part of.
    paired = paired.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                           "block", "doc_id", "label", "elements")

    def run(table: pa.Table) -> pa.Table:
        pair = (table.column("i")[0].as_py(), table.column("j")[0].as_py())
        table = table.sort_by("doc_id")
        ids, labels = table.column("doc_id").to_pylist(), table.column("label").to_pylist()
        blocks = table.column("block").to_numpy()
        found = _joining(ids, labels, [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()],
                         blocks == pair[0], blocks == pair[1], percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()),
                         "b": pa.array([b for _, b in found], pa.int64())}, schema=_LINKS)

    return paired.groupBy("group", "i", "j").applyInArrow(run, "a long, b long")


def _joining(ids, labels, sets, of_left, of_right, percent, width: int = 4096) -> list[tuple[int, int]]:
    """Links between members on the left and on the right that join different labels, without those already joined."""
    left, right = np.flatnonzero(of_left), np.flatnonzero(of_right)
    if len(set(labels)) < 2 or not len(left) or not len(right):
        return []
    sizes = np.array([len(s) for s in sets])
    elements, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column) > 1  # an element of one set only is in no intersection
    at = np.cumsum(often) - 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    columns = [at[c[often[c]]] for c in (column[s:e] for s, e in zip(starts, starts[1:], strict=False))]
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(often.sum()), width):  # columns come in slices, so that memory stays bounded
        slab = np.zeros((len(sets), width), np.float32)
        for k, c in enumerate(columns):
            slab[k, c[np.searchsorted(c, low):np.searchsorted(c, low + width)] - low] = 1
        shared += slab[left] @ slab[right].T
    names = {label: k for k, label in enumerate(dict.fromkeys(labels))}
    own = np.array([names[label] for label in labels])
    joint = sizes[left][:, None] + sizes[right][None, :] - shared
    links = (100 * shared >= percent * joint) & (own[left][:, None] != own[right][None, :])
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for x, y in zip(*np.nonzero(links), strict=True):
        p, q = root(own[left[x]]), root(own[right[y]])
        if p != q:
            parent[max(p, q)] = min(p, q)
            found.append((ids[left[x]], ids[right[y]]))
    return found


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by Jaccard similarity of at least ``percent`` / 100.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Returns, for every
    input row, ``doc_id, n_shingles, component_id, kept``: the size of its set of distinct
    shingles of ``words`` words (A-Z folded; a shorter text is one shingle), the smallest
    doc_id it reaches over links (itself included), and whether that is its own.

    A text that is null or has no words has an empty set and is linked with nothing. A row
    without doc_id is linked with nothing either: its component is null, and it is kept.
    Rows that repeat a doc_id come back once each, judged by their own text; texts whose
    smallest doc_id is the same count as one document. An empty table gives an empty result.
    """
    return _judged(docs, words, percent).drop("text_hash")


def _judged(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """:func:`near_duplicates` with the hash of each row's text."""
    signed_docs = written(signatures(docs, words), "sketches")
    full = signed_docs.filter("doc_id is not null and n_shingles > 0")
    classes = written(full.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands")), "classes")

    buckets = classes.select(F.explode("bands").alias("key"), "node").distinct()
    chained = previous_values(buckets, ["key"], ["node"], "node", "before").filter("before is not null")
    chained = written(chained.select("key", F.col("before").alias("a"), F.col("node").alias("b")), "chained")
    pairs = written(chained.select("a", "b").distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = classes.select("node", "digest").join(nodes, "node")
    sets = written(_sets(docs, wanted, words), "sets")

    compared = written(_similarities(pairs, sets), "similarities")
    near = compared.filter(F.col("shared") * 100 >= F.col("joint") * percent).select("a", "b")
    is_alike = F.col("shared") >= F.col("joint") * min(GROUP, percent / 100)
    groups = components(compared.filter(is_alike).select("a", "b"))
    labels = components(near)
    apart = chained.join(compared.filter(~is_alike).select("a", "b"), ["a", "b"]).select("key").distinct()
    of_buckets = (chained.join(written(apart, "apart"), "key")
                         .select(F.col("key").alias("component"), F.explode(F.array("a", "b")).alias("node")).distinct())
    # Should a bucket's key be the number of a group, both are compared as one.
    named = groups.select("component", "node").union(of_buckets).join(
        labels.withColumnRenamed("component", "label"), "node", "left").select(
        F.col("component").alias("group"), "node", F.coalesce("label", "node").alias("label"))
    # Written, so that a large group meets its one row in a join that Spark can broadcast or split.
    named = written(named, "named")
    member = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_members{k}") for k in (0, 1)]
    open_groups = (named.groupBy("group").agg(F.min("label").alias("_least"), F.max("label").alias("_most"),
                                              F.count(F.lit(1)).alias("_n"), *member)
                        .filter("_least < _most and _n > 2")  # two are compared already
                        .groupBy("_n", "_members0", "_members1").agg(F.min("group").alias("group"))  # equal ones once
                        .select("group", F.ceil(F.col("_n") / BLOCK).cast("int").alias("n_blocks")))
    members = (named.join(written(open_groups, "open-groups"), "group")
                    .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
                    .join(sets.withColumnRenamed("doc_id", "node"), "node")
                    .select("group", F.col("node").alias("doc_id"), "label", "elements", "n_blocks", "block"))
    more = written(_in_blocks(members, percent), "joining")
    if not more.isEmpty():
        ends = more
        for side in ("a", "b"):
            label = labels.select(F.col("node").alias("_node"), F.col("component").alias("_label"))
            ends = (ends.join(label, ends[side] == label["_node"], "left")
                        .withColumn(side, F.coalesce("_label", side)).drop("_node", "_label"))
        further = components(ends).withColumnRenamed("node", "_node").withColumnRenamed("component", "_label")
        rest = further.join(labels, further["_node"] == labels["node"], "left_anti")
        labels = written(labels.join(further, labels["component"] == further["_node"], "left")
                               .select("node", F.coalesce("_label", "component").alias("component"))
                               .union(rest.select("_node", "_label")), "labels")

    of_class = classes.select("digest", F.col("node")).join(labels, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("_component"))
    joined = signed_docs.select("doc_id", "text_hash", "n_shingles", "digest").join(written(of_class, "class-labels"), "digest", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_component", "doc_id"))
    return joined.select("doc_id", "text_hash", "n_shingles", component.cast("long").alias("component_id"),
                         F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, unchanged, that :func:`near_duplicates` keeps.

    Rows that repeat a doc_id are judged by their own texts; of rows with equal doc_id and text
    one stays. Rows without doc_id and texts without words stay.
    """
    found = _judged(docs, words, percent).filter("doc_id is not null and n_shingles > 0")
    marked = written(found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
                          .agg(F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).filter("not _kept or _n > 1"), "gone")
    names, places = docs.columns, [f"_{i}" for i in range(len(docs.columns))]
    placed, doc_id, text = docs.toDF(*places), places[names.index("doc_id")], places[names.index("text")]
    same = (F.col(doc_id).cast("long") == F.col("_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_hash"))
    kept, repeated = placed.join(marked, same, "left_anti"), marked.filter("_kept")
    if not repeated.isEmpty():
        kept = kept.union(placed.join(repeated, same, "left_semi").dropDuplicates([doc_id, text]))
    return kept.toDF(*names)
