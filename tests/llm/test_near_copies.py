"""Near copies, repeated passages and benchmark items against plain restatements."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from helpers import EXTRA, awkward_rows, changed, prose, shingle_set, table
from pyspark.sql import functions as F

from streamjobs.llm import fast_sketch, relative_lz, simhash_windows
from streamjobs.llm.components import components
from streamjobs.llm.words import WordHashes, shingles


def brute_components(rows, size, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        sets.setdefault(doc_id, shingle_set(text, size))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([d for d in sets if sets[d] and d is not None], 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {d: root(d) for d in sets}, sets


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_all_pairs(spark, size):
    rows = awkward_rows()
    known, sets = brute_components(rows, size, 80)
    got = fast_sketch.near_duplicates(table(spark, rows), size, 80).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), known[r.doc_id], known[r.doc_id] == r.doc_id)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(fast_sketch, "BLOCK", 16)  # many blocks
    base = prose(50, 80)
    rows = [(i, changed(base, i, i % 9), "aa") for i in range(150)]
    known, _ = brute_components(rows, 2, 80)
    got = {r.doc_id: r.component_id for r in fast_sketch.near_duplicates(table(spark, rows), 2, 80).collect()}
    assert got == known


def test_kept_rows_come_back_whole(spark):
    rows = awkward_rows()
    docs = table(spark, rows)
    kept = fast_sketch.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.filter("node <> 'n'").isEmpty()
    ids = [r.doc_id for r in kept.collect()]
    assert {6, 7, -3} & set(ids) == {-3} and ids.count(None) == 2 and {1, 2, 3} <= set(ids)


def test_sketch_fills_and_estimates():
    hashes = WordHashes()
    for n in (1, 2, 30, 500):
        text = prose(n, n).encode().split()
        found = np.unique(shingles(hashes.of(text), 2))
        coordinates = fast_sketch.sketch(found)
        assert int((coordinates >> np.uint64(32)).max()) < 2 * fast_sketch.BINS
    a, b = (np.arange(k, k + 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (0, 250))
    share = (fast_sketch.sketch(a) == fast_sketch.sketch(b)).mean()  # similarity 0.6
    assert abs(share - 0.6) < 0.2


def test_empty_tables(spark):
    none = table(spark, [])
    assert fast_sketch.near_duplicates(none).count() == 0
    assert relative_lz.repeat_report(none).count() == 0
    assert relative_lz.without_repeats(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash_windows.contamination_report(none, bench).count() == 0
    assert simhash_windows.without_benchmark(table(spark, awkward_rows()), bench).count() == len(awkward_rows())


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1040)] + [(5, 5), (2000, 2001), (2001, 1999)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1040)} | {1999: 1999, 2000: 1999, 2001: 1999}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, window=13):
    """Per distinct (doc_id, text): kept words."""
    first = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = {}
    for doc_id, text, *_ in rows:
        words = (text or "").encode().split()
        gone = bytearray(len(words))
        for i in range(len(words) - window + 1):
            if doc_id is not None and first[tuple(words[i:i + window])] < doc_id:
                gone[i:i + window] = b"\1" * window
        out[doc_id, text] = [w for w, g in zip(words, gone, strict=True) if not g], len(words)
    return out


def test_repeats_match_all_windows(spark):
    rows = awkward_rows() + [(200, prose(4, 50) + " " + prose(60, 30), "aa"), (201, prose(60, 30), "aa"),
                             (202, prose(4, 50)[5:] + " " + prose(61, 20) + " " + prose(60, 30), "aa"), (7, prose(2, 40), "aa")]
    known = brute_repeats(rows)
    docs = table(spark, rows)
    got = relative_lz.repeat_report(docs).collect()
    want = [(d, known[d, t][1], known[d, t][1] - len(known[d, t][0]),
             hashlib.sha256(b" ".join(known[d, t][0])).hexdigest()) for d, t, *_ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    cut = relative_lz.without_repeats(docs)
    assert cut.columns == docs.columns
    texts = sorted(((r.doc_id, (r.text or "").encode().split()) for r in cut.collect()), key=repr)
    assert texts == sorted(((d, known[d, t][0]) for d, t, *_ in rows), key=repr)


def test_untouched_texts_keep_their_white_space(spark):
    rows = [(1, " a  b\n" + prose(70, 30) + "\t", 5), (2, "  " + prose(70, 30) + "\n\nlast  words ", 5)]
    got = {r.doc_id: (r.text, r.n_chars) for r in
           relative_lz.without_repeats(table(spark, rows, ("doc_id", "text", "n_chars"))).collect()}
    assert got[1] == (rows[0][1], 5)
    assert got[2] == ("  last  words ", 14)


def test_benchmark_items_are_found(spark):
    items = [(1, prose(80, 30)), (2, prose(81, 55)), (3, "Only three words"), (4, None), (5, ""), (6, prose(82, 14)), (1000, prose(80, 30))]
    edge = items[1][1].split()
    near = " ".join([*edge[:20], "changed", *edge[21:]])
    rows = awkward_rows() + [(300, prose(90, 20) + " " + items[0][1].upper() + ". " + prose(91, 9), "aa"), (301, near, "aa"),
                             (302, "so (only three words)!", "aa"), (303, " ".join(edge[:40]), "aa"), (304, items[5][1], "aa"),
                             (305, items[1][1] + " " + items[5][1], "aa"), (None, items[5][1], "aa")]
    docs = table(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in simhash_windows.contamination_report(docs, bench).collect()}
    want = set()
    for doc_id, text, *_ in rows:
        words = simhash_windows.plain_words(text)
        for item, of in items:
            held = simhash_windows.plain_words(of)
            if held and any(simhash_windows.weighted_similarity(words[i:i + len(held)], held) >= 0.8
                            for i in range(len(words) - len(held) + 1)):
                want.add((doc_id, item))
    assert got == want and {(300, 1), (300, 1000), (301, 2), (302, 3), (304, 6), (305, 2), (None, 6)} <= got
    clean = simhash_windows.without_benchmark(docs, bench)
    assert clean.columns == docs.columns and set(EXTRA) <= set(clean.columns)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in clean.collect()))) == sorted(
        map(repr, ((d, t) for d, t, *_ in rows if d not in {a for a, _ in want if a} and not (d is None and t == items[5][1]))))


def test_items_are_found_beyond_any_radius_of_fingerprints(spark):
    """One changed word inside 50 leaves a similarity of 0.804; some of the fingerprints lie more than 11 bits apart."""
    items = [(i, prose(2000 + i, 50)) for i in range(60)] + [(60, "do re " * 25), (61, prose(2061, 200))]
    rows = [(i, prose(3000 + i, i % 7) + " " + " ".join([*words[:25], "changed", *words[26:]]) + " " + prose(4000 + i, i % 5), "aa")
            for i, text in items[:60] for words in [text.split()]]
    rows += [(60, "do re " * 300, "aa"), (61, changed(items[61][1], 1, 4), "aa"), (62, items[0][1], "aa"), (62, items[1][1], "aa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in simhash_windows.contamination_report(table(spark, rows), bench).collect()}
    want = {}
    for doc_id, text, *_ in rows:
        words = simhash_windows.plain_words(text)
        for item, of in items:
            held = simhash_windows.plain_words(of)
            found = [(-simhash_windows.weighted_similarity(words[i:i + len(held)], held), i) for i in range(len(words) - len(held) + 1)]
            if found and -min(found)[0] >= 0.8:
                want[doc_id, item] = min(found)
    assert {k: (-r.similarity, r.start) for k, r in got.items()} == want
    assert {(i, i) for i in range(62)} <= set(got) and max(r.distance for r in got.values()) > 11
    ways = {(r.distance <= simhash_windows.RADIUS, r.by_fingerprint) for r in got.values()}
    assert ways == {(True, True), (False, False)}  # every text here is one run with one window that is similar


def test_blocks_hold_every_fingerprint_within_the_radius():
    pick = random.Random(4)
    for _ in range(300):
        one = pick.getrandbits(64)
        other = one ^ sum(1 << b for b in pick.sample(range(64), simhash_windows.RADIUS))
        own = {other >> b * 16 & 0xFFFF | b << 16 for b in range(4)}
        assert own & set(simhash_windows.near_blocks(one).tolist())


def test_every_link_of_given_documents_is_found(spark):
    """All pairs of the given documents that share a shingle, from an inverted index: recall of links and of components is 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text, 2) for r in docs.select("doc_id", "text").collect()}
    holders = {}
    for doc_id, held in sets.items():
        for shingle in held:
            holders.setdefault(shingle, []).append(doc_id)
    # A pair at 0.8 shares one of the rarest shingles of the smaller set, as many as it may lack and one more.
    parent, links = {d: d for d in sets}, []

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for doc_id, held in sets.items():
        rare = sorted(held, key=lambda s: (len(holders[s]), s))[:len(held) - -(-4 * len(held) // 5) + 1]
        for other in {o for s in rare for o in holders[s]} - {doc_id}:
            both = len(held & sets[other])
            if 100 * both >= 80 * (len(held) + len(sets[other]) - both):
                links.append((doc_id, other))
                p, q = root(doc_id), root(other)
                parent[max(p, q)] = min(p, q)
    got = {r.doc_id: r.component_id for r in fast_sketch.near_duplicates(docs, 2, 80).collect()}
    assert got == {d: root(d) for d in sets} and len(links) > 200


def test_items_with_one_preamble(spark):
    """Two hundred items of one length begin alike: what many items share is the last to bring a pair together."""
    preamble = prose(6000, 20)
    items = [(i, preamble + " " + prose(6100 + i, 30)) for i in range(200)]
    rows = [(i, changed(items[i][1], i, 1), "aa") for i in range(0, 200, 3)] + [(1000 + i, preamble + " " + prose(7000 + i, 30), "aa") for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in simhash_windows.contamination_report(table(spark, rows), bench).collect()}
    want = {(doc_id, item): found for doc_id, text, *_ in rows for item, of in items
            if (found := simhash_windows.weighted_similarity(simhash_windows.plain_words(text), simhash_windows.plain_words(of))) >= 0.8}
    assert got == want and len(want) > 60
    often = np.zeros(simhash_windows.MAP_BITS // 8, np.uint8)
    shared = simhash_windows.window_shingles(WordHashes().of([w.encode() for w in preamble.split()]), 20)
    for at in (shared % np.uint64(simhash_windows.MAP_BITS)).tolist():
        often[at >> 3] |= 1 << (at & 7)
    for _, text in items:
        whole = simhash_windows.window_shingles(WordHashes().of([w.encode() for w in text.split()]), 50)
        first = set(simhash_windows.first_tokens(whole, 10, often).tolist())
        assert not first & set(simhash_windows.first_tokens(shared, 99, often).tolist())


def test_items_without_their_last_words_are_found_in_short_texts(spark):
    items = [(1, prose(5001, 50)), (2, prose(5002, 15)), (3, "w " * 30), (4, "four words are here"), (5, prose(5003, 6)), (6, prose(5004, 400))]
    texts = {(item, n): " ".join(text.split()[:n]) for item, text in items for n in range(1, len(text.split()) + 1)
             if n < 50 or n % 20 < 2}
    rows = [(k, text, "aa") for k, text in enumerate(texts.values())] + [(None, "", "aa"), (5000, None, "aa")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words)
           for r in simhash_windows.contamination_report(table(spark, rows), bench).collect()}
    want = {}
    for doc_id, text, *_ in rows:
        words = simhash_windows.plain_words(text)
        for item, of in items:
            held = simhash_windows.plain_words(of)
            size = min(len(held), len(words))
            found = [(-simhash_windows.weighted_similarity(words[i:i + size], held), i, size) for i in range(len(words) - size + 1)]
            if words and -min(found)[0] >= 0.8:
                want[doc_id, item] = -min(found)[0], *min(found)[1:]
    assert got == want
    places = {key: k for k, key in enumerate(texts)}
    assert got[places[1, 46], 1] == (42 / 46, 0, 46) and (places[4, 3], 4) not in got


def test_links_across_other_classes_of_a_bucket_are_found(spark, monkeypatch):
    """All classes in one bucket, and between two linked ones others that are not even alike."""
    signatures = fast_sketch.signatures
    monkeypatch.setattr(fast_sketch, "signatures", lambda *a: signatures(*a).withColumn(
        "bands", F.when(F.size("bands") > 0, F.array(F.lit(7).cast("long"))).otherwise(F.col("bands"))))
    rows = [(i, changed(prose(70 + i % 7, 60), i, i % 4), "aa") for i in range(60)]
    known, _ = brute_components(rows, 2, 80)
    for block in (1024, 16):
        monkeypatch.setattr(fast_sketch, "BLOCK", block)
        got = {r.doc_id: r.component_id for r in fast_sketch.near_duplicates(table(spark, rows), 2, 80).collect()}
        assert got == known and len(set(got.values())) < 30


def test_rows_that_repeat_a_doc_id_are_judged_by_their_texts(spark):
    a, b, c = prose(90, 40), prose(91, 40), prose(92, 40)
    rows = [(1, a, "aa"), (1, a, "bb"), (2, b, "aa"), (2, a, "aa"), (3, c, "aa"), (4, None, "aa"), (4, None, "aa"), (None, a, "aa"), (None, a, "aa")]
    docs = table(spark, rows)
    kept = fast_sketch.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(1, a), (2, b), (3, c), (4, None), (4, None), (None, a), (None, a)], key=repr)
