"""Search, sharding, licences, token files, encoding and the two classifiers on small tables."""

import base64
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import awkward_rows, prose, table
from pyspark.sql import functions as F

from streamjobs.llm import (byte_bpe, histogram_shards, language_codes, licenses, metric_tree, token_files, toxicity)
from streamjobs.llm.words import drawn
from streamjobs.session import fresh_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).repartition(4)


def brute_top(rows, k=20):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole = [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]
            held[i] = min(held.get(i, whole), whole)
    out = set()
    for q in held:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(held[q], v, strict=False)), i) for i, v in held.items() if i != q)
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def vector_rows(n, dim=6):
    random = np.random.default_rng(3)
    rows = [(i, [float(x) for x in random.normal(size=dim)]) for i in range(n)]
    rows += [(n + i, [0.5] * dim) for i in range(n // 2)]  # a hot vector: ties
    return rows + [(None, [1.0] * dim), (-20, None), (-40, [None] + [1.0] * (dim - 1)), (-60, [float("nan")] * dim),
                   (-80, [float("inf")] * dim), (0, rows[0][1]), (20, [0.0] * dim), (-100, []), (-120, [2.0, 1.0])]


@pytest.mark.parametrize("subtree, page", [(metric_tree.SUBTREE, metric_tree.PAGE), (40, 8)])
def test_top_k_is_exact(spark, monkeypatch, subtree, page):
    monkeypatch.setattr(metric_tree, "SUBTREE", subtree)
    monkeypatch.setattr(metric_tree, "PAGE", page)
    rows = vector_rows(400)
    got = {tuple(r) for r in metric_tree.top_inner_products(vectors(spark, rows)).collect()}
    assert got == brute_top(rows)


def test_top_k_of_few_and_large_numbers(spark):
    rows = [(0, [2.1e7, 1.0]), (1, [1.1e7, 5.0]), (20, [-2e7, 0.0]), (40, [1.0, 1.0])]
    got = {tuple(r) for r in metric_tree.top_inner_products(vectors(spark, rows)).collect()}
    assert got == brute_top(rows)
    assert metric_tree.top_inner_products(vectors(spark, [])).count() == 0
    assert metric_tree.top_inner_products(vectors(spark, [(0, [1.0])])).count() == 0


def test_queries_at_one_home_go_to_many_tasks(spark, monkeypatch):
    """All vectors lie close together, so that nearly all queries share a home; a slice has some seven of them."""
    random = np.random.default_rng(8)
    rows = [(i, [float(x) for x in 5 + random.normal(size=5) * 0.3]) for i in range(4000)] + [(4000 + i, [-50.0 * i] * 5) for i in range(3)]
    monkeypatch.setattr(metric_tree, "QUERIES", 7)
    monkeypatch.setattr(metric_tree, "FANOUT", 2)
    searched, seen = metric_tree._searched, []

    def watched(points, visits, *rest):
        most = visits.groupBy("ball", "piece").count().agg(F.max("count")).first()[0]
        found = searched(points, visits, *rest)
        seen.append((most, sum(n > 0 for n in found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())))
        return found

    monkeypatch.setattr(metric_tree, "_searched", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in metric_tree.top_inner_products(vectors(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_top(rows)
    assert seen[0][0] > 100 and seen[0][1] > 12


def test_the_tree_grows_with_the_table(spark, monkeypatch):
    """Entries of many vectors get inner routing objects; copies of one vector are dealt into pieces."""
    monkeypatch.setattr(metric_tree, "SUBTREE", 32)
    made, init = [], metric_tree.Balls.__init__
    monkeypatch.setattr(metric_tree.Balls, "__init__", lambda self, *a: (init(self, *a), made.append(self))[0])
    rows = vector_rows(900)
    got = {tuple(r) for r in metric_tree.top_inner_products(vectors(spark, rows)).collect()}
    assert got == brute_top(rows)
    assert len(made[-1].routing) > len(made[-1].root) and made[-1].pieces.max() > 4


def test_only_the_most_frequent_languages_are_learned(spark, monkeypatch):
    rows = [(i * 100 + k, prose(i * 100 + k, 30), f"l{i:02d}") for i in range(12) for k in range(12 - i)]
    docs = table(spark, rows)
    seen = Counter(lang for doc_id, _, lang in rows if zlib.crc32(str(doc_id).encode()) % 3 != 1)
    assert language_codes.fit(docs, values=5).languages == sorted(sorted(seen, key=lambda lang: (-seen[lang], lang))[:5])
    monkeypatch.setattr(language_codes, "DOCUMENTS", 6)
    assert len(language_codes.fit(docs, values=3).languages) <= 3


def test_pages_prune():
    """With well separated groups, a search looks at few pages."""
    random = np.random.default_rng(1)
    points = np.concatenate([random.integers(-5, 5, (300, 8)) + 200 * np.eye(8, dtype=int)[g] for g in range(8)]).astype(np.float64)
    space = metric_tree.Space(float((points ** 2).sum(axis=1).max()), 8)
    tree = metric_tree.Subtree(np.arange(len(points)), points, space.points(points[:1])[0], space)
    query, seen = points[5], []
    tree.pages = [_Watched(p, seen) for p in tree.pages]
    d = metric_tree.distances(space.queries(query[None]), tree.parent[None])[0, 0]
    best = tree.search(-1, query, float((query ** 2).sum()), d, 5, None)
    want = sorted((points @ query).astype(int).tolist())[-5:]
    assert sorted(s for s, _ in best) == want and len(set(seen)) < len(tree.pages)


class _Watched(tuple):
    def __new__(cls, page, seen):
        made = super().__new__(cls, page)
        made.seen = seen
        return made

    def __iter__(self):
        self.seen.append(id(self))
        return super().__iter__()


def test_shards(spark):
    rows = awkward_rows() + [(None, "x" * i, "aa") for i in range(50)] + [(5, "y" * i, "aa") for i in range(200)]
    got = histogram_shards.shard(table(spark, rows), shards=4, slices=4).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [float("-inf") if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    for s in range(4):
        own = [r for r in order if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own)))
        below = sum(r.size for r in order if r.shard < s)
        assert abs(below - total * s / 4) <= largest / 2
    assert histogram_shards.shard(table(spark, [])).count() == 0
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_shards_of_one_hot_key(spark):
    rows = [(7, "z" * 9, "aa")] * 900 + [(i, "z" * 9, "aa") for i in range(100)]
    got = histogram_shards.shard(table(spark, rows)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert {r.b for r in got} == {1250}


def test_license_lines(spark):
    whole = "Permission to use, copy, modify,\nand/or distribute this software for any purpose\nwith or without fee is hereby granted"
    rows = [(1, "some text that goes on and on\nLICENSED under the  Apache License -- Version 2.0!\nmore of the same text", "aa"), (2, "Released under the MIT License.", "aa"),
            (3, whole, "aa"), (4, "released under the license", "aa"), (5, None, "aa"), (None, "Licensed under CC BY-NC 4.0", "aa"),
            (2, "Released under the MIT License.", "aa"), (6, "", "aa"), (7, "the " * 300, "aa")]
    got = licenses.license_report(table(spark, rows), licenses.default_templates(spark)).collect()
    assert sorted(map(repr, ((r.doc_id, r.unit, r.license) for r in got))) == sorted(map(repr, [
        (1, 2, "Apache-2.0"), (2, 1, "MIT"), (2, 1, "MIT"), (3, 0, "ISC"), (None, 1, "CC-BY-NC-4.0")]))
    assert licenses.license_report(table(spark, []), licenses.default_templates(spark)).count() == 0
    none = licenses.default_templates(spark).limit(0)
    assert licenses.license_report(table(spark, rows), none).count() == 0


def test_elias_fano():
    random = np.random.default_rng(5)
    for n, most in ((1, 1), (1, 10 ** 12), (1000, 1), (5000, 900), (300, 10 ** 10)):
        ends = np.cumsum(random.integers(0, most + 1, n))
        index = token_files.EliasFano.of(ends)
        assert [index[i] for i in range(n)] == ends.tolist()
        bits = 64 * (len(index.low) + len(index.high) + len(index.samples))
        assert bits <= n * (2 + max(0, int(np.log2(max(1, ends[-1] / n))) + 1)) + n / 4 + 256


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = awkward_rows() + [(400, "don't STOP!! <|endoftext|> Σίσυφος İ x²\x1cy", "aa")]
    tokenizer = Tokenizer.from_file(WORDS)
    folder = fresh_path(spark, "tokens")
    files = token_files.write_tokens(table(spark, rows), WORDS, folder).cache()
    assert files.agg(F.sum("n_docs")).first()[0] == len(rows)
    got = token_files.read_tokens(files, folder).collect()
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows}
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((d, tuple(ids[t])) for d, t, *_ in rows)
    order = sorted(got, key=lambda r: r.start)
    at = 0
    for r in order:
        assert r.start == at
        at += len(r.ids)
    known = [r.doc_id for r in order if r.doc_id is not None]
    assert known == sorted(known) and order[0].doc_id is None
    report = token_files.digests(files, folder).collect()
    crc = {(r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    assert {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in report} == crc
    assert token_files.token_report(table(spark, []), WORDS).count() == 0


def test_every_letter_is_encoded_as_by_the_library():
    """All code points that are letters, marks or signs with a decomposition: alone, between letters, before a sign, doubled."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    pieces = token_files._Pieces(tokenizer, 2, token_files.is_plain(open(WORDS).read()))
    chars = [chr(c) for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LM"]
    few = [c for c in chars if unicodedata.normalize("NFC", c) != c or not (0x3400 <= ord(c) < 0xA000 or ord(c) >= 0xAC00)]
    for kind in ("{}", "a{}b", "{}.", "ka{0}{0}"):
        texts = [kind.format(c) for c in (chars if kind in ("{}", "a{}b") else few)]
        for text, encoding in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(pieces.encode(text), "<u2").tolist() == encoding.ids, list(map(hex, map(ord, text)))


def test_words_and_signs_are_held_once():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    pieces = token_files._Pieces(tokenizer, 2, token_files.is_plain(open(WORDS).read()))
    texts = ["ab, Öl.", "ab Öl ab, ,.", "\x1dab\x1fÖl, ab"]
    for text in texts:
        assert np.frombuffer(pieces.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert {"ab", "ab,", "Öl", "Öl.", ",", "."} <= set(pieces) and not any(
        isinstance(held, dict) and "ab" in held for held in vars(pieces).values())


def test_folders_are_qualified(spark, tmp_path):
    assert token_files.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        token_files.write_tokens(table(spark, []), public_tokenizers.path("byte_bpe_50k.json"), "/tmp/none")


def test_encoding_round_trip(spark, monkeypatch):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "DISTINCT", 50)  # many blocks
    rows = awkward_rows() + [(401, "it's   \n\n  we'll x²　<|endoftext|> 12345 \t", "aa")]
    with open(RANKS, "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(table(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    want = Counter((d, tuple(encoder.encode_ordinary(t or "")), (t or "").encode()) for d, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_codes.language_report(docs).collect()
    out = [known[r.doc_id] == r.lang_pred for r in got if r.held_out]
    assert sum(out) >= 0.97 * len(out) and len(got) == len(known)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.held_out} == {d for d in known if zlib.crc32(str(d).encode()) % 3 == 1}


def test_language_of_awkward_rows(spark):
    rows = awkward_rows() + [(500 + i, prose(i, 30), "bb" if i % 2 else "aa") for i in range(30)]
    docs = table(spark, rows + [(600, "12 34 !!", "aa"), (601, "日本語", None), (602, "𝒳", None)])
    got = language_codes.language_report(docs).collect()
    assert len(got) == len(rows) + 3
    texts = {d: t for d, t, *_ in rows}
    for r in got:
        if r.doc_id in (1, 2, 3, 600):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("aa", "bb"), texts.get(r.doc_id)
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_codes.language_report(none).collect()} == {"und"}
    one = docs.withColumn("lang", F.lit("zz"))
    assert {r.lang_pred for r in language_codes.language_report(one).collect()} == {"und", "zz"}
    assert language_codes.language_report(table(spark, [])).count() == 0


def test_codewords_tell_languages_apart():
    for n in (2, 3, 4, 5, 6, 9, 40):
        codes = language_codes.codewords(n)
        apart = min(int((codes[a] != codes[b]).sum()) for a in range(n) for b in range(a))
        assert apart >= min(2, 2 ** (n - 2)) and not (np.abs(codes.sum(axis=0)) == n).any()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.toxicity_report(docs, labels).collect()
    assert {r.doc_id for r in got if r.held_out} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    out = [(r.predicted, known[r.doc_id]) for r in got if r.held_out and known.get(r.doc_id) is not None]
    right = Counter(out)
    assert right[1, 1] >= 0.85 * (right[1, 1] + right[0, 1])
    assert right[1, 1] >= 0.9 * (right[1, 1] + right[1, 0])
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_toxicity_without_labels_and_with_awkward_rows(spark):
    rows = awkward_rows()
    docs = table(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_report(docs, none).collect()} == {0.0}
    some = [(d, 1, int("same" in (t or ""))) for d, t, *_ in rows] + [(None, 1, 1), (6, 1, None), (9999, 0, 1)]
    texts = [(1000 + i, prose(i, 20) + (" you idiot" if i % 3 == 0 else ""), "aa") for i in range(120)]
    labels = spark.createDataFrame(some + [(d, 1, int("idiot" in t)) for d, t, _ in texts], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + texts)
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == len(rows) + len(texts) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() < len(got)
    assert toxicity.toxicity_report(table(spark, []), labels).count() == 0


def test_dense_features():
    names = toxicity.NAMES
    held = dict(zip(names, toxicity.dense_features("YOU are an 1d10t, idiot!", {"clown": 3.0}), strict=True))
    assert held["insult_any"] == 1 and held["disguised_hits"] == 1 and held["second_person_near"] > 0 and held["capitals"] > 0
    assert toxicity.dense_features(None, {}) == toxicity.dense_features(" ", {}) == [0.0] * len(names)


def test_samples_of_very_large_tables_are_drawn(spark):
    """Of 2e9 rows that are not there but counted, 400 are a share of 2e-7: some 8 of 40 million keys."""
    keys = spark.range(40_000_000)
    found = [r.id for r in keys.filter(drawn(F.col("id"), F.lit(2_000_000_000), 400)).collect()]
    assert 1 <= len(found) <= 25
    known = spark.range(20_000).filter(drawn(F.col("id"), F.lit(20_000), 400)).count()
    assert 300 <= known <= 500
    assert spark.range(5000).filter(drawn(F.col("id"), F.lit(300), 400)).count() == 5000


def test_languages_with_more_rows_than_hash_steps_are_learned(spark):
    """A sample of about one in 1.3 million: the share must not become 0 below 2^-20."""
    rows = spark.range(24_000_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"),
                                          F.when(F.col("id") % 2 == 0, "kan lon min").otherwise("the quick fox").alias("text"))
    assert set(language_codes.fit(rows, sample=7).languages) == {"aa", "bb"}
