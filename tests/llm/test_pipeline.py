"""The pipeline's stages, each against a plain restatement on its own input, and the registered text queries."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from check_oracle import compare, duck  # noqa: E402

import corpus_pipeline  # noqa: E402
from streamjobs.llm import simhash_windows  # noqa: E402
from streamjobs.llm.queries import ORACLE, QUERIES, read  # noqa: E402
from streamjobs.session import written  # noqa: E402
from test_near_copies import brute_components, brute_repeats  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        assert compare(df, duck(SF), ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_stages(spark):
    docs = read(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = written(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    seen["end"] = docs
    rows = {k: [tuple(r) for r in v.collect()] for k, v in seen.items()}

    known, _ = brute_components(rows["minhash_near_dedup"], 5, 80)
    assert sorted(rows["substring_dedup"]) == sorted(r for r in rows["minhash_near_dedup"] if known[r[0]] == r[0])

    repeats = brute_repeats(rows["substring_dedup"])
    cut = {r[0]: r for r in rows["benchmark_decontamination"]}
    for doc_id, text, *rest in rows["substring_dedup"]:
        kept, n = repeats[doc_id, text]
        assert cut[doc_id][1].encode().split() == kept
        if len(kept) == n:
            assert cut[doc_id] == (doc_id, text, *rest)
        assert cut[doc_id][columns.index("n_chars")] == len(cut[doc_id][1])

    items = [simhash_windows.plain_words(r.text) for r in read(spark, SF, "benchmark").collect()]

    def found(text):
        words = simhash_windows.plain_words(text)
        return any(simhash_windows.weighted_similarity(words[i:i + len(of)], of) >= 0.8
                   for of in items for i in range(len(words) - len(of) + 1) if set(of[:9]) & set(words[i:i + 12]))

    assert sorted(rows["byte_bpe"]) == sorted(r for r in rows["benchmark_decontamination"] if not found(r[1]))
    assert {r[0] for r in rows["end"]} == {r[0] for r in rows["byte_bpe"]}
    assert len(rows["minhash_near_dedup"]) < len(rows["toxicity"])


def test_run(spark):
    result = corpus_pipeline.run(spark, SF)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and result.count() > 0
