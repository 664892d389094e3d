"""Language identification with error-correcting output codes over character n-grams.

Every language has a codeword of bits. One linear classifier per bit, trained on
hashed character 1- to 3-grams, predicts whether a text's language has that bit.
A text belongs to the language whose codeword costs least, where each bit counts
by how well its classifier did on texts it was not trained on. A text whose two
cheapest codewords lie close together is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.llm.words import drawn, mix
from streamjobs.session import written

#: At most about so many labelled texts of each language are used to fit; all rows are predicted.
SAMPLE = 400
#: Values of lang that are learned, and documents in the sample, at most about so many in all.
VALUES, DOCUMENTS = 100, 8000
DIMENSIONS = 1 << 12
#: Besides a whole sample text, so many runs of its words are training texts, of so many words.
RUNS, RUN = 2, 12
#: Least lead of the best language's share over the second for an unambiguous text.
CLEAR = 0.2
NO_LANGUAGE = "und"
_TABLE = 1 << 16
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """For the code points of the basic plane: the lower-case letter, or 0."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(_TABLE)], np.uint32)


def vector(text: str, letters: np.ndarray) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram counts within words; None for a text without letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if codes.size and codes.max() >= _TABLE:
        low = letters[np.minimum(codes, _TABLE - 1)]
        folded = np.where(codes < _TABLE, low, np.array([c if chr(c).isalpha() else 0 for c in codes.tolist()], np.uint32))
    else:
        folded = letters[codes]
    if not folded.any():
        return None
    padded = np.concatenate([[0], folded, [0]]).astype(np.uint64)
    one, two, three = padded, padded[:-1], padded[:-2]
    # A gap between words is one zero: runs of zeros give no grams of their own.
    letter = one > 0
    first = mix(one[letter] * _SEED)
    pair_ok = letter[:-1] | letter[1:]
    second = mix((two * np.uint64(1 << 21) + padded[1:] + np.uint64(1 << 62))[pair_ok] * _SEED)
    triple_ok = letter[1:-1]
    third = mix(((three * np.uint64(1 << 21) + padded[1:-1]) * np.uint64(1 << 21) + padded[2:])[triple_ok] * _SEED)
    grams = np.concatenate([first, second, third]) % np.uint64(DIMENSIONS)
    counts = np.sqrt(np.bincount(grams.astype(np.int64), minlength=DIMENSIONS))
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """Codewords of +1 and -1, one row per language: all splits for few languages, else one against the rest and random splits."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        splits = [s for s in product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T
    random = np.random.default_rng(n)
    bits = [2 * np.eye(n) - 1]
    for _ in range(int(4 * np.ceil(np.log2(n)))):
        split = np.where(np.arange(n) < n // 2, 1.0, -1.0)
        random.shuffle(split)
        bits.append(split[:, None])
    return np.concatenate(bits, axis=1)


class LanguageModel:
    """Codewords, bit classifiers and bit weights for the languages met in training."""

    def __init__(self, languages: list[str], codes: np.ndarray, planes: np.ndarray, offsets: np.ndarray, weights: np.ndarray):
        self.languages, self.codes, self.planes, self.offsets, self.weights = languages, codes, planes, offsets, weights

    def shares(self, vectors: np.ndarray) -> np.ndarray:
        """For each vector the languages' shares: softmax of the weighted losses of their codewords."""
        margins = vectors @ self.planes + self.offsets
        # Loss of codeword bit m against margin f: log(1 + exp(-m f)).
        losses = np.logaddexp(0, -self.codes[None] * margins[:, None, :]) @ self.weights
        low = np.exp(losses.min(axis=1, keepdims=True) - losses)
        return low / low.sum(axis=1, keepdims=True)


def _fit_bits(x: np.ndarray, targets: np.ndarray, costs: np.ndarray, rounds: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all bits at once, by accelerated gradient descent with a small ridge."""
    targets, costs = targets.astype(np.float32), costs.astype(np.float32)
    planes, offsets = np.zeros((x.shape[1], targets.shape[1]), np.float32), np.zeros(targets.shape[1], np.float32)
    ahead_p, ahead_o, t = planes, offsets, 1.0
    rate, ridge = np.float32(4.0), np.float32(1e-4)
    for _ in range(rounds):
        margins = x @ ahead_p + ahead_o
        pull = -targets * costs[:, None] / (1 + np.exp(np.clip(targets * margins, -50, 50)))
        new_p = ahead_p - rate * (x.T @ pull + ridge * ahead_p)
        new_o = ahead_o - rate * pull.sum(axis=0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        step = np.float32((t - 1) / after)
        ahead_p, ahead_o = new_p + step * (new_p - planes), new_o + step * (new_o - offsets)
        planes, offsets, t = new_p, new_o, after
    return planes, offsets


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from; a null doc_id counts as such."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _training_texts(text: str) -> list[str]:
    words = text.split()
    step = max(1, len(words) // RUNS)
    return [text, *(" ".join(words[i:i + RUN]) for i in range(0, step * RUNS, step) if words[i:i + RUN])]


def fit(docs: DataFrame, sample: int = SAMPLE, values: int = VALUES) -> LanguageModel:
    """Fit on about ``sample`` documents of each language, drawn by the hash of doc_id.

    At most ``values`` values of ``lang`` are learned, the most frequent ones (ties by name), and
    about ``DOCUMENTS`` documents in all: with more than 20 languages each gets fewer, so that a
    column full of odd values does not fill the driver.

    Held-out documents, null languages and texts without letters are left out. The sample's
    vectors are made by the tasks, ``RUNS`` + 1 per document, and are all that comes to the driver:
    about 10 MB for each language, 200 MB at most.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    known = known.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    learned = counts.orderBy(F.desc("n"), "lang").limit(values)
    each = min(sample, max(1, DOCUMENTS // max(1, min(counts.count(), values))))
    sampled = known.join(learned, "lang").filter(drawn(F.col("doc_id"), F.col("n"), each))

    @F.pandas_udf("array<binary>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        letters = _letters()
        for texts in batches:
            yield pd.Series([[v.astype(np.float16).tobytes() for t in _training_texts(text)
                              if (v := vector(t, letters)) is not None] for text in texts])

    rows = sorted((r["lang"], r["doc_id"], [bytes(v) for v in r["vectors"]])
                  for r in sampled.select("lang", "doc_id", vectors("text").alias("vectors")).collect())
    languages = sorted({lang for lang, _, held in rows if held})
    codes = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, codes, np.zeros((DIMENSIONS, 0)), np.zeros(0), np.zeros(0))
    x = np.stack([np.frombuffer(v, np.float16) for _, _, held in rows for v in held], dtype=np.float32)
    y = np.array([languages.index(lang) for lang, _, held in rows for _ in held])
    document = np.array([d for d, (_, _, held) in enumerate(rows) for _ in held])
    costs = 1.0 / (len(languages) * np.bincount(y, minlength=len(languages))[y])  # every language weighs the same
    testing = document % 4 == 0
    planes, offsets = _fit_bits(x[~testing], codes[y[~testing]], costs[~testing] / costs[~testing].sum())
    if testing.any():
        hits = codes[y[testing]] * (x[testing] @ planes + offsets) > 0
        error = np.clip(((~hits) * costs[testing][:, None]).sum(axis=0) / costs[testing].sum(), 0.005, 0.49)
    else:
        error = np.full(codes.shape[1], 0.25)
    weights = np.log((1 - error) / error)
    return LanguageModel(languages, codes, planes.astype(np.float32), offsets, weights / weights.mean())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of the predicted language) and ``ambiguous``.

    A null text and one without letters is ``und`` with score 0, as is any text if the model
    has met no language; with one language only, every text with letters is that one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as languages, bits and dimensions make it

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held, letters = shared.value, _letters()
        for texts in batches:
            out = []
            for text in texts:
                v = vector(text, letters) if text and held.languages else None
                if v is None:
                    out.append((NO_LANGUAGE, 0.0, False))
                    continue
                shares = held.shares(v[None])[0]
                first = int(shares.argmax())
                lead = shares[first] - np.delete(shares, first).max(initial=0.0)
                out.append((held.languages[first], float(shares[first]), bool(lead < CLEAR)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"])

    places = [f"_{i}" for i in range(len(docs.columns))]
    text = F.col(places[docs.columns.index("text")]).cast("string")
    done = docs.toDF(*places).withColumn("_best", best(text))
    return done.select(*[F.col(p).alias(c) for p, c in zip(places, docs.columns, strict=True)], "_best.*")


def language_report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for every row of ``docs``.

    Rows that repeat a doc_id or have none come back each; an empty table gives no rows.
    """
    model = fit(docs, sample)
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    done = predict(slim, model)
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return done.select("doc_id", crc.alias("held_out"), "lang_pred", "score", "ambiguous")
