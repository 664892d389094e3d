"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.llm.words import drawn, in_batches, rows_of
from streamjobs.session import written

#: At most about so many labelled rows are used to fit; all rows are scored.
SAMPLE = 12_000
#: At most so many words are learned, each from at least so many documents.
LEARNED, SEEN = 400, 4
#: Insults and second-person words that need no learning.
INSULTS = ("idiot moron stupid loser scum trash worthless disgusting pathetic dumb fool imbecile jerk garbage filth "
           "vermin hate kill ugly idiota estúpido basura imbécil asqueroso inútil crétin débile ordure minable nul "
           "dégoûtant dumm trottel abschaum müll wertlos ekelhaft verlierer").split()
SECOND_PERSON = "you your yours yourself u ur tu te toi vous votre du dich dir dein deine ihr euch usted tú ti tus vosotros".split()
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
NAMES = ("log_words", "insult_rate", "insult_any", "learned_rate", "learned_most", "learned_sum", "second_person_near",
         "second_person_rate", "capitals", "exclamations", "punctuation", "digits", "disguised_rate", "disguised_hits")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
NEAR = 5
#: Beginnings of words are learned like words, at these lengths.
BEGINNINGS = (5, 7)


def plain(word: str) -> str:
    return word.strip(_EDGE)


def forms(word: str) -> tuple[str, ...]:
    """What a word is looked up as: itself, and its beginnings."""
    return (word, *(word[:k] + "*" for k in BEGINNINGS if len(word) > k))


def weight_of(word: str, weights: dict[str, float]) -> float:
    return max(weights.get(f, 0.0) for f in forms(word))


def dense_features(text: str | None, weights: dict[str, float]) -> list[float]:
    """The numbers of ``NAMES`` for a whole text; a null or empty text has zeros."""
    text = text or ""
    raw = text.lower().split()
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    words = [plain(w) for w in raw]
    held = set(words)
    insults, persons = held & _INSULTS, held & _PERSONS
    learned = {w: v for w in held if (v := weight_of(w, weights))}
    disguised = disguised_hits = 0
    for w in held:
        if not w.isalpha() and not w.isdecimal():
            bare = plain(w.translate(DISGUISE)).replace("*", "").replace(".", "").replace("-", "")
            disguised += any(c.isalpha() for c in w)
            disguised_hits += bare in _INSULTS or weight_of(bare, weights) > 0
    hits = insults | learned.keys()
    near = 0
    places = [i for i, w in enumerate(words) if w in hits] if hits else []
    if places and persons:
        you = np.array([i for i, w in enumerate(words) if w in persons])
        at = np.searchsorted(you, places)
        ahead = you[np.minimum(at, len(you) - 1)]
        behind = you[np.maximum(at - 1, 0)]
        gap = np.minimum(np.abs(ahead - places), np.abs(behind - places))
        near = int((gap <= NEAR).sum())
    count_insults = sum(words[i] in insults for i in places)
    count_learned = sum(learned.get(words[i], 0.0) for i in places)
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(codes, minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    marks = counts[33:127].sum() - upper - lower - digits
    return [math.log1p(n), count_insults / n, float(len(insults)), count_learned / n,
            max(learned.values(), default=0.0), sum(learned.values()), near / n,
            float(sum(w in persons for w in words) if persons else 0) / n, upper / max(1, upper + lower),
            (counts[33] + counts[63]) / len(codes), marks / len(codes), digits / len(codes), disguised / n, float(disguised_hits)]


_INSULTS, _PERSONS = frozenset(INSULTS), frozenset(SECOND_PERSON)


def features(text: Column, weights: dict[str, float]) -> Column:
    """:func:`dense_features` as an array column; ``weights`` holds at most ``LEARNED`` words."""
    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([dense_features(t, weights) for t in texts])

    return of(text)


def learned_words(labelled: DataFrame) -> dict[str, float]:
    """Words that stand in more toxic documents than chance gives, with their log odds, at most ``LEARNED``.

    Both kinds of label have to be there.
    """
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64())])

    def run(batches):
        rows = ((f, toxic) for text, toxic in rows_of(batches, "text", "toxic")
                for f in {f for w in set((text or "").lower().split()) for f in forms(plain(w)) if f})
        return in_batches(rows, schema, size=20_000)

    once = labelled.withColumn("_text", F.xxhash64("text")).dropDuplicates(["_text"])  # copies are no evidence
    n, n_toxic = once.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    rate = n_toxic / n
    words = (once.select("text", F.col("toxic").cast("long")).mapInArrow(run, "word string, toxic long")
                 .groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")))
    clean = F.col("n") - F.col("k")
    odds = (F.log((F.col("k") + 0.5) / (n_toxic - F.col("k") + 0.5))
            - F.log((clean + 0.5) / (n - n_toxic - clean + 0.5)))
    # Log likelihood ratio against a word that does not care for the label.
    surprise = 2 * (F.col("k") * F.log(F.col("k") / (F.col("n") * rate))
                    + F.when(clean > 0, clean * F.log(clean / (F.col("n") * (1 - rate)))).otherwise(0.0))
    best = (words.filter((F.col("n") >= SEEN) & (F.col("k") > 0)).select("word", odds.alias("odds"), surprise.alias("llr"))
                 .filter((F.col("llr") > 20) & (F.col("odds") > 2)).orderBy(F.desc("llr"), "word").limit(LEARNED))
    return {r["word"]: float(r["odds"]) for r in best.collect()}


class ToxicityModel:
    """Learned words, trees and calibration; without labels of both kinds a constant."""

    def __init__(self, weights: dict[str, float], trees: GBTClassificationModel | None,
                 calibration: IsotonicRegressionModel | None, rate: float):
        self.weights, self.trees, self.calibration, self.rate = weights, trees, calibration, rate

    def score(self, docs: DataFrame, name: str = "score") -> DataFrame:
        """``docs`` with all its columns and ``name``: 0 to 1, the calibrated chance of label 1."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.rate))
        columns, places = docs.columns, [f"_{i}" for i in range(len(docs.columns))]
        text = F.col(places[columns.index("text")]).cast("string")
        placed = docs.toDF(*places).withColumn("features", array_to_vector(features(text, self.weights)))
        raw = self.trees.transform(placed).withColumn("raw", vector_to_array("probability")[1])
        done = self.calibration.transform(raw).withColumn("_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")))
        return done.select(*[F.col(p).alias(c) for p, c in zip(places, columns, strict=True)], F.col("_score").alias(name))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from; a null doc_id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on about ``sample`` of the labelled documents that are not held out, drawn by the hash of doc_id.

    Repeated labels of a document count once, as toxic if one of them says so. Three quarters
    give the words and the trees, the rest the calibration. Null labels are left out.
    """
    known = (labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna()
                   .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = written(known, "known")
    sampled = known.filter(drawn(F.col("doc_id"), F.lit(max(1, known.count())), sample))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(texts.join(F.broadcast(sampled), "doc_id").withColumn(  # the draw is bounded by ``sample``
        "part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))), "labelled")
    fitting, calibrating = rows.filter("part > 0"), rows.filter("part = 0")
    counts = [{r["toxic"]: r["count"] for r in part.groupBy("toxic").count().collect()} for part in (fitting, calibrating)]
    if any(set(c) != {0, 1} for c in counts):
        every = {k: sum(c.get(k, 0) for c in counts) for k in (0, 1)}
        return ToxicityModel({}, None, None, every[1] / max(1, sum(every.values())))
    weights = learned_words(fitting)
    dense = written(rows.select("doc_id", "part", F.col("toxic").cast("double").alias("label"),
                                features(F.col("text"), weights).alias("dense")), "dense")
    dense = dense.select("part", "label", array_to_vector("dense").alias("features")).coalesce(8)
    trees = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(dense.filter("part > 0"))
    raw = trees.transform(dense.filter("part = 0")).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", predictionCol="calibrated").fit(raw)
    return ToxicityModel(weights, trees, calibration, 0.0)


def toxicity_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts are scored like a text without words. Rows that repeat a doc_id or
    have none come back each; an empty table gives no rows. Without labels of both kinds the
    score is the share of toxic ones among the labels there are, 0 without any.
    """
    scored = fit(docs, labels, sample).score(docs.select(F.col("doc_id").cast("long"), "text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is below 0.5."""
    scored = fit(docs, labels, sample).score(docs, "_score_of_text")
    return scored.filter("_score_of_text < 0.5").drop("_score_of_text")
