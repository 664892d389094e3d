"""Words, posts and sentiment."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.functions.parsing import drop_blank

# The patterns removed from a post, in this order.
POST_NOISE = [r"http\S+", r"@\w+", "#", "RT", ":"]

POST_END = "t_end"


def words(df: DataFrame, keep: list[str], text: str = "value", name: str = "word") -> DataFrame:
    """One row per word; a word ends at a single blank, so repeated blanks give empty words."""
    return df.select(*keep, F.explode(F.split(F.col(text), " ")).alias(name))


def without_noise(text: Column) -> Column:
    for pattern in POST_NOISE:
        text = F.regexp_replace(text, pattern, "")
    return text


def clean_posts(df: DataFrame, keep: list[str] | None = None, text: str = "value", end: str = POST_END,
                name: str = "post") -> DataFrame:
    """One row per post of a message; empty posts are dropped before the cleaning."""
    posts = df.select(*(keep or []), F.explode(F.split(F.col(text), end)).alias(name))
    return drop_blank(posts, [name]).withColumn(name, without_noise(F.col(name)))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and apostrophes."""
    return F.filter(F.split(F.lower(text), "[^a-z']+"), lambda w: w != "")


_BUCKETS = 4096


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(_BUCKETS))


def lexicon_buckets(lexicon: DataFrame, max_words: int = 100_000) -> Column:
    """The lexicon (word, polarity, subjectivity) as one constant: lists of entries by hash of the word.

    A map constant would be searched from end to end for every token. A lexicon
    is a dictionary of a language, so it does not grow with the data; its size
    is checked and a larger one is refused.
    """
    rows = (lexicon.select("word", "polarity", "subjectivity", _bucket(F.col("word")).alias("b"))
                   .limit(max_words + 1).collect())
    if len(rows) > max_words:
        raise ValueError(f"lexicon has more than {max_words} words; use scores_by_join")
    buckets: list[list[dict]] = [[] for _ in range(_BUCKETS)]
    for r in rows:
        buckets[r["b"]].append({"w": r["word"], "p": float(r["polarity"]), "s": float(r["subjectivity"])})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<w:string,p:double,s:double>>>")


def score_sentiment(df: DataFrame, lexicon: DataFrame, text: str = "post") -> DataFrame:
    """Mean polarity and subjectivity of a text's known words; 0 when none is known.

    Row-local: no shuffle, and it runs on an append stream.
    """
    buckets = lexicon_buckets(lexicon)

    def entry(word: Column) -> Column:
        return F.get(F.filter(F.get(buckets, _bucket(word).cast("int")), lambda e: e["w"] == word), F.lit(0))

    known = F.filter(F.transform(tokens(F.col(text)), entry), lambda e: e.isNotNull())

    def mean(field: str) -> Column:
        total = F.aggregate("_known", F.lit(0.0), lambda acc, e: acc + e[field])
        return F.coalesce(F.try_divide(total, F.size("_known").cast("double")), F.lit(0.0))

    scored = df.withColumn("_known", known)
    return scored.withColumns({"polarity": mean("p"), "subjectivity": mean("s")}).drop("_known")


def scores_by_join(df: DataFrame, lexicon: DataFrame, key: str, text: str = "post") -> DataFrame:
    """The same scores as (key, polarity, subjectivity), for a lexicon of any size.

    Words are counted per row before the equi-join on the word, so a frequent
    word is carried once per row of ``df``. ``key`` must be unique.
    """
    counts = (df.select(key, F.explode_outer(tokens(F.col(text))).alias("word"))
                .groupBy(key, "word").agg(F.count("word").alias("n")))
    joined = counts.join(lexicon.select("word", "polarity", "subjectivity"), "word", "left")
    n = F.sum(F.when(F.col("polarity").isNotNull(), F.col("n")))

    def mean(c: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(F.col("n") * F.col(c)), n), F.lit(0.0)).alias(c)

    return joined.groupBy(key).agg(mean("polarity"), mean("subjectivity"))
