"""Distinct words per document, then their mean per topic, as two chained stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamjobs.functions.parsing import split_tags
from streamjobs.functions.text import words
from streamjobs.operators.aggregates import avg_distinct_terms, distinct_terms

FIRST_STAGE = [(" File: ", "file"), (" Topic: ", "topic")]
SECOND_STAGE = [(" Frequency: ", "frequency"), (" Word: ", "word"), (" File: ", "file"), ("Topic: ", "topic")]


def document_terms(messages: DataFrame) -> DataFrame:
    """``<body> Topic: t File: f`` messages to the words of each document."""
    return distinct_terms(split_tags(messages, FIRST_STAGE), ["topic", "file"])


def document_terms_once(messages: DataFrame) -> DataFrame:
    """The first stage for an append stream: each word of a document is emitted when it first occurs.

    Its frequency is 1 from then on, so nothing is ever emitted again and the
    second stage may simply add up.
    """
    found = words(split_tags(messages, FIRST_STAGE), ["topic", "file"])
    return found.dropDuplicates(["topic", "file", "word"]).withColumn("frequency", F.lit(1).cast("long"))


def running_mean_terms(tagged: DataFrame) -> DataFrame:
    """The second stage as one stateful aggregation over lines that are emitted once."""
    return avg_distinct_terms(parse_terms(tagged), approx=True)


def running_mean(messages: DataFrame) -> DataFrame:
    """Exact mean number of distinct words per document and topic of a stream, both stages in one query.

    Every document adds a row without a word beside its words. Once repeats are dropped, the
    words of a topic are its distinct words per document, and the rows without a word its documents.
    """
    tagged = split_tags(messages, FIRST_STAGE)
    every = F.concat(F.split("value", " "), F.array(F.lit(None).cast("string")))
    seen = tagged.select("topic", "file", F.explode(every).alias("word")).dropDuplicates(["topic", "file", "word"])
    return seen.groupBy("topic").agg((F.count("word") / F.count_if(F.col("word").isNull())).alias("avg_words"))


def tagged_terms(terms: DataFrame) -> DataFrame:
    """The text form in which the first stage hands its rows to the second; null is empty text."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return terms.select(F.concat(F.lit("Topic: "), text("topic"), F.lit(" File: "), text("file"), F.lit("  Word: "), text("word"),
                                 F.lit("  Frequency: "), F.col("frequency").cast("string")).alias("value"))


def parse_terms(tagged: DataFrame) -> DataFrame:
    """The fields of the text form. Only the tag blanks around file, word and topic are removed."""
    parsed = split_tags(tagged, SECOND_STAGE, rest="_rest").drop("_rest")
    return parsed.withColumns({"word": F.rtrim("word"), "file": F.rtrim("file"), "topic": F.rtrim("topic")})


def mean_terms(tagged: DataFrame, approx: bool = False) -> DataFrame:
    """Mean number of distinct words per document and topic.

    The first stage emits a word again whenever its count changes; the last
    value of each (topic, file, word) counts once. On a stream the repeated rows
    carry the same frequency, so dropping duplicates does it. The frequency is a number
    before that: as text it would have all words sorted, and not hashed.
    """
    found = parse_terms(tagged).withColumn("frequency", F.col("frequency").try_cast("double"))
    latest = found.dropDuplicates(["topic", "file", "word"])
    return avg_distinct_terms(latest, approx=approx)


def mean_typed_terms(terms: DataFrame) -> DataFrame:
    """``mean_terms`` of the first stage's rows themselves, which hold each word of a document once."""
    return avg_distinct_terms(terms)


def mean_terms_text(means: DataFrame) -> DataFrame:
    return means.select(F.concat(F.lit("Topic: "), "topic", F.lit(" Avg number of words for this topic: "),
                                 F.col("avg_words").cast("string")).alias("value"))
