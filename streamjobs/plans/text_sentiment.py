"""Posts with polarity and subjectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame

from streamjobs.functions.text import clean_posts, score_sentiment


def sentiment(messages: DataFrame, lexicon: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Split, clean and score; stateless, so it appends on a stream."""
    return score_sentiment(clean_posts(messages, keep), lexicon)
