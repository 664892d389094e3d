"""Words, documents and posts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from streamjobs.catalog.registry import plain, query, stream, table
from streamjobs.functions.text import clean_posts, score_sentiment, scores_by_join
from streamjobs.operators.aggregates import word_count as count_words
from streamjobs.plans import document_analytics as docs
from streamjobs.plans.text_sentiment import sentiment
from streamjobs.session import fresh_path
from streamjobs.sources.topics import file_source, read_topic
from streamjobs.streaming.runs import collect_append, collect_complete, collect_ordered
from streamjobs.streaming.sinks import file_sink, start

# A small lexicon of words that occur in the texts: word, polarity, subjectivity.
LEXICON = [("the", 0.25, 0.5), ("and", 0.5, 0.25), ("of", -0.25, 0.75), ("is", 0.75, 1.0), ("with", -0.5, 0.5),
           ("that", -0.75, 0.25), ("que", 0.25, 0.25), ("la", -0.25, 0.5), ("et", 0.5, 0.75), ("un", -1.0, 1.0)]
_LEXICON_SQL = ", ".join(f"('{w}', {p}, {s})" for w, p, s in LEXICON)


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, polarity double, subjectivity double")


def messages(df):
    """Documents as tagged messages."""
    return df.select(F.concat("text", F.lit(" Topic: "), "source", F.lit(" File: "),
                              F.col("doc_id").cast("string")).alias("value"))


@query("""SELECT word, count(*) AS count
          FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word""")
def word_count(spark, sf):
    return count_words(table(spark, sf, "documents"), "text")


@query("""SELECT word, count(*) AS count
          FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY word""")
def word_count_stream(spark, sf):
    return collect_complete(count_words(stream(spark, sf, "conversations"), "text"))


@query("""SELECT source AS topic, CAST(doc_id AS VARCHAR) AS file, word, CAST(1 AS BIGINT) AS frequency,
                 count(*) AS term_count
          FROM (SELECT source, doc_id, unnest(string_split(text, ' ')) AS word FROM documents)
          GROUP BY source, doc_id, word""")
def doc_term_tags(spark, sf):
    return docs.document_terms(messages(table(spark, sf, "documents")))


_MEAN = """WITH w AS (SELECT DISTINCT source, doc_id, rtrim(word, ' ') AS word FROM
                      (SELECT source, doc_id, unnest(string_split(text, ' ')) AS word FROM documents))
           SELECT source AS topic, count(*) * 1.0::DOUBLE / count(DISTINCT doc_id) AS avg_words FROM w GROUP BY source"""


@query(_MEAN)
def doc_avg_distinct_words(spark, sf):
    """Both stages in one batch, without the text form between them."""
    return docs.mean_typed_terms(docs.document_terms(messages(table(spark, sf, "documents"))))


_CLOSE = "SELECT DISTINCT source AS topic, true AS close FROM documents"


def _close(spark, sf, approximate):
    """Whether the number of files that each topic's approximate mean stands for is within 10 percent, or 1, of the exact one."""
    files = table(spark, sf, "documents").groupBy(F.col("source").alias("topic")).agg(F.countDistinct("doc_id").alias("_n"))
    both = (approximate.withColumnRenamed("avg_words", "_approx").join(doc_avg_distinct_words(spark, sf), "topic", "full")
                       .join(files, "topic", "full"))
    implied = F.col("_n") * F.col("avg_words") / F.col("_approx")
    close = F.abs(implied - F.col("_n")) <= F.greatest(F.lit(1.0), F.col("_n") * 0.1) + 1e-6
    return both.select("topic", F.coalesce(close, F.lit(False)).alias("close"))


@query(_CLOSE)
def doc_avg_distinct_words_approx(spark, sf):
    terms = docs.document_terms(messages(table(spark, sf, "documents")))
    return _close(spark, sf, docs.mean_terms(docs.tagged_terms(terms), approx=True))


def _term_topic(spark, sf) -> str:
    """First stage: a stream of documents to a topic of tagged words, as text files."""
    path = fresh_path(spark, "terms")
    lines = docs.tagged_terms(docs.document_terms_once(messages(stream(spark, sf, "documents"))))
    start(lines, file_sink(path), "append", available_now=True).awaitTermination()
    return path


@query("""SELECT DISTINCT 'Topic: ' || source || ' File: ' || doc_id || '  Word: ' || word || '  Frequency: 1' AS value
          FROM (SELECT source, doc_id, unnest(string_split(text, ' ')) AS word FROM documents)""")
def doc_term_topic_stream(spark, sf):
    return spark.read.schema("value string").parquet(_term_topic(spark, sf))


@query(_MEAN)
def doc_avg_distinct_words_stream(spark, sf):
    """The tagged words of the stream, averaged exactly by a batch."""
    return docs.mean_terms(spark.read.schema("value string").parquet(_term_topic(spark, sf)))


@query(_CLOSE)
def doc_avg_chained_streams(spark, sf):
    """Both stages as streams, the second reading what the first has written."""
    source = file_source(_term_topic(spark, sf), schema=T.StructType([T.StructField("value", T.StringType())]))
    return _close(spark, sf, collect_complete(docs.running_mean_terms(read_topic(spark, source))))


@query(_MEAN)
def doc_avg_one_stream(spark, sf):
    """Both stages in one query, exact, without files between them."""
    return collect_complete(docs.running_mean(messages(stream(spark, sf, "documents"))))


@query(f"""WITH m AS ({_MEAN}) SELECT topic, 'Topic: ' || topic || ' Avg number of words for this topic: ' AS head,
             round(avg_words, 9) AS avg_words FROM m""")
def doc_avg_text(spark, sf):
    """The text output of the second stage, taken apart again."""
    lines = docs.mean_terms_text(docs.mean_terms(docs.tagged_terms(docs.document_terms(messages(table(spark, sf, "documents"))))))
    parts = F.regexp_extract("value", "^(Topic: (.*) Avg number of words for this topic: )(.*)$", 1)
    return lines.select(F.regexp_extract("value", "^Topic: (.*) Avg number", 1).alias("topic"), parts.alias("head"),
                        F.round(F.regexp_extract("value", ": ([^:]*)$", 1).cast("double"), 9).alias("avg_words"))


@query("""WITH w AS (SELECT source AS topic, CAST(doc_id AS VARCHAR) AS file, count(DISTINCT word) AS n_words FROM
            (SELECT source, doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY ALL)
          SELECT topic, file, n_words, row_number() OVER (ORDER BY topic, file) AS place FROM w""")
def doc_terms_ordered_stream(spark, sf):
    """Words per document in complete mode, each batch in the order of topic and file; the place is that in the output."""
    found = docs.document_terms_once(messages(stream(spark, sf, "documents")))
    counts = found.groupBy("topic", "file").agg(F.count(F.lit(1)).alias("n_words")).orderBy("topic", "file")
    return collect_ordered(counts, "place")


_CLEANED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p,
               'http\S+', '', 'g'), '@\w+', '', 'g'), '#', '', 'g'), 'RT', '', 'g'), ':', '', 'g')"""


@query(f"""SELECT conv_id, turn, {_CLEANED} AS post
           FROM (SELECT conv_id, turn, unnest(string_split(text, 't_end')) AS p FROM conversations) WHERE p <> ''""")
def tweet_clean(spark, sf):
    return clean_posts(table(spark, sf, "conversations"), ["conv_id", "turn"], "text")


@query(f"""SELECT page_id, {_CLEANED} AS post
           FROM (SELECT page_id, unnest(string_split(html, 't_end')) AS p FROM pages) WHERE p <> ''""")
def page_clean(spark, sf):
    return clean_posts(table(spark, sf, "pages"), ["page_id"], "html")


def _score_sql(key: str, posts: str, text: str) -> str:
    return f"""WITH lex(word, pol, sub) AS (VALUES {_LEXICON_SQL}),
      posts AS ({posts}),
      tok AS (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^a-z'']+')) AS word FROM posts),
      s AS (SELECT {key}, avg(CAST(pol AS DOUBLE)) AS pol, avg(CAST(sub AS DOUBLE)) AS sub
            FROM tok JOIN lex USING (word) GROUP BY {key})"""


_POST_SQL = _score_sql("conv_id, turn", "SELECT conv_id, turn, " + _CLEANED + """ AS post FROM
      (SELECT conv_id, turn, text AS p FROM conversations) WHERE p <> ''""", "post") + """
      SELECT conv_id, turn, post, coalesce(pol, 0.0) AS polarity, coalesce(sub, 0.0) AS subjectivity
      FROM posts LEFT JOIN s USING (conv_id, turn)"""


@query(_POST_SQL)
def lexicon_sentiment(spark, sf):
    posts = table(spark, sf, "conversations").withColumnRenamed("text", "value")
    return sentiment(posts, lexicon(spark), ["conv_id", "turn"])


@query(_POST_SQL)
def lexicon_sentiment_stream(spark, sf):
    posts = stream(spark, sf, "conversations").withColumnRenamed("text", "value")
    return collect_append(sentiment(posts, lexicon(spark), ["conv_id", "turn"]))


@query(_score_sql("doc_id", "SELECT doc_id, text FROM documents", "text") + """
      SELECT doc_id, coalesce(pol, 0.0) AS polarity, coalesce(sub, 0.0) AS subjectivity
      FROM documents LEFT JOIN s USING (doc_id)""")
def document_sentiment(spark, sf):
    return scores_by_join(table(spark, sf, "documents"), lexicon(spark), "doc_id", "text")


@query(_score_sql("doc_id", "SELECT doc_id, text FROM documents", "text") + """
      SELECT doc_id, coalesce(pol, 0.0) AS polarity, coalesce(sub, 0.0) AS subjectivity
      FROM documents LEFT JOIN s USING (doc_id)""")
def document_sentiment_rowwise(spark, sf):
    scored = score_sentiment(table(spark, sf, "documents"), lexicon(spark), "text")
    return plain(scored.select("doc_id", "polarity", "subjectivity"))
