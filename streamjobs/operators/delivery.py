"""Which consumer got which message, as bits of message numbers.

A message's number is the digits at the end of its id. 64 neighbouring numbers of a producer
are one word: sent messages are a word per topic, receipts a word per consumer, unconfirmed
messages a word. Log lines become words by an aggregate with partial results, so repeats
and runs of ids shrink before the shuffle; what is missing, inconsistent or counted is bit
arithmetic between words. Cells are written out only where asked for. There is no limit on
consumers, and nothing is brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamjobs.functions.scalar import topic_colour
from streamjobs.operators.latency import MESSAGE

DELIVERED = 255
_SIZE = 64
_DIGITS = "([0-9]{1,15})$"
#: A word of 64 message numbers of a producer; ``_prefix`` and ``_width`` keep the form of the id.
_WORD = ["prod_id", "_prefix", "_width", "_word"]


def _words(df: DataFrame, *keys: str) -> DataFrame:
    """``_bits`` of the messages in ``df`` by word and ``keys``; rows without producer or id count for nothing."""
    digits = F.regexp_extract("msg_id", _DIGITS, 1)
    number = F.when(digits != "", digits.cast("long")).otherwise(F.lit(0).cast("long"))
    placed = df.filter("prod_id IS NOT NULL AND msg_id IS NOT NULL").select(
        "prod_id", F.regexp_replace("msg_id", _DIGITS, "").alias("_prefix"), F.length(digits).alias("_width"),
        F.call_function("div", number, F.lit(_SIZE).cast("long")).alias("_word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), (number % _SIZE).cast("int")).alias("_bit"), *keys)
    return placed.groupBy(*_WORD, *keys).agg(F.bit_or("_bit").alias("_bits"))


def _and_not(bits: Column, other: Column) -> Column:
    return bits.bitwiseAND(F.bitwise_not(F.coalesce(other, F.lit(0).cast("long"))))


def _sent(prod: DataFrame) -> DataFrame:
    """Sent messages by word and topic; one that was sent to several topics counts for the one of least number."""
    numbered = prod.select("prod_id", "msg_id", F.col("topic_id").try_cast("long").alias("_topic"))
    before = Window.partitionBy(*_WORD).orderBy(F.col("_topic").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    words = _words(numbered, "_topic").withColumn("_sent", _and_not(F.col("_bits"), F.bit_or("_bits").over(before)))
    return words.filter("_sent <> 0").select(*_WORD, F.col("_topic").cast("string").alias("topic_id"), "_sent")


def delivery_words(prod: DataFrame, cons: DataFrame, consumers: DataFrame, confirmations: DataFrame | None = None,
                   buckets: int = 32) -> DataFrame:
    """For every word, topic and consumer the bits ``_sent``, ``_got`` and ``_unconfirmed``.

    ``consumers`` has ``consumer_id``; each is expected to get every message. Words are dealt to
    ``buckets``, and the consumers listed once in each, so that words meet consumers by an
    equi-join; there is one row for 64 cells of the matrix. Receipts of consumers that are
    not among ``consumers`` count for nothing.
    """
    spread = F.pmod(F.xxhash64(*_WORD), F.lit(buckets)).cast("int")
    expected = (consumers.select(F.col("consumer_id").cast("int").alias("consumer_id")).filter("consumer_id IS NOT NULL").distinct()
                         .withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))))
    pairs = _sent(prod).withColumn("_bucket", spread).join(expected, "_bucket").drop("_bucket")
    got = _words(cons.withColumn("consumer_id", F.col("consumer_id").cast("int")), "consumer_id").withColumnRenamed("_bits", "_got")
    joined = pairs.join(got, [*_WORD, "consumer_id"], "left")
    none = F.lit(0).cast("long")
    if confirmations is None:
        joined = joined.withColumn("_unconfirmed", none)
    else:
        unconfirmed = _words(confirmations.filter(F.col("confirmed") == 0)).withColumnRenamed("_bits", "_unconfirmed")
        joined = joined.join(unconfirmed, _WORD, "left")
    return joined.select(*_WORD, "topic_id", "consumer_id", "_sent", F.coalesce("_got", none).alias("_got"),
                         F.coalesce("_unconfirmed", none).alias("_unconfirmed"))


def _messages(words: DataFrame, bits: Column, *more: Column) -> DataFrame:
    """A row per set bit: the message, its consumer and ``more``, columns that may use the bit's place ``_place``."""
    places = F.filter(F.sequence(F.lit(0), F.lit(_SIZE - 1)), lambda b: F.getbit("_wanted", b) == 1)
    rows = (words.withColumn("_wanted", bits).filter("_wanted <> 0").withColumn("_place", F.explode(places))
                 .withColumn("msg_id", F.when(F.col("_width") > 0, F.concat("_prefix", F.lpad(
                     (F.col("_word") * _SIZE + F.col("_place")).cast("string"), F.col("_width"), F.lit("0")))).otherwise(F.col("_prefix"))))
    return rows.select(*MESSAGE, "consumer_id", *more)


def delivery_matrix(words: DataFrame, n_topics: int) -> DataFrame:
    """All cells: 255 where delivered (or unconfirmed, shown as sent), else the topic's shade."""
    delivered = F.getbit(F.col("_got").bitwiseOR(F.col("_unconfirmed")), F.col("_place")) == 1
    shade = topic_colour(F.col("topic_id").try_cast("int"), n_topics)
    return _messages(words, F.col("_sent"), F.when(delivered, F.lit(DELIVERED)).otherwise(shade).alias("cell"))


def undelivered(words: DataFrame, max_index: int | None = None) -> DataFrame:
    """Missing (message, consumer) cells; an unconfirmed message counts as sent."""
    rows = _messages(words, _and_not(_and_not(F.col("_sent"), F.col("_got")), F.col("_unconfirmed")))
    return rows if max_index is None else rows.filter(F.col("msg_id").try_cast("long") < max_index)


def inconsistent(words: DataFrame) -> DataFrame:
    """Messages the broker did not confirm that were received all the same."""
    return _messages(words, F.col("_sent").bitwiseAND(F.col("_got")).bitwiseAND(F.col("_unconfirmed")))


def delivery_counts(words: DataFrame) -> DataFrame:
    """Per topic and consumer the messages sent, received, missing and unconfirmed: bit counts, no cell is written out."""
    sent, got, unconfirmed = F.col("_sent"), F.col("_got"), F.col("_unconfirmed")

    def counted(bits: Column, name: str) -> Column:
        return F.sum(F.bit_count(bits)).cast("long").alias(name)

    return words.groupBy("topic_id", "consumer_id").agg(
        counted(sent, "n_sent"), counted(sent.bitwiseAND(got), "n_received"),
        counted(_and_not(_and_not(sent, got), unconfirmed), "n_missing"), counted(sent.bitwiseAND(unconfirmed), "n_unconfirmed"))


def message_lookup(wanted: DataFrame, prod: DataFrame, order: str = "produced_ts") -> DataFrame:
    """The first producer entry for each wanted producer and zero-padded message id."""
    first = prod.groupBy("prod_id", "msg_id").agg(
        F.min_by(F.struct("topic_id", "produced_ts"), F.struct(order, "topic_id")).alias("_m"))
    return (wanted.select("prod_id", "msg_id").distinct().join(first, ["prod_id", "msg_id"])
                  .select("prod_id", "msg_id", "_m.topic_id", "_m.produced_ts"))
